"""Connected components of an edge table by alternating large and small stars, with every round stored, and groups of rows named by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, looked_up, settled, stored


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: u > v, distinct. Each node hands its smallest neighbour (or itself) to its larger (or smaller) neighbours."""
    one = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    sides = one.union(edges.select(F.col("v").alias("a"), F.col("u").alias("b"))) if large else one
    least = sides.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).withColumn("m", F.least("a", "m"))
    met = looked_up(sides, "a", least, "size", total)  # a star's centre may have any number of neighbours
    if large:
        out = met.filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (u, v) but the smallest ones themselves; stored."""

    def rounds() -> DataFrame:
        ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = settled(lambda: ordered.filter("u > v").distinct(), "edges")
        mark = None
        while True:
            seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if seen == mark or seen[0] == 0:
                return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            mark, last = seen, now
            now = settled(lambda last=last, n=seen[0]: _star(_star(last, True, 2 * n), False, 2 * n), "edges")

    return settled(rounds, "components")


def grouped(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ``key``; stored) with label (the smallest key reachable over ``edges``) and component_id, its rows' smallest doc_id.

    component_id is null where all doc_ids of a label are null.
    """
    found = components(edges).select(F.col("node").alias(key), "component")
    nodes = rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    nodes = stored(nodes.join(found, key, "left").withColumn("label", F.coalesce("component", key)).drop("component"), "nodes")
    labels = nodes.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("keys"))
    named = looked_up(nodes, "label", labels, "keys", nodes.count())
    return looked_up(rows, key, named.select(key, "label", "component_id", "size"), "size", rows.count())


def one_each(docs: DataFrame, groups: DataFrame, id_col: str, row: str, row_of) -> DataFrame:
    """``docs`` with one row of each label of ``groups`` (doc_id, ``row``, label, component_id), that of smallest id, then smallest ``row``.

    ``row_of`` computes ``row`` from ``docs``. Of equal rows of that id the first stays.
    """
    mine = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label", "component_id").agg(F.min(row).alias(row))
    same, digest, place = fresh("same_id", docs), fresh("same_row", docs), fresh("place", docs)
    keep = mine.select(F.col("component_id").alias(same), F.col(row).alias(digest)).distinct()
    met = docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep[same]) & (row_of == keep[digest]))
    return met.withColumn(place, F.row_number().over(Window.partitionBy(same, digest).orderBy(F.lit(0)))).filter(F.col(place) == 1).select(docs.columns)
