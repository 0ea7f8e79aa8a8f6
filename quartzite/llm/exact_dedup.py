"""Exact deduplication by skew-safe combining, in DataFrame functions only.

1. Local: rows of one input partition with equal (digest, content) become one row, by the partial aggregate that runs
   before the shuffle.
2. Salted: those rows meet per (salt, digest, content), the salt being a hash of the id. A group that holds a third of all rows
   reaches a salt task as one row per input partition.
3. Global: the winners of the salts, at most ``salts`` rows per group, meet per (digest, content). The winner goes back to each salt
   that had the group, so that looking it up is dealt over the salts too.

The whole normalised text is a grouping key at every step, so a digest collision can't merge two texts. Documents then
look their winner up by two digests and the length; should two texts ever agree in all three, the job stops with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; ``salts`` is 63 at most.

    Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]. The row with the most code points
    in the original text stays, then the one with the smallest id. Null text counts as empty; empty texts are one group.
    A null id counts as larger than any other. Repeated rows of one id each give a row, all kept or all dropped together; an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= salts <= 63:
        raise ValueError("salts must be 1 to 63")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(F.col(text_col)).alias("content"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
    ).withColumns({"text_sha256": F.sha2(F.col("content"), 256), "mix": F.xxhash64("content"), "size": F.length("content"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
    # Most points first, then the smallest id, as one number: 2^64 is above any id's range, and a null id counts as the largest.
    rank = F.col("points").cast("decimal(38,0)") * _number(2**64) - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), _number(2**63))
    key = ["text_sha256", "mix", "size"]
    salted = (
        rows.select(*key, "content", "salt", rank.cast("decimal(38,0)").alias("rank"), F.col("points"))
        .groupBy("salt", *key, "content")
        .agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        salted.groupBy(*key, "content")
        .agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.sum("n").alias("n"), F.expr("bit_or(shiftleft(1L, salt))").alias("in_salts"))
        .groupBy(*key)
        .agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.sum("n").alias("group_size"), F.bit_or("in_salts").alias("in_salts"), F.count(F.lit(1)).alias("texts"))
        .withColumn("sure", F.when(F.col("texts") == 1, True).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("boolean")))
        .filter("sure")
        .select(*key, "group_size", "in_salts", (F.col("points").cast("decimal(38,0)") * _number(2**64) - F.col("rank")).alias("id"))
        .select(*key, "group_size", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit(F.col("in_salts"), i) == 1)).alias("salt"), F.when(F.col("id") < _number(2**63), F.col("id").cast("long")).alias("keep_id"))
    )
    return rows.select("doc_id", *key, "salt").join(winners, [*key, "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that :func:`exact_groups` keeps; all columns stay.

    Of repeated rows of that id and text, the first in the order of their original texts stays.
    """
    digest, same, place = fresh("digest", docs), fresh("same_id", docs), fresh("place", docs)
    keep = exact_groups(docs, id_col, text_col, salts).filter("kept").select(F.col("doc_id").alias(same), F.col("text_sha256").alias(digest)).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.join(keep, docs[id_col].eqNullSafe(keep[same]) & (F.sha2(normalised(docs[text_col]), 256) == keep[digest]))
    one = F.row_number().over(Window.partitionBy(same, digest).orderBy(F.desc(F.length(text)), text))
    return met.withColumn(place, one).filter(F.col(place) == 1).select(docs.columns)
