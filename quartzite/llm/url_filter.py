"""URL block and allow lists by a sort-merge range join.

A rule (host, path) covers the host and its subdomains. Written with reversed labels, ``net.example.``, a host is a prefix of all its
subdomains, so each rule host is an interval of the sorted keys. One sweep over sorted urls and sorted rules keeps a stack of the rules whose
interval is open; they are nested, so the stack is the chain of a url's rule hosts. Of their rules the longest that fits wins.

A rule table of up to ``local_rules`` rows goes to every task and is swept against the urls of each batch, without a shuffle. A larger one
is cut into key ranges of about that size. A range gets as many salts as it has ``urls_per_task`` urls, its urls are dealt over them, a rule
goes to each range its interval meets, and each (range, salt) is swept by itself. Urls without a host meet no rule and stay out of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# The production rules (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
OUT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Node:
    """The rules of one host: path -> (length, verdict), looked up by the lengths that occur, longest first."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def best(self, path: str) -> tuple[int, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.paths:
                return self.paths[path[:n]]
        return None


def nodes_of(rules: list[tuple[str, str, str]]) -> list[Node]:
    """Sorted nodes of rules (verdict, host, path). Of equal rules with both verdicts, block holds."""
    at: dict[str, Node] = {}
    for verdict, host, path in rules:
        node = at.setdefault(key_of(host), Node(key_of(host)))
        if node.paths.get(path, (0, "", ""))[2] != "block":
            node.paths[path] = (len(host) + len(path), host + path, verdict)
    for node in at.values():
        node.lengths = sorted({len(p) for p in node.paths}, reverse=True)
    return sorted(at.values(), key=lambda x: x.key)


def sweep(hosts: list[str], paths: list[str], nodes: list[Node], default: str) -> tuple[list[str | None], list[str]]:
    """Rule and verdict of each url."""
    keys = [key_of(h) for h in hosts]
    rule: list[str | None] = [None] * len(keys)
    verdict = [default] * len(keys)
    stack: list[Node] = []
    k = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        while k < len(nodes) and nodes[k].key <= key:
            while stack and not nodes[k].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(nodes[k])
            k += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        found = max((b for n in stack if (b := n.best(paths[i]))), key=lambda b: b[0], default=None)
        if found:
            rule[i], verdict[i] = found[1], found[2]
    return rule, verdict


def _judged(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))


def _swept(page: pa.Array, host: pa.Array, path: pa.Array, nodes: list[Node], default: str) -> list[pa.Array]:
    rule, verdict = sweep(host.to_pylist(), path.to_pylist(), nodes, default)
    return [page, host, path, pa.array(rule, pa.string()), pa.array(verdict, pa.string())]


NAMES = [x.split()[0] for x in OUT.split(", ")]


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", local_rules: int = 200_000, urls_per_task: int = 200_000) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict of every row of ``pages``; ``rules`` has verdict, host, path.

    A null url or one without ``://`` has an empty host and path. A path fits if it starts with the rule's. The longest rule (host and path
    together) wins, of two of equal length that of the outer host. Rules with a null or empty host are ignored, a null path counts as empty. Repeated rows each give a row; an empty table gives none.
    """
    urls = _judged(pages, id_col, url_col)
    listed = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).filter("host <> ''")
    known = [tuple(r) for r in listed.limit(local_rules + 1).collect()]
    if len(known) <= local_rules:
        nodes = nodes_of(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(_swept(*batch.columns, nodes, default), names=NAMES)

        return urls.mapInArrow(run, OUT)
    return _by_ranges(urls, listed, default, local_rules, urls_per_task)


def _by_ranges(urls: DataFrame, listed: DataFrame, default: str, local_rules: int, urls_per_task: int) -> DataFrame:
    """For rule tables that no task should hold: the same sweep per key range and salt."""
    ranges = -(-listed.count() // max(1, local_rules // 2))
    # A sample of 64 keys a range sets the cuts; it decides how even the ranges are, not what they return.
    cuts = sorted(key_of(r.host) for r in listed.select("host").orderBy(F.xxhash64("host"), "host").limit(64 * ranges).collect())[63::64]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([bisect_right(cuts, key_of(h)) for h in batch.column(1).to_pylist()], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["at", "page_id", "host", "path"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, v, h, p) for v, h, p in zip(*[c.to_pylist() for c in batch.columns], strict=True) for a in range(bisect_right(cuts, key_of(h)), bisect_right(cuts, key_of(h) + chr(0x10FFFF)) + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("at", pa.int32()), ("verdict", pa.string()), ("host", pa.string()), ("path", pa.string())]))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = nodes_of(list(zip(*[right.column(c).to_pylist() for c in ("verdict", "host", "path")], strict=True)))
        own = left.combine_chunks()
        cols = [pa.concat_arrays(own.column(c).chunks) if own.num_rows else pa.array([], own.schema.field(c).type) for c in ("page_id", "host", "path")]
        return pa.Table.from_arrays(_swept(*cols, nodes, default), names=NAMES)

    placed = stored(urls.filter("host <> ''").mapInArrow(place, "at int, page_id long, host string, path string"), "urls")
    salts = F.broadcast(placed.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / urls_per_task).cast("int").alias("salts")))  # a row per range
    # The number keeps even copies of one url apart.
    dealt = placed.join(salts, "at").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")).cast("int")).drop("salts")
    copies = listed.mapInArrow(spread, "at int, verdict string, host string, path string").join(salts, "at").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    found = dealt.groupBy("at", "salt").cogroup(copies.groupBy("at", "salt")).applyInArrow(judge, OUT)
    return found.unionByName(urls.filter("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
