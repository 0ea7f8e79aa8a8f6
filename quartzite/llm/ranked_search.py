"""Ranked lexical search by a two-level quantised index.

1. Index. One pass over the documents keeps, per document, the terms of the queries with their numbers of occurrences; N, L and the document
   frequencies are aggregates of it. A term's impact in a document, (1e9 tf) div (1000 tf + 12 m), is below 1e6, so one upward-rounded byte
   bounds it from both sides within a ``QUANTUM``. The bytes are the first level, the numbers behind them the second.
2. Bounds. A pass over the bytes alone gives each task's ``k`` greatest lower bounds per query; the kth of all tasks is the query's threshold.
3. Rescoring. Every document whose upper bound reaches the threshold is scored in exact integers, and the ``k`` best of those are the result.
   A document of the result has a score of the kth lower bound at least, so none is lost, ties included.

The queries' dictionary and weights go to every task; a query set of more than ``MAX_TERMS`` terms is dealt into groups that are searched one
after another. Documents are never shuffled by term, so no frequent term meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Distinct (query, term) pairs of a group of queries; at some 50 bytes each, what goes to a task.
MAX_TERMS = 500_000
QUANTUM = -(-1_000_000 // 255)
#: Documents times queries, and (posting, query) pairs, that a task holds at a time.
CELLS, PAIRS = 1 << 21, 1 << 20
SALTS = 64

#: Maps bytes of UTF-8: letters, digits and all of other characters stay, A-Z are lower-cased, the rest is blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_TERMS).split()


def query_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query (unique row number), item, term, times: the terms of each query with their repeats."""
    numbered = items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    terms = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda t: t != "")
    return numbered.select("query", "item", F.explode(terms).alias("term")).groupBy("query", "item", "term").agg(F.count(F.lit(1)).alias("times"))


class Queries:
    """A group of queries: term numbers, and per term the (query, times) pairs as rows of a sparse matrix."""

    def __init__(self, rows: list):
        self.queries = sorted({r.query for r in rows})
        number = {q: i for i, q in enumerate(self.queries)}
        self.terms = {t: i for i, t in enumerate(sorted({r.term.encode() for r in rows}))}
        pairs = sorted((self.terms[r.term.encode()], number[r.query], r.times) for r in rows)
        of, self.query, self.times = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.begin = np.searchsorted(of, np.arange(len(self.terms) + 1))

    def weighted(self, frequency: dict[int, int], n_docs: int) -> None:
        """Sets ``weight``: times * w of each pair, by the terms' document frequencies."""
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(self.terms))], dtype=np.int64)
        self.weight = self.times * np.repeat(w, np.diff(self.begin))

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For postings of these terms: (place among the postings, place among the pairs) of every query of each posting's term."""
        n = self.begin[term + 1] - self.begin[term]
        posting = np.repeat(np.arange(len(term)), n)
        return posting, np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + self.begin[term][posting]


POSTINGS = "doc_id long, n long, terms array<int>, tf array<long>"
LEVELS = f"{POSTINGS}, m long, bytes array<short>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the number of each list's."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)


def postings(docs: DataFrame, group: Queries, id_col: str, text_col: str) -> DataFrame:
    """Stored, for each document with a term: doc_id, n (its terms), terms and tf of those that the queries have."""
    numbers = group.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                rows, n, found = [], [], []
                for i, text in enumerate(piece.column(1).to_pylist()):
                    if words := terms_of(text):
                        own = np.array([t for t in map(numbers.get, words) if t is not None], dtype=np.int64)
                        rows.append(i), n.append(len(words)), found.append(np.unique(own, return_counts=True))
                sizes = np.array([len(t) for t, _ in found], dtype=np.int64)
                terms, tf = (np.concatenate([x[c] for x in found]) if found else np.array([], dtype=np.int64) for c in (0, 1))
                arrays = [piece.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), _lists(terms, sizes, pa.int32()), _lists(tf, sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "tf"])

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, POSTINGS), "postings")


def levels(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Stored: the postings with each document's m and its terms' impacts as upward-rounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
            tf, sizes = _flat(batch.column(3))
            rounded = -(-impact(tf, np.repeat(m, sizes)) // QUANTUM)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m), _lists(rounded, sizes, pa.int16())], names=["doc_id", "n", "terms", "tf", "m", "bytes"])

    return stored(found.mapInArrow(run, LEVELS), "impacts")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _chunks(group: Queries, terms: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last, first posting, last) of runs of documents that stay within CELLS and PAIRS, one document at least."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    work = np.concatenate([[0], np.cumsum(group.begin[terms + 1] - group.begin[terms])])[ends]
    most, lo = max(1, CELLS // len(group.queries)), 0
    while lo < len(sizes):
        hi = min(lo + most, len(sizes), max(lo + 1, int(np.searchsorted(work, work[lo] + PAIRS, side="right")) - 1))
        yield lo, hi, int(ends[lo]), int(ends[hi])
        lo = hi


def _bounds(group: Queries, terms: np.ndarray, rounded: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
    """Upper or lower bounds of the scores of documents (rows) for queries (columns)."""
    posting, pair = group.pairs(terms)
    value = rounded[posting] * QUANTUM if upper else np.maximum((rounded[posting] - 1) * QUANTUM + 1, 0)
    cell = np.repeat(np.arange(len(sizes)), sizes)[posting] * len(group.queries) + group.query[pair]
    return np.bincount(cell, weights=group.weight[pair] * value, minlength=len(sizes) * len(group.queries)).reshape(len(sizes), -1)


#: Relative room for the rounding of sums in doubles.
ROOM = 1e-9


def thresholds(index: DataFrame, group: Queries, k: int) -> np.ndarray:
    """The kth greatest lower bound of each query over all documents; 0 where fewer have one above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(group.queries), k))
        for batch in batches:
            (terms, sizes), (rounded, _) = _flat(batch.column(0)), _flat(batch.column(1))
            rounded = rounded.astype(np.int64)
            for lo, hi, a, b in _chunks(group, terms, sizes):
                low = _bounds(group, terms[a:b], rounded[a:b], sizes[lo:hi], upper=False)
                both = np.concatenate([best, low.T], axis=1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        query, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[query, place])], names=["query", "low"])

    found = index.select("terms", "bytes").mapInArrow(run, "query long, low double")
    # First the k best of each salt, so that no task gets those of all tasks.
    salted = Window.partitionBy("query", "salt").orderBy(F.desc("low"))
    some = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
    last = some.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).filter(F.col("r") == k)
    out = np.zeros(len(group.queries))
    for r in last.select("query", "low").collect():  # a number per query
        out[r.query] = r.low
    return out


def rescored(index: DataFrame, group: Queries, least: np.ndarray) -> DataFrame:
    """query, doc_id, score: the exact scores, where above 0, of the documents whose upper bound reaches ``least``."""
    queries = np.array(group.queries, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, m, (terms, sizes), (rounded, _), (tf, _) = batch.column(0), batch.column(1).to_numpy(), *map(_flat, batch.columns[2:])
            rounded = rounded.astype(np.int64)
            for lo, hi, a, b in _chunks(group, terms, sizes):
                high = _bounds(group, terms[a:b], rounded[a:b], sizes[lo:hi], upper=True) * (1 + ROOM)
                reach = (high > 0) & (high >= least * (1 - ROOM))
                # The postings of the documents that reach some threshold, and of those the pairs of queries that they reach.
                some = np.flatnonzero(reach.any(axis=1))
                if not len(some):
                    continue
                own = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                at = np.flatnonzero(reach.any(axis=1)[own])
                posting, pair = group.pairs(terms[a:b][at])
                row, column = own[at][posting], group.query[pair]
                keep = reach[row, column]
                posting, pair, row, column = at[posting[keep]] + a, pair[keep], row[keep], column[keep]
                score = np.zeros((hi - lo, len(queries)), dtype=np.int64)
                np.add.at(score, (row, column), group.weight[pair] * impact(tf[posting], m[row + lo]))
                row, column = np.nonzero(score)
                yield pa.RecordBatch.from_arrays([pa.array(queries[column]), doc.take(pa.array(row + lo)), pa.array(score[row, column])], names=["query", "doc_id", "score"])

    return index.select("doc_id", "m", "terms", "bytes", "tf").mapInArrow(run, "query long, doc_id long, score long")


def _searched(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """query, doc_id, score of the ``k`` best documents of a group of queries; None if it has no terms."""
    rows = wanted.select("query", "term", "times").collect()  # MAX_TERMS pairs at most, but for the terms of a single query
    if not rows:
        return None
    group = Queries(rows)
    found = postings(docs, group, id_col, text_col)
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    per_term = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a number per term of the group
    group.weighted({r["term"]: r["count"] for r in per_term}, total.docs)
    index = levels(found, total.docs, total.terms or 1)
    best = rescored(index, group, thresholds(index, group, k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_terms: int = MAX_TERMS
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all other characters from \\x80 on, A-Z lower-cased. Null texts have none. Each row is a
    document, repeated ones too; null ids come last among equal scores. Each row of ``items`` is a query of its own. Empty tables give no rows.
    """
    wanted = stored(query_terms(items, item_col, item_text_col), "queries")
    groups = -(-wanted.count() // max_terms)
    parts = []
    for g in range(groups):
        own = wanted if groups == 1 else wanted.filter(F.pmod(F.xxhash64("query"), F.lit(groups)) == g)
        if (part := _searched(docs, own, k, id_col, text_col)) is not None:
            parts.append(part)
    names = wanted.select("query", "item").distinct()
    none = names.select("query", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).filter(F.lit(False))
    found = reduce(DataFrame.unionByName, parts, none) if len(parts) != 1 else parts[0]
    return found.join(names, "query").select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
