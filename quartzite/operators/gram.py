"""Pearson correlations of all pairs of columns from one pass, pairwise complete, by a blocked Gram matrix.

A task keeps, for all pairs of columns, the number of rows that have both and the sums of values, squares and products over those rows: four
matrix products of a batch's values and of its mask of known values. Values are taken relative to the first one that the task sees in a column,
so the sums stay exact enough for large means. At the end a task turns them into means and centred co-moments and cuts these into blocks of
columns. Blocks of a pair are merged twice, first by a salt of the task, by the update rule of parallel moments, in a stream that keeps one
block per pair of a task. The rows are read once, whatever the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SALTS = 64, 32
#: Columns of a pass: its five matrices of doubles take 40 MB at 1,000.
PASS_COLUMNS = 1024
#: n, mean of the first and of the second, squared deviations of both, co-moment.
MOMENTS = ("n", "mx", "my", "xx", "yy", "xy")
PARTIAL = "a int, b int, salt int, moments binary"


class Sums:
    """Sums over the rows of a task."""

    def __init__(self, columns: int):
        self.base = np.full(columns, np.nan)
        self.n, self.s, self.q, self.p = (np.zeros((columns, columns)) for _ in range(4))

    def add(self, values: np.ndarray) -> None:
        """Rows by columns; NaN is missing."""
        known = ~np.isnan(values)
        for c in np.flatnonzero(np.isnan(self.base) & known.any(axis=0)):
            self.base[c] = values[known[:, c].argmax(), c]
        z = np.where(known, values - np.where(np.isnan(self.base), 0.0, self.base), 0.0)
        mask = known.astype(np.float64)
        self.n += mask.T @ mask
        self.s += z.T @ mask
        self.q += (z * z).T @ mask
        self.p += z.T @ z

    def moments(self) -> np.ndarray:
        """MOMENTS by first column by second column."""
        n = np.maximum(self.n, 1)
        base = np.where(np.isnan(self.base), 0.0, self.base)
        xx = np.maximum(self.q - self.s**2 / n, 0)
        return np.stack([self.n, base[:, None] + self.s / n, base[None, :] + self.s.T / n, xx, xx.T, self.p - self.s * self.s.T / n])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of the rows of both."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    # Where one side has no rows its means say nothing.
    dx, dy = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    mx, my = (np.where(a[0] > 0, a[k] + d * share, b[k]) for k, d in ((1, dx), (2, dy)))
    w = a[0] * share
    return np.stack([n, mx, my, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for a, b, blob in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3)], strict=True):
            block = np.frombuffer(blob).reshape(len(MOMENTS), -1)
            held[a, b] = merged(held[a, b], block) if (a, b) in held else block
    for (a, b), block in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["a", "b", "salt", "moments"])


def _passed(df: DataFrame, cols: Sequence[str], wanted: set[int]) -> DataFrame:
    """feature_1, feature_2 and MOMENTS of the pairs of columns of one pass; ``wanted`` are the blocks of the second group, or all."""
    names, d = list(cols), len(cols)
    edges = list(range(0, d, BLOCK)) + [d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, salt = Sums(d), TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                sums.add(np.stack([c.to_numpy(zero_copy_only=False) for c in piece.columns], axis=1).astype(np.float64))
        found = sums.moments()
        for i, j in combinations_with_replacement(range(len(edges) - 1), 2):
            if not wanted or (i not in wanted and j in wanted):
                block = np.ascontiguousarray(found[:, edges[i] : edges[i + 1], edges[j] : edges[j + 1]])
                if block[0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([salt], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["a", "b", "salt", "moments"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, blob in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3)], strict=True):
                first, second = np.meshgrid(np.arange(edges[a], edges[a + 1]), np.arange(edges[b], edges[b + 1]), indexing="ij")
                keep = (first < second).ravel()
                block = np.frombuffer(blob).reshape(len(MOMENTS), -1)[:, keep]
                of = lambda x: pa.array([names[k] for k in x.ravel()[keep].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([of(first), of(second), pa.array(block[0].astype(np.int64)), *map(pa.array, block[1:])], names=["feature_1", "feature_2", *MOMENTS])

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    some = values.mapInArrow(run, PARTIAL).repartition("a", "b", "salt").mapInArrow(_merge, PARTIAL)
    whole = some.repartition("a", "b").mapInArrow(_merge, PARTIAL)
    found = whole.mapInArrow(rows, "feature_1 string, feature_2 string, n long, mx double, my double, xx double, yy double, xy double")
    return found.filter("n > 0")


def co_moments(df: DataFrame, cols: Sequence[str], pass_columns: int = PASS_COLUMNS) -> DataFrame:
    """feature_1, feature_2, n, mx, my (means), xx, yy (sums of squared deviations), xy (sum of products) over the rows that have both, for each
    pair of ``cols`` in their order that has such rows. Nulls and NaN are missing.

    Up to ``pass_columns`` columns take one pass over the rows; more take a pass for each pair of halves of that many.
    """
    cols = list(cols)
    if len(cols) <= pass_columns:
        return _passed(df, cols, set())
    half = max(BLOCK, pass_columns // 2 // BLOCK * BLOCK)
    groups = [cols[k : k + half] for k in range(0, len(cols), half)]
    out = None
    for i, first in enumerate(groups):
        parts = [_passed(df, first, set())]
        parts += [_passed(df, [*first, *second], set(range(half // BLOCK, -(-(half + len(second)) // BLOCK)))) for second in groups[i + 1 :]]
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """feature_1, feature_2, correlation, abs_correlation of the pairs of at least ``threshold``. Pairs in which a column doesn't vary have none."""
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy")))
    found = co_moments(df, cols).select("feature_1", "feature_2", r.alias("correlation")).withColumn("abs_correlation", F.abs("correlation"))
    return found.filter(F.col("abs_correlation") >= threshold)
