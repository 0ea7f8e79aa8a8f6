"""Mergeable summaries with error bounds, as the opt-in for tables whose exact figures cost too much.

* Quantiles: KLL sketches per column and part. They can be stored; a later part is sketched alone and merged, and quantiles, bins, KS and PSI are
  read from the sketches without the rows.
* Distinct counts: HyperLogLog sketches for one table, theta sketches for unions and intersections of two.
* Heavy hitters: counters per task give candidates and a bound for all other values; a second pass counts the candidates, so the result is exact.

Sketches combine before they are shuffled, so no value is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import c_, value_counts

K, LG_HLL, LG_THETA = 800, 14, 14


def rank_error(k: int = K) -> float:
    """Normalized rank error of a KLL sketch that 99 of 100 queries keep; fixed values of the sketch's design."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, cols: Sequence[str], part: Column | None = None, k: int = K) -> DataFrame:
    """feature, part, sketch of the known values of each column; NaN counts as missing. ``part`` tells parts apart that are stored one by one."""
    v = {c: F.nanvl(c_(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    named = df.select((F.lit("") if part is None else part.cast("string")).alias("part"), *[x.alias(f"v{i}") for i, x in enumerate(v.values())])
    aggs = [F.kll_sketch_agg_double(f"v{i}", k).alias(f"s{i}") for i in range(len(v))]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(v)]))
    return named.groupBy("part").agg(*aggs).select("part", rows.alias("r")).select("r.feature", "part", "r.sketch")


def merged(sketches: DataFrame, k: int = K) -> DataFrame:
    """feature, sketch of all parts."""
    return sketches.groupBy("feature").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def _quantiles(sketch: str, probs: Sequence[float]) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*[F.lit(float(p)) for p in probs]))


def _share(grid: str, v: Column) -> Column:
    """Share of values up to ``v`` by a grid of evenly spaced quantiles, within half a step and the sketch's rank error."""
    return F.size(F.filter(grid, lambda q: q <= v)) / F.size(grid)


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], k: int = K) -> DataFrame:
    """feature, n, q: values within :func:`rank_error` of the ranks ``probs``; null without values."""
    some = merged(sketches, k).withColumn("n", F.kll_sketch_get_n_double("sketch"))
    return some.select("feature", "n", F.when(F.col("n") > 0, _quantiles("sketch", probs)).alias("q"))


def _grids(pool: DataFrame, sample: DataFrame, points: int, k: int) -> DataFrame:
    """feature, a, b: evenly spaced quantiles of the features that both have values of."""
    probs = [(i + 0.5) / points for i in range(points)]
    grid = lambda s, name: sketch_quantiles(s, probs, k).filter("n > 0").select("feature", F.col("q").alias(name))
    return grid(pool, "a").join(grid(sample, "b"), "feature")


def sketch_ks(pool: DataFrame, sample: DataFrame, points: int = 400, k: int = K) -> DataFrame:
    """feature, ks, bound: the greatest difference of the two distributions at the quantiles of both, within ``bound`` of the exact statistic."""
    found = _grids(pool, sample, points, k).select("feature", "a", "b", F.explode(F.array_distinct(F.concat("a", "b"))).alias("x"))
    gap = F.abs(_share("a", F.col("x")) - _share("b", F.col("x")))
    return found.groupBy("feature").agg(F.max(gap).alias("ks")).withColumn("bound", F.lit(2 * rank_error(k) + 2 / points))


def sketch_psi(pool: DataFrame, sample: DataFrame, bins: int = 10, points: int = 1000, k: int = K) -> DataFrame:
    """feature, psi over bins cut at the pool's quantiles, both shares at least 0.0001."""
    cuts = F.array_distinct(F.transform(F.array(*[F.lit(points * i // bins - 1) for i in range(1, bins)]), lambda i: F.get("a", i)))
    rows = _grids(pool, sample, points, k).withColumn("cuts", cuts)
    each = rows.select("feature", "a", "b", "cuts", F.posexplode(F.concat("cuts", F.array(F.lit(float("inf"))))).alias("i", "hi"))
    lo = F.when(F.col("i") > 0, F.get("cuts", F.col("i") - 1))
    share = lambda s: F.greatest(_share(s, F.col("hi")) - F.when(lo.isNull(), 0.0).otherwise(_share(s, lo)), F.lit(1e-4))
    p, q = share("a"), share("b")
    return each.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def distinct_counts(df: DataFrame, cols: Sequence[str], lg: int = LG_HLL) -> DataFrame:
    """feature, n_unique (estimated), bound (relative, three standard errors) from one aggregate."""
    found = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c_(c).cast("string"), lg)).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_unique")) for i, c in enumerate(cols)]))
    return found.select(rows.alias("r")).select("r.*").withColumn("bound", F.lit(3 * 1.04 / 2 ** (lg / 2)))


def theta_sketches(df: DataFrame, cols: Sequence[str], lg: int = LG_THETA) -> DataFrame:
    """feature, sketch of the distinct values of each column, for storing and for :func:`overlap`."""
    found = df.agg(*[F.theta_sketch_agg(c_(c).cast("string"), lg).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)]))
    return found.select(rows.alias("r")).select("r.*")


def overlap(pool: DataFrame, sample: DataFrame, lg: int = LG_THETA) -> DataFrame:
    """feature, n_pool, n_sample, n_union, n_both, card_ratio, bound of two tables of :func:`theta_sketches`. bound is three standard errors,
    relative to n_union; card_ratio is the sample's distinct values over the pool's."""
    size = F.theta_sketch_estimate
    both = pool.withColumnRenamed("sketch", "a").join(sample.withColumnRenamed("sketch", "b"), "feature")
    out = both.select("feature", size("a").alias("n_pool"), size("b").alias("n_sample"), size(F.theta_union("a", "b", lg)).alias("n_union"), size(F.theta_intersection("a", "b")).alias("n_both"))
    return out.withColumns({"card_ratio": F.try_divide("n_sample", "n_pool"), "bound": F.lit(3 / 2 ** (lg / 2))})


class Counters:
    """Counts of frequent values: when there are too many values, all lose what the ``size``-th has, and ``lost`` grows by it.

    A count is never above the true one, and a true count is never above the count (0 if absent) plus ``lost``.
    """

    def __init__(self, size: int):
        self.size, self.lost, self.counts = size, 0, {}

    def add(self, values: list, times: list[int]) -> None:
        own = self.counts
        for v, n in zip(values, times, strict=True):
            own[v] = own.get(v, 0) + n
        if len(own) > 2 * self.size:
            cut = sorted(own.values(), reverse=True)[self.size]
            self.lost += cut
            self.counts = {v: n - cut for v, n in own.items() if n > cut}


COUNTED = "feature string, value string, n long, lost long"


def candidates(df: DataFrame, cols: Sequence[str], counters: int = 1024) -> DataFrame:
    """feature, value, n, lost of the values that each task's counters hold; a row with a null value has what the task has lost."""
    names = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counters(counters) for _ in names]
        for batch in batches:
            for own, column in zip(held, batch.columns, strict=True):
                found = pc.value_counts(column.drop_null())
                own.add(found.field(0).to_pylist(), found.field(1).to_pylist())
        for name, own in zip(names, held, strict=True):
            values, n = [*own.counts, None], [*own.counts.values(), 0]
            lost = [0] * len(own.counts) + [own.lost]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(values, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=["feature", "value", "n", "lost"])

    return df.select(*[c_(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, COUNTED)


def heavy_hitters(df: DataFrame, cols: Sequence[str], k: int = 1, counters: int = 1024, most: int = 100_000) -> DataFrame:
    """feature, value, n, rank: the ``k`` most frequent values of each column with exact counts, ties by the value as text.

    Two passes. What is shuffled is bounded by ``counters`` per column and task. A value without a counter occurs ``lost`` times at most, so a
    column whose kth count is above that is settled; the others, whose values are all rare, are counted in full, and so are all if the candidates
    are more than ``most``, the bound of what is sent to every task.
    """
    found = candidates(df, cols, counters)
    known = found.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    lost = {r.feature: r.lost for r in known.filter("value is null").collect()}  # a row per column
    top = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    lower = {r.feature: r.n for r in known.filter("value is not null").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") == k).collect()}
    limit = F.create_map(*[F.lit(x) for c in cols for x in (c, max(1, lower.get(c, 0) - lost.get(c, 0)))])
    wanted = known.filter("value is not null").filter(F.col("n") >= limit[F.col("feature")]).select("feature", "value")
    # Fewer than k values and nothing lost: the counters hold all values.
    open_ = [c for c in cols if lost.get(c, 0) and lower.get(c, 0) <= lost[c]]
    closed = [c for c in cols if c not in open_]
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    ranked = lambda counts: counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    wanted = wanted.filter(F.col("feature").isin(closed))
    if not closed or wanted.count() > most:
        return ranked(value_counts(df, cols))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), c_(c).cast("string").alias("value")) for c in closed]))
    exact = df.select(pairs.alias("p")).select("p.*").join(F.broadcast(wanted), ["feature", "value"]).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return ranked(exact.unionByName(value_counts(df, open_)) if open_ else exact)

