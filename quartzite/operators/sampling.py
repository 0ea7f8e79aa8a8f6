"""Reproducible samples: exact counts per stratum, order by md5 of seed and row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_key(seed: int, rid: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(rid).cast("string")).cast("binary"))


def strata_sizes(pool: DataFrame, n: int, rate: float | None = None, target: str = "is_fraud") -> tuple[int, int]:
    """(fraud rows, other rows) of a sample: the fraud share of the pool unless ``rate`` is given, one at least, as far as there are any."""
    c = pool.agg(F.count_if(F.col(target) == 1).alias("f"), F.count_if(F.col(target) == 0).alias("o")).first()
    rate = c.f / max(c.f + c.o, 1) if rate is None else rate
    fraud = min(max(1, round(n * rate)), c.f)
    if n - fraud > c.o:
        raise ValueError(f"{n - fraud} rows wanted, the pool has {c.o}")
    return fraud, n - fraud


def stratified(pool: DataFrame, sizes: dict, target: str = "is_fraud", rid: str = "rid", seed: int = 42) -> DataFrame:
    """Exactly ``sizes[value]`` rows of each stratum; rows of other values and of null are never drawn.

    The rows are those of smallest key, see :func:`draws`.
    """
    return draws(pool, sizes, [seed], target, rid).drop("seed")


def strata_counts(pool: DataFrame, sizes: dict, target: str = "is_fraud") -> dict:
    """Rows of each stratum of ``sizes``."""
    return {r[0]: r.n for r in pool.filter(F.col(target).isin(list(sizes))).groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}


def draws(pool: DataFrame, sizes: dict, seeds: Sequence[int], target: str = "is_fraud", rid: str = "rid", counts: dict | None = None) -> DataFrame:
    """The stratified sample of every seed, with its ``seed``, from one pass over ``pool``; ``counts`` saves counting the strata.

    A key's first 32 bits are a uniform number. Only rows below a bound that leaves a little more than the wanted rows are ranked, so no
    stratum meets in one task, whatever its size. The bound is tested by a count; where rows of equal ids leave too few, it is lifted.
    """
    sizes = {v: int(k) for v, k in sizes.items()}
    n = strata_counts(pool, sizes, target) if counts is None else counts
    want = {v: min(k, n.get(v, 0)) for v, k in sizes.items()}
    bound = {v: min(1.0, (k + 8 * k**0.5 + 32) / max(1, n.get(v, 0))) for v, k in want.items()}
    # The seed is a column here; the key is that of rank_key.
    key = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col(rid).cast("string")).cast("binary"))
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32
    keyed = pool.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))).withColumn("_key", key)

    def near(limits: dict) -> DataFrame:
        low = F.lit(False)
        for v, b in limits.items():
            low = low | ((F.col(target) == v) & ((share <= b) if b < 1 else F.lit(True)))
        return keyed.filter(low)

    found = {(r[0], r.seed): r.n for r in near(bound).groupBy(target, "seed").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = {v: b if all(found.get((v, s), 0) >= want[v] for s in seeds) else 1.0 for v, b in bound.items()}
    ranked = near(bound).withColumn("_rank", F.row_number().over(Window.partitionBy("seed", target).orderBy("_key", rid)))
    most = F.lit(0)
    for v, k in sizes.items():
        most = F.when(F.col(target) == v, k).otherwise(most)
    return ranked.filter(F.col("_rank") <= most).drop("_key", "_rank")


def rest_of(pool: DataFrame, sample: DataFrame, rid: str = "rid") -> DataFrame:
    """The rows of ``pool`` that were not drawn; rows without ``rid`` were not."""
    return pool.join(sample.select(rid), rid, "left_anti").select(pool.columns)


def shuffled(df: DataFrame, rid: str = "rid", seed: int = 42) -> DataFrame:
    return df.orderBy(rank_key(seed, rid), rid)


def safe_sample(data: DataFrame, target: str | None = None, max_rows: int = 500_000, rid: str = "rid", seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows: all, or by class in proportion (classes of 20 at most, null being one), or at random."""
    n = data.count()
    if n <= max_rows:
        return data
    counts = data.groupBy(target).count().orderBy(F.col(target).asc_nulls_last()).limit(21).collect() if target else []
    if not counts or len(counts) > 20:
        return data.orderBy(rank_key(seed, rid), rid).limit(max_rows)
    sizes = [max(1, int(max_rows * r["count"] / n)) for r in counts]
    while sum(sizes) > max_rows:
        sizes[sizes.index(max(sizes))] -= 1
    for i in range(max_rows - sum(sizes)):
        free = [k for k in range(len(sizes)) if sizes[k] < counts[k]["count"]]
        sizes[free[i % len(free)]] += 1
    out = None
    for r, k in zip(counts, sizes, strict=True):
        part = data.filter(F.col(target).eqNullSafe(F.lit(r[target]))).orderBy(rank_key(seed, rid), rid).limit(k)
        out = part if out is None else out.unionByName(part)
    return out


def random_multi_mid_tin(df: DataFrame, seed: int = 42) -> DataFrame:
    """One TIN with several MIDs."""
    many = df.filter((F.col("tin") != "") & (F.col("mid") != "")).groupBy("tin").agg(F.countDistinct("mid").alias("n")).filter("n >= 2")
    return many.orderBy(rank_key(seed, "tin"), "tin").limit(1)


def search_seed(pool: DataFrame, reference: DataFrame, sizes: dict, stable, seeds: int = 100, target: str = "is_fraud", rid: str = "rid") -> tuple[int, float]:
    """(seed, max PSI) of least max PSI up to the first seed whose sample is ``stable(reference, sample) -> (max_psi, is_stable)``.

    For any measure of one's own; :func:`quartzite.operators.drift.stable_seed` measures many seeds in a job.
    """
    best = (0, float("inf"))
    for seed in range(seeds):
        value, ok = stable(reference, stratified(pool, sizes, target, rid, seed))
        if value < best[1]:
            best = (seed, value)
        if ok:
            break
    return best


def strata_ranks(pool: DataFrame, target: str, rid: str, seed: int) -> DataFrame:
    """The rank of each row in its stratum, for drawing several sizes at once."""
    return pool.withColumn("rank_in_stratum", F.row_number().over(Window.partitionBy(target).orderBy(rank_key(seed, rid), rid)))
