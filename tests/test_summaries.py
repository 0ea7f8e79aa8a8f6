"""Charts, blocked correlations and sketches against direct computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import charts, drift, gram, profile, sketches


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(5, 2, 900)] + [("b", float(v)) for v in rng.exponential(1000, 500)] + [("b", 1e5)]
    return rows + [("one", 3.0), ("flat", 7.0), ("flat", 7.0), (None, 1.0), ("a", None), ("a", math.nan), ("rare", 1.0), ("rare", 2.0)]


def test_violin(spark, values):
    df = spark.createDataFrame(values, "c string, v double").repartition(4)
    rows = charts.violin(df, "v", "c", top=4, points=80).collect()
    by = {c: sorted((r for r in rows if r.category == c), key=lambda r: r.point) for c in {r.category for r in rows}}
    assert set(by) == {"a", "b", "flat", "rare"}  # of the four, flat comes before rare and one by number and name
    for c in ("a", "b"):
        v = np.array([x for k, x in values if k == c and x is not None and not math.isnan(x)])
        width = v.std(ddof=1) * len(v) ** -0.2
        at = np.linspace(v.min(), v.max(), 80)
        direct = np.exp(-(((at[:, None] - v) / width) ** 2) / 2).sum(axis=1) / (len(v) * width * math.sqrt(2 * math.pi))
        got = np.array([r.density for r in by[c]])
        assert np.allclose([r.x for r in by[c]], at) and (abs(got - direct) <= 0.01 * direct + 1e-12).all()
        assert by[c][0].n == len(v) and math.isclose(by[c][0].median, np.median(v)) and math.isclose(by[c][0].mean, v.mean())
    assert [(r.x, r.density) for r in by["flat"]] == [(7.0, 1.0)]
    for c in ("a", "b"):
        whole = sorted((r.x, r.density) for r in charts.violin(df, "v", "c", points=400, cut=5).filter(F.col("category") == c).collect())
        x, d = np.array(whole).T
        assert abs(np.trapezoid(d, x) - 1) < 1e-3
    assert charts.violin(df.limit(0), "v", "c").count() == 0


def test_hexbin_cells_are_nearest(spark):
    rng = np.random.default_rng(3)
    points = [*zip(rng.normal(0, 1, 600).tolist(), rng.normal(50, 20, 600).tolist(), strict=True), (None, 1.0), (1.0, math.nan)]
    known = np.array([p for p in points if p[0] is not None and not math.isnan(p[1])])
    got = charts.hexbin(spark.createDataFrame(points, "x double, y double"), "x", "y", 12).collect()
    lo, span = known.min(axis=0), known.max(axis=0) - known.min(axis=0)
    lo, span = lo - 1e-9 * span, (1 + 2e-9) * span
    step = span / np.array([12, int(12 / math.sqrt(3))])
    centres = np.array([(i + h, j + h) for h in (0, 0.5) for i in range(-1, 14) for j in range(-1, 9)])
    grid = (known - lo) / step
    nearest = ((grid[:, None, :] - centres) ** 2 @ np.array([1, 3])).argmin(axis=1)
    want = {tuple(np.round(lo + centres[k] * step, 6)): n for k, n in zip(*np.unique(nearest, return_counts=True), strict=True)}
    assert {(round(r.x, 6), round(r.y, 6)): r.n for r in got} == want
    assert charts.hexbin(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), "x", "y").first().n == 3


def reference(x, i, j):
    known = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = (x[known, k].astype(np.longdouble) for k in (i, j))
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def test_gram_is_pairwise_and_stable(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 9))
    x[:, 1] += x[:, 0]
    x[:, 2] = 1e9 + x[:, 0] - x[:, 2]
    x[:, 3] += 1e9
    x[:, 4] *= 1e-6
    x[:, 5] = 0.1
    x[rng.random(x.shape) < 0.3] = np.nan
    x[200:, 6] = np.nan
    x[:200, 7] = np.nan
    names = [f"k {i}" for i in range(9)]
    rows = [tuple(None if math.isnan(v) and r % 2 else v for v in row) for r, row in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7)
    want = {(names[i], names[j]): reference(x, i, j) for i, j in itertools.combinations(range(9), 2) if 5 not in (i, j) and (i, j) != (6, 7)}
    got = {(r.feature_1, r.feature_2): r.correlation for r in gram.correlations(df, names).collect()}
    assert set(got) == set(want) and max(abs(got[p] - want[p]) for p in want) < 1e-6
    moments = {(r.feature_1, r.feature_2): r for r in gram.co_moments(df, names).collect()}
    assert ("k 6", "k 7") not in moments and moments["k 0", "k 5"].yy == 0
    both = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, 3])
    assert moments["k 0", "k 3"].n == both.sum() and math.isclose(moments["k 0", "k 3"].my, x[both, 3].mean())
    assert gram.correlations(df.limit(0), names).count() == 0


def test_gram_of_a_thousand_columns(spark):
    n = 1000
    df = spark.range(0, 300, 1, 3).select(*[F.sin(F.col("id") * (k % 7 + 1) + k / 50).alias(f"c{k}") for k in range(n)])
    x = np.sin(np.arange(300)[:, None] * (np.arange(n) % 7 + 1) + np.arange(n) / 50)
    found = gram.correlations(df, df.columns, 0.999)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1  # one pass
    got = {(r.feature_1, r.feature_2): r.correlation for r in found.collect()}
    want = np.corrcoef(x.T)
    close = [(i, j) for i, j in zip(*np.nonzero(np.triu(abs(want) >= 0.999, 1)), strict=True) if abs(abs(want[i, j]) - 0.999) > 1e-9]
    assert len(close) > 100 and all(math.isclose(got[f"c{i}", f"c{j}"], want[i, j], abs_tol=1e-9) for i, j in close)


def test_few_and_many_pairs_agree(spark, monkeypatch):
    df = spark.range(200).select(*[(F.sin(F.col("id") * k) + k).alias(f"c{k}") for k in range(1, 6)], F.when(F.col("id") % 3 > 0, F.cos("id")).alias("gaps"), F.lit(2.0).alias("flat"))
    few, many = {}, {}
    for found, limit in ((few, 66), (many, 0)):
        monkeypatch.setattr(profile, "FEW_PAIRS", limit)
        found.update({(r.feature_1, r.feature_2): round(r.correlation, 9) for r in profile.correlations(df).collect()})
    assert few == many and len(few) == 15


def test_gram_by_groups_of_columns(spark):
    names = [f"c{k}" for k in range(300)]
    df = spark.range(100).select(*[F.cos(F.col("id") * (k % 11 + 1) + k).alias(c) for k, c in enumerate(names)])
    one, many = ({(r.feature_1, r.feature_2): round(r.correlation, 9) for r in gram.co_moments(df, names, p).selectExpr("feature_1", "feature_2", "xy / sqrt(xx * yy) as correlation").collect()} for p in (1024, 128))
    assert one == many and len(one) == 300 * 299 // 2


def test_quantile_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 500).alias("w"), F.lit(None).cast("int").alias("none"), (F.col("id") % 5).alias("part"))
    parts = sketches.quantile_sketches(df.filter("part < 4"), ["v", "w", "none"], F.col("part"))
    later = sketches.quantile_sketches(df.filter("part = 4"), ["v", "w", "none"], F.lit("later"))
    assert parts.count() == 12
    got = {r.feature: r for r in sketches.sketch_quantiles(parts.unionByName(later), [0.1, 0.5, 0.99]).collect()}
    room = 2 * sketches.rank_error()
    assert got["v"].n == 60_000 and got["w"].n == 40_000 and (got["none"].n, got["none"].q) == (0, None)
    assert all(abs(q / 60_000 - p) < room for q, p in zip(got["v"].q, (0.1, 0.5, 0.99), strict=True))


def test_sketched_drift(spark):
    pool = spark.range(40_000).select(F.sqrt(F.col("id")).alias("v"), (F.col("id") % 90).cast("double").alias("w"))
    sample = pool.filter("v > 60").unionByName(pool.limit(500))
    a, b = (sketches.quantile_sketches(x, ["v", "w"]) for x in (pool, sample))
    for r in sketches.sketch_ks(a, b).collect():
        assert abs(r.ks - drift.ks_test(pool, sample, r.feature)[0]) <= r.bound
    psi = {r.feature: r.psi for r in sketches.sketch_psi(a, b).collect()}
    assert psi["w"] < 0.01 and abs(psi["v"] - drift.psi_numeric(pool, sample, "v").first().psi) < 0.1


def test_distinct_sketches(spark):
    df = spark.range(50_000).select((F.col("id") % 20_000).alias("a"), F.when(F.col("id") < 30, F.col("id")).alias("b"))
    for r in sketches.distinct_counts(df, ["a", "b"]).collect():
        assert abs(r.n_unique - {"a": 20_000, "b": 30}[r.feature]) <= r.bound * 20_000 / (1 if r.feature == "a" else 1000)
    both = {r.feature: r for r in sketches.overlap(sketches.theta_sketches(df, ["a"]), sketches.theta_sketches(df.filter("a < 5000").unionByName(spark.range(90_000, 95_000).selectExpr("id as a", "id as b")), ["a"])).collect()}["a"]
    for got, want in ((both.n_pool, 20_000), (both.n_sample, 10_000), (both.n_union, 25_000), (both.n_both, 5_000)):
        assert abs(got - want) <= both.bound * 25_000


@pytest.mark.parametrize("counters", [3, 40, 1000])
def test_heavy_hitters_are_exact(spark, counters):
    rng = np.random.default_rng(6)
    rows = [(str(int(z)) if z < 500 else None, f"u{i}", "x" if i % 3 else "y", None) for i, z in enumerate(rng.zipf(1.4, 6000))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(5)
    for k in (1, 3):
        got = {(r.feature, r["rank"]): (r.value, r.n) for r in sketches.heavy_hitters(df, ["a", "b", "c", "d"], k, counters).collect()}
        want = {}
        for r in profile.value_counts(df, ["a", "b", "c", "d"]).collect():
            want.setdefault(r.feature, []).append((-r.n, r.value))
        assert got == {(f, i): (v, -n) for f, x in want.items() for i, (n, v) in enumerate(sorted(x)[:k], 1)}
    held = sketches.candidates(df, ["a", "b"], counters)
    assert held.groupBy("feature").count().agg(F.max("count")).first()[0] <= df.rdd.getNumPartitions() * (2 * counters + 1)
    modes = {r.feature: (r["mode"], r.n) for r in profile.modes(df, ["a", "c"]).collect()}
    assert modes == {r.feature: (r.value, r.n) for r in sketches.heavy_hitters(df, ["a", "c"], 1, counters).collect()}
