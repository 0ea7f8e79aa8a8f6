"""How well a sample represents its pool: PSI, chi-square, Kolmogorov-Smirnov, cardinality, verdicts.

Every measure is an aggregate over both tables; only category shares, bin counts or distinct values are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from .profile import feature_types
from .ranks import long_values, quantiles, running
from .sampling import draws, strata_counts
from .stats_math import chi2_sf, ks_exact_sf, ks_sf

FLOOR = 1e-6


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def category_shares(pool: DataFrame, sample: DataFrame, key: Column) -> DataFrame:
    """cat, p_n, s_n, p, s: counts and shares of each category of either table; null keys count as __NA__."""
    both = pool.select(F.coalesce(key.cast("string"), F.lit("__NA__")).alias("cat"), F.lit(0).alias("side")).union(sample.select(F.coalesce(key.cast("string"), F.lit("__NA__")), F.lit(1)))
    counts = both.groupBy("cat").agg(F.count_if(F.col("side") == 0).alias("p_n"), F.count_if(F.col("side") == 1).alias("s_n"))
    totals = counts.agg(F.sum("p_n").alias("p_t"), F.sum("s_n").alias("s_t"))
    return counts.join(F.broadcast(totals)).select("cat", "p_n", "s_n", N.ratio(F.col("p_n"), F.col("p_t")).alias("p"), N.ratio(F.col("s_n"), F.col("s_t")).alias("s"))


def _psi(shares: DataFrame) -> DataFrame:
    """PSI of shares floored and scaled to one; null below two categories."""
    f = shares.select(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR)).alias("e"), F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(FLOOR)).alias("a"))
    t = f.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"), F.count(F.lit(1)).alias("k"))
    e, a = F.col("e") / F.col("te"), F.col("a") / F.col("ta")
    return f.join(F.broadcast(t)).agg(F.when(F.max("k") >= 2, F.sum((a - e) * F.log(a / e))).alias("psi"))


def psi_categorical(pool: DataFrame, sample: DataFrame, col: str) -> DataFrame:
    return _psi(category_shares(pool, sample, _c(col)))


def psi_date(pool: DataFrame, sample: DataFrame, col: str, bin_: str = "quarter") -> DataFrame:
    """PSI of quarters or weekdays of non-null dates; null if either side has fewer than ten."""
    at = {"quarter": D.quarter, "weekday": D.weekday, "month": D.month}[bin_](_c(col))
    p, s = pool.filter(_c(col).isNotNull()), sample.filter(_c(col).isNotNull())
    shares = category_shares(p, s, at)
    enough = shares.agg((F.least(F.sum("p_n"), F.sum("s_n")) >= 10).alias("ok"))
    return _psi(shares).join(F.broadcast(enough)).select(F.when(F.col("ok"), F.col("psi")).alias("psi"))


def bin_edges(pool: DataFrame, cols: Sequence[str], buckets: int = 10, approximate: bool = False) -> dict[str, list[float]]:
    """The distinct quantiles that bound each column's bins."""
    steps = [i / buckets for i in range(buckets + 1)]
    rows = long_values(pool, {c: _c(c) for c in cols})
    found = rows.groupBy("feature").agg(F.percentile_approx("v", steps, 100_000).alias("q")) if approximate else quantiles(rows, ["feature"], "v", steps)
    return {c: [] for c in cols} | {r.feature: list(dict.fromkeys(r.q or [])) for r in found.collect()}


def psi_numeric(pool: DataFrame, sample: DataFrame, cols: Sequence[str] | str, buckets: int = 10, approximate: bool = False, by: Sequence[str] = (), edges: dict[str, list[float]] | None = None) -> DataFrame:
    """col_name, psi over the pool's quantile bins: one job for all bin edges (unless given), one for all counts.

    ``by``: columns of ``sample`` that tell several samples apart, each with rows of its own in the result.

    Bins are half-open, the last closed. Values outside count in the denominator only; a share of 0 is 1e-6. Null if either side has fewer
    than ten values or there are fewer than two edges. ``approximate`` takes percentile_approx, for columns too large for exact quantiles.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    value = {c: _c(c).cast("double") for c in cols}
    edges = edges or bin_edges(pool, cols, buckets, approximate)

    def counts(df: DataFrame, side: str, by: Sequence[str] = ()) -> DataFrame:
        aggs = []
        for i, c in enumerate(cols):
            b, v = edges[c], value[c]
            ins = [F.count_if((v >= lo) & ((v < hi) if k < len(b) - 2 else (v <= hi))) for k, (lo, hi) in enumerate(zip(b, b[1:], strict=False))]
            aggs += [F.count(v).alias(f"{side}n{i}"), (F.array(*ins) if ins else F.array().cast("array<bigint>")).alias(f"{side}c{i}")]
        return df.groupBy(*by).agg(*aggs)

    both = counts(pool, "p").join(counts(sample, "s", by))  # a row against one per sample

    def terms_of(i: int) -> Column:
        share = lambda side, x: F.when(x == 0, FLOOR).otherwise(x / F.greatest(F.col(f"{side}n{i}"), F.lit(1)))
        return F.zip_with(f"pc{i}", f"sc{i}", lambda p, s: (share("s", s) - share("p", p)) * F.log(share("s", s) / share("p", p)))

    out = []
    for i, c in enumerate(cols):
        terms = terms_of(i)
        ok = (F.col(f"pn{i}") >= 10) & (F.col(f"sn{i}") >= 10) & F.lit(len(edges[c]) >= 2)
        out.append(F.struct(F.lit(c).alias("col_name"), F.when(ok, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).alias("psi")))
    return both.select(*by, F.explode(F.array(*out)).alias("r")).select(*by, "r.*")


def ks_statistics(pool: DataFrame, sample: DataFrame, cols: Sequence[str]) -> DataFrame:
    """col_name, ks, n, m of all columns in one job, over running totals of distinct values."""
    value = {c: _c(c) for c in cols}
    side = lambda df, p, s: long_values(df, value).filter("v is not null").withColumns({"p": F.lit(p), "s": F.lit(s)})
    both = side(pool, 1, 0).unionByName(side(sample, 0, 1))
    counted = both.groupBy("feature", "v").agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    run = running(counted, both, ["feature"], "v", ["p", "s"]).withColumnsRenamed({"p_total": "n", "s_total": "m"})
    gap = F.abs(F.try_divide(F.col("p_upto"), F.col("n")) - F.try_divide(F.col("s_upto"), F.col("m")))
    return run.groupBy(F.col("feature").alias("col_name")).agg(F.max(gap).alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_statistic(pool: DataFrame, sample: DataFrame, col: str) -> DataFrame:
    """ks, n, m of one column."""
    return ks_statistics(pool, sample, [col]).drop("col_name")


#: Up to so many values on both sides the p-value of a KS statistic is exact.
EXACT_ROWS = 10_000


def ks_p_value(d: float, n: int, m: int, exact_rows: int = EXACT_ROWS) -> tuple[float, str]:
    """(p-value, exact or asymptotic)."""
    return (ks_exact_sf(d, n, m), "exact") if max(n, m) <= exact_rows else (ks_sf(d, n, m), "asymptotic")


def ks_test(pool: DataFrame, sample: DataFrame, col: str, exact_rows: int = EXACT_ROWS) -> tuple[float, float]:
    """(statistic, p-value)."""
    r = ks_statistic(pool, sample, col).first()
    return (r.ks, ks_p_value(r.ks, r.n, r.m, exact_rows)[0]) if r.ks is not None else (float("nan"), float("nan"))


def chi2_statistic(pool: DataFrame, sample: DataFrame, key: Column, pool_rows: int | None = None, sample_rows: int | None = None) -> DataFrame:
    """chi2, dof of the two-sample table of counts, at least 1 a cell; with Yates' correction for two categories."""
    shares = category_shares(pool, sample, key)
    if pool_rows is not None:
        cells = shares.select(F.greatest(F.lit(1.0), F.bround(F.coalesce("p", F.lit(0.0)) * pool_rows)).alias("a"), F.greatest(F.lit(1.0), F.bround(F.coalesce("s", F.lit(0.0)) * sample_rows)).alias("b"))
    else:
        cells = shares.select(F.greatest(F.lit(1.0), F.col("p_n").cast("double")).alias("a"), F.greatest(F.lit(1.0), F.col("s_n").cast("double")).alias("b"))
    t = cells.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k"))
    n, col = F.col("ta") + F.col("tb"), F.col("a") + F.col("b")

    def part(o: str, total: str) -> Column:
        e = F.col(total) * col / n
        d = F.abs(F.col(o) - e)
        return F.pow(F.when(F.col("k") == 2, d - F.least(F.lit(0.5), d)).otherwise(d), 2) / e

    return cells.join(F.broadcast(t)).agg(F.sum(part("a", "ta") + part("b", "tb")).alias("chi2"), (F.max("k") - 1).cast("int").alias("dof"))


def chi2_test(pool: DataFrame, sample: DataFrame, key: Column, **rows) -> tuple[float, float]:
    r = chi2_statistic(pool, sample, key, **rows).first()
    return (r.chi2, chi2_sf(r.chi2, r.dof)) if r.chi2 is not None and r.dof else (float("nan"), float("nan"))


def cardinality_ratio(pool: DataFrame, sample: DataFrame, col: str) -> DataFrame:
    """Distinct ids in the sample against what its size lets expect: ratio and verdict."""
    p = pool.agg(F.countDistinct(_c(col)).alias("u_p"), F.count(F.lit(1)).alias("n_p"))
    s = sample.agg(F.countDistinct(_c(col)).alias("u_s"), F.count(F.lit(1)).alias("n_s"))
    r = F.col("u_s") / F.greatest(F.col("u_p") * F.col("n_s") / F.greatest(F.col("n_p"), F.lit(1)), F.lit(FLOOR))
    return p.join(s).select("u_p", "u_s", r.alias("ratio")).withColumn("verdict", F.when(F.col("ratio").between(0.7, 1.3), "Good").when(F.col("ratio").between(0.4, 1.6), "Check").otherwise("Sparse"))


def category_tests(pool: DataFrame, sample: DataFrame, keys: dict[str, Column], dates: Sequence[str] = (), pool_rows: int = 0, sample_rows: int = 0) -> DataFrame:
    """feature, psi, chi2, dof of all ``keys``, from one shuffle over (feature, category).

    Null keys count as __NA__, but are left out of ``dates``, whose cells are the shares times the rows of the whole tables; their PSI is
    null where either side has fewer than ten values.
    """
    dated = F.col("feature").isin(list(dates)) if dates else F.lit(False)

    def side(df: DataFrame, is_sample: int) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.cast("string").alias("cat")) for k, c in keys.items()]))
        rows = df.select(rows.alias("x")).select("x.*").filter(~dated | F.col("cat").isNotNull())
        return rows.select("feature", F.coalesce("cat", F.lit("__NA__")).alias("cat"), F.lit(is_sample).alias("side"))

    counts = side(pool, 0).union(side(sample, 1)).groupBy("feature", "cat").agg(F.count_if(F.col("side") == 0).alias("p_n"), F.count_if(F.col("side") == 1).alias("s_n"))
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("p_n").alias("p_t"), F.sum("s_n").alias("s_t")))  # a row per feature
    share = lambda x, t: F.coalesce(N.ratio(F.col(x), F.col(t)), F.lit(0.0))
    cell = lambda x, n, rows: F.greatest(F.lit(1.0), F.when(dated, F.bround(F.col(x) * rows)).otherwise(F.col(n).cast("double")))
    shares = counts.join(totals, "feature").withColumns({"p": share("p_n", "p_t"), "s": share("s_n", "s_t")})
    cells = shares.select("feature", "p_t", "s_t", F.greatest("p", F.lit(FLOOR)).alias("e"), F.greatest("s", F.lit(FLOOR)).alias("f"), cell("p", "p_n", pool_rows).alias("a"), cell("s", "s_n", sample_rows).alias("b"))
    sums = F.broadcast(cells.groupBy("feature").agg(*[F.sum(c).alias(f"t{c}") for c in "efab"], F.count(F.lit(1)).alias("k")))  # a row per feature
    e, f = F.col("e") / F.col("te"), F.col("f") / F.col("tf")
    n, col = F.col("ta") + F.col("tb"), F.col("a") + F.col("b")

    def part(o: str) -> Column:
        want = F.col(f"t{o}") * col / n
        d = F.abs(F.col(o) - want)
        return F.pow(F.when(F.col("k") == 2, d - F.least(F.lit(0.5), d)).otherwise(d), 2) / want

    out = cells.join(sums, "feature").groupBy("feature").agg(F.sum((f - e) * F.log(f / e)).alias("psi"), F.sum(part("a") + part("b")).alias("chi2"), F.max("k").alias("k"), F.least(F.max("p_t"), F.max("s_t")).alias("least"))
    return out.select("feature", F.when((F.col("k") >= 2) & (~dated | (F.col("least") >= 10)), F.col("psi")).alias("psi"), "chi2", (F.col("k") - 1).cast("int").alias("dof"))


def drift_table(pool: DataFrame, sample: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence[str] = (), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Feature, type, psi, stat, p_value, sig, test, verdict, p_method (exact or asymptotic). One row per feature, dates two (quarter, weekday).

    The number of jobs does not depend on the number of features.
    """
    nan, rows = float("nan"), []
    if numeric:
        psi = {r.col_name: r.psi for r in psi_numeric(pool, sample, numeric).collect()}
        ks = {r.col_name: r for r in ks_statistics(pool, sample, numeric).collect()}
        stat = lambda r: (r.ks, *ks_p_value(r.ks, r.n, r.m, exact_rows)) if r is not None and r.ks is not None else (nan, nan, None)
        rows += [(c, "numeric", psi[c], *stat(ks.get(c)), "KS") for c in numeric]
    bins = {f"{c} ({name})": at(_c(c)) for c in dates for name, at in (("quarter", D.quarter), ("weekday", D.weekday))}
    keys = {c: _c(c) for c in categorical} | bins
    if keys:
        n = (pool.count(), sample.count()) if bins else (0, 0)
        found = {r.feature: r for r in category_tests(pool, sample, keys, list(bins), *n).collect()}
        for c in keys:
            r = found.get(c)
            test = (r.chi2, chi2_sf(r.chi2, r.dof), "asymptotic") if r is not None and r.chi2 is not None and r.dof else (nan, nan, None)
            rows.append((c, "datetime" if c in bins else "categorical", r.psi if r is not None else None, *test, "Chi-square"))
    out = pool.sparkSession.createDataFrame(rows, "feature string, type string, psi double, stat double, p_value double, p_method string, test string")
    keep = lambda c, places: F.round(F.when(~F.isnan(c), F.col(c)), places).alias(c)
    return out.select("feature", "type", keep("psi", 4), keep("stat", 4), keep("p_value", 4), N.significance(F.when(~F.isnan("p_value"), F.col("p_value"))).alias("sig"), "test", N.psi_verdict(F.col("psi")).alias("verdict"), "p_method")


def top_psi(table: DataFrame, most: int = 30) -> DataFrame:
    """The features of largest PSI, largest first."""
    return table.filter(F.col("psi").isNotNull()).orderBy(F.desc("psi"), "feature").limit(most)


def top_categories(pool: DataFrame, sample: DataFrame, col: str, most: int = 25) -> DataFrame:
    """cat, p, s: shares of the categories most frequent in the pool."""
    shares = category_shares(pool, sample, _c(col)).select("cat", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in "ps"])
    return shares.orderBy(F.desc("p"), "cat").limit(most)


def overall_verdict(table: DataFrame) -> DataFrame:
    """Mean and largest PSI, and the features of each verdict."""
    named = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("feature"))))
    out = table.agg(F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi"), named("Critical Shift").alias("critical"), named("Minor Shift").alias("minor"), F.count(F.lit(1)).alias("features"))
    return out.withColumn("verdict", F.when(F.size("critical") > 0, "Critical Shift").when(F.size("minor") > 0, "Minor Shift").otherwise("Stable"))


def max_psi(pool: DataFrame, sample: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence[str] = (), outcome: Sequence[str] = ()) -> tuple[float, bool]:
    """(largest PSI, whether every feature is below its threshold: 0.20 for outcome columns, else 0.10)."""
    found = [(r.col_name, r.psi) for r in psi_numeric(pool, sample, numeric).collect()] if numeric else []
    bins = {f"{c} ({name})": at(_c(c)) for c in dates for name, at in (("quarter", D.quarter), ("weekday", D.weekday))}
    keys = {c: _c(c) for c in (*categorical, *outcome)} | bins
    found += [(r.feature, r.psi) for r in category_tests(pool, sample, keys, list(bins)).collect()] if keys else []
    return _stability(found, outcome)


def _stability(found: Sequence[tuple[str, float | None]], outcome: Sequence[str] = ()) -> tuple[float, bool]:
    known = [(c, v) for c, v in found if v is not None]
    return max([0.0, *(v for _, v in known)]), all(v <= (0.20 if c in outcome or c.startswith("Fraud.") else 0.10) for c, v in known)


# Columns that say nothing on how well a sample represents its pool.
NOT_COMPARED = ("duplicate_tag", "tag_reason", "is_first_of_group", "address_postal_code", "owner1_first_name", "address_line_2", "address_city")
TIN_STATS = ("record_count", "n_mid", "n_state", "n_city", "fraud_count", "fraud_rate")


def compared_columns(pool: DataFrame, outcome: Sequence[str] = (), skip: Sequence[str] = (*NOT_COMPARED, *TIN_STATS), rid: str = "rid", head: int = 100) -> dict[str, list[str]]:
    """numeric, categorical, dates, outcome: the columns to compare, by the types of the pool's first ``head`` rows.

    Helper columns, ``skip``, the row id and columns of other types are left out.
    """
    types = feature_types(pool.orderBy(rid).limit(head))
    kept = {c: k for c, k in types.items() if not c.startswith("_") and c not in {*skip, *outcome, rid}}
    of = lambda *kinds: [c for c, k in kept.items() if k in kinds]
    return {"numeric": of("numeric"), "categorical": of("categorical", "binary"), "dates": of("datetime"), "outcome": [c for c in outcome if c in pool.columns]}


def psi_of_draws(pool: DataFrame, drawn: DataFrame, seeds: Sequence[int], numeric: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence[str] = (), edges: dict | None = None) -> DataFrame:
    """seed, feature, psi of samples told apart by ``seed`` against one pool; dates give two features (quarter, weekday).

    All samples share the pool's counts: one aggregate for the bins of numbers, one shuffle over (feature, category) for the rest.
    """
    out = psi_numeric(pool, drawn, numeric, by=["seed"], edges=edges).select("seed", F.col("col_name").alias("feature"), "psi") if numeric else None
    texts = {c for c, kind in pool.dtypes if kind == "string"}
    day = lambda c: F.try_to_timestamp(_c(c)) if c in texts else _c(c)
    bins = {f"{c} ({name})": at(day(c)) for c in dates for name, at in (("quarter", D.quarter), ("weekday", D.weekday))}
    keys = {c: _c(c) for c in categorical} | bins
    if not keys:
        return out
    dated = F.col("feature").isin(list(bins)) if bins else F.lit(False)

    def side(df: DataFrame, seed: Column) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.cast("string").alias("cat")) for k, c in keys.items()]))
        rows = df.select(seed.alias("seed"), rows.alias("x")).select("seed", "x.*").filter(~dated | F.col("cat").isNotNull())
        return rows.withColumn("cat", F.coalesce("cat", F.lit("__NA__")))

    both = side(pool, F.lit(None).cast("int")).union(side(drawn, F.col("seed")))
    per_seed = F.array(*[F.struct(F.lit(int(s)).alias("seed"), F.count_if(F.col("seed") == int(s)).alias("s")) for s in seeds])
    counts = both.groupBy("feature", "cat").agg(F.count_if(F.col("seed").isNull()).alias("p"), per_seed.alias("x"))
    long = counts.select("feature", "p", F.explode("x").alias("x")).select("feature", "p", "x.*").filter("p > 0 or s > 0")
    totals = F.broadcast(long.groupBy("feature", "seed").agg(F.sum("p").alias("pt"), F.sum("s").alias("st")))  # a row per feature and seed
    e, a = (F.greatest(F.coalesce(N.ratio(F.col(x), F.col(f"{x}t")), F.lit(0.0)), F.lit(FLOOR)) for x in "ps")
    gap = F.log(a / e)
    sums = long.join(totals, ["feature", "seed"]).groupBy("seed", "feature").agg(F.sum(a * gap).alias("ag"), F.sum(e * gap).alias("eg"), F.sum(a).alias("a"), F.sum(e).alias("e"), F.count(F.lit(1)).alias("k"), F.least(F.max("pt"), F.max("st")).alias("least"))
    # With shares scaled to one, the logs of both scales cancel out.
    psi = F.when((F.col("k") >= 2) & (~dated | (F.col("least") >= 10)), F.col("ag") / F.col("a") - F.col("eg") / F.col("e"))
    found = sums.select("seed", "feature", psi.alias("psi"))
    return found if out is None else out.unionByName(found)


def stable_seed(pool: DataFrame, reference: DataFrame, sizes: dict, columns: dict[str, Sequence[str]], target: str = "is_fraud", rid: str = "rid", first: int = 0, seeds: int = 100, batch: int = 8) -> tuple[int, float, bool]:
    """(seed, max PSI, stable) of least max PSI among ``seeds`` seeds from ``first`` up to the first whose sample is stable.

    ``columns`` as :func:`compared_columns` gives them. The bins of the reference are computed once, ``batch`` seeds are measured in a job.
    """
    numeric, outcome = list(columns.get("numeric", ())), list(columns.get("outcome", ()))
    categorical, dates = [*columns.get("categorical", ()), *outcome], list(columns.get("dates", ()))
    compared = list(dict.fromkeys([*numeric, *categorical, *dates]))
    narrow = lambda df, *more: df.select(*[_c(c) for c in dict.fromkeys([*more, *compared])]).persist(StorageLevel.MEMORY_AND_DISK)
    # All batches read the same two tables of the compared columns, which are computed once and kept for the search.
    kept = [narrow(pool, rid, target)]
    kept.append(kept[0] if reference is pool else narrow(reference))
    try:
        edges = bin_edges(kept[1], numeric) if numeric else None
        counts = strata_counts(kept[0], sizes, target)
        best = (first, float("inf"), False)
        for start in range(first, first + seeds, batch):
            group = range(start, min(start + batch, first + seeds))
            found = psi_of_draws(kept[1], draws(kept[0], sizes, group, target, rid, counts), group, numeric, categorical, dates, edges).collect()
            for seed in group:
                value, ok = _stability([(r.feature, r.psi) for r in found if r.seed == seed], outcome)
                if value < best[1]:
                    best = (seed, value, ok)
                if ok:
                    return best
        return best
    finally:
        for df in kept:
            df.unpersist()


def rate_by_bin(df: DataFrame, bin_: Column, bins: Sequence, target: str) -> DataFrame:
    """Per calendar bin: rows, share of all, mean of the target; missing bins have 0."""
    fixed = df.sparkSession.createDataFrame([(b,) for b in bins], "bin int")
    found = df.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(_c(target).cast("double")).alias("rate")).filter("bin is not null")
    total = F.sum("n").over(Window.partitionBy())  # a row per bin
    return fixed.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.col("n") / total, F.lit(0.0)), 6).alias("share"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"))


def rate_by_category(df: DataFrame, col: str, target: str) -> DataFrame:
    """Per category: percent of the target and its complement."""
    return df.filter(_c(col).isNotNull()).groupBy(_c(col).alias("category")).agg(F.round(F.avg(_c(target).cast("double")) * 100, 2).alias("pct")).withColumn("complement", F.round(100 - F.col("pct"), 2))
