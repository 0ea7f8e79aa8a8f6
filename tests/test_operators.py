import json
import math
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import clean, drift, entity, profile, ranks, report, sampling, stats_math
from quartzite.operators.analyzer import Analyzer
from quartzite.plans.cleaning import COLS, ROLES, contacts
from quartzite.plans.entities import applications
from quartzite.sources import io


def test_address(spark):
    rows = [
        ("1 Oak Ave|Suite 5|Dallas|TX|75201|US", None, "1 Oak Ave", "Suite 5", "1 Oak Ave, Suite 5, Dallas, TX, 75201, US"),
        ("only street", None, "only street", "", "only street"),
        ("Austin|TX|78701|US", None, "", "", "Austin|TX|78701|US"),
        ("Acme Widgets Inc|12 Main St|Austin|TX|78701|US", "Acme Widgets", "12 Main St", "", "12 Main St, Austin, TX, 78701, US"),
        ("Acme Widgets|Austin|TX|78701|US", "Acme Widgets", "Acme Widgets", "", "Acme Widgets, Austin, TX, 78701, US"),
        ("nan", None, "", "", ""), ("", None, "", "", ""), (None, None, "", "", ""),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, addr string, lgl string")
    parts = clean.address_parts(F.col("addr"), F.col("lgl"), F.lit(None).cast("string"))
    got = df.select("i", *[parts[p].alias(p) for p in ("address_1", "address_2", "full_address")]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [r[2:] for r in rows]


def test_similarity_is_ratcliff_obershelp():
    assert clean.similarity("ACMELLC", "ACME") == SequenceMatcher(None, "ACMELLC", "ACME").ratio() > 0.72


def test_quality_score_is_half_even(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string")
    r = clean.quality_raw(df, {}).first()
    assert (r.score, r.missing, r.m_pct) == (88, 1, 25.0)


def test_cleaning_run(spark, sf_dir):
    df = contacts(spark, sf_dir)
    table, issues, stats = clean.run_data_check_and_cleaning(df, ROLES)
    assert table.count() == issues.count() == df.count() == stats["global"].first().total_rows
    assert {"address_1_std", "TIN_std_no_format", "Duplicate_TIN_CHECK", "Duplicate_Address_CHECK"} <= set(table.columns)
    assert clean.infer_roles(df)["zip_zip"] == "zip"


def test_plans_stay_native(spark, sf_dir):
    df = contacts(spark, sf_dir)
    for frame in (clean.issue_matrix(df, ROLES, COLS), clean.quality_raw(df, ROLES, COLS), entity.tagged(applications(spark, sf_dir))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert report.issues_long(df, ROLES, COLS)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_tags_partition_rows(spark, sf_dir):
    tags = entity.tagged(applications(spark, sf_dir))
    counts = {r.duplicate_tag: r.n for r in entity.tag_counts(tags).collect()}
    assert set(counts) == set(entity.TAGS) and sum(counts.values()) == tags.count()
    with pytest.raises(ValueError):
        entity.tagged(tags.drop("open_date"))


def test_stratified_counts(spark):
    pool = spark.range(1000).select(F.col("id").alias("rid"), (F.col("id") % 20 == 0).cast("int").alias("is_fraud"))
    sizes = sampling.strata_sizes(pool, 100)
    assert sizes == (5, 95)
    s = sampling.stratified(pool, {1: sizes[0], 0: sizes[1]})
    assert {r.is_fraud: r["count"] for r in s.groupBy("is_fraud").count().collect()} == {1: 5, 0: 95}
    assert sorted(r.rid for r in s.collect()) == sorted(r.rid for r in sampling.stratified(pool, {1: 5, 0: 95}).collect())
    assert sampling.safe_sample(pool, "is_fraud", 50).count() == 50
    with pytest.raises(ValueError):
        sampling.strata_sizes(pool, 5000, 0.01)


def test_psi(spark):
    a = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("c"))
    assert drift.psi_numeric(a, a, "v").first().psi == 0
    assert abs(drift.psi_categorical(a, a, "c").first().psi) < 1e-12
    assert drift.psi_numeric(a.limit(5), a, "v").first().psi is None
    b = a.filter("v < 50")
    assert drift.psi_numeric(a, b, "v").first().psi > 0.2
    assert drift.ks_test(a, a, "v") == (0.0, 1.0)
    assert drift.max_psi(a, a, ["v"], ["c"])[1]


def test_seed_search(spark):
    pool = spark.range(2000).select(F.col("id").alias("rid"), (F.col("id") % 10 == 0).cast("int").alias("is_fraud"), (F.col("id") % 7).cast("string").alias("c"))
    seed, value = sampling.search_seed(pool, pool, {1: 100, 0: 900}, lambda p, s: drift.max_psi(p, s, categorical=["c"]), seeds=3)
    assert 0 <= seed < 3 and value <= 0.1


def test_p_values():
    assert abs(stats_math.chi2_sf(7.8147, 3) - 0.05) < 1e-5
    assert abs(stats_math.chi2_sf(3.8415, 1) - 0.05) < 1e-5
    assert stats_math.chi2_sf(0, 4) == 1.0


def paths_beyond(d, n, m):
    """The exact p-value by counting all paths."""
    @lru_cache(None)
    def inside(i, j):
        if abs(i / n - j / m) >= d - 1e-12:
            return 0
        return 1 if i == j == 0 else (inside(i - 1, j) if i else 0) + (inside(i, j - 1) if j else 0)

    return 1 - inside(n, m) / math.comb(n + m, n)


def test_exact_p_values():
    """Against a count of all paths, tables of critical values, and the asymptotic value for many rows."""
    for n, m in ((1, 1), (3, 5), (6, 6), (7, 12), (10, 4), (1, 9)):
        for k in range(1, n * m + 1):
            d = k / (n * m)
            if any(abs(d - abs(i / n - j / m)) < 1e-12 for i in range(n + 1) for j in range(m + 1)):
                assert stats_math.ks_exact_sf(d, n, m) == pytest.approx(paths_beyond(d, n, m), abs=1e-11)
    for n, d, p in ((4, 1.0, 0.02857), (5, 0.8, 0.07937), (10, 0.7, 0.01234), (20, 0.45, 0.03354)):  # equal sizes, as tabulated
        assert stats_math.ks_exact_sf(d, n, n) == pytest.approx(p, abs=6e-6)
    assert stats_math.ks_exact_sf(0.0, 5, 5) == 1.0 and stats_math.ks_exact_sf(1.0, 1, 1) == 1.0
    assert stats_math.ks_exact_sf(0.022, 9000, 8000) == pytest.approx(stats_math.ks_sf(0.022, 9000, 8000), rel=0.05)


def test_drift_table_names_its_method(spark):
    a = spark.range(300).select((F.col("id") % 41).cast("double").alias("v"))
    b = a.filter("v > 3")
    rows = [drift.drift_table(a, b, ["v"], exact_rows=limit).first() for limit in (10_000, 10)]
    assert [r.p_method for r in rows] == ["exact", "asymptotic"] and rows[0].stat == rows[1].stat and 0 < abs(rows[0].p_value - rows[1].p_value) < 0.1


def test_seed_search_reads_its_pool_once(spark):
    """The pool is computed once for all batches of seeds, and nothing stays cached."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pool = spark.range(3000, numPartitions=3).select(F.col("id").alias("rid"), (F.col("id") % 10 == 0).cast("int").alias("is_fraud"), (F.col("id") % 7).cast("string").alias("c"), F.lit("wide").alias("more")).mapInArrow(count, "rid long, is_fraud int, c string, more string")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = drift.stable_seed(pool, pool, {1: 5, 0: 12}, {"categorical": ["c"]}, seeds=6, batch=2)
    assert seen.value == 3000 and found[1] > 0 and len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)] + [(math.nan, 0), (None, 1)], "v double, g int").withColumn("h", F.col("g").cast("string"))
    d = profile.describe(df, ["v"]).first()
    assert (d.n, d.mean, d.max, d.q3) == (20, 9.5, 19.0, 14.25) and profile.describe(df, ["v"], approximate=True).first().n == 20
    assert profile.variance(df, ["v"]).first().value_range == 19 and not math.isnan(profile.skewness(df, ["v"]).first().skew)
    assert profile.outliers(df, ["v"]).first().n == 20 and sum(r.n for r in profile.histogram(df, "v", 4).collect()) == 20
    assert {r.category: (r.min, r.max) for r in profile.box_stats(df, "v", "h").collect()} == {"0": (0.0, 18.0), "1": (1.0, 19.0)}
    assert {r.category: r.n for r in profile.group_stats(df, "v", "h").collect()} == {"0": 10, "1": 10} and profile.trend(df, "v", "g").first().n == 20


def test_types(spark):
    df = spark.createDataFrame([(i, i % 2, "x" if i % 2 else "y", float(i) / 7, f"2024-01-{i % 28 + 1:02d}", None) for i in range(100)], "user_id int, flag int, kind string, v double, day string, none string")
    assert profile.feature_types(df) == {"user_id": "id", "flag": "binary", "kind": "binary", "v": "numeric", "day": "datetime", "none": "unknown"}


def test_number_dates(spark):
    df = spark.createDataFrame([(44927 + i, 1990 + i % 30, 202300 + i % 12 + 1, 10**9 + i * 7, float(i)) for i in range(60)], "opened int, y int, ym int, ref bigint, v double")
    types = profile.feature_types(df)
    assert types == {"opened": "datetime", "y": "datetime", "ym": "datetime", "ref": "id", "v": "numeric"}
    fixed = profile.fixed_types(df, types)
    assert dict(fixed.dtypes)["opened"] == "date" and dict(fixed.dtypes)["y"] == "int"
    assert str(fixed.agg(F.min("opened")).first()[0]) == "2023-01-01"
    assert [r["feature"] for r in Analyzer(df).report_type_issues()] == ["opened"]  # calendar years are no serial dates


def test_load_and_tag_normalizes(spark):
    """The same TIN and MID in other spellings is a later application (of another identity group, by its postal code); texts that are no ids count as blank."""
    rows = [
        (1, "123.0", "77", "acme", "o", "n", "tx", "austin", "78701", "2024-01-01", 0), (2, "123", "77.0", "ACME ", "O", "N ", "TX", "Austin", "78702", "2024-01-02", 0),
        (3, "nan", None, "Other", "p", "q", "NY", None, "10001", "not a date", 1), (4, "abc", " ", "Third", "p", "q", "NY", "x", "10001", "2024-01-01", 0),
    ]
    df = spark.createDataFrame(rows, "rid int, tin string, mid string, legal_name string, owner_first string, owner_last string, state string, city string, postal string, open_date string, is_fraud int")
    got = {r.rid: r for r in entity.load_and_tag(df).collect()}
    assert [got[i].duplicate_tag for i in (1, 2, 3, 4)] == ["UNIQUE_CLEAN_NON_LINKED", "TECH_REAPPLICATION", "INVALID_FOR_KYC", "INVALID_FOR_KYC"]
    assert [(got[i].tin, got[i].mid, got[i].record_count, got[i].n_state) for i in (1, 2)] == [("123", "77", 2, 1)] * 2
    assert [got[i].is_first_of_group for i in (1, 2, 3, 4)] == [True, False, False, True] and got[3].record_count is None


def test_constants_and_single_columns(spark):
    df = spark.createDataFrame([(9, "N/A", "US", i % 4) for i in range(40)], "nine int, gone string, country string, grade int")
    assert profile.feature_types(df) == {"nine": "numeric", "gone": "unknown", "country": "categorical", "grade": "categorical"}
    assert [profile.single_type(df, c) for c in df.columns] == ["numeric", "unknown", "unknown", "numeric"]


def test_quantiles_are_exact(spark):
    """Against the built-in percentile, with repeats, a long tail, nulls, one value and none."""
    rows = [("a", float(i % 17)) for i in range(300)] + [("a", 1e9), ("b", 3.0), ("c", None)] + [("d", 2.0**i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    steps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {r.g: r.q for r in df.filter("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, steps))).alias("q")).collect()}
    assert {r.g: r.q for r in ranks.quantiles(df, ["g"], "v", steps).collect()} == {g: pytest.approx(q) for g, q in want.items()}
    assert ranks.quantiles(df.limit(0), ["g"], "v", steps).count() == 0


def test_quantiles_over_ranges(spark):
    """Many ranges a key, of columns of all scales, with weights, ties across cuts and NaN: as a plain sort gives."""
    rng = np.random.default_rng(8)
    columns = {"big": rng.normal(1e9, 1e7, 4000), "small": rng.normal(0, 1e-6, 4000), "ties": rng.integers(0, 4, 4000).astype(float), "few": rng.normal(0, 1, 30), "tail": rng.pareto(0.4, 4000)}
    rows = [(k, float(v), i % 3) for k, x in columns.items() for i, v in enumerate(x)] + [("few", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, t int").repartition(6)
    steps = [0.0, 0.003, 0.25, 0.5, 0.77, 1.0]
    for times in (None, "t"):
        got = {r.k: (r.n, r.q) for r in ranks.quantiles(df, ["k"], "v", steps, times, per_range=50).collect()}
        for k, x in columns.items():
            whole = np.repeat(x, [i % 3 for i in range(len(x))]) if times else x
            assert got[k][0] == len(whole) and got[k][1] == pytest.approx(np.quantile(whole, steps).tolist(), rel=1e-12)
    counted = df.filter("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in ranks.running(counted, df.filter("v is not null"), ["k"], "v", ["n"], per_range=50).collect():
        assert (r.n_upto, r.n_total) == ((columns[r.k] <= r.v).sum(), len(columns[r.k]))


def test_every_column_has_ranges_of_its_own(spark):
    """300 columns of scales from 1e-10 to 1e10: each is cut into many ranges of about the same size."""
    df = spark.range(0, 3000, 1, 4).select(*[(F.pow(F.lit(10.0), k % 21 - 10) * (F.col("id") * 7919 % 3001)).alias(f"c{k}") for k in range(300)])
    long = ranks.long_values(df, {c: F.col(c) for c in df.columns})
    cuts = ranks.cuts_of(long, ["feature"], "v", per_range=100)
    assert len(cuts) == 300 and all(25 <= len(r.cuts) < 31 for r in cuts)
    sizes = ranks.with_range(long, ["feature"], "v", cuts).groupBy("feature", "range").count()
    least, most = sizes.agg(F.min("count"), F.max("count")).first()
    assert sizes.count() >= 300 * 26 and 40 < least and most < 200


def test_alerts_on_formats(spark):
    df = spark.createDataFrame([("212-555-0000", "2024-01-01", "Yes", "abc"), ("2125550000", "Jan 1 2024", "yes", "DEF"), ("x", "2024-01-02", "no", "g")], "phone string, open_date string, answer string, other string")
    found = {(r.feature, r.severity, r.value) for r in profile.alerts(df).collect() if r.alert_type == "FORMAT INCONSISTENCY"}
    assert found == {("phone", "HIGH", 3.0), ("open_date", "MEDIUM", 2.0), ("answer", "LOW", 1.0)}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, float(i), i % 2) for i in range(30)], "c int, v double, y int")
    assert {(r.feature_1, r.feature_2) for r in profile.correlations(df).collect()} == {("v", "y")}
    assert {r.feature: r.status for r in profile.variance(df).collect()}["c"] == "constant"
    assert ("c", "CONSTANT") in {(r.feature, r.alert_type) for r in profile.alerts(df).collect()}


def test_leak_names():
    assert profile.leak_names(["city", "amount"], "fraud") == ["city"]  # it holds a y
    assert profile.leak_names(["city", "amount"], "fraud", strict=True) == []


def test_analyzer(spark, sf_dir, tmp_path):
    a = Analyzer(applications(spark, sf_dir).drop("rid"), "is_fraud")
    results = a.run_all_analyses()
    assert {"feature_types", "missing_values", "correlations", "leakage_risk", "feature_quality", "data_alerts"} <= set(results)
    a.export_results(str(tmp_path / "r.json"))
    assert json.load(open(tmp_path / "r.json"))["feature_types"]["total_features"] == 12


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,v,f\n1,"a ""q""",1.5,true\n2,NA,,false\n')
    df = io.read_table(spark, f"file://{tmp_path}/a.csv")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double"), ("f", "boolean")]
    assert df.orderBy("id").collect()[1].name is None
    io.write_csv(df, f"file://{tmp_path}/out", one_file=True)
    assert io.read_csv(spark, f"file://{tmp_path}/out").count() == 2


def test_html(spark):
    page = report.generate_html_report({"rows": 3}, tables={"t": spark.range(3)}, notes=["<b>"], raw_stats={"total_rows": 10, "rows_with_issues": 1})
    assert "Strong" in page and "&lt;b&gt;" in page and page.count("<tr>") == 6


def test_quality_page(spark, sf_dir):
    df = contacts(spark, sf_dir)
    page = report.quality_page(df, ROLES, COLS, notes={2: "<look>"}, listed=5)
    assert [f"id='{i}'" in page for i in ("summary", "s1", "s2", "s3", "s4", "s5")] == [True] * 6
    assert page.count("<blockquote>") == 1 and "&lt;look&gt;" in page and "<look>" not in page
    dups = report.duplicate_totals(clean.cleaned(df, ROLES)).first()
    assert dups.tin_dups > 0 and f"share their TIN: {dups.tin_dups:,} (" in page


def test_draws_are_those_of_a_full_sort(spark):
    """Also where equal ids crowd a key, and where a stratum is smaller than its size."""
    pool = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("rid"), (F.col("id") % 30 == 0).cast("int").alias("is_fraud"))
    got = sampling.draws(pool, {1: 500, 0: 40}, [1, 2])
    for seed in (1, 2):
        for value, k in ((1, 500), (0, 40)):
            want = pool.filter(F.col("is_fraud") == value).orderBy(sampling.rank_key(seed, "rid"), "rid").limit(k)
            assert sorted(r.rid for r in got.filter((F.col("seed") == seed) & (F.col("is_fraud") == value)).collect()) == sorted(r.rid for r in want.collect())
    assert sampling.draws(pool.limit(0), {1: 5}, [1]).count() == 0


def test_seeds_in_a_job_equal_single_seeds(spark):
    pool = spark.range(4000).select(F.col("id").alias("rid"), (F.col("id") % 10 == 0).cast("int").alias("is_fraud"), (F.col("id") % 7).cast("string").alias("c"), (F.col("id") % 91).cast("double").alias("v"))
    sizes = {1: 20, 0: 180}
    one = sampling.search_seed(pool, pool, sizes, lambda p, s: drift.max_psi(p, s, ["v"], ["c"]), seeds=6)
    seed, value, _ = drift.stable_seed(pool, pool, sizes, {"numeric": ["v"], "categorical": ["c"]}, seeds=6, batch=4)
    assert seed == one[0] and value == pytest.approx(one[1])


def test_compared_columns(spark, sf_dir):
    found = drift.compared_columns(entity.load_and_tag(applications(spark, sf_dir)), outcome=["is_fraud", "fraud_type"])
    every = [c for cols in found.values() for c in cols]
    assert found["outcome"] == ["is_fraud", "fraud_type"] and "amount" in found["numeric"] and "open_date" in found["dates"]
    assert not {"rid", "duplicate_tag", "record_count", "fraud_rate"} & set(every)


def test_bivariate_needs_ten_rows(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(9)], "v double, k string")
    assert "error" in Analyzer(df).analyze_bivariate_relationships([("v", "k")])["v_vs_k"]
