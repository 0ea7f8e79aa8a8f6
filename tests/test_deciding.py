"""Types from counters without a shuffle where they suffice, the same as from all distinct values."""

from pyspark.sql import functions as F

from quartzite.operators import profile as P
from quartzite.plans import analyses


def test_same_types_as_by_distinct_values(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") / 7).alias("part"), (F.col("id") % 3).alias("three"), (F.col("id") % 2).alias("two"), F.lit(4).alias("one"), (F.col("id") + 5_000_000).alias("large"),
        (F.col("id") % 20 + 2_000_000).alias("few_large"), (F.col("id") % 50 + 1990).alias("years"), (F.col("id") + 30000).alias("serial"), F.lit(None).cast("int").alias("none"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") * 1.5).alias("gaps"), (F.col("id") % 7 == 0).alias("flag"), (F.col("id") % 12).cast("decimal(9,2)").alias("dec"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 9).alias("day"), F.col("id").cast("string").alias("text"), (F.col("id") % 400).alias("acct"), (F.col("id") / 3).cast("float").alias("single"),
        F.lit(float("nan")).alias("nans"), (F.col("id") % 11).alias("eleven"), (F.col("id") % 10 + 1).alias("ten"),
    )
    full = P.type_counters(df).collect()
    assert P.feature_types(df) == P._types_of(df, full, df.columns) and P.single_types(df) == P._types_of(df, full, df.columns, single=True)
    assert sorted(P.serial_dates(df, ["id", "serial", "years"])) == ["serial"]


def test_numbers_need_no_distinct_values(spark, sf_dir, monkeypatch):
    asked = []
    kept = P.type_counters
    monkeypatch.setattr(P, "type_counters", lambda df, cols=None: asked.append(cols) or kept(df, cols))
    assert set(P.feature_types(analyses.numbers(spark, sf_dir)).values()) == {"numeric"}
    assert not asked


def test_correlations_share_their_sums(spark):
    rows = spark.range(500).select((F.col("id") * 1.5 + 1e7).alias("a"), (F.col("id") * F.col("id")).alias("b"), F.lit(0.1).alias("flat"), F.when(F.col("id") % 3 > 0, F.sin("id")).alias("gaps"))
    got = {(r.feature_1, r.feature_2): r.correlation for r in P.correlations(rows).collect()}
    want = {k: rows.agg(P.pearson(P.num_(k[0]), P.num_(k[1]))).first()[0] for k in (("a", "b"), ("a", "gaps"), ("b", "gaps"))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    text = P.correlations(rows, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in text and "covar" not in text
