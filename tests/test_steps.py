"""Steps that several others read are computed once per row."""

from pyspark.sql import functions as F

from quartzite.operators import clean, report
from quartzite.plans import cleaning as C


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_address_steps_are_columns(spark, sf_dir):
    text = plan(C.pipe_exact(spark, sf_dir))
    assert text.count("split(") == 1 and text.count("rlike") <= 4, "parts are cut and looked at once"


def test_compared_cells_are_columns(spark, sf_dir):
    generators = [line for line in plan(C.compare(spark, sf_dir)).splitlines() if "Generate" in line]
    assert len(generators) == 1 and "regexp_replace" not in generators[0], "a generator computes nothing twice"
    fields = "rid feature original standardized tags reason resolution".split()
    assert C.compare(spark, sf_dir).columns == fields


def test_address_parts_as_columns(spark):
    rows = ["ACME LLC|1 Main St|Austin|TX|78701|US", "acme|Acme|7 Oak Ave|Suite 5|Dallas|Texas|7520|USA", "acme| a |b|\r\n c|d ", "x", "a|b|c|d", "", None, "nan"]
    df = spark.createDataFrame([(i, a, "Acme", None) for i, a in enumerate(rows)], "i int, addr string, lgl string, _anything string")
    got = {}
    for fuzzy in (False, True):
        out = clean.with_address_parts(df, F.col("addr"), F.col("lgl"), F.col("_anything"), fuzzy)
        got[fuzzy] = [tuple(r) for r in out.orderBy("i").select("address_1", "address_2", "city", "country").collect()]
        assert set(df.columns) < set(out.columns) and len(out.columns) == len(df.columns) + len(clean.PARTS)
    exact = [("ACME LLC", "1 Main St", "Austin", "US"), ("7 Oak Ave", "Suite 5", "Dallas", "USA"), ("acme", "", "a", "d"), ("x", "", "", ""), ("", "", "a", "d"), *[("", "", "", "")] * 3]
    assert got[False] == got[True] == exact


def test_failed_samples_keep_order(spark, sf_dir):
    got = report.failed_samples(C.compare(spark, sf_dir), "zip", 3).collect()
    assert [r.rid for r in got] == sorted(r.rid for r in got) and {r.resolution for r in got} == {"Unresolved"}


def test_standardizer_steps_are_columns(spark, sf_dir):
    """The digits of a phone, a zip and a TIN are found once per row, not once per use."""
    text = plan(C.export(spark, sf_dir))
    assert text.count("regexp_replace(") < 90, text.count("regexp_replace(")


def test_company_names_of_few_rows(spark):
    """Rows without a doubtful part don't pass through Python objects; nulls and empty batches keep their places."""
    rows = [None, "only street", "Acme Incorp|7 Oak Ave|Austin|TX|78701|US", "1 Main St|Austin|TX|78701|US", "", "Acme Inc|8 Oak Ave|Dallas|TX|1|US", "Other|9 Oak Ave|Dallas|TX|1|US"]
    df = spark.createDataFrame([(i, a, "Acme Inc") for i, a in enumerate(rows)], "i int, addr string, lgl string").coalesce(1)
    out = clean.with_address_parts(df, F.col("addr"), F.col("lgl"), F.lit(None).cast("string"))
    assert [r.address_1 for r in out.orderBy("i").collect()] == ["", "only street", "7 Oak Ave", "1 Main St", "", "8 Oak Ave", "Other"]
    none = clean.with_address_parts(df.filter("i in (0, 1, 4)"), F.col("addr"), F.col("lgl"), F.lit(None).cast("string"))
    assert sorted(r.address_1 for r in none.collect()) == ["", "", "only street"]
