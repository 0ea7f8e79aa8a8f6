"""Reports over the tags read them once, whatever they list."""

from pyspark.sql import functions as F

from quartzite.operators import entity
from quartzite.plans import entities as E

SCHEMA = "tin string, mid string, duplicate_tag string, is_fraud int"


def joins(df) -> int:
    """Joins of the plan in which the tags are found; every pass over the tags has three."""
    return sum("Join LeftOuter" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_breakdown_reads_the_tags_once(spark, sf_dir):
    assert joins(E.QUERIES["excl_breakdown"](spark, sf_dir)) == 3


def test_breakdown_of_few_rows(spark):
    rows = [("1", "2", "A", 1), ("1", "", "A", 1), (None, "2", "B", None), ("", None, "B", 0), ("3", "4", "B", 0)]
    got = {tuple(r) for r in entity.exclusion_breakdown(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("A", 2, 2, 0, 100.0, 40.0), ("B", 3, 0, 3, 0.0, 60.0), ("MISSING_ID", 3, 1, 2, 33.33, 60.0)}
    whole = entity.exclusion_breakdown(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert {tuple(r) for r in whole} == {("A", 1, 1, 0, 100.0, 100.0), ("MISSING_ID", 0, 0, 0, 0.0, 0.0)}
    assert [tuple(r) for r in entity.exclusion_breakdown(spark.createDataFrame([], SCHEMA)).collect()] == [("MISSING_ID", 0, 0, 0, 0.0, None)]


def test_browsing_reads_the_tags_once(spark, sf_dir):
    for name in ("tin_browse_filter", "tin_decision"):
        df = E.QUERIES[name](spark, sf_dir)
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert joins(df) == 3 and "Generate" not in text and "Window" not in text, name


def test_tin_tags_equal_the_summary(spark, sf_dir):
    rows = [("1", "a", "UNIQUE_CLEAN_NON_LINKED", 1), ("1", "b", "EXACT_DUPLICATE", 0), ("1", "b", "EXACT_DUPLICATE", 0), ("", "c", "INVALID_FOR_KYC", 0), (None, "c", "INVALID_FOR_KYC", 0), ("2", None, "TECH_REAPPLICATION", None)]
    got = {tuple(r) for r in entity.tin_tags(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("1", 3, "EXACT_DUPLICATE, UNIQUE_CLEAN_NON_LINKED"), ("2", 1, "TECH_REAPPLICATION")}
    tags = E.tags(spark, sf_dir)
    fields = ("tin", "record_count", "tags")
    assert {tuple(r) for r in entity.tin_tags(tags).collect()} == {tuple(r) for r in entity.tin_summary(tags).select(*fields).collect()}


def test_kept_rows_need_no_sorted_input(spark, sf_dir):
    text = E.tags(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_kept_rows_of_far_days_and_ids(spark):
    """Days before 1970 and at both ends, negative ids, ids near both ends of a long; a group of one outcome, of none, of outcomes above one."""
    big = 2**63 - 1
    rows = [(-big - 1, "0001-01-01", 0), (-3, None, 1), (5, "1969-12-31", 2), (7, "1969-12-31", 2), (big, "9999-12-31", None)]
    def tagged(which):
        df = spark.createDataFrame([(i, "", "", "N", "F", "S", "1", d, y) for i, d, y in which], "rid long, tin string, mid string, legal_name string, owner_first string, state string, postal string, day string, is_fraud int")
        out = entity.tagged(df.withColumn("open_date", F.col("day").cast("date")).drop("day").withColumn("_same", F.lit(1)), identity=("legal_name", "owner_first", "state"))
        return {r.rid: (r.duplicate_tag, r.is_first_of_group) for r in out.collect()}
    got = tagged(rows)
    # Rows without a TIN are invalid unless they are linked: the fraud group keeps the earliest of its greatest outcome.
    assert {i for i, (tag, _) in got.items() if tag == "IDENTITY_GROUP_FRAUD"} == {-big - 1, -3, big} and got[7][0] == "EXACT_DUPLICATE"
    assert {i for i, (_, first) in got.items() if first} == {-big - 1}
    clean = tagged([(i, d, None) for i, d, _ in rows if i != 7])
    assert {i for i, (_, first) in clean.items() if first} == {-big - 1} and {tag for tag, _ in clean.values()} == {"INVALID_FOR_KYC"}
