import pytest
from pyspark.sql import functions as F

from quartzite.functions import dates as D
from quartzite.functions import numbers as N
from quartzite.functions import strings as S

CASES = [
    (S.standardize_phone, [("2125551234", "(212) 555-1234"), ("12125551234", "+1 (212) 555-1234"), ("2125551234.0", "(212) 555-1234"), ("555-1234", "555-1234"), (None, None)]),
    (S.phone_issue, [("2125551234", False), ("22125551234", True), ("", False), (None, False), ("12", True)]),
    (S.standardize_zip, [("7702", "07702"), ("7702.0", "07702"), ("10001-1234", "10001"), ("ABC", "ABC"), ("nan", None), (None, None)]),
    (S.zip_issue, [("10001", False), ("10001-1234", False), ("770", True), ("", False), ("nan", False), (None, False)]),
    (S.standardize_tin, [("12345678", "01-2345678"), ("123456789", "12-3456789"), ("123-45-6789", "123-45-6789"), ("12", "12"), (None, None)]),
    (S.tin_digits, [("12-3456789", "123456789"), ("12345678", "012345678"), ("12345678.0", "123456780"), ("12", ""), (None, "")]),
    (S.tin_issue, [("123456789", False), ("12345678", True), (None, False), ("  ", False)]),
    (S.standardize_state, [("Texas", "TX"), ("tx", "TX"), ("New York", "New York"), (None, None)]),
    (lambda c: S.standardize_state(c, two_words=True), [("New York", "NY"), ("ZZ", "ZZ")]),
    (S.standardize_country, [("usa", "USA"), ("United States", "USA"), ("America", "USA"), ("Canada", "Canada"), (None, None)]),
    (S.entity_key, [("Acme Co, LLC", "ACME"), (None, None)]),
    (S.standardize_name, [("  #Acme   corp$ ", "ACME CORP"), (None, None)]),
    (S.address_type, [("12 Flower St", "Commercial"), ("12 Oak Rd", "Residential"), (None, "Unknown")]),
    (S.has_whitespace_issue, [(" a", True), ("a ", True), ("a  b", True), ("a b", False), (None, False)]),
    (S.has_special_chars, [("a#b", True), ("a\\b", True), ("ab", False), (None, False)]),
    (S.match_key, [(" Acme-1 ", "ACME1"), (None, "")]),
    (S.normalized_id, [("12.0", "12"), ("007", "7"), ("1234567890.0", "1234567890"), ("", ""), (None, "")]),
    (S.trim_if_content, [(" a ", "a"), ("   ", "   "), (None, None)]),
    (S.distinct_tags, [("B, A,B", "A,B"), ("", "GOOD_DATA"), (None, "GOOD_DATA")]),
    (N.parse_number, [("1.5", 1.5), ("1d", None), ("x", None), ("-3", -3.0)]),
    (lambda c: D.from_excel_serial(c).cast("string"), [("44927.54", "2023-01-01")]),
    (D.standardize_datetime, [("2024-01-02", "2024-01-02"), ("01/02/2024", None), (None, None)]),
]


@pytest.mark.parametrize("f, rows", CASES)
def test_values(spark, f, rows):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string")
    got = [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]
    assert got == [want for _, want in rows]


@pytest.mark.parametrize("f", [S.standardize_phone, S.standardize_zip, S.clean_text, S.standardize_name, S.standardize_tin])
def test_idempotent(spark, f):
    df = spark.createDataFrame([(v,) for v in ("2125551234", "7702.0", " a#b  c ", "12-3456789", "", None)], "v string")
    once = df.select(f(F.col("v")).alias("v"))
    assert once.collect() == once.select(f(F.col("v")).alias("v")).collect()


def test_tiers(spark):
    df = spark.range(1, 60).select(N.tier(F.col("id")).alias("t"))
    assert {r.t for r in df.collect()} == {label for _, label in N.RECORD_TIERS}
