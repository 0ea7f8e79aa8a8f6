"""The date format of text columns by elimination.

Each distinct value gets a bit mask of the formats that it fits; the masks of a column are combined by ``bit_and``, which leaves the formats that
fit all of its values. So month first and day first are told apart by the values above 12, wherever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from .profile import c_, text_columns, value_counts

# Name, shape and pattern of each format; of those that fit all values the first is taken, month first before day first.
FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("yyyy/MM/dd", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("yyyyMMdd", r"^(19|20)\d{6}$", "yyyyMMdd"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    ("yyyy-MM-ddTHH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("dd/MM/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("MM-dd-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    ("dd-MM-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    ("dd.MM.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ("dd-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    ("dd MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    ("MMM dd yyyy", r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    ("MMM dd, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)
#: Pairs that only values above 12 tell apart.
ORDERS = (("MM/dd/yyyy", "dd/MM/yyyy"), ("MM-dd-yyyy", "dd-MM-yyyy"))


def read_as(value: Column, shape: str, pattern: str) -> Column:
    """The day and time that a trimmed text is in a format, or null."""
    return F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)))


def fitting(value: Column) -> Column:
    """Bit i is set if the text is a date in the i-th format."""
    bits = [F.when(read_as(value, shape, pattern).isNotNull(), 1 << i).otherwise(0).cast("long") for i, (_, shape, pattern) in enumerate(FORMATS)]
    return sum(bits[1:], bits[0])


def date_formats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n, formats, format, ambiguous of text columns: the formats that all values fit, the one taken (null if none), and whether month
    and day could be either way round. Nulls and blanks are left out; a column without values has no format.

    Only (column, distinct value) pairs are shuffled, and each distinct value is parsed once.
    """
    cols = list(cols or text_columns(df))
    values = value_counts(df, cols).withColumn("value", S.strip(F.col("value"))).filter("value <> ''").withColumn("mask", fitting(F.col("value")))
    found = values.groupBy("feature").agg(F.sum("n").alias("n"), F.bit_and("mask").alias("mask"))
    fixed = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    out = fixed.join(F.broadcast(found), "feature", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))  # a row per column
    left = F.filter(F.array(*[F.when(F.getbit("mask", F.lit(i)) == 1, name) for i, (name, _, _) in enumerate(FORMATS)]), lambda f: f.isNotNull())
    out = out.withColumn("formats", left)
    both = F.lit(False)
    for pair in ORDERS:
        both = both | (F.array_contains("formats", pair[0]) & F.array_contains("formats", pair[1]))
    return out.select("feature", F.coalesce("n", F.lit(0)).alias("n"), "formats", F.get("formats", F.lit(0)).alias("format"), both.alias("ambiguous"))


def parsed(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """``df`` with the text columns of ``formats`` (column to format name) as dates; values that don't fit are null."""
    known = {name: (shape, pattern) for name, shape, pattern in FORMATS}
    return df.withColumns({c: read_as(S.strip(c_(c)), *known[f]).cast("date") for c, f in formats.items()})


def with_dates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df`` with every text column that has a common format as dates."""
    return parsed(df, {r.feature: r.format for r in date_formats(df, cols).collect() if r.format})
