"""Reading and writing tables."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .xlsx import read_xlsx, write_xlsx

# Texts that a CSV scan reads as null.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one thing to the operators."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`") for c, k in kinds.items()])


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """``_rid``, which stands for the physical order: a declared key, else an increasing id in scan order."""
    return df.withColumn("_rid", F.col(key).cast("long") if key else F.monotonically_increasing_id())


def breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line of the files has an odd number of quotes, so that a value may go on in the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Header row, types inferred over the whole file, the usual NA texts as null.

    Where values hold line breaks a file is one task's, else it is read in splits. Unless ``multi_line`` says which, a scan decides: a
    value with a line break leaves lines with an odd number of quotes. A ``schema`` saves the inferring scan; what doesn't fit it is null.
    """
    if multi_line is None:
        multi_line = breaks_lines(spark, path)
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if schema is not None:
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    shape = [F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(p)), F.lit(False)) for c in df.columns for p in (r"^[+-]?\d{1,18}$", number, r"^(?i:true|false)$")]
    seen = df.agg(*[s.alias(str(i)) for i, s in enumerate(shape)]).first()
    out = []
    for i, c in enumerate(df.columns):
        whole, real, flag = seen[3 * i : 3 * i + 3]
        kind = "bigint" if whole else "double" if real else "boolean" if flag else "string"
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return df.select(*out)


def read_excel(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A sheet of one or more .xlsx files, the first by default; the usual NA texts are null. See :func:`quartzite.sources.xlsx.read_xlsx`."""
    return read_xlsx(spark, path, sheet, NA_TOKENS)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, default: str | None = None) -> DataFrame:
    """By extension: csv, xls and xlsx, json, orc, else parquet. Without a path the ``default`` is read."""
    path = path or default
    if not path:
        raise ValueError("no path and no default")
    fmt = fmt or os.path.splitext(path)[1].lower().lstrip(".")
    if fmt in ("xls", "xlsx"):
        return nan_to_null(read_excel(spark, path))
    if fmt == "csv":
        return read_csv(spark, path)
    return nan_to_null(spark.read.format(fmt if fmt in ("json", "orc") else "parquet").load(path))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; quotes inside a value are doubled, as :func:`read_csv` reads them."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_excel(df: DataFrame, path: str, sheet: str = "Cleaned_Data", max_rows: int = 1_000_000) -> None:
    """One file with one sheet; refuses what no sheet holds. See :func:`quartzite.sources.xlsx.write_xlsx`."""
    write_xlsx(df, path, sheet, max_rows)


def display_columns(df: DataFrame) -> DataFrame:
    """Without helper columns, those that start with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def plain(value):
    """Results as JSON values: NaN and infinities are null, tables are lists of rows."""
    if isinstance(value, DataFrame):
        return [plain(r.asDict(recursive=True)) for r in value.collect()]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def export_results(results: dict, path: str, fmt: str = "json") -> None:
    """Small results to a file, as json or pickle."""
    if fmt == "json":
        with open(path, "w", encoding="utf-8") as f:
            json.dump(plain(results), f, indent=2)
    elif fmt == "pickle":
        import pickle

        with open(path, "wb") as f:
            pickle.dump(plain(results), f)
    else:
        raise ValueError("fmt must be json or pickle")
