"""The stateless cleaning columns on streams, and issue counts per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clean_value, issue_matrix


def standardized(stream: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Every column standardized by its roles; works on batches and on streams, without state."""
    return stream.select(*[clean_value(stream, roles, c).alias(c) for c in stream.columns])


def issue_rate(stream: DataFrame, roles: dict[str, str], time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per window of event time: rows, and rows with an issue. Rows later than ``delay`` are dropped, so state stays bounded."""
    flagged = issue_matrix(stream.withWatermark(time, delay), roles)
    out = flagged.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_has_issue").cast("long")).alias("with_issue"))
    return out.select(F.col("window.start").alias("start"), "n", "with_issue")
