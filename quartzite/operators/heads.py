"""The first K known values of every column, in the order of the row id, from one job.

Each task keeps the K smallest row ids of each column with their values, so it sends K values a column at most; the tasks' heads are cut to K.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from .profile import c_, numeric_columns

# Columns that hold dates, serial numbers of days included, and what share of a head must be such numbers.
KNOWN_DATES = ("open_date", "closed_date", "Fraud.Opened Date", "Fraud.Date Fraud Found")
SERIAL, SHARE, HEAD = (20_000, 60_000), 0.8, 200


def first_values(df: DataFrame, k: int, cols: Sequence[str] | None = None, rid: str = "rid") -> DataFrame:
    """feature, place (from 1), rid, value (as text) of the first ``k`` non-null values of each column by ``rid``, an integral column without
    repeats. Rows without ``rid`` come last, as none; columns without values have no rows.
    """
    cols = [c for c in cols or df.columns if c != rid]
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.array([], np.int64), pa.array([], pa.string())) for _ in cols]
        for batch in batches:
            ids = batch.column(0).fill_null(last).to_numpy()
            for i in range(len(cols)):
                at, texts = held[i]
                column = batch.column(i + 1)
                known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if len(at) == k:  # only what comes before the last of a full head
                    known = known[ids[known] < at[-1]]
                if not len(known):
                    continue
                both = np.concatenate([at, ids[known]])
                first = np.argsort(both, kind="stable")[:k]
                held[i] = (both[first], pa.concat_arrays([texts, column.take(pa.array(known))]).take(pa.array(first)))
        for name, (at, texts) in zip(cols, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), texts], names=["feature", "rid", "value"])

    rows = df.select(F.col(f"`{rid}`").cast("long").alias("r"), *[c_(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    heads = rows.mapInArrow(run, "feature string, rid long, value string")
    order = Window.partitionBy("feature").orderBy("rid")
    return heads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("feature", "place", F.when(F.col("rid") < last, F.col("rid")).alias("rid"), "value")


def serial_in_head(df: DataFrame, cols: Sequence[str] = KNOWN_DATES, rid: str = "rid", head: int = HEAD) -> list[str]:
    """The columns of numbers among ``cols`` of whose first values more than SHARE are serial numbers of days."""
    cols = [c for c in cols if c in numeric_columns(df)]
    if not cols:
        return []
    v = F.col("value").cast("double")
    found = first_values(df, head, cols, rid).groupBy("feature").agg(F.avg(v.between(*SERIAL).cast("int")).alias("share"))
    serial = {r.feature for r in found.filter(F.col("share") > SHARE).collect()}  # a row per column
    return [c for c in cols if c in serial]


def known_dates(df: DataFrame, cols: Sequence[str] = KNOWN_DATES, rid: str = "rid") -> DataFrame:
    """``df`` with its known date columns as dates where their heads are serial numbers: the load's way without types."""
    return df.withColumns({c: D.from_excel_serial(c_(c)) for c in serial_in_head(df, cols, rid)})
