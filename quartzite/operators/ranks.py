"""Exact quantiles and running totals over sorted values, spread over value ranges of each key.

A key with many rows has its values cut into ranges of about ``PER_RANGE`` rows by a sketch of its own, so that keys of different scales don't
share ranges and no task holds a whole column. The cuts decide where the work is done, not the result.

* :func:`quantiles` is a selection: rows are counted per range without a shuffle of values, the ranges that hold the wanted positions follow
  from the counts, and only the values in these are counted and sorted.
* :func:`running` needs all distinct values; totals within a range are added up by the totals of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about, and ranges of a key at most; cuts of all keys that go into one expression.
PER_RANGE, RANGES = 1_000_000, 2048
MOST_CASES = 2_000


def cuts_of(rows: DataFrame, keys: Sequence[str], value: str, per_range: int = PER_RANGE) -> list[Row]:
    """``keys``, cuts of the keys with more than ``per_range`` rows, one job: the ranges' upper ends but the last, sorted.

    All cuts together are no more than the rows divided by ``per_range``. Large ranges are cut by a sketch of a share of the rows.
    """
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    v = F.col(value).cast("double")
    share = min(1.0, 50_000 / per_range)
    some = rows.select(*keys, v.alias("_v"), (F.when(F.rand(7) < share, v) if share < 1 else v).alias("_some"))
    sketched = some.groupBy(*keys).agg(F.count("_v").alias("rows"), F.kll_sketch_agg_double("_some", 4000).alias("sketch")).filter(F.col("rows") > per_range)
    steps = F.least(F.lit(RANGES), F.ceil(F.col("rows") / per_range)).cast("int")
    step_of = lambda i: F.floor(i * steps / RANGES)
    at = F.filter(F.kll_sketch_get_quantile_double("sketch", probs), lambda x, i: (step_of(i + 1) > step_of(i)) & (F.abs(x) < float("inf")))
    return sketched.select(*keys, F.array_sort(F.array_distinct(at)).alias("cuts")).filter(F.size("cuts") > 0).collect()


def _halved(v: str, cuts: Sequence[float], first: int) -> str:
    if not cuts:
        return str(first)
    m = len(cuts) // 2
    return f"CASE WHEN {v} <= {cuts[m]!r}D THEN {_halved(v, cuts[:m], first)} ELSE {_halved(v, cuts[m + 1 :], first + m + 1)} END"


def with_range(df: DataFrame, keys: Sequence[str], value: str, cuts: Sequence[Row]) -> DataFrame:
    """``df`` with range, the number of its key's cuts below the value; 0 for keys without cuts.

    Up to MOST_CASES cuts are one generated expression that halves them; more would be too much code, and are searched by numpy in batches.
    """
    if not cuts:
        return df.withColumn("range", F.lit(0))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_key", T.IntegerType())])
    numbers = F.broadcast(df.sparkSession.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(cuts)], schema))  # bounded: see cuts_of
    keyed = df.join(numbers, list(keys), "left").select(*df.columns, "_key")
    if sum(len(r.cuts) for r in cuts) <= MOST_CASES:
        found = " ".join(f"WHEN {i} THEN {_halved(f'`{value}`', r.cuts, 0)}" for i, r in enumerate(cuts))
        return keyed.withColumn("range", F.expr(f"CASE _key {found} ELSE 0 END")).drop("_key")
    ends = [np.array(r.cuts, dtype=np.float64) for r in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.num_columns - 1).fill_null(-1).to_numpy()
            v = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            found, bounds = np.zeros(len(key), dtype=np.int32), np.searchsorted(key[order], np.arange(len(ends) + 1))
            for k in np.unique(key[key >= 0]):
                rows = order[bounds[k] : bounds[k + 1]]
                found[rows] = np.searchsorted(ends[k], v[rows], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "range"])

    return keyed.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType())]))


def running(counted: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], per_range: int = PER_RANGE) -> DataFrame:
    """``counted`` (``keys``, ``value``; distinct) with ``<s>_upto`` and ``<s>_total``: each sum over the key's values up to this one, and over all.

    ``rows`` has the values that ``counted`` was made from; a sketch of all of them sets the ranges, not the result.
    """
    ranged = with_range(counted, keys, value, cuts_of(rows, keys, value, per_range))
    per_range_ = ranged.groupBy(*keys, "range").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a key at most
    base = per_range_.select(*keys, "range", *[x for s in sums for x in (F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before"), F.sum(s).over(Window.partitionBy(*keys)).alias(f"{s}_total"))])
    own = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({f"{s}_upto": F.sum(s).over(own) for s in sums}).join(base, [*keys, "range"])
    return out.withColumns({f"{s}_upto": F.col(f"{s}_upto") + F.col(f"{s}_before") for s in sums}).drop("range", *[f"{s}_before" for s in sums])


def _ends(n: int, probs: Sequence[float]) -> list[int]:
    """The places, from 0, between which the quantiles of ``n`` values lie."""
    return [k for p in probs for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]


def _selected(ranged: DataFrame, keys: Sequence[str], cuts: Sequence[Row], weight: Column, probs: Sequence[float]) -> DataFrame:
    """Rows of keys without cuts, and those rows of the others whose range holds a wanted place; with the key's number of values in all and
    those before the range (null for keys without cuts)."""
    names = [tuple(r[k] for k in keys) for r in cuts]
    schema = T.StructType([*[ranged.schema[k] for k in keys], T.StructField("large", T.BooleanType())])
    large = F.broadcast(ranged.sparkSession.createDataFrame([(*k, True) for k in names], schema))
    counts: dict[tuple, dict[int, int]] = {k: {} for k in names}
    for r in ranged.join(large, list(keys)).groupBy(*keys, "range").agg(F.sum(weight).alias("_times")).collect():  # a row per range
        counts[tuple(r[k] for k in keys)][r["range"]] = r["_times"]
    wanted = []
    for key, own in counts.items():
        n, at = sum(own.values()), 0
        places = _ends(n, probs)
        for i in sorted(own):
            if any(at <= p < at + own[i] for p in places):
                wanted.append((*key, i, n, at))
            at += own[i]
    schema = T.StructType([*[ranged.schema[k] for k in keys], T.StructField("range", T.IntegerType()), T.StructField("n_all", T.LongType()), T.StructField("before", T.LongType())])
    found = F.broadcast(ranged.sparkSession.createDataFrame(wanted, schema))
    return ranged.join(large, list(keys), "left").join(found, [*keys, "range"], "left").filter("large is null or n_all is not null").drop("large")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], times: str | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """``keys``, n, q: exact quantiles of ``value`` by linear interpolation, nulls left out. A row stands for as many as ``times`` says."""
    known = rows.filter(F.col(value).isNotNull())
    weight = F.col(times) if times else F.lit(1)
    cuts = cuts_of(known, keys, value, per_range)
    ranged = with_range(known, keys, value, cuts)
    if cuts:
        some = _selected(ranged, keys, cuts, weight, probs)
    else:
        some = ranged.withColumns({"n_all": F.lit(None).cast("long"), "before": F.lit(None).cast("long")})
    counted = some.groupBy(*keys, "range", "n_all", "before", value).agg(F.sum(weight).alias("_times"))
    own = Window.partitionBy(*keys, "range")
    upto = F.sum("_times").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce("before", F.lit(0))
    placed = counted.withColumns({"_upto": upto, "n": F.coalesce("n_all", F.sum("_times").over(own))})
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    # The value at a place is the least whose running total is above it; values before a wanted range are not there to be mistaken for it.
    first = lambda place: F.min(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_times") <= place), F.col(value)))
    ends = [x for i, a in enumerate(at) for x in (first(F.floor(a)).alias(f"lo{i}"), first(F.ceil(a)).alias(f"hi{i}"))]
    out = placed.groupBy(*keys, "n").agg(*ends)
    between = lambda i, a: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((F.ceil(a) - a) * F.col(f"lo{i}") + (a - F.floor(a)) * F.col(f"hi{i}"))
    return out.select(*keys, "n", F.array(*[between(i, a) for i, a in enumerate(at)]).alias("q"))


def long_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """feature, v: a row per column and row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), v.cast("double").alias("v")) for c, v in values.items()])).alias("x")).select("x.*")
