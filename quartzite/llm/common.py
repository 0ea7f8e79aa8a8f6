"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id, which comes after all others.
LAST_ID = 2**63 - 1
#: A key with fewer rows is never hot.
HOT_ROWS, HOT_KEYS = 100_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        root = f"file://{tempfile.mkdtemp(dir='/tmp/checkpoints')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class _Building(threading.local):
    """Folders stored while a :func:`settled` result is built, innermost last; each thread has its own, so queries at the same time keep apart."""

    def __init__(self):
        self.folders: list[list[str]] = []


_building = _Building()


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at files that survive lost executors.

    The files go with the :func:`settled` result that is being built, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    if _building.folders:
        _building.folders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``build()``, stored; all that was stored while it was built is deleted."""
    mine: list[str] = []
    _building.folders.append(mine)
    try:
        out = stored(build(), name)
    finally:
        _building.folders.pop()
    path = mine.pop()
    for p in mine:
        discard(out.sparkSession, p)
    if _building.folders:
        _building.folders[-1].append(path)
    return out


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of ``frames`` has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def looked_up(rows: DataFrame, key: str, found: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``found`` (one row per ``key``, with the number ``size`` of its rows) on ``key``, however many rows a key has.

    Keys of over a thousandth of the ``total`` rows, at most a thousand of them, are sent to every task; the rest are shuffled.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    cold = found.filter(F.col(size) <= least).drop(size)
    if total <= least:
        return rows.join(cold, key)
    hot = F.broadcast(found.filter(F.col(size) > least).drop(size))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed split into training and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
