"""Near-duplicate groups by SimHash fingerprints, compared exactly in tiles.

Distinct fingerprints are tiled by the population counts of their ``blocks`` bit blocks. Two fingerprints within ``radius``
bits differ by at most ``radius`` in the sum of those counts' differences, so every tile pair beyond that is skipped and no link
is lost. The remaining tile pairs are compared whole with numpy exclusive-or and bit counts, in pieces of bounded size. Each
comparison hands on a star per connected part, not all its pairs, so dense groups stay linear. Each pair of pieces is dealt by itself, so
a crowded tile is spread over many tasks.

``blocks`` sets how finely tiles are cut: with 4, about one pair in sixty is compared; with 8, one in 1,500, for 3.5 times the
tile pairs and some two hundred times the tiles. The result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, settled, stored
from .components import grouped, one_each
from .line_dedup import row_key

SEED = 42
#: Distinct fingerprints from which tiles are cut by eight blocks: by estimate, comparing then costs more than handling tiles.
MANY = 8_000_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles of an UTF-8 text, repeats included."""
    found = text.lower().split()  # on bytes, both know ASCII only
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, row (``row_key`` of the text), fingerprint (long) of every whole text; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                prints = [fingerprint(shingle_hashes(t, words)) if t else 0 for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(prints, pa.int64())], names=["doc_id", "row", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), row_key(F.col(text_col)), F.col(text_col).cast("binary")).mapInArrow(run, "doc_id long, row long, fingerprint long")


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star (fingerprint, smallest fingerprint) of each connected part between two tile pieces."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    near &= a[:, None] != b[None, :]
    rows, cols = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near, an, bn = near[np.ix_(rows, cols)], a[rows].view(np.int64), b[cols].view(np.int64)
    top = np.iinfo(np.int64).max
    la, lb = an, bn
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            return np.concatenate((an, bn)), np.concatenate((la, lb))
        la, lb = na, nb


def neighbours(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of two tile pieces with the nearest and the smallest one of the other piece, if within ``radius``: pairs to be checked."""
    a, b = np.sort(a), np.sort(b)
    apart = np.bitwise_count(a[:, None] ^ b[None, :])
    apart[a[:, None] == b[None, :]] = 65
    found = []
    for x, y, d in ((a, b, apart), (b, a, apart.T)):
        near = d <= radius
        some = near.any(axis=1)
        found += [(x[some], y[at[some]]) for at in (d.argmin(axis=1), near.argmax(axis=1))]
    u, v = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
    return u, v


def links(prints: DataFrame, radius: int = 2, blocks: int = 4, piece: int = 2048, pick: Callable = linked) -> DataFrame:
    """Edges (u, v) that connect the distinct values of ``prints`` (fingerprint) within ``radius`` bits; ``pick`` names those of two pieces."""
    bits = 64 // blocks
    field = (bits + 2 * radius).bit_length()
    if 64 % blocks or field * blocks > 62:
        raise ValueError("blocks must divide 64 and leave room for the counts")
    count = lambda k: F.bit_count(F.shiftrightunsigned("fingerprint", bits * k).bitwiseAND(F.lit((1 << bits) - 1))).cast("long")
    tile = sum((F.shiftleft(count(k) + F.lit(radius), field * k) for k in range(blocks)), F.lit(0).cast("long"))
    tiled = prints.select("fingerprint", tile.alias("tile"))
    sizes = settled(lambda: tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).withColumn("pieces", F.ceil(F.col("size") / piece)), "sizes")
    dealt = looked_up(tiled, "tile", sizes, "size", prints.count()).withColumn("sub", F.pmod(F.xxhash64("fingerprint"), F.col("pieces")))
    pieces = stored(dealt.groupBy("tile", "sub").agg(F.collect_list("fingerprint").alias("f")), "tiles")
    steps = [sum(d << (field * k) for k, d in enumerate(v)) for v in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, v)) <= radius] if blocks <= 8 else _steps(blocks, field, radius)
    ahead = F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(s for s in steps if s >= 0)]))
    # Which pieces meet is settled on their numbers alone; the fingerprints join last.
    meet = pieces.select(F.col("tile").alias("t1"), F.col("sub").alias("s1"), ahead.alias("step")).withColumn("tile", F.col("t1") + F.col("step")).join(sizes, "tile")
    meet = meet.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).filter((F.col("step") > 0) | (F.col("sub") >= F.col("s1")))
    first = pieces.select(F.col("tile").alias("t1"), F.col("sub").alias("s1"), F.col("f").alias("f1"))
    pairs = meet.select("t1", "s1", "tile", "sub").join(first, ["t1", "s1"]).join(pieces, ["tile", "sub"]).select("f1", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xo), (y, yo) = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in batch.columns]
            out = [pick(x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]], radius) for r in range(batch.num_rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in out])) for k in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long").filter("u <> v")


def _steps(blocks: int, field: int, radius: int) -> list[int]:
    """The same for many blocks: reach every difference one unit at a time."""
    at = {(0,) * blocks}
    for _ in range(radius):
        at |= {v[:k] + (v[k] + d,) + v[k + 1 :] for v in at for k in range(blocks) for d in (-1, 1)}
    return [sum(d << (field * k) for k, d in enumerate(v)) for v in at]


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, blocks: int | None) -> DataFrame:
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    prints = stored(rows.select("fingerprint").distinct(), "prints")
    return grouped(rows, "fingerprint", links(prints, radius, blocks or (4 if prints.count() < MANY else 8)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (the smallest id reachable over links of ``radius`` bits or less).

    Null and blank texts have fingerprint 0 and link like others. Repeated rows of one id each give a row, and are linked by their
    fingerprints only. Rows with a null id are linked too; component_id is null where a whole group has none. An empty table gives no rows;
    other columns are ignored. ``blocks`` changes the work, not the result.
    """
    return _grouped(docs, id_col, text_col, words, radius, blocks).select("doc_id", "fingerprint", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, blocks: int | None = None) -> DataFrame:
    """``docs`` with one row of each group, the one of smallest id (null after all others); all columns stay.

    Of several rows of that id in the group, the one whose text has the smallest hash stays, and of equal ones the first.
    """
    return one_each(docs, _grouped(docs, id_col, text_col, words, radius, blocks), id_col, "row", row_key(docs[text_col]))
