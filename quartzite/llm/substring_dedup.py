"""Removal of repeated word sequences by fixed-block anchors.

A window of ``window`` words always holds one whole block of ``window // 2 + 1`` words that starts at a multiple of that length. So blocks
of that length are indexed, and every rolling run of as many words is probed against them. A block that meets a probe elsewhere is an
anchor; only windows around anchors are extended and compared in full, by 64-bit hashes of all their words. Overlapping
repeated windows join to maximal repeats.

Texts are stored once, as compressed chunks of whole documents. What travels from a chunk is, per range of hash values, the sorted list
of its distinct hashes, written as differences; what comes back is one bit per entry. A hash that is found in every chunk is one
entry of each, so no passage, however common, grows into one task, and nothing is emitted per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK_BYTES, CHUNK_DOCS = 3 << 20, 4096
PER_BUCKET = 1_000_000  # hashes that meet in one task
B = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
B_INV = np.uint64(pow(int(B), -1, 1 << 64))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk, n_words, doc_ids, data: documents whose words (split at [\\x20\\x09-\\x0D]) are joined by a space, one a line, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, lines, size, count = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=1).compress(b"\n".join(lines))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([count]), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["chunk", "n_words", "doc_ids", "data"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    words = (t or b"").split()
                    line = b" ".join(words)
                    if ids and (size + len(line) > CHUNK_BYTES or len(ids) >= CHUNK_DOCS):
                        yield flush()
                        seq, ids, lines, size, count = seq + 1, [], [], 0, 0
                    ids.append(i)
                    lines.append(line)
                    size, count = size + len(line) + 1, count + len(words)
        if ids:
            yield flush()

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "chunk long, n_words long, doc_ids array<long>, data binary"), "chunks")


class Words:
    """The words of one chunk: ``hashes``, ``pos`` (in its document), ``left`` (words from here to the document's end)."""

    def __init__(self, data: bytes):
        self.docs = [line.split(b" ") if line else [] for line in zstandard.ZstdDecompressor().decompress(data).split(b"\n")]
        self.sizes = np.fromiter(map(len, self.docs), np.int64, len(self.docs))
        n = int(self.sizes.sum())
        h = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((h(w) for d in self.docs for w in d), np.uint64, n)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.pos = np.arange(n) - np.repeat(self.first, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.pos
        power, back = np.full(n + 1, B), np.full(n + 1, B_INV)
        power[:1], back[:1] = 1, 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * np.cumprod(power)[:n])))

    def rolling(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the ``length`` words from each position in ``at``."""
        x = (self.sums[at + length] - self.sums[at]) * self.back[at]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack(sorted_: np.ndarray, width: int) -> bytes:
    """Differences of a sorted array, byte plane by byte plane, compressed."""
    steps = np.diff(sorted_, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, n).T
    return np.cumsum(planes.view(np.uint64).reshape(-1))


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def mask(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


SENT = "bucket int, chunk long, n int, data binary, many binary, block binary"


def send(chunk: int, distinct: np.ndarray, many: np.ndarray, block: np.ndarray, width: int, buckets: int) -> Iterator[tuple]:
    """The rows of one chunk's sorted distinct hashes of ``width`` bytes, by the range of their upper 32 bits; ``many``: found again in the chunk; ``block``: indexed here."""
    if len(distinct) == 0:
        return
    # Only buckets that the chunk has hashes for, so the work is linear in its hashes however many buckets there are.
    of = ((distinct >> np.uint64(8 * width - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(distinct)])).tolist()
    for lo, hi in pairwise(cuts):
        yield int(of[lo]), chunk, hi - lo, pack(distinct[lo:hi], width), bits(many[lo:hi]), bits(block[lo:hi])


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SENT.split(", ")])


def replies(sent: DataFrame, width: int) -> DataFrame:
    """chunk, reply (in order of the buckets: n and one bit for each hash): set if the hash is indexed anywhere and found twice."""

    def meet(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_numpy()
        lists = [unpack(d, int(n), width) for d, n in zip(group.column("data").to_pylist(), sizes, strict=True)]
        flags = [np.concatenate([mask(d, int(n)) for d, n in zip(group.column(c).to_pylist(), sizes, strict=True)]) for c in ("many", "block")]
        values = np.concatenate(lists)
        order = np.argsort(values, kind="stable")
        found = values[order]
        head = np.concatenate(([True], found[1:] != found[:-1]))
        of = np.cumsum(head) - 1
        twice = (np.bincount(of) > 1) | np.bincount(of, weights=flags[0][order]).astype(bool)
        hit = np.empty(len(values), bool)
        hit[order] = (twice & np.bincount(of, weights=flags[1][order]).astype(bool))[of]
        ends = np.cumsum(sizes)
        return pa.table({"chunk": group.column("chunk").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "n": group.column("n").combine_chunks(), "hit": pa.array([bits(hit[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    met = sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, n int, hit binary")
    return met.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "hit"))).alias("reply"))


def answered(reply: list[dict] | None, n: int) -> np.ndarray:
    """The bits of a reply for the ``n`` distinct hashes of its chunk."""
    return np.concatenate([mask(r["hit"], r["n"]) for r in reply]) if reply else np.zeros(n, bool)


class Chunk:
    """What the three passes compute of one chunk."""

    def __init__(self, data: bytes, window: int):
        self.words, self.window, self.block = Words(data), window, window // 2 + 1
        w = self.words
        long = np.repeat(w.sizes >= window, w.sizes)
        self.at = np.flatnonzero(long & (w.left >= self.block))
        self.probes = w.rolling(self.at, self.block) >> np.uint64(24)
        self.distinct, self.inverse, counts = np.unique(self.probes, return_inverse=True, return_counts=True)
        self.many = counts > 1

    def blocks(self) -> np.ndarray:
        out = np.zeros(len(self.distinct), bool)
        out[self.inverse[self.words.pos[self.at] % self.block == 0]] = True
        return out

    def windows(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around anchors: positions, distinct hashes, index of each position's hash, whether found again here."""
        w = self.words
        anchor = np.zeros(len(w.hashes) + self.block, bool)
        anchor[self.at] = hits[self.inverse]
        at = np.flatnonzero(w.left >= self.window)
        at = at[anchor[at + (-w.pos[at]) % self.block]]
        distinct, inverse, counts = np.unique(w.rolling(at, self.window), return_inverse=True, return_counts=True)
        return at, distinct, inverse, counts > 1


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text, spans array<struct<start int, end int>>.

    A word is removed if a window of ``window`` consecutive words that covers it starts anywhere else too, in the same document or another.
    Spans are the maximal runs of such words, end exclusive. Null, blank and short texts have no window. Repeated rows of one id are
    copies of each other like any two documents. An empty table gives no rows; other columns are ignored.
    """
    table = chunks(docs, id_col, text_col)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    buckets = int(max(4, -(-total // PER_BUCKET)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.column(1)[i].as_py(), window)
                if rows := list(send(batch.column(0)[i].as_py(), c.distinct, c.many, c.blocks(), 5, buckets)):
                    yield sent_batch(rows)

    anchors = stored(replies(table.select("chunk", "data").mapInArrow(probe, SENT), 5), "anchors")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.column(1)[i].as_py(), window)
                _, distinct, _, many = c.windows(answered(batch.column(2)[i].as_py(), len(c.distinct)))
                if rows := list(send(batch.column(0)[i].as_py(), distinct, many, np.ones(len(distinct), bool), 8, buckets)):
                    yield sent_batch(rows)

    with_anchors = table.join(anchors, "chunk", "left")
    found = replies(with_anchors.select("chunk", "data", "reply").mapInArrow(extend, SENT), 8).withColumnRenamed("reply", "again")
    both = anchors.join(found, "chunk", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.column(1)[i].as_py(), window)
                w = c.words
                at, distinct, inverse, _ = c.windows(answered(batch.column(2)[i].as_py(), len(c.distinct)))
                starts = at[answered(batch.column(3)[i].as_py(), len(distinct))[inverse]]
                edge = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                texts, spans, removed = [], [], []
                for d, first in zip(w.docs, w.first.tolist(), strict=True):
                    g = gone[first : first + len(d)]
                    removed.append(int(g.sum()))
                    texts.append(b" ".join(d) if not removed[-1] else b" ".join([x for x, y in zip(d, g.tolist(), strict=True) if not y]))
                    turns = np.flatnonzero(np.diff(g, prepend=False, append=False)).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(0)[i].as_py(), pa.int64()), pa.array(w.sizes), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
                )

    whole = table.join(both, "chunk", "left").select("doc_ids", "data", "reply", "again")
    return whole.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: int, end: int>>")

