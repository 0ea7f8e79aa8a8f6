"""Packing token streams into fixed windows: concatenate and cut.

Pass 1 tokenises every document once, each with its end token, and stores the ids with a running start inside the input
partition. The partitions' token totals, one number each, are summed up in partition order on the driver: the sum before a
partition is its global offset. Pass 2 adds it to each document's start and cuts the stream at multiples of the window size.
Nothing is shuffled. A window that crosses documents or partitions is described by its pieces, the boundary records;
:func:`sequences` puts windows together, at most ``size`` pieces each.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SIZE, END = 1024, 0


class Encoder:
    """Ids of a byte-level BPE file as ``tokenizers`` gives them (add_special_tokens=False).

    The file's vocabulary and merges run in ``tiktoken``, several times faster and with the same ids where merges are ranked by id
    and the pre-tokenizer is the plain byte-level one. A text that holds the string of an added token goes through ``tokenizers``, and so
    does one that ``tiktoken`` refuses: its pattern engine fails on runs of some hundred thousand blanks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.slow.get_vocab_size() <= 1 << 16 else "<u4")
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        ranked = [model["vocab"].get(m.replace(" ", "")) for m in merges]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type", "BPE") == "BPE" and plain and spec.get("normalizer") is None and None not in ranked and all(a < b for a, b in pairwise(ranked)):
            self.fast = self._tiktoken(model["vocab"], set(self.added))

    @staticmethod
    def _tiktoken(vocab: dict[str, int], added: set[str]):
        import tiktoken

        # Byte-level vocabularies write byte b as the character b if that is printable, else as the next free one from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
        except ValueError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


TOKENS = "part int, doc_id long, local_start long, n long, width int, ids binary"


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END) -> DataFrame:
    """Pass 1, stored: part, doc_id, local_start (ids before it in the partition), n (with the end token), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path or default_path()), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                ids = [enc.ids(t).tobytes() + end if t else end for t in piece.column(1).to_pylist()]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), piece.column(0), pa.array(starts), pa.array(n), pa.array(np.full(k, enc.dtype.itemsize, np.int32)), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "local_start", "n", "width", "ids"],
                )

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, TOKENS), "tokens")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``with_ids``).

    Null and empty texts are one end token. Repeated rows of one id are packed each. Every window is full but the last.
    An empty table gives no rows; other columns are ignored. Documents follow the order of the input's partitions.
    """
    tokens = tokenised(docs, id_col, text_col, path, end_id)
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("t")).orderBy("part").collect()  # a number per input partition
    offsets = dict(zip([r.part for r in totals], np.cumsum([0] + [r.t for r in totals]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, doc, local, n, width, blobs = batch.slice(lo, 512).columns
                n, begin = n.to_numpy(), local.to_numpy() + np.array([offsets[p] for p in part.to_pylist()], dtype=np.int64)
                first = begin // size
                pieces = (begin + n - 1) // size - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lo_, hi = np.maximum(seq * size, begin[row]), np.minimum((seq + 1) * size, (begin + n)[row])
                start, length = lo_ - begin[row], hi - lo_
                wide = [np.frombuffer(b, dtype=f"<u{w}").astype("<u4") for b, w in zip(blobs.to_pylist(), width.to_pylist(), strict=True)]
                raw = [wide[r][s : s + k] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                out = [doc.take(pa.array(row)), start, length, np.array([zlib.crc32(x) for x in raw], dtype=np.int64), n[row], seq, lo_ - seq * size]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in out]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32).tolist() for x in raw], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return tokens.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = END) -> DataFrame:
    """sequence_id, n_tokens, ids: the windows put together from :func:`pack` with ids, padded to ``size`` unless n_tokens is a power of two."""
    whole = pieces.filter(F.col("length") == size).select("sequence_id", F.col("length").alias("n_tokens"), "ids")
    parts = (
        pieces.filter(F.col("length") < size)
        .groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        .select("sequence_id", "n_tokens", F.flatten(F.col("p.ids")).alias("ids"))
    )
    gap = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(size - F.col("n_tokens")).cast("int")
    return whole.unionByName(parts).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), gap)))
