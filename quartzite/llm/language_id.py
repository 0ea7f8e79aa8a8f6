"""Language identification by error-correcting output codes.

Every language gets a binary codeword. One linear classifier per bit reads hashed byte n-grams of the whole text and predicts
that bit. Decoding sums, over the bits, the loss of a codeword's bit under the predicted margin, weighted by how reliable the bit
was in training; the language of least loss wins. A small lead over the second best marks a text as ambiguous. Two or three
languages have too few distinct bits to correct an error, so there each bit is learned four times: from all n-grams and from those of
each length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
SIZES = (256, 1024, 2048)  # of the tables for 1-, 2- and 3-grams
_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def features(text: str | None) -> np.ndarray:
    """Square roots of the n-gram shares of a lower-cased text's letters; runs of anything else count as one space."""
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE) + b" ", np.uint8)
    raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))].astype(np.uint32)
    out = []
    for n, size in enumerate(SIZES, 1):
        code = raw[: len(raw) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(0x01000193) + raw[k : len(raw) - n + 1 + k]
        code = code if n == 1 else (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (size - 1).bit_length())
        out.append(np.bincount(code, minlength=size) / max(1, len(code)))
    return np.sqrt(np.concatenate(out)).astype(np.float32)


def codewords(k: int, tries: int = 500) -> np.ndarray:
    """k codewords of -1 and 1: for up to five languages all distinct splits, else the draw of largest least distance."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(bits)] for i in range(k)])
    length, best, rng = max(15, int(np.ceil(10 * np.log2(k)))), None, np.random.default_rng(0)
    for _ in range(tries):
        c = rng.choice((-1, 1), (k, length))
        d = (length - c @ c.T) / 2 + np.eye(k) * length
        if best is None or d.min() > best[0]:
            best = (d.min(), c)
    return best[1]


def views(k: int) -> list[np.ndarray]:
    """Feature columns that the copies of each bit are learned from; the last column is the intercept."""
    ends = np.cumsum((0, *SIZES))
    own = [np.append(np.arange(a, b), ends[-1]) for a, b in zip(ends, ends[1:], strict=False)]
    return [np.arange(ends[-1] + 1), *(own if k <= 3 else [])]


def fit(labelled: DataFrame, max_docs: int = 4_000, ridge: float = 0.02, least: int = 20) -> dict:
    """The model from rows (doc_id, text, lang): at most ``max_docs`` ids, an equal quota for each language (``least`` ids at least), by id hash.

    Every language that occurs is learned. Null languages and texts without a letter are left out; of several texts of one id and
    language the first in their order is read. Without rows every text is ``und``.
    """
    rows = labelled.filter("lang is not null and doc_id is not null").select("doc_id", "lang")
    counts = rows.groupBy("lang").count()
    n_langs = counts.count()
    quota = max(least, max_docs // max(1, n_langs))
    # What each language's share of the table would give of its quota, times 1.2 and 20 more; of these the smallest hashes.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(F.broadcast(counts) if n_langs <= 10_000 else counts, "lang").filter(place * F.col("count") < 1.2 * quota + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id"))
    picked = near.distinct().withColumn("rank", rank).filter(F.col("rank") <= quota).select("doc_id", "lang")
    texts = labelled.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(a, features(t).tobytes()) for a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.binary())], names=["lang", "x"])

    found = picked.mapInArrow(measure, "lang string, x binary").collect()
    if not found:
        return {"langs": []}
    one = np.ones((len(found), sum(SIZES) + 1), np.float32)
    for i, r in enumerate(found):
        one[i, :-1] = np.frombuffer(r.x, np.float32)
    langs = sorted({r.lang for r in found})
    at = np.array([langs.index(r.lang) for r in found])
    del found  # the driver holds one copy of the features at a time
    parts = views(len(langs))
    code = np.tile(codewords(len(langs)), (1, len(parts)))
    y = code[at].astype(np.float32)
    # A row counts by the inverse of its language's size, so that frequent languages don't outvote rare ones.
    weight = np.sqrt(len(at) / len(langs) / np.bincount(at)[at]).astype(np.float32)[:, None]
    one *= weight
    gram = (one.T @ one).astype(np.float64)
    gram[np.diag_indices_from(gram)] += ridge * len(one) / 100
    right = (one.T @ (y * weight)).astype(np.float64)
    w, n = np.zeros(right.shape, np.float32), code.shape[1] // len(parts)
    for i, cols in enumerate(parts):
        w[cols, i * n : (i + 1) * n] = np.linalg.solve(gram[np.ix_(cols, cols)], right[cols, i * n : (i + 1) * n])
    one /= weight
    margin = np.clip(one @ w, -2, 2)
    wrong = np.clip((np.sign(margin) != y).mean(axis=0), 1e-3, 0.49)
    return {"langs": langs, "code": code, "w": w, "bits": np.log((1 - wrong) / wrong)}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, lead over the second) by weighted logistic loss."""
    bits, code = model["bits"] / model["bits"].sum(), model["code"]
    loss = np.stack([(np.logaddexp(0, -4.0 * margins * c) * bits).sum(axis=1) for c in code], axis=1)
    p = np.exp(-3.0 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    top = np.sort(p, axis=1)
    return loss.argmin(axis=1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous, of every whole text.

    Null texts and texts without a letter are ``und`` with score 1. Repeated rows each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model["langs"], "und"], dtype=object)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                best, p, lead = np.full(len(texts), len(langs) - 1), np.ones(len(texts)), np.ones(len(texts))
                some = np.array([has_letter(t) for t in texts], dtype=bool)
                if some.any() and len(langs) > 1:
                    x = np.stack([features(t) for t, s in zip(texts, some, strict=True) if s])
                    best[some], p[some], lead[some] = decode(np.clip(x @ model["w"][:-1] + model["w"][-1], -2, 2), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(p), pa.array(lead < margin)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
