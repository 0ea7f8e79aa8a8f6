"""Token counts by whole tokens: most pieces of a text are one token, which is known without merging.

Offline, every string of the vocabulary is encoded alone; those that give exactly one token are the whole tokens (:func:`whole_tokens`). A text is
cut at each space that a visible character follows, which is always a border of the pre-tokenizer; the chunks are split into pre-tokens,
a pre-token that is a whole token counts one, and only the rest is merged. The counts of short chunks are remembered, at most
``REMEMBERED`` and those of a batch in each of two generations.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Encoder, default_path

#: Chunks of a generation, characters of a chunk that is remembered, texts that are counted together.
REMEMBERED, SHORT, TEXTS = 300_000, 48, 256
#: The characters of the pre-tokenizer's ``\\s``: those with the Unicode property White_Space.
WHITE = "\t\n\x0b\f\r \x85\xa0                　"


def _ranges(kinds: set[str]) -> str:
    """A regular expression's class body of all characters of some Unicode categories, without those of the surrogates."""
    of = np.fromiter((unicodedata.category(chr(c)) in kinds for c in range(0x110000)), dtype=np.int8, count=0x110000)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], of, [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2).tolist())


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    r"""The byte-level pre-tokenizer's pattern, and characters that Python's tables lack, so that they may be letters elsewhere.

    ``\p{N}`` is \d with the other numerals, and ``\p{L}`` what is left of \w without them.
    """
    numerals, white = _ranges({"Nl", "No"}), re.escape(WHITE)
    letter, number, other = rf"[^\W\d_{numerals}]", rf"[\d{numerals}]", rf"(?:[^\w{white}{numerals}]|_)"
    pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{white}]+(?![^{white}])|[{white}]+")
    return pieces, re.compile(rf"[{_ranges({'Cn'})}]")


def whole_tokens(encoder: Encoder) -> frozenset[str]:
    """The proof: strings of the vocabulary that, as a pre-token of their own, the library encodes as one token."""
    vocab = encoder.slow.get_vocab(with_added_tokens=False)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    texts = []
    for token in vocab:
        try:
            texts.append(bytes(byte[c] for c in token).decode())
        except (UnicodeDecodeError, KeyError):
            continue  # parts of characters, which no pre-token consists of
    found = encoder.slow.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, x in zip(texts, found, strict=True) if len(x.ids) == 1)


class Counter:
    """Token counts of texts. Those of short chunks are remembered in two generations: when the young one is full it becomes the old one."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.whole = encoder, whole_tokens(encoder)
        self.pieces, self.unknown = patterns()
        self.split = re.compile(rf" (?=[^{re.escape(WHITE)}])").split
        self.doubled = re.compile(rf" [{re.escape(WHITE)}]| \Z").search
        self.border = encoder.ids("\n")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def encoded(self, text: str) -> int:
        """Tokens of a text by the library."""
        return len(self.encoder.slow.encode(text, add_special_tokens=False).ids)

    def merged(self, pieces: list[str]) -> list[int]:
        """Tokens of pre-tokens without white space but a space before them: merged in one call, with line ends as borders between them."""
        ids = self.encoder.ids("\n".join([*pieces, ""]))
        return np.diff(np.flatnonzero(ids == self.border), prepend=-1).__sub__(1).tolist()

    def counted(self, chunks: Collection[str]) -> list[int]:
        """Tokens of each chunk: whole tokens count one, the other pre-tokens of all chunks are merged together."""
        whole, of, rest, found = self.whole, [], [], []
        for k, chunk in enumerate(chunks):
            n = 0
            if chunk in whole:
                n = 1
            elif not "".join(chunk.split()).isprintable() and self.unknown.search(chunk):
                n = self.encoded(chunk)
            else:
                for piece in self.pieces.findall(chunk):
                    if piece in whole:
                        n += 1
                    elif piece.isspace() or "\n" in piece:
                        n += len(self.encoder.ids(piece))
                    else:
                        of.append(k)
                        rest.append(piece)
            found.append(n)
        for k, n in zip(of, self.merged(rest) if rest else (), strict=True):
            found[k] += n
        return found

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of whole texts."""
        special = [any(a in text for a in self.encoder.added) for text in texts]
        parts = [[] if own else self.split(text) if self.doubled(text) else text.split(" ") for text, own in zip(texts, special, strict=True)]
        known = self.young
        need = set().union(*[p[1:] for p in parts]).difference(known)
        known.update((c, self.old[c]) for c in need & self.old.keys())
        need = [c for c in need if c not in known]
        known.update(zip(need, self.counted([" " + c for c in need]), strict=True))
        firsts = self.counted([p[0] if p else "" for p in parts])
        out = [self.encoded(text) if own else first + sum(map(known.__getitem__, p[1:])) for text, own, first, p in zip(texts, special, firsts, parts, strict=True)]
        for c in need:
            if len(c) > SHORT:
                del known[c]
        if len(known) >= REMEMBERED:
            self.old, self.young = known, {}
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter | None:
    """None for a tokenizer that is not plain byte-level BPE: its texts are encoded whole."""
    if not path.endswith(".json"):
        return None
    encoder = Encoder(path)
    return Counter(encoder) if encoder.fast is not None else None


@lru_cache(maxsize=2)
def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = spec["padding"] = None
    model = Tokenizer.from_str(json.dumps(spec))
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), as the library of the file gives them:
    without begin, end or added special tokens; strings of special tokens in a text are those tokens, the library's default.

    ``path`` is a .json file of ``tokenizers`` or a .model of ``sentencepiece``; the whole-token shortcut is for byte-level BPE, texts of other
    files are encoded whole. A null or empty text has no tokens; repeated rows and null ids are counted each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or default_path()
        shortcut = counter(file)
        count = shortcut.count if shortcut is not None else _library(file)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(lo, TEXTS)
                n = count([t or "" for t in piece.column(1).to_pylist()])
                size = pc.fill_null(pc.binary_length(piece.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
