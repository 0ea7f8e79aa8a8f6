"""Token counts against the libraries themselves."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quartzite.llm import queries, token_counts
from quartzite.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, texts):
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


EDGES = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n", "\n\n a", "don't 'll '' 'st", "x y 　z  ", "a\x1cb \x1f c", "<|endoftext|>", "a <|endoftext|> b\n <|endoftext|>", "<|endof text|>",
    "1²Ⅷ ٣_- éè 漢字 \U0001f600\U0001f600", "Ɤ new Ᲊ letters", "w" * 3000, " " * 5000 + "x", "a" + "\n" * 3000 + " b", "\x00 \x00", "the the the", "word " * 2000, "́́ é",
]


def test_edges(spark, library):
    rows = [(i, t, i) for i, t in enumerate(EDGES)] + [(None, "twice", 1), (3, "a  b", 1), (3, "a  b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect())
    counts = by_library(library, [t for _, t, _ in rows])
    assert got == sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, counts, strict=True))
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_random_texts(library):
    parts = [*" \t\n\x0b\x1c\x85 　 ab'st1²Ⅷ٣_-.!é漢\U0001f600Ɤ", "<|endoftext|>", "<|endof", "   ", " the", "lling", "2024"]
    rng = random.Random(0)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    count = token_counts.counter(PATH).count
    assert [n for k in range(0, len(texts), 500) for n in count(texts[k : k + 500])] == by_library(library, texts)


def test_generations_keep_counts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    shortcut, rng = token_counts.Counter(token_counts.Encoder(PATH)), random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(200)]
    assert [n for k in range(0, 200, 7) for n in shortcut.count(texts[k : k + 7])] == by_library(library, texts)
    assert len(shortcut.young) < 250


def test_whole_tokens_are_one(library):
    whole = token_counts.counter(PATH).whole
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole
    assert {len(x.ids) for x in library.encode_batch(sorted(whole), add_special_tokens=False)} == {1}


def test_other_files(spark, sf_dir):
    import sentencepiece

    docs = table(spark, sf_dir, "documents").filter("doc_id < 40")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, count in (("piece_bpe_32k.model", lambda t: len(pieces.encode(t))), ("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False).ids))):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path=public_tokenizers.path(name)).collect()}
        assert got == {i: count(t) if t else 0 for i, t in texts.items()}


def test_query(spark, sf_dir, library):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("b")).collect()
    counts = by_library(library, [r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_token_counts"](spark, sf_dir).collect()}
    assert got == {r.doc_id: (r.b, n, n > 512) for r, n in zip(rows, counts, strict=True)}
