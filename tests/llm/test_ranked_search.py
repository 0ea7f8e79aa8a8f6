"""Ranked search against brute force and its SQL twin."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.llm import queries, ranked_search

LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    v = [*("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)), "the", "THE", "é", "漢字", "x1", "\x7fq"]
    weights = 1 / np.arange(1, len(v) + 1)
    texts = [None, "", " .,-", "the the the", "The", "é·é É", "漢字。漢字 x1"]
    texts += [" ".join(rng.choice(v, int(n), p=weights / weights.sum())) for n in rng.integers(1, 120, 150)]
    texts += [texts[20]] * 30 + [texts[21].replace(" ", "-")] * 3 + [" ".join(rng.choice(v, 30_000))]
    docs = list(enumerate(texts)) + [(None, texts[20]), (None, texts[25]), (9, texts[9]), (9, texts[9])]
    items = [(i, " ".join(rng.choice(v, int(n)))) for i, n in enumerate(rng.integers(1, 60, 12))]
    items += [(100, None), (101, ""), (102, "unknown words"), (103, "the"), (103, "the"), (None, f"the the {texts[20]}"), (104, texts[30])]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = spark.createDataFrame(rows[0], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "query", "score", "m")})
    items = spark.createDataFrame(rows[1], "item_id long, text string").withColumns({c: F.lit(0) for c in ("item", "term", "doc_id")})
    return docs.repartition(6), items.repartition(3)


@pytest.mark.parametrize("how", [{}, {"k": 3}, {"k": 500}, {"max_terms": 40}])
def test_brute(rows, tables, how):
    got = ranked_search.search(*tables, **how).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(*rows, how.get("k", 20))


def test_empty(tables):
    docs, items = tables
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.filter("text = ''"), items.filter("text = ''")).count() == 0


def test_bounds_enclose_scores(rows):
    tf, m = np.meshgrid(np.array([1, 2, 3, 50, 10**6]), np.array([75, 76, 100, 10**5, 10**9]))
    exact = ranked_search.impact(tf, m)
    rounded = -(-exact // ranked_search.QUANTUM)
    assert rounded.max() <= 255
    assert (rounded * ranked_search.QUANTUM >= exact).all() and (np.maximum((rounded - 1) * ranked_search.QUANTUM + 1, 0) <= exact).all()


def test_chunks_cover(monkeypatch):
    Row = collections.namedtuple("Row", "query term times")
    group = ranked_search.Queries([Row(q, f"t{t}", 1) for q in range(5) for t in range(20) if (q + t) % 3])
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 12, 50)
    chosen = rng.integers(0, len(group.terms), sizes.sum())
    for cells, pairs in ((1, 1), (7, 40), (10**6, 10**6)):
        monkeypatch.setattr(ranked_search, "CELLS", cells)
        monkeypatch.setattr(ranked_search, "PAIRS", pairs)
        cuts = list(ranked_search._chunks(group, chosen, sizes))
        assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == 50
        assert all(b - a == sizes[lo:hi].sum() for lo, hi, a, b in cuts)


def test_query(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES["op13_ranked_search"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL["op13_ranked_search"]).fetchall())
