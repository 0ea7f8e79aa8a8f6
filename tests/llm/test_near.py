"""The pipeline's near stage against brute force over shingle sets."""

from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import LOWER, SCHEMA, vocabulary, words

from quartzite.llm import near_dedup, simhash_dedup


def grams(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, t=Fraction(4, 5)):
    sets, label = {i: grams(x) for i, x in rows}, {i: i for i, _ in rows}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
    while True:
        old = dict(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == old:
            return label


@pytest.fixture(scope="module")
def rows():
    rng, v = np.random.default_rng(5), vocabulary(300, 5)
    pick = lambda n: rng.choice(v, n).tolist()
    out = [None, "", " \n", "One two", "one  two", "a b c d e", "a b c d e f"]
    for n in (20, 60, 200, 900):  # one to five words changed: on both sides of 0.8
        base = pick(n)
        out.append(" ".join(base))
        for changed in (1, 2, 3, 5):
            copy = list(base)
            for at in np.linspace(6, n - 7, changed).astype(int):
                copy[at] = "other"
            out.append(" ".join(copy))
    base = pick(100)
    out += [" ".join([*base[: 100 - k], *pick(k)]) for k in range(0, 20, 2)]  # sixth to eleventh word from the end
    chain = pick(80)
    out += [" ".join(chain[k : k + 60]) for k in range(0, 20, 3)]  # neighbours are near, the ends are not
    passage = pick(30)
    out += [" ".join([*passage, *pick(20)]) for _ in range(30)]  # a frequent passage alone is not enough
    four = pick(22)
    out += [" ".join(four), " ".join([*four[:20], "x", "y"])]  # 16 of 20 shingles: 0.8 exactly
    return list(enumerate(out, 1))


def test_near_stage(spark, rows):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], SCHEMA).repartition(4)
    want = brute(rows)
    assert sum(grams(a) != grams(b) for (i, a) in rows for (j, b) in rows if want[i] == j) > 15
    kept = corpus_pipeline.near(spark, docs, "")
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in rows if want[i] == i}


def test_groups(spark, rows):
    empty = spark.createDataFrame([(None, "no id"), (None, "no id")], "doc_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(empty)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()} == {None: None, **brute(rows)}
    assert [r.text for r in near_dedup.drop_near(empty).collect()] == ["no id"]
    assert near_dedup.near_groups(empty.limit(0)).collect() == [] == near_dedup.drop_near(empty.limit(0)).collect()


@pytest.mark.parametrize("drop", [near_dedup.drop_near, simhash_dedup.drop_near])
def test_rows_of_one_id(spark, drop):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of seven words"), (2, "quite another text of seven words"), (None, "a b c d e f g"), (None, "no id but unique")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_keep", "_row", "row", "label", "place", "same_id", "same_row", "component_id")})
    kept = drop(docs)
    assert kept.columns == docs.columns and all(r.label == "label" and r.row == "row" for r in kept.collect())
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", rows[0][1]), ("2", rows[2][1]), ("None", rows[5][1])]


def test_fingerprints_name_pairs(spark, rows, monkeypatch):
    """With the index left out, groups remain, and only such that fingerprints within the radius name and the exact check confirms."""
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], SCHEMA).repartition(4)
    full, none = near_dedup.prefixes, lambda *args: full(*args).filter("false")
    monkeypatch.setattr(near_dedup, "prefixes", none)
    sets = {i: near_dedup.sets_of(near_dedup.pa.array([(t or "").encode()]), 5)[0] for i, t in rows}
    prints = {i: simhash_dedup.fingerprint(s) & (2**64 - 1) for i, s in sets.items()}
    radius = 9
    label = {i: i for i in sets}
    same = {i: next(j for j in sets if np.array_equal(sets[i], sets[j])) for i in sets}
    similar = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    near = [(i, j) for i in sets for j in sets if i < j and (same[i] == same[j] or ((prints[i] ^ prints[j]).bit_count() <= radius and similar(i, j)))]
    for _ in sets:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, radius=radius).collect()}
    assert all(label[i] == label[got[i]] for i in got)  # nothing beyond the radius
    assert len({*label.values()}) <= len({*got.values()}) < len({*same.values()})  # a fingerprint meets its nearest and its least neighbour, not all
