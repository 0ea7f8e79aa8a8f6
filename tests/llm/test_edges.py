"""Cases that the other fixtures leave out: long runs of white space, repeated and null ids, clashing names, empty tables, hot keys, bounds."""

import collections
import json
import math
import os
import threading
import time
import zlib
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import SCHEMA, by_id, vocabulary

from quartzite.llm import common, components, decontamination, exact_dedup, language_id, line_dedup, packing, quality, simhash_dedup, substring_dedup, toxicity, url_filter

CLASH = ("_keep", "_row", "_line_dropped", "line_kept", "kept", "row", "place", "same_id", "digest", "first", "range", "salt", "hs", "window", "component_id")


def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n\t "])
def test_packing_survives_white_space(spark, run):
    text = "a" + run * (2_000_000 // len(run)) + "b"
    want = np.array([*packing.encoder(packing.default_path()).slow.encode(text, add_special_tokens=False).ids, 0], "<u4")
    rows = sorted(packing.pack(frame(spark, [(1, text), (2, "next")])).filter("doc_id = 1").collect(), key=lambda r: r.start)
    assert sum(r.length for r in rows) == len(want) == rows[0].doc_tokens
    assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in rows)


def test_pipeline_survives_odd_rows(spark, tmp_path):
    """Null ids and texts, repeats, long white space and empty tables through every stage."""
    odd = [(1, " " * 1_500_000, None, "s", None), (2, None, None, None, None), (None, "no id at all, but a text", "en", "s", 5), (3, "same text twice over", "en", "s", 1), (3, "same text twice over", "en", "s", 1), (3, "an other text of that id", None, "s", 1)]
    spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of five words or more"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, ids in ((odd, {1, 3, None}), ([], set())):
        docs = spark.createDataFrame(rows, SCHEMA)
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        assert {r.doc_id for r in docs.collect()} == ids
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids


def test_lines_by_row(spark):
    docs = frame(spark, [(1, "shared boilerplate line\nx"), (2, "shared boilerplate line\ny"), (2, "a wholly unique line of row three\nz"), (None, "Shared boilerplate LINE\nw"), (None, "only the rows without id\nq"), (None, "only the rows without id\nr")])
    kept = line_dedup.drop_lines(clashing(docs), salts=2)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "shared boilerplate line\nx"), ("2", "a wholly unique line of row three\nz"), ("2", "y"), ("None", "only the rows without id\nq"), ("None", "only the rows without id\nr"), ("None", "w")]
    assert kept.columns == clashing(docs).columns and {r.kept for r in kept.collect()} == {"clash"}
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_exact_by_row(spark):
    docs = clashing(frame(spark, [(3, "same"), (5, "same"), (5, "different"), (5, "diff erent"), (5, "diff erent"), (None, "same"), (None, None)]))
    kept = exact_dedup.drop_exact(docs)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "same"), ("5", "diff erent"), ("None", None)] and kept.columns == docs.columns
    assert exact_dedup.drop_exact(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs, salts=64)


def test_leaks_by_row(spark):
    item = "one two three four five six seven"
    docs = clashing(frame(spark, [(1, "clean text of this id without any passage"), (1, f"x {item} y"), (None, f"{item} z"), (None, "clean too, and without an id")]))
    bench = spark.createDataFrame([(7, item), (8, item), (None, item)], "item_id long, text string")
    found = decontamination.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) == [(d, i) for d in ("1", "None") for i in ("7", "8", "None")]
    clean = decontamination.drop_contaminated(docs, bench)
    assert sorted(r.text[:5] for r in clean.collect()) == ["clean", "clean"] and clean.columns == docs.columns
    assert decontamination.drop_contaminated(docs.limit(0), bench).count() == 0 and decontamination.drop_contaminated(docs, bench.limit(0)).count() == 4


def test_radius_holds_similar_pairs():
    """Windows at the least similarity, for item lengths from 9 to 400 shingles: none is beyond the radius."""
    rng, far = np.random.default_rng(9), 0
    for n in (9, 10, 18, 20, 27, 40, 90, 200, 400):
        same = math.ceil(1.6 * n / 1.8 - 1e-9)
        for _ in range(1500):
            h = rng.integers(0, 2**64, 2 * n - same, dtype=np.uint64)
            far = max(far, (simhash_dedup.fingerprint(h[:n]) ^ simhash_dedup.fingerprint(h[n - same :])).__and__(2**64 - 1).bit_count())
    assert 12 < far <= decontamination.RADIUS


def weighted_jaccard(a, b, k=5):
    x, y = (collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return (x & y).total() / (x | y).total()


def test_leaks_with_repeated_shingles(spark):
    """Texts of few words in turns, whose shingles repeat many times: all pairs of 0.8 or more are found."""
    pairs = [("yes", "no"), ("a", "b"), ("left", "right"), ("0", "1"), ("tick", "tock"), ("on", "off")]
    items = [[p[i % 2] for i in range(23)] for p in pairs]
    texts = [[p[(i + 1) % 2] for i in range(23)] for p in pairs]
    rng = np.random.default_rng(11)
    for n in (24, 40, 90):
        for turns in (2, 3, 5):
            words = [f"w{n}x{turns}y{i}" for i in range(turns)]
            for shift in (1, 2):
                item = [words[i % turns] for i in range(n)]
                text = [words[(i + shift) % turns] for i in range(n)]
                text[int(rng.integers(n // 2))] = "other"
                items.append(item)
                texts.append(text)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = frame(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if weighted_jaccard(t, item) >= 0.8}
    assert len(want) >= 10
    for rows in (1_000_000, 1):
        found = decontamination.contaminated(docs, bench, broadcast_rows=rows).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want


def test_bitmaps_are_linear(spark):
    """Four times the lines take far less than sixteen times as long."""
    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"line number {i} of {n}" if i % 70 else f"own line {i}" for i in range(n))
        docs = frame(spark, [(1, text), (2, "\n".join(f"other {x}" if k % 200 == 0 else x for k, x in enumerate(text.split("\n"))))])
        line_dedup.drop_lines(docs.limit(1)).count()
        start = time.perf_counter()
        got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
        took.append(time.perf_counter() - start)
        assert got[1] == text and got[2] == "\n".join(f"other {x}" for x in text.split("\n")[::200])
    assert took[1] < 8 * took[0]


def test_repeated_and_null_ids(spark):
    passage = " ".join(vocabulary(50, 8))
    docs = frame(spark, [(1, passage), (1, f"x {passage}"), (None, "short"), (None, None)])
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.repeats(docs).collect()) == [(0, 0), (1, 0), (50, 50), (51, 50)]
    groups = simhash_dedup.near_groups(docs.union(frame(spark, [(9, "short")]))).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in groups) == [("1", "1"), ("1", "1"), ("9", "9"), ("None", "9"), ("None", "None")]
    assert sorted(r.start for r in packing.pack(docs).collect()) == [0, 0, 0, 0]


@pytest.mark.parametrize("local", [100, 2])
def test_urls_of_one_range(spark, local):
    pages = spark.createDataFrame([(i, f"http://a{i % 7}.example.com/de/{i % 3}") for i in range(200)] + [(None, None)] * 30 + [(5, "http://com/")] * 20, "page_id long, url string")
    rules = spark.createDataFrame([("block", "com", "/"), ("allow", "example.com", "/de/1"), ("block", "a3.example.com", ""), ("block", "zz.org", "/")], "verdict string, host string, path string")
    got = url_filter.filter_urls(pages, rules, local_rules=local, urls_per_task=10).groupBy("rule").count().collect()
    want = {"com/": sum(i % 3 != 1 and i % 7 != 3 for i in range(200)) + 20, "example.com/de/1": sum(i % 3 == 1 for i in range(200)), "a3.example.com": sum(i % 7 == 3 and i % 3 != 1 for i in range(200)), None: 30}
    assert {r.rule: r["count"] for r in got} == want


def test_hot_keys_are_dealt(spark, monkeypatch):
    """With a third of the rows in one key, its rows stay where they were read."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id").repartition(8, "id")
    found = rows.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("size"))
    got = common.looked_up(rows, "k", found, "size", 3000)
    tasks = [r["count"] for r in got.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert got.count() == 3000 and max(tasks) < 200 and {r.top for r in got.filter("k = 7").collect()} == {2997}


def test_components_of_a_wide_star(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    edges = spark.range(1, 400).selectExpr("id as u", "0L as v").union(spark.range(500, 520).selectExpr("id as u", "id + 1 as v"))
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 400)}, **{i: 500 for i in range(501, 521)}}


def test_settled_leaves_no_files(spark):
    kept = common.settled(lambda: common.stored(common.stored(spark.range(5).toDF("x"), "one"), "two").filter("x > 1"), "end")
    root = common.shared_dir(spark).removeprefix("file://")
    names = {p.split("-")[0] for p in __import__("os").listdir(root)}
    assert kept.count() == 3 and "end" in names and not {"one", "two"} & names


@pytest.fixture(scope="module")
def taught(spark):
    rng, v = np.random.default_rng(7), vocabulary(500)
    rows = [(i, " ".join(rng.choice(v, 30)) + (" you scumbag." if i % 5 == 0 else " | | !!" if i % 3 == 0 else "."), ["aa", "bb"][i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    repeated = docs.union(docs.filter("doc_id < 100").crossJoin(spark.range(20)).select("doc_id", F.concat("text", F.col("id").cast("string")), "lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("label"))
    return docs, repeated, labels


def test_samples_are_bounded_by_ids(taught, monkeypatch):
    docs, repeated, labels = taught
    seen = []
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: seen.append(len(x)) or np.array(toxicity.UNTAUGHT))
    toxicity.fit(repeated, labels, max_docs=120)
    monkeypatch.setattr(quality, "logistic", lambda x, y, ridge=1.0: seen.append(len(x)) or np.zeros(x.shape[1]))
    quality.fit(repeated, labels, max_docs=60)
    assert seen[0] == 120 and seen[1] <= 120


def test_every_language_is_learned(spark):
    letters = [chr(97 + i // 5) + chr(97 + i % 5) + chr(99 + i % 7) for i in range(60)]
    rows = [(100 * i + j, f"{x * 5} {x[::-1] * 4} {x}", f"l{i}") for i, x in enumerate(letters) for j in range(1 if i == 59 else 4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=40)
    assert len(model["langs"]) == 60


def test_scores_against_plain_code(taught, spark):
    """op1, op4 and op6 over a fitted model, computed again without the operators' code."""
    docs, _, labels = taught
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {900: None, 901: "", 902: "Ünïcode – “quoted” text: kill you!", 903: "12 34"}
    more = spark.createDataFrame([(i, t, None) for i, t in texts.items()], docs.schema)
    sig = lambda x: 1 / (1 + math.exp(-x))

    m = language_id.fit(docs)
    got = by_id(language_id.predict(more, m))
    for i, t in texts.items():
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 1.0)
            continue
        raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + t.lower().encode() + b" "]
        raw = [b for p, b in enumerate(raw) if p == 0 or b != 32 or raw[p - 1] != 32]
        x = []
        for n, size in enumerate(language_id.SIZES, 1):
            counts = [0] * size
            for p in range(len(raw) - n + 1):
                code = raw[p]
                for b in raw[p + 1 : p + n]:
                    code = (code * 0x01000193 + b) % 2**32
                counts[code if n == 1 else (code * 0x9E3779B1 % 2**32) >> (32 - (size - 1).bit_length())] += 1
            x += [math.sqrt(c / (len(raw) - n + 1)) for c in counts]
        margins = np.clip(np.array([*x, 1.0]) @ m["w"], -2, 2)
        loss = [sum(b * math.log1p(math.exp(-4 * f * c)) for b, f, c in zip(m["bits"], margins, word, strict=True)) / sum(m["bits"]) for word in m["code"]]
        assert got[i].lang_pred == m["langs"][int(np.argmin(loss))]
        assert got[i].score == pytest.approx(1 / sum(math.exp(-3 * (e - min(loss))) for e in loss), abs=1e-4)

    m = quality.fit(docs, labels)
    got = by_id(quality.score(more, m))
    k = m["edges"].shape[1] + 1
    for i, t in texts.items():
        f = quality.features(t)
        z = m["beta"][0] + sum(m["beta"][1 + j * k + sum(f[j] >= e for e in m["edges"][j])] for j in range(len(f)))
        assert got[i].score == pytest.approx(sig(m["scale"][0] + m["scale"][1] * z))
    words = "Two words, two WORDS\n9 x".split()
    f = quality.features("Two words, two WORDS\n9 x")
    n = len("Two words, two WORDS\n9 x")
    plain = [6 / n, 11 / n, 1 / n, 4 / n, 1 / n, 0, 1 / n, 0, 0, 0, 0, 0, 0, 0]
    sizes = [len(w) for w in words]
    plain += [math.log1p(6), np.mean(sizes), np.std(sizes), 1.0, 1 / 6, 0, 1.0, math.log1p(3), 4 / 6]
    assert f == pytest.approx(plain)

    m = json.loads(json.dumps(toxicity.fit(docs, labels)))
    got = by_id(toxicity.score(more, m))
    odds = lambda p, n: math.log((p + 0.5) / (m["n"][0] + 1)) - math.log((n + 0.5) / (m["n"][1] + 1)) - 2 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    closed = (toxicity.TARGETS + " " + toxicity.NEGATIONS + " " + toxicity.REPORTS).split()
    for i, t in texts.items():
        scores, n = [], 0
        for clause in (t or "").lower().replace("!", ".").replace(":", ".").split("."):  # the fixture has no other breaks
            tokens = ["".join(c for c in w if c.isalpha()) for w in clause.split() if any(c.isalpha() for c in w)]
            n += len(tokens)
            total = 0.0
            for p, w in enumerate(tokens):
                heads = [odds(*m["heads"][w[:k]]) for k in range(3, min(9, len(w) - 1) + 1) if w[:k] in m["heads"]]
                x = 0 if w in closed else odds(*m["words"][w]) if w in m["words"] else max(heads, default=0)
                x = x if x >= m["least"] else 0
                near = any(v in toxicity.TARGETS.split() for v in tokens[max(0, p - 4) : p + 5])
                if w in toxicity.THREATS.split():
                    total += (x or 3.0) * (1.5 if near else 0.5)
                elif x:
                    total += x * (1.5 if near else 1.0)
            if total:
                scores.append(total)
        s = sum(scores)
        f = [1, math.log1p(s), max(scores, default=0), math.log1p(len(scores)), math.log1p(100 * s / (n + 20)), bool(scores)]
        assert got[i].score == pytest.approx(sig(float(np.dot(f, m["beta"])))), t


def test_threads_keep_their_files(spark):
    """Two results built at the same time delete their own intermediate files only."""
    gate = threading.Barrier(2, timeout=60)

    def build(name):
        def inner():
            kept = common.stored(spark.range(7).toDF("x"), f"{name}-inner")
            gate.wait()
            return kept.filter("x > 1")

        return common.settled(inner, f"{name}-end")

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(build, ("left", "right")))
    names = os.listdir(common.shared_dir(spark).removeprefix("file://"))
    assert [f.count() for f in found] == [5, 5] and not [n for n in names if "-inner-" in n]
