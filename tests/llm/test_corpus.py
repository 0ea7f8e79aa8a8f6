"""The corpus operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quartzite.llm import decontamination, exact_dedup, language_id, line_dedup, packing, quality, queries, simhash_dedup, substring_dedup, toxicity, url_filter
from quartzite.llm.common import table

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def vocabulary(n, seed=0):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng, v = np.random.default_rng(1), vocabulary(400)
    passage = " ".join(rng.choice(v, 60))
    out = [None, "", " \t\n", "one", "One", "two words", "A\nb\n\nA", "x" * 30, "\u00e9\u00a0\u2003z"]
    out += [" ".join(rng.choice(v, int(n))) for n in rng.integers(1, 200, 30)]
    out += [f"{' '.join(rng.choice(v, 20))} {passage} {' '.join(rng.choice(v, 9))}" for _ in range(4)]
    out += [f"common boilerplate line\n{' '.join(rng.choice(v, 12))}\n  COMMON boilerplate line \nshort" for _ in range(5)]
    out += [out[12], out[12], out[12].replace(" ", "\n"), out[20].upper(), " ".join(v[:50]) + " " + " ".join(v[:50])]
    near = out[15].split()
    out += [" ".join(near[:-1]), " ".join([*near, "end"]), " ".join(rng.choice(v, 20_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "s", len(t) if t else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"pos": F.lit("clash"), "h": F.lit(1), "word": F.lit(0), "fingerprint": F.lit("f"), "first": F.lit(0)}).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact(docs, texts, none):
    got = by_id(exact_dedup.exact_groups(docs))
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for content, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(content.encode()).hexdigest())
    assert exact_dedup.drop_exact(docs).count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a "), (None, "b"), (-5, "c"), (-5, "c")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(df).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows) == [("-5", "-5", 2, True), ("-5", "-5", 2, True), ("3", "3", 2, True), ("None", "3", 2, False), ("None", "None", 1, True)]


def keep_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    first, seen = {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
            first.setdefault(key(x), i)
    return ["\n".join(x for x in (t or "").split("\n") if not (len(key(x)) >= 10 and len(seen[key(x)]) > 1 and first[key(x)] != i)) for i, t in enumerate(texts)]


def test_lines(docs, texts, none):
    want = keep_lines(texts)
    got = by_id(line_dedup.drop_lines(docs))
    assert [got[i].text for i in range(len(texts))] == [w if t is not None else None for w, t in zip(want, texts, strict=True)]
    assert line_dedup.drop_lines(docs).columns == docs.columns
    maps = by_id(line_dedup.line_bitmaps(docs))
    assert all(sum(64 - (k.bits & (2**64 - 1)).bit_count() for k in m.kept) == m.n_dropped > 0 for m in maps.values())
    assert line_dedup.line_bitmaps(none).count() == 0


def test_lines_past_one_word(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line number {i}" for i in range(200))), (2, "\n".join(f"line number {i}" for i in range(100, 300)))], "doc_id long, text string")
    assert by_id(line_dedup.drop_lines(df))[2].text == "\n".join(f"line number {i}" for i in range(200, 300))


def simhash(text, k):
    w = words((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius, blocks", [(2, 4), (2, 8), (3, 4)])
def test_simhash(docs, texts, none, radius, blocks):
    prints = np.array([simhash(t, 3) for t in texts], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = np.arange(len(texts))
    for _ in texts:
        label = np.where(near, label[None, :], len(texts)).min(axis=1)
    got = by_id(simhash_dedup.near_groups(docs, radius=radius, blocks=blocks))
    assert [got[i].fingerprint & (2**64 - 1) for i in range(len(texts))] == prints.tolist()
    assert [got[i].component_id for i in range(len(texts))] == label.tolist()
    if radius == 2 and blocks == 4:
        assert sorted(r.doc_id for r in simhash_dedup.drop_near(docs).collect()) == sorted(set(label.tolist()))
        assert simhash_dedup.near_groups(none).count() == 0


def test_links_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a, b in rng.integers(0, 64, (12, 2)).tolist()]]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    at = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    found = {(at[r.u], at[r.v]) for r in simhash_dedup.links(df, 2, 4, piece=16).collect()}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in found:
        parent[root(u)] = root(v)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    assert all(root(i) == root(j) for i, j in zip(*np.nonzero(near), strict=True))


def test_packing(docs, texts, none):
    enc = packing.encoder(packing.default_path())
    ids = [[*enc.slow.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = packing.pack(docs, with_ids=True).collect()
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.ids == part and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r.doc_id] += r.length
    assert all(at[i] == len(x) for i, x in enumerate(ids))
    filled = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert all(n == 1024 for s, n in filled.items() if s < max(filled))
    whole = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert sum(r.n_tokens for r in whole) == sum(map(len, ids))
    assert all(len(r.ids) == 1024 or (r.n_tokens & (r.n_tokens - 1)) == 0 for r in whole)
    assert packing.pack(none).count() == 0


def test_fast_ids_are_the_slow_ones():
    enc = packing.encoder(packing.default_path())
    for t in ("it's  a\n\n test 123!! \u00e9\u4e2d", "a <|endoftext|> b", " ", "\x00\x01"):
        assert enc.ids(t).tolist() == enc.slow.encode(t, add_special_tokens=False).ids


def weighted(a, b):
    same = sum((collections.Counter(a) & collections.Counter(b)).values())
    return same / (len(a) + len(b) - same)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, limit):
    rng, v = np.random.default_rng(5), vocabulary(60, 2)
    items = [" ".join(rng.choice(v, n)) for n in (15, 20, 40, 5)] + ["tiny one", "", None]
    plant = lambda t, k: " ".join(w if i % 25 != k else "zzz" for i, w in enumerate(t.split()))
    texts = [None, "", *[" ".join(rng.choice(v, 80)) for _ in range(5)]]
    texts += [f"{' '.join(rng.choice(v, 9))} {t.upper()}\t{' '.join(rng.choice(v, 9))}" for t in items[:4]] + [plant(items[2], 3), items[2] + " " + items[2], items[1].rsplit(" ", 1)[0], "a Tiny  ONE b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, s int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        w = words((t or "").translate(LOWER))
        for i, item in enumerate(items):
            x = words((item or "").translate(LOWER))
            k = min(5, len(x))
            if not k:
                continue
            s, y = [tuple(w[p : p + k]) for p in range(len(w) - k + 1)], [tuple(x[p : p + k]) for p in range(len(x) - k + 1)]
            best = max((weighted(s[p : p + len(y)], y) for p in range(max(1, len(s) - len(y) + 1)) if s), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    got = decontamination.contaminated(docs, bench, broadcast_rows=limit)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == want and len(want) >= 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    if limit:
        clean = decontamination.drop_contaminated(docs, bench)
        assert clean.columns == docs.columns and clean.count() == len(texts) - len({d for d, _ in want})
        assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_multi_index_blocks_reach_the_radius():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        flips = rng.choice(64, decontamination.RADIUS, replace=False)
        assert np.bincount(flips // decontamination.WIDTH, minlength=decontamination.BLOCKS).min() <= decontamination.NEAR


def test_substring(docs, texts, none, monkeypatch):
    for size in (1 << 22, 2_000):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", size)
        count = collections.Counter(tuple(w[p : p + 35]) for w in map(words, texts) for p in range(len(w) - 34))
        got = by_id(substring_dedup.repeats(docs))
        for i, w in enumerate(map(words, texts)):
            gone = [False] * len(w)
            for p in range(len(w) - 34):
                if count[tuple(w[p : p + 35])] > 1:
                    gone[p : p + 35] = [True] * 35
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), kept)
            assert sum(s.end - s.start for s in got[i].spans) == sum(gone)
    assert substring_dedup.repeats(none).count() == 0


RULES = [*url_filter.RULES, ("block", "a.b.example.org", "/x"), ("allow", "b.example.org", "/x/y/z/long"), ("block", "example.org", "")]
URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/1", "https://example.net/de/", "http://net/", "http://sub.net", "x://org/fr/?q#f", "http://a.b.example.org/x/y/z/longer", "http://b.example.org#/x", "http://notexample.org/fr/", "http://u@h.example.com:80/de/a?b://c", "a\nb://x.org/fr/1"]


@pytest.mark.parametrize("local", [100, 2])
def test_urls(spark, local):
    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.match(r"[^/?#]*", rest).group().translate(LOWER) if rest is not None else ""
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S).group(1) if rest is not None else ""
        fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, ("allow", None, "/"), ("block", "org", None)][: len(RULES) + 1], "verdict string, host string, path string")
    got = url_filter.filter_urls(pages, rules, local_rules=local, urls_per_task=3)
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == {i: judge(u) for i, u in enumerate(URLS)}
    assert url_filter.filter_urls(pages.limit(0), rules, local_rules=local).count() == 0


def test_grammar():
    lexicon = toxicity.Lexicon({"words": {"idiot": (50, 0), "kill": (50, 0)}, "heads": {}, "n": (100, 900), "least": 1.4})
    score = lambda t: sum(toxicity.clauses(t, lexicon)[0])
    assert score("You are an idiot.") > score("An idiot.") > score("He is not an idiot.") > 0
    assert score("She said he is an idiot.") < score("He is an idiot.")
    assert score("He said so. An idiot.") == score("An idiot.")
    assert score("I will kill you.") == score("You, I will kill.") > score("I will kill.") > 0 == score("Nothing here.")
    assert lexicon["kill"][0] == toxicity.THREAT and lexicon["murder"] == (toxicity.THREAT, toxicity.THREAT_WEIGHT)
    assert score('He wrote "hi" you are an idiot') == score("He is one, you are an idiot") > score('He wrote "you are an idiot"')
    assert score('"Well. You are an idiot." ') == score('He: "you are an idiot"') < score('"Well.\nYou are an idiot.')


def test_grammar_against_plain_rules():
    """The composed machines against the rules said in words."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(1, 16))
        clause = list(zip(rng.choice(7, n, p=(0.3, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1)).tolist(), rng.random(n).tolist(), strict=True))
        want, quoted, told = 0.0, False, False
        for i, (s, w) in enumerate(clause):
            if s == toxicity.QUOTE:
                quoted, told = not quoted, False
            elif s == toxicity.REPORT and not quoted:
                told = True
            elif s in (toxicity.INSULT, toxicity.THREAT):
                aimed = any(x == toxicity.TARGET for x, _ in clause[max(0, i - 4) : i + 5])
                negated = any(x == toxicity.NEGATION for x, _ in clause[max(0, i - 3) : i])
                a, b, c, d = (1.5, 1.0, 0.3, 0.5) if s == toxicity.INSULT else (1.5, 0.5, 0.2, 0.4)
                want += w * (a if aimed else b) * (c if negated else 1) * (d if quoted or told else 1)
        assert toxicity._walk(clause) == pytest.approx(want)


def test_classifiers_learn(spark):
    rng, v = np.random.default_rng(7), vocabulary(3000)
    letters = {"aa": "abcdefghi", "bb": "ijklmnopq", "cc": "qrstuvwxyz"}
    rows, labels = [], []
    for i in range(600):
        toxic, junk, lang = i % 9 == 0, i % 5 == 0, ["aa", "bb", "cc"][i % 3]
        w = ["".join(rng.choice(list(letters[lang]), 7)) for _ in range(60)] if i % 2 else list(rng.choice(v, 60))
        if toxic:
            w[10] = w[30] = "scumbag"
        rows.append((i, (" | ".join(w) + "!!") if junk else " ".join(w) + ".", lang if i % 2 else None))
        labels.append((i, 1 - int(junk), int(toxic)))
    rows += [(9000, None, "aa"), (9001, "", None), (9002, "12 34", "bb"), (9003, "x" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (9000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = queries.toxicity_model(docs, known)
    tox = by_id(toxicity.score(docs, model))
    right = np.mean([(tox[i].score >= 0.7) == bool(t) for i, _, t in labels])
    assert right > 0.97 and tox[9000].score == tox[9001].score < 0.3, right
    assert toxicity.drop_toxic(docs, model).count() == sum(r.score < 0.7 for r in tox.values())
    good = by_id(quality.score(docs, quality.fit(docs, known.select("doc_id", F.col("quality").alias("label")))))
    assert np.mean([(good[i].score >= 0.5) == bool(q) for i, q, _ in labels]) > 0.95 and 0 <= good[9001].score <= 1
    lang = by_id(language_id.predict(docs, language_id.fit(docs)))
    assert np.mean([lang[i].lang_pred == x for i, _, x in rows[1:600:2]]) > 0.98
    assert [lang[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and lang[9003].lang_pred in ("aa", "bb", "cc")


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    empty = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.score(docs, toxicity.fit(docs, empty)).count() == 2
    assert {r.score for r in quality.score(docs, quality.fit(docs, empty)).collect()} == {0.5}
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"und"}
    for df in (toxicity.score(docs.limit(0), toxicity.fit(docs, empty)), quality.score(docs.limit(0), quality.fit(docs, empty)), language_id.predict(docs.limit(0), {"langs": []})):
        assert df.count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 9])
def test_codewords(k):
    c = np.tile(language_id.codewords(k), (1, len(language_id.views(k))))
    assert k == 1 or min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= 4
    assert c.shape[0] == k and all((c[i] != c[j]).any() for i in range(k) for j in range(i))


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    cuts = quality.prior_cuts(p)
    assert abs(quality.class_prior(p, cuts, (u[:, None] >= cuts).sum(axis=0), len(u)) - 0.7) < 0.06
    x = lambda v: np.stack([np.ones_like(v), v], axis=1)
    beta = quality.nn_pu(x(p), x(u), 0.7)
    assert ((x(rng.normal(-2, 1, 500)) @ beta) < 0).mean() > 0.9 and ((x(rng.normal(2, 1, 500)) @ beta) > 0).mean() > 0.9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, d, "labels").collect()}
    langs = {r.doc_id: r.lang for r in table(spark, d, "documents").select("doc_id", "lang").collect()}
    tox = [(r, labels[r.doc_id].toxic) for r in queries.op1_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == t for r, t in tox]) > 0.93
    good = [(r, labels[r.doc_id].quality) for r in queries.op6_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == q for r, q in good]) > 0.88
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in queries.op4_language_id(spark, d).collect() if r.held_out]) > 0.98
