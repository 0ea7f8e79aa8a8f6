import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np  # noqa: E402
from test_corpus import LOWER, keep_lines, weighted, words  # noqa: E402
from test_near import brute  # noqa: E402

from quartzite.llm import packing, queries, toxicity  # noqa: E402
from quartzite.llm.common import stored, table  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    extra = spark.createDataFrame([(900001, None, None, None, None), (900002, "", None, "s", 0), (900003, "one clean unlabelled sentence that is nothing special", "en", "s", None)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert docs.columns == columns
        docs = docs.cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= left and 900003 in now
        left = now
    total = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in total} == left and all(r.n == r.t for r in total)


def test_against_brute_force(spark, sf_dir):
    """Each stage's result from its own input, by the plainest code."""
    docs = table(spark, sf_dir, "documents")
    items = [words(r.text.translate(LOWER)) for r in table(spark, sf_dir, "benchmark").collect()]
    enc = packing.encoder(packing.default_path())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    def leaks(text):
        s = grams(words(text.translate(LOWER)))
        for y in map(grams, items):
            if len(set(s) & set(y)) >= 0.4 * len(y) and max(weighted(s[p : p + len(y)], y) for p in range(max(1, len(s) - len(y) + 1))) >= 0.8:
                return True
        return False

    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
        after = stored(stage(spark, docs, sf_dir), "test")
        if name == "packing":
            total = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
            assert total == {i: len(enc.slow.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
            break
        got = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
            lexicon, beta = toxicity.Lexicon(model), np.array(model["beta"])
            want = {i: t for i, t in before.items() if 1 / (1 + np.exp(-np.array([1.0, *toxicity.features(t, lexicon)]) @ beta)) < 0.7}
        elif name == "line_dedup":
            want = dict(zip(before, keep_lines(list(before.values())), strict=True))
        elif name == "near_dedup":
            want = {i: before[i] for i in set(brute(list(before.items())).values())}
        else:
            want = {i: t for i, t in before.items() if not leaks(t)}
        assert got == want, name
        docs = after


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
