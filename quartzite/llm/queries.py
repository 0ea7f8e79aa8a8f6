"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, exact_dedup, language_id, line_dedup, packing, quality, ranked_search, simhash_dedup, substring_dedup, token_counts, toxicity, url_filter
from .common import fold_of, table
from .conversation_sql import SQL as CONVERSATION_SQL


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Fitted on the labelled rows whose crc32 remainder is not 1."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter(fold_of(F.col("doc_id"), 3) != 1)
    return toxicity.fit(docs, known)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "clauses")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    found = language_id.predict(docs, language_id.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = quality.score(docs, quality.fit(docs.filter(~held_out), labels.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined, kept, dropped = line_dedup.with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select(
        "doc_id",
        F.size(line_dedup.lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.col(dropped).alias("n_dropped"),
        F.sha2(line_dedup.keep_lines(F.col("text"), F.col(kept)), 256).alias("kept_sha256"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversations, conversation_repair.damaged(conversations))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash_dedup, op3_packing, op4_language_id, op5_decontamination, op6_quality, op7_exact_dedup, op8_line_dedup, op9_substring_dedup, op10_url_filter, op11_conversation_repair, op12_token_counts, op13_ranked_search)}

_GRAMS = """SELECT {id}, pos, array_to_string(list_slice(w, pos + 1, pos + 5), ' ') AS gram, n FROM (
          SELECT {id}, w, len(w) - 4 AS n, unnest(range(0, len(w) - 4)) AS pos FROM (
            SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}) a WHERE len(w) >= 5) b"""

_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = {
    # For items of five words or more, as all of the benchmark's are.
    "op5_decontamination": f"""
        WITH s AS ({_GRAMS.format(id="doc_id", table="documents")}), b AS ({_GRAMS.format(id="item_id", table="benchmark")}),
        it AS (SELECT item_id, gram, count(*) AS k, max(n) AS m FROM b GROUP BY item_id, gram),
        st AS (SELECT DISTINCT s.doc_id, it.item_id, it.m, s.n, greatest(0, least(s.pos, s.n - it.m)) AS start FROM s JOIN it ON s.gram = it.gram),
        wg AS (SELECT st.doc_id, st.item_id, st.start, st.m, least(st.m, st.n) AS size, s.gram, count(*) AS k FROM st JOIN s ON st.doc_id = s.doc_id AND s.pos >= st.start AND s.pos < st.start + st.m GROUP BY ALL),
        ov AS (SELECT wg.doc_id, wg.item_id, wg.start, wg.m, wg.size, sum(least(wg.k, it.k)) AS o FROM wg JOIN it ON wg.item_id = it.item_id AND wg.gram = it.gram GROUP BY ALL),
        sm AS (SELECT doc_id, item_id, start, o / (m + size - o)::DOUBLE AS similarity FROM ov)
        SELECT doc_id, item_id, similarity, start::INTEGER AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM sm WHERE similarity >= 0.8 - 1e-12) x WHERE rn = 1
    """,
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
        r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id) AS rn, count(*) OVER (PARTITION BY c) AS group_size FROM d),
        k AS (SELECT c, doc_id AS keep_id FROM r WHERE rn = 1)
        SELECT r.doc_id, k.keep_id, r.group_size, r.doc_id = k.keep_id AS kept, sha256(r.c) AS text_sha256 FROM r JOIN k ON r.c = k.c
    """,
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
        m AS (SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id <> f.first_doc AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS pos FROM d WHERE len(w) >= 35),
        g AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + 35), ' ') AS gram FROM p),
        r AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
        h AS (SELECT g.doc_id, g.pos FROM g JOIN r ON g.gram = r.gram),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
        c AS (SELECT t.doc_id, t.word, t.pos, max(h.pos) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t LEFT JOIN h ON t.doc_id = h.doc_id AND t.pos = h.pos),
        k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op10_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, rhost, rpath)),
        j AS (SELECT s.*, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rn
          FROM s LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE rn = 1
    """,
    "op11_conversation_repair": CONVERSATION_SQL,
    "op13_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
        q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
        qt AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM q) x GROUP BY ALL),
        t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) x WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term) x, s),
        i AS (SELECT t.r, t.doc_id, t.term, f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS score FROM t JOIN f ON t.term = f.term, s),
        a AS (SELECT q, item_id, doc_id, r, sum(times * score)::BIGINT AS score FROM i JOIN qt ON i.term = qt.term GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM a WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
    """,
}
