"""Queries of report filters, totals, type rules, drift listings and helpers, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import strings as S
from ..operators import clean as K
from ..operators import drift, entity, profile, sampling
from ..operators import report as R
from . import cleaning as C
from . import entities as E
from . import sql as Q
from .cleaning import COLS, ROLES, contacts, table
from .fixtures import DIRTY_CONTACTS


def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    return entity.normalized(E.applications(spark, d)).select("rid", "_tin", "_mid", "_state", "_city", "tin", "legal_name", "owner_first", "postal")


def labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.labelled(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"), N.half_even(F.col("o_totalprice").cast("double") / 1000).alias("price"), D.midnight(F.col("o_orderdate")).cast("string").alias("day"))


def ranks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return sampling.strata_ranks(o, "o_orderstatus", "o_orderkey", 7).select("o_orderkey", F.col("rank_in_stratum").cast("long").alias("r"))


def shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The first rows in the shuffled order."""
    return sampling.shuffled(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey").limit(100)


def single_types(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("US").alias("country"), F.lit("n/a").alias("note"), (F.col("o_orderkey") % 4).cast("int").alias("grade"), F.lit(9).alias("nine"))
    single, many = profile.single_types(df), profile.feature_types(df)
    return spark.createDataFrame([(c, single[c], many[c]) for c in df.columns], "feature string, single string, many string")


def missing_by_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"lgl_nm": "text", "dba_nm": "text", "phone": "code", "zip": "code", "tin": "code"}
    return profile.missing_by_type(profile.missing_values(contacts(spark, d), list(kinds)), kinds).withColumn("mean_pct", F.round("mean_pct", 6))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    df = contacts(spark, d)
    stats = K.global_stats(df, ROLES, COLS).first().asDict()
    raw, clean = (K.overall_score(q(df, ROLES, COLS)).first().score for q in (K.quality_raw, K.quality_clean))
    return spark.createDataFrame([R.html_statistics(stats, raw, clean)], "issue_pct double, good_pct double, improvement double").select(*[F.round(c, 6).alias(c) for c in ("issue_pct", "good_pct", "improvement")])


def display_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("n", F.when(F.col("o_orderkey") % 2 == 0, F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))).otherwise(1990))
    return o.select("o_orderkey", profile.displayed_date(F.col("n"), o.schema["n"].dataType).alias("day"))


def seeds_psi(spark: SparkSession, d: str) -> DataFrame:
    """PSI of the samples of three seeds."""
    e = E.events(spark, d).withColumn("y", (F.col("event_id") % 10 == 0).cast("int"))
    drawn = sampling.draws(e, {1: 50, 0: 450}, SEEDS, "y", "event_id")
    return drift.psi_of_draws(e, drawn, SEEDS, ["value"], ["event_type"], ["ts"]).withColumn("psi", F.round("psi", 8))


def stable_seed(spark: SparkSession, d: str) -> DataFrame:
    e = E.events(spark, d).withColumn("y", (F.col("event_id") % 10 == 0).cast("int"))
    found = drift.stable_seed(e, e, {1: 50, 0: 450}, {"numeric": ["value"], "categorical": ["event_type"]}, "y", "event_id", SEEDS[0], len(SEEDS))
    return spark.createDataFrame([found], "seed int, max_psi double, stable boolean").withColumn("max_psi", F.round("max_psi", 8))


def drift_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.drift_table(spark, d).drop("p_value", "sig", "p_method")


def leak_cardinality(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_totalprice") > 150000).cast("int").alias("y"), F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus")
    return profile.leak_by_cardinality(o, "y").select("feature", F.round("v", 8).alias("v"), F.round("cardinality_ratio", 8).alias("cardinality_ratio"), "warning")


def export_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.export(spark, d).drop("Duplicate_Address_CHECK")


SEEDS = (42, 43, 44)

QUERIES = {
    "clean_summary": lambda s, d: R.summary_figures(contacts(s, d), ROLES, COLS),
    "tin_banner": lambda s, d: entity.banner(E.tags(s, d), "100000007"),
    "sample_seed_psi": seeds_psi,
    "sample_stable_seed": stable_seed,
    "str_normalized_keys": normalized_keys,
    "str_labels": labels,
    "clean_rule_filter": lambda s, d: R.failing_rule(contacts(s, d), ROLES, "FORMAT_ISSUE", COLS).select("rid", "phone", "zip", "tin"),
    "clean_issue_filter": lambda s, d: R.filter_issues(C.issue_long(s, d), "Low", "phone"),
    "clean_anomalies": lambda s, d: R.anomaly_totals(contacts(s, d), ROLES, COLS),
    "clean_unfixable": lambda s, d: R.unfixable(contacts(s, d), ROLES),
    "clean_best_worst": lambda s, d: R.best_and_worst(C.quality_raw(s, d)),
    "clean_failed_samples": lambda s, d: R.failed_samples(R.comparison(contacts(s, d), ROLES, ["zip"]), "zip").select("rid", "original", "reason"),
    "clean_html_statistics": statistics,
    "clean_export_columns": export_columns,
    "sample_ranks": ranks,
    "sample_shuffled": shuffled,
    "prof_single_type": single_types,
    "prof_missing_by_type": missing_by_type,
    "prof_display_dates": display_dates,
    "leak_cardinality": leak_cardinality,
    "mid_scatter": lambda s, d: entity.scatter(E.tags(s, d), "100000007").withColumn("is_fraud", F.col("is_fraud").cast("long")),
    "tin_random": lambda s, d: sampling.random_multi_mid_tin(E.keyed(s, d), 5).select("tin", "n"),
    "drift_stats": drift_stats,
    "drift_top_psi": lambda s, d: drift.top_psi(E.drift_table(s, d), 3).select("feature", "psi"),
    "drift_top_categories": lambda s, d: drift.top_categories(E.events(s, d), E.drawn_events(s, d), "event_type", 3).select("cat", F.round("p", 8).alias("p"), F.round("s", 8).alias("s")),
}

CC = f"WITH c AS ({DIRTY_CONTACTS})"
_FORMAT = " OR ".join(f"({C._FLAGS[f'{c}_has_format']})" for c in ("phone", "zip", "tin"))
_TOTAL = {k: " + ".join(C._sum(e) for f, e in C._FLAGS.items() if K.kind_of(f) == k) for k in ("format", "ws", "sc")}


def _chi(key: str) -> str:
    return f"""(SELECT round(sum(pow(a - ta * (a + b) / (ta + tb), 2) / (ta * (a + b) / (ta + tb)) + pow(b - tb * (a + b) / (ta + tb), 2) / (tb * (a + b) / (ta + tb))), 4) FROM (
      SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (SELECT greatest(1.0, count(*) FILTER (WHERE k = 0))::DOUBLE AS a, greatest(1.0, count(*) FILTER (WHERE k = 1))::DOUBLE AS b FROM (SELECT {key} AS c, 0 AS k FROM events UNION ALL SELECT {key}, 1 FROM q) u GROUP BY c) z) w)"""


def _drift() -> str:
    psi = lambda x: f"(SELECT psi FROM ({x}) p)"
    rows = [("value", "numeric", psi(E._psi_num_sql("value")), f"(SELECT ks FROM ({E.SQL['ks_stat'].removeprefix(E.EVENTS).removeprefix(', u AS ').join(['WITH u AS ', ''])}) k)", "KS")]
    rows += [("event_type", "categorical", psi(E._psi_sql("events", "q", "event_type")), _chi("event_type"), "Chi-square")]
    rows += [(f"ts ({n})", "datetime", psi(E._psi_sql("events", "q", e)), _chi(e), "Chi-square") for n, e in (("quarter", "quarter(ts)"), ("weekday", "isodow(ts)"))]
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS type, {p} AS raw_psi, {s} AS raw_stat, '{test}' AS test" for f, t, p, s, test in rows)


_DRIFT = f"{E.EVENTS}, dr AS ({_drift()})"
_VERDICT = "CASE WHEN raw_psi IS NULL THEN 'N/A' WHEN raw_psi <= 0.1 THEN 'Stable' WHEN raw_psi <= 0.2 THEN 'Minor Shift' ELSE 'Critical Shift' END"
_LEAKV = """WITH o AS (SELECT CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS y, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus FROM orders), """
_V = lambda c: f"""SELECT '{c}' AS feature, sqrt(greatest(sum(n * n / (r * k)) - 1, 0) / (least(max(rows), max(cols)) - 1)) AS v, max(rows)::DOUBLE / max(t) AS ratio FROM (
  SELECT n, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS t, (SELECT count(DISTINCT {c}) FROM o) AS rows, (SELECT count(DISTINCT y) FROM o) AS cols FROM (SELECT {c} AS a, y AS b, count(*)::DOUBLE AS n FROM o GROUP BY 1, 2) x) z"""  # noqa: E731
_RANK = "row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey)"
_SCORE = lambda rows: f"(SELECT round_even(avg(score), 1) FROM ({C._score(rows)}) s)"
_HASH = lambda c: f"sha256(CASE WHEN coalesce({c}, '') IN ('nan', 'None') THEN '' ELSE coalesce({c}, '') END)"



def _seeds() -> str:
    """seed, feature, psi of the samples of all seeds."""
    features = {"value": E._psi_num_sql("value"), "event_type": E._psi_sql("events", "q", "event_type")} | {f"ts ({n})": E._psi_sql("events", "q", e) for n, e in (("quarter", "quarter(ts)"), ("weekday", "isodow(ts)"))}
    return " UNION ALL ".join(f"SELECT {s} AS seed, feature, psi FROM ({E.EVENTS.replace('42:', f'{s}:')} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, psi FROM ({x}) x" for f, x in features.items()) + ") y" for s in SEEDS)


SQL = {
    "clean_summary": f"""{CC}, g AS ({C.SQL['clean_global_stats'].removeprefix(C.C)}), f AS (SELECT total_rows, rows_with_issues, good_rows, missing_values_count AS missing_values, (SELECT {' + '.join(C._sum(f"NOT regexp_matches({C._STD[c]}, {chr(39)}{K.CLEAN_SHAPE[c]}{chr(39)})") for c in ("phone", "zip", "tin"))} FROM c)::BIGINT AS unfixable,
      {_SCORE(C._RAW)} AS raw_score, {_SCORE(C._CLEAN)} AS clean_score FROM g) SELECT *, round(clean_score - raw_score, 1) AS improvement, round(rows_with_issues * 100.0::DOUBLE / total_rows, 1) AS issue_pct, round(good_rows * 100.0::DOUBLE / total_rows, 1) AS good_pct FROM f""",
    "tin_banner": f"{E.TAGGED} SELECT count(*) AS record_count, count(DISTINCT nullif(mid, '')) AS n_mid, count(DISTINCT nullif(state, '')) AS n_state, count(DISTINCT nullif(city, '')) AS n_city, coalesce(sum(is_fraud), 0)::BIGINT AS fraud_count FROM t WHERE tin = '100000007'",
    "sample_seed_psi": _seeds(),
    "sample_stable_seed": f"WITH z AS ({_seeds()}), m AS (SELECT seed, max(psi) AS max_psi, max(psi) <= 0.1 AS stable FROM z WHERE feature IN ('value', 'event_type') GROUP BY seed) SELECT * FROM m WHERE seed <= coalesce((SELECT min(seed) FROM m WHERE stable), {SEEDS[-1]}) ORDER BY max_psi, seed LIMIT 1",
    "str_normalized_keys": f"{E.KEYED} SELECT rid, tin AS _tin, mid AS _mid, state AS _state, city AS _city, tin_given AS tin, legal_name, owner_first, postal FROM a",
    "str_labels": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status, round_even(o_totalprice::DOUBLE / 1000, 0) AS price, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS day FROM orders",
    "clean_rule_filter": f"{CC} SELECT rid, phone, zip, tin FROM c WHERE {_FORMAT} ORDER BY rid LIMIT 200",
    "clean_issue_filter": f"{CC} SELECT * FROM ({C._LONG}) x WHERE severity = 'Low' AND feature = 'phone'",
    "clean_anomalies": f"{CC} SELECT *, format_flags + ws_flags + sc_flags AS anomalies FROM (SELECT " + ", ".join(f"({e})::BIGINT AS {k}_flags" for k, e in _TOTAL.items()) + " FROM c) x",
    "clean_unfixable": f"{CC} " + " UNION ALL ".join(f"SELECT '{c}' AS role, ({C._sum(f'NOT regexp_matches({C._STD[c]}, {chr(39)}{K.CLEAN_SHAPE[c]}{chr(39)})')})::BIGINT AS n FROM c" for c in ("phone", "zip", "tin")),
    "clean_best_worst": f"{CC}, q AS ({C._score(C._RAW)}) SELECT * FROM (SELECT 'worst' AS \"end\", col_name, score, missing, invalid FROM q ORDER BY score, col_name LIMIT 1) a UNION ALL SELECT * FROM (SELECT 'best', col_name, score, missing, invalid FROM q ORDER BY score DESC, col_name DESC LIMIT 1) b",
    "clean_failed_samples": f"{CC} SELECT rid, original, reason FROM ({C._COMPARE}) y WHERE resolution = 'Unresolved' AND feature = 'zip' ORDER BY rid LIMIT 10",
    "clean_html_statistics": f"{CC}, g AS ({C.SQL['clean_global_stats'].removeprefix(C.C)}) SELECT round(rows_with_issues * 100.0::DOUBLE / total_rows, 6) AS issue_pct, round(good_rows * 100.0::DOUBLE / total_rows, 6) AS good_pct, round({_SCORE(C._CLEAN)} - {_SCORE(C._RAW)}, 6) AS improvement FROM g",
    "clean_export_columns": f"{CC} SELECT {_HASH('uid')} AS uid_received, lgl_nm AS lgl_nm_received, lgl_nm_std, phone_std, zip_std, tin_std, coalesce(replace(tin_std, '-', ''), '') AS tin_std_no_dash, state_std, country_std, CASE WHEN k <> '' AND count(*) OVER (PARTITION BY k) > 1 THEN 'Yes' ELSE 'No' END AS Duplicate_TIN_CHECK FROM (SELECT *, "
    + ", ".join(f"{C._STD[c]} AS {c}_std" for c in ("lgl_nm", "phone", "zip", "tin", "state", "country")) + f", {Q.tin9(C._STD['tin'])} AS k FROM c) x",
    "sample_ranks": f"SELECT o_orderkey, {_RANK} AS r FROM orders",
    "sample_shuffled": "SELECT o_orderkey FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100",
    "sample_safe": "WITH g AS (SELECT event_type, count(*) AS k, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY event_type) AS rn FROM events GROUP BY 1), f AS (SELECT *, greatest(1, floor(1000.0::DOUBLE * k / t)) AS n FROM g) SELECT event_type, (CASE WHEN t <= 1000 THEN k ELSE n + CASE WHEN rn <= 1000 - (SELECT sum(n) FROM f) THEN 1 ELSE 0 END END)::BIGINT AS n FROM f",
    "prof_single_type": "SELECT unnest(['o_orderkey', 'o_orderstatus', 'country', 'note', 'grade', 'nine']) AS feature, unnest(['numeric', CASE WHEN s = 2 THEN 'binary' ELSE 'categorical' END, 'unknown', 'unknown', 'numeric', 'numeric']) AS single, "
    "unnest(['numeric', CASE WHEN s = 2 THEN 'binary' ELSE 'categorical' END, 'categorical', 'unknown', CASE WHEN g = 2 THEN 'binary' WHEN g >= 3 THEN 'categorical' ELSE 'numeric' END, 'numeric']) AS many FROM (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderkey % 4) AS g FROM orders) x",
    "prof_missing_by_type": f"{CC}, m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature_type, count(*) FILTER (WHERE {c} IS NULL) AS m, count(*) AS n FROM c" for c, k in (("lgl_nm", "text"), ("dba_nm", "text"), ("phone", "code"), ("zip", "code"), ("tin", "code"))) + ") SELECT feature_type, count(*) AS features, sum(m)::BIGINT AS missing, round(avg(m * 100.0::DOUBLE / n), 6) AS mean_pct FROM m GROUP BY 1",
    "prof_display_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1990' END AS day FROM orders",
    "leak_cardinality": f"{_LEAKV} w AS ({_V('key')} UNION ALL {_V('o_orderstatus')}) SELECT feature, round(v, 8) AS v, round(ratio, 8) AS cardinality_ratio, ratio > 0.5 AND v >= 0.9 AS warning FROM w",
    "mid_scatter": f"{E.TAGGED} SELECT mid, state, city, duplicate_tag, is_fraud::BIGINT AS is_fraud FROM t WHERE tin = '100000007'",
    "tin_random": f"{E.KEYED} SELECT tin, count(DISTINCT mid) AS n FROM a WHERE tin <> '' AND mid <> '' GROUP BY tin HAVING count(DISTINCT mid) >= 2 ORDER BY md5('5:' || tin), tin LIMIT 1",
    "drift_stats": f"{_DRIFT} SELECT feature, type, round(raw_psi, 4) AS psi, round(CASE WHEN raw_psi IS NOT NULL THEN raw_stat END, 4) AS stat, test, {_VERDICT} AS verdict FROM dr",
    "drift_top_psi": f"{_DRIFT} SELECT feature, round(raw_psi, 4) AS psi FROM dr WHERE raw_psi IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 3",
    "drift_top_categories": f"{E.EVENTS} SELECT a.cat, round(a.p, 8) AS p, round(coalesce(b.s, 0.0)::DOUBLE, 8) AS s FROM (SELECT event_type AS cat, count(*)::DOUBLE / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1) a LEFT JOIN (SELECT event_type AS cat, count(*)::DOUBLE / (SELECT count(*) FROM q) AS s FROM q GROUP BY 1) b ON a.cat = b.cat ORDER BY p DESC, a.cat LIMIT 3",
}
