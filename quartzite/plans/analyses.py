"""Queries of the façade's analyses and of results whose order, labels or p-values count, each as a table with a place for its order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import drift, report
from ..operators import profile as P
from ..operators.analyzer import Analyzer
from . import cleaning as C
from . import entities as E
from . import reports as R
from . import rule_twins
from .fixtures import APPLICATIONS
from .profiling import _ALERTED, _KINDS, _SHAPED, each, rounded

table = C.table


def small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A result that the façade has already brought to the driver."""
    return spark.createDataFrame(rows, schema)


def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    found = drift.overall_verdict(E.drift_table(spark, d))
    return rounded(found.withColumns({c: F.array_join(c, "; ") for c in ("critical", "minor")}), 6, "mean_psi", "max_psi")


def drift_p_values(spark: SparkSession, d: str) -> DataFrame:
    found = drift.drift_table(E.events(spark, d), E.drawn_events(spark, d), ["value"], ["event_type"], ["ts"], exact_rows=0)
    return found.select("feature", "p_value", "sig", "p_method")


def alerts_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = Analyzer(E.applications(spark, d).select(*_ALERTED), "is_fraud", "WARNING").analyze_data_alerts()["table"]
    return small(spark, [(i, r["severity"], r["feature"], r["alert_type"]) for i, r in enumerate(rows, 1)], "place long, severity string, feature string, alert_type string")


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose types are numeric whatever the table's size."""
    return spark.sql("SELECT l_quantity / 7 AS quantity, l_extendedprice AS price, l_discount + l_quantity / 90 AS discount, l_tax * l_extendedprice AS tax, l_quantity * l_quantity / 3 AS squared FROM {l}", l=table(spark, d, "lineitem"))


_NUMBERS = "SELECT l_quantity / 7 AS quantity, l_extendedprice AS price, l_discount + l_quantity / 90 AS discount, l_tax * l_extendedprice AS tax, l_quantity * l_quantity / 3 AS squared FROM lineitem"
_NAMES = ("quantity", "price", "discount", "tax", "squared")


def correlations_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = Analyzer(numbers(spark, d), log_level="WARNING").analyze_correlations(0.2)["high_correlations"]
    return small(spark, [(i, r["feature_1"], r["feature_2"], round(r["abs_correlation"], 6)) for i, r in enumerate(rows, 1)], "place long, feature_1 string, feature_2 string, r double")


def heat_map_features(spark: SparkSession, d: str) -> DataFrame:
    names = Analyzer(numbers(spark, d), log_level="WARNING").analyze_correlations(0.2, max_features_plot=3)["plot_features"]
    return small(spark, list(enumerate(names, 1)), "place long, feature string")


def shaped(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_SHAPED, o=table(spark, d, "orders"))


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = Analyzer(shaped(spark, d), log_level="WARNING").analyze_feature_types()
    n = found["total_features"]
    return small(spark, [(k, c, round(100 * c / n, 4)) for k, c in found["type_counts"].items()], "feature_type string, features long, pct double")


def type_issues(spark: SparkSession, d: str) -> DataFrame:
    return small(spark, [(r["feature"], r["issue"], r["type"]) for r in Analyzer(shaped(spark, d), log_level="WARNING").report_type_issues()], "feature string, issue string, dtype string")


def columns_by_type(spark: SparkSession, d: str) -> DataFrame:
    types = P.feature_types(shaped(spark, d))
    return small(spark, [(kind, c) for kind in ("datetime", "id", "unknown") for c in P.columns_of_type(types, kind)], "wanted string, feature string")


PAIRS = (("l_quantity", "l_extendedprice"), ("l_discount", "l_returnflag"), ("l_returnflag", "l_linestatus"))


def bivariate(spark: SparkSession, d: str) -> DataFrame:
    """A row per measure of three pairs: two numbers, a number and a category, two categories."""
    found = Analyzer(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"), log_level="WARNING").analyze_bivariate_relationships(PAIRS)
    rows = []
    for pair, r in found.items():
        if r["type"] == "numeric_categorical":
            rows += [(pair, r["type"], f"{k} of {g['category']}", round(float(g[k]), 4)) for g in r["groups"] for k in ("n", "mean", "median")]
        else:
            rows += [(pair, r["type"], k, round(float(v), 4)) for k, v in r.items() if k in ("correlation", "n", "v")]
    return small(spark, rows, "pair string, kind string, measure string, value double")


def health(spark: SparkSession, d: str) -> DataFrame:
    stats = C.QUERIES["clean_global_stats"](spark, d).first().asDict()
    return small(spark, [report.health_note(stats)], "label string, note string")


def day_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest day of a column of dates, and the days between."""
    info = Analyzer(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ordered"), "o_orderkey"), log_level="WARNING").inspect_feature("ordered")["datetime_info"]
    return small(spark, [(str(info["min"]), str(info["max"]), info["days"])], "least string, greatest string, days int")


_OPENED = "SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 08:00:00' WHEN 2 THEN 'soon' END AS opened FROM {o}"


def text_dates_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer by their dates as text, parsed where they can be; what is no date comes last."""
    rows = spark.sql(_OPENED, o=table(spark, d, "orders")).withColumn("at", D.parsed(F.col("opened")))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("at"), "o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("day"), place.alias("place"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over a table with an outcome: rows, columns, the analyses that ran, features of each type."""
    a = Analyzer(E.applications(spark, d).select(*_ALERTED), "is_fraud", "WARNING")
    a.run_all_analyses()
    s = a.get_summary()
    rows = [("rows", str(s["rows"])), ("columns", str(s["columns"])), ("outcome", s["outcome_feature"]), *[("analysis", x) for x in s["analyses"]], ("features", str(sum(s["type_counts"].values())))]
    return small(spark, rows, "name string, value string")


QUERIES = {
    "drift_summary": drift_summary, "drift_p_values": drift_p_values, "alerts_in_order": alerts_in_order, "corr_in_order": correlations_in_order, "corr_heat_map": heat_map_features, "type_distribution": type_distribution,
    "type_issues": type_issues, "type_columns": columns_by_type, "bivariate": bivariate, "health_labels": health, "day_ranges": day_ranges, "text_dates_in_order": text_dates_in_order, "analyzer_summary": summary,
}

_DR = f"{R._DRIFT}, v AS (SELECT feature, type, round(raw_psi, 4) AS psi, {R._VERDICT} AS verdict FROM dr)"
_SHAPED_TABLE = f"({_SHAPED.format(o='orders')}) w"
#: The same with the statistics of chi-square as they are, not rounded.
_RAW = _DR.replace("SELECT round(sum(pow", "SELECT (sum(pow").replace("(ta + tb))), 4) FROM", "(ta + tb)))) FROM")
_LIST = lambda v: f"coalesce(string_agg(feature, '; ' ORDER BY feature) FILTER (WHERE verdict = '{v}'), '')"
_SHAPED_KINDS = _KINDS[_SHAPED_TABLE]
_TYPES = rule_twins.types({_SHAPED_TABLE: _SHAPED_KINDS})
_CORR = f"WITH l AS ({_NUMBERS}), c AS (" + each(lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, abs(corr({p[0]}, {p[1]})) AS r FROM l", list(combinations(_NAMES, 2))) + ")"
# Upper tails: of chi-square by the series of the lower one, of Kolmogorov's distribution by its own.
_CHI_P = "(SELECT 1 - sum(exp(-raw_stat / 2 + (dof / 2.0 + k) * ln(raw_stat / 2) - lgamma(dof / 2.0 + k + 1))) FROM range(0, 400) r(k))"
_KS_P = "(SELECT least(1.0, greatest(0.0, 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * raw_stat * raw_stat * n * m / (n + m))))) FROM range(1, 101) r(k))"
_CATEGORIES = lambda key: f"(SELECT count(DISTINCT {key}) - 1 FROM events)"
_GROUPS = "SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_discount) AS mean, quantile_cont(l_discount::DOUBLE, 0.5) AS median FROM lineitem GROUP BY 1"
_PAIR = [f"{a}_vs_{b}" for a, b in PAIRS]

SQL = {
    "drift_summary": f"{_DR} SELECT round(avg(psi), 6) AS mean_psi, round(max(psi), 6) AS max_psi, {_LIST('Critical Shift')} AS critical, {_LIST('Minor Shift')} AS minor, count(*) AS features, CASE WHEN bool_or(verdict = 'Critical Shift') THEN 'Critical Shift' WHEN bool_or(verdict = 'Minor Shift') THEN 'Minor Shift' ELSE 'Stable' END AS verdict FROM v",
    "drift_p_values": f"""{_RAW}, w AS (SELECT feature, test, raw_stat, CASE feature WHEN 'event_type' THEN {_CATEGORIES('event_type')} WHEN 'ts (quarter)' THEN {_CATEGORIES('quarter(ts)')} WHEN 'ts (weekday)' THEN {_CATEGORIES('isodow(ts)')} END AS dof,
        (SELECT count(value) FROM events)::DOUBLE AS n, (SELECT count(value) FROM q)::DOUBLE AS m FROM dr), p AS (SELECT feature, CASE WHEN test = 'KS' THEN {_KS_P} WHEN dof > 0 THEN {_CHI_P} END AS p FROM w)
        SELECT feature, round(p, 4) AS p_value, CASE WHEN p < 0.05 THEN 'p<0.05' ELSE 'n.s.' END AS sig, CASE WHEN p IS NOT NULL THEN 'asymptotic' END AS p_method FROM p""",
    "alerts_in_order": f"SELECT row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, feature, alert_type) AS place, severity, feature, alert_type FROM ({rule_twins.alerts(f'SELECT {chr(44).join(_ALERTED)} FROM ({APPLICATIONS}) w', _ALERTED, 'is_fraud')}) z",
    "corr_in_order": f"{_CORR} SELECT row_number() OVER (ORDER BY r DESC) AS place, a AS feature_1, b AS feature_2, round(r, 6) AS r FROM c WHERE r >= 0.2",
    "corr_heat_map": f"{_CORR} SELECT * FROM (SELECT row_number() OVER (ORDER BY sum(r) DESC) AS place, feature FROM (SELECT a AS feature, r FROM c UNION ALL SELECT b, r FROM c) x GROUP BY feature) y WHERE place <= 3",
    "type_distribution": f"SELECT feature_type, count(*) AS features, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM ({_TYPES}) t GROUP BY feature_type",
    "type_issues": f"WITH w AS (SELECT * FROM {_SHAPED_TABLE}) " + each(lambda c: f"SELECT * FROM (SELECT '{c}' AS feature, 'EXCEL_SERIAL_DATE' AS issue, lower(any_value(typeof({c}))) AS dtype, count(*) FILTER (WHERE {c} BETWEEN 20000 AND 60000) > 0.8 * count({c}) AND count(DISTINCT {c}) > 1 AS serial FROM w) x WHERE serial".replace("SELECT * FROM (", "SELECT feature, issue, dtype FROM ("), [c for c, k in _SHAPED_KINDS.items() if k == "number"]),
    "type_columns": f"SELECT feature_type AS wanted, feature FROM ({_TYPES}) t WHERE feature_type IN ('datetime', 'id', 'unknown')",
    "bivariate": f"""SELECT '{_PAIR[0]}' AS pair, 'numeric_numeric' AS kind, 'correlation' AS measure, round(corr(l_quantity, l_extendedprice), 4) AS value FROM lineitem UNION ALL SELECT '{_PAIR[0]}', 'numeric_numeric', 'n', count(*)::DOUBLE FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
        UNION ALL {each(lambda k: f"SELECT '{_PAIR[1]}', 'numeric_categorical', '{k} of ' || g, round({k}, 4) FROM ({_GROUPS}) x", ['n', 'mean', 'median'])}
        UNION ALL SELECT '{_PAIR[2]}', 'categorical_categorical', 'n', count(*)::DOUBLE FROM lineitem
        UNION ALL SELECT '{_PAIR[2]}', 'categorical_categorical', 'v', round(sqrt(sum(o * o / (r * c)) - 1), 4) FROM (SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2) x) y""",
    "health_labels": f"WITH g AS ({C.SQL['clean_global_stats']}), h AS (SELECT *, 100.0::DOUBLE * rows_with_issues / greatest(1, total_rows) AS pct FROM g), l AS (SELECT *, CASE WHEN pct < 20 THEN 'Strong' WHEN pct < 50 THEN 'Moderate' ELSE 'Weak' END AS label FROM h) SELECT label, label || ': ' || format('{{:,}}', rows_with_issues) || ' of ' || format('{{:,}}', total_rows) || ' rows (' || printf('%.1f', pct) || ' %) have at least one issue.' AS note FROM l",
    "day_ranges": "SELECT CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS least, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS greatest, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)))::INTEGER AS days FROM orders",
    "text_dates_in_order": f"WITH o AS ({_OPENED.format(o='orders')}), p AS (SELECT *, coalesce(try_strptime(opened, '%Y-%m-%d'), try_strptime(opened, '%Y-%m-%d %H:%M:%S')) AS ts FROM o) SELECT o_custkey, o_orderkey, strftime(ts, '%Y-%m-%d %H:%M:%S') AS day, (row_number() OVER (PARTITION BY o_custkey ORDER BY ts NULLS LAST, o_orderkey))::INTEGER AS place FROM p",
    "analyzer_summary": f"SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM ({APPLICATIONS}) w UNION ALL SELECT * FROM (VALUES ('columns', '{len(_ALERTED)}'), ('outcome', 'is_fraud'), ('features', '{len(_ALERTED)}'), "
    + ", ".join(f"('analysis', '{x}')" for x in ("feature_types", "missing_values", "low_variance", "sparse_categorical", "correlations", "outcome_correlation", "leakage_risk", "feature_quality", "data_alerts")) + ") v(name, value)",
}
