"""Queries of the profiling subsystem."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from .cleaning import contacts, table
from .entities import applications
from . import rule_twins
from .fixtures import APPLICATIONS, DIRTY_CONTACTS

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]
MISS = ["lgl_nm", "dba_nm", "phone", "zip", "tin", "state", "country", "business_address"]
A, C = f"WITH a AS ({APPLICATIONS})", f"WITH c AS ({DIRTY_CONTACTS})"


def t(name: str):
    return lambda spark, d: table(spark, d, name)


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def special(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 4 == 0, "N/A").when(F.col("c_custkey") % 4 == 1, "  ").when(F.col("c_custkey") % 4 == 2, "-999").otherwise(F.col("c_mktsegment")).alias("a"),
        (F.col("c_custkey") % 3 - 1).cast("int").alias("b"),
    )
    return P.special_codes(df)


def nulled(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise(F.col("c_mktsegment")).alias("seg"))
    return P.missing_values(P.nulled_special(df, exclude=["c_custkey"])).withColumn("pct", F.round("pct", 6))


def outcome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


_LEAK = "SELECT y, CAST(y AS DOUBLE) AS copy, CASE WHEN o_orderkey % 3 > 0 THEN y END AS gaps, o_custkey AS other, y + 1e-9 AS close, CASE WHEN y = 1 THEN ' 1 ' ELSE '0' END AS texts, CASE WHEN y < 0 THEN y END AS nothing FROM (SELECT *, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS y FROM {o}) o"
_LEAK_COLS = ("copy", "gaps", "other", "close", "texts", "nothing")


def leak(spark: SparkSession, d: str) -> DataFrame:
    return P.leak_exact(spark.sql(_LEAK, o=table(spark, d, "orders")), "y")


def _leak_sql(c: str) -> str:
    exact = "false" if c == "texts" else f"coalesce(bool_and(CASE WHEN {c} IS NOT NULL THEN {c} = y END), false)"
    close = f"lower(trim({c})) = CAST(y AS VARCHAR)" if c == "texts" else f"abs({c} - y) <= 1e-8 + 1e-5 * abs(y)"
    return f"SELECT feature, exact, NOT exact AND close AS near FROM (SELECT '{c}' AS feature, {exact} AS exact, coalesce(bool_and(CASE WHEN {c} IS NOT NULL THEN {close} END), false) AS close FROM l) x"


def determinism(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", (F.col("o_custkey") % 2 == 0).cast("int"))
    return P.leak_determinism(o, "o_custkey", "y")


# A column for every rule of the types, and the kind of each.
_SHAPED = """SELECT 2000 + o_orderkey % 20 AS opened, 40000 + o_orderkey % 900 AS shipped, 199001 + o_orderkey % 9 AS cycle, o_orderkey % 2 AS flag, 10000000 + o_orderkey AS agreement, 'n/a' AS note, 'US' AS country,
  concat('A', CAST(o_orderkey AS STRING)) AS batch_code, concat('oct', CAST(10 + o_orderkey % 15 AS STRING)) AS batch, CAST(CAST(o_orderdate AS DATE) AS STRING) AS ordered, CAST(o_orderkey % 50 AS STRING) AS lane,
  concat('0', CAST(o_orderkey % 50 AS STRING)) AS bay, CAST(NULL AS STRING) AS nothing, '  ' AS spaces, 9 AS nine, o_custkey AS tin_ref, CASE WHEN o_orderkey % 5 = 0 THEN '1d' ELSE CAST(o_orderkey % 70 AS STRING) END AS mixed,
  concat(CAST(1 + o_orderkey % 12 AS STRING), '/', CAST(1 + o_orderkey % 28 AS STRING), '/2020') AS agreed, concat(CAST(1 + o_orderkey % 9 AS STRING), '-Mar-2021') AS closed,
  CASE o_orderkey % 2 WHEN 0 THEN '2020-01-02' ELSE '1/2/2020' END AS two_shapes, concat('2020-13-', CAST(10 + o_orderkey % 9 AS STRING)) AS no_month FROM {o}"""
_KINDS = {
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text"},
    "lineitem": {"l_quantity": "number", "l_discount": "number", "l_returnflag": "text", "l_linenumber": "number"},
    f"({_SHAPED.format(o='orders')}) w": dict.fromkeys(("opened", "shipped", "cycle", "flag", "agreement", "nine", "tin_ref"), "number")
    | dict.fromkeys(("note", "country", "batch_code", "batch", "ordered", "lane", "bay", "nothing", "spaces", "mixed", "agreed", "closed", "two_shapes", "no_month"), "text"),
}


def types(spark: SparkSession, d: str) -> DataFrame:
    """The types of all columns of orders, of some of lineitem, and of a column made for each rule."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    found = P.feature_types(orders) | P.feature_types(items.select(*_KINDS["lineitem"])) | P.feature_types(spark.sql(_SHAPED, o=orders))
    return spark.createDataFrame(sorted(found.items()), "feature string, feature_type string")


_ALERTED = {"tin": "text", "legal_name": "text", "owner_first": "text", "postal": "text", "is_fraud": "number", "fraud_type": "number", "amount": "number"}
_ALERTED_CONTACTS = {"phone": "text", "zip": "text", "state": "text", "country": "text", "day_dt": "text", "agreed": "text", "balance": "number", "one": "number", "uid": "text"}
_CONTACTS = """SELECT phone, zip, state, country, CASE rid % 3 WHEN 0 THEN '2020-01-02' WHEN 1 THEN '1/2/2020' ELSE 'soon' END AS day_dt, CASE rid % 2 WHEN 0 THEN 'Yes' ELSE 'yes' END AS agreed,
  CASE WHEN rid % 400 = 0 THEN -90000.0 ELSE rid % 7 END AS balance, 1 AS one, uid FROM {c}"""


def contact_alerts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.alerts(spark.sql(_CONTACTS, c=contacts(spark, d))), 4, "value")


def biv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.group_stats(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"), 4, "mean", "median")


QUERIES = {
    "prof_missing": lambda s, d: rounded(P.missing_values(contacts(s, d), MISS), 6, "pct"),
    "prof_special_codes": special,
    "prof_nulled_special": nulled,
    "prof_variance": lambda s, d: rounded(P.variance(table(s, d, "lineitem"), NUM), 6, "variance", "std_dev", "value_range"),
    "prof_sparse": lambda s, d: rounded(P.sparse_categories(table(s, d, "customer"), ["c_mktsegment"], 0.2), 8, "dominance"),
    "prof_describe": lambda s, d: rounded(P.describe(table(s, d, "lineitem"), NUM), 6, "mean", "std", "min", "q1", "median", "q3", "max"),
    "prof_mode": lambda s, d: P.modes(table(s, d, "lineitem"), ["l_returnflag", "l_quantity"]),
    "prof_skew": lambda s, d: rounded(P.skewness(table(s, d, "lineitem"), NUM), 8, "skew"),
    "prof_outliers": lambda s, d: rounded(P.outliers(table(s, d, "lineitem"), NUM), 6, "pct"),
    "prof_cardinality": lambda s, d: rounded(P.cardinality(table(s, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"]), 8, "unique_ratio"),
    "prof_value_counts": lambda s, d: P.value_counts(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "prof_duplicate_rows": lambda s, d: P.duplicate_rows(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "prof_alerts": lambda s, d: rounded(P.alerts(applications(s, d).select(*_ALERTED), "is_fraud"), 4, "value"),
    "prof_alerts_formats": contact_alerts,
    "prof_types": types,
    "prof_types_counters": lambda s, d: P.type_counters(table(s, d, "orders"), ["o_custkey", "o_orderstatus"]).select("feature", "rows", "nulls", "numeric", "integral", "n_unique"),
    "corr_pairs": lambda s, d: rounded(P.correlations(table(s, d, "lineitem"), NUM), 8, "correlation", "abs_correlation"),
    "point_biserial": lambda s, d: rounded(P.point_biserial(outcome(s, d), "y", NUM), 8, "r"),
    "cramers_v": lambda s, d: rounded(P.cramers_v(outcome(s, d), "y", ["l_linestatus"]), 8, "v"),
    "cramers_v_corrected": lambda s, d: rounded(P.cramers_v_corrected(outcome(s, d), "l_linestatus", "y"), 6, "chi2", "v"),
    "crosstab": lambda s, d: P.crosstab(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
    "crosstab_pct": lambda s, d: rounded(P.crosstab_percent(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), 6, "pct"),
    "biv_num_cat": biv,
    "biv_trend": lambda s, d: rounded(P.trend(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), 4, "slope", "intercept"),
    "leak_exact": leak,
    "leak_v": lambda s, d: rounded(P.leakage_v(outcome(s, d), "y", CAT), 6, "v"),
    "leak_id_determinism": determinism,
    "feature_quality": lambda s, d: rounded(P.feature_quality(table(s, d, "lineitem").select(*NUM, *CAT)), 6, "missing_rate", "unique_ratio", "diversity_score", "outlier_rate", "quality_score"),
    "chart_histogram": lambda s, d: P.histogram(table(s, d, "orders"), "o_totalprice", 10),
    "chart_box": lambda s, d: rounded(P.box_stats(table(s, d, "orders"), "o_totalprice", "o_orderstatus"), 4, "min", "q1", "median", "q3", "max"),
    "chart_grid": lambda s, d: P.grid_counts(table(s, d, "lineitem"), "l_quantity", "l_discount", 5),
}


def each(f, cols: list[str]) -> str:
    return " UNION ALL ".join(f(c) for c in cols)


def severity(pct: str) -> str:
    return f"CASE WHEN {pct} >= 50 THEN 'Critical' WHEN {pct} >= 20 THEN 'High' WHEN {pct} >= 5 THEN 'Moderate' ELSE 'Low' END"


def strength(r: str, steps: str = "0.5:Very_Strong 0.3:Strong 0.1:Moderate", otherwise: str = "Weak") -> str:
    return "CASE " + " ".join(f"WHEN abs({r}) >= {x.split(':')[0]} THEN '{x.split(':')[1].replace('_', ' ')}'" for x in steps.split()) + f" ELSE '{otherwise}' END"


L = "WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


def _v(col: str) -> str:
    return f"""SELECT '{col}' AS feature, max(t)::BIGINT AS n, CASE WHEN least(max(rows), max(cols)) > 1 THEN sqrt(greatest(sum(o * o / (r * c)) - 1, 0) / (least(max(rows), max(cols)) - 1)) ELSE 0.0 END AS v FROM (
      SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c, sum(o) OVER () AS t, (SELECT count(DISTINCT {col}) FROM l) AS rows, (SELECT count(DISTINCT y) FROM l) AS cols FROM (SELECT {col} AS a, y AS b, count(*)::DOUBLE AS o FROM l GROUP BY 1, 2) x) z"""


def _leak_v(col: str) -> str:
    return f"""SELECT '{col}' AS feature, (SELECT count(*) FROM l) AS n, round(sqrt(greatest(sum(q * k / c - c), 0) / ((SELECT count(*) FROM l) * (least(max(k), count(*)) - 1))), 6) AS v FROM (
      SELECT b, sum(o) AS c, sum(o * o) AS q, (SELECT count(DISTINCT {col}) FROM l) AS k FROM (SELECT {col} AS a, y AS b, count(*)::DOUBLE AS o FROM l GROUP BY 1, 2) x GROUP BY b) z"""


_YATES = """, q AS (SELECT count(*) FILTER (WHERE l_linestatus = 'F' AND y = 0)::DOUBLE AS a, count(*) FILTER (WHERE l_linestatus = 'F' AND y = 1)::DOUBLE AS b, count(*) FILTER (WHERE l_linestatus = 'O' AND y = 0)::DOUBLE AS c, count(*) FILTER (WHERE l_linestatus = 'O' AND y = 1)::DOUBLE AS d, count(*)::DOUBLE AS n FROM l),
  x AS (SELECT n, n * pow(greatest(0.0, abs(a * d - b * c) - n / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM q) SELECT n::BIGINT AS n, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS v FROM x"""


def _quality_num(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'numeric' AS type, miss, uniq, tanh(var / (iqr * iqr + 1e-9)) AS div, (SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * iqr OR {c} > q3 + 1.5 * iqr)::DOUBLE / nn AS outl FROM (
      SELECT (count(*) - count({c}))::DOUBLE / count(*) AS miss, count(DISTINCT {c})::DOUBLE / count({c}) AS uniq, var_samp({c}) AS var, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, greatest(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 1e-9) AS iqr, count({c}) AS nn FROM lineitem) x"""


def _quality_cat(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'categorical' AS type, 0.0::DOUBLE AS miss, max(k)::DOUBLE / max(t) AS uniq, -sum(n / t * ln(n / t + 1e-12)) / greatest(ln(max(k)::DOUBLE), 1e-9) AS div, 0.0::DOUBLE AS outl FROM (SELECT n, sum(n) OVER () AS t, count(*) OVER () AS k FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY {c}) y) x"""


_ALERT_A = "tin legal_name owner_first postal is_fraud fraud_type amount".split()
SQL = {
    "prof_missing": f"{C} " + each(lambda c: f"SELECT '{c}' AS feature, m AS missing, round(m * 100.0 / n, 6)::DOUBLE AS pct, {severity('m * 100.0 / n')} AS severity FROM (SELECT count(*) FILTER (WHERE {c} IS NULL) AS m, count(*) AS n FROM c) x", MISS),
    "prof_special_codes": "WITH d AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'N/A' WHEN c_custkey % 4 = 1 THEN '  ' WHEN c_custkey % 4 = 2 THEN '-999' ELSE c_mktsegment END AS a, CAST(c_custkey % 3 - 1 AS VARCHAR) AS b FROM customer) SELECT 'a' AS feature, CASE WHEN a = 'N/A' THEN 'text' WHEN a = '  ' THEN 'whitespace' ELSE 'code' END AS kind, a AS value, count(*) AS n FROM d WHERE a IN ('N/A', '  ', '-999') GROUP BY a UNION ALL SELECT 'b', 'code', b, count(*) FROM d WHERE b = '-1' GROUP BY b",
    "prof_nulled_special": "SELECT 'c_custkey' AS feature, 0::BIGINT AS missing, 0.0::DOUBLE AS pct, 'Low' AS severity UNION ALL SELECT 'seg', m, round(m * 100.0 / n, 6)::DOUBLE, " + severity("m * 100.0 / n") + " FROM (SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS m, count(*) AS n FROM customer) x",
    "prof_variance": each(lambda c: f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance, round(stddev_samp({c}), 6) AS std_dev, round((max({c}) - min({c}))::DOUBLE, 6) AS value_range, CASE WHEN var_samp({c}) < 0.003 THEN 'Critical' WHEN var_samp({c}) < 0.006 THEN 'High' WHEN var_samp({c}) < 0.01 THEN 'Moderate' END AS severity, CASE WHEN var_samp({c}) = 0 THEN 'constant' WHEN var_samp({c}) < 0.01 THEN 'low' ELSE 'normal' END AS status FROM lineitem", NUM),
    "prof_sparse": "WITH g AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT v, n, n::DOUBLE / (SELECT sum(n) FROM g) AS share FROM g) SELECT 'c_mktsegment' AS feature, count(*) AS categories, count(*) FILTER (WHERE share <= 0.2) AS sparse, (SELECT v FROM s ORDER BY n DESC, v DESC LIMIT 1) AS dominant, round(max(share), 8) AS dominance FROM s",
    "prof_describe": each(lambda c: f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, round(max({c})::DOUBLE, 6) AS max FROM lineitem", NUM),
    "prof_mode": "SELECT * FROM (SELECT 'l_returnflag' AS feature, l_returnflag AS mode, count(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY 3 DESC, 2 LIMIT 1) x",
    "prof_skew": each(lambda c: f"SELECT '{c}' AS feature, round(skewness({c}), 8) AS skew FROM lineitem", NUM),
    "prof_outliers": each(lambda c: f"SELECT '{c}' AS feature, n, o AS outliers, round(o * 100.0::DOUBLE / n, 6) AS pct, CASE WHEN o = 0 THEN 'NONE' WHEN o * 100.0 / n > 5 THEN 'HIGH' WHEN o * 100.0 / n > 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT count({c}) AS n, count(*) FILTER (WHERE {c} < m - 3 * s OR {c} > m + 3 * s) AS o FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem) y) x", NUM),
    "prof_cardinality": each(lambda c: f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c})::DOUBLE / count(*), 8) AS unique_ratio FROM orders", ["o_custkey", "o_orderstatus", "o_orderpriority"]),
    "prof_value_counts": each(lambda c: f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM orders GROUP BY {c}", ["o_orderstatus", "o_orderpriority"]),
    "prof_alerts": rule_twins.alerts(f"SELECT {', '.join(_ALERTED)} FROM ({APPLICATIONS}) w", _ALERTED, "is_fraud"),
    "prof_alerts_formats": rule_twins.alerts(_CONTACTS.format(c=f"({DIRTY_CONTACTS}) w"), _ALERTED_CONTACTS),
    "prof_types": rule_twins.types(_KINDS),
    "prof_duplicate_rows": "SELECT sum(k - 1)::BIGINT AS n_dup FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber) x",
    "prof_types_counters": each(lambda c: f"SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS nulls, count(try_cast({c} AS DOUBLE)) AS numeric, count(*) FILTER (WHERE try_cast({c} AS DOUBLE) = floor(try_cast({c} AS DOUBLE))) AS integral, count(DISTINCT {c}) AS n_unique FROM orders", ["o_custkey", "o_orderstatus"]),
    "corr_pairs": each(lambda p: f"SELECT '{p[0]}' AS feature_1, '{p[1]}' AS feature_2, round(corr({p[0]}, {p[1]}), 8) AS correlation, round(abs(corr({p[0]}, {p[1]})), 8) AS abs_correlation FROM lineitem", list(combinations(NUM, 2))),
    "point_biserial": f"{L} SELECT feature, n, round(r, 8) AS r, {strength('r')} AS strength FROM (" + each(lambda c: f"SELECT '{c}' AS feature, count({c}) AS n, corr({c}, y) AS r FROM l", NUM) + ") x",
    "cramers_v": f"{L} SELECT feature, n, round(v, 8) AS v, {strength('v', '0.5:Very_Strong 0.25:Strong 0.15:Moderate 0.05:Weak', 'Very Weak')} AS strength FROM ({_v('l_linestatus')}) w",
    "cramers_v_corrected": L + _YATES,
    "crosstab": "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "crosstab_pct": "SELECT a, b, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY a), 6) AS pct FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) x",
    "biv_num_cat": "SELECT o_orderpriority AS category, count(*) AS n, round(avg(o_totalprice)::DOUBLE, 4) AS mean, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 4) AS median FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "biv_trend": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem",
    "leak_exact": f"WITH l AS ({_LEAK.format(o='orders')}) " + each(_leak_sql, _LEAK_COLS),
    "leak_v": f"{L} " + each(_leak_v, CAT),
    "leak_id_determinism": "SELECT sum(k)::BIGINT AS n, count(*) AS ids, count(*) FILTER (WHERE k > 1) AS repeated, count(*) FILTER (WHERE k > 1 AND lo = hi) AS single, sum(k) >= 200 AND count(*) FILTER (WHERE k > 1) >= 25 AND count(*) FILTER (WHERE k > 1 AND lo = hi) >= 0.98 * count(*) FILTER (WHERE k > 1) AS deterministic FROM (SELECT count(*) AS k, min(o_custkey % 2) AS lo, max(o_custkey % 2) AS hi FROM orders GROUP BY o_custkey) x",
    "feature_quality": "SELECT feature, type, round(miss, 6) AS missing_rate, round(uniq, 6) AS unique_ratio, round(div, 6) AS diversity_score, round(outl, 6) AS outlier_rate, false AS leakage_flag, round(greatest(0.0, least(1.0, 0.35 * (1 - miss) + 0.2 * CASE WHEN type = 'numeric' THEN 1 - greatest(0.0, least(1.0, (uniq - 0.98) / 0.02)) ELSE exp(-pow((uniq - 0.2) / 0.3, 2)) END + 0.2 * div + 0.1 * (1 - least(outl / 0.1, 1.0)))) * 100, 6)::DOUBLE AS quality_score FROM (" + each(_quality_num, NUM) + " UNION ALL " + each(_quality_cat, CAT) + ") x",
    "chart_histogram": "SELECT CASE WHEN hi > lo THEN least(9, floor((o_totalprice - lo) / (hi - lo) * 10)) ELSE 0 END::INTEGER AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders) s GROUP BY 1",
    "chart_box": "SELECT o_orderstatus AS category, round(min(o_totalprice)::DOUBLE, 4) AS min, round(quantile_cont(o_totalprice::DOUBLE, 0.25), 4) AS q1, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 4) AS median, round(quantile_cont(o_totalprice::DOUBLE, 0.75), 4) AS q3, round(max(o_totalprice)::DOUBLE, 4) AS max FROM orders GROUP BY 1",
    "chart_grid": "SELECT least(4, floor((l_quantity - xl) / (xh - xl) * 5))::INTEGER AS x_bin, least(4, floor((l_discount - yl) / (yh - yl) * 5))::INTEGER AS y_bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity)::DOUBLE AS xl, max(l_quantity)::DOUBLE AS xh, min(l_discount)::DOUBLE AS yl, max(l_discount)::DOUBLE AS yh FROM lineitem) s GROUP BY 1, 2",
}
SQL["prof_mode"] += " UNION ALL SELECT * FROM (SELECT 'l_quantity' AS feature, CAST(l_quantity AS VARCHAR) AS mode, count(*) AS n FROM lineitem GROUP BY l_quantity ORDER BY 3 DESC, 2 LIMIT 1) y"
