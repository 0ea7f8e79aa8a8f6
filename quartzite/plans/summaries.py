"""Queries of density charts, wide correlations, sketches and bounded aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, date_formats, gram, heads, sketches
from .cleaning import contacts, table
from .fixtures import DIRTY_CONTACTS
from .profiling import each, rounded

#: Columns with gaps of their own and a mean far above their spread.
WIDE = {f"w{k}": f"CASE WHEN (l_orderkey + {k}) % {k + 3} <> 0 THEN 1e6 + l_quantity * {k % 5} + l_extendedprice * {(k % 7) / 1e4!r} + l_linenumber * {k % 3 + 1} END" for k in range(24)}
_WIDE = f"SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in WIDE.items())} FROM {{l}}"


def wide(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_WIDE, l=table(spark, d, "lineitem"))


SKETCHED, PROBS = ("l_quantity", "l_extendedprice", "l_discount"), (0.01, 0.25, 0.5, 0.9)


def quantile_errors(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of merged sketches of three parts against the rows: whether each is within the rank error."""
    items = table(spark, d, "lineitem")
    found = sketches.sketch_quantiles(sketches.quantile_sketches(items, SKETCHED, F.col("l_returnflag")), PROBS)
    n = {r.feature: r for r in found.collect()}  # a row per column
    pairs = [(c, i) for c in SKETCHED for i in range(len(PROBS))]
    counted = items.agg(*[x for j, (c, i) in enumerate(pairs) for x in (F.count_if(F.col(c) < n[c].q[i]).alias(f"b{j}"), F.count_if(F.col(c) <= n[c].q[i]).alias(f"u{j}"))])
    row = lambda j, c, i: F.struct(F.lit(c).alias("feature"), F.lit(PROBS[i]).alias("prob"), F.lit(n[c].n).alias("n"), F.col(f"b{j}").alias("b"), F.col(f"u{j}").alias("u"))
    rows = counted.select(F.explode(F.array(*[row(j, c, i) for j, (c, i) in enumerate(pairs)])).alias("r")).select("r.*")
    room = sketches.rank_error()
    return rows.select("feature", "prob", "n", ((F.col("b") / F.col("n") <= F.col("prob") + room) & (F.col("u") / F.col("n") >= F.col("prob") - room)).alias("within"))


COUNTED = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")


def distinct_errors(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts, and whether the sketches' are within their bounds: of a table, and of the union and overlap with a third of it."""
    items = table(spark, d, "lineitem")
    third = items.filter("l_orderkey % 3 = 0")
    exact = items.agg(*[x for c in COUNTED for x in (F.countDistinct(c).alias(c), F.countDistinct(F.when(F.col("l_orderkey") % 3 == 0, F.col(c))).alias(f"{c}_third"))])
    known = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n"), F.col(f"{c}_third").alias("m")) for c in COUNTED])).alias("r")).select("r.*")
    one = sketches.distinct_counts(items, COUNTED).withColumnRenamed("bound", "hll_bound")
    both = sketches.overlap(sketches.theta_sketches(items, COUNTED), sketches.theta_sketches(third, COUNTED))
    near = lambda a, b, room: F.abs(F.col(a) - F.col(b)) <= room
    room = F.col("bound") * F.col("n")
    out = known.join(one, "feature").join(both, "feature")
    return out.select("feature", F.col("n").alias("n_unique"), F.col("m").alias("n_third"), near("n_unique", "n", F.col("hll_bound") * F.col("n")).alias("hll"), near("n_union", "n", room).alias("union"), near("n_both", "m", room).alias("overlap"))


FREQUENT = ("l_returnflag", "l_quantity", "l_partkey", "l_orderkey")

_DAY, _MONTH, _YEAR = (f"CAST({p}(o_orderdate) AS STRING)" for p in ("day", "month", "year"))
#: Columns of dates in one format, in two, and of none.
DATED = {
    "iso": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "stamped": "CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 10:15:00'", "digits": "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING)",
    "month_first": f"{_MONTH} || '/' || {_DAY} || '/' || {_YEAR}", "day_first": f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}", "either": f"CAST(1 + o_orderkey % 12 AS STRING) || '-' || {_MONTH} || '-' || {_YEAR}",
    "dotted": f"' ' || {_DAY} || '.' || {_MONTH} || '.' || {_YEAR} || ' '", "named": f"{_DAY} || '-Mar-' || {_YEAR}", "gaps": f"CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'Jan ' || {_DAY} || ', 2020' END",
    "mixed": f"CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE {_MONTH} || '/' || {_DAY} || '/' || {_YEAR} END", "thirteen": f"'13/13/' || {_YEAR}", "words": "o_orderpriority", "nothing": "CAST(NULL AS STRING)",
}
_DATED = f"SELECT {', '.join(f'{e} AS {c}' for c, e in DATED.items())} FROM {{o}}"


def formats(spark: SparkSession, d: str) -> DataFrame:
    found = date_formats.date_formats(spark.sql(_DATED, o=table(spark, d, "orders")))
    return found.withColumn("formats", F.array_join("formats", "; "))


#: The formats in the other engine's letters.
_STRPTIME = {"yyyy": "%Y", "MMM": "%b", "MM": "%m", "dd": "%d", "HH:mm:ss": "%H:%M:%S"}


def _strptime(name: str) -> str:
    for ours, theirs in _STRPTIME.items():
        name = name.replace(ours, theirs)
    return name


def _formats_sql(c: str) -> str:
    fits = [rf"bool_and(regexp_matches(v, '{shape}') AND try_strptime(v, '{_strptime(name)}') IS NOT NULL) AS f{i}" for i, (name, shape, _) in enumerate(date_formats.FORMATS)]
    names = ", ".join(f"CASE WHEN f{i} THEN '{name}' END" for i, (name, _, _) in enumerate(date_formats.FORMATS))
    place = {name: i for i, (name, _, _) in enumerate(date_formats.FORMATS)}
    both = " OR ".join(f"coalesce(f{place[a]} AND f{place[b]}, false)" for a, b in date_formats.ORDERS)
    return f"""SELECT '{c}' AS feature, n, array_to_string(names, '; ') AS formats, names[1] AS format, ambiguous FROM (
      SELECT n, list_filter([{names}], lambda x: x IS NOT NULL) AS names, {both} AS ambiguous FROM (SELECT count(*) AS n, {', '.join(fits)} FROM (SELECT trim({c}) AS v FROM d WHERE trim({c}) <> '') x) y) z"""


HEADS = ("lgl_nm", "phone", "zip", "state")

QUERIES = {
    "prof_date_formats": formats,
    "prof_first_values": lambda s, d: heads.first_values(contacts(s, d), 7, HEADS),
    "chart_violin": lambda s, d: rounded(rounded(charts.violin(table(s, d, "orders"), "o_totalprice", "o_orderpriority"), 4, "mean", "median", "x"), 14, "density"),
    "chart_hexbin": lambda s, d: rounded(charts.hexbin(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "x", "y"),
    "corr_blocks": lambda s, d: rounded(gram.correlations(wide(s, d), list(WIDE)), 6, "correlation", "abs_correlation"),
    "sketch_quantiles": quantile_errors,
    "sketch_distinct": distinct_errors,
    "heavy_hitters": lambda s, d: sketches.heavy_hitters(table(s, d, "lineitem"), FREQUENT, 3, counters=256),
}

SQL = {
    "prof_date_formats": f"WITH d AS ({_DATED.format(o='orders')}) " + each(_formats_sql, DATED),
    "prof_first_values": f"WITH c AS ({DIRTY_CONTACTS}) " + each(lambda c: f"SELECT * FROM (SELECT '{c}' AS feature, (row_number() OVER (ORDER BY rid))::INTEGER AS place, rid, {c} AS value FROM c WHERE {c} IS NOT NULL) x WHERE place <= 7", HEADS),
    "chart_violin": """
        WITH r AS (SELECT o_orderpriority AS category, o_totalprice::DOUBLE AS v FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
        s AS (SELECT category, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi FROM r GROUP BY category ORDER BY n DESC, category LIMIT 10),
        b AS (SELECT r.category, least(2047, floor((v - lo) / (hi - lo) * 2048)) AS bin, count(*) AS k, avg(v) AS center FROM r JOIN s ON r.category = s.category GROUP BY 1, 2),
        p AS (SELECT *, lo + (hi - lo) * point / 99 AS x, std * pow(n::DOUBLE, -0.2) AS width FROM (SELECT *, unnest(range(100)) AS point FROM s) y)
        SELECT p.category, n, round(mean, 4) AS mean, round(median, 4) AS median, point::INTEGER AS point, round(x, 4) AS x, round(sum(k * exp(-pow((x - center) / width, 2) / 2) / (n * width * sqrt(2 * pi()))), 14) AS density
        FROM p JOIN b ON p.category = b.category GROUP BY p.category, n, mean, median, point, x
    """,
    "chart_hexbin": """
        WITH r AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
        e AS (SELECT min(a) - (max(a) - min(a)) * 1e-9 AS xl, max(a) + (max(a) - min(a)) * 1e-9 AS xh, min(b) - (max(b) - min(b)) * 1e-9 AS yl, max(b) + (max(b) - min(b)) * 1e-9 AS yh FROM r),
        s AS (SELECT xl, (xh - xl) / 30 AS sx, yl, (yh - yl) / 17 AS sy FROM e),
        g AS (SELECT (a - xl) / sx AS i, (b - yl) / sy AS j FROM r, s),
        c AS (SELECT pow(i - round_even(i, 0), 2) + 3 * pow(j - round_even(j, 0), 2) < pow(i - (floor(i) + 0.5), 2) + 3 * pow(j - (floor(j) + 0.5), 2) AS first, i, j FROM g),
        k AS (SELECT CASE WHEN first THEN round_even(i, 0) ELSE floor(i) + 0.5 END AS p, CASE WHEN first THEN round_even(j, 0) ELSE floor(j) + 0.5 END AS q, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT round(xl + p * sx, 6) AS x, round(yl + q * sy, 6) AS y, n FROM k, s
    """,
    "corr_blocks": f"WITH w AS ({_WIDE.format(l='lineitem')}) " + each(lambda p: f"SELECT '{p[0]}' AS feature_1, '{p[1]}' AS feature_2, round(corr({p[0]}, {p[1]}), 6) AS correlation, round(abs(corr({p[0]}, {p[1]})), 6) AS abs_correlation FROM w", list(combinations(WIDE, 2))),
    "sketch_quantiles": each(lambda c: f"SELECT '{c}' AS feature, prob::DOUBLE AS prob, n, true AS within FROM (SELECT count({c}) AS n FROM lineitem) x, (VALUES {', '.join(f'({p})' for p in PROBS)}) v(prob)", SKETCHED),
    "sketch_distinct": each(lambda c: f'SELECT \'{c}\' AS feature, count(DISTINCT {c}) AS n_unique, count(DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN {c} END) AS n_third, true AS hll, true AS "union", true AS overlap FROM lineitem', COUNTED),
    "heavy_hitters": each(lambda c: f"SELECT * FROM (SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)))::INTEGER AS rank FROM lineitem GROUP BY 2) x WHERE rank <= 3", FREQUENT),
}
