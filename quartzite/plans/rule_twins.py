"""DuckDB twins of the rule tables of profiling: types and alerts of columns, from one long table of all values."""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..functions import numbers as N
from ..operators import profile as P


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _long(kinds: Mapping[str, str], table: str) -> str:
    """feature, kind (number, date or text), v, x (the number, if it is one) of every row and column."""
    number = f"CASE WHEN regexp_matches(v, '{N.NUMERIC}') THEN try_cast(v AS DOUBLE) END"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, '{kind}' AS kind, CAST({c} AS VARCHAR) AS v, " + (f"CAST({c} AS DOUBLE)" if kind == "number" else "NULL") + f" AS y FROM {table}" for c, kind in kinds.items())
    return f"SELECT feature, kind, v, CASE WHEN kind = 'number' THEN y ELSE {number} END AS x FROM ({rows}) z"


def _names(c: str) -> str:
    """What the identifier rules see in a column's name."""
    part, word = any(p in c for p in P.ID_PARTS), bool(set(re.split(r"[_. ]", c)) & set(P.ID_WORDS))
    return f"SELECT '{c}' AS feature, {part} AS part, {word} AS word, {c.startswith(P.ID_FAMILIES) or c.endswith(P.ID_FAMILIES)} AS family"


def types(parts: Mapping[str, Mapping[str, str]]) -> str:
    """feature, feature_type of ``{table or (query): {column: kind}}``."""
    values = " UNION ALL ".join(_long(kinds, table) for table, kinds in parts.items())
    names = " UNION ALL ".join(_names(c) for kinds in parts.values() for c in kinds)
    whole = "x = floor(x)"
    lengths = ", ".join(f"count(*) FILTER (WHERE {whole} AND abs(x) >= 1e{k - 1} AND abs(x) < 1e{k})" for k in range(7, 19))
    dates = ", ".join(f"count(*) FILTER (WHERE regexp_matches(v, '{p}'))" for p in P.DATE_TEXTS)
    return rf"""WITH l AS ({values}), names AS ({names}),
c AS (SELECT feature, any_value(kind) AS kind, count(*) AS m, count(v) AS n, count(DISTINCT v) AS k, count(DISTINCT v)::DOUBLE / count(*) AS ratio,
  count(*) FILTER (WHERE trim(v) = '') AS blanks, count(x) AS numeric, count(*) FILTER (WHERE {whole}) AS integral, count(*) FILTER (WHERE x BETWEEN 20000 AND 60000) AS serial,
  count(*) FILTER (WHERE regexp_matches(v, '^0\d+')) AS zero, greatest({dates}) AS dated, count(*) FILTER (WHERE regexp_matches(lower(v), '{P.DATE_TOKENS}')) AS token,
  count(*) FILTER (WHERE lower(trim(v)) IN ({_quoted(P.CONSTANT_STAND_INS)})) AS stand_in, greatest({lengths}) AS same, median(abs(x)) AS mid, max(abs(x)) AS size,
  count(*) FILTER (WHERE {whole} AND x BETWEEN 1900 AND 2100) AS years, max(x) FILTER (WHERE x BETWEEN 1900 AND 2100) - min(x) FILTER (WHERE x BETWEEN 1900 AND 2100) AS span,
  count(*) FILTER (WHERE {whole} AND floor(x / 100) BETWEEN 1900 AND 2100 AND x % 100 BETWEEN 1 AND 12) AS ym,
  count(*) FILTER (WHERE {whole} AND floor(x / 10000) BETWEEN 1 AND 12 AND x % 10000 BETWEEN 1900 AND 2100) AS my FROM l GROUP BY feature)
SELECT feature, CASE
  WHEN n = 0 OR blanks = n THEN 'unknown' WHEN kind = 'date' THEN 'datetime'
  WHEN kind = 'number' AND k > 1 AND (serial > 0.8 * n OR (years > 0.8 * n AND span BETWEEN 1 AND 150) OR ym > 0.8 * n OR my > 0.8 * n) THEN 'datetime'
  WHEN kind = 'text' AND (dated = n OR token > 0.8 * n) THEN 'datetime'
  WHEN kind = 'text' AND k = 1 AND stand_in = n THEN 'unknown'
  WHEN (part AND ratio > 0.8) OR (word AND ratio > 0.05) OR (family AND ratio > 0.05) THEN 'id'
  WHEN kind = 'number' AND k > 10 AND integral = n AND ((mid >= 1e6 AND ratio > 0.02) OR (mid >= 1e9 AND ratio > 0.01) OR (same >= 0.9 * n AND ratio > 0.02)) THEN 'id'
  WHEN k = 2 THEN 'binary'
  WHEN kind = 'number' THEN CASE WHEN k BETWEEN 3 AND 10 AND integral = n AND size <= 100 THEN 'categorical' ELSE 'numeric' END
  WHEN numeric > 0.8 * n AND zero <= 0.05 * n AND ratio <= 0.95 THEN 'numeric' ELSE 'categorical' END AS feature_type
FROM c JOIN names USING (feature)"""


def alerts(source: str, kinds: Mapping[str, str], outcome: str | None = None, places: int = 4) -> str:
    """feature, alert_type, severity, value of the columns of the query ``source``."""
    shapes = {c: P.format_of(c) for c, kind in kinds.items() if kind == "text" and P.format_of(c)}
    count = lambda c, kind: " + ".join(f"(count(*) FILTER (WHERE regexp_matches({c}, '{p}')) > 0)::INT" for p in P.FORMATS[kind])
    other = lambda c: " + (count({0}) > {1})::INT".format(c, " + ".join(f"count(*) FILTER (WHERE regexp_matches({c}, '{p}'))" for p in P.FORMATS["phone"]))
    formats = [f"SELECT '{c}' AS feature, '{k}' AS shape, {count(c, k)}{other(c) if k == 'phone' else ''} AS formats FROM src" for c, k in shapes.items()]
    formats.append("SELECT '' AS feature, NULL AS shape, 0 AS formats")
    flat, live = "nn > 0 AND k = 1", "nn > 0 AND k <> 1"
    number, text = "kind = 'number'", "kind = 'text'"
    rules = [
        ("HIGH MISSING", "missing * 100.0::DOUBLE / m", "CASE WHEN missing >= 0.5 * m THEN 'HIGH' WHEN missing >= 0.2 * m THEN 'MEDIUM' END"),
        ("MIXED TYPE", "digits", f"CASE WHEN {text} AND digits > 0 AND digits < nn THEN 'HIGH' END"),
        ("CONSTANT", "k", f"CASE WHEN {flat} THEN 'HIGH' END"),
        ("NEAR CONSTANT", "top * 100.0::DOUBLE / nn", f"CASE WHEN {live} AND top >= 0.99 * nn THEN 'MEDIUM' END"),
        ("ZEROS DOMINANT", "zeros * 100.0::DOUBLE / nn", f"CASE WHEN {live} AND {number} AND zeros >= 0.9 * nn THEN 'MEDIUM' END"),
        ("SKEWED", "skew", f"CASE WHEN {live} AND {number} AND abs(skew) > 5 THEN 'HIGH' WHEN {live} AND {number} AND abs(skew) > 2 THEN 'MEDIUM' END"),
        ("OUTLIERS", "outliers * 100.0::DOUBLE / nn", f"CASE WHEN {live} AND {number} AND outliers > 0 THEN CASE WHEN outliers > 0.05 * nn THEN 'HIGH' WHEN outliers > 0.01 * nn THEN 'MEDIUM' ELSE 'LOW' END END"),
        ("NEGATIVE VALUES", "negative", f"CASE WHEN {live} AND {number} AND negative > 0 THEN 'LOW' END"),
        ("UNIQUE", "k", f"CASE WHEN {live} AND k = nn AND nn > 50 THEN 'MEDIUM' END"),
        ("HIGH CARDINALITY", "k * 100.0::DOUBLE / nn", f"CASE WHEN {live} AND {text} AND k >= 0.5 * nn AND k < nn AND k > 50 THEN 'MEDIUM' END"),
        ("FORMAT INCONSISTENCY", "formats", f"CASE WHEN {live} AND {text} AND formats > 1 THEN CASE shape WHEN 'phone' THEN 'HIGH' WHEN 'date' THEN 'MEDIUM' END END"),
        ("FORMAT INCONSISTENCY", "by_case", f"CASE WHEN {live} AND {text} AND shape IS NULL AND by_case > 0 THEN 'LOW' END"),
    ]
    if outcome:
        rules.append(("IMBALANCED TARGET", "least * 100.0::DOUBLE / nn", f"CASE WHEN feature = '{outcome}' AND least < 0.05 * nn THEN 'HIGH' WHEN feature = '{outcome}' AND least < 0.15 * nn THEN 'MEDIUM' END"))
    found = " UNION ALL ".join(f"SELECT feature, '{name}' AS alert_type, {severity} AS severity, round(({value})::DOUBLE, {places}) AS value FROM a" for name, value, severity in rules)
    return f"""WITH src AS ({source}), l AS ({_long(kinds, 'src')}),
f AS (SELECT feature, count(*) AS k, max(n) AS top, min(n) AS least, count(*) - count(DISTINCT lower(v)) AS by_case FROM (SELECT feature, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY feature, v) q GROUP BY feature),
c AS (SELECT feature, any_value(kind) AS kind, count(*) AS m, count(*) - count(v) AS missing, count(v) AS nn, count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x < 0) AS negative,
  count(x) AS digits, avg(x) AS mean, stddev_samp(x) AS sd FROM l GROUP BY feature),
s AS (SELECT feature, skewness(x) AS skew FROM l WHERE kind = 'number' GROUP BY feature HAVING count(DISTINCT x) > 1),
o AS (SELECT l.feature, count(*) FILTER (WHERE abs(x - mean) > 3 * sd) AS outliers FROM l JOIN c ON l.feature = c.feature GROUP BY l.feature),
shapes AS ({' UNION ALL '.join(formats)}),
a AS (SELECT c.*, coalesce(f.k, 0) AS k, f.top, f.least, f.by_case, s.skew, o.outliers, shapes.shape, coalesce(shapes.formats, 0) AS formats FROM c LEFT JOIN f ON c.feature = f.feature LEFT JOIN s ON c.feature = s.feature
  LEFT JOIN o ON c.feature = o.feature LEFT JOIN shapes ON c.feature = shapes.feature)
SELECT * FROM ({found}) r WHERE severity IS NOT NULL
UNION ALL SELECT '(dataset)', 'DUPLICATE ROWS', 'HIGH', round(d::DOUBLE, {places}) FROM (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM src GROUP BY {', '.join(kinds)}) g) h WHERE d > 0"""
