"""Queries of the cleaning subsystem over the view of dirty contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import strings as S
from ..operators import clean as K
from ..operators import report as R
from . import sql as Q
from .fixtures import DIRTY_CONTACTS

COLS = ["lgl_nm", "dba_nm", "phone", "zip", "tin", "state", "country", "business_address", "uid"]
ROLES = {"company_name_lgl_nm": "lgl_nm", "dba_dba_nm": "dba_nm", "phone_phone": "phone", "zip_zip": "zip", "tin_tin": "tin", "state_state": "state", "country_country": "country", "address_business_address": "business_address"}
C = f"WITH c AS ({DIRTY_CONTACTS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_CONTACTS.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, sf_dir, "customer")))


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table over as many tasks as run at once: a file of a few MB is one task, however much work its rows are."""
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


QUERIES: dict = {}
SQL: dict = {}


def scalar(name: str, cols: dict) -> None:
    """A query of text functions over the contacts: {alias: (Column builder, SQL builder, column)}."""
    QUERIES[name] = lambda spark, d: contacts(spark, d).select("rid", *[f(F.col(c)).alias(a) for a, (f, _, c) in cols.items()])
    SQL[name] = f"{C} SELECT rid, {', '.join(f'{s(c)} AS {a}' for a, (_, s, c) in cols.items())} FROM c"


scalar("str_phone_issue", {"phone_issue": (S.phone_issue, Q.phone_issue, "phone")})
scalar("str_zip_issue", {"zip_issue": (S.zip_issue, Q.zip_issue, "zip")})
scalar("str_tin_issue", {"tin_issue": (S.tin_issue, Q.tin_issue, "tin")})
scalar("str_phone_std", {"phone_std": (S.standardize_phone, Q.phone, "phone")})
scalar("str_zip_std", {"zip_std": (S.standardize_zip, Q.zip_, "zip")})
scalar("str_tin_std", {"tin_std": (S.standardize_tin, Q.tin, "tin")})
scalar("str_tin9", {"tin9": (S.tin_digits, Q.tin9, "tin")})
scalar("str_state_std", {"state_std": (S.standardize_state, Q.state, "state")})
scalar("str_country_std", {"country_std": (S.standardize_country, Q.country, "country")})
scalar("str_entity_norm", {"entity": (S.entity_key, Q.entity, "lgl_nm")})
scalar("str_match_key", {"k1": (S.match_key, Q.key, "lgl_nm"), "k2": (S.match_key, Q.key, "dba_nm")})
scalar("str_address_type", {"kind": (S.address_type, Q.address_type, "business_address")})
scalar("str_name_std", {"lgl_std": (S.standardize_name, Q.name, "lgl_nm"), "dba_std": (S.standardize_name, Q.name, "dba_nm")})
scalar("str_uid_sha256", {"uid_sha256": (S.hashed_id, lambda c: f"sha256(CASE WHEN coalesce({c}, '') IN ('nan', 'None') THEN '' ELSE coalesce({c}, '') END)", "uid")})
scalar("str_trim_if_content", {"v": (S.trim_if_content, lambda c: f"CASE WHEN {Q.strip(c)} <> '' THEN {Q.strip(c)} ELSE {c} END", "lgl_nm")})
scalar("str_contact_clean", {"v": (S.clean_text, Q.clean, "lgl_nm"), "missing": (S.is_missing, Q.missing, "dba_nm")})
scalar("str_no_dash", {"v": (S.without_dashes, lambda c: f"replace({c}, '-', '')", "tin")})


def whitespace_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.has_whitespace_issue(F.col("text")).alias("flag"))


def special_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.has_special_chars(F.col("text")).alias("flag"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(S.clean_text(F.col("text")).cast("binary")).alias("digest"))


def composite_key(spark: SparkSession, d: str) -> DataFrame:
    return contacts(spark, d).select("rid", S.composite_key(F.col("lgl_nm"), F.col("zip"), F.col("tin")).alias("k"))


def tags_distinct(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws(",", F.when(S.is_missing(F.col("phone")), "MISSING_VALUE"), F.when(S.is_missing(F.col("zip")), "MISSING_VALUE"), F.when(S.has_special_chars(F.col("lgl_nm")), "SPECIAL_CHARS"))
    return contacts(spark, d).select("rid", S.distinct_tags(raw).alias("tags"))


def pipe_split(spark: SparkSession, d: str) -> DataFrame:
    df = K.with_address_parts(contacts(spark, d), F.col("business_address"), F.col("lgl_nm"), F.col("dba_nm"), False, "part_")
    return df.select("rid", *[F.col(f"part_{p}").alias(p) for p in ("city", "region", "zip_code", "country")], F.size(F.split("business_address", r"\|", -1)).cast("long").alias("n_parts"))


def pipe_parse(spark: SparkSession, d: str) -> DataFrame:
    df = K.with_parsed_address(contacts(spark, d), "business_address", "lgl_nm", "dba_nm")
    return df.select("rid", *[f"{p}_std" for p in K.PARTS])


def pipe_exact(spark: SparkSession, d: str) -> DataFrame:
    """The parts by equal names only, which is the native form."""
    df = K.with_address_parts(contacts(spark, d), F.col("business_address"), F.col("lgl_nm"), F.col("dba_nm"), False, "part_")
    return df.select("rid", *[F.col(f"part_{p}").alias(p) for p in K.PARTS])


def issue_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = K.issue_matrix(contacts(spark, d), ROLES, COLS)
    return m.select("rid", "_has_issue", "_issue_tags", "lgl_nm_has_ws", "lgl_nm_has_sc", "dba_nm_is_missing", "phone_has_format", "zip_has_format", "tin_has_format")


def issue_long(spark: SparkSession, d: str) -> DataFrame:
    return R.issues_long(contacts(spark, d), ROLES, COLS)


def issue_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.issue_totals(issue_long(spark, d))


def compare(spark: SparkSession, d: str) -> DataFrame:
    return R.comparison(contacts(spark, d), ROLES, ["lgl_nm", "phone", "zip", "tin", "state"])


def unresolved(spark: SparkSession, d: str) -> DataFrame:
    return R.unresolved(compare(spark, d))


def compare_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(compare(spark, d), resolution="Unresolved", pattern="abc|555")


def export(spark: SparkSession, d: str) -> DataFrame:
    df = contacts(spark, d).drop("rid")
    return R.export(df, ROLES).select("uid_received", "lgl_nm_received", "lgl_nm_std", "phone_std", "zip_std", "tin_std", "tin_std_no_dash", "state_std", "country_std", "Duplicate_TIN_CHECK", "Duplicate_Address_CHECK")


def dup_tin(spark: SparkSession, d: str) -> DataFrame:
    df = contacts(spark, d).select("rid", S.tin_digits(F.col("tin")).alias("tin9"))
    return K.duplicate_flag(df, [F.col("tin9")], "Duplicate_TIN_CHECK")


def dup_address(spark: SparkSession, d: str) -> DataFrame:
    df = K.with_parsed_address(contacts(spark, d), "business_address", "lgl_nm", "dba_nm")
    out = K.duplicate_flag(df, [S.match_key(F.col("address_1_std")), S.match_key(S.standardize_zip(F.col("zip_code_std"))), S.match_key(F.col("city_std"))], "Duplicate_Address_CHECK")
    return out.select("rid", "Duplicate_Address_CHECK")


def dup_tin_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates_listing(dup_tin(spark, d), "Duplicate_TIN_CHECK", ("rid", "tin"), ["tin9", "rid"]).select("rid", "tin9")


def dup_flag_orders(spark: SparkSession, d: str) -> DataFrame:
    flagged = K.duplicate_flag(table(spark, d, "orders"), [F.col("o_custkey").cast("string")], "dup")
    return flagged.groupBy("dup").agg(F.count(F.lit(1)).alias("n"))


def quality_raw(spark: SparkSession, d: str) -> DataFrame:
    return K.quality_raw(contacts(spark, d), ROLES, COLS)


def quality_clean(spark: SparkSession, d: str) -> DataFrame:
    return K.quality_clean(contacts(spark, d), ROLES, COLS)


def overall(spark: SparkSession, d: str) -> DataFrame:
    return K.overall_score(quality_raw(spark, d))


def global_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.global_stats(contacts(spark, d), ROLES, COLS)


def excel_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("serial", F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")) + 0.54)
    return o.select("o_orderkey", D.from_excel_serial(F.col("serial")).cast("string").alias("day"))


def date_std(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", D.standardize_datetime(raw).alias("day"), D.quarter(F.col("o_orderdate")).cast("long").alias("q"), D.month(F.col("o_orderdate")).cast("long").alias("m"), D.weekday(F.col("o_orderdate")).cast("long").alias("w"), D.weekday_label(F.col("o_orderdate")).alias("wl"))


QUERIES |= {
    "str_whitespace_flag": whitespace_flag, "str_special_flag": special_flag, "str_clean_text": clean_text, "str_composite_key": composite_key, "str_tags_distinct": tags_distinct,
    "addr_pipe_split": pipe_split, "addr_pipe_parse": pipe_parse, "addr_pipe_exact": pipe_exact, "clean_issue_matrix": issue_matrix, "clean_issue_long": issue_long, "clean_issue_totals": issue_totals, "clean_compare": compare,
    "clean_unresolved": unresolved, "clean_compare_search": compare_search, "clean_export": export, "clean_quality_raw": quality_raw, "clean_quality_clean": quality_clean, "clean_overall_score": overall, "clean_global_stats": global_stats,
    "dup_tin_flag": dup_tin, "dup_address_flag": dup_address, "dup_tin_rows": dup_tin_rows, "dup_flag_orders": dup_flag_orders, "excel_serial_dates": excel_dates, "date_std": date_std,
}

_FLAGS = {f"{c}_has_ws": Q.ws(c) for c in COLS} | {f"{c}_has_sc": Q.sc(c) for c in COLS} | {f"{c}_is_missing": Q.missing(c) for c in COLS}
_FLAGS |= {"phone_has_format": Q.phone_issue("phone"), "zip_has_format": Q.zip_issue("zip"), "tin_has_format": Q.tin_issue("tin")}
_ANY = {k: " OR ".join(f"({e})" for f, e in _FLAGS.items() if K.kind_of(f) == k) for k in ("format", "is_missing", "sc", "ws")}
_TAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN {_ANY[k]} THEN '{K.TAGS[k]}' END" for k in sorted(_ANY, key=lambda k: K.TAGS[k])) + ")"
_LONG = " UNION ALL ".join(
    f"SELECT rid, '{f.removesuffix('_has_' + K.kind_of(f)).removesuffix('_' + K.kind_of(f))}' AS feature, '{R.KINDS[K.kind_of(f)][1]}' AS issue_type, '{R.KINDS[K.kind_of(f)][0]}' AS severity, '{R.KINDS[K.kind_of(f)][2]}' AS strategy, {f.removesuffix('_has_' + K.kind_of(f)).removesuffix('_' + K.kind_of(f))} AS value FROM c WHERE {e}"
    for f, e in _FLAGS.items()
)
_STD = {"lgl_nm": Q.name(Q.clean("lgl_nm")), "dba_nm": Q.name(Q.clean("dba_nm")), "phone": Q.phone(Q.clean("phone")), "zip": Q.zip_(Q.clean("zip")), "tin": Q.tin(Q.clean("tin")), "state": Q.state(Q.clean("state")), "country": Q.country(Q.clean("country")), "business_address": Q.name(Q.clean("business_address")), "uid": Q.clean("uid")}
_SHAPES = {"phone": K.CLEAN_SHAPE["phone"], "zip": K.CLEAN_SHAPE["zip"], "tin": K.CLEAN_SHAPE["tin"]}


def _compare(c: str) -> str:
    kinds = [k for k in ("ws", "sc", "is_missing", "format") if f"{c}_has_{k}" in _FLAGS or f"{c}_{k}" in _FLAGS]
    tags = "concat_ws(',', " + ", ".join(f"CASE WHEN {_FLAGS.get(f'{c}_has_{k}') or _FLAGS[f'{c}_{k}']} THEN '{k}' END" for k in kinds) + ")"
    why = f"CASE WHEN {Q.missing(c)} THEN 'MISSING_SOURCE'" + (f" WHEN NOT regexp_matches({_STD[c]}, '{_SHAPES[c]}') THEN 'UNFIXABLE_BY_ENGINE'" if c in _SHAPES else "") + " END"
    return f"SELECT rid, '{c}' AS feature, {c} AS original, {_STD[c]} AS standardized, {tags} AS tags, {why} AS reason FROM c"


_COMPARE = "SELECT *, CASE WHEN reason IS NULL THEN 'Resolved' ELSE 'Unresolved' END AS resolution FROM (" + " UNION ALL ".join(_compare(c) for c in ("lgl_nm", "phone", "zip", "tin", "state")) + ") x WHERE tags <> ''"


def _score(rows: str) -> str:
    return f"""SELECT col_name, CAST(round_even(CASE WHEN (m > 0 OR i > 0) AND s > 99 THEN 99.0 ELSE s END, 0) AS INTEGER) AS score, CAST(m AS BIGINT) AS missing, CAST(i AS BIGINT) AS invalid, round_even(mp, 1) AS m_pct, round_even(ip, 1) AS i_pct
        FROM (SELECT *, greatest(0.0, least(100.0, 100 - (mp * 0.5 + ip)))::DOUBLE AS s FROM (SELECT *, m::DOUBLE / n * 100 AS mp, i::DOUBLE / n * 100 AS ip FROM ({rows}) a) b) q"""


def _sum(e: str) -> str:
    return f"coalesce(sum(CASE WHEN {e} THEN 1 ELSE 0 END), 0)"


_RAW = " UNION ALL ".join(f"SELECT '{c}' AS col_name, count(*)::DOUBLE AS n, {_sum(_FLAGS[c + '_is_missing'])} AS m, {' + '.join(_sum(_FLAGS[f]) for f in (c + '_has_ws', c + '_has_sc', c + '_has_format') if f in _FLAGS)} AS i FROM c" for c in COLS)
_CLEAN = " UNION ALL ".join(f"SELECT '{c}' AS col_name, count(*)::DOUBLE AS n, {_sum(f'{_STD[c]} IS NULL')} AS m, " + (_sum(f"NOT regexp_matches({_STD[c]}, '{_SHAPES[c]}')") if c in _SHAPES else "0") + " AS i FROM c" for c in COLS)
_PART = "string_split(business_address, '|')"
_PHYSICAL = f"(regexp_matches(upper(p), '{K.ADDRESS_SHAPE}') OR regexp_matches(upper(p), '{K.STREET_WORD}'))"
_SAME = f"length({Q.key('p')}) > 3 AND ({Q.key('p')} = {Q.key('lgl_nm')} OR {Q.key('p')} = {Q.key('dba_nm')})"
_TAIL = ("city", "region", "zip_code", "country")
_EXACT = f"""SELECT rid, CASE WHEN empty OR n = 4 THEN '' WHEN n < 4 THEN parts[1] ELSE one END AS address_1, CASE WHEN empty OR n <= 4 THEN '' ELSE others END AS address_2,
  {', '.join(f"CASE WHEN empty OR n < 4 THEN '' ELSE parts[n - {3 - i}] END AS {t}" for i, t in enumerate(_TAIL))},
  CASE WHEN empty THEN '' WHEN n < 4 THEN parts[1] WHEN n = 4 THEN a ELSE array_to_string(list_filter(list_concat([one, others], parts[n - 3:n]), lambda x: x <> ''), ', ') END AS full_address
FROM (SELECT *, coalesce(kept[1], '') AS one, array_to_string(kept[2:], ', ') AS others FROM (
  SELECT *, CASE WHEN n > 4 AND len(front) = 0 THEN [parts[n - 4]] ELSE front END AS kept FROM (
  SELECT *, list_filter(parts[1:greatest(n - 4, 0)], lambda p: p <> '' AND ({_PHYSICAL} OR NOT ({_SAME}))) AS front FROM (
  SELECT rid, business_address AS a, lgl_nm, dba_nm, {Q.blank('business_address')} OR lower(business_address) = 'nan' AS empty, list_transform({_PART}, lambda p: {Q.strip('p')}) AS parts, len({_PART}) AS n FROM c) x) y) z) w"""
_NP = f"CASE WHEN {Q.blank('business_address')} THEN 0 ELSE len({_PART}) END"

SQL |= {
    "str_whitespace_flag": f"SELECT doc_id, {Q.ws('text')} AS flag FROM documents",
    "str_special_flag": f"SELECT doc_id, {Q.sc('text')} AS flag FROM documents",
    "str_clean_text": f"SELECT doc_id, md5({Q.clean('text')}) AS digest FROM documents",
    "str_composite_key": f"{C} SELECT rid, coalesce(lgl_nm, '__NA__') || '|' || coalesce(zip, '__NA__') || '|' || coalesce(tin, '__NA__') AS k FROM c",
    "str_tags_distinct": f"{C} SELECT rid, CASE WHEN t = '' THEN 'GOOD_DATA' ELSE t END AS tags FROM (SELECT rid, concat_ws(',', CASE WHEN {Q.missing('phone')} OR {Q.missing('zip')} THEN 'MISSING_VALUE' END, CASE WHEN {Q.sc('lgl_nm')} THEN 'SPECIAL_CHARS' END) AS t FROM c) x",
    "addr_pipe_split": f"{C} SELECT rid, " + ", ".join(f"CASE WHEN {_NP} >= 4 THEN {Q.strip(f'list_extract({_PART}, len({_PART}) - {k})')} ELSE '' END AS {p}" for p, k in (("city", 3), ("region", 2), ("zip_code", 1), ("country", 0))) + f", len({_PART})::BIGINT AS n_parts FROM c",
    "addr_pipe_exact": f"{C} {_EXACT}",
    "clean_issue_matrix": f"{C} SELECT rid, t <> '' AS _has_issue, CASE WHEN t = '' THEN 'GOOD_DATA' ELSE t END AS _issue_tags, lgl_nm_has_ws, lgl_nm_has_sc, dba_nm_is_missing, phone_has_format, zip_has_format, tin_has_format FROM (SELECT rid, {_TAGS} AS t, {', '.join(f'{_FLAGS[f]} AS {f}' for f in ('lgl_nm_has_ws', 'lgl_nm_has_sc', 'dba_nm_is_missing', 'phone_has_format', 'zip_has_format', 'tin_has_format'))} FROM c) x",
    "clean_issue_long": f"{C} {_LONG}",
    "clean_issue_totals": f"{C}, l AS ({_LONG}) SELECT severity, issue_type, count(*) AS n, CAST(floor(count(*) * 100 / (SELECT count(*) FROM l)) AS INTEGER) AS pct FROM l GROUP BY severity, issue_type",
    "clean_compare": f"{C} {_COMPARE}",
    "clean_unresolved": f"{C} SELECT feature, reason, count(*) AS n FROM ({_COMPARE}) y WHERE resolution = 'Unresolved' GROUP BY feature, reason",
    "clean_compare_search": f"{C} SELECT * FROM ({_COMPARE}) y WHERE resolution = 'Unresolved' AND (" + " OR ".join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '(?i)abc|555'), false)" for c in ("rid", "feature", "original", "standardized", "tags", "reason", "resolution")) + ")",
    "clean_quality_raw": f"{C} {_score(_RAW)}",
    "clean_quality_clean": f"{C} {_score(_CLEAN)}",
    "clean_overall_score": f"{C}, q AS ({_score(_RAW)}) SELECT score, CASE WHEN score > 80 THEN 'high' WHEN score > 50 THEN 'medium' ELSE 'low' END AS band FROM (SELECT round_even(avg(score), 1) AS score FROM q) x",
    "clean_global_stats": f"{C} SELECT count(*) AS total_rows, {_sum(f'({_TAGS}) <> ' + chr(39) * 2)}::BIGINT AS rows_with_issues, (count(*) - {_sum(f'({_TAGS}) <> ' + chr(39) * 2)})::BIGINT AS good_rows, ({' + '.join(_sum(f'{c} IS NULL') for c in COLS)})::BIGINT AS missing_values_count FROM c",
    "dup_tin_flag": f"{C} SELECT rid, tin9, CASE WHEN tin9 <> '' AND count(*) OVER (PARTITION BY tin9) > 1 THEN 'Yes' ELSE 'No' END AS Duplicate_TIN_CHECK FROM (SELECT rid, {Q.tin9('tin')} AS tin9 FROM c) x",
    "dup_tin_rows": f"{C} SELECT rid, tin9 FROM (SELECT rid, tin9, count(*) OVER (PARTITION BY tin9) AS k FROM (SELECT rid, {Q.tin9('tin')} AS tin9 FROM c) x) y WHERE tin9 <> '' AND k > 1",
    "dup_flag_orders": "SELECT dup, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'Yes' ELSE 'No' END AS dup FROM orders) x GROUP BY dup",
    "excel_serial_dates": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    "date_std": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, quarter(o_orderdate) AS q, month(o_orderdate) AS m, isodow(o_orderdate) - 1 AS w, list_extract(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], isodow(o_orderdate)) AS wl FROM orders",
}
