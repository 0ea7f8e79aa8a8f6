"""Long reports: issues, raw against clean, exports, listings, notes, and the HTML page."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from .clean import CLEAN_SHAPE, c_, clean_value, cleaned, global_stats, issue_flags, issue_matrix, kind_of, overall_score, quality_clean, quality_raw, role_of, text_columns

# Severity, type and strategy of each kind of issue.
KINDS = {
    "is_missing": ("High", "MISSING", "Flag/Null representation"),
    "sc": ("Medium", "SPECIAL CHARACTERS", "Strip valid chars"),
    "ws": ("Low", "FORMAT WHITESPACE", "Trim and single-space"),
    "format": ("Low", "FORMAT WHITESPACE", "Flag/Null representation"),
}


def issues_long(df: DataFrame, roles: dict[str, str], cols: Sequence[str] | None = None, rid: str = "rid") -> DataFrame:
    """A row per issue: rid, feature, issue_type, severity, strategy, value; from one pass, without a shuffle."""
    flags = issue_flags(df, roles, list(cols) if cols else None)
    rows = []
    for name, flag in flags.items():
        kind = kind_of(name)
        severity, what, strategy = KINDS[kind]
        c = name.removesuffix(f"_has_{kind}").removesuffix(f"_{kind}")
        rows.append(F.when(flag, F.struct(F.lit(c).alias("feature"), F.lit(what).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(strategy).alias("strategy"), c_(c).cast("string").alias("value"))))
    return df.select(c_(rid).alias("rid"), F.explode(F.array(*rows)).alias("r")).filter("r is not null").select("rid", "r.*")


def issue_totals(long: DataFrame) -> DataFrame:
    """severity, issue_type, n, pct (whole percents of all issues)."""
    by = long.groupBy("severity", "issue_type").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("t"))
    return by.join(F.broadcast(total)).select("severity", "issue_type", "n", F.floor(F.col("n") * 100 / F.col("t")).cast("int").alias("pct"))


def failure(role: str | None, raw: Column, clean: Column) -> Column:
    """Why a flagged cell is unresolved, or null: nothing there, or still the wrong shape."""
    shape = CLEAN_SHAPE.get(role or "")
    out = F.when(S.is_missing(raw), "MISSING_SOURCE")
    return out.when(~clean.rlike(shape), "UNFIXABLE_BY_ENGINE") if shape else out


def comparison(df: DataFrame, roles: dict[str, str], cols: Sequence[str] | None = None, rid: str = "rid") -> DataFrame:
    """A row per flagged cell: rid, feature, original, standardized, tags, reason, resolution."""
    cols = list(cols or text_columns(df))
    flags = issue_flags(df, roles, cols)
    steps, rows = {}, []
    for i, c in enumerate(cols):
        own = {kind_of(f): e for f, e in flags.items() if f in (f"{c}_has_ws", f"{c}_has_sc", f"{c}_is_missing", f"{c}_has_format")}
        steps |= {f"old{i}": c_(c), f"new{i}": clean_value(df, roles, c).cast("string"), f"tags{i}": F.concat_ws(",", *[F.when(e, k) for k, e in own.items()])}
        role = next((role_of(k) for k, v in roles.items() if v == c), None)
        why = failure(role, F.col(f"old{i}"), F.col(f"new{i}"))
        rows.append(F.struct(F.lit(c).alias("feature"), F.col(f"old{i}").alias("original"), F.col(f"new{i}").alias("standardized"), F.col(f"tags{i}").alias("tags"), why.alias("reason")))
    # Columns first, rows of them after: inside a generator nothing that is used twice is computed once.
    out = df.select(c_(rid).alias("rid"), *[v.alias(k) for k, v in steps.items()]).select("rid", F.explode(F.array(*rows)).alias("r")).select("rid", "r.*").filter("tags <> ''")
    return out.withColumn("resolution", F.when(F.col("reason").isNull(), "Resolved").otherwise("Unresolved"))


def search(compared: DataFrame, feature: str | None = None, tag: str | None = None, resolution: str | None = None, pattern: str | None = None) -> DataFrame:
    out = compared
    if feature:
        out = out.filter(F.col("feature") == feature)
    if tag:
        out = out.filter(F.array_contains(F.split("tags", ","), tag))
    if resolution:
        out = out.filter(F.col("resolution") == resolution)
    return out.filter(S.any_column_matches([F.col(c) for c in out.columns], pattern)) if pattern else out


def failing_rule(df: DataFrame, roles: dict[str, str], rule: str, cols: Sequence[str] | None = None, rid: str = "rid", most: int = 200) -> DataFrame:
    """The first ``most`` raw rows that fail a rule (a tag of the issue table)."""
    tags = issue_matrix(df, roles, list(cols) if cols else None)
    return tags.filter(F.array_contains(F.split("_issue_tags", ","), rule)).orderBy(rid).limit(most).select(*[c_(c) for c in df.columns])


def filter_issues(long: DataFrame, severity: str | None = None, feature: str | None = None) -> DataFrame:
    out = long.filter(F.col("severity") == severity) if severity else long
    return out.filter(F.col("feature") == feature) if feature else out


def anomaly_totals(df: DataFrame, roles: dict[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """format_flags, ws_flags, sc_flags and their sum as anomalies, over all columns."""
    flags = issue_flags(df, roles, list(cols) if cols else None)
    total = lambda kind: sum((F.count_if(e) for f, e in flags.items() if kind_of(f) == kind), F.lit(0).cast("bigint"))
    out = df.agg(*[total(k).alias(f"{k}_flags") for k in ("format", "ws", "sc")])
    return out.withColumn("anomalies", F.col("format_flags") + F.col("ws_flags") + F.col("sc_flags"))


def unfixable(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """role, n: cells of TIN, phone and zip columns that have a value but, standardized, not the shape of their role."""
    shaped = {k: c for k, c in roles.items() if role_of(k) in CLEAN_SHAPE}
    sums = [F.struct(F.lit(role_of(k)).alias("role"), F.count_if(~clean_value(df, roles, c).cast("string").rlike(CLEAN_SHAPE[role_of(k)])).alias("n")) for k, c in shaped.items()]
    return df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("r")).select("r.*").groupBy("role").agg(F.sum("n").alias("n"))


def best_and_worst(quality: DataFrame) -> DataFrame:
    """end (worst, best), col_name, score, missing, invalid of the columns of least and greatest score; ties go by name."""
    row = F.struct("col_name", "score", "missing", "invalid")
    ends = quality.agg(F.min_by(row, F.struct("score", "col_name")).alias("worst"), F.max_by(row, F.struct("score", "col_name")).alias("best"))
    return ends.select(F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("r")) for e in ("worst", "best")])).alias("x")).select("x.end", "x.r.*")


def unresolved(compared: DataFrame) -> DataFrame:
    return compared.filter("resolution = 'Unresolved'").groupBy("feature", "reason").agg(F.count(F.lit(1)).alias("n"))


def failed_samples(compared: DataFrame, feature: str, most: int = 10, rid: str = "rid") -> DataFrame:
    return compared.filter((F.col("resolution") == "Unresolved") & (F.col("feature") == feature)).orderBy(rid).limit(most)


def export(df: DataFrame, roles: dict[str, str], suffix: str = "_std", fuzzy: bool = True) -> DataFrame:
    """``<c>_received`` and ``<c><suffix>`` of every column (uid hashed, the piped address raw only), the unformatted TIN, parsed parts, flags."""
    received = {f"{c}_received": c_(c) for c in df.columns}
    clean = cleaned(df.withColumns(received), roles, suffix, fuzzy, untouched=list(received))
    out = []
    for c in df.columns:
        raw = c_(f"{c}_received")
        out.append((S.hashed_id(raw) if c.lower() == "uid" else raw).alias(f"{c}_received"))
        if "business_address" not in c.lower():
            out.append((S.hashed_id(raw) if c.lower() == "uid" else c_(c).cast("string")).alias(f"{c}{suffix}"))
    tin = next((c for c in df.columns if c.lower() == "tin"), None)
    if tin:
        out.append(F.coalesce(S.without_dashes(c_(tin)), F.lit("")).alias(f"{tin}{suffix}_no_dash"))
    have = {f"{c}{suffix}" for c in df.columns}
    out += [c_(c) for c in clean.columns if c.endswith(suffix) and c not in have]
    return clean.select(*out, *[F.coalesce(c, F.lit("No")).alias(c) for c in ("Duplicate_TIN_CHECK", "Duplicate_Address_CHECK")])


def duplicates_listing(clean: DataFrame, flag: str, keywords: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with a flag, columns chosen by keywords, sorted."""
    cols = [c for c in clean.columns if any(k in c.lower() for k in keywords)]
    return clean.filter(c_(flag) == "Yes").orderBy(*[c_(c) for c in order]).select(*[c_(c) for c in dict.fromkeys([*cols, flag])])


def health_note(stats: dict) -> tuple[str, str]:
    """(label, sentence) of the share of rows with issues."""
    pct = 100 * stats["rows_with_issues"] / max(1, stats["total_rows"])
    label = "Strong" if pct < 20 else "Moderate" if pct < 50 else "Weak"
    return label, f"{label}: {stats['rows_with_issues']:,} of {stats['total_rows']:,} rows ({pct:.1f} %) have at least one issue."


def html_statistics(stats: dict, raw_score: float, clean_score: float) -> dict:
    n = max(1, stats["total_rows"])
    return {"issue_pct": 100 * stats["rows_with_issues"] / n, "good_pct": 100 * stats["good_rows"] / n, "improvement": clean_score - raw_score}


def _table(rows: Sequence[dict]) -> str:
    if not rows:
        return "<p>No rows.</p>"
    head = "".join(f"<th>{escape(str(c))}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def generate_html_report(metrics: dict, charts: dict[str, str] | None = None, tables: dict[str, Sequence[dict] | DataFrame] | None = None, notes: Sequence[str] = (), raw_stats: dict | None = None, most_rows: int = 200) -> str:
    """A page of statistics, tables (of ``most_rows`` rows at most) and notes."""
    parts = ["<!doctype html><html><head><meta charset='utf-8'><title>Data quality report</title><style>body{font-family:sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.3em .6em}table{border-collapse:collapse}</style></head><body><h1>Data quality report</h1>"]
    if raw_stats:
        parts.append(f"<p>{escape(health_note(raw_stats)[1])}</p>")
    parts.append(_table([metrics]))
    parts += [f"<h2>{escape(k)}</h2>{svg}" for k, svg in (charts or {}).items()]
    for name, rows in (tables or {}).items():
        rows = [r.asDict() for r in rows.limit(most_rows).collect()] if isinstance(rows, DataFrame) else list(rows)[:most_rows]
        parts.append(f"<h2>{escape(name)}</h2>{_table(rows)}")
    if notes:
        parts.append("<ul>" + "".join(f"<li>{escape(n)}</li>" for n in notes) + "</ul>")
    return "".join(parts) + "</body></html>"


def _bars(rows: Sequence[tuple[str, float]]) -> str:
    """Horizontal bars as SVG; values are percents."""
    row = lambda i, name, v: f"<text x='0' y='{20 * i + 14}'>{escape(name)}</text><rect x='200' y='{20 * i + 3}' width='{4 * max(0.0, min(100.0, v)):.0f}' height='14' fill='#4878a8'/><text x='610' y='{20 * i + 14}'>{v:g}</text>"
    return f"<svg width='680' height='{20 * len(rows) + 6}' font-size='12'>" + "".join(row(i, str(k), float(v)) for i, (k, v) in enumerate(rows)) + "</svg>"


def duplicate_totals(clean: DataFrame) -> DataFrame:
    """tin_dups, addr_dups: rows whose key repeats, in a table with both flags."""
    return clean.agg(*[F.count_if(F.col(f) == "Yes").alias(n) for f, n in (("Duplicate_TIN_CHECK", "tin_dups"), ("Duplicate_Address_CHECK", "addr_dups"))])


def summary_figures(df: DataFrame, roles: dict[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row: total_rows, good_rows, rows_with_issues, missing_values, unfixable, raw_score, clean_score, improvement, issue_pct, good_pct."""
    cols = list(cols or df.columns)
    scores = [overall_score(q(df, roles, cols)).select(F.col("score").alias(n)) for q, n in ((quality_raw, "raw_score"), (quality_clean, "clean_score"))]
    failed = unfixable(df, roles).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unfixable"))
    out = global_stats(df, roles, cols).withColumnRenamed("missing_values_count", "missing_values").join(failed).join(scores[0]).join(scores[1])  # a row each
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("total_rows")), F.lit(0.0)), 1)
    return out.withColumns({"improvement": F.round(F.col("clean_score") - F.col("raw_score"), 1), "issue_pct": share("rows_with_issues"), "good_pct": share("good_rows")})


# What each kind of column is checked for, and how it is standardized.
RULES = (
    ("Names", "special characters; leading, trailing or doubled blanks", "special characters removed, blanks collapsed, upper case"),
    ("Address in parts", "missing; not in parts", "split into parts, the company name left out, joined again"),
    ("TIN", "missing; not nine digits", "digits only, a zero before eight digits, XX-XXXXXXX"),
    ("Phone", "fewer than 10 or more than 11 digits", "(XXX) XXX-XXXX, or +1 (XXX) XXX-XXXX"),
    ("Date", "no date", "YYYY-MM-DD, else null"),
    ("ZIP", "not five digits", "five digits"),
    ("Duplicate TIN", "a standardized TIN that occurs again", "Duplicate_TIN_CHECK is Yes"),
    ("Duplicate address", "first address line, ZIP and city that occur together again", "Duplicate_Address_CHECK is Yes"),
)


def quality_page(df: DataFrame, roles: dict[str, str], cols: Sequence[str] | None = None, rid: str = "rid", notes: dict[int, str] | None = None, fuzzy: bool = True, listed: int = 50) -> str:
    """The data quality report: a summary and five sections (raw quality, issues and duplicates, changes, rules, final table).

    Figures are aggregates over all rows; a listing shows ``listed`` rows at most. ``notes`` are put under the sections of their numbers.
    """
    cols, notes = list(cols or df.columns), notes or {}
    rows = lambda t, n=listed: [r.asDict() for r in t.limit(n).collect()]
    clean = cleaned(df, roles, fuzzy=fuzzy)
    figures = summary_figures(df, roles, cols).first().asDict()
    dups = duplicate_totals(clean).first().asDict()
    total = max(1, figures["total_rows"])
    pct = {k: round(100 * v / total, 1) for k, v in dups.items()}
    label, sentence = health_note(figures)
    compared = comparison(df, roles, [c for c in cols if c in text_columns(df)], rid)
    raw, after = (q(df, roles, cols).orderBy("col_name").collect() for q in (quality_raw, quality_clean))
    totals = issue_totals(issues_long(df, roles, cols, rid)).orderBy(F.desc("n"), "severity", "issue_type")
    duplicates = {f: duplicates_listing(clean, f, keys, [rid]) for f, keys in (("Duplicate_TIN_CHECK", (rid, "lgl", "tin")), ("Duplicate_Address_CHECK", (rid, "lgl", "address", "city", "zip")))}
    gain = figures["improvement"]
    change = f"{gain:+g} points against the raw score." if gain else "the same as the raw score."
    any_dups = dups["tin_dups"] + dups["addr_dups"] > 0
    cards = figures | dups | {"tin_dup_pct": pct["tin_dups"], "addr_dup_pct": pct["addr_dups"], "health": label}
    sections = (
        ("Quality of the raw table", [f"<p>{escape(sentence)} Missing values: {figures['missing_values']:,}. Mean score of the columns: {figures['raw_score']}.</p>", _bars([(r.col_name, r.score) for r in raw])]),
        ("Issues and duplicates", [_table(rows(totals)), f"<p>Rows that share their TIN: {dups['tin_dups']:,} ({pct['tin_dups']} %), their address: {dups['addr_dups']:,} ({pct['addr_dups']} %).</p>", *[f"<h3>{f}</h3>{_table(rows(t))}" for f, t in duplicates.items()]]),
        ("Standardized against original", [f"<p>Mean score after standardizing: {figures['clean_score']}, {change} Cells that could not be standardized: {figures['unfixable']:,}.</p>", _bars([(r.col_name, r.score) for r in after]), _table(rows(unresolved(compared).orderBy(F.desc("n"), "feature", "reason"))), _table(rows(compared.orderBy(rid, "feature")))]),
        ("Rules", [_table([dict(zip(("columns", "flagged", "standardized"), r, strict=True)) for r in RULES])]),
        ("Final table", [f"<p>{figures['total_rows']:,} rows. {'Review the flagged rows before use.' if any_dups else 'No duplicates of TIN or address.'}</p>", _table(rows(export(df, roles, fuzzy=fuzzy)))]),
    )
    body = "".join(f"<section id='s{i}'><h2>{i}. {name}</h2>{''.join(parts)}{f'<blockquote>{escape(notes[i])}</blockquote>' if i in notes else ''}</section>" for i, (name, parts) in enumerate(sections, 1))
    style = "body{font-family:sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.3em .6em}table{border-collapse:collapse;margin:1em 0}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Data quality report</title><style>{style}</style></head><body><h1>Data quality report</h1><section id='summary'><h2>Summary</h2>{_table([cards])}</section>{body}</body></html>"
