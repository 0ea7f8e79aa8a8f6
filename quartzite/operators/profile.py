"""Profiling: counters, missing values, variance, sparsity, correlation, association, leakage, alerts, quality.

All columns share a job: counters are one wide aggregate, value frequencies one shuffle over (column, value) pairs, quantiles running
totals over distinct values, pairs of columns a blocked matrix of co-moments. Only results of that size reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import strings as S
from . import gram
from .ranks import long_values, quantiles

# Texts (upper case) and numbers that stand for a missing value.
MISSING_TEXTS = (
    "NA", "N/A", "NA.", "N.A.", "<NA>", "NAN", "<NAN>", "NULL", "<NULL>", "NONE", "<NONE>", "MISSING", "<MISSING>", "MISS", "UNKNOWN", "UNK", "UNKN", "UNDEF", "UNDEFINED",
    "BLANK", "EMPTY", "VOID", "NIL", "NODATA", "NO DATA", "NOT AVAILABLE", "NOTAVAILABLE", "-", "--", "---", "?", ".",
)
MISSING_CODES = (-1, -9, -99, -999, -9999, -99999, 999, 9999, 99999, 999999, 9999999)
# Texts (lower case) that make a constant column one of unknown type.
CONSTANT_STAND_INS = ("unknown", "unk", "n/a", "na", "nan", "null", "none", "missing", "not available", "not applicable", "undefined", "empty", "")
# Parts of an identifier's name, whole words of it, and families of words.
ID_PARTS = (
    "id_", "_id", "_key", "key_", "_code", "code_", "_number", "number_", "_num", "num_", "_nbr", "nbr_", "_ref", "ref_", "_token", "token_",
    "_acct", "acct_", "_account", "account_", "_seq", "seq_", "_serial", "serial_", "_uuid", "uuid_", "_guid", "guid_",
)
ID_WORDS = (
    "id", "uid", "pid", "cid", "rid", "fid", "bid", "nid", "sid", "key", "ref", "uuid", "guid", "token", "seq", "serial", "mid", "tid", "arn", "stan", "rrn", "ica", "bin", "pan",
    "tin", "ein", "ssn", "itin", "fein", "npi", "duns", "acct", "account", "routing", "aba", "msisdn", "imei", "imsi",
)
ID_FAMILIES = ("mid", "tid", "tin", "ssn", "ein", "bin", "pan", "arn", "rrn")
# Words of a column name that hint at the outcome.
LEAK_NAMES = ("label", "target", "outcome", "fraud", "chargeback", "default", "approved", "declined", "decision", "result", "status", "is_fraud", "y", "class")
# Month tokens like oct15_25, oct_25, oct25.
DATE_TOKENS = r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(\d{1,2}_\d{2,4}|_\d{2,4}|\d{2,4})$"

# Shapes of dates as text, year first, slashes, month by name.
DATE_TEXTS = (
    r"^\d{4}[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])([ T].*)?$", r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|[12]\d|3[01])/\d{4}$",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^[A-Za-z]{3}\s+\d{1,2},?\s+\d{4}$",
)


def c_(name: str) -> Column:
    return F.col(f"`{name}`")


def num_(name: str) -> Column:
    """The column as double; NaN counts as missing."""
    return F.nanvl(c_(name).cast("double"), F.lit(None).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _rows(df: DataFrame, per: dict[str, dict[str, Column]], shared: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate of ``{column: {measure: expression}}``, as a row per column."""
    aggs, shared = [], shared or {}
    for i, m in enumerate(per.values()):
        aggs += [e.alias(f"{k}_{i}") for k, e in m.items()]
    out = df.agg(*[e.alias(f"_{k}") for k, e in shared.items()], *aggs)
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}_{i}").alias(k) for k in m]) for i, (c, m) in enumerate(per.items())]
    return out.select(*[F.col(f"_{k}").alias(k) for k in shared], F.explode(F.array(*rows)).alias("r")).select(*shared, "r.*")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, value, n of all non-null values of all columns, from one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), c_(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n_unique, unique_ratio of all rows."""
    cols = cols or df.columns
    found = value_counts(df, cols).groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    fixed = df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"), "n")
    return fixed.join(found, "feature", "left").select("feature", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), F.coalesce(N.ratio(F.col("n_unique"), F.col("n")), F.lit(0.0)).alias("unique_ratio"))


def missing_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, missing, pct, severity."""
    out = _rows(df, {c: {"missing": F.count_if(c_(c).isNull())} for c in cols or df.columns}, {"n": F.count(F.lit(1))})
    return out.withColumn("pct", F.coalesce(N.ratio(F.col("missing"), F.col("n")), F.lit(0.0)) * 100).select("feature", "missing", "pct", N.missing_severity(F.col("pct")).alias("severity"))


def missing_by_type(missing: DataFrame, types: dict[str, str]) -> DataFrame:
    """Features, cells missing and mean percent by feature type."""
    kind = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return missing.groupBy(kind[F.col("feature")].alias("feature_type")).agg(F.count(F.lit(1)).alias("features"), F.sum("missing").alias("missing"), F.avg("pct").alias("mean_pct"))


def special_kind(v: Column) -> Column:
    """Which kind of missing-value stand-in a text is, or null."""
    number = N.parse_number(v)
    return F.when((v != "") & (S.strip(v) == ""), "whitespace").when(F.upper(S.strip(v)).isin(*MISSING_TEXTS), "text").when(number.isin(*[float(x) for x in MISSING_CODES]), "code")


def special_codes(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """feature, kind, value, n of stand-ins for missing values."""
    cols = [c for c in cols or df.columns if c not in exclude]
    return value_counts(df, cols).withColumn("kind", special_kind(F.col("value"))).filter("kind is not null").select("feature", "kind", "value", "n")


def nulled_special(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``df`` with stand-ins for missing values as null; ``exclude`` keeps ids and targets as they are."""
    return df.select(*[c_(c) if c in exclude else F.when(special_kind(c_(c).cast("string")).isNull(), c_(c)).alias(c) for c in df.columns])


def variance(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.01) -> DataFrame:
    """feature, variance, std_dev, value_range, severity, status (constant, low, normal)."""
    v = lambda c: num_(c)
    out = _rows(df, {c: {"variance": F.var_samp(v(c)), "std_dev": F.stddev_samp(v(c)), "value_range": F.max(v(c)) - F.min(v(c))} for c in cols or numeric_columns(df)})
    out = out.withColumn("severity", N.variance_severity(F.col("variance"), threshold))
    return out.withColumn("status", F.when(F.col("variance") == 0, "constant").when(F.col("variance") < threshold, "low").otherwise("normal"))


def sparse_categories(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.01) -> DataFrame:
    """feature, categories, sparse (categories of ``threshold`` or less), dominant value and its share."""
    counts = value_counts(df, cols or text_columns(df))
    total = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    share = counts.join(total, "feature").withColumn("share", F.col("n") / F.col("t"))
    top = F.max_by("value", F.struct("n", F.col("value")))
    return share.groupBy("feature").agg(F.count(F.lit(1)).alias("categories"), F.count_if(F.col("share") <= threshold).alias("sparse"), top.alias("dominant"), F.max("share").alias("dominance"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """feature, n, mean, std, min, q1, median, q3, max; quantiles exact with linear interpolation unless ``approximate``."""
    cols = list(cols or numeric_columns(df))
    v = {c: num_(c) for c in cols}
    steps = [0.25, 0.5, 0.75]
    per = {c: {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)} | ({"q": F.percentile_approx(x, steps, 10_000)} if approximate else {}) for c, x in v.items()}
    out = _rows(df, per)
    if not approximate:
        out = out.join(quantiles(long_values(df, v), ["feature"], "v", steps).drop("n"), "feature", "left")
    return out.select("feature", "n", "mean", "std", "min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "max")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, mode, n; ties give the smallest value as text."""
    counts = value_counts(df, cols)
    return counts.groupBy("feature").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("m")).select("feature", F.col("m.value").alias("mode"), F.col("m.n").alias("n"))


def adjusted_skew(v: Column) -> Column:
    n = F.count(v)
    return F.when(n > 2, F.skewness(v) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def skewness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _rows(df, {c: {"skew": adjusted_skew(num_(c))} for c in cols or numeric_columns(df)})


def outliers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n, outliers beyond three standard deviations, pct, severity; two jobs."""
    cols = list(cols or numeric_columns(df))
    v = {c: num_(c) for c in cols}
    m = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(v[c]).alias(f"m{i}"), F.stddev_samp(v[c]).alias(f"s{i}"))]).first()
    per = {}
    for i, c in enumerate(cols):
        mean, std = m[f"m{i}"], m[f"s{i}"]
        bad = F.lit(False) if not std else (v[c] < mean - 3 * std) | (v[c] > mean + 3 * std)
        per[c] = {"n": F.count(v[c]), "outliers": F.count_if(bad)}
    out = _rows(df, per).withColumn("pct", F.coalesce(N.ratio(F.col("outliers"), F.col("n")), F.lit(0.0)) * 100)
    return out.withColumn("severity", F.when(F.col("outliers") == 0, "NONE").when(F.col("pct") > 5, "HIGH").when(F.col("pct") > 1, "MEDIUM").otherwise("LOW"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n_dup: second and later copies of rows that are equal in all columns, nulls equal."""
    cols = cols or df.columns
    return df.groupBy(*[c_(c) for c in cols]).agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_dup"))


def pearson(a: Column, b: Column) -> Column:
    """Over rows where both are there; null if either doesn't vary, where corr would divide by zero."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Pairs of columns up to which correlations are one native aggregate; more go through matrices.
FEW_PAIRS = 66


def correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """feature_1, feature_2, correlation, abs_correlation of all pairs, pairwise complete: few pairs by two aggregates, many by :mod:`.gram`.

    The first aggregate takes mean and range of each column. In the second, columns without gaps have their sums of differences from the mean
    once for all pairs; moments of their own for each pair, three aggregates each, are left to pairs with gaps.
    """
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    if len(pairs) > FEW_PAIRS:
        return gram.correlations(df, cols, threshold)
    v = {c: num_(c) for c in cols}
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[f(v[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("known", F.count), ("mean", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    whole = {c: i for i, c in enumerate(cols) if seen.n and seen[f"known{i}"] == seen.n}
    d = {c: v[c] - F.lit(seen[f"mean{i}"]) for c, i in whole.items()}
    sums = {f"s{i}": F.sum(d[c]) for c, i in whole.items()} | {f"q{i}": F.sum(d[c] * d[c]) for c, i in whole.items()}
    found = {}
    for i, (a, b) in enumerate(pairs):
        if not (a in whole and b in whole):
            sums[f"r{i}"], found[f"r{i}"] = pearson(v[a], v[b]), F.col(f"r{i}")
            continue
        sums[f"p{i}"] = F.sum(d[a] * d[b])
        left = lambda q, x, y: F.col(q) - F.col(x) * F.col(y) / float(seen.n)
        j, k = whole[a], whole[b]
        flat = any(seen[f"lo{x}"] == seen[f"hi{x}"] for x in (j, k))
        r = F.try_divide(left(f"p{i}", f"s{j}", f"s{k}"), F.sqrt(left(f"q{j}", f"s{j}", f"s{j}")) * F.sqrt(left(f"q{k}", f"s{k}", f"s{k}")))
        found[f"r{i}"] = F.lit(None).cast("double") if flat else r
    out = df.agg(*[e.alias(k) for k, e in sums.items()]).select(*[e.alias(k) for k, e in found.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]))
    out = out.select(rows.alias("r")).select("r.*").withColumn("abs_correlation", F.abs("correlation"))
    return out.filter(F.col("abs_correlation") >= threshold)


def features_to_remove(high: DataFrame) -> DataFrame:
    """The second feature of each high pair, by its largest correlation."""
    return high.groupBy(F.col("feature_2").alias("feature")).agg(F.max("abs_correlation").alias("max_correlation"))


def binary_outcome(df: DataFrame, outcome: str) -> Column:
    """0/1 as it is; of two other values the smaller is 0. Raises if there aren't two."""
    values = [r[0] for r in df.filter(c_(outcome).isNotNull()).select(c_(outcome)).distinct().limit(3).collect()]
    if len(values) != 2:
        raise ValueError(f"{outcome} isn't binary")
    if {float(v) if isinstance(v, (int, float, bool)) else v for v in values} == {0.0, 1.0}:
        return c_(outcome).cast("double")
    return F.when(c_(outcome) == max(values), 1.0).when(c_(outcome) == min(values), 0.0)


def point_biserial(df: DataFrame, outcome: str, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n, r, strength; at least ten pairs, an undefined correlation is 0."""
    y = binary_outcome(df, outcome)
    cols = [c for c in cols or numeric_columns(df) if c != outcome]
    per = {c: {"n": F.count_if(c_(c).isNotNull() & y.isNotNull()), "r": pearson(c_(c).cast("double"), y)} for c in cols}
    out = _rows(df, per).filter("n >= 10").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return out.withColumn("strength", N.correlation_strength(F.col("r")))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n of the cells that occur; nulls are left out."""
    return df.filter(c_(a).isNotNull() & c_(b).isNotNull()).groupBy(c_(a).cast("string").alias("a"), c_(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def crosstab_percent(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row percents."""
    return crosstab(df, a, b).withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy("a")) * 100)


def _association(cells: DataFrame) -> DataFrame:
    """Per feature: n, rows, columns and chi2 / n of long cells (feature, a, b, n)."""
    rows = cells.groupBy("feature", "a").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("feature", "b").agg(F.sum("n").alias("c"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"), F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"))
    each = cells.join(rows, ["feature", "a"]).join(cols, ["feature", "b"])
    o, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    return each.groupBy("feature").agg((F.sum(o * o / (r * c)) - 1).alias("phi2")).join(total, "feature")


def _cells(df: DataFrame, cols: Sequence[str], outcome: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), c_(c).cast("string").alias("a")) for c in cols]))
    return df.select(pairs.alias("p"), c_(outcome).cast("string").alias("b")).select("p.*", "b").filter("a is not null and b is not null").groupBy("feature", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, outcome: str, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n, v, strength without continuity correction."""
    cols = [c for c in cols or text_columns(df) if c != outcome]
    v = F.when(F.least("rows", "cols") > 1, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / (F.least("rows", "cols") - 1))).otherwise(0.0)
    out = _association(_cells(df, cols, outcome)).select("feature", F.col("t").alias("n"), v.alias("v"))
    return out.withColumn("strength", N.correlation_strength(F.col("v"), ((0.5, "Very Strong"), (0.25, "Strong"), (0.15, "Moderate"), (0.05, "Weak")), "Very Weak"))


def leak_by_cardinality(df: DataFrame, outcome: str, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, v, cardinality_ratio, warning: many categories (over half the rows) with a nearly perfect association (0.9) are a likely leak."""
    cols = [c for c in cols or text_columns(df) if c != outcome]
    known = value_counts(df, cols).groupBy("feature").agg((F.count(F.lit(1)) / F.sum("n")).alias("cardinality_ratio"))
    out = cramers_v(df, outcome, cols).join(known, "feature")
    return out.select("feature", "v", "cardinality_ratio", ((F.col("cardinality_ratio") > 0.5) & (F.col("v") >= 0.9)).alias("warning"))


def cramers_v_corrected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairwise V; a two-by-two table has Yates' correction."""
    cells = _cells(df, [a], b)
    ends = cells.groupBy("feature").agg(F.min("a").alias("a1"), F.max("a").alias("a2"), F.min("b").alias("b1"), F.max("b").alias("b2"))
    # The four corners of the table, which are all of it where they are used.
    at = {f"n{i}{j}": F.coalesce(F.sum(F.when((F.col("a") == F.col(f"a{i}")) & (F.col("b") == F.col(f"b{j}")), F.col("n"))), F.lit(0)).cast("double") for i in (1, 2) for j in (1, 2)}
    corners = cells.join(F.broadcast(ends), "feature").groupBy("feature").agg(*[e.alias(k) for k, e in at.items()])  # a row
    out = _association(cells).join(corners, "feature")
    n11, n12, n21, n22 = (F.col(k) for k in at)
    t = F.col("t").cast("double")
    yates = t * F.pow(F.greatest(F.lit(0.0), F.abs(n11 * n22 - n12 * n21) - t / 2), 2) / ((n11 + n12) * (n21 + n22) * (n11 + n21) * (n12 + n22))
    chi2 = F.when((F.col("rows") == 2) & (F.col("cols") == 2), yates).otherwise(F.col("phi2") * t)
    return out.select(F.col("t").alias("n"), chi2.alias("chi2"), F.when(F.least("rows", "cols") > 1, F.sqrt(chi2 / (t * (F.least("rows", "cols") - 1)))).otherwise(0.0).alias("v"))


def leakage_v(df: DataFrame, outcome: str, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n, v of the leakage check, whose chi-square takes each outcome column's mean as expectation."""
    cols = [c for c in cols or text_columns(df) if c != outcome]
    cells = _cells(df, cols, outcome)
    t = cells.groupBy("feature").agg(F.sum("n").alias("t"), F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"))
    by_b = cells.groupBy("feature", "b").agg(F.sum("n").cast("double").alias("c"), F.sum(F.col("n").cast("double") * F.col("n")).alias("q"))
    # Over all rows of a column, absent cells included: sum (o - mean)^2 / mean = sum o^2 / mean - column total.
    chi = by_b.join(t, "feature").groupBy("feature").agg(F.sum(F.col("q") * F.col("rows") / F.col("c") - F.col("c")).alias("chi2"))
    v = F.when(F.least("rows", "cols") > 1, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("t") * (F.least("rows", "cols") - 1)))).otherwise(0.0)
    return chi.join(t, "feature").select("feature", F.col("t").alias("n"), v.alias("v"))


def leak_exact(df: DataFrame, outcome: str, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, exact, near, over the rows where both values are there: equal to the outcome in all of them; or else close as numbers,
    or equal as trimmed lower-case texts where one of the two is no number. Without such rows both are false.
    """
    cols, t, numbers = [c for c in cols or df.columns if c != outcome], c_(outcome), numeric_columns(df)
    kinds, per = dict(df.dtypes), {}
    for c in cols:
        x, both = c_(c), c_(c).isNotNull() & t.isNotNull()
        if c in numbers and outcome in numbers:
            same, close = x.cast("double") == t.cast("double"), F.abs(x.cast("double") - t.cast("double")) <= 1e-8 + 1e-5 * F.abs(t.cast("double"))
        else:
            same = x == t if kinds[c] == kinds[outcome] else F.lit(False)
            close = F.lower(S.strip(x.cast("string"))) == F.lower(S.strip(t.cast("string")))
        per[c] = {"exact": F.coalesce(F.bool_and(F.when(both, same)), F.lit(False)), "close": F.coalesce(F.bool_and(F.when(both, close)), F.lit(False))}
    return _rows(df, per).select("feature", "exact", (~F.col("exact") & F.col("close")).alias("near"))


def leak_names(cols: Sequence[str], outcome: str, strict: bool = False) -> list[str]:
    """Columns whose name holds a target-like word; ``strict`` asks for the word as a whole token."""
    words = {*LEAK_NAMES, outcome.lower()}
    parts = lambda c: set(re.split(r"[^a-z0-9]+", c.lower()))
    return [c for c in cols if c != outcome and (parts(c) & words if strict else any(w in c.lower() for w in words))]


def leak_determinism(df: DataFrame, id_col: str, outcome: str) -> DataFrame:
    """n, ids, repeated, single: whether ids that repeat have one outcome only."""
    per = df.filter(c_(id_col).isNotNull() & c_(outcome).isNotNull()).groupBy(c_(id_col)).agg(F.count(F.lit(1)).alias("k"), F.min(c_(outcome)).alias("lo"), F.max(c_(outcome)).alias("hi"))
    again = F.col("k") > 1
    out = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("ids"), F.count_if(again).alias("repeated"), F.count_if(again & (F.col("lo") == F.col("hi"))).alias("single"))
    return out.withColumn("deterministic", (F.col("n") >= 200) & (F.col("repeated") >= 25) & (F.col("single") >= 0.98 * F.col("repeated")))


def group_stats(df: DataFrame, number: str, category: str, top: int = 10) -> DataFrame:
    """category, n, mean, median of the ``top`` most frequent categories."""
    d = df.filter(num_(number).isNotNull() & c_(category).isNotNull())
    d = d.select(c_(category).cast("string").alias("category"), num_(number).alias("v"))
    out = d.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).orderBy(F.desc("n"), "category").limit(top)
    median = quantiles(d.join(F.broadcast(out.select("category")), "category"), ["category"], "v", [0.5])  # ``top`` rows
    return out.join(median.select("category", F.get("q", F.lit(0)).alias("median")), "category")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y over x."""
    a, b = num_(x), num_(y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_count(b, a).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """bin, n over equal widths between the least and the greatest value, the last bin closed."""
    v = num_(col)
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    return df.filter(v.isNotNull()).join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, number: str, category: str) -> DataFrame:
    """Quartiles and whisker fences by category, as a box plot needs them."""
    rows = df.filter(c_(category).isNotNull()).select(c_(category).cast("string").alias("category"), num_(number).alias("v"))
    out = rows.groupBy("category").agg(F.min("v").alias("min"), F.max("v").alias("max")).join(quantiles(rows, ["category"], "v", [0.25, 0.5, 0.75]), "category", "left")
    return out.select("category", "min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "max")


def grid_counts(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """x_bin, y_bin, n of a two-dimensional histogram."""
    a, b = num_(x), num_(y)
    span = df.agg(F.min(a).alias("xl"), F.max(a).alias("xh"), F.min(b).alias("yl"), F.max(b).alias("yh"))
    at = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), F.floor((v - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins))).otherwise(0).cast("int")
    return df.filter(a.isNotNull() & b.isNotNull()).join(F.broadcast(span)).groupBy(at(a, "xl", "xh").alias("x_bin"), at(b, "yl", "yh").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def feature_quality(df: DataFrame, outcome: str | None = None, weights: tuple = (0.35, 0.20, 0.20, 0.10, 0.15), leaking: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """feature, type, missing_rate, unique_ratio, diversity_score, outlier_rate, leakage_flag, quality_score."""
    cols = [c for c in cols or df.columns if c != outcome]
    nums = [c for c in numeric_columns(df) if c in cols]
    freq = value_counts(df, cols)
    total = freq.groupBy("feature").agg(F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"))
    p = F.col("n") / F.col("nn")
    entropy = freq.join(total, "feature").groupBy("feature").agg((-F.sum(p * F.log(p + 1e-12))).alias("h"))
    base = _rows(df, {c: {"missing": F.count_if(c_(c).isNull())} for c in cols}, {"rows": F.count(F.lit(1))}).join(total, "feature", "left").join(entropy, "feature", "left")
    if nums:
        d = {r.feature: r for r in describe(df, nums).collect()}
        per = {}
        for c in nums:
            q1, q3 = d[c].q1 or 0.0, d[c].q3 or 0.0
            iqr = max(q3 - q1, 1e-9)
            v = c_(c).cast("double")
            var = F.when(F.count(v) > 1, F.var_samp(v)).otherwise(0.0)
            per[c] = {"spread": F.tanh(var / (iqr**2 + 1e-9)), "out": F.when(F.count(v) >= 20, F.count_if((v < q1 - 1.5 * iqr) | (v > q3 + 1.5 * iqr)) / F.count(v)).otherwise(0.0)}
        base = base.join(_rows(df, per), "feature", "left")
    else:
        base = base.withColumns({"spread": F.lit(None).cast("double"), "out": F.lit(None).cast("double")})
    number = F.col("feature").isin(nums) if nums else F.lit(False)
    some = F.coalesce("nn", F.lit(0)) > 0
    unique = F.when(some, F.col("k") / F.col("nn")).otherwise(0.0)
    diversity = F.when(number, F.coalesce("spread", F.lit(0.0))).when(some, F.col("h") / F.greatest(F.log(F.col("k").cast("double")), F.lit(1e-9))).otherwise(0.0)
    out = base.select(
        "feature",
        F.when(number, "numeric").otherwise("categorical").alias("type"),
        (F.col("missing") / F.col("rows")).alias("missing_rate"),
        unique.alias("unique_ratio"),
        diversity.alias("diversity_score"),
        F.coalesce("out", F.lit(0.0)).alias("outlier_rate"),
        (F.col("feature").isin(list(leaking)) if leaking else F.lit(False)).alias("leakage_flag"),
    )
    u = F.col("unique_ratio")
    uniq = F.when(F.col("type") == "numeric", 1 - N.clip((u - 0.98) / 0.02, 0.0, 1.0)).otherwise(F.exp(-F.pow((u - 0.20) / 0.30, 2)))
    outl = 1 - F.least(F.col("outlier_rate") / 0.10, F.lit(1.0))
    raw = weights[0] * (1 - F.col("missing_rate")) + weights[1] * uniq + weights[2] * F.col("diversity_score") + weights[3] * outl - weights[4] * F.col("leakage_flag").cast("int")
    return out.withColumn("quality_score", N.clip(raw, 0.0, 1.0) * 100)


# Parts of the names of phone and date columns, and the formats told apart; two of the dates look alike.
PHONE_PARTS = ("phone", "fax", "mobile", "tel")
DATE_PARTS = ("date", "dt", "time", "timestamp")
FORMATS = {
    "phone": (r"^\d{10}$", r"^\d{3}-\d{3}-\d{4}$", r"^\(\d{3}\)\s*\d{3}-\d{4}$", r"^\+1\d{10}$", r"^\d{3}\.\d{3}\.\d{4}$", r"^\d{3}\s\d{3}\s\d{4}$"),
    "date": (r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}-[A-Za-z]{3}-\d{4}$", r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{4}$"),
}


def format_of(name: str) -> str | None:
    """phone or date, by a column's name, or None."""
    low = name.lower()
    return "phone" if any(p in low for p in PHONE_PARTS) else "date" if any(p in low for p in DATE_PARTS) else None


def formats(col: str, kind: str | None) -> Column:
    """How many formats a phone or date column has; phones of no format are one more."""
    if kind is None:
        return F.lit(0).cast("bigint")
    seen = [F.count_if(c_(col).rlike(p)) for p in FORMATS[kind]]
    other = [F.count(c_(col)) - sum(seen, F.lit(0))] if kind == "phone" else []
    return sum(((n > 0).cast("bigint") for n in (*seen, *other)), F.lit(0).cast("bigint"))


def alerts(df: DataFrame, outcome: str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, alert_type, severity, value: the rule table over counters, frequencies, moments and outliers."""
    cols = list(cols or df.columns)
    nums, texts = [c for c in numeric_columns(df) if c in cols], [c for c in text_columns(df) if c in cols]
    v = lambda c: c_(c).cast("double")
    per = {}
    for c in cols:
        n = c in nums
        zero = F.lit(0).cast("bigint")
        per[c] = {
            "missing": F.count_if(c_(c).isNull()), "zeros": F.count_if(v(c) == 0) if n else zero, "negative": F.count_if(v(c) < 0) if n else zero,
            "skew": adjusted_skew(v(c)) if n else F.lit(None).cast("double"),
            "digits": F.count_if(c_(c).rlike(N.NUMERIC)) if c in texts else zero, "formats": formats(c, format_of(c)) if c in texts else zero,
        }
    base = _rows(df, per, {"rows": F.count(F.lit(1))})
    freq = value_counts(df, cols).groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"), F.min("n").alias("least"), (F.count(F.lit(1)) - F.countDistinct(F.lower("value"))).alias("by_case"))
    t = base.join(freq, "feature", "left").withColumns({"nn": F.col("rows") - F.col("missing"), "k": F.coalesce("k", F.lit(0))})
    if nums:
        t = t.join(outliers(df, nums).select("feature", "outliers", F.col("pct").alias("out_pct")), "feature", "left")
    else:
        t = t.withColumns({"outliers": F.lit(0), "out_pct": F.lit(0.0)})
    num = F.col("feature").isin(nums) if nums else F.lit(False)
    txt = F.col("feature").isin(texts) if texts else F.lit(False)
    shaped = [x for c in texts if format_of(c) for x in (F.lit(c), F.lit(format_of(c)))]
    kind = F.try_element_at(F.create_map(*shaped), F.col("feature")) if shaped else F.lit(None).cast("string")
    miss, top = F.col("missing") / F.col("rows"), F.col("top") / F.col("nn")
    some, flat = F.col("nn") > 0, F.col("k") == 1
    live = some & ~flat
    rules = [
        ("HIGH MISSING", miss * 100, F.when(miss >= 0.5, "HIGH").when(miss >= 0.2, "MEDIUM")),
        ("MIXED TYPE", F.col("digits").cast("double"), F.when(some & txt & (F.col("digits") > 0) & (F.col("digits") < F.col("nn")), "HIGH")),
        ("CONSTANT", F.col("k").cast("double"), F.when(some & flat & (num | txt), "HIGH")),
        ("NEAR CONSTANT", top * 100, F.when(live & (num | txt) & (top >= 0.99), "MEDIUM")),
        ("ZEROS DOMINANT", F.col("zeros") / F.col("nn") * 100, F.when(live & num & (F.col("zeros") / F.col("nn") >= 0.9), "MEDIUM")),
        ("SKEWED", F.col("skew"), F.when(live & num & (F.abs("skew") > 5), "HIGH").when(live & num & (F.abs("skew") > 2), "MEDIUM")),
        ("OUTLIERS", F.col("out_pct"), F.when(live & num & (F.col("outliers") > 0), F.when(F.col("out_pct") > 5, "HIGH").when(F.col("out_pct") > 1, "MEDIUM").otherwise("LOW"))),
        ("NEGATIVE VALUES", F.col("negative").cast("double"), F.when(live & num & (F.col("negative") > 0), "LOW")),
        ("UNIQUE", F.col("k").cast("double"), F.when(live & (num | txt) & (F.col("k") == F.col("nn")) & (F.col("nn") > 50), "MEDIUM")),
        ("HIGH CARDINALITY", F.col("k") / F.col("nn") * 100, F.when(live & txt & (F.col("k") / F.col("nn") >= 0.5) & (F.col("k") < F.col("nn")) & (F.col("k") > 50), "MEDIUM")),
        ("FORMAT INCONSISTENCY", F.col("formats").cast("double"), F.when(live & txt & (F.col("formats") > 1), F.when(kind == "phone", "HIGH").when(kind == "date", "MEDIUM"))),
        ("FORMAT INCONSISTENCY", F.col("by_case").cast("double"), F.when(live & txt & kind.isNull() & (F.col("by_case") > 0), "LOW")),
    ]
    if outcome:
        least = F.col("least") / F.col("nn")
        rules.append(("IMBALANCED TARGET", least * 100, F.when((F.col("feature") == outcome) & some & (least < 0.05), "HIGH").when((F.col("feature") == outcome) & some & (least < 0.15), "MEDIUM")))
    hit = F.explode(F.filter(F.array(*[F.struct(F.lit(name).alias("alert_type"), sev.alias("severity"), val.cast("double").alias("value")) for name, val, sev in rules]), lambda r: r["severity"].isNotNull()))
    out = t.select("feature", hit.alias("r")).select("feature", "r.*")
    dup = duplicate_rows(df, cols).filter("n_dup > 0").select(F.lit("(dataset)").alias("feature"), F.lit("DUPLICATE ROWS").alias("alert_type"), F.lit("HIGH").alias("severity"), F.col("n_dup").cast("double").alias("value"))
    return out.unionByName(dup)


def sorted_alerts(a: DataFrame) -> DataFrame:
    return a.orderBy(F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2), "feature", "alert_type")


def type_counters(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """What the type rules ask of each column: rows, nulls, blanks, distinct values, integral and numeric shares, serial dates.

    Every rule looks at the distinct values, weighted by their counts; medians are taken of columns of numbers only.
    """
    cols = list(cols or df.columns)
    numbers = [c for c in numeric_columns(df) if c in cols]
    values = value_counts(df, cols).withColumn("x", N.parse_number(F.col("value")))
    s, x = F.col("value"), F.col("x")
    rows = lambda rule: F.sum(F.when(rule, F.col("n")).otherwise(0))
    whole, size = x == F.floor(x), F.abs(x)
    year = x.between(1900, 2100)
    counts = {
        "known": F.sum("n"), "n_unique": F.count(F.lit(1)), "blanks": rows(S.strip(s) == ""), "numeric": rows(x.isNotNull()), "integral": rows(whole), "serial": rows(x.between(20000, 60000)),
        "leading_zero": rows(s.rlike(r"^0\d+")), "date_text": F.greatest(*[rows(s.rlike(p)) for p in DATE_TEXTS]), "date_token": rows(F.lower(s).rlike(DATE_TOKENS)), "stand_in": rows(F.lower(S.strip(s)).isin(*CONSTANT_STAND_INS)),
        "same_length": F.greatest(*[rows(whole & (size >= 10 ** (k - 1)) & (size < 10**k)) for k in range(7, 19)]), "year": rows(whole & year),
        "year_month": rows(whole & F.floor(x / 100).between(1900, 2100) & (x % 100).between(1, 12)), "month_year": rows(whole & F.floor(x / 10000).between(1, 12) & (x % 10000).between(1900, 2100)),
    }
    ends = {"max_abs": F.max(size), "year_span": F.max(F.when(year, x)) - F.min(F.when(year, x))}
    found = values.groupBy("feature").agg(*[e.alias(k) for k, e in (counts | ends).items()])
    fixed = df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"), "rows")
    out = fixed.join(F.broadcast(found), "feature", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in counts})  # a row per column
    out = out.withColumn("nulls", F.col("rows") - F.col("known")).drop("known")
    if not numbers:
        return out.withColumn("median_abs", F.lit(None).cast("double"))
    sizes = values.filter(F.col("feature").isin(numbers)).select("feature", size.alias("v"), "n")
    middle = quantiles(sizes, ["feature"], "v", [0.5], times="n").select("feature", F.get("q", F.lit(0)).alias("median_abs"))
    return out.join(F.broadcast(middle), "feature", "left")


#: Bits of a column's mark of hashes; as many of them are set as the column has values at least.
MARKS = 64


def deciding_counters(df: DataFrame, cols: Sequence[str] | None = None) -> list:
    """The counters that :func:`decide_type` asks for, a row per column: as :func:`type_counters` has them where distinct values
    or texts count, from one aggregate that shuffles a row per column and task where they don't.

    Numbers are looked at row by row. Values are hashed onto ``MARKS`` bits, so over ten set bits prove over ten values; then their exact number
    is asked for only by an identifier's name, and by whole numbers that reach a million. Of dates only their presence counts.
    """
    cols, kinds = list(cols or df.columns), {f.name: f.dataType for f in df.schema}
    days = [c for c in cols if isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    plain = [c for c in cols if isinstance(kinds[c], T.NumericType) and not isinstance(kinds[c], T.FloatType) and not named_id(c)]
    found = []
    if days or plain:
        number = lambda c: F.lit(None).cast("double") if c in days else c_(c).cast("double")
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), c_(c).isNotNull().alias("known"), number(c).alias("x")) for c in (*days, *plain)]))
        # A few sums of long rows: as many for each column of a wide row are too large to be compiled.
        x = F.col("x")
        whole, size, year = x == F.floor(x), F.abs(x), x.between(1900, 2100)
        mark = F.bit_or(F.when(x.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(MARKS)).cast("int"))))
        rules = {
            "known": F.col("known"), "numeric": x.isNotNull(), "integral": whole, "serial": x.between(20000, 60000), "year": whole & year,
            "year_month": whole & F.floor(x / 100).between(1900, 2100) & (x % 100).between(1, 12), "month_year": whole & F.floor(x / 10000).between(1, 12) & (x % 10000).between(1900, 2100),
        }
        ends = {"rows": F.count(F.lit(1)), "max_abs": F.max(size), "year_span": F.max(F.when(year, x)) - F.min(F.when(year, x)), "n_unique": F.bit_count(mark).cast("long")}
        none = {k: F.lit(0).cast("long") for k in ("blanks", "leading_zero", "date_text", "date_token", "stand_in", "same_length")}
        # Neither NaN nor infinite values, which are no numbers as text.
        long = df.select(cells.alias("r")).select("r.feature", "r.known", F.when(F.abs("r.x") < float("inf"), F.col("r.x")).alias("x"))
        rows = long.groupBy("feature").agg(*[F.count_if(e).alias(k) for k, e in rules.items()], *[e.alias(k) for k, e in ends.items()])
        rows = rows.withColumns({"nulls": F.col("rows") - F.col("known"), "median_abs": F.lit(None).cast("double")} | none)
        found = [r for r in rows.collect() if r.feature in days or _decided(r)]
    rest = [c for c in cols if c not in {r.feature for r in found}]
    return found + (type_counters(df, rest).collect() if rest else [])


def _decided(r) -> bool:
    """Whether a column of numbers has its type by counters without exact distinct values."""
    n = r.rows - r.nulls
    return n == 0 or (r.n_unique or 0) > 10 and (r.integral < n or (r.max_abs or 0) < 1e6)


def named_id(name: str) -> bool:
    """Whether a column is named like an identifier, by any of the rules."""
    low = name.lower()
    return any(x in low for x in ID_PARTS) or bool(set(re.split(r"[_. ]", low)) & set(ID_WORDS)) or low.startswith(ID_FAMILIES) or low.endswith(ID_FAMILIES)


def feature_types(df: DataFrame, outcome: str | None = None, cols: Sequence[str] | None = None) -> dict[str, str]:
    """outcome, unknown, datetime, id, binary, categorical or numeric for each column, from one pass of counters."""
    return _types_of(df, deciding_counters(df, cols), cols or df.columns, outcome)


def _types_of(df: DataFrame, counters: Sequence, cols: Sequence[str], outcome: str | None = None, single: bool = False) -> dict[str, str]:
    kinds = {f.name: f.dataType for f in df.schema}
    out = {r.feature: "outcome" if r.feature == outcome else decide_type(r.feature, kinds[r.feature], r, single) for r in counters}
    return {c: out[c] for c in cols}


def single_type(df: DataFrame, col: str, outcome: str | None = None) -> str:
    """The type of one column by the rules for a single column."""
    return single_types(df, [col], outcome)[col]


def single_types(df: DataFrame, cols: Sequence[str] | None = None, outcome: str | None = None) -> dict[str, str]:
    """Each column's type by the rules for a single column, from one pass."""
    return _types_of(df, deciding_counters(df, cols), cols or df.columns, outcome, single=True)


def _serial_of(counters: Sequence) -> list[str]:
    return [r.feature for r in counters if r.serial > 0.8 * (r.rows - r.nulls)]


def serial_dates(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns of numbers whose values are mostly Excel serial dates; calendar years are not."""
    return _serial_of(deciding_counters(df, cols)) if cols else []


def columns_of_type(types: dict[str, str], *kinds: str) -> list[str]:
    return [c for c, k in types.items() if k in kinds]


def fixed_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Numbers that are Excel serial dates become dates, timestamps are cut to the day; a new table, the input stays as it is. ``types`` saves looking for types."""
    kinds = {f.name: f.dataType for f in df.schema}
    counters = [] if types == {} else deciding_counters(df, list(types) if types else None)
    types = _types_of(df, counters, df.columns) if types is None else types
    numbers = {c for c in columns_of_type(types, "datetime") if isinstance(kinds[c], T.NumericType)}
    serial = numbers & set(_serial_of(counters))
    out = []
    for c, k in kinds.items():
        if c in serial:
            out.append(D.from_excel_serial(c_(c)).alias(c))
        elif isinstance(k, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_trunc("DAY", c_(c)).alias(c))
        else:
            out.append(c_(c))
    return df.select(*out)


def displayed_date(c: Column, kind: T.DataType) -> Column:
    """``YYYY-MM-DD`` of a date or of a serial number; other numbers and texts as they are."""
    if isinstance(kind, T.NumericType):
        return F.when(c.between(20000, 60000), F.date_format(D.from_excel_serial(c), "yyyy-MM-dd")).otherwise(c.cast("string"))
    return c if isinstance(kind, T.StringType) else F.date_format(c, "yyyy-MM-dd")


def decide_type(name: str, kind: T.DataType, r, single: bool = False) -> str:
    """The type of a column from its counters. ``single``, for a look at one column: every constant that is no number is unknown, and small
    integers are numeric.
    """
    n, low = r.rows - r.nulls, name.lower()
    number = isinstance(kind, (T.NumericType, T.BooleanType))
    if n == 0 or r.blanks == n:
        return "unknown"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if number and r.n_unique > 1 and (r.serial > 0.8 * n or (r.year > 0.8 * n and 1 <= (r.year_span or 0) <= 150) or r.year_month > 0.8 * n or r.month_year > 0.8 * n):
        return "datetime"
    if not number and (r.date_text == n or r.date_token > 0.8 * n):
        return "datetime"
    ratio = r.n_unique / max(r.rows, 1)
    tokens = set(re.split(r"[_. ]", low))
    if r.n_unique == 1 and not number and (single or r.stand_in == n):
        return "unknown"
    if any(x in low for x in ID_PARTS) and ratio > 0.80 or tokens & set(ID_WORDS) and ratio > 0.05:
        return "id"
    if low.startswith(ID_FAMILIES) and ratio > 0.05 or low.endswith(ID_FAMILIES) and ratio > 0.05:
        return "id"
    if number and r.n_unique > 10 and r.integral == n:
        mid = r.median_abs or 0
        if (mid >= 1e6 and ratio > 0.02) or (mid >= 1e9 and ratio > 0.01) or (r.same_length >= 0.9 * n and ratio > 0.02):
            return "id"
    if r.n_unique == 2:
        return "binary"
    if number:
        return "categorical" if not single and 3 <= r.n_unique <= 10 and r.integral == n and (r.max_abs or 0) <= 100 else "numeric"
    if r.numeric > 0.8 * n and r.leading_zero <= 0.05 * n and ratio <= 0.95:
        return "numeric"
    return "categorical"
