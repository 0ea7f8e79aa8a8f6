"""Cleaning: issue flags, standardized values, address parts, duplicate flags, quality scores.

Everything up to the duplicate flags is one projection of the input; raw and clean values travel in the same row. The two
duplicate flags are two hash shuffles, the scores one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import strings as S

# Role of a column by substrings of its name, the first that fits.
ROLES = (
    ("phone", ("phone", "mobile")), ("tin", ("tin",)), ("address", ("address",)), ("city", ("city",)), ("state", ("state",)), ("zip", ("zip", "postal")),
    ("company_name", ("company", "business")), ("dba", ("dba",)), ("first_name", ("first",)), ("last_name", ("last",)),
)
TAGS = {"ws": "WHITESPACE_ISSUE", "sc": "SPECIAL_CHARS", "is_missing": "MISSING_VALUE", "format": "FORMAT_ISSUE"}
# Shapes of a physical address part, and street words.
ADDRESS_SHAPE = r"(^\d+)|(P\.?O\.?\s*BOX)|(PO BOX)|(STE\s+\d+)|(UNIT\s+\w+)|(DEPT\s+\d+)|(ROUTE\s+\d+)|(PMB\s+\d+)|(^[A-Z]\d+)"
STREET_WORD = r"\b(AVE|BLVD|DR|ST|RD|LN|WAY|PKWY|CIR|PL|TR|CT|HWY|HIGHWAY|ROAD|COURT|STREET|URB|CALLE)\b"
PARTS = ("address_1", "address_2", "city", "region", "zip_code", "country", "full_address")
# What a clean value of a role must look like.
CLEAN_SHAPE = {"tin": r"^\d{2}-\d{7}$", "phone": r"^(\+1 )?\(\d{3}\) \d{3}-\d{4}$", "zip": r"^\d{5}$"}


def c_(name: str) -> Column:
    return F.col(f"`{name}`")


def infer_roles(df: DataFrame) -> dict[str, str]:
    """{role_column: column} from column names, with ``datetime`` for timestamp columns; no data is read."""
    out = {}
    for f in df.schema:
        low = f.name.lower()
        role = next((r for r, keys in ROLES if any(k in low for k in keys)), "datetime" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else None)
        if role:
            out[f"{role}_{f.name}"] = f.name
    return out


def role_of(key: str) -> str | None:
    return next((r for r in ("phone", "zip", "tin", "address", "datetime", "company_name", "dba", "first_name", "last_name", "city", "state", "country") if key.startswith(r)), None)


FORMAT = {"phone": S.phone_issue, "zip": S.zip_issue, "tin": S.tin_issue}
STANDARD = {
    "phone": S.standardize_phone, "zip": S.standardize_zip, "tin": S.standardize_tin, "address": S.standardize_name, "datetime": D.standardize_datetime, "company_name": S.standardize_name, "dba": S.standardize_name,
    "first_name": S.standardize_name, "last_name": S.standardize_name, "city": S.standardize_name, "state": S.standardize_state, "country": S.standardize_country,
}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def issue_flags(df: DataFrame, roles: dict[str, str], cols: list[str] | None = None) -> dict[str, Column]:
    """Name -> flag: ``<c>_has_ws``, ``_has_sc``, ``_is_missing`` for text columns, ``_has_format`` by role."""
    out = {}
    for c in cols or text_columns(df):
        out |= {f"{c}_has_ws": S.has_whitespace_issue(c_(c)), f"{c}_has_sc": S.has_special_chars(c_(c)), f"{c}_is_missing": S.is_missing(c_(c))}
    for key, c in roles.items():
        if c in df.columns and (check := FORMAT.get(role_of(key))):
            out[f"{c}_has_format"] = check(c_(c))
    return out


def kind_of(flag: str) -> str:
    return next(k for k in ("is_missing", "format", "ws", "sc") if flag.endswith(k))


def issue_matrix(df: DataFrame, roles: dict[str, str], cols: list[str] | None = None) -> DataFrame:
    """``df`` with its flags, ``_has_issue`` and the sorted distinct ``_issue_tags``."""
    flags = issue_flags(df, roles, cols)
    kinds = sorted({kind_of(f) for f in flags}, key=lambda k: TAGS[k])
    hit = {k: F.greatest(*v) if len(v := [c_(f) for f in flags if kind_of(f) == k]) > 1 else v[0] for k in kinds}
    tags = F.concat_ws(",", *[F.when(hit[k], TAGS[k]) for k in kinds])
    return df.withColumns(flags).withColumn("_tags", tags).withColumns({"_has_issue": F.col("_tags") != "", "_issue_tags": F.when(F.col("_tags") == "", "GOOD_DATA").otherwise(F.col("_tags"))}).drop("_tags")


# These read their argument and steps of it several times.
STEPPED = (S.standardize_phone, S.standardize_zip, S.standardize_tin, S.standardize_state)


class Steps:
    """A table that grows by the steps of its expressions.

    Each step is a column, so it is computed once per row, and only where it is asked for.
    """

    def __init__(self, df: DataFrame):
        self.out, self.kept, self.at, self.n = df, df.columns, "_s", 0
        while any(c.lower().startswith(self.at) for c in df.columns):
            self.at += "_"

    def let(self, c: Column) -> Column:
        self.n += 1
        self.out = self.out.withColumn(f"{self.at}{self.n}", c)
        return c_(f"{self.at}{self.n}")

    def standard(self, f: Callable[..., Column], v: Column) -> Column:
        return f(self.let(v), self.let) if f in STEPPED else f(v)

    def done(self, cols: dict[str, Column]) -> DataFrame:
        """The table as it was, with ``cols`` and without the steps."""
        return self.out.withColumns(cols).select(*[c_(c) for c in dict.fromkeys([*self.kept, *cols])])


def clean_value(df: DataFrame, roles: dict[str, str], c: str, standard: Callable[..., Column] = lambda f, v: f(v)) -> Column:
    """The standardized value of a column: cleaned text, then the standardizers of its roles in their order."""
    v = S.clean_text(c_(c)) if c in text_columns(df) else c_(c)
    for key, col in roles.items():
        if col == c and (f := STANDARD.get(role_of(key))):
            v = standard(f, v)
    return v


def with_clean_values(df: DataFrame, roles: dict[str, str], cols: Sequence[str], names: Callable[[str], str] = lambda c: c) -> DataFrame:
    """``df`` with the :func:`clean_value` of ``cols``, each under the name that ``names`` gives."""
    steps = Steps(df)
    return steps.done({names(c): clean_value(df, roles, c, steps.standard) for c in cols})


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


def is_company(part: str, key: str, names: tuple[str, str]) -> bool:
    """Whether an address part is just the company's name; ``key`` and ``names`` are match keys."""
    if len(key) <= 3:
        return False
    names = [n for n in names if n]
    if key in names:
        return True
    # A ratio is at most 2 * shorter / (both lengths): below 0.65 no rule can hold.
    ratios = [similarity(key, n) for n in names if 2 * min(len(key), len(n)) / (len(key) + len(n)) > 0.65]
    best = max(ratios, default=0.0)
    return best > 0.85 or (not part[:1].isdigit() and best > 0.65 and any(len(n) > 5 and n in key for n in names))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _without_company(parts: pa.Array, doubtful: pa.Array, legal: pa.Array, dba: pa.Array) -> pa.Array:
    """The parts of each row without those that are doubtful and the company's name; rows without a doubtful part come as null.

    Only rows with a doubtful part become Python objects.
    """
    asked = np.flatnonzero(doubtful.is_valid().to_numpy(zero_copy_only=False))
    some = [a.take(pa.array(asked)).to_pylist() for a in (parts, doubtful, legal, dba)]
    kept = []
    for ps, ds, a, b in zip(*some, strict=True):
        names = (a or "", b or "")
        kept.append([p for p, d in zip(ps, ds, strict=True) if d is None or not is_company(d, "".join(x for x in d.upper() if x.isascii() and x.isalnum()), names)])
    at = np.full(len(doubtful), -1)
    at[asked] = np.arange(len(asked))
    return pa.array(kept, pa.list_(pa.string())).take(pa.array(at, mask=at < 0))


def address_parts(addr: Column, legal: Column, dba: Column, fuzzy: bool = True, let: Callable[[str, Column], Column] = lambda name, c: c) -> dict[str, Column]:
    """The seven parts of ``[name|]street[|unit]|city|region|zip|country``.

    Fewer than four parts: the first is the street. Without ``fuzzy`` a part counts as the company's name only if its key is equal,
    and the whole expression is native; with it, similar names are found by an Arrow function over the doubtful parts.
    ``let`` is given each step that several others read; :func:`with_address_parts` makes columns of them.
    """
    addr = let("raw", addr)
    none = let("none", addr.isNull() | (S.strip(addr) == "") | (F.lower(addr) == "nan"))
    parts = let("parts", F.transform(F.split(addr, r"\|", -1), S.strip))
    legal, dba = let("legal", S.match_key(legal)), let("dba", S.match_key(dba))
    n = F.size(parts)
    front = let("front", F.filter(F.slice(parts, 1, F.greatest(n - 4, F.lit(0))), lambda p: p != ""))
    physical = lambda p: F.upper(p).rlike(ADDRESS_SHAPE) | F.upper(p).rlike(STREET_WORD)
    if fuzzy:
        doubtful = let("doubtful", F.transform(front, lambda p: F.when(~physical(p), p)))
        some = F.when(F.exists(doubtful, lambda p: p.isNotNull()), doubtful)
        kept = let("left", F.coalesce(_without_company(front, some, legal, dba), front))
    else:
        keys = let("keys", F.transform(front, S.match_key))
        same = lambda k: (F.length(k) > 3) & ((k == legal) | (k == dba))
        kept = let("left", F.filter(front, lambda p, i: ~same(F.get(keys, i)) | physical(p)))
    kept = let("kept", F.when((F.size(kept) == 0) & (n > 4), F.array(F.get(parts, n - 5))).otherwise(kept))
    short, bare = n < 4, n == 4
    one = let("one", F.coalesce(F.get(kept, F.lit(0)), F.lit("")))
    rest = let("rest", F.array_join(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), ", "))
    tail = {p: F.coalesce(F.get(parts, n - k), F.lit("")) for p, k in (("city", 4), ("region", 3), ("zip_code", 2), ("country", 1))}
    whole = F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in (one, rest, *tail.values())])
    pick = lambda long, few, four: F.when(none, "").when(short, few).when(bare, four).otherwise(long)
    first = F.get(parts, F.lit(0))
    out = {"address_1": pick(one, first, F.lit("")), "address_2": pick(rest, F.lit(""), F.lit(""))}
    out |= {p: pick(v, F.lit(""), v) for p, v in tail.items()}
    return out | {"full_address": pick(whole, first, addr)}


def with_address_parts(df: DataFrame, addr: Column, legal: Column, dba: Column, fuzzy: bool = True, prefix: str = "") -> DataFrame:
    """``df`` with the :func:`address_parts` as ``<prefix>address_1`` and so on. Steps are columns, so each is computed once per row."""
    out, at = df, "_a"
    while any(c.lower().startswith(at) for c in df.columns):
        at += "_"

    def let(name: str, c: Column) -> Column:
        nonlocal out
        out = out.withColumn(f"{at}{name}", c)
        return c_(f"{at}{name}")

    found = address_parts(addr, legal, dba, fuzzy, let)
    return out.select(*[c_(c) for c in df.columns], *[v.alias(f"{prefix}{k}") for k, v in found.items()])


PART_STANDARD = {"address_1": S.standardize_name, "address_2": S.standardize_name, "city": S.standardize_name, "region": S.standardize_state, "zip_code": S.standardize_zip, "country": S.standardize_country, "full_address": S.standardize_name}


def with_parsed_address(df: DataFrame, addr: str, legal: str | None, dba: str | None, suffix: str = "_std", fuzzy: bool = True) -> DataFrame:
    none = F.lit(None).cast("string")
    out = with_address_parts(df, c_(addr), c_(legal) if legal else none, c_(dba) if dba else none, fuzzy, "_part_")
    steps = Steps(out)
    return steps.done({f"{p}{suffix}": steps.standard(PART_STANDARD[p], F.col(f"_part_{p}")) for p in PARTS}).drop(*[f"_part_{p}" for p in PARTS])


def duplicate_flag(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``name`` = Yes for rows whose keys are all non-blank and occur more than once, else No.

    Keys are counted by an aggregate, which combines before it shuffles, and only repeated ones are joined back. Rows with a blank key carry
    a number of their own into the join, or all of them would meet in one task; a frequent key is split by the engine's skew join.
    """
    marks = [f"_k{i}" for i in range(len(keys))]
    full = F.lit(True)
    for m in marks:
        full = full & (F.col(m) != "")
    rows = df.withColumns(dict(zip(marks, keys, strict=True))).withColumn("_alone", F.when(full, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    # Counted by a condition, since a filter on the keys would move below them and compute them, similar names included, once more.
    again = rows.groupBy(*marks).agg(F.count_if(full).alias("_n")).filter("_n > 1").withColumn("_alone", F.lit(-1).cast("bigint"))
    return rows.join(again, [*marks, "_alone"], "left").select(*[c_(c) for c in df.columns if c != name], F.when(F.col("_n").isNull(), "No").otherwise("Yes").alias(name))


def cleaned(df: DataFrame, roles: dict[str, str], suffix: str = "_std", fuzzy: bool = True, untouched: Sequence[str] = ()) -> DataFrame:
    """Raw columns but the ``untouched`` ones standardized in place, parsed address columns, name and TIN columns, and the two duplicate flags.

    Format checks and the address read the raw value, standardizers the cleaned one.
    """
    find = lambda test: next((c for c in df.columns if test(c.lower())), None)
    addr = find(lambda c: "business_address" in c)
    new, at = [c for c in df.columns if c not in untouched], "_new_"
    while any(c.lower().startswith(at) for c in df.columns):
        at += "_"
    out = with_clean_values(df, roles, new, lambda c: at + c)
    if addr:
        legal = find(lambda c: "lgl_nm" in c)
        dba = find(lambda c: "dba_nm" in c or ("dba" in c and "lgl" not in c))
        out = with_parsed_address(out, addr, legal, dba, suffix, fuzzy)
    parts = [c for c in out.columns if c not in df.columns and not c.startswith(at)]
    out = out.select(*[c_(at + c).alias(c) if c in new else c_(c) for c in df.columns], *[c_(c) for c in parts])
    tin, legal, dba = (find(lambda c, n=n: c == n) for n in ("tin", "lgl_nm", "dba_nm"))
    empty = F.lit("")
    steps = Steps(out)
    out = steps.done({
        f"TIN{suffix}_no_format": S.tin_digits(c_(tin), steps.let) if tin else empty,
        f"lgl_nm{suffix}": S.standardize_name(c_(legal)) if legal else empty,
        f"dba_nm{suffix}": S.standardize_name(c_(dba)) if dba else empty,
    })
    out = duplicate_flag(out, [S.match_key(F.col(f"TIN{suffix}_no_format"))], "Duplicate_TIN_CHECK")
    part = lambda p: F.col(f"{p}{suffix}") if addr else empty
    return duplicate_flag(out, [S.match_key(part("address_1")), S.match_key(S.standardize_zip(part("zip_code"))), S.match_key(part("city"))], "Duplicate_Address_CHECK")


def _score(m: Column, i: Column, n: Column) -> list[Column]:
    m_pct, i_pct = m / n * 100, i / n * 100
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (m_pct * 0.5 + i_pct)))
    score = F.when(((m > 0) | (i > 0)) & (score > 99), 99.0).otherwise(score)
    return [F.bround(score).cast("int").alias("score"), m.cast("long").alias("missing"), i.cast("long").alias("invalid"), F.bround(m_pct, 1).alias("m_pct"), F.bround(i_pct, 1).alias("i_pct")]


def _long(sums: DataFrame, cols: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"m{k}").cast("double").alias("m"), F.col(f"i{k}").cast("double").alias("i")) for k, c in enumerate(cols)]))
    return sums.select(F.greatest(F.col("n"), F.lit(1)).cast("double").alias("n"), rows.alias("r")).select("n", "r.*").select("col_name", *_score(F.col("m"), F.col("i"), F.col("n")))


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def quality_raw(df: DataFrame, roles: dict[str, str], cols: list[str] | None = None) -> DataFrame:
    """col_name, score, missing, invalid, m_pct, i_pct per column, from one aggregate."""
    cols, flags = cols or df.columns, issue_flags(df, roles, [c for c in cols or df.columns if c in text_columns(df)])
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(cols):
        aggs.append(_count(flags.get(f"{c}_is_missing", c_(c).isNull())).alias(f"m{k}"))
        aggs.append(sum((_count(flags[f]) for f in (f"{c}_has_ws", f"{c}_has_sc", f"{c}_has_format") if f in flags), F.lit(0)).alias(f"i{k}"))
    return _long(df.agg(*aggs), cols)


def quality_clean(df: DataFrame, roles: dict[str, str], cols: list[str] | None = None) -> DataFrame:
    """The same after standardizing: missing is null only, invalid what still has the wrong shape."""
    cols = cols or df.columns
    clean = with_clean_values(df, roles, cols).select(*[c_(c) for c in cols])
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(cols):
        shape = next((CLEAN_SHAPE.get(role_of(key)) for key, col in roles.items() if col == c), None)
        aggs += [_count(c_(c).isNull()).alias(f"m{k}"), (_count(~S.text(c_(c)).rlike(shape)) if shape else F.lit(0)).alias(f"i{k}")]
    return _long(clean.agg(*aggs), cols)


def global_stats(df: DataFrame, roles: dict[str, str], cols: list[str] | None = None) -> DataFrame:
    """total_rows, rows_with_issues, good_rows, missing_values_count (nulls only)."""
    m = issue_matrix(df, roles, cols)
    nulls = sum((_count(c_(c).isNull()) for c in cols or df.columns), F.lit(0))
    bad = _count(F.col("_has_issue"))
    return m.agg(F.count(F.lit(1)).alias("total_rows"), bad.alias("rows_with_issues"), (F.count(F.lit(1)) - bad).alias("good_rows"), nulls.alias("missing_values_count"))


def overall_score(quality: DataFrame) -> DataFrame:
    """Mean score with one decimal, and its band: above 80, above 50, below."""
    mean = F.bround(F.avg("score"), 1)
    return quality.agg(mean.alias("score")).withColumn("band", F.when(F.col("score") > 80, "high").when(F.col("score") > 50, "medium").otherwise("low"))


def run_data_check_and_cleaning(df: DataFrame, columns_config: dict[str, str], suffix: str = "_std", fuzzy: bool = True) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(clean table, issue table, {global, feature_quality_orig, feature_quality_clean}), all lazy."""
    clean = cleaned(df, columns_config, suffix, fuzzy)
    issues = issue_matrix(df, columns_config)
    stats = {"global": global_stats(df, columns_config), "feature_quality_orig": quality_raw(df, columns_config), "feature_quality_clean": quality_clean(df, columns_config)}
    return clean, issues, stats
