"""Entity resolution: duplicate tags by priority, rollups per taxpayer, tiers, exclusion reports, pools.

Rows need a unique ``rid`` (stands for the physical order). Tags use three groupings: the whole row, (tin, mid), and the identity key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions import strings as S
from .heads import known_dates
from .profile import fixed_types

# The tags by priority.
TAGS = ("EXACT_DUPLICATE", "IDENTITY_GROUP_FRAUD", "TECH_REAPPLICATION", "INVALID_FOR_KYC", "IDENTITY_GROUP_CLEAN", "UNIQUE_CLEAN_NON_LINKED")
TRUE_DUPLICATES = ("EXACT_DUPLICATE", "TECH_REAPPLICATION", "IDENTITY_GROUP_CLEAN")
EXCLUDED = ("EXACT_DUPLICATE", "TECH_REAPPLICATION", "IDENTITY_GROUP_CLEAN", "IDENTITY_GROUP_FRAUD", "INVALID_FOR_KYC")
KYC = (("legal_name", "Legal Name"), ("postal", "Postal Code"))  # beside the TIN
IDENTITY = ("legal_name", "owner_first", "owner_last", "state", "city", "postal")
# What a taxpayer's records call for, by the first tag that is present.
DECISIONS = (
    ("EXACT_DUPLICATE", "Drop copies"), ("IDENTITY_GROUP_FRAUD", "Review fraud group"), ("TECH_REAPPLICATION", "Keep earliest application"),
    ("IDENTITY_GROUP_CLEAN", "Keep latest record"), ("INVALID_FOR_KYC", "Complete missing fields"),
)


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def normalized(df: DataFrame) -> DataFrame:
    """Texts of the key columns trimmed and in upper case; beside them _tin and _mid as integral text and _state and _city without nulls."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    keys = {c: F.upper(S.strip(F.col(c))) for c in ("tin", "mid", *IDENTITY) if c in texts}
    return df.withColumns({"_tin": S.normalized_id(F.col("tin")), "_mid": S.normalized_id(F.col("mid")), "_state": S.normalized_upper(F.col("state")), "_city": S.normalized_upper(F.col("city"))} | keys)


def keyed(df: DataFrame) -> DataFrame:
    """The normalized values as tin, mid, state and city; tin and mid as given stay as tin_given and mid_given."""
    out = df.withColumnsRenamed({"tin": "tin_given", "mid": "mid_given"}).drop("state", "city")
    return out.withColumnsRenamed({"_tin": "tin", "_mid": "mid", "_state": "state", "_city": "city"})


def _backward(day: str, kind: T.DataType) -> Column:
    """A number that falls as ``day`` grows."""
    if isinstance(kind, T.DateType):
        return -F.unix_date(day)
    return -F.unix_micros(F.col(day).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else -F.col(day)


def _places(rid: str, day: str, rows: DataFrame) -> tuple[Column, Column, Callable[[Column], Column]]:
    """Earliest day first, latest day first, missing days last, equal days by ``rid``, as values whose least is wanted; and what gives the rid of one.

    Days and whole-number ids fit one decimal, day * 2**64 + rid, which a hash aggregate can update in place; a struct, which others
    come as, makes every aggregate sort its input.
    """
    types = {f.name: f.dataType for f in rows.schema}
    if isinstance(types[day], T.DateType) and isinstance(types[rid], T.IntegralType):
        number = lambda n: F.lit(str(n)).cast(T.DecimalType(20, 0))
        place = lambda days: F.coalesce(days, F.lit(2**32)).cast(T.DecimalType(10, 0)) * number(2**64) + F.col(rid).cast(T.DecimalType(19, 0))
        days = F.unix_date(day).cast("long")
        return place(days), place(-days), lambda v: (F.pmod(v + number(2**63), number(2**64)) - number(2**63)).cast(types[rid])
    place = lambda d: F.struct(F.col(day).isNull().alias("none"), d.alias("day"), F.col(rid).alias("rid"))
    return place(F.col(day)), place(_backward(day, types[day])), lambda v: v["rid"]


def tagged(df: DataFrame, rid: str = "rid", target: str = "is_fraud", date: str = "open_date", identity: Sequence[str] = IDENTITY, tin: str = "tin", mid: str = "mid") -> DataFrame:
    """``df`` with duplicate_tag, tag_reason and is_first_of_group.

    The exact-duplicate key is every column but ``rid`` and those that begin with an underscore. Dates given as text are parsed, others
    count as missing. Rows without TIN or MID are no re-applications.

    The row that a group keeps is found by an aggregate, which combines before it shuffles, so a group may hold any share of all rows. Only
    groups of several rows are joined back.
    """
    for need in (target, date):
        if need not in df.columns:
            raise ValueError(f"column {need} is needed")
    whole = [c for c in df.columns if c != rid and not c.startswith("_")]
    present = [c for c in identity if c in df.columns]
    parsed = F.try_to_timestamp(F.col(date)) if isinstance(df.schema[date].dataType, T.StringType) else F.col(date)
    rows = df.withColumns({"_day": parsed, "_t": F.coalesce(tin, F.lit("")), "_m": F.coalesce(mid, F.lit(""))} | {f"_id{i}": F.coalesce(F.col(c).cast("string"), F.lit("__NA__")) for i, c in enumerate(present)})
    first, last, rid_of = _places(rid, "_day", rows)
    size = F.count(F.lit(1)).alias("n")
    copies = rows.groupBy(*[F.col(f"`{c}`") for c in whole]).agg(size, F.min(rid).alias("exact")).filter("n > 1")
    pairs = rows.groupBy("_t", "_m").agg(size, F.min(first).alias("tech")).filter("n > 1").withColumn("tech", rid_of(F.col("tech")))
    keys = [f"_id{i}" for i in range(len(present))] if len(present) >= 3 else []
    # Per outcome first, then the rows of the greatest one; without any outcome there is no fraud and igf isn't asked for.
    outcomes = rows.groupBy(*keys, F.col(target).alias("_y")).agg(size, F.min(last).alias("igc"), F.min(first).alias("igf"))
    groups = outcomes.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("_y") * F.col("n")), F.lit(0)).alias("fraud"), F.min("igc").alias("igc"), F.max_by("igf", "_y").alias("igf")).filter("n > 1")
    groups = groups.withColumns({c: rid_of(F.col(c)) for c in ("igc", "igf")})
    out = rows
    for name, found, by in (("_exact", copies, whole), ("_tech", pairs, ["_t", "_m"]), ("_group", groups, keys)):
        if not by:
            out = out.withColumn(name, F.lit(None).cast("struct<n: bigint, fraud: bigint, igc: bigint, igf: bigint>"))
            continue
        kept = found.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], F.struct(*[c for c in found.columns if c not in by]).alias(name))
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}")) if by is whole else F.col(c) == F.col(f"_by{i}") for i, c in enumerate(by)]
        out = out.join(kept, same, "left").drop(*[f"_by{i}" for i in range(len(by))])
    labels = ((tin, "TIN"), *KYC)
    missing = F.array_join(F.filter(F.array(*[F.when(blank(c), label) for c, label in labels]), lambda x: x.isNotNull()), ", ")
    later = lambda c: F.col(c) != F.col(rid)
    either = blank(tin) | blank(mid)
    rules = [
        (later("_exact.exact"), TAGS[0], F.lit("Identical to an earlier row")),
        ((F.col("_group.fraud") > 0) & later("_group.igf"), TAGS[1], F.lit("Identity group with fraud")),
        (~either & later("_tech.tech"), TAGS[2], F.lit("Later application of the same TIN and MID")),
        (missing != "", TAGS[3], F.concat(F.lit("Missing: "), missing)),
        ((F.col("_group.fraud") == 0) & later("_group.igc"), TAGS[4], F.lit("Identity group without fraud")),
    ]
    tag = reason = None
    for hit, name, why in rules:
        tag, reason = (F.when(hit, name), F.when(hit, why)) if tag is None else (tag.when(hit, name), reason.when(hit, why))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("_tech.tech") == F.col(rid), F.lit(True)).alias("is_first_of_group"), tag.otherwise(TAGS[5]).alias("duplicate_tag"), reason.otherwise("").alias("tag_reason"))


def tin_stats(df: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Per non-blank TIN: records, distinct mids, states and cities (blank counts as a value), fraud sum and rate."""
    value = lambda c: F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return (
        df.filter(~blank("tin"))
        .groupBy("tin")
        .agg(F.count(F.lit(1)).alias("record_count"), value("mid").alias("n_mid"), value("state").alias("n_state"), value("city").alias("n_city"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("fraud_count"), F.avg(target).alias("fraud_rate"))
    )


def with_tin_stats(df: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Rows with their TIN's statistics; rows without a TIN get nulls."""
    return df.join(tin_stats(df, target), "tin", "left")


def tin_summary(tags: DataFrame, rid: str = "rid", target: str = "is_fraud") -> DataFrame:
    """Per TIN: statistics, fraud percent, its tags, first 3 legal names, 5 states, 5 cities by first appearance.

    All come from one table of the distinct values of each TIN, which is shuffled by TIN, kind and value. Statistics are sums of it, which combine
    before they are shuffled by TIN; the first values are a limit per TIN and kind that each task applies to its own values before it sends
    them, so a TIN of any number of values sends a few from each task.
    """
    most = {"legal_name": 3, "state": 5, "city": 5}
    kinds = ("duplicate_tag", "mid", *most)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = tags.filter(~blank("tin")).select("tin", rid, target, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), value(k).alias("value")) for k in kinds])).alias("x"))
    seen = rows.groupBy("tin", "x.kind", "x.value").agg(F.min(rid).alias("at"), F.count(F.lit(1)).alias("n"), F.sum(target).alias("fraud"), F.count(target).alias("known"))
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    # Both sides ask for all columns of ``seen``, and neither filters it by kind, so that it is computed once and its exchange is used by both.
    stats = seen.groupBy("tin").agg(
        F.sum(of("duplicate_tag", "n")).alias("record_count"),
        *[F.count(F.when(F.col("kind") == k, F.struct("at"))).alias(f"n_{k}") for k in ("mid", "state", "city")],
        F.coalesce(F.sum(of("duplicate_tag", "fraud")), F.lit(0)).cast("long").alias("fraud_count"),
        F.round(F.sum(of("duplicate_tag", "fraud")) / F.sum(of("duplicate_tag", "known")) * 100, 2).alias("fraud_pct"),
        F.array_join(F.array_sort(F.collect_set(of("duplicate_tag", "value"))), ", ").alias("tags"),
    )
    place = Window.partitionBy("tin", F.concat("kind", F.lit(" "))).orderBy(F.col("value") == "", "at", "n", "fraud", "known")
    some = seen.withColumn("rn", F.row_number().over(place)).filter(F.col("rn") <= max(most.values()))
    firsts = lambda k: F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("rn") <= most[k]) & (F.col("value") != ""), F.struct("at", "value"))))
    listed = some.groupBy("tin").agg(*[firsts(k).alias(k) for k in most])
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: x["value"]), ", "))
    return stats.join(listed, "tin").withColumns({k: joined(F.col(k)) for k in most})


def tin_tags(tags: DataFrame) -> DataFrame:
    """Per TIN record_count and its tags as :func:`tin_summary` lists them, from one aggregate of flags: all that :func:`browse` and :func:`decision` ask for."""
    found = tags.filter(~blank("tin")).groupBy("tin").agg(F.count(F.lit(1)).alias("record_count"), *[F.max(F.col("duplicate_tag") == t).alias(t) for t in TAGS])
    return found.select("tin", "record_count", F.array_join(F.array_compact(F.array(*[F.when(F.col(t), t) for t in sorted(TAGS)])), ", ").alias("tags"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """Every tag with its count, 0 where it doesn't occur."""
    fixed = tags.sparkSession.createDataFrame([(i, t) for i, t in enumerate(TAGS)], "priority int, duplicate_tag string")
    return fixed.join(tags.groupBy("duplicate_tag").agg(F.count(F.lit(1)).alias("n")), "duplicate_tag", "left").select("priority", "duplicate_tag", F.coalesce("n", F.lit(0)).alias("n"))


def kpis(tags: DataFrame, target: str = "is_fraud") -> DataFrame:
    """unique_tin, multi_mid_tins, fraud_tins, unique_mid, n_rows; from the distinct pairs of TIN and MID."""
    value = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    pairs = tags.groupBy(value("tin"), value("mid")).agg(F.count(F.lit(1)).alias("n"), F.max(target).alias("fraud"))
    per_tin = pairs.filter("tin <> ''").groupBy("tin").agg(F.count_if(F.col("mid") != "").alias("mids"), F.max("fraud").alias("fraud"))
    a = per_tin.agg(F.count(F.lit(1)).alias("unique_tin"), F.count_if(F.col("mids") >= 2).alias("multi_mid_tins"), F.count_if(F.col("fraud") > 0).alias("fraud_tins"))
    b = pairs.agg(F.countDistinct(F.when(F.col("mid") != "", F.col("mid"))).alias("unique_mid"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return a.join(b)  # one row each


def tiers(df: DataFrame, size: str = "record_count", tiers_: tuple = N.RECORD_TIERS, target: str = "is_fraud") -> DataFrame:
    """Per tier of TINs by records (or mids): number of TINs and mean fraud percent; empty tiers have 0."""
    fixed = df.sparkSession.createDataFrame([(i, label) for i, (_, label) in enumerate(tiers_)], "ord int, tier string")
    found = tin_stats(df, target).groupBy(N.tier(F.col(size), tiers_).alias("tier")).agg(F.count(F.lit(1)).alias("tins"), F.avg("fraud_rate").alias("rate"))
    return fixed.join(found, "tier", "left").select("ord", "tier", F.coalesce("tins", F.lit(0)).alias("tins"), F.round(F.coalesce("rate", F.lit(0.0)) * 100, 4).alias("fraud_pct"))


def exclusion_breakdown(tags: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Per tag, and for rows without TIN or MID: rows, fraud, non-fraud, fraud percent, share of all rows.

    The tags are read once: one row per tag carries all counts, and the total and the rows without an id are sums of those few rows.
    """
    gone, fraud = blank("tin") | blank("mid"), F.col(target) == 1
    per = tags.groupBy("duplicate_tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(fraud).alias("fraud"), F.count_if(gone).alias("gone"), F.count_if(gone & fraud).alias("gone_fraud"))
    none = F.lit(0).cast("long")
    one = per.agg(F.collect_list(F.struct(F.col("duplicate_tag").alias("reason"), "n", "fraud")).alias("tags"), F.sum("n").alias("total"), F.coalesce(F.sum("gone"), none).alias("gone"), F.coalesce(F.sum("gone_fraud"), none).alias("gone_fraud"))
    missing = F.array(F.struct(F.lit("MISSING_ID").alias("reason"), F.col("gone").alias("n"), F.col("gone_fraud").alias("fraud")))
    out = one.select("total", F.explode(F.concat("tags", missing)).alias("r")).select("total", "r.*")
    return out.select("reason", "n", "fraud", (F.col("n") - F.col("fraud")).alias("non_fraud"), F.round(F.coalesce(N.ratio(F.col("fraud"), F.col("n")), F.lit(0.0)) * 100, 2).alias("fraud_pct"), F.round(N.ratio(F.col("n"), F.col("total")) * 100, 2).alias("pct_of_total"))


def costliest_tag(tags: DataFrame, target: str = "is_fraud") -> DataFrame:
    """The excluded tag that takes most fraud rows."""
    found = tags.filter(F.col("duplicate_tag").isin(*EXCLUDED)).groupBy("duplicate_tag").agg(F.count_if(F.col(target) == 1).alias("fraud"))
    return found.orderBy(F.desc("fraud"), "duplicate_tag").limit(1)


def in_clean_pool() -> Column:
    return ~F.col("duplicate_tag").isin(*EXCLUDED) & ~blank("tin") & ~blank("mid")


def in_reference_pool() -> Column:
    return ~F.col("duplicate_tag").isin(*TRUE_DUPLICATES) & ~blank("tin") & ~blank("mid")


def clean_pool(tags: DataFrame) -> DataFrame:
    """What samples are drawn from: no excluded tag, TIN and MID present."""
    return tags.filter(in_clean_pool())


def reference_pool(tags: DataFrame) -> DataFrame:
    """What samples are compared with: true duplicates dropped only, TIN and MID present."""
    return tags.filter(in_reference_pool())


def browse(summary: DataFrame, min_records: int = 2, any_tags: Sequence[str] = (), top: int = 200) -> DataFrame:
    """TINs of some size with any of the tags, largest first."""
    out = summary.filter(F.col("record_count") >= min_records)
    if any_tags:
        out = out.filter(F.arrays_overlap(F.split("tags", ", "), F.array(*[F.lit(t) for t in any_tags])))
    return out.orderBy(F.desc("record_count"), "tin").limit(top)


def filtered(tags: DataFrame, tag_set: Sequence[str] = (), fraud: int | None = None, state: str | None = None, tin: str | None = None, target: str = "is_fraud") -> DataFrame:
    out = tags
    if tag_set:
        out = out.filter(F.col("duplicate_tag").isin(*tag_set))
    if fraud is not None:
        out = out.filter(F.col(target) == fraud)
    if state is not None:
        out = out.filter(F.col("state") == state)
    return out if tin is None else out.filter(F.col("tin") == tin)


def options(tags: DataFrame, col: str = "state") -> DataFrame:
    """The distinct values of ``col`` that are not blank, sorted: what a filter can be set to."""
    return tags.filter(~blank(col)).select(col).distinct().orderBy(col)


def decision(summary: DataFrame) -> DataFrame:
    """Per TIN the text of its first tag by precedence."""
    has = lambda t: F.array_contains(F.split("tags", ", "), t)
    out = F.when(has(DECISIONS[0][0]), DECISIONS[0][1])
    for tag, text in DECISIONS[1:]:
        out = out.when(has(tag), text)
    return summary.select("tin", out.otherwise("Clean").alias("decision"))


def banner(tags: DataFrame, tin: str, target: str = "is_fraud") -> DataFrame:
    """record_count, n_mid, n_state, n_city (values that are not blank) and fraud_count of one TIN."""
    value = lambda c: F.countDistinct(F.when(~blank(c), F.col(c)))
    return tags.filter(F.col("tin") == tin).agg(F.count(F.lit(1)).alias("record_count"), *[value(c).alias(f"n_{c}") for c in ("mid", "state", "city")], F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("fraud_count"))


def scatter(tags: DataFrame, tin: str) -> DataFrame:
    return tags.filter(F.col("tin") == tin).select("mid", "state", "city", "duplicate_tag", "is_fraud")


def loaded(source: DataFrame, rid: str = "rid", target: str = "is_fraud") -> DataFrame:
    """``source`` with normalized keys and the tags of every row."""
    return keyed(tagged(normalized(source), rid, target, tin="_tin", mid="_mid"))


def load_and_tag(source: DataFrame, rid: str = "rid", target: str = "is_fraud", classify: bool = True) -> DataFrame:
    """Types fixed, keys normalized, rows tagged, TIN statistics attached. Without ``classify`` no types are looked for: the known date columns
    become dates where their first values are serial numbers, and timestamps are cut to the day."""
    typed = fixed_types(source) if classify else fixed_types(known_dates(source, rid=rid), {})
    return with_tin_stats(loaded(typed, rid, target), target)


get_tin_summary = tin_summary
