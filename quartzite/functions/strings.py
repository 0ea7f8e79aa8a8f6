"""Cell checks and standardizers for text columns, as Column expressions.

All work on text and pass null on unless stated. Digits and white space are the ASCII ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII white space, which is what a pattern's \\s finds.
SPACE = " \t\n\x0b\f\r"
# The symbols that count as special characters.
SPECIAL = r"[#\$%\*\^~`\{\}\|<>\\]"
# Legal-form words that entity names are compared without.
LEGAL_FORMS = ("LLC", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC")
# Spellings of the United States, letters only.
USA = ("US", "USA", "UNITEDSTATES", "UNITEDSTATESOFAMERICA", "AMERICA")
# Substrings of a commercial address.
COMMERCIAL = ("suite", "ste", "floor", "fl", "bldg", "building", "plaza", "center", "industrial", "park")
# The US states and their codes.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}


def as_is(c: Column) -> Column:
    return c


# A standardizer's ``let`` is given each step that it reads more than once; a table can make a column of it.
Let = Callable[[Column], Column]


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    """Without white space at both ends (trim knows only the space)."""
    return F.btrim(text(c), F.lit(SPACE))


def drop_point_zero(c: Column) -> Column:
    """A trailing ``.0`` of an integer that was once a float."""
    return F.regexp_replace(c, r"\.0$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def is_missing(c: Column) -> Column:
    """Null or the empty string."""
    return c.isNull() | (text(c) == "")


def has_whitespace_issue(c: Column) -> Column:
    """Leading, trailing or repeated white space; false for null."""
    return F.coalesce(c.startswith(" ") | c.endswith(" ") | c.rlike(r"\s{2,}"), F.lit(False))


def has_special_chars(c: Column) -> Column:
    return F.coalesce(c.rlike(SPECIAL), F.lit(False))


def phone_issue(c: Column) -> Column:
    """Not 10 digits, nor 11 that start with 1; false for null and blank."""
    d = digits(drop_point_zero(strip(c)))
    good = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
    return F.when(blank(c), False).otherwise(~good)


def zip_issue(c: Column) -> Column:
    """Neither five digits nor ZIP+4; false for null, blank and the text nan."""
    v = drop_point_zero(strip(c))
    return F.coalesce(~v.rlike(r"^\d{5}(-\d{4})?$") & ~v.isin("nan", ""), F.lit(False))


def tin_issue(c: Column) -> Column:
    """Not nine digits; false for null and blank. Eight digits are an issue although they can be fixed."""
    return F.when(blank(c), False).otherwise(F.length(digits(drop_point_zero(text(c)))) != 9)


def standardize_phone(c: Column, let: Let = as_is) -> Column:
    v = let(drop_point_zero(strip(c)))
    d = let(digits(v))
    spell = lambda at: F.concat(F.lit("("), F.substring(d, at, 3), F.lit(") "), F.substring(d, at + 3, 3), F.lit("-"), F.substring(d, at + 6, 4))
    return F.when(F.length(d) == 10, spell(1)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), spell(2))).otherwise(v)


def standardize_zip(c: Column, let: Let = as_is) -> Column:
    """The first five digits, zero-padded; the value itself if it has none; null for the text nan."""
    v = let(digits(drop_point_zero(strip(c))))
    return F.when(F.lower(strip(c)) == "nan", F.lit(None).cast("string")).when(F.length(v) == 0, text(c)).when(F.length(v) < 5, F.lpad(v, 5, "0")).otherwise(F.substring(v, 1, 5))


def standardize_tin(c: Column, let: Let = as_is) -> Column:
    """DD-DDDDDDD, or DDD-DD-DDDD if it was written in parts of three, two and more digits; else as it is."""
    v = let(drop_point_zero(text(c)))
    d = let(digits(v))
    d = let(F.when(F.length(d) == 8, F.concat(F.lit("0"), d)).otherwise(d))
    ssn = v.rlike(r"^[^-]{3}-[^-]{2}-[^-]*$")
    return (
        F.when(F.length(d) != 9, v)
        .when(ssn, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 6, 4)))
        .otherwise(F.concat(F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 7)))
    )


def tin_digits(c: Column, let: Let = as_is) -> Column:
    """Exactly nine digits, eight are padded, else empty; a trailing ``.0`` is not dropped. Null gives empty."""
    d = let(digits(text(c)))
    return F.coalesce(F.when(F.length(d) == 9, d).when(F.length(d) == 8, F.concat(F.lit("0"), d)), F.lit(""))


def standardize_state(c: Column, let: Let = as_is, two_words: bool = False) -> Column:
    """A state's code; other values stay. Names of two words are found only with ``two_words``."""
    letters = let(F.regexp_replace(F.upper(text(c)), "[^A-Z]", ""))
    names = {k.replace(" ", "") if two_words else k: v for k, v in STATES.items()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(letters.isin(list(STATES.values())), letters).otherwise(F.coalesce(F.try_element_at(table, letters), text(c)))


def standardize_country(c: Column) -> Column:
    return F.when(F.regexp_replace(F.upper(text(c)), "[^A-Z]", "").isin(*USA), "USA").otherwise(text(c))


def entity_key(c: Column) -> Column:
    """Letters and digits of a name without its legal form, for comparison."""
    return F.regexp_replace(F.regexp_replace(F.upper(text(c)), rf"\b({'|'.join(LEGAL_FORMS)})\b", ""), "[^A-Z0-9]", "")


def match_key(c: Column) -> Column:
    """Upper-case letters and digits; null gives empty."""
    return F.regexp_replace(F.upper(F.coalesce(text(c), F.lit(""))), "[^A-Z0-9]", "")


def address_type(c: Column) -> Column:
    return F.when(c.isNull(), "Unknown").when(F.lower(text(c)).rlike("|".join(COMMERCIAL)), "Commercial").otherwise("Residential")


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def clean_special_chars(c: Column) -> Column:
    return F.regexp_replace(text(c), SPECIAL, "")


def clean_text(c: Column) -> Column:
    return clean_whitespace(clean_special_chars(c))


def standardize_name(c: Column) -> Column:
    return F.upper(clean_text(c))


def normalized_upper(c: Column) -> Column:
    """Trimmed upper case, null as empty."""
    return F.upper(strip(F.coalesce(text(c), F.lit(""))))


def normalized_id(c: Column) -> Column:
    """Digits of an integral number given as text or float; blank, nan, null and what is no number are empty."""
    v = strip(text(c))
    return F.coalesce(F.when(~F.lower(v).isin("", "nan"), v.try_cast("double").try_cast("bigint").cast("string")), F.lit(""))


def trim_if_content(c: Column) -> Column:
    """Trimmed, unless there is nothing but white space."""
    return F.when(strip(c) != "", strip(c)).otherwise(c)


def composite_key(*cols: Column, sep: str = "|", na: str = "__NA__") -> Column:
    return F.concat_ws(sep, *[F.coalesce(text(c), F.lit(na)) for c in cols])


def hashed_id(c: Column) -> Column:
    """SHA-256 of an identifier; the texts nan and None, and null, count as empty."""
    v = F.coalesce(text(c), F.lit(""))
    return F.sha2(F.when(v.isin("nan", "None"), "").otherwise(v), 256)


def without_dashes(c: Column) -> Column:
    return F.replace(text(c), F.lit("-"), F.lit(""))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """Codes by their labels; other codes stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), text(c)), text(c))


def distinct_tags(c: Column, none: str = "GOOD_DATA") -> Column:
    """Comma-joined tags, distinct and sorted; ``none`` if there are none."""
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda t: t != "")))
    return F.when(F.size(tags) == 0, none).otherwise(F.array_join(tags, ","))


def any_column_matches(cols: list[Column], pattern: str) -> Column:
    """A case-insensitive pattern in any column."""
    return reduce(lambda a, b: a | b, [F.coalesce(text(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in cols])
