"""DuckDB spellings of the text functions, for the twins of the queries."""

from __future__ import annotations

from ..functions import strings as S

SPECIAL = S.SPECIAL


def rx(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def strip(c: str) -> str:
    return rx(c, r"^\s+|\s+$")


def point(c: str) -> str:
    return rx(c, r"\.0$")


def digits(c: str) -> str:
    return rx(c, r"\D")


def missing(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def ws(c: str) -> str:
    return rf"coalesce(starts_with({c}, ' ') OR ends_with({c}, ' ') OR regexp_matches({c}, '\s{{2,}}'), false)"


def sc(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{SPECIAL}'), false)"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {strip(c)} = '')"


def phone_issue(c: str) -> str:
    d = digits(point(strip(c)))
    return f"(CASE WHEN {blank(c)} THEN false ELSE NOT (length({d}) = 10 OR (length({d}) = 11 AND starts_with({d}, '1'))) END)"


def zip_issue(c: str) -> str:
    v = point(strip(c))
    return rf"coalesce(NOT regexp_matches({v}, '^\d{{5}}(-\d{{4}})?$') AND {v} NOT IN ('nan', ''), false)"


def tin_issue(c: str) -> str:
    return f"(CASE WHEN {blank(c)} THEN false ELSE length({digits(point(c))}) <> 9 END)"


def phone(c: str) -> str:
    v = point(strip(c))
    d = digits(v)
    return f"(CASE WHEN length({d}) = 10 THEN '(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || substr({d}, 7, 4) WHEN length({d}) = 11 AND starts_with({d}, '1') THEN '+1 (' || substr({d}, 2, 3) || ') ' || substr({d}, 5, 3) || '-' || substr({d}, 8, 4) ELSE {v} END)"


def zip_(c: str) -> str:
    v = digits(point(strip(c)))
    return f"(CASE WHEN lower({strip(c)}) = 'nan' THEN NULL WHEN length({v}) = 0 THEN {c} WHEN length({v}) < 5 THEN lpad({v}, 5, '0') ELSE substr({v}, 1, 5) END)"


def tin(c: str) -> str:
    v = point(c)
    d = f"(CASE WHEN length({digits(v)}) = 8 THEN '0' || {digits(v)} ELSE {digits(v)} END)"
    return rf"(CASE WHEN length({d}) <> 9 THEN {v} WHEN regexp_matches({v}, '^[^-]{{3}}-[^-]{{2}}-[^-]*$') THEN substr({d}, 1, 3) || '-' || substr({d}, 4, 2) || '-' || substr({d}, 6, 4) ELSE substr({d}, 1, 2) || '-' || substr({d}, 3, 7) END)"


def tin9(c: str) -> str:
    d = digits(c)
    return f"coalesce(CASE WHEN length({d}) = 9 THEN {d} WHEN length({d}) = 8 THEN '0' || {d} END, '')"


def state(c: str) -> str:
    v = rx(f"upper({c})", "[^A-Z]")
    codes = ", ".join(f"'{x}'" for x in S.STATES.values())
    cases = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in S.STATES.items())
    return f"(CASE WHEN {v} IN ({codes}) THEN {v} ELSE coalesce(CASE {v} {cases} END, {c}) END)"


def country(c: str) -> str:
    names = ", ".join(f"'{x}'" for x in S.USA)
    return f"(CASE WHEN {rx(f'upper({c})', '[^A-Z]')} IN ({names}) THEN 'USA' ELSE {c} END)"


def clean(c: str) -> str:
    return rx(rx(rx(c, SPECIAL), r"\s+", " "), "^ +| +$")


def name(c: str) -> str:
    return f"upper({clean(c)})"


def entity(c: str) -> str:
    return rx(rx(f"upper({c})", rf"\b({'|'.join(S.LEGAL_FORMS)})\b"), "[^A-Z0-9]")


def key(c: str) -> str:
    return rx(f"upper(coalesce({c}, ''))", "[^A-Z0-9]")


def address_type(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN 'Unknown' WHEN regexp_matches(lower({c}), '{'|'.join(S.COMMERCIAL)}') THEN 'Commercial' ELSE 'Residential' END)"
