"""Arithmetic and ladders as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Lower edges and labels of the record and the merchant tiers.
RECORD_TIERS = ((1, "1 (single)"), (2, "2"), (3, "3"), (4, "4–5"), (6, "6–10"), (11, "11–50"), (51, "51+"))
MID_TIERS = ((1, "1"), (2, "2"), (3, "3"), (4, "4–5"), (6, "6–10"), (11, "11+"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def half_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)


def parse_number(c: Column) -> Column:
    """A number or null. The pattern keeps out what only Spark reads as a number, like 1d."""
    v = c.cast("string")
    return F.when(v.rlike(NUMERIC), v.try_cast("double"))


def ladder(c: Column, steps: tuple[tuple[float, str], ...], otherwise: str, reach=lambda c, edge: c >= edge) -> Column:
    """The label of the first step that is reached."""
    out = None
    for edge, label in steps:
        out = F.when(reach(c, edge), label) if out is None else out.when(reach(c, edge), label)
    return out.otherwise(otherwise)


def tier(c: Column, tiers: tuple[tuple[int, str], ...] = RECORD_TIERS) -> Column:
    """Half-open bins by their lower edges; null below the first."""
    out = F.when(c >= tiers[-1][0], tiers[-1][1])
    for edge, label in reversed(tiers[:-1]):
        out = out.when(c >= edge, label)
    return out


def missing_severity(share: Column) -> Column:
    """Of a share in percent."""
    return ladder(share, ((50, "Critical"), (20, "High"), (5, "Moderate")), "Low")


def variance_severity(variance: Column, threshold: float) -> Column:
    """Null where the variance isn't low."""
    return F.when(variance < 0.3 * threshold, "Critical").when(variance < 0.6 * threshold, "High").when(variance < threshold, "Moderate")


def psi_verdict(psi: Column) -> Column:
    return F.when(psi.isNull() | F.isnan(psi), "N/A").when(psi <= 0.10, "Stable").when(psi <= 0.20, "Minor Shift").otherwise("Critical Shift")


def significance(p: Column) -> Column:
    return F.when(F.coalesce(p, F.lit(1.0)) < 0.05, "p<0.05").otherwise("n.s.")


def correlation_strength(r: Column, steps: tuple[tuple[float, str], ...] = ((0.5, "Very Strong"), (0.3, "Strong"), (0.1, "Moderate")), otherwise: str = "Weak") -> Column:
    return ladder(F.abs(r), steps, otherwise)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def health(issue_percent: Column) -> Column:
    return F.when(issue_percent < 20, "Strong").when(issue_percent < 50, "Moderate").otherwise("Weak")
