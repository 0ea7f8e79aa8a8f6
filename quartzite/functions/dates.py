"""Date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of calendar bins.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def parsed(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")) -> Column:
    """The first of ``formats`` that fits each value; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats])


def standardize_datetime(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")) -> Column:
    return F.date_format(parsed(c, formats), "yyyy-MM-dd")


def from_excel_serial(c: Column) -> Column:
    """Days since 1899-12-30, fractions dropped."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c.cast("double")).cast("int"))


def midnight(c: Column) -> Column:
    return F.date_trunc("DAY", c)


def quarter(c: Column) -> Column:
    return F.quarter(c)


def month(c: Column) -> Column:
    return F.month(c)


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def month_label(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(c))


def weekday_label(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(c) + 1)
