"""Dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_years(d: Column, n: int) -> Column:
    """n years later; 29 February of a year without one becomes 1 March."""
    moved = F.add_months(d, 12 * n)
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29) & (F.dayofmonth(moved) == 28)
    return F.when(leap, F.date_add(moved, 1)).otherwise(moved)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def month_ends(start: Column, end: Column) -> Column:
    """The month ends in [start, end]; an empty array for none."""
    firsts = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(firsts, F.last_day), lambda d: (d >= start) & (d <= end))


def quarter_ends(start: Column, end: Column) -> Column:
    """The quarter ends in (start, end]."""
    return F.filter(month_ends(start, end), lambda d: (F.month(d) % 3 == 0) & (d > start))


def month_starts(start: Column, end: Column) -> Column:
    firsts = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(firsts, lambda d: (d >= start) & (d <= end))


def in_third_week(d: Column) -> Column:
    """Day of month 15 to 21, where the monthly expiration falls."""
    return F.dayofmonth(d).between(15, 21)


def is_friday(d: Column) -> Column:
    return F.dayofweek(d) == 6


def parse_date(text: Column) -> Column:
    """A date from 'January 5, 2020', '2020-01-05' or '5 January 2020'; null for any other form."""
    text = F.trim(text)
    forms = ((r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"))
    return F.coalesce(*(F.when(text.rlike(p), F.try_to_date(text, f)) for p, f in forms))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def regime(d: Column) -> Column:
    """The market regime of a date."""
    return F.when(d < F.lit("2020-02-01").cast("date"), "pre-covid").when(d < F.lit("2022-01-01").cast("date"), "covid").otherwise("recent")
