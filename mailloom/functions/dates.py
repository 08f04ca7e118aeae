"""Date arithmetic with overflow instead of clamping, and the ``{{ dates.x }}`` placeholders.

31 March minus one month is 3 March here (day 31 of February), where ``add_months`` gives
28 February. Every function takes the reference date, so results never depend on the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import as_col


def _previous_month(d: dt.date) -> dt.date:
    return d.replace(day=1) - dt.timedelta(days=1)


def placeholder_values(d: dt.date) -> dict[str, str]:
    """Placeholder name to text for one date; :func:`placeholders` does this for a column."""
    before = _previous_month(d)
    quarter = (d.month + 2) // 3
    return {
        "dates.year": f"{d.year:04d}",
        "dates.lastYear": f"{d.year - 1:04d}",
        "dates.nextYear": f"{d.year + 1:04d}",
        "dates.month": d.strftime("%B"),
        "dates.lastMonth": before.strftime("%B"),
        "dates.month.abbr": d.strftime("%b"),
        "dates.lastMonth.abbr": before.strftime("%b"),
        "dates.day": f"{d.day:02d}",
        "dates.quarter": str(quarter),
        "dates.lastQuarter": str((quarter + 2) % 4 + 1),
        "dates.year.short": f"{d.year % 100:02d}",
    }


def placeholders(d: Column | str) -> dict[str, Column]:
    """The same values as columns, keyed by placeholder name."""
    d = F.to_date(as_col(d))
    before = F.add_months(F.trunc(d, "MM"), -1)

    def year(offset: int) -> Column:
        return F.lpad((F.year(d) + offset).cast("string"), 4, "0")

    return {
        "dates.year": year(0),
        "dates.lastYear": year(-1),
        "dates.nextYear": year(1),
        "dates.month": F.date_format(d, "MMMM"),
        "dates.lastMonth": F.date_format(before, "MMMM"),
        "dates.month.abbr": F.date_format(d, "MMM"),
        "dates.lastMonth.abbr": F.date_format(before, "MMM"),
        "dates.day": F.date_format(d, "dd"),
        "dates.quarter": F.quarter(d).cast("string"),
        "dates.lastQuarter": ((F.quarter(d) + 2) % 4 + 1).cast("string"),
        "dates.year.short": F.date_format(d, "yy"),
    }


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """Date from parts where month 13 or day 32 roll over into the next year or month."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (month - 1).cast("int"))
    return F.date_add(first, (day - 1).cast("int"))


def minus_months(d: Column, months: Column) -> Column:
    """Go back whole months, keeping the day number and rolling over when it does not exist."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), -months), F.dayofmonth(d) - 1)


def minus_units(d: Column, n: Column, unit: Column) -> Column:
    """``d`` minus ``n`` days, weeks, months or years; null where that leaves year 1."""
    per = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 31).otherwise(366)
    fits = n <= F.floor(F.datediff(d, F.make_date(F.lit(1), F.lit(1), F.lit(1))) / per)
    k = F.when(fits, n).otherwise(0).cast("int")
    back = (
        F.when(unit == "day", F.date_sub(d, k))
        .when(unit == "week", F.date_sub(d, k * 7))
        .when(unit == "month", minus_months(d, k))
        .when(unit == "year", minus_months(d, k * 12))
    )
    return F.when(fits, back)


def within(d: Column | str, start: Column | None, end: Column | None) -> Column:
    """Inside ``[start, end]``; a null bound is open, a null date is outside."""
    inside = as_col(d).isNotNull()
    if start is not None:
        inside = inside & F.coalesce(as_col(d) >= start, F.lit(True))
    if end is not None:
        inside = inside & F.coalesce(as_col(d) <= end, F.lit(True))
    return inside


def mdy(d: Column) -> Column:
    """``MM/DD/YYYY`` text."""
    return F.date_format(d, "MM/dd/yyyy")


def parse_mdy(text: Column) -> Column:
    """``MM/DD/YYYY`` text to a date; text that names no calendar day gives null."""
    return F.try_to_date(text, "MM/dd/yyyy")
