"""Calendar expressions. The reference date is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def months_before(as_of: dt.date, months: int) -> Column:
    """First day inside a trailing window of ``months`` months; folds to a literal."""
    return F.add_months(F.lit(as_of), -months)


def same_day(moment: Column, day: dt.date) -> Column:
    """Whether a date or timestamp falls on ``day``; the scan sees a range filter."""
    return F.to_date(moment) == F.lit(day)


def full_month_name(year: Column, month: Column) -> Column:
    return F.date_format(F.make_date(year, month, F.lit(1)), "MMMM")


def short_month_label(month_name: Column) -> Column:
    """Chart label: the first three letters of a month name."""
    return F.substring(month_name, 1, 3)


def rental_days(start: Column, end: Column) -> Column:
    """Days between the two dates, the end day not counted."""
    return F.datediff(end, start)


def inclusive_days(start: Column, end: Column) -> Column:
    """Days charged for a rental: first and last day both count."""
    return F.datediff(end, start) + F.lit(1)
