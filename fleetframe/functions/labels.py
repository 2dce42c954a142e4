"""Labels derived from dates and counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from fleetframe import fixed


def booking_status(start: Column, end: Column, as_of: dt.date) -> Column:
    """Active on both end days, else Upcoming or Completed; Unknown without dates."""
    today = F.lit(as_of)
    return (
        F.when((start <= today) & (end >= today), fixed.ACTIVE)
        .when(start > today, fixed.UPCOMING)
        .when(end < today, fixed.COMPLETED)
        .otherwise(fixed.UNKNOWN)
    )


def customer_tier(bookings: Column) -> Column:
    tiers = [F.when(bookings >= fewest, tier) for fewest, tier in fixed.CUSTOMER_TIERS]
    return F.coalesce(*tiers, F.lit(fixed.NO_BOOKINGS_TIER))


def usage_status(rentals: Column) -> Column:
    levels = [F.when(rentals < below, level) for below, level in fixed.USAGE_LEVELS]
    return F.coalesce(*levels, F.lit(fixed.TOP_USAGE_LEVEL))
