"""Exact rounding of ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Wide enough for a money sum over 10^15 rows; the quotient keeps ten or more
# decimals, so the final rounding is the only one that can be seen.
_SUM = "decimal(28,2)"
_COUNT = "decimal(15,0)"


def half_up_ratio(total: Column, count: Column, digits: int) -> Column:
    """``total / count`` rounded half away from zero; NULL when the count is 0."""
    return F.round(F.try_divide(total.cast(_SUM), count.cast(_COUNT)), digits)


def percent_of(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL when the whole is 0 or NULL."""
    return F.round(F.try_divide((part * F.lit(100)).cast(_SUM), whole.cast(_SUM)), digits)
