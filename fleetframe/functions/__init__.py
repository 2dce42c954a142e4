from fleetframe.functions.dates import (
    full_month_name,
    inclusive_days,
    months_before,
    rental_days,
    same_day,
    short_month_label,
)
from fleetframe.functions.labels import booking_status, customer_tier, usage_status
from fleetframe.functions.numbers import half_up_ratio, percent_of
from fleetframe.functions.text import (
    is_missing,
    literal_runs,
    or_default,
    form_trim,
    rupiah,
    truncate_text,
    wildcard_match,
    wildcard_pattern,
)

__all__ = [
    "booking_status",
    "customer_tier",
    "full_month_name",
    "half_up_ratio",
    "inclusive_days",
    "is_missing",
    "literal_runs",
    "months_before",
    "or_default",
    "percent_of",
    "form_trim",
    "rental_days",
    "rupiah",
    "same_day",
    "short_month_label",
    "truncate_text",
    "usage_status",
    "wildcard_match",
    "wildcard_pattern",
]
