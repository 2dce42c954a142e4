"""Short forms of values in test rows."""

import datetime as dt
from decimal import Decimal


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def money(text):
    return None if text is None else Decimal(text)
