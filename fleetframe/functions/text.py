"""Text helpers: matching, form-input checks and display formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from fleetframe import fixed


def form_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(fixed.BLANKS))


def is_missing(value: Column) -> Column:
    """A form field counts as missing when absent, empty or the text "0"."""
    return F.coalesce(value.isin(*fixed.MISSING_TEXTS), F.lit(True))


def wildcard_pattern(query: str) -> str:
    """LIKE pattern for a substring search in which ``%`` and ``_`` stay wildcards.

    A backslash before any other character stands for that character itself.
    """
    pattern, escaped = [], False
    for char in f"%{query}%":
        if escaped:
            pattern.append(f"\\{char}" if char in "%_\\" else char)
            escaped = False
        elif char == "\\":
            escaped = True
        else:
            pattern.append(char)
    return "".join(pattern)


def literal_runs(query: str) -> list[str]:
    """The runs of characters between the wildcards of a search; every match holds all of them."""
    runs, escaped = [""], False
    for char in query:
        if escaped or char not in "%_\\":
            runs[-1] += char
            escaped = False
        elif char == "\\":
            escaped = True
        else:
            runs.append("")
    return [run for run in runs if run]


def wildcard_match(query: str, *columns: Column) -> Column:
    """Case-insensitive substring match on any column; NULL columns never match."""
    pattern = wildcard_pattern(query)
    hits = [F.coalesce(column.ilike(pattern), F.lit(False)) for column in columns]
    return reduce(lambda left, right: left | right, hits)


def literal_contains(query: str, *columns: Column) -> Column:
    """Case-insensitive literal match on the joined text of the columns."""
    return F.lower(F.concat_ws(" ", *columns)).contains(query.lower())


def rupiah(amount: Column) -> Column:
    """``Rp 1.234.568``: whole rupiah, dots between thousands, NULL as zero."""
    whole = F.round(F.coalesce(amount, F.lit(0)), 0)
    return F.concat(F.lit("Rp "), F.translate(F.format_number(whole, 0), ",", "."))


def truncate_text(value: Column, limit: int = 30) -> Column:
    return F.when(
        F.char_length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))
    ).otherwise(value)


def or_default(value: Column, default: Column | str, falsy: bool = False) -> Column:
    """Fallback text for NULL; with ``falsy`` also for '' and '0'."""
    fallback = F.lit(default) if isinstance(default, str) else default
    if falsy:
        return F.when(is_missing(value), fallback).otherwise(value)
    return F.coalesce(value, fallback)
