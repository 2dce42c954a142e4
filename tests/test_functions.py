import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fleetframe import functions as fn
from fleetframe.functions.text import literal_contains

TODAY = dt.date(2024, 3, 10)


def one(spark, *columns, rows=None, schema=None):
    frame = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    return frame.select(*columns).collect()


def test_status_of_missing_and_edge_dates(spark):
    rows = [
        (None, None),
        (None, dt.date(2024, 3, 9)),
        (TODAY, TODAY),
        (dt.date(2024, 3, 11), None),
        (dt.date(2024, 3, 1), dt.date(2024, 3, 9)),
        (dt.date(2024, 3, 1), None),
    ]
    got = one(
        spark, fn.booking_status(F.col("s"), F.col("e"), TODAY), rows=rows, schema="s date, e date"
    )
    assert [r[0] for r in got] == ["Unknown", "Completed", "Active", "Upcoming", "Completed", "Unknown"]


def test_tier_and_usage_steps(spark):
    rows = [(n,) for n in (0, 1, 2, 3, 4, 5, 7, 8)]
    got = one(spark, fn.customer_tier(F.col("n")), fn.usage_status(F.col("n")), rows=rows, schema="n int")
    assert [r[0].split()[0] for r in got] == [
        "Prospect", "New", "New", "Regular", "Regular", "VIP", "VIP", "VIP",
    ]
    assert [r[1] for r in got] == [
        "Never Rented", "Low Usage", "Low Usage", "Medium Usage", "Medium Usage", "Medium Usage",
        "Medium Usage", "High Usage",
    ]


def test_rounding_half_away_from_zero_and_empty_totals(spark):
    got = one(
        spark,
        fn.half_up_ratio(F.lit(Decimal("0.05")), F.lit(2), 2),
        fn.half_up_ratio(F.lit(Decimal("0.01")), F.lit(0), 2),
        fn.percent_of(F.lit(1), F.lit(800)),
        fn.percent_of(F.lit(1), F.lit(0)),
        fn.rupiah(F.lit(Decimal("2.50"))),
        fn.rupiah(F.lit(Decimal("1234567.50"))),
        fn.rupiah(F.lit(None).cast("decimal(12,2)")),
    )[0]
    assert got[0] == Decimal("0.03") and got[1] is None
    assert got[2] == Decimal("0.13") and got[3] is None
    assert list(got[4:]) == ["Rp 3", "Rp 1.234.568", "Rp 0"]


def test_months_before_clamps_to_month_end(spark):
    got = one(spark, fn.months_before(dt.date(2024, 2, 29), 12))[0][0]
    assert got == dt.date(2023, 2, 28)


def test_missing_trim_truncate_default(spark):
    rows = [("",), ("0",), (None,), ("00",), ("\t 0 \n",), ("x" * 31,)]
    got = one(
        spark,
        fn.is_missing(F.col("v")),
        fn.is_missing(fn.form_trim(F.col("v"))),
        fn.truncate_text(F.col("v"), 30),
        fn.or_default(F.col("v"), "none"),
        fn.or_default(F.col("v"), "none", falsy=True),
        rows=rows,
        schema="v string",
    )
    assert [r[0] for r in got] == [True, True, True, False, False, False]
    assert [r[1] for r in got] == [True, True, True, False, True, False]
    assert got[5][2] == "x" * 30 + "..."
    assert [r[3] for r in got][:3] == ["", "0", "none"]
    assert [r[4] for r in got][:4] == ["none", "none", "none", "00"]


def test_wildcards_work_in_searches_but_not_in_quick_filters(spark):
    rows = [("100% cotton",), ("1000 cotton",), ("a_b",), ("axb",), (None,), ("back\\slash",)]

    def hits(query, match):
        found = spark.createDataFrame(rows, "v string").filter(match(query, F.col("v")))
        return {r[0] for r in found.collect()}

    assert hits("0% COT", fn.wildcard_match) == {"100% cotton", "1000 cotton"}
    assert hits("a_b", fn.wildcard_match) == {"a_b", "axb"}
    assert hits("a\\_b", fn.wildcard_match) == {"a_b"}
    assert hits("c\\otton", fn.wildcard_match) == {"100% cotton", "1000 cotton"}
    assert hits("\\\\s", fn.wildcard_match) == {"back\\slash"}
    assert hits("a_b", literal_contains) == {"a_b"}
    assert hits("0% COT", literal_contains) == {"100% cotton"}
    assert hits("", fn.wildcard_match) == {r[0] for r in rows if r[0]}
