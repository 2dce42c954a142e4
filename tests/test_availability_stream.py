"""Availability kept as state; a booking handler looks at the bookings of a car before it adds one."""

import datetime as dt
import random

import pytest

from fleetframe.operators import availability
from fleetframe.streaming import availability as stream
from values import day, money

REQUEST = "arrival bigint, car_id string, start date, end date, reject_reason string"


def test_days_are_taken_once():
    rng = random.Random(2)
    for _ in range(300):
        held, days = [], set()
        for _ in range(40):
            a = rng.randrange(60)
            b = a + rng.randrange(6)
            wanted = set(range(a, b + 1))
            fits = not wanted & days
            assert stream.take_days(held, a, b) == fits
            days |= wanted if fits else set()
            assert held == sorted(held) and all(x[1] + 1 < y[0] for x, y in zip(held, held[1:]))
            assert {d for x, y in held for d in range(x, y + 1)} == days


def test_ranges_of_the_tables(spark, make_tables):
    tables = make_tables(
        booking=[
            (f"B{i}", day("2024-01-01"), day(a), day(b), None, None, None)
            for i, (a, b) in enumerate(
                [("2024-03-01", "2024-03-03"), ("2024-03-04", "2024-03-05"), ("2024-03-02", "2024-03-02"),
                 ("2024-03-09", "2024-03-07"), (None, "2024-03-20"), ("2024-02-01", "2024-02-02")]
            )
        ],
        transaction=[(f"T{i}", "Cash", money("1"), None, None, f"B{i}") for i in range(6)],
        car_transaction=[("K1", f"T{i}") for i in range(6)] + [("K2", "T3"), (None, "T1")],
    )
    got = sorted(tuple(r) for r in stream.taken_ranges(tables, day("2024-03-01")).selectExpr("car_id", "date_from_unix_date(first)", "date_from_unix_date(last)").collect())
    assert got == [
        ("K1", day("2024-03-01"), day("2024-03-05")),
        ("K1", day("2024-03-07"), day("2024-03-09")),
        ("K2", day("2024-03-07"), day("2024-03-09")),
    ]


@pytest.fixture()
def requests():
    rng = random.Random(9)
    rows = []
    for n in range(90):
        a = rng.randrange(1, 25)
        reason = "no" if n % 11 == 0 else "no car" if n % 29 == 7 else None
        car = None if reason == "no car" else f"K{rng.randrange(1, 5)}"
        rows.append((n, car, day(f"2024-03-{a:02}"), day(f"2024-03-{a + rng.randrange(3):02}"), reason))
    return rows


def test_stream_decides_as_one_batch_and_goes_on_after_a_restart(spark, small, requests, tmp_path):
    inbox, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    initial = stream.taken_ranges(small, day("2024-03-01"))

    def run():
        asked = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(inbox)
        query = stream.start_admission(asked, initial, out, progress, until_caught_up=True)
        query.awaitTermination()
        return {r.arrival: r.reject_reason for r in spark.read.parquet(out).collect()}

    try:
        for low in (0, 30):
            spark.createDataFrame(requests[low : low + 30], REQUEST).coalesce(1).write.mode("append").parquet(inbox)
            first = run()
        assert run() == first and len(first) == 60
        spark.createDataFrame(requests[60:], REQUEST).coalesce(1).write.mode("append").parquet(inbox)
        got = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = spark.createDataFrame(requests, REQUEST)
    expected = {r.arrival: r.reject_reason for r in availability.admit_bookings(whole, small).collect()}
    assert got == expected and spark.read.parquet(out).count() == 90
    assert len({v for v in got.values()}) == 4


def test_state_that_is_handed_over_in_parts_is_kept_whole(spark, tmp_path):
    inbox, batch_rows = f"{tmp_path}/in", "spark.sql.execution.arrow.maxRecordsPerBatch"
    first_day = 19_783
    initial = spark.createDataFrame(
        [(f"K{c}", first_day + 3 * i, first_day + 3 * i + 1) for c in range(3) for i in range(7)], f"car_id string, {stream.RANGE}"
    )
    # One request for each day of three weeks; every third day is free.
    asked = [(c * 100 + i, f"K{c}", dt.date.fromordinal(day("2024-03-01").toordinal() + i)) for c in range(3) for i in range(21)]
    spark.createDataFrame([(n, car, d, d, None) for n, car, d in asked], REQUEST).write.parquet(inbox)
    before = {k: spark.conf.get(k) for k in (batch_rows, "spark.sql.shuffle.partitions")}
    spark.conf.set(batch_rows, "3")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        requests = spark.readStream.schema(REQUEST).parquet(inbox)
        stream.start_admission(requests, initial, f"{tmp_path}/out", f"{tmp_path}/progress", until_caught_up=True).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = spark.read.parquet(f"{tmp_path}/out").filter("reject_reason IS NULL")
    assert sorted(r.arrival for r in got.collect()) == [c * 100 + i for c in range(3) for i in range(2, 21, 3)]
