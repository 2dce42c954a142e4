"""Batches too large to send to the tasks: only what can decide them meets."""

import datetime as dt
import random

from fleetframe.operators import availability, intake
from fleetframe.plans import first_come, lookups
from fleetframe.plans.lookups import measured


def requests(spark, n=300):
    draw = random.Random(3)
    rows = [(i, f"p{draw.randrange(n)}", f"l{draw.randrange(n)}", f"c{draw.randrange(n)}", draw.random() < 0.1) for i in range(n)]
    reason = "arrival long, phone string, license_number string, id_card string, bad boolean"
    return spark.createDataFrame(rows, reason).selectExpr(
        "arrival", "phone", "license_number", "id_card", "IF(bad, 'bad', NULL) AS reject_reason"
    )


def master(spark):
    return spark.range(40).selectExpr("'p' || id * 3 AS phone_number", "'l' || id * 5 AS drivers_license", "'c' || id AS id_card")


def test_reasons_by_claims_equal_those_by_rows(spark, monkeypatch):
    asked = requests(spark)
    for size in (lookups.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", size)
        monkeypatch.setattr(first_come, "GROUP_ROWS", 20 if size else 50_000)
        batch = measured(asked.withColumn("_open", asked.reject_reason.isNull()), keep=True)
        rules = intake._CUSTOMER_RULES
        claims = intake._reason_by_claims(batch, master(spark), rules).select("arrival", "_taken")
        rows = intake._reason_by_rows(batch, master(spark), rules, None).select("arrival", "_taken")
        got = sorted(map(tuple, claims.collect()))
        assert got == sorted(map(tuple, rows.collect()))
        assert len({reason for _, reason in got}) == 4


def test_held_values_are_taken_before_all_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, None, None), (5, "c", "a")], "n int, k string, m string")
    held = spark.createDataFrame([(0, "a"), (1, "y"), (1, "y")], "kind int, value string")
    for group_rows in (100, 1):
        got = first_come.accept_unique(rows, "n", ["k", "m"], group_rows=group_rows, held=held)
        assert sorted(r[0] for r in got.collect()) == [2, 4, 5]


def test_only_requested_cars_are_looked_at(spark, make_tables):
    day = dt.date(2024, 3, 10)
    tables = make_tables(
        booking=[("B1", day, day, day, None, None, None)],
        transaction=[(f"T{i}", "Cash", None, None, None, "B1") for i in (1, 2, 3)],
        car_transaction=[("C1", "T1"), ("C1", "T2"), ("C2", "T3")],
    )
    asked = spark.createDataFrame([(1, "C1", day, day), (2, None, day, day)], "arrival int, car_id string, start date, end date")
    assert [tuple(r) for r in availability.booked_ranges(tables, asked).collect()] == [("C1", day, day, 2)]
    got = availability.availability_conflicts(asked, tables).select("arrival", "conflict_count").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 0)]


def test_large_kept_frame_is_not_measured(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 160)
    many = measured(spark.range(50), keep=True)
    assert many.column_bytes is None and many.frame.count() == 50
    assert not intake.held_values(spark.range(9).selectExpr("CAST(id AS STRING) AS v"), "v", measured(
        spark.range(50).selectExpr("'x' AS w"), keep=True), "w").isEmpty()
