"""Reports from daily sums of signed rows, and distinct counts from bitmaps, against the same reports made anew.

The dashboard and the report pages recompute all of them on every visit.
"""

import datetime as dt
import glob

import pytest

from fleetframe.operators import dashboard, months, payments
from fleetframe.operators.distinct_counts import DistinctCounts, bitmaps, update_counts
from fleetframe.operators.maintained import MaintainedReports, partners, update_reports
from fleetframe.sources import batches
from fleetframe.sources.tables import read_parquet_tables
from fleetframe.streaming.micro_batch import edit_batch, write_base
from values import day, money

TODAY = dt.date(2024, 3, 10)
EDIT = "arrival bigint, action string, id_card string, name string, phone_number string, address string, drivers_license string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def check(spark, folder):
    tables, kept = read_parquet_tables(spark, folder), MaintainedReports(spark, folder)
    assert rows(kept.monthly_bookings(TODAY)) == rows(months.monthly_bookings(tables, TODAY))
    for name in ("revenue_growth", "monthly_revenue_report", "monthly_revenue_recent"):
        assert rows(getattr(kept, name)(TODAY)) == rows(getattr(months, name)(tables, TODAY)), name
    for at in (TODAY, dt.date(2024, 3, 3), dt.date(2020, 1, 1)):
        assert rows(kept.today_stats(at)) == rows(payments.today_stats(tables, at))
        assert rows(kept.dashboard_stats(at)) == rows(dashboard.dashboard_stats(tables, at)), at
    counts = DistinctCounts(spark, folder)
    paid = tables.booking.join(tables.transaction, tables.booking.booking_id == tables.transaction.booking_booking_id)
    expected = paid.groupBy("payment_method").agg({"customer_id_card": "count"}).select("payment_method")
    assert {r[0] for r in rows(counts.customers_by_method())} <= {r[0] for r in rows(expected)}
    by_method = {r.payment_method: set() for r in paid.collect()}
    for r in paid.collect():
        by_method[r.payment_method] |= {r.customer_id_card} - {None}
    assert dict(rows(counts.customers_by_method())) == {k: len(v) for k, v in by_method.items() if v}
    seasonal = {(r[0], r[1]): r[6] for r in rows(months.seasonal_patterns(tables, TODAY))}
    assert {(r[0], r[1]): r[3] for r in rows(counts.customers_by_month(TODAY))} == {k: v for k, v in seasonal.items() if v}
    assert rows(counts.cars_ever_rented())[0][0] == tables.car_transaction.select("car_car_id").distinct().count()


def update(spark, folder):
    assert update_reports(spark, folder) == update_counts(spark, folder)


def spoil(folder, batch, tables):
    """Make the files of a batch unreadable."""
    for table in tables:
        for path in glob.glob(f"{folder}/{table}/batch_id={batch}/*.parquet"):
            with open(path, "wb") as file:
                file.write(b"spoilt")


@pytest.fixture()
def folder(spark, small, tmp_path):
    folder = str(tmp_path)
    write_base(small, folder)
    update(spark, folder)
    return folder


def new_rental(make_tables, n, car="K2", method="Cash", customer="2222", amount="5.25"):
    return make_tables(
        booking=[(f"B1{n}", day("2024-03-05"), day("2024-03-09"), day("2024-03-11"), "L2", customer, "S1")],
        transaction=[(f"T1{n}", method, money(amount), dt.datetime(2024, 3, 10, 12, n), "S1", f"B1{n}")],
        car_transaction=[(car, f"T1{n}")],
    )


def parts(tables, *names):
    return {name: getattr(tables, name) for name in names}


FACTS = ("booking", "transaction", "car_transaction")


def test_batches_edits_and_late_rows(spark, make_tables, folder):
    check(spark, folder)
    first = new_rental(make_tables, 1)
    batches.write_batch(spark, folder, 0, parts(first, *FACTS), {})
    edit_batch("customer", spark.createDataFrame([(1, "delete", "3333", *[None] * 4)], EDIT), 1, folder, dt.datetime(2024, 3, 10))
    # Payment and car of a booking come one batch after another.
    late = new_rental(make_tables, 2, car="K4", method="Card", customer="3333")
    for n, name in enumerate(FACTS, 2):
        batches.write_batch(spark, folder, n, parts(late, name), {})
    update(spark, folder)
    check(spark, folder)
    # A payment is corrected, another one taken back, and a booking moved.
    old = read_parquet_tables(spark, folder)
    corrected = make_tables(transaction=[("T11", "Card", money("900.00"), dt.datetime(2024, 3, 3, 1), "S1", "B11")])
    moved = make_tables(booking=[("B1", day("2023-01-01"), day("2024-03-20"), day("2024-03-21"), "L1", "1111", "S1")])
    ended = {
        "transaction": old.transaction.filter("transaction_id IN ('T11', 'T3')"),
        "booking": old.booking.filter("booking_id = 'B1'"),
    }
    batches.write_batch(spark, folder, 5, {"transaction": corrected.transaction, "booking": moved.booking}, {}, ended)
    update(spark, folder)
    check(spark, folder)
    assert update_reports(spark, folder) == [] and update_counts(spark, folder) == []


def test_only_new_batches_are_read(spark, make_tables, folder):
    batches.write_batch(spark, folder, 0, parts(new_rental(make_tables, 3), *FACTS), {})
    before = {n: rows(getattr(MaintainedReports(spark, folder), n)(TODAY)) for n in ("today_stats", "dashboard_stats")}
    spoil(folder, -1, ("booking", "transaction", "car_transaction", "customer", "car"))
    spark.catalog.clearCache()
    update(spark, folder)
    kept = MaintainedReports(spark, folder)
    (old,), (new,) = before["today_stats"], rows(kept.today_stats(TODAY))
    assert new[0] == old[0] + 1 and new[1] == old[1] + money("5.25")
    # K2 is out already.
    assert rows(kept.dashboard_stats(TODAY))[0][2] == before["dashboard_stats"][0][2]
    assert rows(DistinctCounts(spark, folder).cars_ever_rented()) == [(3,)]


def test_bitmaps_are_made_after_the_last_shuffle(spark, capsys):
    found = spark.range(100).selectExpr("cast(id AS string) AS key", "id % 2 = 0 AS even")
    numbers = spark.range(100).selectExpr("cast(id AS string) AS key", "id * 1000 + 1 AS number")
    bits = bitmaps(found, numbers, "even")
    bits.explain()
    plan = capsys.readouterr().out
    assert "partial_bitmap_construct_agg" in plan
    assert plan.rindex("partial_bitmap_construct_agg") < plan.index("Exchange")
    assert bits.selectExpr("sum(bitmap_count(bits))").first()[0] == 100


@pytest.mark.parametrize("most_bytes", [None, 0])
def test_rows_are_joined_with_their_batch_once(spark, monkeypatch, most_bytes):
    if most_bytes is not None:
        monkeypatch.setattr("fleetframe.plans.lookups.BROADCAST_BYTES", most_bytes)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    asked = [(n, k) for n, k in enumerate(["a", "a", "b", "c", "d", None])]
    rows = spark.createDataFrame(asked, "n int, wanted string").mapInArrow(counted, "n int, wanted string")
    inside = spark.createDataFrame([("a", 1), ("a", 2), (None, 9)], "key string, x int")
    before = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5), ("z", 6), (None, 8)], "key string, x int")
    got = sorted(tuple(r) for r in partners(rows, "wanted", inside, before).collect())
    assert got == [(0, "a", 1), (0, "a", 2), (1, "a", 1), (1, "a", 2), (2, "b", 3), (3, "c", 4), (3, "c", 5)]
    assert read.value == 6
