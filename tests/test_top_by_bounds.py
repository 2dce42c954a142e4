"""The best customers by bounds against the ranking of all of them; the report page ranks them on every visit."""

import datetime as dt
import random

import pytest

from fleetframe.operators import customers
from fleetframe.operators.top_by_bounds import top_customers, update_ranking
from fleetframe.sources import batches
from fleetframe.sources.tables import read_parquet_tables
from values import day, money

ON_FILE = [(f"{i:03}", f"L{i}", f"N{i}", "08", "x") for i in range(160)]


def facts(make_tables, batch, amount, rng):
    bookings, payments = [], []
    for i in range(180):
        key = f"B{batch}-{i}"
        bookings.append((key, day("2024-01-01"), day("2024-03-01"), day("2024-03-04"), None, f"{i:03}" if i % 50 else None, None))
        for j in range(rng.randrange(0, 3)):
            payments.append((f"T{key}-{j}", "Cash", amount(i), dt.datetime(2024, 3, 1), None, key))
    return make_tables(booking=bookings, transaction=payments, customer=ON_FILE if batch == 0 else [])


def filled(spark, make_tables, folder, amount, rng, count=3, slice_rows=10):
    for n in range(count):
        made = facts(make_tables, n, amount, rng)
        parts = {name: getattr(made, name) for name in ("booking", "transaction", "customer")}
        batches.write_batch(spark, folder, n, parts, {})
    assert update_ranking(spark, folder, slice_rows) == list(range(count))
    return read_parquet_tables(spark, folder)


AMOUNTS = {
    # A few customers spend far more than all others.
    "steep": lambda rng: lambda i: money(f"{10_000 // (i + 1)}.50"),
    "ties": lambda rng: lambda i: money("5.00"),
    "signs": lambda rng: lambda i: None if i % 7 == 0 else money(f"{rng.randrange(-500, 500)}.25"),
}


@pytest.mark.parametrize("kind", sorted(AMOUNTS))
def test_same_as_ranking_all(spark, make_tables, tmp_path, kind):
    rng = random.Random(kind)
    folder = str(tmp_path)
    tables = filled(spark, make_tables, folder, AMOUNTS[kind](rng), rng)
    for k in (1, 5, 1_000):
        found = top_customers(tables, folder, k)
        assert found.rows.collect() == customers.top_customers(tables, k).collect(), k
    few = top_customers(tables, folder, 3, most_candidates=4)
    assert few.rows.collect() == customers.top_customers(tables, 3).collect()
    if kind == "steep":
        few = top_customers(tables, folder, 3)
        assert few.slices_read < few.slices / 2 and few.buckets_read < 32


def test_edits_begin_anew(spark, make_tables, tmp_path):
    folder = str(tmp_path)
    tables = filled(spark, make_tables, folder, AMOUNTS["steep"](None), random.Random(1), count=2)
    largest = tables.transaction.orderBy("amount", ascending=False).limit(3)
    batches.write_batch(spark, folder, 2, {}, {}, {"transaction": spark.createDataFrame(largest.collect(), tables.transaction.schema)})
    assert update_ranking(spark, folder, 10) == [2]
    after = read_parquet_tables(spark, folder)
    assert top_customers(after, folder, 6).rows.collect() == customers.top_customers(after, 6).collect()
    assert after.transaction.count() == tables.transaction.count() - 3


def test_nothing_there(spark, make_tables, tmp_path):
    folder = str(tmp_path)
    batches.write_batch(spark, folder, 0, {"customer": make_tables(customer=ON_FILE).customer}, {})
    update_ranking(spark, folder)
    assert top_customers(read_parquet_tables(spark, folder), folder).rows.collect() == []
