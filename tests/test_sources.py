import datetime as dt

import pytest

from fleetframe.operators.booking_intake import process_booking_requests
from fleetframe.operators.changes import apply_customer_changes, process_customer_changes
from fleetframe.operators.intake import IdSeries
from fleetframe.sources import batches, sinks
from fleetframe.sources.tables import SCHEMAS, empty_tables, jdbc_options, read_parquet_tables
from fleetframe.streaming.micro_batch import (
    book_batch,
    compact,
    edit_batch,
    read_before,
    read_mark_batch,
    start_booking_stream,
    write_base,
)
from test_intake import BOOKING_REQUEST, booking

NOW = dt.datetime(2024, 3, 10, 8, 30)
STAFF_EDIT = "arrival bigint, action string, staff_id string, name string, position string, contact string"


def test_tables_round_trip(spark, small, tmp_path):
    for name in SCHEMAS:
        sinks.append_rows(getattr(small, name), f"{tmp_path}/{name}")
    read = read_parquet_tables(spark, str(tmp_path))
    for name, schema in SCHEMAS.items():
        assert getattr(read, name).schema == schema
        assert sorted(map(str, getattr(read, name).collect())) == sorted(map(str, getattr(small, name).collect()))
    read.create_views("rental_")
    assert spark.sql("select count(*) from rental_booking").first()[0] == 4
    assert empty_tables(spark).booking.count() == 0


def test_snapshots_never_overwrite(small, tmp_path):
    sinks.write_snapshot(small.staff, f"{tmp_path}/staff")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_snapshot(small.staff, f"{tmp_path}/staff")


def test_json_rows_keep_nulls(spark):
    frame = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.json_rows(frame).first().json == '{"a":1,"b":null}'


PARTS = ("customer", "car_transaction", "transaction", "booking")


@pytest.mark.parametrize("written", range(5))
def test_a_batch_that_broke_off_leaves_no_trace(spark, small, tmp_path, written):
    """The write stops after some of the four tables; nothing shows, and the next run leaves all rows once."""
    folder = str(tmp_path)
    write_base(small, folder)
    rows = [booking(1, start="2024-05-10", end="2024-05-12"), booking(2, start="2024-06-10", end="2024-06-12")]
    frame = spark.createDataFrame(rows, BOOKING_REQUEST)
    broken = process_booking_requests(frame, read_before(spark, folder, 0), NOW)
    for name in PARTS[:written]:
        batches.write_part(getattr(broken, name), folder, name, 0)
    between = read_parquet_tables(spark, folder)
    assert {n: getattr(between, n).count() for n in PARTS} == {n: getattr(small, n).count() for n in PARTS}
    assert book_batch(frame, 0, folder, NOW)
    after = read_parquet_tables(spark, folder)
    new = after.booking.join(small.booking, "booking_id", "left_anti")
    assert new.count() == 2
    paid = new.join(after.transaction, new.booking_id == after.transaction.booking_booking_id)
    bridged = paid.join(
        after.car_transaction, paid.transaction_id == after.car_transaction.transaction_transaction_id
    )
    assert paid.groupBy("booking_id").count().collect() and paid.count() == 2 and bridged.count() == 2
    assert not book_batch(frame, 0, folder, NOW)
    assert read_parquet_tables(spark, folder).transaction.count() == small.transaction.count() + 2


def test_ids_continue_from_the_marks(spark, small, tmp_path, monkeypatch):
    """Three batches: numbers go on, and only the first look reads ids."""
    folder = f"{tmp_path}/a"
    write_base(small, folder)
    monkeypatch.setattr(IdSeries, "highest_in_use", lambda self: pytest.fail("looked at all ids"))
    seen = []
    for n in range(3):
        rows = [booking(k, start=f"2024-0{5 + n}-0{k}", end=f"2024-0{5 + n}-0{k + 1}") for k in (1, 4)]
        assert book_batch(spark.createDataFrame(rows, BOOKING_REQUEST), n, folder, NOW)
        seen.append(batches.highest_numbers(spark, folder, n + 1))
    assert [s["booking_id"] - seen[0]["booking_id"] for s in seen] == [0, 2, 4]
    ids = [r.booking_id for r in read_parquet_tables(spark, folder).booking.collect()]
    assert len(ids) == len(set(ids)) == 10
    into = f"{tmp_path}/b"
    assert compact(spark, folder, into) == 2
    assert batches.marked_batches(spark, into) == [2]
    rows = [booking(1, start="2024-09-01", end="2024-09-02")]
    assert book_batch(spark.createDataFrame(rows, BOOKING_REQUEST), 3, into, NOW)
    after = read_parquet_tables(spark, into)
    assert after.booking.count() == 11 and after.booking.select("booking_id").distinct().count() == 11
    assert batches.highest_numbers(spark, into, 4)["booking_id"] == seen[2]["booking_id"] + 1


EDIT = "arrival bigint, action string, id_card string, name string, phone_number string, address string, drivers_license string"
EDITS = [(1, "update", "1111", "Ana B", "0811", "New 1", "L1"), (2, "delete", "3333", None, None, None, None)]


def names(tables):
    return sorted((r.id_card, r.name) for r in tables.customer.collect())


def test_edits_and_their_log_come_together(spark, small, tmp_path):
    """The case of an update of customers and their log: handlers of edits change the one table that all reports read."""
    folder = str(tmp_path)
    write_base(small, folder)
    edits = spark.createDataFrame(EDITS, EDIT)
    assert edit_batch("customer", edits, 0, folder, NOW) and not edit_batch("customer", edits, 0, folder, NOW)
    after = read_parquet_tables(spark, folder)
    assert names(after) == [("1111", "Ana B"), ("2222", "Budi")]
    assert sorted(r.type for r in after.notification.collect()) == ["danger", "success"]
    # Only the changed row is written, not the table.
    assert spark.read.parquet(f"{folder}/customer/batch_id=0").count() == 1
    assert names(read_before(spark, folder, 0)) == names(small)


def test_deleted_and_booked_again(spark, small, tmp_path):
    """A deleted customer who comes back with a booking is there once; later edits reach the new row."""
    folder, into = f"{tmp_path}/a", f"{tmp_path}/b"
    write_base(small, folder)
    edit_batch("customer", spark.createDataFrame([(1, "delete", "3333", *[None] * 4)], EDIT), 0, folder, NOW)
    back = (1, "Citra", "new_customer", "0844000000", "3" * 16, "L9", "x", "K1", "2024-05-10", "2024-05-12")
    assert book_batch(spark.createDataFrame([back], BOOKING_REQUEST), 1, folder, NOW)
    for n, edits in ((2, [(1, "update", "3" * 16, "Twice", "1", "y", "z")]), (3, [(1, "update", "3" * 16, "Thrice", "1", "y", "z")])):
        assert edit_batch("customer", spark.createDataFrame(edits, EDIT), n, folder, NOW)
    expected = [("1111", "Ana"), ("2222", "Budi"), ("3" * 16, "Thrice")]
    assert names(read_parquet_tables(spark, folder)) == expected
    assert compact(spark, folder, into) == 3
    assert names(read_parquet_tables(spark, into)) == expected
    assert edit_batch("customer", spark.createDataFrame([(1, "delete", "1111", *[None] * 4)], EDIT), 4, into, NOW)
    assert names(read_parquet_tables(spark, into)) == expected[1:]


@pytest.mark.parametrize("written", range(3))
def test_an_edit_batch_that_broke_off(spark, small, tmp_path, written):
    """Between two booking batches the write of an edit batch stops after some parts; then it runs again."""
    folder = str(tmp_path)
    write_base(small, folder)
    first = [booking(1, start="2024-05-10", end="2024-05-12")]
    assert book_batch(spark.createDataFrame(first, BOOKING_REQUEST), 0, folder, NOW)
    edits = spark.createDataFrame(EDITS, EDIT)
    broken = process_customer_changes(read_before(spark, folder, 1).customer, edits, NOW)
    parts = {**broken.parts(), batches.edited_part("customer"): broken.ended}
    for name in list(parts)[:written]:
        batches.write_part(parts[name], folder, name, 1)
    between = read_parquet_tables(spark, folder)
    assert names(between) == names(small) and between.notification.count() == 0
    assert edit_batch("customer", edits, 1, folder, NOW)
    second = [booking(2, start="2024-06-10", end="2024-06-12")]
    assert book_batch(spark.createDataFrame(second, BOOKING_REQUEST), 2, folder, NOW)
    after = read_parquet_tables(spark, folder)
    assert names(after) == [("1111", "Ana B"), ("2222", "Budi")]
    assert after.booking.count() == 6 and after.notification.count() == 2


def test_log_marked_as_read(spark, small, tmp_path):
    folder, into = f"{tmp_path}/a", f"{tmp_path}/b"
    write_base(small, folder)
    edit_batch("customer", spark.createDataFrame(EDITS, EDIT), 0, folder, NOW)
    assert read_mark_batch(spark, 1, folder) and not read_mark_batch(spark, 1, folder)
    edit_batch("staff", spark.createDataFrame([(1, "delete", "S1", *[None] * 3)], STAFF_EDIT), 2, folder, NOW)
    compact(spark, folder, into)
    for tables in (read_parquet_tables(spark, folder), read_parquet_tables(spark, into)):
        assert sorted((r.is_read, r.type) for r in tables.notification.collect()) == [(0, "danger"), (1, "danger"), (1, "success")]
        assert [r.staff_id for r in tables.staff.collect()] == ["S2"]
    assert batches.contents(spark, into).edited == frozenset()


def test_edits_give_the_same_table_either_way(spark, small):
    """Rows replaced and ended add up to the table that applying the edits gives."""
    edits = spark.createDataFrame([*EDITS, (3, "update", "3333", "Late", *[None] * 3), (4, "update", "9", "Ghost", *[None] * 3)], EDIT)
    made = process_customer_changes(small.customer, edits, NOW)
    expected = sorted(map(str, apply_customer_changes(small.customer, edits).collect()))
    assert sorted(map(str, made.applied_to(small.customer).collect())) == expected
    assert sorted(r.id_card for r in made.ended.collect()) == ["1111", "3333"]


def test_jdbc_options():
    split = {"transaction": {"partitionColumn": "n", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}}
    made = jdbc_options("jdbc:x", {"user": "u"}, {"staff": "Crew"}, split, large=("transaction",))
    assert made["car_transaction"] == {"user": "u", "url": "jdbc:x", "dbtable": "Car_Transaction"}
    assert made["staff"]["dbtable"] == "Crew" and made["transaction"]["numPartitions"] == "3"
    assert set(made) == set(SCHEMAS)
    with pytest.raises(ValueError, match="booking"):
        jdbc_options("jdbc:x", {}, large=("booking",))


def test_a_stream_of_requests_sees_earlier_batches(spark, small, tmp_path):
    folder, inbox = f"{tmp_path}/tables", f"{tmp_path}/inbox"
    write_base(small, folder)

    def run():
        stream = spark.readStream.schema(BOOKING_REQUEST).parquet(inbox)
        start_booking_stream(stream, folder, f"{tmp_path}/progress", lambda: NOW, until_caught_up=True).awaitTermination()

    first = [booking(1, start="2024-05-10", end="2024-05-12"), booking(2, start="2024-05-12", end="2024-05-14")]
    spark.createDataFrame(first, BOOKING_REQUEST).coalesce(1).write.mode("append").parquet(inbox)
    run()
    second = [booking(3, start="2024-05-12", end="2024-05-13"), booking(4, start="2024-05-13", end="2024-05-14")]
    spark.createDataFrame(second, BOOKING_REQUEST).coalesce(1).write.mode("append").parquet(inbox)
    run()
    decided = spark.read.parquet(f"{folder}/decision").collect()
    assert {r.arrival: r.reject_reason is None for r in decided} == {1: True, 2: False, 3: False, 4: True}
    assert read_before(spark, folder, 99).booking.count() == 6
