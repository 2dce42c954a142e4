"""Booking requests and edits taken batch by batch, and booking requests from a stream.

The tables lie in one folder, written in batches (``sources.batches``). Batch n reads only whole batches
before it and becomes visible as a whole, so a batch that is run again after a failure leaves the same
rows once. Id numbers continue from the marks of the batches; the tables' ids are not looked at again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetframe.operators.booking_intake import booking_series, process_booking_requests
from fleetframe.operators.changes import process_customer_changes, process_staff_changes
from fleetframe.sources.batches import BASE_BATCH, highest_numbers, marked_batches, write_batch
from fleetframe.sources.tables import SCHEMAS, RentalTables, read_parquet_tables


def write_base(tables: RentalTables, folder: str, batch_id: int = BASE_BATCH) -> None:
    """Write a snapshot as the batch before all others."""
    highest = {s.column: s.highest_in_use().first()["highest"] for s in booking_series(tables)}
    write_batch(tables.spark, folder, batch_id, {n: getattr(tables, n) for n in SCHEMAS}, highest)


def read_before(spark: SparkSession, folder: str, batch_id: int) -> RentalTables:
    """The tables as they were before a batch; other batches are not read."""
    return read_parquet_tables(spark, folder, before=batch_id)


def compact(spark: SparkSession, folder: str, into: str) -> int:
    """Write all whole batches as one into a new folder; later batches go on there.

    Of an edited key only its newest state is written, so the new folder has no edits to resolve.
    Returns the number of the last batch, under which the new folder has its snapshot. Decisions stay in
    the old folder.
    """
    last = max(marked_batches(spark, folder) or [BASE_BATCH])
    highest = highest_numbers(spark, folder, last + 1)
    tables = read_parquet_tables(spark, folder)
    write_batch(spark, into, last, {n: getattr(tables, n) for n in SCHEMAS}, highest)
    return last


def book_batch(requests: DataFrame, batch_id: int, folder: str, now: dt.datetime, seed: int = 0) -> bool:
    """Decide one batch of requests and write its rows and decisions; False if that was done before."""
    spark = requests.sparkSession
    if batch_id in (marked_batches(spark, folder) or []):
        return False
    tables = read_before(spark, folder, batch_id)
    highest = highest_numbers(spark, folder, batch_id)
    return process_booking_requests(requests, tables, now, seed, highest).append_to(folder, batch_id)


def edit_batch(table: str, changes: DataFrame, batch_id: int, folder: str, now: dt.datetime) -> bool:
    """Apply one batch of edits to customers or staff and log them; False if that was done before."""
    spark = changes.sparkSession
    if batch_id in (marked_batches(spark, folder) or []):
        return False
    process = {"customer": process_customer_changes, "staff": process_staff_changes}[table]
    return process(getattr(read_before(spark, folder, batch_id), table), changes, now).write_to(folder, batch_id)


def read_mark_batch(spark: SparkSession, batch_id: int, folder: str) -> bool:
    """Mark all log entries of earlier batches as read; no entry is written again."""
    return write_batch(spark, folder, batch_id, {}, {}, read=("notification",))


def start_booking_stream(
    requests: DataFrame,
    folder: str,
    checkpoint: str,
    clock: Callable[[], dt.datetime],
    until_caught_up: bool = False,
) -> StreamingQuery:
    """Run ``book_batch`` on every micro-batch of a stream of booking requests.

    ``clock`` gives the time of a batch. With ``until_caught_up`` the query
    stops after the requests that are present now.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty():
            book_batch(rows, batch_id, folder, clock())

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if until_caught_up:
        writer = writer.trigger(availableNow=True)
    return writer.start()
