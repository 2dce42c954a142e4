"""Availability of cars as the state of a stream of booking requests.

The state of a car is the days on which it is taken, as merged ranges. It starts with the booked ranges of the
tables and grows with every accepted request, so a micro-batch reads its requests and the state of their cars,
and no history. The state lies in RocksDB with its change log in the checkpoint folder of the stream: a
stream that is started again goes on where it stopped, and a batch that is run again finds the state it
found before.

Requests count in order of ``arrival`` within a batch, and a batch comes after those before it. So a stream
whose batches follow the arrivals decides as one batch over all requests (``admit_bookings``).
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetframe import fixed
from fleetframe.operators.intake import REASON
from fleetframe.plans.lookups import measured
from fleetframe.session import reach_workers, stored
from fleetframe.sources.tables import RentalTables

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANGE = "first int, last int"


def taken_ranges(tables: RentalTables, from_day: dt.date | None = None) -> DataFrame:
    """(car_id, first, last): the days on which cars are booked, as ranges without a shared or adjoining day.

    Days are numbered. Only bookings with a payment for the car count. A range recorded back to front
    takes the days between its ends. Ranges wholly before ``from_day`` are left out. They are written once, as a
    stream neither plans joins adaptively nor keeps their result for its next start.
    """
    first, last = F.least("start_date", "end_date"), F.greatest("start_date", "end_date")
    dated = tables.booking.filter(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    ranges = dated.select("booking_id", F.unix_date(first).alias("first"), F.unix_date(last).alias("last"))
    if from_day is not None:
        ranges = ranges.filter(F.col("last") >= F.unix_date(F.lit(from_day)))
    payment = tables.transaction.select("transaction_id", "booking_booking_id")
    paid = payment.join(measured(ranges).hinted(), F.col("booking_booking_id") == F.col("booking_id")).select(
        "transaction_id", "first", "last"
    )
    # One row per car and first day before the window, so a car is never longer than its calendar.
    rented = (
        tables.car_transaction.join(
            measured(paid).hinted(), F.col("transaction_transaction_id") == F.col("transaction_id")
        )
        .groupBy(F.col("car_car_id").alias("car_id"), "first")
        .agg(F.max("last").alias("last"))
        .filter("car_id IS NOT NULL")
    )
    by_day = Window.partitionBy("car_id").orderBy("first")
    reached = F.max("last").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") <= reached + 1, 0).otherwise(1)
    islands = rented.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_day))
    return stored(
        islands.groupBy("car_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")
    )


def take_days(held: list[tuple[int, int]], first: int, last: int) -> bool:
    """Add a range to sorted disjoint ranges unless it shares a day with one of them; whether it was added."""
    at = bisect_left(held, (first, first))
    if at < len(held) and held[at][0] <= last:
        return False
    if at and held[at - 1][1] >= first:
        return False
    # Ranges that adjoin become one.
    if at < len(held) and held[at][0] == last + 1:
        last = held.pop(at)[1]
    if at and held[at - 1][1] == first - 1:
        first = held.pop(at - 1)[0]
    insort(held, (first, last))
    return True


class CarCalendar(StatefulProcessor):
    """Decides the requests for one car."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", RANGE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.taken.put([(r["first"], r["last"]) for r in initialState["ranges"]])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked = sorted(rows, key=lambda r: (r["arrival"] is None, r["arrival"] or 0))
        held = [tuple(r) for r in self.taken.get()] if self.taken.exists() else []
        before = len(held), sum(b - a for a, b in held)
        fits = [take_days(held, r["first"], r["last"]) for r in asked]
        if (len(held), sum(b - a for a, b in held)) != before:
            self.taken.put(held)
        for r, accepted in zip(asked, fits):
            yield Row(arrival=r["arrival"], car_id=r["car_id"], accepted=accepted)

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, initial: DataFrame) -> DataFrame:
    """A stream of decisions (arrival, car_id, reject_reason) about a stream of requests.

    ``requests`` has arrival, car_id, start, end and reject_reason; rows with a reason are passed through, and
    so do not touch the state. ``initial`` has the ``taken_ranges`` at the start of the stream. A car's ranges come
    to its state as one row, as rows are handed over in parts and each part would replace those before.
    """
    reach_workers(requests.sparkSession)
    is_open = F.col(REASON).isNull()
    asked = requests.filter(is_open & F.col("car_id").isNotNull()).select(
        "arrival", "car_id", F.unix_date("start").alias("first"), F.unix_date("end").alias("last")
    )
    kind = requests.schema["arrival"].dataType.simpleString()
    calendars = initial.groupBy("car_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    decided = asked.groupBy("car_id").transformWithState(
        statefulProcessor=CarCalendar(),
        outputStructType=f"arrival {kind}, car_id string, accepted boolean",
        outputMode="Append",
        timeMode="None",
        initialState=calendars.groupBy("car_id"),
    )
    free = decided.select("arrival", "car_id", F.when(~F.col("accepted"), fixed.CAR_UNAVAILABLE).alias(REASON))
    # Validation turns requests without a car away; any others are let through.
    rest = requests.filter(~is_open | F.col("car_id").isNull()).select("arrival", "car_id", REASON)
    return free.unionByName(rest)


def start_admission(
    requests: DataFrame, initial: DataFrame, folder: str, checkpoint: str, until_caught_up: bool = False
) -> StreamingQuery:
    """Write the decisions about a stream of requests to a parquet folder, each once.

    ``initial`` is read at the first start only; afterwards the state comes from ``checkpoint``. With
    ``until_caught_up`` the query stops after the requests that are present now.
    """
    spark = requests.sparkSession
    before = spark.conf.get(STATE_STORE)
    # A stream keeps the settings it was started with.
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        writer = admitted(requests, initial).writeStream.format("parquet").option("path", folder)
        writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
        if until_caught_up:
            writer = writer.trigger(availableNow=True)
        return writer.start()
    finally:
        spark.conf.set(STATE_STORE, before)
