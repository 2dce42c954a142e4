"""Exact distinct counts that merge over batches: a stable number per key, and bitmaps of the numbers.

Keys are numbered in the order of the batches in which they first occur, and a number never changes. A batch
writes, per payment method and day of rental start, a bitmap of the customers with a paid booking, and one
of the rented cars; bitmaps of any batches, methods or days merge by OR, and the set bits are the
distinct keys. A batch reads its own rows and the numbers of keys; of earlier rows only the bookings that its
payments name and that it did not bring itself.

Bits cannot be taken back. A batch that ends bookings or payments therefore writes bitmaps of the whole present
state, and earlier ones no longer count. The mark ``folder/counted/batch_id=<n>`` says which it is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.functions import full_month_name, months_before
from fleetframe.operators.maintained import partners
from fleetframe.plans.paging import with_positions
from fleetframe.session import pin, scratch_tables, stored
from fleetframe.sources.batches import contents, edited_part, read_marks, write_part
from fleetframe.sources.tables import SCHEMAS, read_parquet_tables

COUNTED = "counted"
CUSTOMER_BITS, CAR_BITS = "customer_bits", "car_bits"
NUMBERS = {CUSTOMER_BITS: "customer_numbers", CAR_BITS: "car_numbers"}
_SCHEMAS = {
    CUSTOMER_BITS: "payment_method string, day date, bucket bigint, bits binary",
    CAR_BITS: "bucket bigint, bits binary",
}
_NUMBERED = "key string, number bigint"


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    return read_marks(spark, path, T.StructType.fromDDL(f"{ddl}, batch_id bigint"))


def bitmaps(rows: DataFrame, numbers: DataFrame, *groups: str) -> DataFrame:
    """(groups, bucket, bits) of the keys in ``rows``: 32,768 numbers to a bitmap of 4 KB.

    Rows that come twice are looked up twice. The numbers of a bitmap meet before it is made, as a task that holds a
    few of them would send a whole bitmap for these.
    """
    numbered = rows.filter("key IS NOT NULL").join(numbers, "key").withColumn("bucket", F.bitmap_bucket_number("number"))
    dealt = numbered.select(*groups, "bucket", "number").repartition(*groups, "bucket")
    return dealt.groupBy(*groups, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merged_count(bits: DataFrame, *groups: str) -> DataFrame:
    """Distinct keys per group over any set of bitmaps."""
    merged = bits.groupBy(*groups, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("keys"))
    return merged.groupBy(*groups).agg(F.sum("keys").alias("distinct_keys"))


def _numbered(spark: SparkSession, folder: str, name: str, keys: DataFrame, batch_id: int) -> DataFrame:
    """The numbers of all keys up to a batch, after numbering those that are new in it."""
    wanted = keys.filter("key IS NOT NULL").select("key").distinct()
    known = _read(spark, f"{folder}/{name}", _NUMBERED)
    if known is not None:
        # Numbers of this batch may be left from a run that broke off; they are made anew.
        known = known.filter(F.col("batch_id") < batch_id).select("key", "number")
        wanted = wanted.join(known, "key", "left_anti")
        start = known.agg(F.max("number")).first()[0] or 0
    else:
        start = 0
    # Numbers start at 1, as the bitmap functions expect.
    new = pin(with_positions(wanted, [F.asc("key")], "place")).select("key", (F.col("place") + F.lit(start + 1)).alias("number"))
    write_part(new, folder, name, batch_id)
    return new if known is None else known.unionByName(new)


_PAYMENT = ["payment_method", "booking_booking_id"]
_BOOKING = ["booking_id", "start_date", "customer_id_card"]


def _paid(payments: DataFrame, inside: DataFrame | None, before: DataFrame) -> DataFrame:
    """(payment_method, day, key) of payments that have a booking."""
    rows = partners(payments.select(*_PAYMENT), "booking_booking_id", inside, before.select(*_BOOKING))
    return rows.select("payment_method", F.col("start_date").alias("day"), F.col("customer_id_card").alias("key"))


def update_counts(spark: SparkSession, folder: str) -> list[int]:
    """Count the whole batches that are new; returns their numbers."""
    held = contents(spark, folder)
    if held is None:
        raise ValueError(f"{folder} is not written in batches")
    done = {n for n, _ in _counted(spark, folder)}
    new = [n for n in held.batches if n not in done]
    for n in new:
        with scratch_tables(spark):
            _count(spark, folder, n)
    return new


def _count(spark: SparkSession, folder: str, n: int) -> None:
    """Write the bitmaps of one batch and its mark."""
    part = {t: read_marks(spark, f"{folder}/{t}/batch_id={n}", SCHEMAS[t]) for t in ("booking", "transaction", "car_transaction")}
    ended = [t for t in ("booking", "transaction") if read_marks(spark, f"{folder}/{edited_part(t)}/batch_id={n}", SCHEMAS[t]) is not None]
    tables = read_parquet_tables(spark, folder, before=n + 1)
    if ended:
        payments, inside, bridge = tables.transaction, None, tables.car_transaction
    else:
        payments, bridge = part["transaction"], part["car_transaction"]
        inside = None if part["booking"] is None else part["booking"].select(*_BOOKING)
    rows = {
        CUSTOMER_BITS: None if payments is None else _paid(payments, inside, tables.booking),
        CAR_BITS: None if bridge is None else bridge.select(F.col("car_car_id").alias("key")),
    }
    for name, found in rows.items():
        if found is not None:
            found = stored(found.filter("key IS NOT NULL").distinct())
            numbers = _numbered(spark, folder, NUMBERS[name], found, n)
            groups = [c for c in found.columns if c != "key"]
            write_part(bitmaps(found, numbers, *groups), folder, name, n)
    marked = spark.createDataFrame([(bool(ended),)], "anew boolean").coalesce(1)
    marked.write.mode("overwrite").parquet(f"{folder}/{COUNTED}/batch_id={n}")


def _counted(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """The batches counted so far, and whether each began anew."""
    marks = _read(spark, f"{folder}/{COUNTED}", "anew boolean")
    return [] if marks is None else sorted((r["batch_id"], r["anew"]) for r in marks.collect())


class DistinctCounts:
    """Distinct counts from the bitmaps of the batches counted so far."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        counted = _counted(spark, folder)
        first = max((n for n, anew in counted if anew), default=None)
        self.batches = [n for n, _ in counted if first is None or n >= first]

    def bits(self, name: str) -> DataFrame:
        rows = _read(self.spark, f"{self.folder}/{name}", _SCHEMAS[name])
        if rows is None:
            rows = self.spark.createDataFrame([], f"{_SCHEMAS[name]}, batch_id bigint")
        return rows.filter(F.col("batch_id").isin(self.batches))

    def customers_by_method(self) -> DataFrame:
        """Customers with a paid booking per payment method."""
        found = merged_count(self.bits(CUSTOMER_BITS), "payment_method")
        return found.select(F.col("payment_method").alias("Payment_Method"), F.col("distinct_keys").alias("Unique_Customers"))

    def customers_by_month(self, as_of: dt.date, months: int = 6) -> DataFrame:
        """Customers with a paid booking per month of rental start."""
        days = self.bits(CUSTOMER_BITS).filter(F.col("day") >= months_before(as_of, months))
        monthly = days.withColumn("year", F.year("day")).withColumn("month", F.month("day"))
        return merged_count(monthly, "year", "month").select(
            F.col("year").alias("Booking_Year"),
            F.col("month").alias("Booking_Month"),
            full_month_name(F.col("year"), F.col("month")).alias("Month_Name"),
            F.col("distinct_keys").alias("Unique_Customers"),
        ).orderBy(F.desc("Booking_Year"), F.desc("Booking_Month"))

    def customers(self) -> DataFrame:
        """Customers with any paid booking."""
        return merged_count(self.bits(CUSTOMER_BITS)).select(F.coalesce("distinct_keys", F.lit(0)).alias("Unique_Customers"))

    def cars_ever_rented(self) -> DataFrame:
        return merged_count(self.bits(CAR_BITS)).select(F.coalesce("distinct_keys", F.lit(0)).alias("Cars_Ever_Rented"))
