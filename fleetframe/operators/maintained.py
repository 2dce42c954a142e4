"""Reports kept up to date batch by batch, from signed rows.

A batch changes a table by the rows it adds, with weight 1, and the rows it ends, as they were, with weight -1.
Counts and sums of weighted rows per day add up over batches, so an edit or a deletion subtracts what it
ends, and a report needs the few daily sums of all batches and none of their rows. ``update_reports`` reads
the batches that are new since it last ran. ``folder/<sums>/batch_id=<n>`` holds the sums of batch n, and the mark
``folder/maintained/batch_id=<n>`` follows when they are whole.

Cars out on rental need three tables: a rented range is a bridge row with its payment and booking. A batch that
brings all three reads nothing else. History is read for single keys only: for a bridge row whose payment or
booking came in an earlier batch, and for payments and bookings that were edited. Payments must not come
before their booking, nor bridge rows before their payment.

Every report gives the rows of its namesake in ``months``, ``payments`` and ``dashboard``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.functions import full_month_name, half_up_ratio, months_before, percent_of
from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.session import scratch_tables, stored
from fleetframe.sources.batches import contents, edited_part, read_marks, write_part
from fleetframe.sources.tables import EDITABLE, SCHEMAS, read_parquet_tables

MAINTAINED = "maintained"
BOOKING_DAYS, PAYMENT_DAYS, SIZES, RENTED = "booking_days", "payment_days", "table_sizes", "rented_ranges"
_TOTAL = "decimal(28,2)"
SUMS = {
    BOOKING_DAYS: "day date, `rows` bigint",
    PAYMENT_DAYS: f"day date, `rows` bigint, ids bigint, amounts bigint, total {_TOTAL}",
    SIZES: "`table` string, `rows` bigint",
    RENTED: "car_id string, first date, last date, `rows` bigint",
}
COUNTED = ("customer", "car")


def _part(spark: SparkSession, folder: str, name: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
    """What one batch wrote of a table; None if it wrote nothing."""
    return read_marks(spark, f"{folder}/{name}/batch_id={batch_id}", schema)


def changes_of(spark: SparkSession, folder: str, table: str, batch_id: int) -> DataFrame | None:
    """The rows that a batch added (``weight`` 1) and ended (-1); None if it left the table alone.

    Reads files of this batch only.
    """
    added = _part(spark, folder, table, SCHEMAS[table], batch_id)
    ended = _part(spark, folder, edited_part(table), SCHEMAS[table], batch_id) if table in EDITABLE else None
    signed = [rows.withColumn("weight", F.lit(w)) for rows, w in ((added, 1), (ended, -1)) if rows is not None]
    if not signed:
        return None
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


def _weighed(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("weight"))), F.lit(0)).cast("bigint")


def _booking_days(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.col("date_preserved").alias("day")).agg(_weighed(F.lit(True)).alias("rows"))


def _payment_days(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.to_date("payment_date").alias("day")).agg(
        _weighed(F.lit(True)).alias("rows"),
        _weighed(F.col("transaction_id").isNotNull()).alias("ids"),
        _weighed(F.col("amount").isNotNull()).alias("amounts"),
        F.coalesce(F.sum(F.col("amount") * F.col("weight")), F.lit(0)).cast(_TOTAL).alias("total"),
    )


def partners(rows: DataFrame, key: str, found_in: DataFrame | None, before: DataFrame) -> DataFrame:
    """Rows with the row of another table that ``key`` names, from the same batch or, if need be, from earlier ones."""
    name = found_in.columns[0] if found_in is not None else before.columns[0]
    same = F.col(key) == F.col(name)
    if found_in is None:
        return rows.join(before, same).drop(name)
    # Rows meet those of their batch once; what either side below needs is read from the result.
    met = stored(rows.filter(F.col(key).isNotNull()).join(found_in.withColumn("_met", F.lit(True)), same, "left"))
    inside = met.filter("_met").drop(name, "_met")
    missing = met.filter("_met IS NULL").select(*rows.columns)
    if missing.isEmpty():
        return inside
    few = measured(missing)
    wanted = matching_rows(before, name, few, key) if few.fits_broadcast(key) else before
    return inside.unionByName(few.frame.join(wanted, same).drop(name))


_PAYMENT = ["transaction_id", "booking_booking_id"]
_BOOKING = ["booking_id", "start_date", "end_date"]


def _rented_ranges(spark: SparkSession, folder: str, batch_id: int) -> list[DataFrame]:
    """(car_id, start_date, end_date, weight) of what a batch changes."""
    added = {n: _part(spark, folder, n, SCHEMAS[n], batch_id) for n in ("booking", "transaction", "car_transaction")}
    ended = {n: _part(spark, folder, edited_part(n), SCHEMAS[n], batch_id) for n in ("booking", "transaction")}
    after = read_parquet_tables(spark, folder, before=batch_id + 1)
    before = read_parquet_tables(spark, folder, before=batch_id)
    payments = None if added["transaction"] is None else added["transaction"].select(*_PAYMENT)
    bookings = None if added["booking"] is None else added["booking"].select(*_BOOKING)
    bridge = {"car": F.col("car_car_id").alias("car_id"), "payment": F.col("transaction_transaction_id").alias("payment")}
    out = []

    def dated(rows: DataFrame) -> DataFrame:
        with_booking = partners(rows, "booking_booking_id", bookings, after.booking.select(*_BOOKING))
        return with_booking.select("car_id", "start_date", "end_date", "weight")

    if added["car_transaction"] is not None:
        rows = added["car_transaction"].select(*bridge.values(), F.lit(1).alias("weight"))
        out.append(dated(partners(rows, "payment", payments, after.transaction.select(*_PAYMENT)).drop("payment")))
    if ended["transaction"] is not None:
        # Cars that were rented with a payment before it changed.
        changed = _changed(added["transaction"], ended["transaction"], "transaction_id").select(*_PAYMENT, "weight")
        few = measured(changed)
        rented = matching_rows(before.car_transaction, "transaction_transaction_id", few, "transaction_id").select(*bridge.values())
        out.append(dated(rented.join(few.hinted(), F.col("payment") == F.col("transaction_id")).drop("payment", "transaction_id")))
    if ended["booking"] is not None:
        changed = _changed(added["booking"], ended["booking"], "booking_id").select(*_BOOKING, "weight")
        few = measured(changed)
        paid = measured(matching_rows(before.transaction.select(*_PAYMENT), "booking_booking_id", few, "booking_id"))
        rented = matching_rows(before.car_transaction, "transaction_transaction_id", paid, "transaction_id").select(*bridge.values())
        with_payment = rented.join(paid.hinted(), F.col("payment") == F.col("transaction_id"))
        joined = with_payment.join(few.hinted(), F.col("booking_booking_id") == F.col("booking_id"))
        out.append(joined.select("car_id", "start_date", "end_date", "weight"))
    return out


def _changed(added: DataFrame | None, ended: DataFrame, key: str) -> DataFrame:
    """Old and new states of edited keys, signed."""
    old = ended.withColumn("weight", F.lit(-1))
    if added is None:
        return old
    return old.unionByName(added.join(ended.select(key), key, "left_semi").withColumn("weight", F.lit(1)))


def update_reports(spark: SparkSession, folder: str) -> list[int]:
    """Add up the whole batches that are new; returns their numbers. A batch that broke off is added up anew."""
    held = contents(spark, folder)
    if held is None:
        raise ValueError(f"{folder} is not written in batches")
    done = _maintained(spark, folder)
    new = [n for n in held.batches if n not in done]
    for n in new:
        with scratch_tables(spark):
            _add_up(spark, folder, n)
    return new


def _add_up(spark: SparkSession, folder: str, n: int) -> None:
    """Write the sums of one batch and its mark."""
    changed = {table: changes_of(spark, folder, table, n) for table in ("booking", "transaction", *COUNTED)}
    if changed["booking"] is not None:
        write_part(_booking_days(changed["booking"]), folder, BOOKING_DAYS, n)
    if changed["transaction"] is not None:
        write_part(_payment_days(changed["transaction"]), folder, PAYMENT_DAYS, n)
    sizes = [
        rows.agg(F.lit(table).alias("table"), _weighed(F.lit(True)).alias("rows"))
        for table, rows in changed.items()
        if table in COUNTED and rows is not None
    ]
    ranges = _rented_ranges(spark, folder, n)
    for name, parts in ((SIZES, sizes), (RENTED, ranges)):
        if parts:
            rows = parts[0]
            for part in parts[1:]:
                rows = rows.unionByName(part)
            write_part(rows if name == SIZES else _per_range(rows), folder, name, n)
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MAINTAINED}/batch_id={n}")


def _per_range(rows: DataFrame) -> DataFrame:
    rented = rows.filter("car_id IS NOT NULL AND start_date <= end_date")
    grouped = rented.groupBy("car_id", F.col("start_date").alias("first"), F.col("end_date").alias("last"))
    return grouped.agg(_weighed(F.lit(True)).alias("rows")).filter(F.col("rows") != 0)


def _maintained(spark: SparkSession, folder: str) -> list[int]:
    marks = read_marks(spark, f"{folder}/{MAINTAINED}", T.StructType.fromDDL("id bigint, batch_id bigint"))
    return [] if marks is None else sorted(r["batch_id"] for r in marks.collect())


class MaintainedReports:
    """Reports from the sums of the batches added up so far."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.batches = _maintained(spark, folder)

    def sums(self, name: str) -> DataFrame:
        """The sums of all batches added up so far, not yet merged."""
        schema = T.StructType.fromDDL(f"{SUMS[name]}, batch_id bigint")
        rows = read_marks(self.spark, f"{self.folder}/{name}", schema)
        rows = self.spark.createDataFrame([], schema) if rows is None else rows
        return rows.filter(F.col("batch_id").isin(self.batches))

    def _months(self, name: str, as_of: dt.date, months: int, *sums: str) -> DataFrame:
        """Months of the trailing window that have rows left."""
        return (
            self.sums(name)
            .filter(F.col("day") >= months_before(as_of, months))
            .groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums])
            .filter(F.col("rows") > 0)
            .withColumn("month_name", full_month_name(F.col("year"), F.col("month")))
        )

    def monthly_bookings(self, as_of: dt.date, months: int = 12) -> DataFrame:
        monthly = self._months(BOOKING_DAYS, as_of, months)
        return monthly.select("year", "month", "month_name", F.col("rows").alias("booking_count")).orderBy("year", "month")

    def _revenue(self, as_of: dt.date, months: int) -> DataFrame:
        monthly = self._months(PAYMENT_DAYS, as_of, months, "ids", "amounts", "total")
        # A sum without amounts is NULL.
        return monthly.withColumn("total", F.when(F.col("amounts") > 0, F.col("total")))

    def revenue_growth(self, as_of: dt.date, months: int = 12) -> DataFrame:
        return (
            self._revenue(as_of, months)
            .select("year", "month", "month_name", F.col("total").alias("monthly_revenue"), F.col("rows").alias("transaction_count"))
            .orderBy("year", "month")
        )

    def monthly_revenue_report(self, as_of: dt.date, months: int = 12) -> DataFrame:
        return (
            self._revenue(as_of, months)
            .select(
                F.col("year").alias("Year"),
                F.col("month").alias("Month"),
                F.col("month_name").alias("Month_Name"),
                F.col("ids").alias("Total_Transactions"),
                F.col("total").alias("Monthly_Revenue"),
                half_up_ratio(F.col("total"), F.col("amounts"), 2).alias("Average_Transaction"),
            )
            .orderBy("Year", "Month")
        )

    def monthly_revenue_recent(self, as_of: dt.date, months: int = 6) -> DataFrame:
        return (
            self._revenue(as_of, months)
            .select(
                F.col("year").alias("Year"),
                F.col("month").alias("Month"),
                F.col("month_name").alias("Month_Name"),
                F.col("rows").alias("Total_Transactions"),
                F.col("total").alias("Total_Revenue"),
            )
            .orderBy(F.desc("Year"), F.desc("Month"))
        )

    def today_stats(self, as_of: dt.date) -> DataFrame:
        zero = F.lit(0)
        day = self.sums(PAYMENT_DAYS).filter(F.col("day") == F.lit(as_of))
        return day.agg(
            F.coalesce(F.sum("rows"), zero).alias("Today_Transactions"),
            F.coalesce(F.sum("total"), zero).alias("Today_Revenue"),
            F.coalesce(half_up_ratio(F.sum("total"), F.sum("amounts"), 6), zero).alias("Today_Average"),
        )

    def dashboard_stats(self, as_of: dt.date) -> DataFrame:
        today = F.lit(as_of)
        running = self.sums(RENTED).filter((F.col("first") <= today) & (F.col("last") >= today))
        out = running.groupBy("car_id").agg(F.sum("rows").alias("rows")).filter(F.col("rows") > 0)
        sizes = self.sums(SIZES)

        def size(table: str) -> Column:
            return F.coalesce(sizes.filter(F.col("table") == table).agg(F.sum("rows")).scalar(), F.lit(0))

        counted = self.today_stats(as_of).select(
            F.col("Today_Revenue").alias("today_revenue"),
            F.col("Today_Transactions").alias("today_transactions"),
            out.agg(F.count("*")).scalar().alias("active_rentals"),
            size("car").alias("total_cars"),
            size("customer").alias("total_customers"),
        )
        return counted.select(
            "today_revenue",
            "today_transactions",
            "active_rentals",
            "total_cars",
            (F.col("total_cars") - F.col("active_rentals")).alias("available_cars"),
            "total_customers",
            percent_of(F.col("active_rentals"), F.col("total_cars")).alias("utilization_rate"),
        )
