"""The best customers by bounds: a threshold search over sorted lists that stops before they end.

Per batch, payments are rolled up to one row per customer and kept twice: as a list sorted by amount and cut into
slices, each with its highest and lowest amount, and with all sums in buckets by customer. A search reads
the first slices of all batches. A customer it has seen has spent what was seen, and in every other batch
no more than the highest amount of what is unread there, and no less than the lowest; one it has not
seen has no more than these highest amounts together. As soon as the k-th best lower bound is above that,
nobody unseen can be among the k best; those whose upper bound reaches it are looked up in their
buckets, and ranked by their exact sums. Until then twice as many slices are read. A customer holds at most
one row in a batch's list, however many payments there are.

Amounts of all signs are allowed. A batch that ends bookings or payments is rolled up anew from the whole present
state, and earlier lists no longer count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.functions import half_up_ratio
from fleetframe.operators.customers import per_customer
from fleetframe.operators.maintained import partners
from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.plans.paging import top_rows, with_positions
from fleetframe.session import stored
from fleetframe.sources.batches import contents, edited_part, read_marks, write_part
from fleetframe.sources.tables import SCHEMAS, RentalTables, read_parquet_tables

RANKED = "ranked"
LISTS, TOTALS, BOUNDS = "spending_lists", "spending_totals", "spending_bounds"
SLICE_ROWS = 100_000
BUCKETS = 32
# Candidates beyond which further slices are read first.
MOST_CANDIDATES = 10_000
_AMOUNT = "decimal(28,2)"
_SCHEMAS = {
    LISTS: f"customer string, spent {_AMOUNT}, batch_id bigint, slice bigint",
    TOTALS: f"customer string, booking_rows bigint, spent {_AMOUNT}, amounts bigint, last_date date, days bigint, dated bigint,"
    " batch_id bigint, bucket int",
    BOUNDS: f"slice bigint, highest {_AMOUNT}, lowest {_AMOUNT}, batch_id bigint",
    RANKED: "anew boolean, batch_id bigint",
}
_BOOKING = ["booking_id", "customer_id_card", "date_preserved", "start_date", "end_date"]


def _read(spark: SparkSession, folder: str, name: str, batches: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromDDL(_SCHEMAS[name])
    rows = read_marks(spark, f"{folder}/{name}", schema)
    rows = spark.createDataFrame([], schema) if rows is None else rows
    return rows if batches is None else rows.filter(F.col("batch_id").isin(batches))


def _ranked(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    return sorted((r["batch_id"], r["anew"]) for r in _read(spark, folder, RANKED).collect())


def _rolled_up(payments: DataFrame, inside: DataFrame | None, before: DataFrame) -> DataFrame:
    """The sums of each customer over payments that have a booking; payments are reduced per booking first."""
    per_booking = (
        payments.filter(F.col("booking_booking_id").isNotNull())
        .groupBy("booking_booking_id")
        .agg(F.count("*").alias("payments"), F.count("amount").alias("amounts"), F.sum("amount").alias("paid"))
    )
    paid = partners(per_booking, "booking_booking_id", inside, before.select(*_BOOKING))
    sums = per_customer(paid, F.col("payments")).withColumnRenamed("booking_customer", "customer")
    return sums.withColumn("spent", F.col("spent").cast(_AMOUNT))


def update_ranking(spark: SparkSession, folder: str, slice_rows: int = SLICE_ROWS) -> list[int]:
    """Roll up the whole batches that are new; returns their numbers."""
    held = contents(spark, folder)
    if held is None:
        raise ValueError(f"{folder} is not written in batches")
    done = {n for n, _ in _ranked(spark, folder)}
    new = [n for n in held.batches if n not in done]
    for n in new:
        part = {t: read_marks(spark, f"{folder}/{t}/batch_id={n}", SCHEMAS[t]) for t in ("booking", "transaction")}
        anew = any(
            read_marks(spark, f"{folder}/{edited_part(t)}/batch_id={n}", SCHEMAS[t]) is not None for t in part
        )
        tables = read_parquet_tables(spark, folder, before=n + 1)
        payments = tables.transaction if anew else part["transaction"]
        if payments is not None:
            inside = None if anew or part["booking"] is None else part["booking"].select(*_BOOKING)
            totals = stored(_rolled_up(payments, inside, tables.booking))
            bucket = F.pmod(F.crc32("customer"), F.lit(BUCKETS)).cast("int").alias("bucket")
            by_bucket = totals.select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "customer")
            by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{TOTALS}/batch_id={n}")
            order = [F.desc("spent"), F.asc("customer")]
            placed = with_positions(totals.filter("spent IS NOT NULL").select("customer", "spent"), order, "place")
            sliced = stored(placed.withColumn("slice", F.floor(F.col("place") / F.lit(slice_rows))).drop("place"))
            ordered = sliced.repartition("slice").sortWithinPartitions("slice", F.desc("spent"))
            ordered.write.mode("overwrite").partitionBy("slice").parquet(f"{folder}/{LISTS}/batch_id={n}")
            bounds = sliced.groupBy("slice").agg(F.max("spent").alias("highest"), F.min("spent").alias("lowest"))
            write_part(bounds, folder, BOUNDS, n)
        marked = spark.createDataFrame([(anew,)], "anew boolean").coalesce(1)
        marked.write.mode("overwrite").parquet(f"{folder}/{RANKED}/batch_id={n}")
    return new


@dataclass(frozen=True)
class TopCustomers:
    """The rows of ``customers.top_customers``, and how much was read for them."""

    rows: DataFrame
    slices_read: int
    slices: int
    buckets_read: int


def _by_batch(values: dict[int, object]):
    """A column with the value of the row's batch."""
    out = F.lit(0)
    for batch, value in values.items():
        out = F.when(F.col("batch_id") == batch, F.lit(value)).otherwise(out)
    return out.cast(_AMOUNT)


def top_customers(tables: RentalTables, folder: str, k: int = 10, most_candidates: int = MOST_CANDIDATES) -> TopCustomers:
    """The k customers that spent most, ties by key, from the lists rolled up so far."""
    spark = tables.spark
    ranked = _ranked(spark, folder)
    first = max((n for n, anew in ranked if anew), default=None)
    batches = [n for n, _ in ranked if first is None or n >= first]
    # One row per slice of SLICE_ROWS customers.
    bounds = {(r["batch_id"], r["slice"]): (r["highest"], r["lowest"]) for r in _read(spark, folder, BOUNDS, batches).collect()}
    known = tables.customer.select("id_card")
    depth = 1
    while True:
        unread = {b: [v for (batch, s), v in bounds.items() if batch == b and s >= depth] for b in batches}
        most = {b: max([0, *(high for high, _ in rest)]) for b, rest in unread.items()}
        fewest = {b: min([0, *(low for _, low in rest)]) for b, rest in unread.items()}
        above, below = sum(most.values()), sum(fewest.values())
        lists = _read(spark, folder, LISTS, batches).filter(F.col("slice") < depth)
        seen = lists.groupBy("customer").agg(
            F.sum(F.col("spent") - _by_batch(fewest)).alias("low"), F.sum(F.col("spent") - _by_batch(most)).alias("high")
        )
        # Only customers on file count.
        on_file = measured(seen.select("customer", (F.col("low") + F.lit(below)).alias("low"), (F.col("high") + F.lit(above)).alias("high")), keep=True)
        filed = matching_rows(known, "id_card", on_file, "customer").select(F.col("id_card").alias("customer")).distinct()
        seen = stored(on_file.frame.join(filed, "customer", "left_semi"))
        best = seen.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("last"), F.count("*").alias("n")).first()
        rest = any(unread.values())
        if best["n"] == k and (not rest or best["last"] > above):
            candidates = measured(seen.filter(F.col("high") >= F.lit(best["last"])).select("customer"), keep=True)
            if not rest or candidates.frame.count() <= most_candidates:
                break
        elif not rest:
            # Fewer customers with amounts than asked for: those without take part too.
            candidates = None
            break
        depth *= 2
    totals = _read(spark, folder, TOTALS, batches)
    buckets = list(range(BUCKETS))
    if candidates is not None:
        names = candidates.frame.select(F.pmod(F.crc32("customer"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
        buckets = sorted(r["bucket"] for r in names.collect())
        totals = matching_rows(totals.filter(F.col("bucket").isin(buckets)), "customer", candidates, "customer")
    summed = totals.groupBy("customer").agg(
        *[F.sum(c).alias(c) for c in ("booking_rows", "spent", "amounts", "days", "dated")], F.max("last_date").alias("last_date")
    )
    people = tables.customer.select("id_card", "name", "phone_number")
    named = summed.join(people, F.col("customer") == F.col("id_card"))
    rows = top_rows(named, [F.desc("spent"), F.asc("id_card")], k).select(
        F.col("name").alias("Customer_Name"),
        F.col("phone_number").alias("Phone_Number"),
        F.col("booking_rows").alias("Total_Bookings"),
        F.col("spent").alias("Total_Spent"),
        half_up_ratio(F.col("spent"), F.col("amounts"), 2).alias("Average_Booking_Value"),
        F.col("last_date").alias("Last_Booking_Date"),
        half_up_ratio(F.col("days"), F.col("dated"), 1).alias("Avg_Rental_Days"),
    )
    read = sum(1 for _, s in bounds if s < depth)
    return TopCustomers(rows, read, len(bounds), len(buckets))
