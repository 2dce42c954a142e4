"""The rental tables and request batches derived from the bundled star schema.

Every rule keeps all rows of its source table. Links are dropped (set to NULL)
or bent for some keys so that each outer-join branch occurs.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.sources.tables import MONEY, SCHEMAS, RentalTables

# Fixed value: the reference date of every bundled query.
AS_OF = dt.date(2001, 2, 13)

_LONG, _INT, _REAL = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _MOMENT = T.StringType(), T.TimestampNTZType()

# Columns of the star-schema files.
_SOURCE_COLUMNS = {
    "customer": {"c_custkey": _LONG, "c_name": _TEXT, "c_nationkey": _INT, "c_acctbal": _REAL, "c_mktsegment": _TEXT},
    "supplier": {"s_suppkey": _LONG, "s_name": _TEXT, "s_nationkey": _INT, "s_acctbal": _REAL},
    "part": {
        "p_partkey": _LONG,
        "p_name": _TEXT,
        "p_brand": _TEXT,
        "p_type": _TEXT,
        "p_size": _INT,
        "p_retailprice": _REAL,
    },
    "orders": {
        "o_orderkey": _LONG,
        "o_custkey": _LONG,
        "o_orderstatus": _TEXT,
        "o_totalprice": _REAL,
        "o_orderdate": _MOMENT,
        "o_orderpriority": _TEXT,
    },
    "lineitem": {
        "l_orderkey": _LONG,
        "l_partkey": _LONG,
        "l_suppkey": _LONG,
        "l_linenumber": _INT,
        "l_quantity": _REAL,
        "l_extendedprice": _REAL,
        "l_discount": _REAL,
        "l_tax": _REAL,
        "l_returnflag": _TEXT,
        "l_linestatus": _TEXT,
        "l_shipdate": _MOMENT,
    },
    "events": {
        "event_id": _LONG,
        "ts": _MOMENT,
        "user_id": _LONG,
        "event_type": _TEXT,
        "value": _REAL,
        "props": _TEXT,
    },
}


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, t) for c, t in _SOURCE_COLUMNS[name].items()])
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def _padded(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def id_card_of(custkey: Column) -> Column:
    return _padded("", custkey, 16)


def phone_of(custkey: Column) -> Column:
    return _padded("08", custkey, 10)


def licence_of(custkey: Column) -> Column:
    return F.concat(F.lit("DL"), custkey.cast("string"))


@lru_cache(maxsize=4)
def load_tables(spark: SparkSession, folder: str) -> RentalTables:
    """The rental tables over the files in ``folder``, which never change."""
    customer = read_source(spark, folder, "customer")
    supplier = read_source(spark, folder, "supplier")
    part = read_source(spark, folder, "part")
    orders = read_source(spark, folder, "orders")
    lineitem = read_source(spark, folder, "lineitem")
    events = read_source(spark, folder, "events")

    payment_no = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    order_date = F.to_date("o_orderdate")
    start = F.date_add(order_date, (1 + F.col("o_orderkey") % 14).cast("int"))
    # Customers whose key ends in 0 have no bookings; their orders carry no customer.
    known = F.col("o_custkey") % 10 != 0

    classes = part.select("p_type").distinct().union(spark.range(1).select(F.lit("UNUSED")))
    # Whole cents and character codes keep the aggregation buffers fixed-width.
    cents = (F.col("l_extendedprice").cast(MONEY) * 100).cast("long")
    payments = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.char(F.min(F.ascii("l_returnflag"))).alias("payment_method"),
        (F.sum(cents).cast("decimal(16,0)") / 100).cast(MONEY).alias("amount"),
        F.min("l_shipdate").alias("payment_date"),
    )
    # Cars whose key is divisible by 20 pass their rentals to the next car.
    rented = F.when(F.col("l_partkey") % 20 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))

    return RentalTables(
        customer=customer.select(
            id_card_of(F.col("c_custkey")).alias("id_card"),
            licence_of(F.col("c_custkey")).alias("drivers_license"),
            F.col("c_name").alias("name"),
            phone_of(F.col("c_custkey")).alias("phone_number"),
            F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("address"),
        ),
        staff=supplier.select(
            _padded("S", F.col("s_suppkey"), 4).alias("staff_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("Desk "), F.col("s_nationkey").cast("string")).alias("position"),
            _padded("07", F.col("s_suppkey"), 10).alias("contact"),
        ),
        car_class=classes.select(
            F.concat(F.lit("CC-"), "p_type").alias("cc_id"), F.col("p_type").alias("class_name")
        ),
        car=part.select(
            _padded("CAR", F.col("p_partkey"), 8).alias("car_id"),
            F.col("p_name").alias("car_name"),
            F.element_at(
                F.array(F.lit("Manual"), F.lit("Automatic"), F.lit("CVT")), F.col("p_size") % 3 + 1
            ).alias("car_type"),
            F.col("p_retailprice").cast(MONEY).alias("car_price"),
            F.when(F.col("p_size") != 50, F.concat(F.lit("CC-"), "p_type")).alias("car_class_cc_id"),
        ),
        booking=orders.select(
            _padded("BK", F.col("o_orderkey"), 10).alias("booking_id"),
            order_date.alias("date_preserved"),
            start.alias("start_date"),
            F.date_add(start, (1 + F.col("o_orderkey") % 10).cast("int")).alias("end_date"),
            F.when(known, licence_of(F.col("o_custkey"))).alias("customer_drivers_license"),
            F.when(known, id_card_of(F.col("o_custkey"))).alias("customer_id_card"),
            F.when(F.col("o_orderstatus") != "P", _padded("S", F.col("o_orderkey") % 12, 4)).alias("staff_staff_id"),
        ),
        transaction=payments.select(
            _padded("TX", payment_no, 12).alias("transaction_id"),
            "payment_method",
            "amount",
            "payment_date",
            _padded("S", F.col("l_orderkey") % 12, 4).alias("staff_staff_id"),
            F.when(F.col("l_linenumber") < 7, _padded("BK", F.col("l_orderkey"), 10)).alias("booking_booking_id"),
        ),
        car_transaction=lineitem.select(rented.alias("car_no"), payment_no.alias("payment_no"))
        .distinct()
        .select(
            _padded("CAR", F.col("car_no"), 8).alias("car_car_id"),
            _padded("TX", F.col("payment_no"), 12).alias("transaction_transaction_id"),
        ),
        notification=events.select(
            F.col("user_id").cast("string").alias("user_id"),
            F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message"),
            F.when(F.col("event_type") == "error", "danger")
            .when(F.col("event_type").isin("view", "click"), "info")
            .otherwise("success")
            .alias("type"),
            F.lit(None).cast("string").alias("link"),
            F.when(F.col("event_type") == "view", 1).otherwise(0).alias("is_read"),
            F.col("ts").alias("created_at"),
        ),
    )


def customer_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One sign-up per order; identity cards repeat in pairs and phones in threes."""
    key = F.col("o_orderkey")
    return read_source(spark, folder, "orders").select(
        key.alias("arrival"),
        F.when(key % 17 == 0, "0").otherwise(F.concat(F.lit(" Applicant "), key.cast("string"), F.lit("\t"))).alias("full_name"),
        F.when(key % 5 == 0, phone_of(F.col("o_custkey")))
        .when(key % 11 == 0, "12345")
        .otherwise(_padded("09", F.floor(key / 3), 10))
        .alias("phone"),
        F.when(key % 13 == 0, licence_of(F.col("o_custkey")))
        .otherwise(F.concat(F.lit("NL"), key.cast("string")))
        .alias("license_number"),
        F.concat(F.lit("Street "), F.col("o_orderpriority")).alias("address"),
        F.when(key % 7 == 0, F.lpad(F.floor(key / 2).cast("string"), 15, "0"))
        .otherwise(id_card_of(F.floor(key / 2)))
        .alias("id_card"),
    )


def car_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One new car per part; too old, too new, free and unclassed ones occur."""
    key = F.col("p_partkey")
    return read_source(spark, folder, "part").select(
        key.alias("arrival"),
        F.col("p_brand").alias("brand"),
        F.when(key % 23 == 0, "  ").otherwise(F.col("p_name")).alias("model"),
        (1985 + F.col("p_size")).cast("string").alias("year"),
        F.when(key % 17 == 0, "NONE").otherwise(F.concat(F.lit("CC-"), "p_type")).alias("car_class_id"),
        F.element_at(
            F.array(F.lit("Manual"), F.lit("Automatic"), F.lit("CVT")), F.col("p_size") % 3 + 1
        ).alias("car_type"),
        (F.col("p_retailprice").cast(MONEY) - 905).cast("string").alias("daily_rate"),
    )


def booking_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One booking request per order, for few cars; some name a new customer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start = F.date_add(F.lit(AS_OF), (cust % 90 - 2).cast("int"))
    end = F.date_add(start, (key % 5).cast("int"))
    new = key % 6 == 0
    return read_source(spark, folder, "orders").select(
        key.alias("arrival"),
        F.when(key % 29 == 0, "").otherwise(F.concat(F.lit("Guest "), key.cast("string"))).alias("customer_search"),
        F.when(new, "new_customer")
        .when(key % 31 == 0, F.concat(F.lit("missing-"), cust.cast("string")))
        .otherwise(id_card_of(cust))
        .alias("customer_selection"),
        F.when(new & (key % 36 == 0), phone_of(cust)).when(new, _padded("06", key, 10)).alias("customer_phone"),
        F.when(new, _padded("9", F.floor(key / 12), F.when(key % 42 == 0, 14).otherwise(15))).alias("id_card"),
        F.when(new, F.concat(F.lit("RL"), key.cast("string"))).alias("license_number"),
        F.when(new, F.concat(F.lit("Road "), F.col("o_orderpriority"))).alias("address"),
        _padded("CAR", key % 50, 8).alias("car_id"),
        F.when(key % 37 == 0, "soon").otherwise(start.cast("string")).alias("start_date"),
        end.cast("string").alias("end_date"),
    )


def customer_changes(spark: SparkSession, folder: str) -> DataFrame:
    """One edit per order, many per customer; some deletes and unknown customers."""
    key = F.col("o_orderkey")
    return read_source(spark, folder, "orders").select(
        key.alias("arrival"),
        F.when(key % 23 == 0, "delete").when(key % 41 == 0, "view").otherwise("update").alias("action"),
        id_card_of(F.col("o_custkey") + 40).alias("id_card"),
        F.concat(F.lit("Renamed "), key.cast("string")).alias("name"),
        _padded("05", key, 10).alias("phone_number"),
        F.col("o_orderpriority").alias("address"),
        F.concat(F.lit("CL"), key.cast("string")).alias("drivers_license"),
    )


def staff_changes(spark: SparkSession, folder: str) -> DataFrame:
    """One edit per customer row, spread over a few staff members."""
    key = F.col("c_custkey")
    return read_source(spark, folder, "customer").select(
        key.alias("arrival"),
        F.when(key % 31 == 0, "delete").otherwise("update").alias("action"),
        _padded("S", key % 120, 4).alias("staff_id"),
        F.concat(F.lit("Agent "), key.cast("string")).alias("name"),
        F.col("c_mktsegment").alias("position"),
        _padded("04", key, 10).alias("contact"),
    )


def edit_failures(spark: SparkSession, folder: str) -> DataFrame:
    """One failed staff edit per error event."""
    return (
        read_source(spark, folder, "events")
        .filter(F.col("event_type") == "error")
        .select(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"))
    )


__all__ = ["AS_OF", "SCHEMAS", "load_tables"]
