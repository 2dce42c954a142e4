"""Partial rollups that shrink the fact tables before they are joined.

A join with payments repeats each booking once per payment, and a join with
the car bridge repeats each payment once per car. The reports count those
repeated rows. Rolling the many side up to one row per key first, with the row
count kept as a weight, gives the same sums from far fewer joined rows, and a
key that holds a large part of the table is already reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetframe.sources.tables import RentalTables


def payments_per_booking(tables: RentalTables) -> DataFrame:
    """One row per booking that has payments: payment count, amounts counted, amount."""
    return (
        tables.transaction.filter(F.col("booking_booking_id").isNotNull())
        .groupBy(F.col("booking_booking_id").alias("paid_booking_id"))
        .agg(
            F.count("*").alias("payments"),
            F.count("amount").alias("amounts"),
            F.sum("amount").alias("paid"),
        )
    )


def rentals_per_car(tables: RentalTables) -> DataFrame:
    """One row per rented car: rentals, bridge rows (also those without a payment
    id), amounts counted, revenue.

    A payment that covers several cars counts in full for each of them.
    """
    payment = tables.transaction.select("transaction_id", "amount")
    return (
        tables.car_transaction.join(
            payment, F.col("transaction_transaction_id") == F.col("transaction_id"), "left"
        )
        .groupBy(F.col("car_car_id").alias("rented_car_id"))
        .agg(
            F.count("transaction_transaction_id").alias("rentals"),
            F.count("*").alias("bridge_rows"),
            F.count("amount").alias("amounts"),
            F.sum("amount").alias("revenue"),
        )
    )


def rental_counts_per_car(tables: RentalTables) -> DataFrame:
    """As ``rentals_per_car`` where no amounts are needed; reads the bridge only."""
    return tables.car_transaction.groupBy(F.col("car_car_id").alias("rented_car_id")).agg(
        F.count("*").alias("rentals")
    )
