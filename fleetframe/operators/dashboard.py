"""Dashboard views. Their column names are given; the formulas are our own
reconstruction, as the definitions are not published."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from fleetframe.functions import percent_of
from fleetframe.operators.bookings import booking_list
from fleetframe.operators.payments import today_stats
from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.plans.paging import top_rows
from fleetframe.sources.tables import RentalTables


def dashboard_stats(tables: RentalTables, as_of: dt.date) -> DataFrame:
    """One row: payments of the day, cars out on rental, fleet and customer size.

    A car is out when a booking that runs on the day has a payment for it.
    """
    today = F.lit(as_of)
    is_running = (F.col("start_date") <= today) & (F.col("end_date") >= today)
    running = measured(tables.booking.filter(is_running).select("booking_id"))
    paid = measured(
        matching_rows(tables.transaction, "booking_booking_id", running, "booking_id").select(
            "transaction_id"
        )
    )
    out = matching_rows(
        tables.car_transaction, "transaction_transaction_id", paid, "transaction_id"
    )
    active = out.agg(F.countDistinct("car_car_id")).scalar()
    cars = tables.car.agg(F.count("*")).scalar()
    customers = tables.customer.agg(F.count("*")).scalar()
    counted = today_stats(tables, as_of).select(
        F.col("Today_Revenue").alias("today_revenue"),
        F.col("Today_Transactions").alias("today_transactions"),
        active.alias("active_rentals"),
        cars.alias("total_cars"),
        customers.alias("total_customers"),
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


def recent_bookings_dashboard(tables: RentalTables, as_of: dt.date, k: int = 4) -> DataFrame:
    """The newest booking rows in short form."""
    return booking_list(tables, as_of, k).select(
        "Booking_ID",
        F.col("Customer_Name").alias("customer_name"),
        F.col("Customer_Phone").alias("customer_phone"),
        F.col("Cars_Rented").alias("car_name"),
        F.col("Rental_Days").alias("duration_days"),
        F.col("Booking_Status").alias("status"),
        F.col("Total_Amount").alias("total_amount"),
    )


def activity_timeline(tables: RentalTables, k: int = 5) -> DataFrame:
    """The newest bookings and payments. Cars and customers carry no time, so
    they cannot appear. Each table is cut to its own newest k rows first."""
    newest = [F.desc("activity_time"), F.asc("activity_type"), F.asc("activity_message")]
    bookings = tables.booking.select(
        F.lit("booking_created").alias("activity_type"),
        F.lit("success").alias("activity_status"),
        F.concat(F.lit("Booking "), "booking_id", F.lit(" created")).alias("activity_message"),
        F.col("date_preserved").cast("timestamp_ntz").alias("activity_time"),
    )
    payments = tables.transaction.select(
        F.lit("payment_received").alias("activity_type"),
        F.lit("info").alias("activity_status"),
        F.concat(F.lit("Payment "), "transaction_id", F.lit(" received")).alias("activity_message"),
        F.col("payment_date").alias("activity_time"),
    )
    both = top_rows(bookings, newest, k).unionByName(top_rows(payments, newest, k))
    return top_rows(both, newest, k)


def activity_cards(tables: RentalTables, k: int = 5) -> DataFrame:
    """``activity_timeline`` with the time as shown on screen."""
    return activity_timeline(tables, k).withColumn(
        "activity_time", F.date_format("activity_time", "MMM dd, HH:mm")
    )
