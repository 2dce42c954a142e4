"""Reports per calendar month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe.functions import (
    full_month_name,
    half_up_ratio,
    months_before,
    percent_of,
    rental_days,
    short_month_label,
)
from fleetframe.plans.rollups import payments_per_booking
from fleetframe.sources.tables import RentalTables


def _per_month(rows: DataFrame, moment: str, as_of: dt.date, months: int, **measures: Column) -> DataFrame:
    """Group the trailing window by month. Future months count; empty months are absent."""
    return (
        rows.filter(F.col(moment) >= months_before(as_of, months))
        .groupBy(F.year(moment).alias("year"), F.month(moment).alias("month"))
        .agg(*[measure.alias(name) for name, measure in measures.items()])
        .withColumn("month_name", full_month_name(F.col("year"), F.col("month")))
    )


def monthly_bookings(tables: RentalTables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Bookings per month of reservation, oldest month first."""
    monthly = _per_month(tables.booking, "date_preserved", as_of, months, booking_count=F.count("*"))
    return monthly.select("year", "month", "month_name", "booking_count").orderBy("year", "month")


def revenue_growth(tables: RentalTables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Revenue and payments per month, oldest month first."""
    monthly = _per_month(
        tables.transaction,
        "payment_date",
        as_of,
        months,
        monthly_revenue=F.sum("amount"),
        transaction_count=F.count("*"),
    )
    return monthly.select(
        "year", "month", "month_name", "monthly_revenue", "transaction_count"
    ).orderBy("year", "month")


def monthly_revenue_report(tables: RentalTables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Payments, revenue and mean payment per month, oldest month first."""
    monthly = _per_month(
        tables.transaction,
        "payment_date",
        as_of,
        months,
        total=F.count("transaction_id"),
        revenue=F.sum("amount"),
        amounts=F.count("amount"),
    )
    return monthly.select(
        F.col("year").alias("Year"),
        F.col("month").alias("Month"),
        F.col("month_name").alias("Month_Name"),
        F.col("total").alias("Total_Transactions"),
        F.col("revenue").alias("Monthly_Revenue"),
        half_up_ratio(F.col("revenue"), F.col("amounts"), 2).alias("Average_Transaction"),
    ).orderBy("Year", "Month")


def monthly_revenue_recent(tables: RentalTables, as_of: dt.date, months: int = 6) -> DataFrame:
    """Payments and revenue per month, newest month first."""
    monthly = _per_month(
        tables.transaction, "payment_date", as_of, months, total=F.count("*"), revenue=F.sum("amount")
    )
    return monthly.select(
        F.col("year").alias("Year"),
        F.col("month").alias("Month"),
        F.col("month_name").alias("Month_Name"),
        F.col("total").alias("Total_Transactions"),
        F.col("revenue").alias("Total_Revenue"),
    ).orderBy(F.desc("Year"), F.desc("Month"))


def seasonal_patterns(tables: RentalTables, as_of: dt.date, months: int = 6) -> DataFrame:
    """Paid bookings per month of rental start, newest month first.

    Every payment of a booking counts, so the payment rollup carries its row
    count as a weight. The share of the total is a window over the months.
    """
    booking = tables.booking.select("booking_id", "start_date", "end_date", "customer_id_card")
    paid = booking.join(
        payments_per_booking(tables), F.col("booking_id") == F.col("paid_booking_id")
    )
    days = rental_days(F.col("start_date"), F.col("end_date"))
    monthly = _per_month(
        paid,
        "start_date",
        as_of,
        months,
        total=F.sum("payments"),
        revenue=F.sum("paid"),
        amounts=F.sum("amounts"),
        customers=F.countDistinct("customer_id_card"),
        days=F.sum(days * F.col("payments")),
        dated=F.sum(F.when(days.isNotNull(), F.col("payments"))),
    )
    all_months = F.sum("total").over(Window.partitionBy())
    return monthly.select(
        F.col("year").alias("Booking_Year"),
        F.col("month").alias("Booking_Month"),
        F.col("month_name").alias("Month_Name"),
        F.col("total").alias("Total_Bookings"),
        F.col("revenue").alias("Monthly_Revenue"),
        half_up_ratio(F.col("revenue"), F.col("amounts"), 2).alias("Average_Booking_Value"),
        F.col("customers").alias("Unique_Customers"),
        half_up_ratio(F.col("days"), F.col("dated"), 1).alias("Average_Rental_Days"),
        percent_of(F.col("total"), all_months).alias("Booking_Percentage"),
    ).orderBy(F.desc("Booking_Year"), F.desc("Booking_Month"))


def monthly_bookings_chart(tables: RentalTables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Chart series of ``monthly_bookings``: three-letter label and count."""
    return monthly_bookings(tables, as_of, months).select(
        "year", "month", short_month_label(F.col("month_name")).alias("label"), "booking_count"
    )


def revenue_growth_chart(tables: RentalTables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Chart series of ``revenue_growth``: three-letter label and amount."""
    return revenue_growth(tables, as_of, months).select(
        "year",
        "month",
        short_month_label(F.col("month_name")).alias("label"),
        F.col("monthly_revenue").cast("double").alias("monthly_revenue"),
    )


def monthly_revenue_chart(tables: RentalTables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Chart series of ``monthly_revenue_report`` with labels such as "March 2001"."""
    return monthly_revenue_report(tables, as_of, months).select(
        F.concat_ws(" ", "Month_Name", F.col("Year").cast("string")).alias("label"),
        "Monthly_Revenue",
        "Total_Transactions",
    )
