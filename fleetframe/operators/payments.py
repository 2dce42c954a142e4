"""Payment lists and payment-method analysis."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe import fixed
from fleetframe.functions import half_up_ratio, or_default, percent_of, rupiah, same_day
from fleetframe.plans.collations import under
from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.plans.paging import top_rows
from fleetframe.sources.tables import RentalTables


def recent_transactions(tables: RentalTables, k: int = 50) -> DataFrame:
    """Latest payments with the booking's customer and the payment's staff member.

    All three joins look up keys, so each payment stays one row and the top k
    can be cut first. The k rows then go to the large tables, not the reverse.
    """
    order = [F.desc("payment_date"), F.asc("transaction_id")]
    latest = measured(top_rows(tables.transaction, order, k))
    booking = measured(
        matching_rows(
            tables.booking.select("booking_id", "customer_id_card"),
            "booking_id",
            latest,
            "booking_booking_id",
        )
    )
    customer = matching_rows(
        tables.customer.select("id_card", F.col("name").alias("customer_name")),
        "id_card",
        booking,
        "customer_id_card",
    )
    staff = matching_rows(
        tables.staff.select("staff_id", F.col("name").alias("staff_name")),
        "staff_id",
        latest,
        "staff_staff_id",
    )
    joined = (
        latest.frame.join(booking.frame, F.col("booking_booking_id") == F.col("booking_id"), "left")
        .join(customer, F.col("customer_id_card") == F.col("id_card"), "left")
        .join(staff, F.col("staff_staff_id") == F.col("staff_id"), "left")
    )
    return joined.orderBy(*order).select(
        F.col("transaction_id").alias("Transaction_ID"),
        F.col("payment_method").alias("Payment_Method"),
        F.col("amount").alias("Amount"),
        F.col("payment_date").alias("Payment_Date"),
        F.col("staff_staff_id").alias("Staff_Staff_ID"),
        F.col("booking_booking_id").alias("Booking_Booking_ID"),
        F.col("customer_name").alias("Customer_Name"),
        F.col("staff_name").alias("Staff_Name"),
    )


def transaction_cards(tables: RentalTables, k: int = 50) -> DataFrame:
    """``recent_transactions`` as shown on screen: amounts, dates and fallbacks as text."""
    return recent_transactions(tables, k).select(
        "Transaction_ID",
        or_default(F.col("Customer_Name"), fixed.NOT_AVAILABLE).alias("Customer"),
        or_default(F.col("Staff_Name"), F.col("Staff_Staff_ID")).alias("Staff"),
        "Payment_Method",
        rupiah(F.col("Amount")).alias("Amount"),
        F.date_format("Payment_Date", "yyyy-MM-dd HH:mm").alias("Paid_At"),
    )


def payment_method_analysis(tables: RentalTables, collation: str | None = None) -> DataFrame:
    """Per method: payments that have a booking, with shares of all payments.

    Methods are told apart by their bytes, or under a collation, where the smallest spelling by bytes is shown.

    One pass over the payments gives numerators and denominators: every payment
    is kept with a marker telling whether its booking exists, the measures count
    the marked ones, and the totals are windows over the few method rows. Both
    tables are shuffled once, on the booking; payments that pile up on one
    booking, or on none, are split over tasks by the adaptive skew join, and
    are reduced to methods and customers before the next shuffle.
    """
    payment = tables.transaction.select("booking_booking_id", "payment_method", "amount")
    booking = tables.booking.select("booking_id", "customer_id_card")
    joined = payment.join(booking, F.col("booking_booking_id") == F.col("booking_id"), "left")
    booked = F.col("booking_id").isNotNull()
    amount = F.when(booked, F.col("amount"))
    per_method = joined.groupBy(under(F.col("payment_method"), collation).alias("method")).agg(
        F.min("payment_method").alias("payment_method"),
        F.count("*").alias("every_payment"),
        F.sum("amount").alias("every_paid"),
        F.count("booking_id").alias("payments"),
        F.count(amount).alias("amounts"),
        F.sum(amount).alias("paid"),
        F.min(amount).alias("lowest"),
        F.max(amount).alias("highest"),
        F.countDistinct("customer_id_card").alias("customers"),
    )
    every = Window.partitionBy()
    return (
        per_method.withColumn("all_payments", F.sum("every_payment").over(every))
        .withColumn("all_paid", F.sum("every_paid").over(every))
        .filter(F.col("payments") > 0)
        .select(
            F.col("payment_method").alias("Payment_Method"),
            F.col("payments").alias("Transaction_Count"),
            F.col("paid").alias("Total_Revenue"),
            half_up_ratio(F.col("paid"), F.col("amounts"), 2).alias("Average_Transaction_Value"),
            F.col("lowest").alias("Minimum_Transaction"),
            F.col("highest").alias("Maximum_Transaction"),
            percent_of(F.col("payments"), F.col("all_payments")).alias("Usage_Percentage"),
            percent_of(F.col("paid"), F.col("all_paid")).alias("Revenue_Percentage"),
            F.col("customers").alias("Unique_Customers"),
        )
        .orderBy(F.desc("Total_Revenue"), F.asc("Payment_Method"))
    )


def today_stats(tables: RentalTables, as_of: dt.date) -> DataFrame:
    """One row: payments, revenue and mean payment of the day, 0 if none."""
    today = tables.transaction.filter(same_day(F.col("payment_date"), as_of))
    zero = F.lit(0)
    return today.agg(
        F.count("*").alias("Today_Transactions"),
        F.coalesce(F.sum("amount"), zero).alias("Today_Revenue"),
        F.coalesce(half_up_ratio(F.sum("amount"), F.count("amount"), 6), zero).alias("Today_Average"),
    )


def summary_stats(tables: RentalTables, as_of: dt.date) -> DataFrame:
    """One row: table sizes, revenue, and payments of the day (NULL revenue if none).

    The payment figures share one scan; the table sizes are scalar subqueries.
    """
    today = same_day(F.col("payment_date"), as_of)

    def rows(table: DataFrame) -> Column:
        return table.agg(F.count("*")).scalar()

    return tables.transaction.agg(
        F.sum("amount").alias("Total_Revenue"),
        F.count(F.when(today, 1)).alias("Today_Transactions"),
        F.sum(F.when(today, F.col("amount"))).alias("Today_Revenue"),
    ).select(
        rows(tables.customer).alias("Total_Customers"),
        rows(tables.car).alias("Total_Cars"),
        rows(tables.booking).alias("Total_Bookings"),
        "Total_Revenue",
        "Today_Transactions",
        "Today_Revenue",
    )
