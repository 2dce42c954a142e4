"""Customer rankings, the staff list and the paged customer list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe.functions import customer_tier, half_up_ratio, rental_days, truncate_text
from fleetframe.plans.paging import page_rows, top_rows
from fleetframe.plans.rollups import payments_per_booking
from fleetframe.sources.tables import RentalTables

CUSTOMER_COLUMNS = ["id_card", "name", "phone_number", "address", "drivers_license"]


def per_customer(bookings: DataFrame, weight: Column) -> DataFrame:
    """Booking rows with payment rollup, summed per customer.

    ``weight`` is how many rows the booking has after joining its payments.
    """
    days = rental_days(F.col("start_date"), F.col("end_date"))
    return (
        bookings.filter(F.col("customer_id_card").isNotNull())
        .groupBy(F.col("customer_id_card").alias("booking_customer"))
        .agg(
            F.sum(weight).alias("booking_rows"),
            F.sum("paid").alias("spent"),
            F.sum("amounts").alias("amounts"),
            F.max("date_preserved").alias("last_date"),
            F.sum(days * weight).alias("days"),
            F.sum(F.when(days.isNotNull(), weight)).alias("dated"),
        )
    )


def _booking_dates(tables: RentalTables) -> DataFrame:
    return tables.booking.select(
        "booking_id", "customer_id_card", "date_preserved", "start_date", "end_date"
    )


def _named(tables: RentalTables, totals: DataFrame) -> DataFrame:
    names = tables.customer.select("id_card", "name", "phone_number")
    return totals.join(names, F.col("booking_customer") == F.col("id_card"))


def top_customers(tables: RentalTables, k: int | None = 10) -> DataFrame:
    """Customers by amount spent; each payment of a booking counts as a booking."""
    paid = _booking_dates(tables).join(
        payments_per_booking(tables), F.col("booking_id") == F.col("paid_booking_id")
    )
    ranked = top_rows(
        _named(tables, per_customer(paid, F.col("payments"))), [F.desc("spent"), F.asc("id_card")], k
    )
    return ranked.select(
        F.col("name").alias("Customer_Name"),
        F.col("phone_number").alias("Phone_Number"),
        F.col("booking_rows").alias("Total_Bookings"),
        F.col("spent").alias("Total_Spent"),
        half_up_ratio(F.col("spent"), F.col("amounts"), 2).alias("Average_Booking_Value"),
        F.col("last_date").alias("Last_Booking_Date"),
        half_up_ratio(F.col("days"), F.col("dated"), 1).alias("Avg_Rental_Days"),
    )


def customer_history(tables: RentalTables, k: int | None = 10) -> DataFrame:
    """Customers by booking rows, with tier; customers without bookings are left out."""
    bookings = _booking_dates(tables).join(
        payments_per_booking(tables), F.col("booking_id") == F.col("paid_booking_id"), "left"
    )
    weight = F.coalesce(F.col("payments"), F.lit(1))
    ranked = top_rows(
        _named(tables, per_customer(bookings, weight)),
        [F.desc("booking_rows"), F.asc("id_card")],
        k,
    )
    return ranked.select(
        F.col("name").alias("Customer_Name"),
        F.col("phone_number").alias("Phone_Number"),
        F.col("booking_rows").alias("Total_Bookings"),
        F.col("spent").alias("Total_Spent"),
        F.col("last_date").alias("Last_Booking_Date"),
        F.try_divide(F.col("days").cast("double"), F.col("dated").cast("double")).alias("Avg_Rental_Days"),
        customer_tier(F.col("booking_rows")).alias("Customer_Type"),
    )


def staff_list(tables: RentalTables) -> DataFrame:
    return tables.staff.select(
        F.col("staff_id").alias("Staff_ID"),
        F.col("name").alias("Name"),
        F.col("contact").alias("Contact"),
        F.col("position").alias("Position"),
    ).orderBy("Name", "Staff_ID")


def customer_columns(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("id_card").alias("ID_Card"),
        F.col("name").alias("Name"),
        F.col("phone_number").alias("Phone_Number"),
        F.col("address").alias("Address"),
        F.col("drivers_license").alias("Drivers_License"),
    )


def customer_page(tables: RentalTables, page: int = 1, per_page: int = 100) -> DataFrame:
    """One page of customers by name; a page past the end gives the last page.

    The row count is read first, as it decides which page is cut.
    """
    total_pages = -(-tables.customer.count() // per_page)
    return page_rows(
        customer_columns(tables.customer),
        [F.asc("Name"), F.asc("ID_Card")],
        max(1, min(total_pages, page)),
        per_page,
        ["Name", "ID_Card"],
    )


def customer_page_meta(tables: RentalTables, page: int = 1, per_page: int = 100) -> DataFrame:
    """Totals and the shown record range of ``customer_page``; one row."""
    size = F.lit(per_page).cast("long")
    counted = tables.customer.agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / size).cast("long")
    )
    clamped = F.greatest(F.lit(1).cast("long"), F.least("total_pages", F.lit(page).cast("long")))
    offset = (F.col("page") - 1) * size
    return counted.withColumn("page", clamped).select(
        "total",
        "total_pages",
        "page",
        (offset + 1).alias("start_record"),
        F.least(offset + size, F.col("total")).alias("end_record"),
    )


def customer_cards(tables: RentalTables, page: int = 1, per_page: int = 100, limit: int = 30) -> DataFrame:
    """``customer_page`` as shown on screen: long addresses cut with dots."""
    return customer_page(tables, page, per_page).withColumn(
        "Address", truncate_text(F.col("Address"), limit)
    )


def customer_tiers(tables: RentalTables) -> DataFrame:
    """``customer_history`` for every customer with bookings, unranked and uncut."""
    return customer_history(tables, k=None)
