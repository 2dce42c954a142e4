"""Booking detail lists, booking search and booking counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe import fixed
from fleetframe.functions import (
    booking_status,
    half_up_ratio,
    literal_runs,
    or_default,
    rental_days,
    rupiah,
    same_day,
    wildcard_match,
)
from fleetframe.plans.lookups import Measured, matching_rows, measured
from fleetframe.plans.paging import is_deep, page_keys, page_rows, top_rows, with_page_keys
from fleetframe.sources.sinks import json_answer
from fleetframe.sources.tables import RentalTables

_BOOKING = ["booking_id", "date_preserved", "start_date", "end_date", "customer_id_card", "staff_staff_id"]
_PAYMENT = ["amount", "payment_method"]


def newest_first() -> list[Column]:
    """Newest reservation first. The later keys only break ties, so that a page
    is the same on every run."""
    return [
        F.desc("Date_Preserved"),
        F.asc("Booking_ID"),
        F.asc("Total_Amount"),
        F.asc("Payment_Method"),
    ]


def _newest_bookings() -> list[Column]:
    return [F.desc("date_preserved"), F.asc("booking_id")]


def _is_today(as_of: dt.date) -> Column:
    start, end, today = F.col("start_date"), F.col("end_date"), F.lit(as_of)
    return same_day(start, as_of) | same_day(end, as_of) | ((start <= today) & (end >= today))


def _paid(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Bookings with each of their payments, or with none.

    An inner join and the bookings without a match: adaptive execution splits a booking with very
    many payments in an inner join, but not on the right side of an outer one.
    """
    payment = payments.select("transaction_id", "booking_booking_id", *_PAYMENT)
    same = F.col("booking_id") == F.col("booking_booking_id")
    with_payment = bookings.join(payment, same).drop("booking_booking_id")
    without = bookings.join(payment.select("booking_booking_id"), same, "left_anti")
    return with_payment.unionByName(without, allowMissingColumns=True)


def _details(
    bookings: DataFrame,
    payments: DataFrame,
    rentals: DataFrame,
    label: str,
    repeat: bool,
    keep: Column | None = None,
) -> DataFrame:
    """Bookings per (booking, amount, method) with the list of their cars.

    Two different payments of a booking give two rows, two equal ones give one.
    ``rentals`` holds (rental_payment, car columns). Cars are counted per payment
    before they meet the payments, and per group before the lists are built, each
    time partly on the map side; with ``repeat`` a label is listed once per
    occurrence, else once. ``keep`` filters the joined rows before they are grouped.
    """
    columns = [c for c in rentals.columns if c != "rental_payment"]
    counted = (
        rentals.filter(F.col("rental_payment").isNotNull())
        .groupBy("rental_payment", *columns)
        .agg(F.count("*").alias("times"))
    )
    paid = _paid(bookings, payments)
    same = F.col("transaction_id") == F.col("rental_payment")
    with_car = paid.join(counted, same).drop("rental_payment")
    without = paid.join(counted.select("rental_payment"), same, "left_anti").withColumn("times", F.lit(1).cast("long"))
    rows = with_car.unionByName(without, allowMissingColumns=True)
    if keep is not None:
        rows = rows.filter(keep)
    group = [*_BOOKING, *_PAYMENT]
    labelled = rows.groupBy(*group, F.col(label).alias("label")).agg(F.sum("times").alias("times"))
    entry = "label"
    if repeat:
        entry = "concat(repeat(concat(label, ', '), cast(times - 1 as int)), label)"
    listed = F.expr(f"listagg({entry}, ', ') within group (order by label)")
    return labelled.groupBy(*group).agg(listed.alias("cars"))


def _with_people(details: DataFrame, customer: DataFrame, staff: DataFrame) -> DataFrame:
    customers = customer.select(
        "id_card", F.col("name").alias("customer_name"), F.col("phone_number").alias("customer_phone")
    )
    members = staff.select(
        "staff_id", F.col("name").alias("staff_name"), F.col("position").alias("staff_position")
    )
    return details.join(customers, F.col("customer_id_card") == F.col("id_card"), "left").join(
        members, F.col("staff_staff_id") == F.col("staff_id"), "left"
    )


def _detail_columns(details: DataFrame, as_of: dt.date, cars: str, position: bool = False) -> DataFrame:
    start, end = F.col("start_date"), F.col("end_date")
    return details.select(
        F.col("booking_id").alias("Booking_ID"),
        F.col("date_preserved").alias("Date_Preserved"),
        start.alias("Start_Date"),
        end.alias("End_Date"),
        rental_days(start, end).alias("Rental_Days"),
        F.col("customer_name").alias("Customer_Name"),
        F.col("customer_phone").alias("Customer_Phone"),
        F.col("staff_name").alias("Staff_Name"),
        *([F.col("staff_position").alias("Staff_Position")] if position else []),
        F.col("cars").alias(cars),
        F.col("amount").alias("Total_Amount"),
        F.col("payment_method").alias("Payment_Method"),
        booking_status(start, end, as_of).alias("Booking_Status"),
    )


def _rentals_of(bridge: DataFrame, car: DataFrame, *labels: Column) -> DataFrame:
    """Bridge rows with car labels, keyed by payment."""
    cars = car.select("car_id", *labels)
    return bridge.join(cars, F.col("car_car_id") == F.col("car_id"), "left").withColumnRenamed(
        "transaction_transaction_id", "rental_payment"
    ).drop("car_car_id", "car_id")


def today_bookings(tables: RentalTables, as_of: dt.date) -> DataFrame:
    """Bookings that start, end or run on the day, with every car listed as "name (type)"."""
    bookings = measured(tables.booking.select(*_BOOKING).filter(_is_today(as_of)))
    nearby = _tables_around(tables, bookings)
    label = F.concat("car_name", F.lit(" ("), "car_type", F.lit(")")).alias("car_label")
    details = _details(
        bookings.frame,
        nearby.transaction,
        _rentals_of(nearby.car_transaction, tables.car, label),
        "car_label",
        repeat=True,
    )
    shown = _detail_columns(
        _with_people(details, nearby.customer, nearby.staff), as_of, "Rented_Cars", position=True
    )
    return shown.orderBy(F.desc("Start_Date"), "Booking_ID", "Total_Amount", "Payment_Method")


def _tables_around(tables: RentalTables, bookings: Measured) -> RentalTables:
    """The tables cut down to what the ``bookings`` refer to.

    Few bookings are sent to the scans of the large tables, and so are their
    payments if those are few as well. With many bookings nothing is cut.
    """
    if not bookings.fits_broadcast("booking_id", "customer_id_card", "staff_staff_id"):
        return tables
    payments = measured(
        matching_rows(
            tables.transaction.select("transaction_id", "booking_booking_id", *_PAYMENT),
            "booking_booking_id",
            bookings,
            "booking_id",
        )
    )
    return tables.with_tables(
        transaction=payments.frame,
        car_transaction=matching_rows(
            tables.car_transaction, "transaction_transaction_id", payments, "transaction_id"
        ),
        customer=matching_rows(tables.customer, "id_card", bookings, "customer_id_card"),
        staff=matching_rows(tables.staff, "staff_id", bookings, "staff_staff_id"),
    )


def _details_with_car_names(
    tables: RentalTables, bookings: DataFrame, as_of: dt.date, keep: Column | None, *labels: Column
) -> DataFrame:
    rentals = _rentals_of(tables.car_transaction, tables.car, *labels)
    details = _details(bookings, tables.transaction, rentals, "car_name", False, keep)
    return _detail_columns(
        _with_people(details, tables.customer, tables.staff), as_of, "Cars_Rented"
    )


def booking_list(tables: RentalTables, as_of: dt.date, k: int = 50) -> DataFrame:
    """The k newest detail rows, with distinct car names.

    Every booking has at least one detail row and the rows are ordered by
    booking first, so the k newest bookings contain all of them.
    """
    newest = measured(top_rows(tables.booking.select(*_BOOKING), _newest_bookings(), k))
    nearby = _tables_around(tables, newest)
    details = _details_with_car_names(nearby, newest.frame, as_of, None, F.col("car_name"))
    return top_rows(details, newest_first(), k)


def booking_cards(tables: RentalTables, as_of: dt.date, k: int = 50) -> DataFrame:
    """``booking_list`` as shown on screen: amounts, dates and fallbacks as text."""
    return booking_list(tables, as_of, k).select(
        "Booking_ID",
        or_default(F.col("Customer_Name"), fixed.UNKNOWN).alias("Customer"),
        or_default(F.col("Customer_Phone"), fixed.NOT_AVAILABLE).alias("Phone"),
        or_default(F.col("Cars_Rented"), fixed.NO_CARS, falsy=True).alias("Cars"),
        F.date_format("Start_Date", "MMM dd").alias("From"),
        F.date_format("End_Date", "MMM dd, yyyy").alias("To"),
        rupiah(F.col("Total_Amount")).alias("Amount"),
        "Booking_Status",
    )


def booking_stats(tables: RentalTables, as_of: dt.date) -> DataFrame:
    """One row of counts by date, and the mean rental length to one decimal."""
    start, end, today = F.col("start_date"), F.col("end_date"), F.lit(as_of)
    days = rental_days(start, end)
    return tables.booking.agg(
        F.count(F.when(_is_today(as_of), 1)).alias("Today_Bookings"),
        F.count(F.when((start <= today) & (end >= today), 1)).alias("Active_Bookings"),
        F.count(F.when(start > today, 1)).alias("Upcoming_Bookings"),
        F.count(F.when(end < today, 1)).alias("Completed_Bookings"),
        half_up_ratio(F.sum(days), F.count(days), 1).alias("Avg_Rental_Duration"),
    )


def _matching_bookings(tables: RentalTables, query: str) -> DataFrame:
    """Bookings with any matching joined row; ``_self`` tells that the booking's
    own id, customer or staff member matches, not just one of its cars.

    Each column is searched in its own table, and only the keys of hits are
    joined, so no table is joined whole and each is read once.
    """
    booking = tables.booking.select(*_BOOKING)
    if query == "":
        return booking.withColumn("_self", F.lit(True))
    runs = literal_runs(query)
    customers = measured(
        tables.narrowed("customer", runs).filter(wildcard_match(query, F.col("name"), F.col("phone_number"))).select(
            F.col("id_card").alias("_customer")
        )
    )
    members = tables.narrowed("staff", runs).filter(wildcard_match(query, F.col("name"))).select(
        F.col("staff_id").alias("_member")
    )
    cars = measured(tables.narrowed("car", runs).filter(wildcard_match(query, F.col("car_name"))).select("car_id"))
    rentals = measured(
        matching_rows(tables.car_transaction, "car_car_id", cars, "car_id").select(
            "transaction_transaction_id"
        )
    )
    payments = matching_rows(
        tables.transaction, "transaction_id", rentals, "transaction_transaction_id"
    )
    by_car = measured(payments.select(F.col("booking_booking_id").alias("_by_car")).distinct())
    own = (
        F.col("_customer").isNotNull()
        | F.col("_member").isNotNull()
        | wildcard_match(query, F.col("booking_id"))
    )
    return (
        booking.join(customers.hinted(), F.col("customer_id_card") == F.col("_customer"), "left")
        .join(members, F.col("staff_staff_id") == F.col("_member"), "left")
        .join(by_car.hinted(), F.col("booking_id") == F.col("_by_car"), "left")
        .withColumn("_self", own)
        .filter(F.col("_self") | F.col("_by_car").isNotNull())
        .select(*_BOOKING, "_self")
    )


def search_bookings(
    tables: RentalTables, query: str, as_of: dt.date, page: int = 1, per_page: int = 100
) -> DataFrame:
    """One page of the detail rows that match, newest first.

    Rows are filtered before they are grouped: a booking found by a car name
    only lists the matching cars. A page past the end is empty.
    """
    return _search_page(tables, query, _matching_bookings(tables, query), as_of, page, per_page)


def _search_page(
    tables: RentalTables, query: str, matches: DataFrame, as_of: dt.date, page: int, per_page: int
) -> DataFrame:
    car_hit = wildcard_match(query, F.col("car_name")).alias("_car_hit")
    # A booking that matches by itself keeps all its rows.
    keep = F.col("_self") | F.coalesce(F.col("_car_hit"), F.lit(False))

    def details(few: Measured) -> DataFrame:
        nearby = _tables_around(tables, few)
        return _details_with_car_names(nearby, few.frame, as_of, keep, F.col("car_name"), car_hit)

    keys = ["Date_Preserved", "Booking_ID", "Total_Amount", "Payment_Method"]
    if not is_deep(page, per_page):
        newest = measured(top_rows(matches, _newest_bookings(), max(page, 1) * per_page))
        return page_rows(details(newest), newest_first(), page, per_page, keys)
    # Only keys are sorted; the details are built for the bookings of the page.
    wanted = page_keys(_detail_keys(tables, query, matches).toDF(*keys), newest_first(), page, per_page)
    wanted = measured(wanted).hinted()
    on_page = wanted.select(F.col("Booking_ID").alias("_wanted")).distinct()
    few = measured(matches.join(F.broadcast(on_page), F.col("booking_id") == F.col("_wanted"), "left_semi"))
    return with_page_keys(details(few), wanted, keys).orderBy("position").drop("position")


def _detail_keys(tables: RentalTables, query: str, matches: DataFrame) -> DataFrame:
    """(date, booking, amount, method) of the detail rows that match, without their lists."""
    keys = ["date_preserved", "booking_id", *_PAYMENT]
    by_self = _paid(matches.filter("_self"), tables.transaction).select(*keys)
    cars = tables.narrowed("car", literal_runs(query))
    hits = cars.filter(wildcard_match(query, F.col("car_name"))).select("car_id")
    rented = tables.car_transaction.join(hits, F.col("car_car_id") == F.col("car_id"), "left_semi")
    payment = tables.transaction.join(
        rented.select("transaction_transaction_id"),
        F.col("transaction_id") == F.col("transaction_transaction_id"),
        "left_semi",
    ).select("booking_booking_id", *_PAYMENT)
    by_car = matches.filter(~F.col("_self")).join(payment, F.col("booking_id") == F.col("booking_booking_id"))
    return by_self.unionByName(by_car.select(*keys)).distinct()


def search_bookings_answer(
    tables: RentalTables, query: str, as_of: dt.date, page: int = 1, per_page: int = 100
) -> DataFrame:
    """``search_bookings`` and its totals as one JSON answer, from one evaluation of the matches."""
    matches = measured(_matching_bookings(tables, query)).frame
    rows = _search_page(tables, query, matches, as_of, page, per_page)
    meta = search_meta(matches.agg(F.count("*").alias("total")), page, per_page)
    return json_answer(rows, meta, newest_first(), per_page)


def search_meta(total: DataFrame, page: int, per_page: int) -> DataFrame:
    """(total, per_page, page, total_pages) from a one-row frame with ``total``."""
    size = F.lit(per_page).cast("long")
    return total.select(
        "total",
        size.alias("per_page"),
        F.lit(max(page, 1)).cast("long").alias("page"),
        F.ceil(F.col("total") / size).cast("long").alias("total_pages"),
    )


def search_bookings_meta(
    tables: RentalTables, query: str, page: int = 1, per_page: int = 100
) -> DataFrame:
    """Number of matching bookings (not of detail rows) and of pages."""
    total = _matching_bookings(tables, query).agg(F.count("*").alias("total"))
    return search_meta(total, page, per_page)
