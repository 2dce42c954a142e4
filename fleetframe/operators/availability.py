"""Whether cars are free: conflicts with existing bookings and within a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetframe import fixed
from fleetframe.operators.intake import REASON
from fleetframe.plans.first_come import accept_disjoint
from fleetframe.plans.intervals import with_overlap_count
from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.session import stored
from fleetframe.sources.tables import RentalTables

def booked_ranges(tables: RentalTables, requests: DataFrame) -> DataFrame:
    """(car, start, end, weight) of bookings that have a payment for a car; the
    weight counts payments. Limited to dates the requests can touch.

    Bookings wholly before the first or after the last requested day cannot
    change any count, so they are filtered out at the scan. If the requested cars are few enough to be sent to the
    tasks, only their payments are looked at; ranges of other cars are left out then, as no request can touch
    them. Otherwise the bookings left, usually few, are joined outwards to payments and cars.
    """
    asked = requests.filter(F.col("start") <= F.col("end"))
    first_day = asked.agg(F.min("start")).scalar()
    last_day = asked.agg(F.max("end")).scalar()
    start, end = F.col("start_date"), F.col("end_date")
    near = tables.booking.select("booking_id", "start_date", "end_date").filter(
        ((end >= first_day) | (start >= first_day)) & ((start <= last_day) | (end <= last_day))
    )
    payment = tables.transaction.select("transaction_id", "booking_booking_id")
    of_booking = F.col("booking_booking_id") == F.col("booking_id")
    of_payment = F.col("transaction_transaction_id") == F.col("transaction_id")
    cars = measured(asked.select("car_id").distinct())
    if cars.fits_broadcast():
        rented = measured(matching_rows(tables.car_transaction, "car_car_id", cars, "car_id"), keep=True)
        if rented.fits_broadcast():
            payment = matching_rows(payment, "transaction_id", rented, "transaction_transaction_id")
        paid = measured(payment.join(rented.hinted(), of_payment), keep=True)
        ranges = near.join(paid.hinted(), of_booking)
    else:
        paid = measured(payment.join(measured(near).hinted(), of_booking), keep=True)
        ranges = tables.car_transaction.join(paid.hinted(), of_payment)
    return ranges.groupBy("car_car_id", "start_date", "end_date").agg(F.count("*").alias("weight"))


def availability_conflicts(requests: DataFrame, tables: RentalTables) -> DataFrame:
    """Append ``conflict_count``: bookings of the car that share a day with the request.

    ``requests`` has car_id, start and end. Both end days count. A booking
    counts once per payment for the car; one without a payment does not block.
    A request without a valid range gets NULL.
    """
    return with_overlap_count(
        requests,
        ("car_id", "start", "end"),
        booked_ranges(tables, requests),
        ("car_car_id", "start_date", "end_date", "weight"),
        "conflict_count",
    )


def admit_bookings(requests: DataFrame, tables: RentalTables) -> DataFrame:
    """Decide the open requests in order of arrival.

    A request is turned away when its car is booked on any of its days, or was
    given to an earlier accepted request of the batch. ``requests`` has arrival,
    car_id, start, end and reject_reason; rows with a reason are passed through.
    """
    pinned = stored(requests)
    is_open = F.col(REASON).isNull()
    asked = pinned.filter(is_open).select("arrival", "car_id", "start", "end")
    free = availability_conflicts(asked, tables).filter(F.col("conflict_count") == 0)
    accepted = accept_disjoint(free, "arrival", "car_id", "start", "end").withColumnRenamed(
        "arrival", "_accepted"
    )
    accepted = measured(accepted, keep=True).hinted()
    turned_away = is_open & F.col("_accepted").isNull()
    return (
        pinned.join(accepted, F.col("arrival") == F.col("_accepted"), "left")
        .withColumn(REASON, F.when(turned_away, fixed.CAR_UNAVAILABLE).otherwise(F.col(REASON)))
        .drop("_accepted")
    )
