"""Batches of booking requests, from form input to rows to append."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fleetframe import fixed
from fleetframe.functions import inclusive_days, form_trim
from fleetframe.operators.availability import admit_bookings
from fleetframe.operators.intake import (
    REASON,
    IdSeries,
    UniqueRule,
    any_missing,
    assign_ids,
    first_reason,
    held_values,
    open_batch,
    taken_values,
)
from fleetframe.plans.collations import under
from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.plans.paging import with_positions
from fleetframe.session import pin
from fleetframe.sources.batches import write_batch
from fleetframe.sources.tables import MONEY, SCHEMAS, RentalTables

def validate_bookings(requests: DataFrame, as_of: dt.date) -> DataFrame:
    """Apply the form rules and parse the dates into ``start`` and ``end``.

    Dates are ``yyyy-MM-dd``. An unreadable end date breaks the order rule, an
    unreadable start date the not-in-the-past rule.
    """
    start = F.try_to_date("start_date", "yyyy-MM-dd")
    end = F.try_to_date("end_date", "yyyy-MM-dd")
    return (
        requests.withColumn("customer_search", form_trim("customer_search"))
        .withColumn("start", start)
        .withColumn("end", end)
        .withColumn(
            REASON,
            first_reason(
                (
                    any_missing("customer_search", "car_id", "start_date", "end_date"),
                    fixed.FIELDS_REQUIRED,
                ),
                (
                    F.col("end").isNull() | (F.col("start") >= F.col("end")),
                    fixed.END_BEFORE_START,
                ),
                (
                    F.col("start").isNull() | (F.col("start") < F.lit(as_of)),
                    fixed.START_IN_PAST,
                ),
            ),
        )
    )


def price_bookings(requests: DataFrame, car: DataFrame) -> DataFrame:
    """Append days charged and the amount at the car's present rate.

    An unknown car has no rate and is charged nothing. An amount that does not
    fit the amount column is NULL.
    """
    rates = car.select(F.col("car_id").alias("_car"), "car_price")
    return (
        requests.join(rates, F.col("car_id") == F.col("_car"), "left")
        .withColumn("days", inclusive_days(F.col("start"), F.col("end")))
        .withColumn(
            "total_amount",
            (F.coalesce(F.col("car_price"), F.lit(0).cast(MONEY)) * F.col("days")).try_cast(MONEY),
        )
        .drop("_car", "car_price")
    )


_NEW_CUSTOMER_RULES: list[UniqueRule] = [
    ("customer_phone", "phone_number", fixed.GUEST_PHONE_TAKEN),
    ("id_card", "id_card", fixed.GUEST_CARD_TAKEN),
    ("license_number", "drivers_license", fixed.GUEST_LICENCE_TAKEN),
]
_NEW_FIELDS = ["customer_phone", "id_card", "license_number", "address"]


def resolve_booking_customer(
    validated: DataFrame, customer: DataFrame, collation: str | None = None
) -> DataFrame:
    """Append the customer of each open request: one on file, or a new one.

    A new customer must be complete and take no value already in use. One on
    file may also have been added by an earlier request of the same batch.
    Adds customer_id_card, customer_drivers_license and ``is_new_customer``. Values are compared by their
    bytes, or under a collation; the identity card of a customer on file is given as it is on file.
    """
    is_new = F.coalesce(F.col("customer_selection") == fixed.NEW_CUSTOMER, F.lit(False))
    trimmed = validated.select(
        *[
            form_trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in _NEW_FIELDS else F.col(c)
            for c in validated.columns
        ]
    ).withColumn("_new", is_new & F.col(REASON).isNull())
    checked = trimmed.withColumn(
        REASON,
        F.coalesce(
            REASON,
            F.when(
                F.col("_new"),
                first_reason(
                    (
                        any_missing("customer_search", *_NEW_FIELDS),
                        fixed.GUEST_FIELDS_REQUIRED,
                    ),
                    (~F.col("id_card").rlike(fixed.SIXTEEN_DIGITS), fixed.CARD_FORMAT),
                ),
            ),
        ),
    )
    batch = open_batch(checked, F.col("_new") & F.col(REASON).isNull())
    decided = taken_values(batch, customer, _NEW_CUSTOMER_RULES, collation, keep=True)
    decided = decided.withColumn(REASON, F.coalesce(REASON, "_taken")).drop("_taken")

    added = decided.filter(F.col("_open") & F.col(REASON).isNull()).select(
        F.col("id_card").alias("_added_id"),
        F.col("license_number").alias("_added_licence"),
        F.col("arrival").alias("_added_at"),
    )
    selects = ~F.col("_new") & F.col(REASON).isNull()
    chosen = batch.where(selects)
    on_file = held_values(
        customer, "id_card", chosen, "customer_selection", "drivers_license", collation=collation
    ).select(F.col("_held").alias("_filed_id"), F.col("drivers_license").alias("_filed_licence"))
    chosen_id = under(F.col("customer_selection"), collation)
    # Only rows that select a customer meet customers.
    joined = (
        chosen.frame.join(on_file, chosen_id == F.col("_filed_id"), "left")
        .join(
            added,
            (chosen_id == under(F.col("_added_id"), collation)) & (F.col("_added_at") < F.col("arrival")),
            "left",
        )
        .withColumn("_filed_id", F.col("_filed_id").cast("string"))
    )
    others = decided.filter(~F.coalesce(selects, F.lit(False)))
    joined = joined.unionByName(others, allowMissingColumns=True)
    # Both as plain texts again.
    found_id = F.coalesce(F.col("_filed_id").cast("string"), F.col("_added_id"))
    found_licence = F.when(F.col("_filed_id").isNotNull(), F.col("_filed_licence")).otherwise(
        F.col("_added_licence")
    )
    accepted_new = F.col("_new") & F.col(REASON).isNull()
    return joined.select(
        *[c for c in validated.columns if c != REASON],
        F.coalesce(
            F.col(REASON), F.when(selects & found_id.isNull(), fixed.CUSTOMER_UNKNOWN)
        ).alias(REASON),
        F.when(accepted_new, F.col("id_card")).otherwise(found_id).alias("customer_id_card"),
        F.when(accepted_new, F.col("license_number"))
        .otherwise(found_licence)
        .alias("customer_drivers_license"),
        accepted_new.alias("is_new_customer"),
    )


def customers_from_bookings(resolved: DataFrame) -> DataFrame:
    """Customer rows created by the requests, kept even if the booking fails later."""
    return resolved.filter("is_new_customer").select(
        "id_card",
        F.col("license_number").alias("drivers_license"),
        F.col("customer_search").alias("name"),
        F.col("customer_phone").alias("phone_number"),
        "address",
    )


def assign_staff(requests: DataFrame, staff: DataFrame, seed: int = 0) -> DataFrame:
    """Append ``staff_id``, picked by a hash of arrival and seed.

    The pick depends on nothing else, so a retried task picks the same person.
    """
    numbered = with_positions(staff.select("staff_id"), [F.asc("staff_id")], "_place")
    places = measured(numbered).hinted()
    size = staff.agg(F.count("*")).scalar()
    digest = F.md5(F.concat_ws(":", F.col("arrival").cast("string"), F.lit(str(seed))))
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return (
        requests.withColumn("_draw", F.pmod(drawn, F.nullif(size, F.lit(0).cast("long"))))
        .join(places, F.col("_draw") == F.col("_place"), "left")
        .withColumn(
            REASON,
            F.coalesce(
                REASON, F.when(F.col("staff_id").isNull(), fixed.NO_STAFF)
            ),
        )
        .drop("_draw", "_place")
    )


@dataclass(frozen=True)
class BookingBatch:
    """Outcome of a batch: a decision per request and the rows to append."""

    decisions: DataFrame
    customer: DataFrame
    booking: DataFrame
    transaction: DataFrame
    car_transaction: DataFrame
    # One row: the highest number of each id series after the batch.
    highest: DataFrame

    def applied_to(self, tables: RentalTables) -> RentalTables:
        """The snapshot after the batch."""
        names = ("customer", "booking", "transaction", "car_transaction")
        return tables.with_tables(
            **{name: getattr(tables, name).unionByName(getattr(self, name)) for name in names}
        )

    def parts(self) -> dict[str, DataFrame]:
        """What a batch writes, by table."""
        names = ("customer", "car_transaction", "transaction", "booking")
        return {**{name: getattr(self, name) for name in names}, "decision": self.decisions}

    def append_to(self, folder: str, batch_id: int) -> bool:
        """Write the new rows and decisions as one batch, all or nothing.

        The batch is visible to ``read_parquet_tables`` once all of it is written. After a failure it
        can be processed and written again under its number. False if it is already there.
        """
        spark = self.decisions.sparkSession
        return write_batch(spark, folder, batch_id, self.parts(), self.highest.first().asDict())


def booking_series(tables: RentalTables, highest: dict[str, int] | None = None) -> list[IdSeries]:
    known = highest or {}
    return [
        IdSeries(tables.booking, "booking_id", "BK", 10, known.get("booking_id")),
        IdSeries(tables.transaction, "transaction_id", "TX", 12, known.get("transaction_id")),
    ]


def post_bookings(
    accepted: DataFrame, tables: RentalTables, now: dt.datetime, highest: dict[str, int] | None = None
) -> dict[str, DataFrame]:
    """Booking, payment and car rows of accepted, priced requests.

    Everything is cut from one pinned frame, so the three outputs agree. ``highest`` gives the highest
    numbers in use; without it the tables' ids are looked at.
    """
    series = booking_series(tables, highest)
    numbered = pin(assign_ids(accepted, *series))
    added = numbered.agg(F.count("*").alias("added"))
    after = [
        (F.lit(s.highest).cast("long") if s.highest is not None else s.highest_in_use().scalar()) + F.col("added")
        for s in series
    ]
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    booking = numbered.select(
        "booking_id",
        F.lit(now.date()).alias("date_preserved"),
        F.col("start").alias("start_date"),
        F.col("end").alias("end_date"),
        "customer_drivers_license",
        "customer_id_card",
        F.col("staff_id").alias("staff_staff_id"),
    )
    transaction = numbered.select(
        "transaction_id",
        F.lit(fixed.FIRST_PAYMENT_METHOD).alias("payment_method"),
        F.col("total_amount").alias("amount"),
        moment.alias("payment_date"),
        F.col("staff_id").alias("staff_staff_id"),
        F.col("booking_id").alias("booking_booking_id"),
    )
    bridge = numbered.select(
        F.col("car_id").alias("car_car_id"),
        F.col("transaction_id").alias("transaction_transaction_id"),
    )
    return {
        "booking": booking.select(*SCHEMAS["booking"].names),
        "transaction": transaction.select(*SCHEMAS["transaction"].names),
        "car_transaction": bridge,
        "ids": numbered.select("arrival", "booking_id", "transaction_id"),
        "highest": added.select(*[a.alias(s.column) for a, s in zip(after, series)]),
    }


def requested_cars(requests: DataFrame, car: DataFrame) -> DataFrame:
    """The cars that requests name, to be sent to them where they are few; else all cars."""
    named = measured(requests.select("car_id").distinct())
    if not named.fits_broadcast():
        return car
    return measured(matching_rows(car, "car_id", named, "car_id")).hinted()


def decide_bookings(requests: DataFrame, tables: RentalTables, as_of: dt.date, seed: int = 0) -> DataFrame:
    """All requests with customer, staff, price and ``reject_reason``.

    Only what a batch appends is carried along: the form's dates and choice of customer are left out once they are
    read, and fields of a new customer are NULL or empty where none is named.
    """
    names_new = F.col("customer_selection") == fixed.NEW_CUSTOMER
    validated = validate_bookings(requests, as_of).drop("start_date", "end_date")
    needed = validated.withColumns({c: F.when(names_new, F.col(c)) for c in ("customer_search", *_NEW_FIELDS)})
    resolved = resolve_booking_customer(needed, tables.customer).drop("customer_selection")
    staffed = assign_staff(resolved, tables.staff, seed)
    priced = price_bookings(staffed, requested_cars(requests, tables.car)).drop("days")
    too_much = F.when(F.col("total_amount").isNull(), fixed.AMOUNT_TOO_LARGE)
    return admit_bookings(priced.withColumn(REASON, F.coalesce(REASON, too_much)), tables)


def process_booking_requests(
    requests: DataFrame,
    tables: RentalTables,
    now: dt.datetime,
    seed: int = 0,
    highest: dict[str, int] | None = None,
) -> BookingBatch:
    """Run a batch of requests as if they came one after another at ``now``."""
    # Cut from stored frames, so that all outputs agree.
    decided = decide_bookings(requests, tables, now.date(), seed)
    posted = post_bookings(decided.filter(F.col(REASON).isNull()), tables, now, highest)
    ids = measured(posted.pop("ids"), keep=True).hinted()
    decisions = decided.select("arrival", REASON).join(ids, "arrival", "left")
    return BookingBatch(decisions=decisions, customer=customers_from_bookings(decided), **posted)
