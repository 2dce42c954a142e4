"""Batches of new-customer and new-car requests.

Requests carry a unique ``arrival`` that orders them. A check adds
``reject_reason``: the message of the first rule a request breaks, else NULL.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe import fixed
from fleetframe.functions import is_missing, form_trim
from fleetframe.plans.collations import under, with_canonical
from fleetframe.plans.first_come import accept_unique, key_claims
from fleetframe.plans.lookups import Measured, matching_rows, measured
from fleetframe.plans.paging import with_positions
from fleetframe.session import pin, stored
from fleetframe.sources.tables import MONEY, SCHEMAS

REASON = "reject_reason"

# A rule that a value may occur once: request column, master column, message.
UniqueRule = tuple[str, str, str]


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Message of the first rule that is broken."""
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in rules])


def any_missing(*names: str) -> Column:
    missing = F.lit(False)
    for name in names:
        missing = missing | is_missing(F.col(name))
    return missing


def held_values(
    master: DataFrame, column: str, requests: Measured, asked: str, *extra: str, collation: str | None = None
) -> DataFrame:
    """The values asked for by the requests that the master table already holds, one of those that are equal.
    A small batch is sent to the scan of the master; for a large one all values of the master are given."""
    held = master.select(F.col(column).alias("_held"), *extra)
    found = matching_rows(held, "_held", requests, asked, collation) if requests.fits_broadcast(asked) else held
    return found.withColumn("_held", under(F.col("_held"), collation)).dropDuplicates(["_held"])


def unique_reason(
    requests: DataFrame,
    master: DataFrame,
    rules: list[UniqueRule],
    open_rows: Column,
    collation: str | None = None,
) -> DataFrame:
    """Apply "value not yet taken" rules to the open rows, in order of arrival.

    A value is taken by the master table or by an earlier accepted request of
    the batch. Rows that are not open are passed through and take nothing. Adds
    ``_taken``, the message of the first rule broken. Values are compared by their bytes, or under
    a collation, where values that are equal under it are one value.
    """
    batch = open_batch(requests, open_rows)
    return taken_values(batch, master, rules, collation).select(*requests.columns, "_taken")


def open_batch(requests: DataFrame, open_rows: Column) -> Measured:
    """The requests, stored once, with ``_open`` for those that meet the condition."""
    return measured(requests.withColumn("_open", F.coalesce(open_rows, F.lit(False))), keep=True)


def taken_values(
    batch: Measured, master: DataFrame, rules: list[UniqueRule], collation: str | None = None, keep: bool = False
) -> DataFrame:
    """``unique_reason`` for an ``open_batch``. With ``keep`` what is dear to compute is stored, for a frame that
    feeds several branches."""
    # Only open rows are met by arrival.
    found = batch.frame.agg(
        F.count_distinct(F.when(F.col("_open"), F.col("arrival"))).alias("arrivals"),
        F.count_if("_open").alias("open"),
        F.count("*").alias("all"),
    ).first()
    if collation is None and found["arrivals"] == found["open"]:
        few = 2 * found["open"] <= found["all"]
        return _reason_by_claims(batch, master, rules, few, keep)
    told = _reason_by_rows(batch, master, rules, collation).select(*batch.frame.columns, "_taken")
    return stored(told) if keep else told


def _reason_by_claims(
    batch: Measured, master: DataFrame, rules: list[UniqueRule], few: bool = False, keep: bool = False
) -> DataFrame:
    """``unique_reason`` where no open arrival repeats: only arrivals and values meet, and whole rows once, by arrival.

    If ``few`` rows are open, their arrivals and values are stored, as they are read many times."""
    asking = batch.where(F.col("_open"))
    keys = [column for column, _, _ in rules]
    asked = asking.frame.select("arrival", *keys)
    asking_keys = Measured(stored(asked) if few else asked, asking.column_bytes)
    asked = asking_keys.frame
    held = None
    for i, (column, master_column, _) in enumerate(rules):
        values = master.select(F.col(master_column).cast("string").alias("value")).filter(F.col("value").isNotNull())
        if asking.fits_broadcast(column):
            values = matching_rows(values, "value", asking_keys, column)
        values = values.select(F.lit(i).alias("kind"), "value")
        held = values if held is None else held.unionByName(values)
    held = stored(held) if batch.fits_broadcast(*keys) else held
    accepted = stored(accept_unique(asked, "arrival", keys, held=held))
    decided = asked.join(accepted.withColumn("_in", F.lit(True)), "arrival", "left")
    claims = key_claims(decided, "arrival", keys, "_in")
    # A value is taken by one accepted row at most, or by the master.
    takers = claims.filter("_in").select("kind", "value", F.col("arrival").alias("_by"))
    takers = takers.unionByName(held.select("kind", "value", F.lit(None).cast(batch.frame.schema["arrival"].dataType).alias("_by")))
    refused = (
        claims.filter(F.col("_in").isNull())
        .drop("_in")
        .join(takers, ["kind", "value"])
        .filter(F.col("_by").isNull() | (F.col("_by") < F.col("arrival")))
        .groupBy(F.col("arrival").alias("_refused"))
        .agg(F.min("kind").alias("_rule"))
    )
    refused = stored(refused) if keep else refused
    message = first_reason(*[(F.col("_rule") == i, message) for i, (_, _, message) in enumerate(rules)])
    told = asking.frame.join(refused, F.col("arrival") == F.col("_refused"), "left").withColumn("_taken", message)
    silent = batch.frame.filter(~F.col("_open")).withColumn("_taken", F.lit(None).cast("string"))
    return told.drop("_refused", "_rule").unionByName(silent)


def _reason_by_rows(batch: Measured, master: DataFrame, rules: list[UniqueRule], collation: str | None) -> DataFrame:
    """``unique_reason`` for any arrivals and collations: whole rows meet the values rule by rule."""
    asking = batch.where(F.col("_open"))
    marked = batch.frame
    for i, (column, master_column, _) in enumerate(rules):
        held = held_values(master, master_column, asking, column, collation=collation)
        same = under(F.col(column), collation) == F.col(f"_held{i}")
        marked = marked.join(held.withColumnRenamed("_held", f"_held{i}"), same, "left")
    keys = [column for column, _, _ in rules]
    if collation is not None:
        # From here on equal values are written alike.
        marked = with_canonical(marked, keys, collation)
        keys = [f"_as_{column}" for column in keys]
    marked = pin(marked)
    clear = F.col("_open")
    for i in range(len(rules)):
        clear = clear & F.col(f"_held{i}").isNull()
    accepted = accept_unique(marked.filter(clear), "arrival", keys)
    holders = pin(marked.select("arrival", *keys).join(accepted, "arrival", "left_semi"))
    reasons = []
    for i, (column, (_, _, message)) in enumerate(zip(keys, rules)):
        holder = holders.select(F.col(column).alias(f"_key{i}"), F.col("arrival").alias(f"_by{i}"))
        marked = marked.join(holder, F.col(column) == F.col(f"_key{i}"), "left")
        earlier = F.coalesce(F.col(f"_by{i}") < F.col("arrival"), F.lit(False))
        reasons.append((F.col("_open") & (F.col(f"_held{i}").isNotNull() | earlier), message))
    return marked.withColumn("_taken", first_reason(*reasons))


# ---------------------------------------------------------------- customers


def validate_customers(requests: DataFrame) -> DataFrame:
    """Trim the fields and apply the form rules."""
    fields = ["full_name", "phone", "license_number", "address", "id_card"]
    trimmed = requests.select(
        "arrival", *[form_trim(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields]
    )
    return trimmed.withColumn(
        REASON,
        first_reason(
            (any_missing(*fields), fixed.FIELDS_REQUIRED),
            (~F.col("id_card").rlike(fixed.SIXTEEN_DIGITS), fixed.CARD_FORMAT),
            (F.octet_length("phone") < fixed.PHONE_BYTES, fixed.PHONE_FORMAT),
        ),
    )


_CUSTOMER_RULES: list[UniqueRule] = [
    ("phone", "phone_number", fixed.PHONE_TAKEN),
    ("license_number", "drivers_license", fixed.LICENCE_TAKEN),
    ("id_card", "id_card", fixed.CARD_TAKEN),
]


def dedupe_against_master(validated: DataFrame, customer: DataFrame, collation: str | None = None) -> DataFrame:
    """Turn away phones, licences and identity cards that are already in use, by bytes or under a collation."""
    checked = unique_reason(validated, customer, _CUSTOMER_RULES, F.col(REASON).isNull(), collation)
    return checked.withColumn(REASON, F.coalesce(REASON, "_taken")).drop("_taken")


def admit_customers(requests: DataFrame, customer: DataFrame, collation: str | None = None) -> DataFrame:
    """All sign-ups with their ``reject_reason``."""
    return dedupe_against_master(validate_customers(requests), customer, collation)


def new_customers(admitted: DataFrame) -> DataFrame:
    """Customer rows of the accepted sign-ups."""
    return admitted.filter(F.col(REASON).isNull()).select(
        "id_card",
        F.col("license_number").alias("drivers_license"),
        F.col("full_name").alias("name"),
        F.col("phone").alias("phone_number"),
        "address",
    )


def ingest_customers(requests: DataFrame, customer: DataFrame) -> DataFrame:
    """The customer table with the accepted sign-ups added."""
    return customer.unionByName(new_customers(admit_customers(requests, customer)))


# --------------------------------------------------------------------- cars


def validate_cars(requests: DataFrame, car_class: DataFrame, as_of: dt.date) -> DataFrame:
    """Apply the form rules and name the car "brand model year".

    Years and rates that are not numbers break their rule, and a rate must fit
    the price column.
    """
    newest = as_of.year + 1
    fields = ["brand", "model", "year", "car_class_id", "car_type", "daily_rate"]
    filled = requests.select(
        "arrival",
        *[
            (form_trim(F.coalesce(f, F.lit(""))) if f in ("brand", "model") else F.coalesce(f, F.lit(""))).alias(f)
            for f in fields
        ],
    )
    year = F.col("year").try_cast("double")
    rate = F.col("daily_rate").try_cast("double")
    known = car_class.select(F.col("cc_id").alias("_class")).distinct()
    return (
        filled.join(known, F.col("car_class_id") == F.col("_class"), "left")
        .withColumn(
            REASON,
            first_reason(
                (any_missing(*fields), fixed.FIELDS_REQUIRED),
                (
                    ~F.coalesce(year.between(fixed.FIRST_MODEL_YEAR, newest), F.lit(False)),
                    fixed.YEAR_RANGE.format(newest),
                ),
                (~F.coalesce(rate > 0, F.lit(False)), fixed.RATE_POSITIVE),
                (F.col("_class").isNull(), fixed.CLASS_UNKNOWN),
                (F.col("daily_rate").try_cast(MONEY).isNull(), fixed.RATE_TOO_LARGE),
            ),
        )
        .withColumn("car_name", F.concat_ws(" ", "brand", "model", "year"))
        .drop("_class")
    )


def new_cars(validated: DataFrame, car: DataFrame) -> DataFrame:
    """Car rows of the accepted requests, with ids in order of arrival."""
    accepted = validated.filter(F.col(REASON).isNull())
    numbered = assign_ids(accepted, IdSeries(car, "car_id", "CAR", 8))
    return numbered.select(
        "car_id",
        "car_name",
        "car_type",
        F.col("daily_rate").try_cast(MONEY).alias("car_price"),
        F.col("car_class_id").alias("car_class_cc_id"),
    )


def ingest_cars(requests: DataFrame, car: DataFrame, car_class: DataFrame, as_of: dt.date) -> DataFrame:
    """The car table with the accepted requests added."""
    added = new_cars(validate_cars(requests, car_class, as_of), car)
    return car.unionByName(added.select(*SCHEMAS["car"].names))


# ---------------------------------------------------------------------- ids


@dataclass(frozen=True)
class IdSeries:
    """Ids of a table: the column, and a prefix with a zero-padded number.

    ``highest`` is the highest number in use, where it is known; else all ids are looked at.
    """

    table: DataFrame
    column: str
    prefix: str
    width: int
    highest: int | None = None

    def highest_in_use(self) -> DataFrame:
        """One row with the highest number."""
        suffix = F.regexp_extract(F.col(self.column), r"([0-9]+)\z", 1).try_cast("long")
        return self.table.agg(F.coalesce(F.max(suffix), F.lit(0).cast("long")).alias("highest"))

    def after_highest(self, position: Column) -> Column:
        """The id for a 0-based position, counted on from the highest number in use."""
        known = self.highest is not None
        highest = F.lit(self.highest).cast("long") if known else self.highest_in_use().scalar()
        number = (position + highest + 1).cast("string")
        padded = F.lpad(number, self.width, "0")
        return F.concat(
            F.lit(self.prefix), F.when(F.char_length(number) >= self.width, number).otherwise(padded)
        )


def assign_ids(rows: DataFrame, *series: IdSeries) -> DataFrame:
    """Append fresh ids of each series, in order of ``arrival``.

    Numbering works on row positions; no task sees all rows.
    """
    placed = with_positions(rows, [F.asc("arrival")], "_position")
    for ids in series:
        placed = placed.withColumn(ids.column, ids.after_highest(F.col("_position")))
    return placed.drop("_position")
