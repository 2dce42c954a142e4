"""Applying batches of edits to the customer and staff tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe.operators.notifications import (
    customer_change_notifications,
    failure_notifications,
    staff_change_notifications,
)
from fleetframe.plans.lookups import measured
from fleetframe.session import pin
from fleetframe.sources.batches import write_batch
from fleetframe.sources.tables import EDITABLE


def _folded(changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key: whether it is deleted, and the fields of its last update by ``arrival``.

    Combined partly on the map side.
    """
    updated = F.col("action") == "update"
    return (
        changes.filter(F.col("action").isin("update", "delete") & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(
            F.max(F.col("action") == "delete").alias("_deleted"),
            F.max_by(F.when(updated, F.struct(*fields)), F.when(updated, F.col("arrival"))).alias("_last"),
        )
    )


def _edited_columns(table: DataFrame, fields: list[str]) -> list[Column]:
    return [
        F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in table.columns
    ]


def _apply(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The table after the edits, taken in order of ``arrival``.

    A deleted row stays deleted, as an update cannot bring it back; otherwise
    the last update sets all fields. Edits are folded to one row per key before
    the join. Unknown keys and actions change nothing.
    """
    folded = measured(_folded(changes, key, fields)).hinted()
    joined = table.join(folded, F.col(key) == F.col("_key"), "left")
    kept = joined.filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
    return kept.select(*_edited_columns(table, fields))


# Fields that an edit sets.
_FIELDS = {
    "customer": ["name", "phone_number", "address", "drivers_license"],
    "staff": ["name", "position", "contact"],
}


def apply_customer_changes(customer: DataFrame, changes: DataFrame) -> DataFrame:
    return _apply(customer, changes, EDITABLE["customer"], _FIELDS["customer"])


def apply_staff_changes(staff: DataFrame, changes: DataFrame) -> DataFrame:
    return _apply(staff, changes, EDITABLE["staff"], _FIELDS["staff"])


@dataclass(frozen=True)
class EditBatch:
    """Outcome of a batch of edits: what changes in the table, and the log entries of the same edits."""

    table: str
    # Rows in their new state, and the older state of these and of the deleted rows.
    replaced: DataFrame
    ended: DataFrame
    notification: DataFrame

    def applied_to(self, rows: DataFrame) -> DataFrame:
        """The table after the batch."""
        return rows.join(self.ended.select(EDITABLE[self.table]), EDITABLE[self.table], "left_anti").unionByName(self.replaced)

    def parts(self) -> dict[str, DataFrame]:
        """What the batch adds, by table."""
        return {self.table: self.replaced, "notification": self.notification}

    def write_to(self, folder: str, batch_id: int) -> bool:
        """Write the changed rows, the ended rows and the log entries, visible together or not at all.

        Rows without an edit are not written again. False if the batch is already there.
        """
        spark = self.replaced.sparkSession
        return write_batch(spark, folder, batch_id, self.parts(), {}, {self.table: self.ended})


def _edit_batch(table: str, rows: DataFrame, edits: DataFrame, log: DataFrame) -> EditBatch:
    key, fields = EDITABLE[table], _FIELDS[table]
    folded = measured(_folded(edits, key, fields)).hinted()
    # Few against the table; pinned, as three outputs are cut from it.
    hit = pin(rows.join(folded, F.col(key) == F.col("_key")))
    replaced = hit.filter(~F.col("_deleted")).select(*_edited_columns(rows, fields))
    return EditBatch(table, replaced, hit.select(*rows.columns), log)


def process_customer_changes(customer: DataFrame, changes: DataFrame, now: dt.datetime) -> EditBatch:
    edits = pin(changes)
    return _edit_batch("customer", customer, edits, customer_change_notifications(edits, now))


def process_staff_changes(
    staff: DataFrame, changes: DataFrame, now: dt.datetime, failures: DataFrame | None = None
) -> EditBatch:
    """``failures`` are edits that could not be written, with their ``error``; they are logged too."""
    edits = pin(changes)
    log = staff_change_notifications(edits, now)
    if failures is not None:
        log = log.unionByName(failure_notifications(failures, now))
    return _edit_batch("staff", staff, edits, log)
