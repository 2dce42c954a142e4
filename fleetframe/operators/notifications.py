"""The notification feed and log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe import fixed
from fleetframe.plans.paging import top_rows
from fleetframe.sources.tables import SCHEMAS, RentalTables


def notification_feed(tables: RentalTables, k: int = 50) -> DataFrame:
    """The newest notifications, all columns."""
    order = [F.desc("created_at"), F.asc("message"), F.asc("type"), F.asc("user_id")]
    return top_rows(tables.notification, order, k)


def notification_cards(tables: RentalTables, k: int = 50) -> DataFrame:
    """The feed as shown on screen: marked read, with the time as text."""
    feed = notification_feed(tables.with_tables(notification=mark_read(tables.notification)), k)
    return feed.withColumn("created_at", F.date_format("created_at", "dd MMM yyyy HH:mm"))


def mark_read(notification: DataFrame) -> DataFrame:
    """The log with every unread entry marked as read."""
    read = F.when(F.col("is_read") == 0, F.lit(1)).otherwise(F.col("is_read"))
    return notification.withColumn("is_read", read.cast("int"))


def _entries(rows: DataFrame, message: Column, kind: Column, link: Column, now: dt.datetime) -> DataFrame:
    """Unread log rows for no particular user, in the log's column order."""
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    return rows.select(
        F.lit(None).cast("string").alias("user_id"),
        message.alias("message"),
        kind.alias("type"),
        link.alias("link"),
        F.lit(0).cast("int").alias("is_read"),
        moment.alias("created_at"),
    ).select(*SCHEMAS["notification"].names)


def _filled(template: str, value: Column) -> Column:
    """The template with the value, or nothing if it is NULL, in place of ``{}``."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.coalesce(value, F.lit("")), F.lit(after))


def _change_entries(
    changes: DataFrame, key: str, texts: tuple[str, str], updated_kind: str, link: str, now: dt.datetime
) -> DataFrame:
    updated = F.col("action") == "update"
    return _entries(
        changes.filter(F.col("action").isin("update", "delete")),
        F.when(updated, _filled(texts[0], F.col("name"))).otherwise(_filled(texts[1], F.col(key))),
        F.when(updated, updated_kind).otherwise("danger"),
        F.when(updated, _filled(link, F.col(key))).otherwise(fixed.USERS_LINK),
        now,
    )


def customer_change_notifications(changes: DataFrame, now: dt.datetime) -> DataFrame:
    """One log entry per update or delete, whether or not a customer was hit."""
    texts = (fixed.CUSTOMER_UPDATED, fixed.CUSTOMER_DELETED)
    return _change_entries(changes, "id_card", texts, "success", fixed.CUSTOMER_LINK, now)


def staff_change_notifications(changes: DataFrame, now: dt.datetime) -> DataFrame:
    """One log entry per update or delete, whether or not a staff member was hit."""
    texts = (fixed.STAFF_UPDATED, fixed.STAFF_DELETED)
    return _change_entries(changes, "staff_id", texts, "info", fixed.STAFF_LINK, now)


def failure_notifications(failures: DataFrame, now: dt.datetime) -> DataFrame:
    """One log entry per failed staff edit, from its ``error`` text."""
    message = _filled(fixed.WRITE_FAILED, F.col("error"))
    return _entries(failures, message, F.lit("danger"), F.lit(fixed.USERS_LINK), now)
