"""Writing results: appends, new snapshots and JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a parquet table folder."""
    rows.write.mode("append").parquet(path)


def write_snapshot(table: DataFrame, path: str) -> None:
    """Write a changed table to a new folder; an existing folder is an error.

    The folder being read is never the folder being written, so a lost
    executor can always recompute its part from the old snapshot.
    """
    table.write.mode("errorifexists").parquet(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object per row, NULL fields included, in column ``json``."""
    return rows.select(
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json")
    )


def json_answer(page: DataFrame, meta: DataFrame, order: list[Column], per_page: int) -> DataFrame:
    """The search answer ``{data, total, per_page, page, total_pages}`` as one row.

    Of ``page`` the first ``per_page`` rows in ``order`` are taken, so no more than a page is ever
    gathered, whatever is passed in.
    """
    first = page.orderBy(*order).limit(per_page)
    listed = first.select(F.monotonically_increasing_id().alias("_n"), F.struct(*page.columns).alias("_row"))
    data = listed.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", "_row"))), lambda item: item["_row"]
        ).alias("data")
    ).scalar()
    fields = [name for name in ("total", "per_page", "page", "total_pages") if name in meta.columns]
    return meta.select(
        F.to_json(
            F.struct(data.alias("data"), *fields), {"ignoreNullFields": "false"}
        ).alias("json")
    )
