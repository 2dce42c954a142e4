"""Top rows, pages and global row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe.session import pin

# Up to this many leading rows a page is cut by top-k, which keeps offset+limit
# rows per task. Deeper pages are cut by global position instead.
SHALLOW_ROWS = 10_000

_ROW_BITS = 33


def with_positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Append the 0-based position of every row in the given order.

    The sorted rows are range-partitioned and pinned, so partitions stay fixed
    between counting and numbering. A row's position is its place within its
    partition plus the sizes of the partitions before it; only those sizes, one
    row per partition, meet in one task. ``order`` must end in a unique key.
    """
    ordered = pin(df.orderBy(*order))
    tagged = ordered.withColumn("_tag", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_tag"), _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_tag") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place)
        .select(*df.columns, name)
    )


def top_rows(df: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def is_deep(page: int, per_page: int) -> bool:
    """Whether a page is cut by position."""
    return max(page, 1) * per_page > SHALLOW_ROWS


def page_keys(keys: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """The keys of a 1-based page with their ``position``; at most ``per_page`` rows."""
    offset = (max(page, 1) - 1) * per_page
    return with_positions(keys, order).filter(F.col("position").between(offset, offset + per_page - 1))


def page_rows(df: DataFrame, order: list[Column], page: int, per_page: int, keys: list[str]) -> DataFrame:
    """Rows of the given 1-based page, in order.

    ``keys`` are the columns that ``order`` is made of; together they are unique. For a deep page only
    they are sorted and pinned; the page's few keys are then sent to the rows.
    """
    if not is_deep(page, per_page):
        return df.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)
    wanted = page_keys(df.select(*keys), order, page, per_page)
    return with_page_keys(df, wanted, keys).orderBy("position").drop("position")


def with_page_keys(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the keys of a page, and their ``position``."""
    few = wanted.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "position")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    # One page of keys.
    return df.join(F.broadcast(few), same).select(*df.columns, "position")
