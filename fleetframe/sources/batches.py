"""Tables written batch by batch, each batch whole or not at all.

``folder/<table>/batch_id=<n>`` holds the rows that batch n adds to a table or puts in the place of older
ones. ``folder/<table>_edited/batch_id=<n>`` holds the older rows that end with batch n, as they were: those replaced
and those deleted. A row counts until a later batch ends its key, so the newest state of a key is its row
of the last batch that has one, unless a batch since then deleted it.

When all of a batch is written, the mark ``folder/batch/batch_id=<n>`` follows. It holds the highest number
of every id series, the tables in which the batch ended rows, and whether it marked the log as read.
Readers take marked batches only, so a half-written batch is invisible, and running it again overwrites
its files. A marked batch is never written again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

MARKS = "batch"
BASE_BATCH = -1

# Names in the marks that are not id series: a table with ended rows, and the log marked as read.
_EDITED = "edited:"
_READ = "read:"

_MARK = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("highest", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def read_marks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table written by batches; None if no batch wrote it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass(frozen=True)
class Contents:
    """What the marks of a folder say about its whole batches."""

    batches: list[int]
    # The highest number of each id series.
    highest: dict[str, int] = field(default_factory=dict)
    # Tables in which some batch ended rows.
    edited: frozenset[str] = frozenset()
    # The last batch that marked each log as read.
    read: dict[str, int] = field(default_factory=dict)


def contents(spark: SparkSession, folder: str, before: int | None = None) -> Contents | None:
    """The whole batches, or those with numbers below ``before``; None if the folder is not written in batches.

    Reads marks only: a few rows per batch.
    """
    marks = read_marks(spark, f"{folder}/{MARKS}", _MARK)
    if marks is None:
        return None
    wanted = marks if before is None else marks.filter(F.col("batch_id") < before)
    found = wanted.groupBy("series").agg(F.max("highest").alias("highest"), F.collect_set("batch_id").alias("batches"))
    rows = found.collect()
    named = {r["series"]: r["highest"] for r in rows if r["series"] is not None}
    return Contents(
        batches=sorted({n for r in rows for n in r["batches"]}),
        highest={n: h for n, h in named.items() if not n.startswith((_EDITED, _READ))},
        edited=frozenset(n.removeprefix(_EDITED) for n in named if n.startswith(_EDITED)),
        read={n.removeprefix(_READ): h for n, h in named.items() if n.startswith(_READ)},
    )


def marked_batches(spark: SparkSession, folder: str) -> list[int] | None:
    """Numbers of the whole batches; None if the folder is not written in batches."""
    found = contents(spark, folder)
    return None if found is None else found.batches


def highest_numbers(spark: SparkSession, folder: str, before: int) -> dict[str, int]:
    """The highest number of each id series in the batches before one; reads marks only."""
    found = contents(spark, folder, before)
    return {} if found is None else found.highest


def edited_part(table: str) -> str:
    """The part of a batch that holds the older rows it ends."""
    return f"{table}_edited"


def write_part(rows: DataFrame, folder: str, name: str, batch_id: int) -> None:
    """One table of a batch, not visible before the batch is marked."""
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")


def mark(spark: SparkSession, folder: str, batch_id: int, highest: dict[str, int]) -> None:
    """Make a batch visible."""
    series = [(name, number) for name, number in sorted(highest.items())] or [(None, None)]
    rows = spark.createDataFrame(series, T.StructType(_MARK.fields[:2])).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{folder}/{MARKS}/batch_id={batch_id}")


def write_batch(
    spark: SparkSession,
    folder: str,
    batch_id: int,
    tables: dict[str, DataFrame],
    highest: dict[str, int],
    ended: dict[str, DataFrame] | None = None,
    read: tuple[str, ...] = (),
) -> bool:
    """Write all tables of a batch and then its mark; False if the batch is there already.

    ``ended`` has for a table the rows of earlier batches that no longer count, as they were;
    ``read`` names logs whose entries of earlier batches are read.
    """
    if batch_id in (marked_batches(spark, folder) or []):
        return False
    for name, rows in tables.items():
        write_part(rows, folder, name, batch_id)
    for name, keys in (ended or {}).items():
        write_part(keys, folder, edited_part(name), batch_id)
    notes = {f"{_EDITED}{name}": batch_id for name in ended or {}} | {f"{_READ}{name}": batch_id for name in read}
    mark(spark, folder, batch_id, {**highest, **notes})
    return True


def current_rows(rows: DataFrame, ended: DataFrame, key: str) -> DataFrame:
    """Of rows with their ``batch_id`` those that no later batch ended.

    ``ended`` holds keys with the batches that named them. It is reduced to one row per key, partly on the
    map side, and as edits are few against the rows of a table, the join sends them to the scan
    whenever their size allows.
    """
    last = ended.groupBy(F.col(key).alias("_ended")).agg(F.max("batch_id").alias("_last"))
    over = (F.col(key) == F.col("_ended")) & (F.col("batch_id") < F.col("_last"))
    return rows.join(last, over, "left_anti")
