"""Posting lists of character trigrams over the searched tables, kept batch by batch.

``folder/<table>_grams/batch_id=<n>/bucket=<b>`` holds for every trigram of the searched texts of batch n the keys
of the rows that have it. Lists are cut by a hash of the key into parts of bounded length, and sorted, so
that a search opens the files of a few buckets and in them the row groups of its trigrams. The mark
``folder/indexed/batch_id=<n>`` follows when the lists of a batch are whole; a batch is indexed once.

A search takes the rarest trigrams of the literal runs of a pattern and intersects their lists part by part.
The keys found are candidates: whoever asks checks their rows, in their newest state, with the full
pattern. Rows of batches without lists are searched as they are. A pattern without a run of three
characters, or whose rarest trigram is in too many rows, scans the table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.plans.lookups import matching_rows, measured
from fleetframe.sources.batches import marked_batches, read_marks
from fleetframe.sources.tables import SCHEMAS, RentalTables, read_parquet_tables

INDEXED = "indexed"
# Key and searched columns of each table, in the order in which lists show them.
SEARCHED: dict[str, tuple[str, tuple[str, ...]]] = {
    "customer": ("id_card", ("id_card", "name", "phone_number", "address", "drivers_license")),
    "staff": ("staff_id", ("staff_id", "name", "contact", "position")),
    "car": ("car_id", ("car_name",)),
    "booking": ("booking_id", ("booking_id",)),
}
LENGTH = 3
BUCKETS = 16
# Keys of one list; a trigram with more of them has several lists.
LIST_KEYS = 32_768
# Rows of the table to an index file, about; the trigrams of as many are sorted by one task.
FILE_ROWS = 100_000
# Trigrams whose lists are intersected.
MOST_GRAMS = 4
# Share of the rows from which a scan is cheaper.
SCAN_SHARE = 0.1

_LISTS = T.StructType(
    [
        T.StructField("gram", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("batch_id", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
_MARK = T.StructType([T.StructField("table", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("batch_id", T.LongType())])


def lists_part(table: str) -> str:
    return f"{table}_grams"


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text."""
    places = F.sequence(F.lit(1), F.char_length(text) - (LENGTH - 1))
    cut = F.transform(places, lambda i: F.substring(text, i, F.lit(LENGTH)))
    return F.when(F.char_length(text) >= LENGTH, F.array_distinct(cut))


def posting_lists(rows: DataFrame, table: str) -> tuple[DataFrame, int]:
    """(gram, part, rows, keys, bucket) of the rows of a table, sorted file by file, and the number of rows.

    The keys of a list meet once: they are dealt by ranges of (bucket, gram, part), and lists are made where they lie.
    """
    key, columns = SEARCHED[table]
    total = rows.count()
    parts = max(1, -(-total // LIST_KEYS))
    files = max(BUCKETS, -(-total // FILE_ROWS))
    order = ["bucket", "gram", "part"]
    listed = (
        rows.select(F.col(key).alias("key"), F.lower(F.concat_ws(" ", *columns)).alias("text"))
        .filter("key IS NOT NULL")
        .select("key", F.explode(grams_of(F.col("text"))).alias("gram"))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        .withColumn("bucket", F.pmod(F.crc32(F.encode("gram", "utf-8")), F.lit(BUCKETS)).cast("int"))
        .repartitionByRange(files, *order)
        .groupBy(*order)
        .agg(F.sort_array(F.collect_set("key")).alias("keys"))
        .sortWithinPartitions(*order)
    )
    return listed.select("gram", "part", F.size("keys").cast("long").alias("rows"), "keys", "bucket"), total


def update_index(spark: SparkSession, folder: str) -> list[int]:
    """Index the whole batches that have no lists yet; returns their numbers.

    A batch whose indexing broke off has no mark and is indexed anew.
    """
    whole = marked_batches(spark, folder)
    if whole is None:
        raise ValueError(f"{folder} is not written in batches")
    done = indexed_batches(spark, folder)
    new = [n for n in whole if n not in done]
    for n in new:
        marks = []
        for table in SEARCHED:
            rows = _raw_rows(spark, folder, table, [n])
            if rows is None:
                continue
            lists, total = posting_lists(rows, table)
            lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{lists_part(table)}/batch_id={n}")
            marks.append((table, total))
        made = spark.createDataFrame(marks, T.StructType(_MARK.fields[:2])).coalesce(1)
        made.write.mode("overwrite").parquet(f"{folder}/{INDEXED}/batch_id={n}")
    return new


def indexed_batches(spark: SparkSession, folder: str) -> dict[int, dict[str, int]]:
    """Rows of each table by indexed batch."""
    marks = read_marks(spark, f"{folder}/{INDEXED}", _MARK)
    found: dict[int, dict[str, int]] = {}
    for row in [] if marks is None else marks.collect():
        found.setdefault(row["batch_id"], {})[row["table"]] = row["rows"]
    return found


def _raw_rows(spark: SparkSession, folder: str, table: str, batches: list[int]) -> DataFrame | None:
    """The rows that some batches wrote, in whatever state they are now; None if no batch wrote the table."""
    full = T.StructType([*SCHEMAS[table].fields, T.StructField("batch_id", T.LongType())])
    rows = read_marks(spark, f"{folder}/{table}", full)
    return None if rows is None else rows.filter(F.col("batch_id").isin(batches))


@dataclass(frozen=True)
class IndexedTables(RentalTables):
    """The newest state of a folder's tables, searched by posting lists."""

    folder: str = ""
    # Rows of each table by indexed batch, and whole batches without lists.
    indexed: dict[int, dict[str, int]] = field(default_factory=dict)
    unindexed: tuple[int, ...] = ()

    def lists(self, table: str, grams: list[str]) -> DataFrame:
        """The posting lists of some trigrams."""
        buckets = sorted({zlib.crc32(gram.encode()) % BUCKETS for gram in grams})
        rows = self.spark.read.schema(_LISTS).parquet(f"{self.folder}/{lists_part(table)}")
        wanted = F.col("batch_id").isin(list(self.indexed)) & F.col("bucket").isin(buckets) & F.col("gram").isin(grams)
        return rows.filter(wanted)

    def rarest(self, table: str, runs: list[str]) -> list[str] | None:
        """The trigrams of the runs to look up, none if one has no row; None if a scan is better."""
        lowered = self.spark.sql("SELECT transform(:runs, x -> lower(x)) AS runs", args={"runs": F.array(*map(F.lit, runs))})
        grams = sorted({run[i : i + LENGTH] for run in lowered.first()["runs"] for i in range(len(run) - LENGTH + 1)})
        total = sum(rows.get(table, 0) for rows in self.indexed.values())
        if not grams or not total:
            return None
        # One row for each trigram of the pattern; the lists themselves are not read.
        counted = self.lists(table, grams).groupBy("gram").agg(F.sum("rows").alias("rows")).collect()
        rows_of = {r["gram"]: r["rows"] for r in counted}
        if len(rows_of) < len(grams):
            return []
        chosen = sorted(grams, key=lambda g: (rows_of[g], g))[:MOST_GRAMS]
        return None if rows_of[chosen[0]] > SCAN_SHARE * total else chosen

    def candidates(self, table: str, runs: list[str]) -> DataFrame | None:
        """Keys of all rows that can hold the runs, and of some others; None if a scan is better."""
        runs = [run for run in runs if len(run) >= LENGTH]
        grams = self.rarest(table, runs) if runs else None
        if grams is None:
            return None
        common = F.aggregate("lists", F.col("lists")[0], lambda kept, keys: F.array_intersect(kept, keys))
        # A part of a batch has one list per trigram, so no more than MOST_GRAMS of them meet.
        keys = (
            self.lists(table, grams)
            .groupBy("batch_id", "part")
            .agg(F.collect_list("keys").alias("lists"))
            .filter(F.size("lists") == len(grams))
            .select(F.explode(common).alias("key"))
        )
        if self.unindexed:
            key, columns = SEARCHED[table]
            text = F.lower(F.concat_ws(" ", *columns))
            rows = _raw_rows(self.spark, self.folder, table, list(self.unindexed))
            if rows is not None:
                holds = [text.contains(F.lower(F.lit(run))) for run in runs]
                new = rows.filter(_all(holds)).select(F.col(key).alias("key"))
                keys = keys.unionByName(new)
        return keys.distinct()

    def narrowed(self, table: str, runs: list[str]) -> DataFrame:
        rows = getattr(self, table)
        found = self.candidates(table, runs) if table in SEARCHED else None
        if found is None:
            return rows
        return matching_rows(rows, SEARCHED[table][0], measured(found), "key")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def read_indexed_tables(spark: SparkSession, folder: str) -> IndexedTables:
    """The newest state of a folder written in batches, with the lists made so far."""
    tables = read_parquet_tables(spark, folder)
    done = indexed_batches(spark, folder)
    whole = marked_batches(spark, folder) or []
    return IndexedTables(
        **{name: getattr(tables, name) for name in SCHEMAS},
        folder=folder,
        indexed={n: rows for n, rows in done.items() if n in whole},
        unindexed=tuple(n for n in whole if n not in done),
    )
