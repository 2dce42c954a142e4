"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetframe.llm.boosted_trees import levels_of, pooled
from fleetframe.session import ensure_checkpoint_dir, reach_workers

# Rows that a task turns into Python objects at a time.
ROWS_AT_ONCE = 256

SAMPLE_SEED = 20_240_310


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, *columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and the further columns asked for; a null text counts as empty."""
    reach_workers(docs.sparkSession)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *columns
    )


def id_remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


Step = Callable[[dict[str, list]], dict[str, Iterable]]


def map_chunks(df: DataFrame, start: Callable[[], Step], ddl: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Apply a function from columns to columns to a few rows at a time.

    ``start`` runs once per task and returns the function, so models are opened once.
    Memory follows ``rows`` rows, not the partition.
    """
    reach_workers(df.sparkSession)
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                columns = step(batch.slice(low, rows).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def sampled_ids(docs: DataFrame, size: int, where: Column | None = None, seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``size`` ids, those with the smallest hash: the same ones on every run."""
    wanted = docs if where is None else docs.filter(where)
    ids = wanted.select("doc_id").filter(F.col("doc_id").isNotNull())
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pyarrow.fs.LocalFileSystem(),
        folder,
    )


def write_object(folder: str, name: str, value: Any) -> None:
    """Write under a name of its own first: a task that is run again leaves one whole file."""
    files, path = store_of(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        pickle.dump(value, out, protocol=5)
    files.move(own, f"{path}/{name}")


def read_object(folder: str, name: str) -> Any:
    files, path = store_of(folder)
    with files.open_input_file(f"{path}/{name}") as source:
        return pickle.loads(source.read_buffer())


def fields_of(df: DataFrame) -> str:
    """The columns of a frame as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class Memo:
    """Values of a function by key, of bounded number: the older half goes when the younger one is full.

    Keys longer than ``longest`` are computed each time. A worker serves one operator after another, so
    only the memo used last keeps its values.
    """

    _last: Memo | None = None

    def __init__(self, value_of: Callable, size: int, longest: int) -> None:
        self.value_of, self.size, self.longest = value_of, size // 2, longest
        self.young, self.old = _Kept(self), {}

    def all(self, keys: Iterable) -> list:
        if Memo._last is not self:
            if Memo._last is not None:
                Memo._last.young, Memo._last.old = _Kept(Memo._last), {}
            Memo._last = self
        if len(self.young) >= self.size:
            self.old, self.young = dict(self.young), _Kept(self)
        return list(map(self.young.__getitem__, keys))


class _Kept(dict):
    """The younger half; asks for what it does not have."""

    def __init__(self, memo: Memo) -> None:
        super().__init__()
        self.memo = memo

    def __missing__(self, key):
        memo = self.memo
        value = memo.old.get(key)
        if value is None:
            value = memo.value_of(key)
        if len(key) <= memo.longest:
            self[key] = value
        return value


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A file of the public tokenizers, or of another folder with the same files."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def map_groups(
    df: DataFrame, keys: list[str], start: Callable[[], Callable[[tuple, dict[str, list]], dict | None]], ddl: str
) -> DataFrame:
    """Apply a function to all rows of a key together; for many small groups of bounded size.

    The rows are dealt by the keys and sorted by them, and a task walks through its groups in order.
    """
    reach_workers(df.sparkSession)
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        made: list[dict] = []

        def result(key: tuple, rows: dict[str, list]) -> None:
            out = work(key, rows)
            if out is not None and len(next(iter(out.values()))):
                made.append(out)

        key, held = None, {n: [] for n in names}
        for batch in batches:
            columns = batch.to_pydict()
            row_keys = list(zip(*(columns[k] for k in keys)))
            low = 0
            for i in range(len(row_keys) + 1):
                if i < len(row_keys) and row_keys[i] == key:
                    continue
                for n in names:
                    held[n] += columns[n][low:i]
                low = i
                if i < len(row_keys):
                    if held[keys[0]]:
                        result(key, held)
                    key, held = row_keys[i], {n: [] for n in names}
            if made:
                yield _joined(made, arrow)
                made.clear()
        if held[keys[0]]:
            result(key, held)
        if made:
            yield _joined(made, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _joined(made: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for part in made for x in part[f.name]], type=f.type) for f in arrow], schema=arrow
    )


def levels_by_score(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic levels of (score, ones, n) rows: blocks of each range of scores, then of the blocks."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[float], list[float], list[float]] = ([], [], [])
        for batch in batches:
            held = pooled(*(old + new.to_pylist() for old, new in zip(held, batch.columns)))
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.float64()) for n, v in zip(("score", "ones", "n"), held)})

    once = scored.groupBy("score").agg(*(F.sum(n).cast("double").alias(n) for n in ("ones", "n")))
    blocks = once.orderBy("score").mapInArrow(pool, "score double, ones double, n double")
    rows = sorted((r["score"], r["ones"], r["n"]) for r in blocks.collect())
    return levels_of(pooled(*zip(*rows)))


def roots_of(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For items 0 .. count - 1 and links between them, the smallest item each hangs together with."""
    roots = np.arange(count)
    while len(left):
        a, b = roots[left], roots[right]
        if (a == b).all():
            break
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots != roots[roots]).any():
            roots = roots[roots]
    return roots
