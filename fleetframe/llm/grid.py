"""Two sets of vectors that all have to meet, as a grid of tasks.

Queries are dealt into groups that fit a task, candidates into spans. Every task is one cell of the grid: it
holds the queries of a group and reads the candidates of a span a chunk at a time, however many there
are. Queries are copied once per span and candidates once per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetframe.session import reach_workers

# Candidates that a task holds against its queries at a time.
CHUNK = 16_384
# Candidates of a span: at most this many, and not fewer than that many to occupy more tasks.
MOST_IN_SPAN = 1 << 20
LEAST_IN_SPAN = 2_048


class Meeting(Protocol):
    """What a task does with its queries, all of one vector length."""

    def add(self, rows: pa.Table, vectors: np.ndarray) -> None:
        """Take further candidates."""

    def result(self) -> dict[str, list | np.ndarray]:
        """The columns to return."""


def comparable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def spans_for(candidates: int, groups: int, tasks: int) -> int:
    """Spans for a number of candidates, so that there are about two cells for each of the tasks run at once."""
    by_size = -(-candidates // MOST_IN_SPAN)
    to_occupy = min(-(-candidates // LEAST_IN_SPAN), -(-2 * tasks // groups))
    return max(1, by_size, to_occupy)


def matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """Lists of one length as rows in double precision."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, length)


def by_length(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows and their vectors, split by the length of the vectors."""
    lengths = pa.compute.list_value_length(rows["embedding"]).to_numpy()
    for length in np.unique(lengths).tolist():
        part = rows if (lengths == length).all() else rows.filter(pa.array(lengths == length))
        yield part, matrix(part["embedding"], length)


def met(
    queries: DataFrame,
    candidates: DataFrame,
    groups: int,
    spans: int,
    start: Callable[[pa.Table, np.ndarray], Meeting],
    ddl: str,
) -> DataFrame:
    """The results of all cells.

    ``queries`` have a column ``group`` from 0 to ``groups`` - 1, and both sides ``row``, by which candidates
    are dealt, and ``embedding``. Vectors of different lengths do not meet.
    """
    reach_workers(queries.sparkSession)
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    asking = queries.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).withColumn("side", F.lit(0))
    asked = (
        candidates.withColumn("span", F.pmod(F.xxhash64("row"), F.lit(spans)).cast("int"))
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        .withColumn("side", F.lit(1))
    )
    cells = (
        asking.unionByName(asked, allowMissingColumns=True)
        .withColumn("cell", (F.col("group") * spans + F.col("span")).cast("int"))
        .repartitionById(groups * spans, "cell")
        .drop("cell", "group", "span")
        .sortWithinPartitions("side")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        meetings: dict[int, Meeting] | None = None

        def meet() -> None:
            if waiting:
                for part, vectors in by_length(pa.Table.from_batches(waiting)):
                    if vectors.shape[1] in meetings:
                        meetings[vectors.shape[1]].add(part, vectors)
                waiting.clear()

        for batch in batches:
            first = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if first:
                asking.append(batch.slice(0, first))
            if first == batch.num_rows or not asking:
                continue
            if meetings is None:
                parts = by_length(pa.Table.from_batches(asking))
                meetings = {vectors.shape[1]: start(part, vectors) for part, vectors in parts}
            for low in range(first, batch.num_rows, CHUNK):
                waiting.append(batch.slice(low, CHUNK))
                if sum(part.num_rows for part in waiting) >= CHUNK:
                    meet()
        if meetings is None:
            return
        meet()
        for meeting in meetings.values():
            columns = meeting.result()
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return cells.mapInArrow(run, schema)
