"""Nearest vectors by inner product: a block matrix join over int8 codes with error bounds.

Equal vectors are first reduced to one with its smallest ids, as many as can be asked for. Queries and
candidates meet in a grid of tasks (``llm.grid``). A task codes its vectors as multiples of a step of their
own in int8 and keeps the length of what coding loses, so that the product of two codes tells the inner
product up to |x - x'| |y| + |x'| |y - y'|. Tiles of such products are made exactly; a pair whose upper
bound reaches what the query is already sure of is computed anew in double precision, component after
component, and enters the query's heap. Heaps of all spans are merged by a heap per query. No pair that
could be among the nearest is passed over: the answer is that of comparing everything.

A vector that is null, empty, zero, or holds a null or a number that is not finite takes no part, nor does
a row without an id; vectors of different lengths do not meet. A row is not its own neighbour, but a
repeated row is. Ties go to the smaller id. Products beyond double precision count as infinite. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe.llm.common import map_groups
from fleetframe.llm.grid import Meeting, comparable, met, spans_for

NEIGHBOURS = 20
# Queries that one task holds.
QUERIES_AT_ONCE = 65_536
# Queries and candidates of a tile.
TILE = (1_024, 4_096)
# Components whose products are added up in single precision without rounding: 1024 * 127 * 127 < 2 ** 24.
EXACT_COMPONENTS = 1_024
# Pairs computed anew at a time.
PAIRS_AT_ONCE = 16_384
# Part by which rounding may move a bound.
ROUNDING = 1e-9


class Coded:
    """Vectors, their int8 codes, the step of each, and lengths of the vector, the code and the loss."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        largest = np.abs(vectors).max(axis=1)
        self.step = np.maximum(largest, np.finfo(np.float64).tiny) / 127
        # Lengths are taken of scaled rows, so that squares neither vanish nor overflow.
        scaled = vectors / self.step[:, None]
        self.codes = np.rint(scaled).astype(np.int8)
        with np.errstate(over="ignore"):
            self.size = np.sqrt(np.einsum("ij,ij->i", scaled, scaled)) * self.step
            coded = self.codes.astype(np.float64)
            self.coded_size = np.sqrt(np.einsum("ij,ij->i", coded, coded)) * self.step
            lost = scaled - coded
            self.lost = np.sqrt(np.einsum("ij,ij->i", lost, lost)) * self.step

    def part(self, low: int, high: int) -> Coded:
        out = object.__new__(Coded)
        for name, value in vars(self).items():
            setattr(out, name, value[low:high])
        return out


def code_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of int8 rows, exactly."""
    total = 0.0
    for low in range(0, left.shape[1], EXACT_COMPONENTS):
        a, b = (x[:, low : low + EXACT_COMPONENTS].astype(np.float32) for x in (left, right))
        total = total + (a @ b.T).astype(np.float64)
    return total


def bounds(left: Coded, right: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products."""
    with np.errstate(over="ignore", invalid="ignore"):
        about = code_products(left.codes, right.codes) * left.step[:, None] * right.step[None, :]
        off = np.outer(left.size, right.lost) + np.outer(left.lost, right.coded_size)
        off += ROUNDING * np.outer(left.size, right.size)
        lower, upper = about - off, about + off
    # Where a bound is beyond double precision nothing is known.
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up component after component, whatever rows are beside them."""
    out = np.empty(len(left))
    with np.errstate(over="ignore", invalid="ignore"):
        for low in range(0, len(left), PAIRS_AT_ONCE):
            terms = np.ascontiguousarray((left[low : low + PAIRS_AT_ONCE] * right[low : low + PAIRS_AT_ONCE]).T)
            total = np.zeros(terms.shape[1])
            for term in terms:
                total += term
            out[low : low + PAIRS_AT_ONCE] = total
    return np.where(np.isnan(out), -np.inf, out)


class NearestInSpan(Meeting):
    """A heap of the nearest classes for each query; entries are score, negated first id, further ids."""

    def __init__(self, queries: pa.Table, vectors: np.ndarray, wanted: int) -> None:
        self.keys = queries["row"].to_pylist(), queries["second"].to_pylist()
        self.queries, self.wanted = Coded(vectors), wanted
        self.heaps: list[list[tuple]] = [[] for _ in vectors]
        # What the last of the nearest has at least.
        self.level = np.full(len(vectors), -np.inf)

    def add(self, rows: pa.Table, vectors: np.ndarray) -> None:
        candidates = Coded(vectors)
        ids = rows["ids"].to_pylist()
        own = list(zip(rows["row"].to_pylist(), rows["second"].to_pylist()))
        for low in range(0, len(vectors), TILE[1]):
            right = candidates.part(low, low + TILE[1])
            for at in range(0, len(self.heaps), TILE[0]):
                self._tile(at, low, right, ids, own)

    def _tile(self, at: int, low: int, right: Coded, ids: list[list[int]], own: list[tuple]) -> None:
        left = self.queries.part(at, at + TILE[0])
        lower, upper = bounds(left, right)
        level = self.level[at : at + TILE[0]]
        if lower.shape[1] >= self.wanted and np.isneginf(level).any():
            np.maximum(level, np.partition(lower, -self.wanted, axis=1)[:, -self.wanted], out=level)
        near = upper >= level[:, None]
        if near.sum() > 4 * self.wanted * len(level):
            near &= self._closer(left, right, level)
        asking, asked = np.nonzero(near)
        scores = products(left.vectors[asking], right.vectors[asked])
        for q, c, score in zip((asking + at).tolist(), (asked + low).tolist(), scores.tolist()):
            heap = self.heaps[q]
            entry = (score, -ids[c][0], own[c], ids[c])
            if len(heap) < self.wanted:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for q in np.unique(asking).tolist():
            if len(self.heaps[q + at]) == self.wanted:
                level[q] = max(level[q], self.heaps[q + at][0][0])

    def _closer(self, left: Coded, right: Coded, level: np.ndarray) -> np.ndarray:
        """Bounds by products in double precision, for tiles in which codes tell too little apart."""
        with np.errstate(over="ignore", invalid="ignore"):
            about = left.vectors @ right.vectors.T
            off = 4 * (left.vectors.shape[1] + 8) * np.finfo(np.float64).eps * np.outer(left.size, right.size)
            lower = about - off
            upper = about + off
        if lower.shape[1] >= self.wanted:
            lower = np.where(np.isnan(lower), -np.inf, lower)
            np.maximum(level, np.partition(lower, -self.wanted, axis=1)[:, -self.wanted], out=level)
        return ~(upper < level[:, None])

    def result(self) -> dict[str, list]:
        out = {name: [] for name in ("row", "second", "score", "same", "ids")}
        for row, second, heap in zip(*self.keys, self.heaps):
            for score, _, own, ids in heap:
                out["row"].append(row)
                out["second"].append(second)
                out["score"].append(score)
                out["same"].append(own == (row, second))
                out["ids"].append(ids)
        return out


def _merged(wanted: int):
    """Merge the neighbours that a query found in all spans, in order of score and id."""

    def start():
        def work(key: tuple, rows: dict[str, list]) -> dict[str, list]:
            ordered = [
                [(-score, i, same) for i in ids] for score, same, ids in zip(rows["score"], rows["same"], rows["ids"])
            ]
            best = list(islice(heapq.merge(*ordered), wanted))
            return {
                "row": [key[0]],
                "second": [key[1]],
                "found": [[{"vec_id": i, "score": 0.0 - minus, "same": same} for minus, i, same in best]],
            }

        return work

    return start


def nearest(
    vectors: DataFrame, asks: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of every row for which ``asks`` holds."""
    spark = vectors.sparkSession
    kind = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    value = F.col("embedding")
    rows = (
        vectors.select(
            F.col(id_col).cast("bigint").alias("vec_id"),
            # Minus zero counts as zero, so that equal vectors have equal hashes.
            F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind)).alias("embedding"),
            F.coalesce(asks, F.lit(False)).alias("asks"),
        )
        .filter(F.col("vec_id").isNotNull() & comparable(value) & F.exists(value, lambda x: x != 0))
        # Two hashes with different beginnings name a vector by 128 bits.
        .withColumn("row", F.xxhash64("embedding"))
        .withColumn("second", F.xxhash64(F.lit(1), "embedding"))
    )
    key = ["row", "second"]
    # A class is in the answer with no more ids than are asked for, and the query's own.
    smallest = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    classes = (
        rows.select("vec_id", "embedding", *key)
        .withColumn("n", smallest)
        .filter(F.col("n") <= k + 1)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("embedding").alias("embedding"))
    )
    asking = rows.filter("asks")
    total, queries = vectors.count(), vectors.filter(asks).count()
    groups = max(1, -(-queries // QUERIES_AT_ONCE))
    spans = spans_for(total, groups, spark.sparkContext.defaultParallelism)
    query_classes = (
        asking.groupBy(*key)
        .agg(F.any_value("embedding").alias("embedding"))
        .withColumn("group", F.pmod(F.xxhash64("second"), F.lit(groups)).cast("int"))
    )
    found = met(
        query_classes,
        classes,
        groups,
        spans,
        lambda part, held: NearestInSpan(part, held, k + 1),
        "row bigint, second bigint, score double, same boolean, ids array<bigint>",
    )
    merged = map_groups(
        found,
        key,
        _merged(k + 1),
        "row bigint, second bigint, found array<struct<vec_id: bigint, score: double, same: boolean>>",
    )
    # The query's own row is the first of its class with its id; without it the list is one too long.
    is_own = lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))
    answers = (
        asking.select(F.col("vec_id").alias("query_id"), *key)
        .join(merged, key)
        .withColumn("own", F.array_position(F.transform("found", is_own), F.lit(True)))
        .withColumn("others", F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k))
    )
    return answers.select("query_id", F.posexplode("others").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
