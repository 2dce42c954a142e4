"""Hard negatives: for an anchor and one of its positives, the best rows of another label just below it.

Vectors become whole numbers, so scores are exact. Anchors are clustered by direction. Anchors and all rows meet
in a grid of tasks (``llm.grid``); a task sorts its candidates once per cluster of its anchors, by the largest
inner product that the angles allow with any member of length one: |c| * cos(angle of c and the centre
- widest angle of a member and the centre). Every member walks that shared list in growing blocks and stops
when its own length times the bound of the next candidate is below what it still needs. A first walk,
over rows of the member's label, finds its positives; a second one, over the others, finds for each
positive the best scores between ``least`` times its score and its score. The best of all spans are merged
by windows. Nothing is left out: a stop is certified, and a list whose bounds tell nothing is walked to
its end.

Rows without id or label, and vectors that are null, empty, or hold a null or a number that is not finite take no
part; a zero vector does, with score 0. Vectors of different lengths do not meet. Repeated rows are rows of
their own: they are each other's candidates, and each has its results. Ties go to the smaller id. Scores
beyond the range of a long count as its nearest end. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe.llm.common import SAMPLE_SEED
from fleetframe.llm.embedding_dedup import spherical_kmeans, unit
from fleetframe.llm.grid import Meeting, comparable, met, spans_for
from fleetframe.session import reach_workers, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# Least score of a negative as a fraction of its positive's.
LEAST = (80, 100)
# Bounds of the fit: anchors in the sample, clusters.
SAMPLE_ANCHORS = 16_000
MOST_CLUSTERS = 512
# Anchors that one task holds.
ANCHORS_AT_ONCE = 32_768
# Candidates of the first and of the largest block of a walk.
FIRST_BLOCK, LARGEST_BLOCK = 256, 4_096
# Part of the lengths by which rounding may move a bound.
ROUNDING = 1e-6
# Whole numbers up to here are exact in double precision.
EXACT = 2**53
LONG = np.iinfo(np.int64)


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled components, rounded down."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(vectors * scale))


def scores_of(left: np.ndarray, right: np.ndarray, largest: float) -> np.ndarray:
    """All inner products of rows of whole numbers; ``largest`` bounds their size."""
    if largest < EXACT:
        return (left @ right.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in side.tolist()] for side in (left, right))
    return np.array(
        [[min(max(sum(map(int.__mul__, x, y)), LONG.min + 1), LONG.max) for y in b] for x in a], dtype=np.int64
    ).reshape(len(a), len(b))


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows; rows are scaled first, so that squares do not overflow."""
    largest = np.maximum(np.abs(rows).max(axis=1), 1)
    scaled = rows / largest[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(np.sqrt(np.einsum("ij,ij->i", scaled, scaled)) * largest, np.finfo(np.float64).max)


class Best:
    """The best scores of each slot with the ids they belong to; ties go to the smaller id."""

    def __init__(self, slots: int, wanted: int) -> None:
        self.scores = np.full((slots, wanted), LONG.min)
        self.ids = np.full((slots, wanted), LONG.max)

    def better(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (a row per slot, a column per id) would enter."""
        last, last_id = self.scores[slots, -1][:, None], self.ids[slots, -1][:, None]
        return (scores > last) | ((scores == last) & (ids[None, :] < last_id) & (scores > LONG.min))

    def take(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Enter scores, each with its slot and id."""
        if not len(slots):
            return
        touched = np.unique(slots)
        wanted = self.scores.shape[1]
        owner = np.concatenate([slots, np.repeat(touched, wanted)])
        score = np.concatenate([scores, self.scores[touched].ravel()])
        named = np.concatenate([ids, self.ids[touched].ravel()])
        # No score is as low as the lowest long, so it can be turned round.
        order = np.lexsort((named, -np.maximum(score, LONG.min + 1), owner))
        owner, score, named = owner[order], score[order], named[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < wanted
        self.scores[owner[kept], place[kept]] = score[kept]
        self.ids[owner[kept], place[kept]] = named[kept]


class SharedLists(Meeting):
    """Clusters of anchors and the walks of their members over shared lists of candidates."""

    def __init__(self, anchors: pa.Table, vectors: np.ndarray, scale: int) -> None:
        self.scale = scale
        self.rows = anchors["row"].to_numpy()
        self.labels = np.array(anchors["label"].to_pylist(), dtype=object)
        self.whole = whole(vectors, scale)
        self.size = _lengths(self.whole)
        # Members, centre and cosine of the widest angle to it.
        self.clusters: list[tuple[np.ndarray, np.ndarray, float]] = []
        cluster = anchors["cluster"].to_numpy()
        for c in np.unique(cluster).tolist():
            members = np.flatnonzero(cluster == c)
            directions = unit(self.whole[members[self.size[members] > 0]]) if self.size[members].any() else None
            if directions is None:
                self.clusters.append((members, np.zeros(vectors.shape[1]), 1.0))
                continue
            centre = directions.sum(axis=0)
            reach = float(np.linalg.norm(centre))
            centre = centre / reach if reach > 1e-9 else directions[0]
            self.clusters.append((members, centre, float(np.clip((directions @ centre).min(), -1, 1))))

    def add(self, rows: pa.Table, vectors: np.ndarray) -> None:
        candidates = whole(vectors, self.scale)
        size = _lengths(candidates)
        ids, own = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        labels = np.array(rows["label"].to_pylist(), dtype=object)
        for members, centre, widest in self.clusters:
            directed = size > 0
            cosine = np.ones(len(size))
            cosine[directed] = np.clip(unit(candidates[directed]) @ centre, -1, 1)
            off = math.sqrt(max(0.0, 1 - widest * widest))
            apart = cosine * widest + np.sqrt(1 - cosine * cosine) * off
            bound = size * (np.where(cosine >= widest, 1.0, apart) + ROUNDING)
            order = np.lexsort((ids, -bound))
            listed = (candidates[order], size[order], bound[order], ids[order], own[order], labels[order])
            for some, chosen in self.lists(members, listed[-1]):
                self._walk(some, [x if chosen is None else x[chosen] for x in listed])

    def lists(self, members: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Members that walk together, and which part of the list they walk."""
        raise NotImplementedError

    def needed(self, members: np.ndarray) -> np.ndarray:
        """The least score that can still change a member's result."""
        raise NotImplementedError

    def take(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, labels: np.ndarray) -> None:
        raise NotImplementedError

    def _walk(self, members: np.ndarray, listed: list[np.ndarray]) -> None:
        candidates, size, bound, ids, own, labels = listed
        low, step = 0, FIRST_BLOCK
        while low < len(bound):
            with np.errstate(over="ignore", invalid="ignore"):
                members = members[self.size[members] * bound[low] >= self.needed(members)]
            if not len(members):
                return
            block = slice(low, low + step)
            with np.errstate(over="ignore"):
                largest = float(self.size[members].max() * size[block].max())
            scores = scores_of(self.whole[members], candidates[block], largest)
            self.take(members, scores, ids[block], own[block], labels[block])
            low, step = low + step, min(2 * step, LARGEST_BLOCK)


class Positives(SharedLists):
    """The best other rows of the anchor's label."""

    def __init__(self, anchors: pa.Table, vectors: np.ndarray, scale: int, wanted: int) -> None:
        super().__init__(anchors, vectors, scale)
        self.best = Best(len(vectors), wanted)

    def lists(self, members: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        for label in set(self.labels[members].tolist()):
            yield members[self.labels[members] == label], np.flatnonzero(labels == label)

    def needed(self, members: np.ndarray) -> np.ndarray:
        last = self.best.scores[members, -1]
        return np.where(last == LONG.min, -np.inf, last.astype(np.float64))

    def take(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, labels: np.ndarray) -> None:
        enters = self.best.better(members, scores, ids) & (own[None, :] != self.rows[members][:, None])
        at, c = np.nonzero(enters)
        self.best.take(members[at], scores[at, c], ids[c])

    def result(self) -> dict[str, np.ndarray]:
        at, place = np.nonzero(self.best.scores > LONG.min)
        return {"row": self.rows[at], "positive_id": self.best.ids[at, place], "positive_score": self.best.scores[at, place]}


class Negatives(SharedLists):
    """For each positive of an anchor the best rows of another label within its range of scores."""

    def __init__(self, anchors: pa.Table, vectors: np.ndarray, scale: int, wanted: int, least: tuple[int, int]) -> None:
        super().__init__(anchors, vectors, scale)
        highest = anchors["highest"].to_pylist()
        self.places = max(map(len, highest))
        self.best = Best(len(vectors) * self.places, wanted)
        # Without a positive, or with a negative score, no score is in the range.
        self.high = np.full((len(vectors), self.places), LONG.min)
        self.low = np.full((len(vectors), self.places), LONG.max)
        for i, scores in enumerate(highest):
            for j, score in enumerate(scores):
                if score >= 0:
                    self.high[i, j], self.low[i, j] = score, -(-least[0] * score // least[1])

    def lists(self, members: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        yield members, None

    def _needed(self, members: np.ndarray) -> np.ndarray:
        """A row per member, a column per positive; for a positive that can have none, the highest long."""
        last = self.best.scores[:, -1].reshape(-1, self.places)[members]
        return np.maximum(last, self.low[members])

    def needed(self, members: np.ndarray) -> np.ndarray:
        least = self._needed(members)
        return np.where(least == LONG.max, np.inf, least.astype(np.float64)).min(axis=1)

    def take(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, labels: np.ndarray) -> None:
        least = self._needed(members)
        # Only scores that are high enough for some positive are looked at one by one.
        at, c = np.nonzero((scores >= least.min(axis=1)[:, None]) & (scores <= self.high[members].max(axis=1)[:, None]))
        differs = self.labels[members][at] != labels[c]
        at, c = at[differs], c[differs]
        score, named = scores[at, c], ids[c]
        for j in range(self.places):
            slots = members[at] * self.places + j
            last, last_id = self.best.scores[slots, -1], self.best.ids[slots, -1]
            enters = (score <= self.high[members[at], j]) & (score >= self.low[members[at], j])
            enters &= (score > last) | ((score == last) & (named < last_id))
            self.best.take(slots[enters], score[enters], named[enters])

    def result(self) -> dict[str, np.ndarray]:
        slot, place = np.nonzero(self.best.scores > LONG.min)
        return {
            "row": self.rows[slot // self.places],
            "place": slot % self.places,
            "negative_id": self.best.ids[slot, place],
            "negative_score": self.best.scores[slot, place],
        }


def fit_centres(anchors: DataFrame, total: int, scale: int) -> dict[int, np.ndarray]:
    """Directions for each vector length, about as many as the root of the number of anchors."""
    sample = anchors.orderBy(F.xxhash64("vec_id", F.lit(SAMPLE_SEED)), "vec_id").limit(SAMPLE_ANCHORS)
    by_length: dict[int, list] = {}
    for vector in sample.select("embedding").toPandas()["embedding"]:
        by_length.setdefault(len(vector), []).append(vector)
    wanted = min(MOST_CLUSTERS, max(1, math.isqrt(total)))
    out = {}
    for length, rows in by_length.items():
        numbers = whole(np.array(rows, dtype=np.float64), scale)
        numbers = numbers[np.abs(numbers).max(axis=1) > 0]
        if len(numbers):
            out[length] = spherical_kmeans(unit(numbers), wanted)
    return out


def clustered(anchors: DataFrame, centres: dict[int, np.ndarray], scale: int) -> DataFrame:
    """Anchors with the number of the centre nearest in direction; 0 where there is none."""
    reach_workers(anchors.sparkSession)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster = np.zeros(len(batch), dtype=np.int32)
            lengths = batch["embedding"].map(len).to_numpy()
            for length, there in centres.items():
                at = np.flatnonzero(lengths == length)
                if len(at):
                    numbers = whole(np.array(batch["embedding"].iloc[at].tolist(), dtype=np.float64), scale)
                    cluster[at] = (numbers / np.maximum(np.abs(numbers).max(axis=1, keepdims=True), 1) @ there.T).argmax(axis=1)
            yield batch.assign(cluster=cluster)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInPandas(place, f"{fields}, cluster int")


def grouped_for_tasks(anchors: DataFrame) -> tuple[DataFrame, int]:
    """Anchors with the group of their cluster, and the number of groups.

    Small clusters share a group, one too large for a task is dealt over several.
    """
    sizes = anchors.groupBy("cluster").count().orderBy("cluster").collect()  # at most MOST_CLUSTERS rows
    first, filled, deal = 0, 0, []
    for row in sizes:
        parts = -(-row["count"] // ANCHORS_AT_ONCE)
        if filled and (parts > 1 or filled + row["count"] > ANCHORS_AT_ONCE):
            first, filled = first + 1, 0
        deal.append((row["cluster"], first, parts))
        if parts > 1:
            first += parts
        else:
            filled += row["count"]
    groups = first + (1 if filled else 0)
    spark = anchors.sparkSession
    dealt = F.broadcast(spark.createDataFrame(deal, "cluster int, first int, parts int"))
    group = (F.col("first") + F.pmod(F.xxhash64("row", F.lit(2)), "parts")).cast("int")
    return anchors.join(dealt, "cluster").withColumn("group", group).drop("first", "parts"), max(1, groups)


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: tuple[int, int] = LEAST,
    scale: int = SCALE,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Negatives of a positive with score s have scores n with ``least[0]`` * s <= ``least[1]`` * n <= ``least[1]`` * s.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    rows = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("bigint").alias("vec_id"),
            F.col(label_col).alias("label"),
            F.col(vector_col).cast(f"array<{kind}>").alias("embedding"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("embedding")))
    )
    total = rows.count()
    asking = rows.filter("asks").drop("asks")
    anchors = stored(clustered(asking, fit_centres(asking, asking.count(), scale), scale))
    in_groups, groups = grouped_for_tasks(anchors)
    spans = spans_for(total, groups, spark.sparkContext.defaultParallelism)
    candidates = rows.drop("asks")

    found = met(
        in_groups,
        candidates,
        groups,
        spans,
        lambda part, held: Positives(part, held, scale, positives),
        "row bigint, positive_id bigint, positive_score bigint",
    )
    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (
        found.withColumn("place", F.row_number().over(best) - 1)
        .filter(F.col("place") < positives)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positive"))
    )
    # At most ``positives`` entries an anchor.
    paired = stored(
        in_groups.join(chosen, "row").withColumn("highest", F.transform("positive", lambda x: x["positive_score"]))
    )
    near = met(
        paired.drop("positive"),
        candidates,
        groups,
        spans,
        lambda part, held: Negatives(part, held, scale, negatives, least),
        "row bigint, place int, negative_id bigint, negative_score bigint",
    )
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = paired.select("row", F.col("vec_id").alias("anchor_id"), F.explode("positive").alias("p"))
    return (
        ranked.join(pairs.withColumn("place", F.col("p.place")), ["row", "place"])
        .select("anchor_id", "p.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "p.positive_score", "negative_score")
    )
