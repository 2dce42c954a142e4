"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors are first reduced to one with a weight. Centres come from a bounded sample. Every vector
lives in the cell of its nearest centre. The angles of two vectors with the plane between their two
centres add up to no more than the angle between them, so one of both angles is at most half the angle of
the threshold: a vector visits all cells for which its own is, and no link is missed. Within a cell,
residents are compared with each other and with visitors by products of blocks in double precision. Two
vectors may meet in two cells, and the link counts in one of them only. A cell of any size is split into
blocks, and each pair of blocks that has residents is a task's work, of which only counts and a spanning
forest leave the task.

A vector that is null, zero, or holds a null or a number that is not finite, is linked with nothing,
and vectors of different lengths are not linked. Repeated rows are vectors of their own and linked
with each other. A null id has no component. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetframe.llm.common import SAMPLE_SEED
from fleetframe.plans.components import components
from fleetframe.session import stored

THRESHOLD = 0.9
# Bounds of the fit: vectors in the sample, centres, passes.
SAMPLE_VECTORS = 16_000
MOST_CENTRES = 2_048
PASSES = 8
# Vectors of a cell that are compared with as many others at once.
BLOCK = 2_000
# Vectors that are held against all centres at once.
PLACED_AT_ONCE = 1_024
# Distance from a plane within which rounding could hide a link.
ROUNDING = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def usable(vector) -> bool:
    """Whether a vector (a list or None) can be linked."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return False
    values = np.asarray(vector, dtype=np.float64)
    return bool(np.isfinite(values).all() and values.any())


def spherical_kmeans(rows: np.ndarray, centres: int, passes: int = PASSES, seed: int = 5) -> np.ndarray:
    """Centres of length one; a centre without vectors keeps its place."""
    rng = np.random.default_rng(seed)
    found = rows[rng.choice(len(rows), size=min(centres, len(rows)), replace=False)].copy()
    for _ in range(passes):
        sums = np.zeros_like(found)
        for low in range(0, len(rows), 4096):
            part = rows[low : low + 4096]
            np.add.at(sums, (part @ found.T).argmax(axis=1), part)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), found)
    return found


def fit_centres(
    classes: DataFrame, total: int, sample_vectors: int = SAMPLE_VECTORS, most_centres: int = MOST_CENTRES
) -> dict[int, np.ndarray]:
    """Centres for each vector length in a sample of at most ``sample_vectors`` classes.

    There are about as many centres as the root of the number of classes.
    """
    sample = classes.orderBy(F.xxhash64("class", F.lit(SAMPLE_SEED)), "class").limit(sample_vectors)
    vectors = sample.select("embedding").toPandas()["embedding"].tolist()
    centres = min(most_centres, max(1, math.isqrt(total)))
    by_length: dict[int, list] = {}
    for v in vectors:
        by_length.setdefault(len(v), []).append(v)
    return {n: spherical_kmeans(unit(np.array(rows, dtype=np.float64)), centres) for n, rows in by_length.items()}


def visited(rows: np.ndarray, centres: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each vector, and whether it belongs to each cell; ``apart`` holds distances of centres."""
    near = rows @ centres.T
    own = near.argmax(axis=1)
    # Sine of half the angle of the threshold.
    half = math.sqrt(max(0.0, (1 - threshold) / 2))
    return own, near[np.arange(len(rows)), own][:, None] - near <= half * apart[own] + ROUNDING


def placed(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(class, weight, embedding, cells): the own cell first, then those visited."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart = {n: np.sqrt(np.maximum(0, 2 * (1 - c @ c.T))) for n, c in centres.items()}
        for batch in batches:
            cells: list = [None] * len(batch)
            lengths = batch["embedding"].map(len).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                # A length outside the sample has a single cell of its own.
                if length not in centres:
                    for i in at.tolist():
                        cells[i] = [int(length) << 32]
                    continue
                for low in range(0, len(at), PLACED_AT_ONCE):
                    part = at[low : low + PLACED_AT_ONCE]
                    rows = unit(np.array([batch["embedding"].iat[i] for i in part], dtype=np.float64))
                    own, there = visited(rows, centres[length], apart[length], threshold)
                    there[np.arange(len(part)), own] = False
                    for i, home, row in zip(part.tolist(), own.tolist(), there):
                        cells[i] = [int(length) << 32 | c for c in (home, *np.flatnonzero(row).tolist())]
            yield batch.assign(cells=cells)

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInPandas(place, f"class bigint, embedding {kind}, weight bigint, cells array<bigint>")


def _linked(left: pd.DataFrame, right: pd.DataFrame, cell: int, threshold: float) -> np.ndarray:
    """Which vectors of two blocks are linked in this cell."""
    a, b = (unit(np.array(x["embedding"].tolist(), dtype=np.float64)) for x in (left, right))
    close = a @ b.T >= threshold
    home_a, home_b = (x["home"].to_numpy() for x in (left, right))
    # Of two visitors, or two that also meet in a lower cell, this cell says nothing.
    close &= (home_a == cell)[:, None] | (home_b == cell)[None, :]
    for block, homes, others, turned in ((left, home_a, home_b, False), (right, home_b, home_a, True)):
        view = close.T if turned else close
        for i in np.flatnonzero(homes == cell).tolist():
            lower = others[view[i]]
            lower = lower[lower < cell]
            if len(lower):
                view[i] &= ~np.isin(others, [c for c in block["cells"].iat[i] if c < cell])
    return close


def compare_blocks(part: pd.DataFrame, cell: int, first: int, second: int, threshold: float) -> pd.DataFrame:
    """Links of each class in a pair of blocks, and the smallest class it hangs together with there."""
    left = part[part["block"] == first].sort_values("class").reset_index(drop=True)
    same = first == second
    right = left if same else part[part["block"] == second].sort_values("class").reset_index(drop=True)
    if not len(left) or not len(right):
        return pd.DataFrame({"class": [], "links": [], "root": []}).astype("int64")
    close = _linked(left, right, cell, threshold)
    if same:
        np.fill_diagonal(close, False)
    ids = left["class"].to_numpy(), right["class"].to_numpy()
    links = close @ right["weight"].to_numpy(), close.T @ left["weight"].to_numpy()
    roots = [x.copy() for x in ids]
    while True:
        before = [x.copy() for x in roots]
        low = np.where(close, roots[1][None, :], np.iinfo(np.int64).max).min(axis=1)
        roots[0] = np.minimum(roots[0], low)
        low = np.where(close, roots[0][:, None], np.iinfo(np.int64).max).min(axis=0)
        roots[1] = np.minimum(roots[1], low)
        if same:
            roots[0] = roots[1] = np.minimum(roots[0], roots[1])
        if all((x == y).all() for x, y in zip(before, roots)):
            break
    sides = [0] if same else [0, 1]
    rows = pd.DataFrame(
        {
            "class": np.concatenate([ids[s] for s in sides]),
            "links": np.concatenate([links[s] for s in sides]),
            "root": np.concatenate([roots[s] for s in sides]),
        }
    )
    return rows[rows["links"] > 0]


def grouped(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, number of vectors linked directly, component, whether it is kept."""
    # Vectors travel in the precision they came in; products are made in double precision.
    kind = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding")
    )
    value = F.col("embedding")
    fit = (
        value.isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(value, lambda x: x != 0)
    )
    keyed = rows.select(
        "vec_id",
        F.when(F.coalesce(fit, F.lit(False)), value).alias("embedding"),
    ).withColumn("class", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0).cast(kind)))))
    classes = stored(
        keyed.filter("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"))
        .select("class", "embedding", "weight")
    )
    members = keyed.select("vec_id", "class")
    total = classes.count()
    if not total:
        return _result(members, None)
    centres = fit_centres(classes, total)
    # Only residents are asked for their cells.
    in_cells = (
        stored(placed(classes, centres, threshold))
        .select("class", "embedding", "weight", "cells", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
        .withColumn("resident", F.col("cell") == F.col("home"))
        .withColumn("cells", F.when(F.col("resident"), F.col("cells")))
    )
    # One row per cell: at most the centres and one more per vector length. Blocks of residents, then of visitors.
    sizes = in_cells.groupBy("cell").agg(
        F.ceil(F.count_if("resident") / F.lit(block)).cast("int").alias("own_blocks"),
        F.ceil(F.count_if(~F.col("resident")) / F.lit(block)).cast("int").alias("guest_blocks"),
    )
    dealt = F.xxhash64("class", F.lit(1))
    numbered = (
        in_cells.join(sizes.filter("own_blocks > 0"), "cell")
        .withColumn(
            "block",
            F.when(F.col("resident"), F.pmod(dealt, F.col("own_blocks")))
            .otherwise(F.col("own_blocks") + F.pmod(dealt, F.greatest("guest_blocks", F.lit(1))))
            .cast("int"),
        )
        .withColumn("partners", F.col("own_blocks") + F.when(F.col("resident"), F.col("guest_blocks")).otherwise(0))
    )
    units = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partners") - 1))).select(
        "cell",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block",
        "class",
        "embedding",
        "weight",
        "home",
        "cells",
    )

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return compare_blocks(part, int(key[0]), int(key[1]), int(key[2]), threshold)

    found = stored(
        units.groupBy("cell", "first", "second").applyInPandas(compare, "class bigint, links bigint, root bigint")
    )
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.filter("class <> root"), "class", "root")
    weights = classes.select("class", "weight")
    linked = (
        weights.join(links, "class", "left")
        .join(parts.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "class",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("component", "class").alias("part"),
        )
    )
    return _result(members, linked)


def _result(members: DataFrame, linked: DataFrame | None) -> DataFrame:
    if linked is None:
        named = members.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("least"))
    else:
        placed_rows = members.join(linked, "class", "left")
        least = (
            placed_rows.filter("part IS NOT NULL").groupBy("part").agg(F.min("vec_id").alias("least"))
        )
        named = placed_rows.join(least, "part", "left").select(
            "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), "least"
        )
    return named.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))).select(
        "vec_id",
        "n_links",
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
