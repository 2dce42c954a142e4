"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetframe.session import stored

# Links that one task settles at the end.
LAST_LINKS = 50_000


def components(links: DataFrame, left: str, right: str, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Each round, a node goes over to the node with the lowest random number among itself and its
    neighbours, and links are redrawn between the nodes that were gone over to. Those numbers are
    new in each round, so chains shrink by a constant factor like anything else, and the rounds
    grow with the logarithm of the longest chain. A node with very many links is reduced to partial
    minima before the shuffle. What is left of at most ``last_links`` links is settled by one task.
    Links with a null end and links to itself only name their nodes.
    """
    ends = links.select(F.col(left).alias("node"), F.col(right).alias("other"))
    known = stored(ends.filter("node IS NOT NULL OR other IS NOT NULL").distinct())
    both = known.union(known.select(F.col("other").alias("node"), F.col("node").alias("other")))
    nodes = both.select("node").filter("node IS NOT NULL").distinct()
    live = both.filter("node IS NOT NULL AND other IS NOT NULL AND node <> other").distinct()
    left_over = known.filter("node <> other").count() * 2
    labels = None
    turn = 0
    while left_over > 2 * last_links:
        turn += 1
        number = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("n"), F.col(c).alias("to"))  # noqa: B023, E731
        lowest = live.groupBy("node").agg(F.min(number("other")).alias("low"))
        goes = stored(
            lowest.select("node", F.least(number("node"), F.col("low"))["to"].alias("to")).filter("node <> to")
        )
        labels = _moved(nodes if labels is None else labels, goes, labels is None)
        for end in ("node", "other"):
            moves = goes.select(F.col("node").alias(end), "to")
            live = live.join(moves, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = stored(live.filter("node <> other").distinct())
        left_over = live.count()
    if left_over:
        kind = live.schema["node"].dataType.simpleString()
        goes = stored(
            live.filter("node < other").coalesce(1).mapInPandas(_settled, f"node {kind}, to {kind}")
        )
        labels = _moved(nodes if labels is None else labels, goes, labels is None)
    if labels is None:
        return nodes.withColumn("component", F.col("node"))
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(least, "at").select("node", "component")


def _moved(labels: DataFrame, goes: DataFrame, first: bool) -> DataFrame:
    """Nodes with where they are after a round."""
    if first:
        labels = labels.withColumn("at", F.col("node"))
    return stored(
        labels.join(goes.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    )


def _settled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each node of the given links ends up."""
    parent: dict = {}

    def root(node):
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for part in parts:
        for a, b in zip(part["node"], part["other"]):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    moved = [(node, root(node)) for node in parent if parent[node] != node]
    if moved:
        yield pd.DataFrame(moved, columns=["node", "to"])
