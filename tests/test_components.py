import random

import pytest

from fleetframe.plans.components import components


def brute(links):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, x)
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def run(spark, links, last_links, kind="bigint"):
    df = spark.createDataFrame(links, f"a {kind}, b {kind}")
    rows = components(df, "a", "b", last_links).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("last_links", [50_000, 0])
def test_components_equal_brute_force(spark, last_links):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)]
    links += [(1000, 1000 + i) for i in range(200)]  # a node with many links
    links += [(2000 + i, 2001 + i) for i in range(60)]  # a chain
    links += [(5, 5), (9000, None), (None, 9001), (None, None), (7, 8), (7, 8), (8, 7)]
    rng.shuffle(links)
    assert run(spark, links, last_links) == brute(links)


def test_text_nodes_and_no_links(spark):
    assert run(spark, [], 10) == {}
    links = [("b", "a"), ("c", "b"), ("x", "y")]
    assert run(spark, links, 0, "string") == run(spark, links, 10, "string") == brute(links)
