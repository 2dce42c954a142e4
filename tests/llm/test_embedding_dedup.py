import random

import numpy as np
import pytest

from fleetframe.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, class bigint, links bigint, cell bigint"


def brute(rows, threshold=0.9):
    good = [i for i, (_, v) in enumerate(rows) if embedding_dedup.usable(v)]
    by_length = {}
    for i in good:
        by_length.setdefault(len(rows[i][1]), []).append(i)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in by_length.values():
        unit = embedding_dedup.unit(np.array([rows[i][1] for i in members], dtype=np.float32).astype(np.float64))
        close = unit @ unit.T >= threshold
        for a, b in zip(*np.nonzero(np.triu(close, 1))):
            links[members[a]] += 1
            links[members[b]] += 1
            x, y = find(members[a]), find(members[b])
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(least.get(find(i), vec_id), vec_id)
    return sorted(
        (str(v), links[i], str(None if v is None else least[find(i)])) for i, (v, _) in enumerate(rows)
    )


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)
    got = embedding_dedup.grouped(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got)


@pytest.mark.parametrize("block", [2_000, 7])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    centre = rng.normal(size=16)
    rows += [(200 + i, (centre + 0.2 * rng.normal(size=16)).tolist()) for i in range(60)]
    rows += [(300 + i, centre.tolist()) for i in range(80)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15)]
    rows += [(405, [float("inf")] + [1.0] * 15), (None, centre.tolist()), (None, None), (3, rows[3][1]), (406, [1.0, 2.0])]
    rows += [(407, (3 * centre).tolist()), (408, (1e-30 * centre).tolist())]
    random.Random(1).shuffle(rows)
    assert run(spark, rows, block=block) == brute(rows)


def test_bundled_vectors(spark, bundled):
    rows = [(r["vec_id"], r["embedding"]) for r in bundled("embeddings").collect()]
    rows += [(10_000 + i, (np.array(v) + 0.01).tolist()) for i, v in rows[:40]]
    assert run(spark, rows) == brute(rows)


def test_close_vectors_meet_among_many_cells(spark):
    rng = np.random.default_rng(11)
    one = embedding_dedup.unit(rng.normal(size=(1_500, 64)))
    aside = rng.normal(size=one.shape)
    aside = embedding_dedup.unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    other = 0.9001 * one + np.sqrt(1 - 0.9001**2) * aside
    # Centres of other vectors, as in a table much larger than its sample.
    centres = embedding_dedup.spherical_kmeans(embedding_dedup.unit(rng.normal(size=(6_000, 64))), 1_000, passes=2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([one, other]))]
    df = spark.createDataFrame(rows, "class bigint, embedding array<double>, weight bigint")
    cells = {r["class"]: r["cells"] for r in embedding_dedup.placed(df, {64: centres}).select("class", "cells").collect()}
    apart = [i for i in range(1_500) if cells[i][0] not in cells[1_500 + i] and cells[1_500 + i][0] not in cells[i]]
    assert apart == []
    # Far from all cells.
    assert np.mean([len(c) for c in cells.values()]) < 500


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [("1", 0, "1")]
