import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetframe.llm import grid, nearest

ASKS = "vec_id % 20 = 0"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, score string, ids int, `row` int, side int")


def padded(rows):
    return [(i, v, "s", 1, 1, 1) for i, v in rows]


def takes_part(row):
    i, v = row
    return i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain(rows, k=20):
    """Every query against every other row, component after component."""
    rows = [r for r in rows if takes_part(r)]
    out = []
    for n, (i, v) in enumerate(rows):
        if i % 20:
            continue
        scored = []
        for m, (j, w) in enumerate(rows):
            if n != m and len(v) == len(w):
                score = 0.0
                for x, y in zip(v, w):
                    score += x * y
                scored.append((-score, j))
        out += [(i, rank + 1, j, 0.0 - minus) for rank, (minus, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_odd_rows_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(i, [0.5, -0.0] + [0.25] * 6) for i in range(300, 420)]
    rows += [(i, [0.5, 0.0] + [0.25] * 6) for i in range(420, 460)]
    rows += [(20, rows[20][1]), (40, [3.0] * 8), (40, [3.0] * 8)]
    rows += [(500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] + [1.0] * 7)]
    rows += [(580, [0.0] * 8), (600, []), (None, [1.0] * 8), (620, [1.0, 2.0]), (621, [2.0, 1.0]), (640, [1.0] * 3)]
    found = nearest.nearest(frame(spark, padded(rows)), F.expr(ASKS))
    assert got(found) == plain(rows)
    assert [f.simpleString() for f in found.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]


def test_lengths_of_very_different_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(-160, 120)).tolist()) for i in range(200)]
    assert got(nearest.nearest(frame(spark, padded(rows)), F.expr(ASKS), k=3)) == plain(rows, 3)


def test_near_copies_closer_than_codes_can_tell(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=6)
    rows = [(i, (centre + rng.normal(size=6) * 1e-7).tolist()) for i in range(400)]
    assert got(nearest.nearest(frame(spark, padded(rows)), F.expr(ASKS), k=4)) == plain(rows, 4)


def test_several_groups_and_spans(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(grid, "LEAST_IN_SPAN", 40)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(600)]
    assert got(nearest.nearest(frame(spark, padded(rows), "float"), F.expr(ASKS), k=7)) == plain(rows, 7)


def test_empty_and_single(spark):
    assert got(nearest.nearest(frame(spark, []), F.expr(ASKS))) == []
    assert got(nearest.nearest(frame(spark, padded([(20, [1.0])])), F.expr(ASKS))) == []
    assert got(nearest.nearest(frame(spark, padded([(3, [1.0]), (4, [2.0])])), F.expr(ASKS))) == []


def test_bounds_hold():
    rng = np.random.default_rng(8)
    for dims in (3, 64, 2_000):
        a, b = (nearest.Coded(rng.normal(size=(30, dims)) * rng.uniform(0.01, 5, size=(30, 1))) for _ in range(2))
        lower, upper = nearest.bounds(a, b)
        exact = a.vectors @ b.vectors.T
        assert (lower <= exact).all() and (exact <= upper).all()
        assert np.array_equal(nearest.code_products(a.codes, b.codes), a.codes.astype(int) @ b.codes.astype(int).T)
        assert (upper - lower).mean() < 0.05 * np.outer(a.size, b.size).mean()


@pytest.mark.parametrize("k", [1, 20])
def test_bundled_vectors(spark, bundled, k):
    rows = [(r.vec_id, r.embedding) for r in bundled("embeddings").collect()]
    assert got(nearest.nearest(bundled("embeddings"), F.expr(ASKS), k=k)) == plain(rows, k)
