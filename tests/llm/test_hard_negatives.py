import numpy as np
from pyspark.sql import functions as F

from fleetframe.llm import grid, hard_negatives as hn

ANCHOR = "vec_id % 100 = 0"


def frame(spark, rows, kind="double"):
    rows = [(i, label, v, 1, "p", 2) for i, label, v in rows]
    return spark.createDataFrame(rows, f"vec_id bigint, label string, embedding array<{kind}>, `row` int, place string, cluster int")


def plain(rows):
    """All rows against every anchor, by definition."""
    fit = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit.append((i, label, [int(np.floor(x * 256)) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(fit):
        if i % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), j, other == label)
            for m, (j, other, w) in enumerate(fit)
            if m != n and len(v) == len(w)
        ]
        scored.sort()
        for s, j, same in [p for p in scored if p[2]][:5]:
            near = [(t, h) for t, h, alike in scored if not alike and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, rank + 1, h, -s, -t) for rank, (t, h) in enumerate(near)]
    return sorted(out)


def got(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def clustered_rows(count, seed, dims=6, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, dims))
    return [
        (i, f"l{rng.integers(labels)}", (centres[rng.integers(len(centres))] + spread * rng.normal(size=dims)).tolist())
        for i in range(count)
    ]


def test_against_all_rows(spark):
    rows = clustered_rows(1_500, 1)
    made = hn.mined(frame(spark, rows), F.expr(ANCHOR))
    assert got(made) == plain(rows) and plain(rows)
    kinds = dict(made.dtypes)
    assert kinds["rank"] == "int" and {kinds[c] for c in kinds if c != "rank"} == {"bigint"}


def test_odd_rows_copies_and_ties(spark):
    rows = clustered_rows(700, 2)
    rows += [(i, "l1", [0.25] * 6) for i in range(700, 900)] + [(i, "l2", [0.25] * 6) for i in range(900, 1_000)]
    rows += [(1_000, "l1", [0.25] * 6)] * 3 + [(1_100, "l3", [0.001] * 6), (1_200, "l3", [0.0] * 6), (1_300, "l3", [-0.001] * 6)]
    rows += [(1_400, None, [1.0] * 6), (1_500, "l1", None), (1_600, "l1", [None] * 6), (1_700, "l1", [float("nan")] * 6)]
    rows += [(None, "l1", [1.0] * 6), (1_800, "l1", []), (1_900, "l1", [1.0, 2.0]), (1_901, "l1", [1.0, 1.0]), (1_902, "x", [1.0, 0.8])]
    rows += [(2_000, "alone", [0.3] * 6), (2_100, "l1", [1e6, -1e6, 3.0, 1.0, 0.0, 2.0]), (2_101, "l1", [1e6, 1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(2_102, "l2", [9e5, 1.0, 0.0, 0.0, 0.0, 0.0])]
    assert got(hn.mined(frame(spark, rows), F.expr(ANCHOR))) == plain(rows)


def test_several_groups_and_spans(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", 4)
    monkeypatch.setattr(grid, "LEAST_IN_SPAN", 100)
    rows = [(i, label, np.float32(v).tolist()) for i, label, v in clustered_rows(1_200, 3)]
    assert got(hn.mined(frame(spark, rows, "float"), F.expr(ANCHOR))) == plain(rows)


def test_scores_beyond_a_long(spark):
    rows = [(0, "a", [1e200, 1.0]), (1, "a", [1e200, 1.0]), (2, "b", [1e200, 2.0]), (3, "b", [-1e200, 2.0])]
    top = 2**63 - 1
    assert got(hn.mined(frame(spark, rows), F.expr(ANCHOR))) == [(0, 1, 1, 2, top, top)]


def test_no_rows_no_anchors(spark):
    assert got(hn.mined(frame(spark, []), F.expr(ANCHOR))) == []
    assert got(hn.mined(frame(spark, clustered_rows(50, 4)[1:]), F.expr(ANCHOR))) == []


def test_walks_stop_early():
    """Where directions part, most candidates are never scored."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centres = np.eye(8) * 4
    vectors = np.concatenate([c + 0.05 * rng.normal(size=(500, 8)) for c in centres])
    walked = []

    class Counting(hn.Positives):
        def take(self, members, scores, ids, own, labels):
            walked.append(scores.size)
            super().take(members, scores, ids, own, labels)

    ids = np.arange(len(vectors))
    rows = pa.table({"row": ids, "vec_id": ids, "label": np.zeros(len(ids), dtype=int), "cluster": ids // 500})
    anchors = rows.filter(pa.array(ids % 50 == 0))
    walk = Counting(anchors, vectors[ids % 50 == 0], 256, 5)
    walk.add(rows, vectors)
    assert sum(walked) < len(ids) * anchors.num_rows / 4
    assert len(walk.result()["row"]) == 5 * anchors.num_rows
