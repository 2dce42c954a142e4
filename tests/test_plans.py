"""The shared building blocks against plain sequential code."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetframe.plans import paging
from fleetframe.plans.first_come import accept_disjoint, accept_unique
from fleetframe.plans.intervals import with_overlap_count

DAY0 = dt.date(2024, 1, 1)


def at(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def rule_of_three(s, e, b_start, b_end):
    """The overlap rule as three alternatives; None dates never match."""
    if None in (b_start, b_end):
        return False
    return (
        (b_start <= s and b_end >= s) or (b_start <= e and b_end >= e) or (b_start >= s and b_end <= e)
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_count_equals_pairwise_count(spark, seed):
    rng = random.Random(seed)
    hot = lambda: "hot" if rng.random() < 0.4 else f"car{rng.randrange(5)}"
    ranges = []
    for _ in range(400):
        a, b = rng.randrange(40), rng.randrange(40)
        if rng.random() < 0.8:
            a, b = min(a, b), max(a, b)
        if rng.random() < 0.05:
            a = None
        ranges.append((hot(), at(a), at(b), rng.randrange(1, 4)))
    probes = []
    for i in range(300):
        a, b = rng.randrange(40), rng.randrange(40)
        if rng.random() < 0.9:
            a, b = min(a, b), max(a, b)
        probes.append((i, hot() if rng.random() < 0.95 else "unbooked", at(a), at(b)))
    got = with_overlap_count(
        spark.createDataFrame(probes, "id int, g string, s date, e date"),
        ("g", "s", "e"),
        spark.createDataFrame(ranges, "g string, s date, e date, w int"),
        ("g", "s", "e", "w"),
    ).collect()
    assert len(got) == len(probes)
    for row in got:
        if row.s > row.e:
            assert row.overlaps is None
        else:
            expected = sum(w for g, a, b, w in ranges if g == row.g and rule_of_three(row.s, row.e, a, b))
            assert row.overlaps == expected


def test_touching_days_overlap(spark):
    probes = spark.createDataFrame([("c", at(12), at(14))], "g string, s date, e date")
    ranges = spark.createDataFrame([("c", at(10), at(12), 1)], "g string, s date, e date, w int")
    assert with_overlap_count(probes, ("g", "s", "e"), ranges, ("g", "s", "e", "w")).first().overlaps == 1


def sequential_unique(rows):
    taken, accepted = [set(), set(), set()], set()
    for arrival, *keys in sorted(rows):
        if all(k is None or k not in t for k, t in zip(keys, taken)):
            accepted.add(arrival)
            for k, t in zip(keys, taken):
                t.add(k)
    return accepted


@pytest.mark.parametrize("spread", [4, 60, 2000])
def test_accept_unique_equals_sequential(spark, spread):
    rng = random.Random(spread)
    rows = [
        (i, *(None if rng.random() < 0.02 else f"{rng.randrange(spread)}" for _ in range(3)))
        for i in rng.sample(range(10_000), 400)
    ]
    frame = spark.createDataFrame(rows, "n long, a string, b string, c string")
    got = [r[0] for r in accept_unique(frame, "n", ["a", "b", "c"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == sequential_unique(rows)


def test_accept_unique_with_a_third_of_rows_on_one_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"p{i}", f"q{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "n long, a string, b string")
    got = {r[0] for r in accept_unique(frame, "n", ["a", "b"]).collect()}
    assert got == {0} | {i for i in range(3000) if i % 3}


@pytest.mark.parametrize("last_links", [50_000, 0])
def test_accept_unique_with_small_calls(spark, last_links):
    """Components above the bound of a call are settled a part at a time."""
    rng = random.Random(7)
    rows = [(i, *(f"{rng.randrange(90)}" for _ in range(2))) for i in rng.sample(range(10_000), 200)]
    rows += [(20_000 + i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(40)]
    frame = spark.createDataFrame(rows, "n long, a string, b string")
    got = [r[0] for r in accept_unique(frame, "n", ["a", "b"], group_rows=9, last_links=last_links).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential_unique([(*r,) for r in rows])


def test_accept_unique_needs_few_jobs_for_long_chains(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "n long, a string, b string")
    context = spark.sparkContext
    context.setJobGroup("chains", "chains")
    got = sorted(r[0] for r in accept_unique(frame, "n", ["a", "b"], group_rows=6_000).collect())
    jobs = len(context.statusTracker().getJobIdsForGroup("chains"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == list(range(0, 5000, 2))
    assert 0 < jobs < 100


def test_accept_unique_follows_long_chains(spark):
    """Each row shares one value with the next, so every second row is accepted."""
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(24)]
    frame = spark.createDataFrame(rows, "n long, a string, b string")
    assert sorted(r[0] for r in accept_unique(frame, "n", ["a", "b"]).collect()) == list(range(0, 24, 2))


def sequential_disjoint(rows):
    held, accepted = {}, set()
    for arrival, car, s, e in sorted(rows):
        if all(not (a <= e and b >= s) for a, b in held.get(car, [])):
            held.setdefault(car, []).append((s, e))
            accepted.add(arrival)
    return accepted


@pytest.mark.parametrize("group_rows", [1, 7, 50_000])
def test_accept_disjoint_equals_sequential_for_any_group_size(spark, group_rows):
    rng = random.Random(group_rows)
    rows = []
    for i in rng.sample(range(5000), 300):
        s = rng.randrange(60)
        rows.append((i, "hot" if rng.random() < 0.4 else f"car{rng.randrange(6)}", at(s), at(s + rng.randrange(6))))
    frame = spark.createDataFrame(rows, "n long, car string, s date, e date")
    got = [r[0] for r in accept_disjoint(frame, "n", "car", "s", "e", group_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == sequential_disjoint(rows)


def test_positions_and_deep_pages_equal_the_sorted_list(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"name{rng.randrange(40)}", i) for i in rng.sample(range(100_000), 1500)]
    frame = spark.createDataFrame(rows, "name string, id int").repartition(7)
    order = lambda: [F.desc("name"), F.asc("id")]
    expected = sorted(rows, key=lambda r: r[1])
    expected.sort(key=lambda r: r[0], reverse=True)
    numbered = paging.with_positions(frame, order()).collect()
    assert [(r.name, r.id) for r in sorted(numbered, key=lambda r: r.position)] == expected
    assert sorted(r.position for r in numbered) == list(range(1500))
    shallow = [tuple(r) for r in paging.page_rows(frame, order(), 9, 100, ["name", "id"]).collect()]
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 10)
    deep = [tuple(r) for r in paging.page_rows(frame, order(), 9, 100, ["name", "id"]).collect()]
    assert shallow == deep == expected[800:900]
    assert paging.page_rows(frame, order(), 99, 100, ["name", "id"]).count() == 0


def test_tables_of_a_block_are_deleted(spark, tmp_path):
    """Tables that operators wrote within the block go, those written before and results stay."""
    import os

    from fleetframe.session import scratch_folder, scratch_tables, stored

    before = scratch_folder(spark, "kept")
    spark.range(3).write.parquet(before)
    with scratch_tables(spark):
        made = stored(spark.range(5))
        inside = made.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        made.write.parquet(f"{tmp_path}/result")
        assert os.path.exists(inside)
    assert not os.path.exists(os.path.dirname(inside))
    assert spark.read.parquet(before).count() == 3 and spark.read.parquet(f"{tmp_path}/result").count() == 5
