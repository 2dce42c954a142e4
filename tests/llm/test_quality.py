import math
import random
import re

import numpy as np

from fleetframe.llm import quality
from tests.llm.conftest import by_id


def corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]
        grade = i % 4
        if grade == 0:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:3] * 30
        elif grade == 1:
            words[5:9] = ["idiot", "scum", "idiot", "trash"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade != 0), int(grade == 1)))
    return rows, labels


def test_selection_and_order(spark, make_docs):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels[:300], "doc_id bigint, quality int, toxic int")
    docs = make_docs(rows)
    model = quality.train(docs, marks)
    assert model.thresholds[0] < model.thresholds[1]
    got = by_id(quality.scored(docs, model))
    for i, good, toxic in labels[300:]:
        assert got[i]["selected"] == bool(good)
    mean = lambda f: np.mean([got[i]["expected_grade"] for i, g, t in labels[300:] if f(g, t)])
    assert mean(lambda g, t: not g) < mean(lambda g, t: g and t) < mean(lambda g, t: g and not t)
    kept = {r["doc_id"] for r in quality.selected(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["selected"]}


def test_fit_against_a_plain_search():
    """With one feature of value 1 in all rows, the thresholds give the shares of the grades."""
    grades = np.array([0] * 20 + [1] * 30 + [2] * 50)
    rows = [(np.array([7]), np.array([1.0])) for _ in grades]
    weights, cuts = quality.fit_ordinal(rows, grades, np.ones(100), steps=2000)
    tails = 1 / (1 + np.exp(cuts - weights[7]))
    assert np.allclose(tails, [0.8, 0.5], atol=0.02)


def test_odd_rows(spark, make_docs, odd_rows):
    rows, labels = corpus(200)
    odd = [(None if i is None else 1000 + i, t) for i, t in odd_rows]
    docs = make_docs(rows + odd, clashing=True)
    marks = spark.createDataFrame(
        labels + [(None, 0, 0), (1001, None, None), (1002, 1, None), (1003, 0, 0), (1003, 1, 0), (9000, 0, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    model = quality.train(docs, marks)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert quality.selected(docs, model).columns == docs.columns


def test_nothing_to_learn_from(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for docs in (make_docs(odd_rows), make_docs([])):
        model = quality.train(docs, none)
        assert model is None
        assert all(r["selected"] and r["expected_grade"] is None for r in quality.scored(docs, model).collect())
        assert quality.selected(docs, model).count() == docs.count()


def test_shape_reads_the_whole_word():
    word = "a" * 90
    assert quality.shape_of(word + "7") == "a0" and quality.shape_of(word) == "a"
    assert quality.shape_of("-" * 70 + "B" + "-" * 5) == "-A-"
    one, other = (quality.features(word + tail + " plain words")[0] for tail in ("1", "?"))
    assert set(one.tolist()) != set(other.tolist())


def plain_objective(weights, cuts, rows, grades, share):
    """Log likelihood of the grades with the ridge, row by row."""
    total = 0.0
    for (slots, values), grade, s in zip(rows, grades, share):
        at = sum(weights[slot] * value for slot, value in zip(slots, values))
        tails = [1.0, *(1 / (1 + math.exp(cut - at)) for cut in cuts), 0.0]
        total += s * math.log(tails[grade] - tails[grade + 1])
    return total - quality.RIDGE / 2 * sum(w * w for w in weights.values())


def test_fit_reaches_the_likelihood_of_a_plain_search():
    """Small steps along each parameter in turn, as long as any of them helps."""
    rng = np.random.default_rng(12)
    slots = [3, 70, 500]
    true = {3: 1.5, 70: -2.0, 500: 0.3}
    rows, grades = [], []
    for _ in range(150):
        values = rng.normal(size=3)
        at = sum(true[s] * v for s, v in zip(slots, values)) + rng.logistic()
        rows.append((np.array(slots), values))
        grades.append(int(at > -0.5) + int(at > 1.0))
    share = rng.uniform(0.5, 2, 150)
    weights, cuts = quality.fit_ordinal(rows, np.array(grades), share, steps=1500)
    share = share / share.sum()
    found = plain_objective({s: weights[s] for s in slots}, cuts, rows, grades, share)
    at, step = [0.0, 0.0, 0.0, -1.0, 1.0], 0.5
    value = lambda x: plain_objective(dict(zip(slots, x[:3])), sorted(x[3:]), rows, grades, share)
    best = value(at)
    while step > 1e-4:
        better = False
        for i in range(5):
            for move in (step, -step):
                tried = [*at[:i], at[i] + move, *at[i + 1 :]]
                if abs(tried[4] - tried[3]) > 1e-9 and value(tried) > best:
                    at, best, better = tried, value(tried), True
        if not better:
            step /= 2
    assert found > best - 1e-4
    assert np.allclose([weights[s] for s in slots], at[:3], atol=0.05) and np.allclose(cuts, at[3:], atol=0.05)


def plain_row(text, model):
    """Grade and tail of a text, from its words one by one."""
    words = text.split()
    n = len(words)
    x = {}

    def put(name, value):
        slot = quality._slot(name)
        x[slot] = x.get(slot, 0.0) + value

    counts = {}
    keys = ["w=" + re.sub(r"^\W+|\W+$", "", w.lower()) for w in words]
    for name in [*keys, *("s=" + quality.shape_of(w) for w in words)]:
        slot = quality._slot(name)
        counts[slot] = counts.get(slot, 0) + 1
    for slot, count in counts.items():
        x[slot] = math.sqrt(count / n)
    put(f"=length {min(n.bit_length(), 39)}", 0.3)
    if n:
        put("=at once", math.sqrt(sum(a == b for a, b in zip(keys, keys[1:])) / n))
        put("=soon", math.sqrt(sum(k in keys[max(0, i - 8) : i] for i, k in enumerate(keys)) / n))
        put(f"=distinct {int(len(set(keys)) / n * 10)}", 0.3)
    at = sum(model.weights[slot] * value for slot, value in x.items())
    tails = [1 / (1 + math.exp(cut - at)) for cut in model.thresholds]
    return sum(tails), tails[0]


def test_rows_of_the_query_by_hand(spark, make_docs):
    rows, labels = corpus(240)
    rows += [(900, ""), (901, "one"), (902, "again again again ?! 12")]
    docs = make_docs(rows)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = by_id(quality.scored(docs, model))
    for i, text in rows:
        expected, tail = plain_row(text, model)
        assert math.isclose(got[i]["expected_grade"], expected, abs_tol=1e-9)
        assert math.isclose(got[i]["tail_probability"], tail, abs_tol=1e-9)
        assert got[i]["selected"] == (tail >= model.limit) or math.isclose(tail, model.limit, abs_tol=1e-9)
