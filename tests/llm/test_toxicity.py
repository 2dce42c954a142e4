import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark import TaskContext

from fleetframe.llm import toxicity
from tests.llm.conftest import by_id

BAD = ["idiot", "scum", "loweichen", "loweisp", "loweient", "trash"]


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = [rng.choice("the of and house river walk over under some where".split()) + rng.choice(["", "ing", "ed"]) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[rng.randint(0, 59)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_rows(make_docs, make_labels):
    rows, labels = corpus()
    got = by_id(toxicity.train_and_score(make_docs(rows), make_labels(labels)))
    assert len(got) == len(rows)
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["predicted"] == labels[i][2] for i in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(make_docs, make_labels):
    rows, labels = corpus(200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a = by_id(toxicity.train_and_score(make_docs(rows), make_labels(labels)))
    b = by_id(toxicity.train_and_score(make_docs(rows), make_labels(turned)))
    assert a == b


def sparse(dense):
    row, term = np.nonzero(dense)
    return toxicity.Rows(np.append(0, np.cumsum((dense > 0).sum(axis=1))), term, dense[row, term])


def dense(rows, n_terms):
    full = np.zeros((len(rows), n_terms))
    full[rows.row_of, rows.terms] = rows.values
    return full


@pytest.mark.parametrize("common_words", [0, 3, 40])
def test_index_is_exact(common_words):
    rng = np.random.default_rng(4)
    counts = np.where(rng.random((300, 40)) < 0.1, np.ceil(rng.random((300, 40)) * 5), 0)
    counts[50:80] = counts[20]
    counts[90] = 0
    examples = sparse(counts).weighted(np.linspace(1, 3, 40))
    queries = sparse(np.concatenate([counts[::9], rng.random((40, 40)) < 0.1, np.zeros((1, 40))]) * 1.0)
    queries = queries.weighted(np.linspace(1, 3, 40))
    best, who = toxicity.Index.of(examples, 40, common_words).nearest(queries, 7)
    cosines = dense(queries, 40) @ dense(examples, 40).T
    for q, (b, w) in enumerate(zip(best, who)):
        want = sorted((-c, i) for i, c in enumerate(cosines[q]) if c > 0)[:7]
        assert np.allclose(b[: len(want)], [-c for c, _ in want])
        assert (w[len(want) :] == -1).all()
        # Rounding may tell equal cosines apart.
        assert np.allclose(sorted(cosines[q][w[: len(want)]]), sorted(-c for c, _ in want))


def test_blocks_are_passed_over_and_nothing_is_lost():
    rng = np.random.default_rng(5)
    # A strong word for each of 40 groups and many weak ones.
    counts = (rng.random((1280, 340)) < 0.05) * 1.0
    counts[:, :40] = 0
    counts[np.arange(1280), np.arange(1280) % 40] = 1
    weights = np.concatenate([np.full(40, 5.0), np.full(300, 0.05)])
    rows = sparse(counts).weighted(weights)
    index = toxicity.Index.of(rows, 340, 40)
    assert (index.common[:40] >= 0).all()
    read = []
    inner = toxicity.Index._cosines
    try:
        toxicity.Index._cosines = lambda self, low, size, by: (read.append(size.sum()), inner(self, low, size, by))[1]
        best, _ = index.nearest(rows, 15)
    finally:
        toxicity.Index._cosines = inner
    held = np.diff(index.term_starts)[rows.terms].sum()
    full = dense(rows, 340)
    assert np.allclose(best, -np.sort(-(full @ full.T), axis=1)[:, :15])
    assert 0 < sum(read) < held / 4


def test_a_word_of_a_single_example_counts(make_docs, make_labels):
    rows, labels = corpus(300)
    rows = [(i, t + " zyzzyva") if i == 6 else (i, t) for i, t in rows] + [(900, "zyzzyva"), (901, "unheard")]
    model = toxicity.train(make_docs(rows), make_labels(labels), toxicity.learnable())
    learned = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    assert 6 in learned
    assert set(model.words) == {w for i, t in rows if i in learned for w in t.split()}
    assert (model.weights > 0).all()
    got = by_id(toxicity.scored(make_docs(rows), model, ~toxicity.learnable()))
    assert got[900]["nearest_doc_id"] == 6 and got[900]["nearest_cosine"] > 0
    assert got[901]["nearest_doc_id"] is None


def test_against_plain_search(make_docs, make_labels):
    """Weights, neighbours and votes by plain loops."""
    rows, labels = corpus(240)
    model = toxicity.train(make_docs(rows), make_labels(labels), toxicity.learnable())
    texts = dict(rows)
    learned = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(1 for _, t in learned if t == kind) for kind in (0, 1)]
    weight = {}
    for word in model.words:
        a, b = (sum(1 for i, t in learned if t == kind and word in texts[i].split()) for kind in (1, 0))
        chi = (a * (n[0] - b) - b * (n[1] - a)) ** 2 * sum(n) / (n[0] * n[1] * (a + b) * (sum(n) - a - b + 1))
        held = sum(1 for _, t in rows if word in t.split())
        weight[word] = (np.log((1 + len(rows)) / (1 + held)) + 1) * ((chi / (chi + 100)) ** 2 + 0.001)

    def vector(text):
        words = [w for w in text.split() if w in weight]
        v = {w: (1 + np.log(words.count(w))) * weight[w] for w in words}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = [(i, t, vector(texts[i])) for i, t in learned]
    got = by_id(toxicity.scored(make_docs(rows), model, ~toxicity.learnable()))
    for i, text in rows:
        mine = vector(text)
        near = sorted(
            (-round(sum(x * v.get(w, 0) for w, x in mine.items()), 12), j, t) for j, t, v in examples
        )[:15]
        votes = sum(-c for c, _, t in near if t) / sum(-c for c, _, _ in near)
        assert got[i]["nearest_cosine"] == pytest.approx(-near[0][0], abs=1e-9)
        assert got[i]["score"] == pytest.approx(model.scores(np.array([votes]))[0], abs=0.05)


def test_bound_on_characters(make_docs, make_labels):
    rows, labels = corpus(200)
    docs, marks = make_docs(rows), make_labels(labels)
    few = toxicity.train(docs, marks, toxicity.learnable(), example_chars=4_000)
    assert 0 < few.drawn.sum() < toxicity.train(docs, marks, toxicity.learnable()).drawn.sum()
    assert toxicity.scored(docs, few, ~toxicity.learnable()).count() == len(rows)


def test_copies_of_a_toxic_text_do_not_speak_for_texts_without_terms(make_docs, make_labels):
    rows, labels = corpus(400)
    hot = "idiot scum of the river and the house " * 3
    rows += [(1000 + i, hot) for i in range(250)] + [(3000 + i, "qq zz") for i in range(20)] + [(4000, ""), (4001, None)]
    labels += [(1000 + i, 1, 1) for i in range(250)] + [(3000 + i, 1, 0) for i in range(20)]
    docs, marks = make_docs(rows), make_labels(labels)
    model = toxicity.train(docs, marks, toxicity.learnable())
    assert model.without_terms < 0.1
    # One of the distinct texts, with all its copies.
    assert len(model.doc_ids) < 400 and model.drawn.max() > 150
    got = by_id(toxicity.scored(docs, model, ~toxicity.learnable()))
    assert all(got[1000 + i]["predicted"] == 1 and got[1000 + i]["score"] > 0.9 for i in range(250))
    assert all(got[i]["predicted"] == 0 for i in [*range(3000, 3020), 4000, 4001])
    clean = [i for i, _, t in labels if i < 400 and not t]
    assert sum(got[i]["predicted"] for i in clean) < 0.05 * len(clean)


def test_odd_rows(make_docs, make_labels, odd_rows):
    rows, labels = corpus(200)
    odd = [(None if i is None else 1000 + i, t) for i, t in odd_rows]
    docs = make_docs(rows + odd, clashing=True)
    marks = make_labels(labels + [(None, 1, 1), (1001, None, None), (1003, 1, 0), (1003, 1, 1), (5000, 1, 1)])
    got = toxicity.train_and_score(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (1001, 1002, 1007)}
    assert len(same) == 1
    kept = toxicity.without_toxic(docs, toxicity.train(docs, marks, toxicity.learnable()))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_nothing_to_learn_from(make_docs, make_labels):
    docs = make_docs([(1, "a"), (2, None)])
    assert {r["score"] for r in toxicity.train_and_score(docs, make_labels([])).collect()} == {0.0}
    assert toxicity.train_and_score(make_docs([]), make_labels([])).count() == 0


def test_the_driver_does_not_hold_the_model(make_docs, make_labels, monkeypatch):
    """It is fitted in a task and read where it is used; the driver keeps the name of its folder."""
    rows, labels = corpus(200)

    def in_a_task(inner):
        def call(*args):
            assert TaskContext.get() is not None
            return inner(*args)

        return call

    for name in ("_examples", "_calibrated"):
        monkeypatch.setattr(toxicity, name, in_a_task(getattr(toxicity, name)))
    monkeypatch.setattr(toxicity.StoredModel, "read", in_a_task(toxicity.StoredModel.read))
    model = toxicity.train(make_docs(rows), make_labels(labels), toxicity.learnable())
    assert len(pickle.dumps(model)) < 1_000
    assert toxicity.without_toxic(make_docs(rows), model).count() < len(rows)
