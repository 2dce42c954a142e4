import functools
import random
import time

import numpy as np

from fleetframe.llm import boosted_trees, pii, spans
from tests.llm.conftest import by_id
from tests.llm.test_spans import plain_pii

CARDS = ["4111111111111111", "5500005555555559", "4012888888881881"]


def corpus(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "of", "and", "house", "river", "7", "1999", "12-3"]) for _ in range(30)]
        words.insert(rng.randint(0, 30), rng.choice([f"u{i}@mail.example.com", rng.choice(CARDS), f"10.0.{i % 256}.7", f"+1 (555) 555-0{i:03d}", "9" * 16, ""]))
        rows.append((i, " ".join(words)))
    return rows


def test_base_spans_stay_and_split_numbers_are_added(make_docs):
    rows = corpus() + [(1000, "in 2024 4111111111111111 was used"), (1001, "the year 2024 4111111111111112 was used")]
    docs = make_docs(rows)
    model = pii.train(docs)
    got = by_id(pii.found(docs, model))
    for doc_id, text in rows:
        base = plain_pii(text)
        row = got[doc_id]
        assert row["base_sha256"] == spans.digest(base)
        assert [row[f"n_{k}"] for k in spans.PII_KINDS] == [sum(s[0] == k for s in base) for k in spans.PII_KINDS]
        written = row["spans"].split(",") if row["spans"] else []
        assert set(spans.written(base).split(",") if base else []) <= set(written)
    assert got[1000]["spans"] == "card:8:24" and got[1000]["n_card"] == 0
    assert got[1001]["spans"] == ""


def test_candidates_overlap_and_cover_base():
    text = "call 1 4111111111111111 or a@b.co or 10.0.0.1"
    found = pii.candidates(text)
    assert set(spans.base_pii(text)) <= set(found)
    assert ("card", 7, 23) in found and ("card", 5, 23) in found


def test_odd_rows(make_docs, odd_rows):
    for clashing in (False, True):
        docs = make_docs(odd_rows, clashing)
        assert pii.train(docs) is None
        rows = pii.found(docs, None).collect()
        assert len(rows) == len(odd_rows)
        assert all(r["spans"] == "" for r in rows)
        assert sorted(pii.redacted_documents(docs, None).columns) == sorted(docs.columns)
    empty = make_docs([])
    assert pii.found(empty, pii.train(empty)).count() == 0


def test_odd_rows_with_a_trained_model(make_docs, odd_rows):
    rows = corpus(300)
    model = pii.train(make_docs(rows))
    assert model is not None
    late = [(1_000 + i, t) for i, t in rows[:3]]
    for clashing in (False, True):
        docs = make_docs(odd_rows + late + late, clashing)
        got = pii.found(docs, model).collect()
        assert len(got) == len(odd_rows) + 6 and {r["spans"] for r in got if r["doc_id"] in (1, 2, 7)} == {""}
        new = pii.redacted_documents(docs, model)
        assert sorted(new.columns) == sorted(docs.columns) and new.count() == docs.count()
        assert [r.text for r in new.filter("doc_id = 1").collect() if r.text is None]


def test_very_long_texts_take_time_by_length():
    rows = [case for _, t in corpus(300) for case in pii.cases(t, random.Random(1))]
    model = pii.fit(np.array([r for r, _ in rows]), np.array([label for _, label in rows], dtype=float))
    part = "mail a.b@c.org or call +1 (555) 555-0199 with 4111111111111111 from 10.0.0.1 in 2024 and a plain sentence "
    begin = time.time()
    ((base, every),) = pii.found_in([part * (2_000_000 // len(part))], model)
    assert len(base) > 60_000 and set(base) <= set(every)
    assert time.time() - begin < 120


def test_redaction_takes_effect(make_docs):
    docs = make_docs([(1, "mail a@b.co now"), (2, None)])
    rows = by_id(pii.redacted_documents(docs, None))
    assert rows[1]["text"] == "mail [EMAIL] now" and rows[1]["n_chars"] == len("mail [EMAIL] now")
    assert rows[2]["text"] is None


def test_thresholds_are_precise():
    p = np.array([0.2, 0.6, 0.9, 0.95])
    assert pii.lowest_precise(p, np.array([0, 1, 1, 1]), 0.97) == 0.6
    assert pii.lowest_precise(p, np.array([0, 0, 0, 0]), 0.97) > 1


def cases_of(rows):
    found = [case for i, t in rows for case in pii.cases(t or "", random.Random(i or 0))]
    return np.array([r for r, _ in found]), np.array([label for _, label in found], dtype=float)


def test_learns_from_every_text(make_docs):
    """Few texts with cases among very many with digits, one without an id, one with no three digits together."""
    rows = corpus(40) + [(100 + i, f"see page {i}") for i in range(40_000)]
    rows += [(None, "card 4111111111111111 was used")] * 3 + [(99_999, "1 2 3 4 5 6 7 8")]
    docs = make_docs(rows)
    cases, labels = cases_of(rows)
    total = pii.all_cases(docs).selectExpr("sum(n) n", "sum(ones) ones", "sum(n_kept) n_kept").first()
    assert (total["n"], total["ones"]) == (len(cases), labels.sum())
    assert abs(total["n_kept"] - 2 * len(cases) / 3) < 40
    model = pii.train(docs)
    assert model is not None
    here = pii.fit(cases, labels)
    assert all((getattr(model.trees, n) == getattr(here.trees, n)).all() for n in ("features", "limits", "leaves"))
    assert model.thresholds == here.thresholds and all((a == b).all() for a, b in zip(model.levels, here.levels))


def test_a_change_of_order_changes_nothing(make_docs):
    rows = corpus(200)
    model, again = (pii.train(make_docs(r)) for r in (rows, rows[::-1]))
    assert (model.trees.leaves == again.trees.leaves).all() and model.thresholds == again.thresholds


def test_many_parts_make_the_trees_of_all(make_docs, monkeypatch):
    monkeypatch.setattr(pii, "grown_trees", functools.partial(boosted_trees.grown_trees, trees=4))
    monkeypatch.setattr(boosted_trees, "grown_trees", pii.grown_trees)
    rows = corpus()
    docs = make_docs(rows)
    kept = pii.all_cases(docs).filter("n_kept > 0")
    cuts = pii.all_cuts(kept)
    parts = pii.in_parts(kept, cuts, 20).collect()
    assert len(parts) > 3
    model = pii.train(docs, 20)
    here = pii.fit(*cases_of(rows))
    assert (model.trees.features == here.trees.features).all() and (model.trees.limits == here.trees.limits).all()
    assert np.allclose(model.trees.leaves, here.trees.leaves, atol=1e-12)
    assert model.thresholds == here.thresholds


def test_counted_rows_count_as_often():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 40, (500, 6)).astype(float) ** 2
    counts = rng.integers(1, 5, 500)
    every = np.repeat(rows, counts, axis=0)
    for one, all_of in zip(rows.T, every.T):
        cuts = boosted_trees.cuts_of(one, counts)
        assert np.allclose(cuts, np.unique(np.quantile(all_of, np.linspace(0, 1, boosted_trees.BINS + 1)[1:-1])))
    labels = (every[:, 0] + every[:, 1] > 1_000).astype(float)
    ones = np.add.reduceat(labels, np.cumsum(counts) - counts)
    few, many = boosted_trees.fit_trees(rows, ones, counts), boosted_trees.fit_trees(every, labels)
    assert (few.features == many.features).all() and np.allclose(few.leaves, many.leaves)
    assert ((many.margins(every) > 0) == (labels > 0)).mean() > 0.99
    for p in (rng.random(500).round(1), rng.random(500)):
        assert pii.lowest_precise(p, ones, 0.6, counts) == pii.lowest_precise(np.repeat(p, counts), labels, 0.6)


def test_two_thirds_are_learned_from():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 6, 3_000)
    ones = rng.integers(0, n + 1)
    kept, ones_kept = pii.learned_from([b"%d" % i for i in range(3_000)], n, ones)
    assert (abs(kept - 2 * n / 3) < 2).all() and (ones_kept <= ones).all() and (kept - ones_kept <= n - ones).all()
    assert abs(kept.sum() / n.sum() - 2 / 3) < 0.02 and abs(ones_kept.sum() / ones.sum() - 2 / 3) < 0.02


def test_cases_of_a_long_text_take_time_by_length():
    part = "4111111111111111 and 10.0.0.1 but 7 5500005555555559 and 0 10.2.3.4 or 1 4012888888881881 "
    begin = time.time()
    n = sum(1 for _ in pii.cases(part * 20_000, random.Random(1)))
    assert n > 80_000 and time.time() - begin < 30
