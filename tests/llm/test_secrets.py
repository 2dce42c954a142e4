import random
import string
import time

import numpy as np

from fleetframe.llm import char_cnn, secrets, spans
from tests.llm.conftest import by_id
from tests.llm.test_spans import plain_secrets


def corpus(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "of", "and", "house", "river", "1999", "4785380592391135"]) for _ in range(30)]
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        key = "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))
        words.insert(rng.randint(0, 30), rng.choice([f'token = "{value}"', f"password={value[:18]}", key, value, ""]))
        rows.append((i, " ".join(words)))
    return rows


def test_base_spans_stay_and_other_spellings_are_added(make_docs):
    rows = corpus() + [
        (1000, "use pwd = kJ8sQ2mN4xR7tY1wZ6 for it"),
        (1001, "the number 4785380592391135 in the house"),
        (1002, "key 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822C in use"),
    ]
    docs = make_docs(rows)
    model = secrets.train(docs)
    got = by_id(secrets.found(docs, model))
    for doc_id, text in rows:
        base = plain_secrets(text)
        row = got[doc_id]
        assert row["base_sha256"] == spans.digest(base)
        assert [row[f"n_{k}"] for k in spans.SECRET_KINDS] == [sum(s[0] == k for s in base) for k in spans.SECRET_KINDS]
        written = row["spans"].split(",") if row["spans"] else []
        assert set(spans.written(base).split(",") if base else []) <= set(written)
    assert got[1000]["spans"] == "assign:4:28"
    assert got[1001]["spans"] == ""
    assert got[1002]["spans"] == "hex:4:52"


def test_thresholds_find_the_wanted_share():
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 123, (900, char_cnn.PLACES))
    labels = (np.arange(900) % 3 == 0).astype(np.float32)
    codes[labels == 1, 30:40] = 55
    kinds = [spans.SECRET_KINDS[i // 3 % 3] for i in range(900)]
    model = secrets.fit(codes, labels, kinds)
    p = model.probabilities(codes)
    for kind in spans.SECRET_KINDS:
        own = (np.array(kinds) == kind) & (labels == 1)
        assert (p[own] >= model.thresholds[kind]).mean() >= secrets.RECALL - 0.02
    assert (p[labels == 0] < 0.5).mean() > 0.95


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    codes, labels, weights = rng.integers(0, 128, (6, char_cnn.PLACES)), rng.integers(0, 2, 6).astype(float), np.ones(6)
    net = char_cnn.CharCnn.fresh(1)
    for name in ("tables", "shift", "first", "first_shift", "second", "second_shift"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        z = net.logits(codes).astype(np.float64)
        return float((np.logaddexp(0, z) - labels * z).mean())

    for p, g in zip(net.parameters(), net.gradients(codes, labels, weights)):
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            old, step = p[at], 1e-3
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_gradients_of_cases_with_several_windows():
    rng = np.random.default_rng(2)
    counts = np.array([1, 3, 2, 1])
    codes, labels, weights = rng.integers(0, 128, (7, char_cnn.PLACES)), np.array([1.0, 0, 1, 0]), np.ones(4)
    net = char_cnn.CharCnn.fresh(1)
    for name in ("tables", "shift", "first", "first_shift", "second", "second_shift"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        z = net.logits(codes, counts).astype(np.float64)
        return float((np.logaddexp(0, z) - labels * z).mean())

    for p, g in zip(net.parameters(), net.gradients(codes, labels, weights, counts)):
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            old, step = p[at], 1e-3
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_windows_hold_a_whole_span():
    text = "é" + "".join(chr(97 + i % 26) for i in range(500))
    short = np.array(char_cnn.window(text, 30, 40))
    assert len(short) == char_cnn.PLACES and short[char_cnn.LEFT] == ord(text[30]) and short[-1] == ord(text[51])
    assert char_cnn.window("xy", 0, 2)[: char_cnn.LEFT] == [char_cnn.OUTSIDE] * char_cnn.LEFT
    for start, end in ((0, 49), (1, 97), (3, 400), (100, 501)):
        rows = np.array(char_cnn.window(text, start, end)).reshape(-1, char_cnn.PLACES)
        bodies = rows[:, char_cnn.LEFT : char_cnn.LEFT + char_cnn.BODY]
        assert len(rows) == char_cnn.window_count(start, end)
        places = {k * char_cnn.BODY + i for k in range(len(rows) - 1) for i in range(char_cnn.BODY)}
        assert places | set(range(end - start - char_cnn.BODY, end - start)) == set(range(end - start))
        for k, body in enumerate(bodies):
            first = min(start + k * char_cnn.BODY, end - char_cnn.BODY)
            expected = [c if c < 128 else char_cnn.OTHER for c in map(ord, text[first : first + char_cnn.BODY])]
            assert body.tolist() == expected


def test_the_middle_of_a_long_candidate_counts():
    rng = np.random.default_rng(3)
    net = char_cnn.CharCnn.fresh(3)
    plain = "".join(rng.choice(list(string.ascii_lowercase), 200))
    marked = plain[:95] + "%%%%%%" + plain[101:]
    both = [secrets.stacked([char_cnn.window(t, 0, 200)]) for t in (plain, marked)]
    assert net.logits(*both[0])[0] != net.logits(*both[1])[0]


def test_learns_from_the_middle_of_long_candidates():
    rng = random.Random(4)
    made, labels = [], []
    for n in range(600):
        body = "".join(rng.choice("abcdefgh") for _ in range(160))
        if n % 2:
            body = body[:70] + "12345" + body[75:]
        made.append(char_cnn.window(body, 0, 160))
        labels.append(n % 2)
    model = secrets.fit(made, np.array(labels, dtype=np.float32), ["hex"] * 600)
    p = model.probabilities(made)
    assert ((p > 0.5) == np.array(labels)).mean() > 0.95


def test_very_long_texts_take_time_by_length():
    """Two million characters full of candidates, with a model that has seen cases."""
    rows = corpus(200)
    model = secrets.fit(
        [c for _, t in rows for _, c, _ in secrets.cases(t, random.Random(1))],
        np.array([label for _, t in rows for _, _, label in secrets.cases(t, random.Random(1))], dtype=np.float32),
        [s[0] for _, t in rows for s, _, _ in secrets.cases(t, random.Random(1))],
    )
    part = f"token={'a1b2c3d4' * 4} some words pwd = kJ8sQ2mN4xR7tY1wZ6 4785380592391135 then more plain words here "
    begin = time.time()
    ((base, every),) = secrets.found_in([part * (2_000_000 // len(part)) + "f" * 200_000], model)
    assert len(base) > 15_000 and len(every) >= len(base)
    assert time.time() - begin < 60


def test_odd_rows_with_a_trained_model(make_docs, odd_rows):
    rows = corpus(200)
    model = secrets.train(make_docs(rows))
    assert model is not None
    late = [(1_000 + i, t) for i, t in rows[:3]]
    for clashing in (False, True):
        got = secrets.found(make_docs(odd_rows + late + late, clashing), model).collect()
        assert len(got) == len(odd_rows) + 6
        assert {r["spans"] for r in got if r["doc_id"] in (1, 2, 7)} == {""}
        again = [r for r in got if r["doc_id"] == 1_000]
        assert len(again) == 2 and again[0] == again[1]


def test_odd_rows(make_docs, odd_rows):
    for clashing in (False, True):
        docs = make_docs(odd_rows, clashing)
        model = secrets.train(docs)
        assert model is None
        rows = secrets.found(docs, model).collect()
        assert len(rows) == len(odd_rows) and all(r["n_hex"] == 0 for r in rows)
    empty = make_docs([])
    assert secrets.found(empty, secrets.train(empty)).count() == 0


def test_learns_from_every_text(make_docs, monkeypatch):
    """Every case of every text reaches a part, repeated rows and a row without an id included."""
    rows = corpus(200) + corpus(20)[:1] * 30 + [(None, f"password={'a1' * 12}")]
    wanted = sum(len(secrets.cases(t, random.Random(i or 0))) for i, t in rows)
    parts = secrets.in_parts(secrets.all_cases(make_docs(rows)), 100).collect()
    assert len(parts) > 5 and sum(r["n"] for r in parts) == wanted
    assert max(r["n"] for r in parts) < 200
    monkeypatch.setattr(secrets, "train_round", lambda parts, state, *rest: state)
    kept = []
    monkeypatch.setattr(
        secrets, "levels_aside", lambda aside, inner=secrets.levels_aside: (kept.append(aside.count()), inner(aside))[1]
    )
    secrets.train(make_docs(rows), 100)
    assert kept == [wanted - sum(r["n_kept"] for r in parts)]


def test_one_part_is_learned_as_cases_at_hand(make_docs):
    docs = make_docs(corpus(150))
    (row,) = secrets.in_parts(secrets.all_cases(docs), 100_000).collect()
    codes, counts, labels, kinds = secrets._opened(row)
    order, _ = secrets.set_aside(len(counts))
    back = np.argsort(order)
    made = [c.ravel().tolist() for c in np.split(codes, np.cumsum(counts)[:-1])]
    here = secrets.fit([made[i] for i in back], labels[back], [spans.SECRET_KINDS[kinds[i]] for i in back])
    model = secrets.train(docs, 100_000)
    assert all((a == b).all() for a, b in zip(model.net.parameters(), here.net.parameters()))
    assert model.thresholds == here.thresholds and (model.levels[1] == here.levels[1]).all()


def test_many_parts_make_one_model(make_docs):
    rows = corpus()
    model = secrets.train(make_docs(rows), 400)
    again = secrets.train(make_docs(rows[::-1]), 400)
    assert all((a == b).all() for a, b in zip(model.net.parameters(), again.net.parameters()))
    assert model.thresholds == again.thresholds
    late = [(1, "use pwd = kJ8sQ2mN4xR7tY1wZ6 for it"), (2, "the number 4785380592391135 in the house")]
    got = by_id(secrets.found(make_docs(late), model))
    assert got[1]["spans"] == "assign:4:28" and got[2]["spans"] == ""


def test_blocks_of_ranges_give_the_levels_of_all(spark):
    rng = np.random.default_rng(5)
    logits = rng.integers(-300, 300, 4_000) / 64
    labels = (rng.random(4_000) < 1 / (1 + np.exp(-logits))).astype(int)
    rows = [(float(x), 0, int(y)) for x, y in zip(logits, labels)]
    aside = spark.createDataFrame(rows, "logit double, kind int, label int")
    got, wanted = secrets.levels_aside(aside), secrets.monotone_levels(logits, labels)
    assert (got[0] == wanted[0]).all() and (got[1] == wanted[1]).all()
