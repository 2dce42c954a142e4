import hashlib
import random

import numpy as np
import pytest

from fleetframe.llm import fingerprints
from fleetframe.llm.fingerprints import Fingerprint, fingerprint


def plain(rows):
    """Edited texts in the order of ids, ties by text, null ids first."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = []
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = (fingerprint(t) for t in (text, edited, following))
        found.append(
            (
                str(doc_id),
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                a.written(),
                b.written(),
                round(a.likeness(b), 9),
                round(a.likeness(c), 9),
            )
        )
    return sorted(found)


def run(docs):
    return sorted(
        (str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in fingerprints.with_next(docs).collect()
    )


@pytest.mark.parametrize("chars", [8_000_000, 3_000])
def test_against_plain_code(monkeypatch, make_docs, odd_rows, chars):
    monkeypatch.setattr(fingerprints, "ORDERED_CHARS", chars)
    rng = random.Random(9)
    rows = [(i * 3, " ".join(rng.choice(["ab", "cde", "fé", "漢字"]) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(90, rows[3][1])]
    rng.shuffle(rows)
    assert run(make_docs(rows)) == plain(rows)
    assert run(make_docs(odd_rows, clashing=True)) == plain(odd_rows)


def test_single_and_no_rows(make_docs):
    assert run(make_docs([(5, "only one text here")])) == plain([(5, "only one text here")])
    assert run(make_docs([])) == []


def test_likeness_follows_edits():
    rng = random.Random(10)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    before = 1.0
    for edits in (5, 50, 500, 4_000):
        changed = list(text)
        for _ in range(edits):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], [changed[at], "z"], ["y"]])
        near = fingerprint(text).likeness(fingerprint("".join(changed)))
        assert near < before
        before = near
    assert fingerprint(text).likeness(fingerprint("x" + text)) > 0.9
    assert fingerprint(text).likeness(fingerprint(text[:2_500])) == pytest.approx(0.5, abs=0.05)
    assert fingerprint("").likeness(fingerprint("")) == 1.0 and fingerprint("").likeness(fingerprint("a")) == 0.0


def test_written_form():
    for text in ("", "a", "some text " * 40, "漢" * 1000):
        p = fingerprint(text)
        again = Fingerprint.read(p.written())
        assert again.length == p.length and (again.samples == p.samples).all()


def test_near_duplicates(make_docs, odd_rows):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(100 + i, t.replace("a", "b", 3)) for i, t in enumerate(texts[:8])] + [(200, texts[0])]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: (i - 100 if 100 <= i < 200 else 0 if i == 200 else i) for i, _ in rows}
    assert fingerprints.near_duplicates(make_docs(odd_rows, clashing=True)).count() == len(odd_rows)
    assert fingerprints.near_duplicates(make_docs([])).count() == 0


def test_fingerprint_against_a_walk_step_by_step():
    """One step after another: a text stands at a character until the random bit of the step moves it on."""
    period = 1 << fingerprints.PERIOD_BITS
    moves = np.random.default_rng(fingerprints.SEED).integers(0, 2, (fingerprints.KINDS, period), dtype=np.uint8)
    moves[:, ::64] = 1
    sampled, _ = fingerprints._samples()
    rng = random.Random(31)
    for n in (0, 1, 2, 30, 400, 3_000):
        text = "".join(rng.choice("abc défg 漢") for _ in range(n))
        kinds = fingerprints.kinds_of(text)
        assert [kinds[i] == kinds[j] for i in range(min(n, 20)) for j in range(i)] == [
            text[i] == text[j] for i in range(min(n, 20)) for j in range(i)
        ]
        at, embedding = 0, []
        while at < n:
            embedding.append(kinds[at])
            at += int(moves[kinds[at], (len(embedding) - 1) % period])
        found = fingerprint(text)
        assert found.length == len(embedding)
        assert found.samples.tolist() == [embedding[step] & 15 for step in sampled.tolist() if step < len(embedding)]


def test_recall_of_the_bands(make_docs):
    """Pairs of likeness 0.8 and more, most of them far from equal, against comparing all fingerprints."""
    rng = random.Random(32)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = []
    for _ in range(60):
        base = " ".join(word() for _ in range(rng.randint(8, 500)))
        texts.append(base)
        for _ in range(3):
            changed = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], [changed[at], "z"], ["y"]])
            texts.append("".join(changed))
        # A difference that lies in the last part only, and lengths on both sides of a doubling.
        texts.append(base + base[: len(base) // 8])
    prints = [fingerprint(t) for t in texts]
    alike = [
        (i, j) for i in range(len(texts)) for j in range(i) if prints[i].likeness(prints[j]) >= fingerprints.ALIKE
    ]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(make_docs(list(enumerate(texts)))).collect()}
    met = sum(got[i] == got[j] for i, j in alike)
    assert len(alike) > 120 and met >= 0.95 * len(alike)
    # Nothing is linked that does not hang together through pairs so alike.
    root = list(range(len(texts)))
    for i, j in sorted(alike):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[i] == root[got[i]] for i in range(len(texts)))
