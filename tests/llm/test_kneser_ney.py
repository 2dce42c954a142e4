import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetframe.llm import kneser_ney


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        lists = [tokens(t) for t in texts]
        self.count = Counter(w for t in lists for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.pairs = Counter(p for t in lists for p in zip(["<s>"] + t, t))
        self.ends = Counter(b for _, b in self.pairs)
        self.d = self.discounts(self.pairs.values())
        self.e = self.discounts(self.ends.values())
        self.rest = sum(self.off(c, self.e) for c in self.ends.values())
        self.left, self.seen = defaultdict(float), Counter()
        for (a, _), c in self.pairs.items():
            self.left[a] += self.off(c, self.d)
            self.seen[a] += c

    @staticmethod
    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]

    @staticmethod
    def off(count, d):
        return d[min(count, 3) - 1] if count else 0.0

    def lower(self, w):
        if not self.pairs:
            return 1 / (self.v + 1)
        c = self.ends[w]
        return (max(c - self.off(c, self.e), 0) + self.rest / (self.v + 1)) / len(self.pairs)

    def chance(self, before, w):
        if not self.seen[before]:
            return self.lower(w)
        c = self.pairs[before, w]
        return (max(c - self.off(c, self.d), 0) + self.left[before] * self.lower(w)) / self.seen[before]

    def scores(self, text):
        t = tokens(text)
        base = sum(math.log10((self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        return len(t), sum(self.count[w] > 0 for w in t), base, sum(math.log10(self.chance(a, b)) for a, b in zip(["<s>"] + t, t))


def check(docs, rows):
    model = Plain([t for i, t in rows if not held_out(i)])
    got = kneser_ney.train_and_score(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    want = sorted(((i, *model.scores(t)) for i, t in rows), key=lambda r: (str(r[0]), r[1], round(r[4], 6)))
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(have, want):
        assert a[:3] == b[:3]
        assert a[3] == pytest.approx(b[3], abs=1e-6) and a[4] == pytest.approx(b[4], abs=1e-6)
    assert {r["train_tokens"] for r in got} <= {model.n}
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    return model


def test_small_corpus(make_docs):
    rng = random.Random(12)
    words = ["The", "the", "of", "İstanbul", "ÉTÉ", "a\x1cb", "x y", "p\tq\rr"] + [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 68)]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    model = check(make_docs(rows), rows)
    for before in ("<s>", "the", "nowhere"):
        assert sum(model.chance(before, w) for w in [*model.count, "never seen"]) == pytest.approx(1)


def test_many_buckets(monkeypatch, make_docs):
    monkeypatch.setattr(kneser_ney, "WORD_BUCKET_CHARS", 200)
    monkeypatch.setattr(kneser_ney, "PAIR_BUCKET_CHARS", 100)
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(30))) for i in range(40)]
    check(make_docs(rows), rows)


def test_odd_rows(make_docs, odd_rows):
    check(make_docs(odd_rows, clashing=True), odd_rows)
    assert kneser_ney.train_and_score(make_docs([])).count() == 0
    nothing = [(i, "some text") for i in range(200) if held_out(i)][:3]
    check(make_docs(nothing), nothing)


def test_packed_arrays():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    assert (kneser_ney.unpacked(kneser_ney.packed(keys, True), True) == keys).all()
    first, second = rng.integers(0, 1000, 50), rng.integers(0, 1000, 50)
    back = kneser_ney.split_keys(kneser_ney.pair_keys(first, second, 1000), 1000)
    assert (back[0] == first).all() and (back[1] == second).all()


def test_seen_texts_score_better(bundled):
    rows = kneser_ney.train_and_score(bundled("documents")).collect()
    aside = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in aside) > sum(r["base_score"] for r in aside)


def test_counts_beyond_32_bits(tmp_path):
    """One wide count widens its file; what is read is what was written."""
    folder = str(tmp_path)
    for name, counts in (
        ("narrow", np.array([0, 1, 2**32 - 1])),
        ("wide", np.array([5, 2**32, 2**40 + 7])),
        ("rows", np.array([[1, 2], [3, 2**33]])),
        ("none", np.zeros(0, dtype=np.int64)),
    ):
        kneser_ney.write_counts(folder, name, counts)
        read = kneser_ney.mapped_counts(folder, name, counts.size)
        assert read.reshape(counts.shape).astype(np.int64).tolist() == counts.tolist()


def test_ranges_of_sorted_groups():
    assert list(kneser_ney.ranges_of(np.array([2, 2, 5, 9, 9, 9]))) == [(2, 0, 2), (5, 2, 3), (9, 3, 6)]
    assert list(kneser_ney.ranges_of(np.zeros(0, dtype=np.int64))) == []
