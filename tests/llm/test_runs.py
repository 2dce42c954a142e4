import hashlib
import random
import time
import zlib

import numpy as np

from fleetframe.llm import runs
from tests.llm.conftest import by_id


def least_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:])))


def plain_runs(words):
    """Every stretch of equal neighbours at every distance, by definition."""
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and least_period(words[i : i + length]) == q:
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc, text):
    """The query's row for one document, following its definition word by word."""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return {
        "doc_id": doc,
        "n_runs": len(found),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join("%d,%d,%d\n" % r for r in found)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    }


def test_runs_against_their_definition():
    rng = random.Random(3)
    for _ in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            if len(words) > 10:
                q, low = rng.randrange(1, len(words) // 4 + 1), rng.randrange(len(words))
                for i in range(low + q, min(len(words), low + rng.randrange(1, 8 * q))):
                    words[i] = words[i - q]
        assert runs.runs_of(np.array(words, dtype=np.int64)) == plain_runs(words), words


def test_strongest_compares_exactly():
    assert runs.strongest([(0, 9, 2), (3, 18, 4), (5, 8, 2)]) == (0, 9, 2)
    assert runs.strongest([(4, 8, 2), (2, 12, 3)]) == (4, 8, 2)
    assert runs.strongest([]) is None


def test_time_follows_length():
    """Texts in which every place is a seed take no more than a little more time per word."""
    begin = time.time()
    assert runs.runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    half = np.tile(np.arange(1000), 300)
    assert runs.runs_of(half) == [(0, 300_000, 1000)]
    assert time.time() - begin < 20


def test_query_on_odd_rows(make_docs, odd_rows):
    more = [(i, "a b c " * 9 + "x y\vz " + "k " * 7) for i in range(100, 140)]
    rows = odd_rows + more + [(140, " a  " * 8)]
    got = runs.digested(make_docs([r for r in rows if r[0] != 5], clashing=True)).collect()
    assert len(got) == len(rows) - 1
    expected = [plain_digest(i, t) for i, t in rows if i != 5]
    key = lambda r: (str(r["doc_id"]), r["runs_sha256"], r["collapsed_sha256"])
    assert sorted((r.asDict() for r in got), key=key) == sorted(expected, key=key)
    assert runs.digested(make_docs([])).collect() == []


def test_long_text(make_docs, odd_rows):
    row = runs.digested(make_docs([odd_rows[5], (6, "ab " * 400_000)])).collect()
    assert [(r.n_runs, r.length) for r in row if r.doc_id == 6] == [(1, 400_000)]


def test_runs_and_collapsed_texts(make_docs):
    docs = make_docs([(1, "say it it it it it it again"), (2, "1 2 3 " * 4), (3, None)])
    assert sorted(map(tuple, runs.periodic_runs(docs).collect())) == [(1, 1, 6, 1), (2, 0, 12, 3)]
    short = by_id(runs.collapsed(docs))
    assert short[1] == {"doc_id": 1, "text": "say it again", "n_dropped": 5}
    assert short[2]["text"] == "1 2 3" and short[3]["text"] == ""


def test_bundled_documents(bundled):
    rows = {r.doc_id: r.text for r in bundled("documents").collect() if len(r.text or "") < 12_000}
    got = by_id(runs.digested(bundled("documents")))
    assert any(row["n_runs"] for row in got.values())
    for doc, text in rows.items():
        assert got[doc] == plain_digest(doc, text)
