import random
from collections import Counter

import numpy as np
import pytest

from fleetframe.llm import ngram_join


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(d), str(None if d is None else least[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def run(docs):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in ngram_join.joined(docs).collect())


def corpus():
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 120)))) for i in range(60)]
    base = [word() for _ in range(200)]
    for i in range(50):  # a large group of near copies, no two equal
        changed = list(base)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(200)] = word()
        rows.append((100 + i, " ".join(changed)))
    passage = " ".join(word() for _ in range(60))
    rows += [(200 + i, passage + " " + " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(30)]
    rows += [(300 + i, rows[5][1]) for i in range(25)]
    rows += [(400, rows[7][1].upper()), (401, "one two"), (402, "one  two"), (403, "one two three")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1_000, 8])
def test_against_brute_force(monkeypatch, make_docs, block):
    if block < 1_000:
        monkeypatch.setattr(ngram_join, "EXACT_BLOCK", block)
        for f in (ngram_join.candidate_links, ngram_join.verified_links):
            monkeypatch.setattr(f, "__defaults__", (ngram_join.THRESHOLD, block))
    rows = corpus()
    assert run(make_docs(rows)) == brute(rows)


def test_bundled_documents(bundled):
    docs = bundled("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    assert run(docs) == want
    kept = {r["doc_id"] for r in ngram_join.deduplicated(docs).collect()}
    assert {str(i) for i in kept} == {d for d, c, _ in want if d == c}


def test_rows_without_ids(make_docs):
    """Many of them in many classes, near copies of each other and of rows with ids, and copies that are equal."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(60):
        base = [word() for _ in range(60)]
        near = base[:-1] + [word()]
        rows += [(None, " ".join(base)), (None, " ".join(near)), (None, " ".join(base))]
        if i % 3 == 0:
            rows.append((i, " ".join(base[:-1] + [word()])))
    rows += [(None, "the same text in very many rows without any id at all")] * 80
    rows += [(7, rows[0][1]), (7, rows[3][1])]
    assert run(make_docs(rows)) == brute(rows)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    assert run(docs) == brute(odd_rows)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
    assert run(make_docs([])) == []
    assert ngram_join.deduplicated(make_docs([])).count() == 0


def test_pruning_keeps_similar_pairs():
    rng = random.Random(15)
    lost = tried = dropped = apart = 0
    for _ in range(300):
        share = rng.choice([0.1, 0.3, 0.82, 0.9])
        common = [rng.getrandbits(60) for _ in range(int(400 * share))]
        own = (400 - len(common)) // 2
        sets = [np.array(sorted({*common, *(rng.getrandbits(60) for _ in range(own))}), dtype=np.uint64) for _ in range(2)]
        values = np.stack([ngram_join.minhash(s) for s in sets])
        kept = len(ngram_join.surviving(values, np.array([0]), np.array([1]))[0])
        exact = ngram_join.jaccard(sets, np.array([0]), np.array([1]))[0, 0]
        assert exact == pytest.approx(len(common) / (len(sets[0]) + len(sets[1]) - len(common)))
        if exact >= 0.8:
            tried, lost = tried + 1, lost + 1 - kept
        elif exact < 0.4:
            apart, dropped = apart + 1, dropped + 1 - kept
    assert tried and lost == 0 and dropped == apart
