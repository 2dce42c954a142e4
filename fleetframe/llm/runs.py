"""Periodic runs of words within a document: seeds on diagonals, extended both ways.

A run is a stretch of words with smallest period q, of at least max(6, 4 * q) words, that no neighbouring
word extends. Comparing a text with itself q words later, a run is a diagonal of at least 3 * q equal
words, 5 for q = 1. Periods are searched in ranges (k / 3, k] for k = 3, 9, 27, ...: k words are never more
than the overlap that a run of these periods guarantees, so every such run holds the same k-gram q words
apart. As k >= q, occurrences of a k-gram within the run lie at multiples of q, so it is enough to pair an
occurrence with the next one, and there are fewer pairs than words. A k-gram is named by the names of its
three thirds, exactly and without hashing; when no k-gram occurs twice, no longer one does. A table holds
for each lag how far its diagonals are covered, and a seed below that is not extended again.

Texts are independent of each other and each is searched by one call, in time n log n for its n words.

A null text counts as empty; an empty text has no runs. Repeated rows give a result each, a null id keeps
its row, other columns are ignored, an empty table gives no rows. Words are compared by their UTF-8 bytes;
only ASCII white space parts them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fleetframe.llm.common import map_chunks, texts_of

# Fewest words of a run, and fewest repeats of its period.
LEAST_WORDS = 6
LEAST_REPEATS = 4
# Words compared at first when a seed is extended; doubled from step to step.
FIRST_STEP = 32


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of pairs, in which equal pairs have equal names."""
    _, names = np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)
    return names


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading items of two arrays agree."""
    low, step, most = 0, FIRST_STEP, min(len(left), len(right))
    while low < most:
        high = min(low + step, most)
        differ = left[low:high] != right[low:high]
        at = int(differ.argmax())
        if differ[at]:
            return low + at
        low, step = high, step * 2
    return most


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, found = len(words), []
    names, k = words, 1
    # No run has a period above n / LEAST_REPEATS, and the range before ended at k.
    while k < n // LEAST_REPEATS or (k == 1 and n >= LEAST_WORDS):
        size = n - 3 * k + 1
        if size < 2:
            break
        names = _named(_named(names[:size], names[k : k + size]), names[2 * k : 2 * k + size])
        lowest, k = k, 3 * k
        order = np.argsort(names, kind="stable")
        seeds, following = order[:-1], order[1:]
        again = names[seeds] == names[following]
        if not again.any():
            break
        lag = following - seeds
        wanted = again & (lag <= k) & ((lag > lowest) | (k == 3))
        seeds, lag = seeds[wanted], lag[wanted]
        in_order = np.lexsort((seeds, lag))
        # End of the diagonals of each lag that were extended.
        covered: dict[int, int] = {}
        for at, q in zip(seeds[in_order].tolist(), lag[in_order].tolist()):
            if at < covered.get(q, 0):
                continue
            end = at + k + _agreeing(words[at + k :], words[at + k + q :])
            start = at - _agreeing(words[:at][::-1], words[: at + q][::-1])
            covered[q] = end
            length = end - start + q
            if length >= max(LEAST_WORDS, LEAST_REPEATS * q):
                found.append((start, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats its period most often; of equals the one with the least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in no run after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: doc_id, start and length in words, period."""

    def start():
        def step(rows: dict[str, list]) -> dict[str, list]:
            out = {"doc_id": [], "start": [], "length": [], "period": []}
            for doc, text in zip(rows["doc_id"], rows["text"]):
                for begin, length, period in runs_of(numbered(words_of(text))):
                    out["doc_id"].append(doc)
                    out["start"].append(begin)
                    out["length"].append(length)
                    out["period"].append(period)
            return out

        return step

    texts = texts_of(docs, id_col=id_col, text_col=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_chunks(texts, start, f"doc_id {kind}, start bigint, length bigint, period bigint")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_dropped): every run cut to its first period, words joined by one space."""

    def start():
        def step(rows: dict[str, list]) -> dict[str, list]:
            out = {"doc_id": rows["doc_id"], "text": [], "n_dropped": []}
            for text in rows["text"]:
                words = words_of(text)
                kept = kept_words(len(words), runs_of(numbered(words)))
                out["text"].append(_joined(words, kept).decode("utf-8", "surrogatepass"))
                out["n_dropped"].append(len(words) - int(kept.sum()))
            return out

        return step

    texts = texts_of(docs, id_col=id_col, text_col=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_chunks(texts, start, f"doc_id {kind}, text string, n_dropped bigint")


def _joined(words: list[bytes], kept: np.ndarray) -> bytes:
    if kept.all():
        return b" ".join(words)
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


def with_planted_period(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a document; in about one of ten, from some word on, a few words again and again.

    A document without an id keeps its words.
    """
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


DIGEST = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, its texts with planted periods: number of runs, the strongest one, digests of all."""

    def start():
        names = [field.split(" ")[0] for field in DIGEST.split(", ")]

        def step(rows: dict[str, list]) -> dict[str, list]:
            out = {"doc_id": rows["doc_id"], **{name: [] for name in names}}
            for doc, text in zip(rows["doc_id"], rows["text"]):
                words = with_planted_period(words_of(text), doc)
                runs = runs_of(numbered(words))
                best = strongest(runs)
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                short = _joined(words, kept_words(len(words), runs))
                values = (
                    len(runs),
                    *(best or (None, None, None)),
                    1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(listed.encode()).hexdigest(),
                    hashlib.sha256(short).hexdigest(),
                )
                for name, value in zip(names, values):
                    out[name].append(value)
            return out

        return step

    texts = texts_of(docs, id_col=id_col, text_col=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_chunks(texts, start, f"doc_id {kind}, {DIGEST}")
