"""Quality by ordinal regression: one set of weights over hashed text, ordered thresholds between grades.

Grades come from the labels: 0 for poor texts, 1 for good ones that are toxic, 2 for good ones. With
weights w and thresholds t1 < t2, a text x has P(grade >= j) = 1 / (1 + exp(t_j - w x)). That gives the
expected grade and the tail probability P(grade >= 1), by which texts are selected. The limit of that
probability is set on labelled texts that were not fitted, so that good ones stay.

Features are hashed: words, their shapes, words that come again at once or soon, the share of distinct
words and the length in steps. A null or empty text has the features of its length alone. Without labels of
good and poor texts nothing is rejected. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fleetframe.llm.common import Memo, fields_of, map_chunks, sampled_ids, texts_of

BITS = 16
# Bound of the labelled texts that are learned from: so many of each grade.
EXAMPLES_OF_A_GRADE = 2_000
GRADES = 3
# Of the good texts set aside, at most this share may fall below the limit.
GOOD_LOST = 0.002
STEPS, RIDGE = 250, 2e-5
WORDS_KEPT = 400_000
# Longer words are looked at anew each time.
WORD_KEPT_CHARS = 64
LATELY = 8

RESULT = "doc_id bigint, expected_grade double, tail_probability double, selected boolean"

_EDGES = re.compile(r"^\W+|\W+$")


def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8")) >> (64 - BITS)


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits as one character each; other characters stay, repeated ones once."""
    shape = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    return "".join(shape)


def _slots_of(word: str) -> bytes:
    return np.array([_slot("w=" + _EDGES.sub("", word.lower())), _slot("s=" + shape_of(word))], dtype="<u4").tobytes()


@functools.cache
def _memo() -> Memo:
    return Memo(_slots_of, WORDS_KEPT, WORD_KEPT_CHARS)


@functools.cache
def _fixed() -> dict[str, int]:
    names = ["at once", "soon", *(f"distinct {k}" for k in range(11)), *(f"length {k}" for k in range(40))]
    return {n: _slot("=" + n) for n in names}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; the values of a feature are the roots of its share of the words."""
    fixed = _fixed()
    words = text.split()
    n = len(words)
    slots = [fixed[f"length {min(n.bit_length(), 39)}"]]
    values = [0.3]
    if not n:
        return np.array(slots), np.array(values)
    both = np.frombuffer(b"".join(_memo().all(words)), dtype="<u4")
    found, counts = np.unique(both, return_counts=True)
    word = both[::2]
    again = word[1:] == word[:-1]
    soon = np.zeros(n, dtype=bool)
    for back in range(1, min(LATELY, n - 1) + 1):
        soon[back:] |= word[back:] == word[:-back]
    distinct = len(np.unique(word)) / n
    slots += [fixed["at once"], fixed["soon"], fixed[f"distinct {int(distinct * 10)}"]]
    values += [(again.sum() / n) ** 0.5, (soon.sum() / n) ** 0.5, 0.3]
    return np.concatenate([found.astype(np.int64), slots]), np.concatenate([np.sqrt(counts / n), values])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray
    limit: float

    def tails(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade >= j) for each row and j = 1 .. GRADES - 1."""
        at = np.array([float(self.weights[s] @ v) for s, v in rows])
        return _logistic(at[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, row_weights: np.ndarray, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge, by gradient steps of adaptive size.

    The thresholds are a first one and positive gaps, so they stay in order.
    """
    slots = np.concatenate([s for s, _ in rows]).astype(np.int32)
    values = np.concatenate([v for _, v in rows]).astype(np.float32)
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    starts = np.searchsorted(owner, np.arange(len(rows)))
    weights = np.zeros(1 << BITS)
    cuts = np.array([0.0] + [0.0] * (GRADES - 2))  # the first threshold, then logarithms of gaps
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, cuts)]
    share = row_weights / row_weights.sum()
    for step in range(1, steps + 1):
        gaps = np.exp(cuts[1:])
        thresholds = np.concatenate([cuts[:1], cuts[0] + np.cumsum(gaps)])
        at = np.add.reduceat(values * weights[slots], starts)
        upper = np.concatenate([np.ones((len(at), 1)), _logistic(at[:, None] - thresholds), np.zeros((len(at), 1))], 1)
        slope = upper * (1 - upper)
        i = np.arange(len(at))
        chance = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-12)
        pull = share * (slope[i, grades] - slope[i, grades + 1]) / chance
        by_threshold = np.zeros_like(upper)
        by_threshold[i, grades] -= share * slope[i, grades] / chance
        by_threshold[i, grades + 1] += share * slope[i, grades + 1] / chance
        t = by_threshold[:, 1:-1].sum(axis=0)
        of_cuts = np.concatenate([[t.sum()], [t[k:].sum() * gaps[k - 1] for k in range(1, GRADES - 1)]])
        of_weights = np.bincount(slots, values * pull[owner], 1 << BITS) - RIDGE * weights
        for x, gradient, (first, second) in zip((weights, cuts), (of_weights, of_cuts), moments):
            first *= 0.9
            first += 0.1 * gradient
            second *= 0.99
            second += 0.01 * gradient**2
            x += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights, np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled rows; of several labels for an id the lowest grade counts."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    known = labels.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES_OF_A_GRADE) -> QualityModel | None:
    """Fit on three of four sampled texts, set the limit on the rest."""
    texts = texts_of(docs)
    known = graded(labels).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    total = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    if 0 not in total or len(total) < 2:
        return None
    chosen = None
    for grade in sorted(total):
        part = sampled_ids(known, examples, F.col("grade") == grade).withColumn("grade", F.lit(grade))
        chosen = part if chosen is None else chosen.union(part)
    # At most GRADES times ``examples`` ids; one text for each.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def start():
        def step(columns):
            rows = [features(t) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"],
                "grade": columns["grade"],
                "slots": [s for s, _ in rows],
                "values": [v for _, v in rows],
            }

        return step

    ddl = "doc_id bigint, grade int, slots array<int>, values array<float>"
    drawn = map_chunks(sample, start, ddl).orderBy("doc_id").toPandas()
    rows = [(np.asarray(s, dtype=np.int64), np.asarray(v, dtype=np.float64)) for s, v in zip(drawn["slots"], drawn["values"])]
    grades = drawn["grade"].to_numpy(dtype=np.int64)
    aside = np.random.default_rng(11).permutation(len(rows)) % 4 == 0
    # Every grade weighs the same in the fit, so the rare poor texts are learned.
    sizes = np.bincount(grades, minlength=GRADES).astype(float)
    row_weights = 1 / np.maximum(sizes, 1)[grades]
    fitted = np.flatnonzero(~aside)
    weights, thresholds = fit_ordinal([rows[i] for i in fitted], grades[fitted], row_weights[fitted])
    model = QualityModel(weights, thresholds, 0.5)
    good = np.flatnonzero(aside & (grades > 0))
    if not len(good):
        return model
    tails = np.sort(model.tails([rows[i] for i in good])[:, 0])
    return QualityModel(weights, thresholds, float(min(0.5, tails[int(GOOD_LOST * len(tails))])))


def _judged(texts: list[str], model: QualityModel | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None or not texts:
        return np.full(len(texts), np.nan), np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
    tails = model.tails([features(t) for t in texts])
    return tails.sum(axis=1), tails[:, 0], tails[:, 0] >= model.limit


def scored(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """Expected grade, tail probability and selection of every row; null grades without a model."""

    def start():
        def step(columns):
            expected, tail, selected = _judged(columns["text"], model)
            return {
                "doc_id": columns["doc_id"],
                "expected_grade": [None if x != x else x for x in expected.tolist()],
                "tail_probability": [None if x != x else x for x in tail.tolist()],
                "selected": selected,
            }

        return step

    return map_chunks(texts_of(docs), start, RESULT, rows=512)


def selected(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The same columns, only the rows that are selected."""

    def start():
        def step(columns):
            stay = _judged([t or "" for t in columns["text"]], model)[2].tolist()
            return {name: [v for v, s in zip(values, stay) if s] for name, values in columns.items()}

        return step

    return map_chunks(docs, start, fields_of(docs), rows=512)
