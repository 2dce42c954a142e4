"""Gradient-boosted trees over counted cases, and calibrated thresholds, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

BINS = 32
# Shares of the cases that lie below the cuts between bins.
SHARES = [k / BINS for k in range(1, BINS)]
TREES, DEPTH = 60, 4
RATE, RIDGE = 0.2, 2.0


@dataclass(frozen=True)
class Trees:
    """Trees whose nodes of one depth share a split: a leaf is read off ``depth`` comparisons."""

    features: np.ndarray  # (trees, depth)
    limits: np.ndarray  # (trees, depth)
    leaves: np.ndarray  # (trees, 2 ** depth)
    start: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for features, limits, leaves in zip(self.features, self.limits, self.leaves):
            leaf = np.zeros(len(rows), dtype=np.int64)
            for feature, limit in zip(features, limits):
                leaf = leaf * 2 + (rows[:, feature] > limit)
            total += leaves[leaf]
        return total


# Features, places of the cuts and leaves of a tree.
Tree = tuple[list[int], list[int], np.ndarray]
# Gain, place of the cut and the sums of both new leaves of each leaf, as gradients and curves.
Split = tuple[float, int, np.ndarray]


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Quantiles of values that stand for so many cases each, as Spark's ``percentile`` interpolates them."""
    values, place = np.unique(values, return_inverse=True)
    ends = np.cumsum(np.bincount(place, counts))
    at = np.array(SHARES) * (ends[-1] - 1)
    low, high = np.floor(at), np.ceil(at)
    below, above = (values[np.searchsorted(ends, x, side="right")] for x in (low, high))
    return np.unique(np.where(below == above, below, (high - at) * below + (at - low) * above))


def bins_of(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts of its feature lie below each value."""
    return np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def counted(rows: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one, in order, with the sums of their numbers."""
    rows, place = np.unique(rows, axis=0, return_inverse=True)
    place = place.reshape(-1)
    return rows, np.bincount(place, ones, len(rows)), np.bincount(place, counts, len(rows))


class Cases:
    """Binned rows: how many cases each stands for, how many of them are positive, and their margins."""

    def __init__(self, bins: np.ndarray, ones: np.ndarray, counts: np.ndarray, start: float) -> None:
        self.columns = np.ascontiguousarray(bins.T)
        self.ones, self.counts = ones, counts
        self.margins = np.full(len(ones), start)
        self.passed = 0

    def _leaves(self, features: list[int], places: list[int]) -> np.ndarray:
        leaf = np.zeros(len(self.ones), dtype=np.int64)
        for feature, place in zip(features, places):
            leaf = leaf * 2 + (self.columns[feature] > place)
        return leaf

    def sums(self, grown: list[Tree], features: list[int], places: list[int]) -> np.ndarray:
        """Gradients and curves by feature, leaf of the tree begun, and bin."""
        for *tree, leaves in grown[self.passed :]:
            self.margins += leaves[self._leaves(*tree)]
        self.passed = len(grown)
        p = 1 / (1 + np.exp(-self.margins))
        weights = self.ones - self.counts * p, self.counts * np.maximum(p * (1 - p), 1e-9)
        cells = self._leaves(features, places) * BINS
        size = BINS << len(features)
        return np.array(
            [[np.bincount(cells + column, w, size).reshape(-1, BINS) for w in weights] for column in self.columns]
        )


def best_split(sums: np.ndarray, cuts: int, ridge: float = RIDGE) -> Split:
    """The cut of one feature with the largest gain over all leaves of the tree begun."""
    left, total = sums.cumsum(2)[:, :, :-1], sums.sum(2, keepdims=True)
    right = total - left
    gains = sum(sign * g**2 / (h + ridge) for sign, (g, h) in ((1, left), (1, right), (-1, total))).sum(0)[:cuts]
    at = int(gains.argmax()) if cuts else 0
    return float(gains[at]) if cuts else 0.0, at, np.stack([left[:, :, at], right[:, :, at]], axis=2).reshape(2, -1)


def start_of(ones: float, n: float) -> float:
    share = float(np.clip(ones / n, 1e-4, 1 - 1e-4))
    return float(np.log(share / (1 - share)))


def grown_trees(
    cuts: list[np.ndarray],
    start: float,
    splits_of: Callable[[list[Tree], list[int], list[int]], list[Split]],
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    ridge: float = RIDGE,
) -> Trees:
    """Logistic loss; every level takes the split with the largest gain over all its nodes.

    ``splits_of`` gives the best split of each feature after the trees grown and the splits of the one begun.
    """
    grown: list[Tree] = []
    for _ in range(trees):
        features: list[int] = []
        places: list[int] = []
        for _ in range(depth):
            splits = splits_of(grown, features, places)
            # Of features that split alike the first is taken, however the sums were rounded.
            feature = max(range(len(splits)), key=lambda f: np.float32(splits[f][0]))
            _, at, (g, h) = splits[feature]
            features.append(feature)
            places.append(at)
        grown.append((features, places, rate * g / (h + ridge)))
    limits = [[cuts[f][at] if len(cuts[f]) else np.inf for f, at in zip(*tree)] for *tree, _ in grown]
    return Trees(np.array([t[0] for t in grown]), np.array(limits), np.array([t[2] for t in grown]), start)


def grown_from(bins: np.ndarray, ones: np.ndarray, counts: np.ndarray, cuts: list[np.ndarray], start: float) -> Trees:
    """The trees of binned cases that are at hand."""
    cases = Cases(bins, ones, counts, start)
    return grown_trees(
        cuts, start, lambda *so_far: [best_split(s, len(c)) for s, c in zip(cases.sums(*so_far), cuts)]
    )


def fit_trees(rows: np.ndarray, ones: np.ndarray, counts: np.ndarray | None = None) -> Trees:
    """The trees of rows that stand for so many cases each, one if not given, with so many positive ones."""
    counts = np.ones(len(rows)) if counts is None else counts
    cuts = [cuts_of(column, counts) for column in rows.T]
    return grown_from(*counted(bins_of(rows, cuts), ones, counts), cuts, start_of(ones.sum(), counts.sum()))


def pooled(
    values: Iterable[float], ones: Iterable[float], counts: Iterable[float]
) -> tuple[list[float], list[float], list[float]]:
    """Blocks of ascending scores in which the share of ones rises: upper score, ones and cases of each.

    Blocks of parts of the scores, put together in order, give the blocks of all.
    """
    tops: list[float] = []
    sums: list[float] = []
    sizes: list[float] = []
    for value, one, count in zip(values, ones, counts):
        tops.append(float(value))
        sums.append(float(one))
        sizes.append(float(count))
        while len(sums) > 1 and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
            top, total, size = tops.pop(), sums.pop(), sizes.pop()
            tops[-1], sums[-1], sizes[-1] = top, sums[-1] + total, sizes[-1] + size
    return tops, sums, sizes


def levels_of(blocks: tuple[list[float], list[float], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """One case of each label is added to a level, so small levels are not certain of anything."""
    tops, sums, sizes = blocks
    return np.array(tops), (np.array(sums) + 0.5) / (np.array(sizes) + 1.0)


def monotone_levels(
    scores: np.ndarray, ones: np.ndarray, counts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration: upper score of each level and the share of ones in it."""
    values, place = np.unique(scores, return_inverse=True)
    return levels_of(pooled(values, np.bincount(place, ones, len(values)), np.bincount(place, counts, len(values))))


def calibrated(levels: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    tops, shares = levels
    return shares[np.minimum(np.searchsorted(tops, scores, side="left"), len(shares) - 1)]
