"""A small character convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEFT, BODY, RIGHT = 24, 48, 12
WIDTH, FILTERS, HIDDEN = 5, 24, 32
CODES = 130
OUTSIDE, OTHER = 128, 129
REGIONS = ((0, LEFT), (LEFT, LEFT + BODY), (LEFT + BODY, LEFT + BODY + RIGHT))
PAD = WIDTH // 2
PLACES = LEFT + BODY + RIGHT


def window_count(start: int, end: int) -> int:
    """Windows of a span: one, or as many as its characters need."""
    return max(1, -(-(end - start) // BODY))


def window(text: str, start: int, end: int) -> list[int]:
    """Codes of the characters before, in and after a span, PLACES to a window.

    A span longer than BODY has several windows that together hold all of it, each with the characters before
    and after its part; the last one ends with the span.
    """
    count = window_count(start, end)
    low = max(0, start - LEFT)
    part = np.frombuffer(text[low : end + RIGHT].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.full(LEFT + max(end - start, BODY) + RIGHT, OUTSIDE)
    body = LEFT + end - start
    seen = np.where(part < 128, part, OTHER)
    codes[LEFT - (start - low) : body] = seen[: end - low]
    after = seen[end - low :]
    codes[len(codes) - RIGHT : len(codes) - RIGHT + len(after)] = after
    firsts = [min(k * BODY, max(0, end - start - BODY)) for k in range(count)]
    return np.concatenate([codes[f : f + PLACES] for f in firsts]).tolist()


@dataclass
class CharCnn:
    """One convolution over characters, the largest value of each filter in each region, two dense layers.

    A convolution over one-hot characters is a sum of table rows, one table for each place of the filter.
    Of a case with several windows the first one gives the characters before, the last one those after, and
    all of them the largest values within. ``counts`` has the windows of each case, in order.
    """

    tables: np.ndarray  # (WIDTH, CODES, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    first: np.ndarray  # (regions * FILTERS, HIDDEN)
    first_shift: np.ndarray
    second: np.ndarray  # (HIDDEN,)
    second_shift: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> CharCnn:
        rng = np.random.default_rng(seed)
        wide = len(REGIONS) * FILTERS
        return cls(
            rng.normal(0, 0.15, (WIDTH, CODES, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, (2 / wide) ** 0.5, (wide, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32),
            np.zeros(1, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.shift, self.first, self.first_shift, self.second, self.second_shift]

    def _pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter values by region, and where they are."""
        padded = np.pad(codes, ((0, 0), (PAD, PAD)), constant_values=OUTSIDE)
        values = np.zeros((len(codes), PLACES, FILTERS), np.float32) + self.shift
        for k in range(WIDTH):
            values += self.tables[k][padded[:, k : k + PLACES]]
        pooled, places = [], []
        for low, high in REGIONS:
            at = values[:, low:high].argmax(axis=1)
            pooled.append(np.take_along_axis(values[:, low:high], at[:, None], axis=1)[:, 0])
            places.append(at + low)
        return np.concatenate(pooled, axis=1), np.concatenate(places, axis=1)

    def _combined(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest filter values by region for each case, the places and the windows in which they are."""
        pooled, places = [], []
        for low in range(0, len(codes), 512):
            values, at = self._pooled(codes[low : low + 512])
            pooled.append(values)
            places.append(at)
        pooled, places = np.concatenate(pooled), np.concatenate(places)
        starts = np.cumsum(counts) - counts
        best = np.repeat(starts[:, None], pooled.shape[1], axis=1)
        inside = slice(FILTERS, 2 * FILTERS)
        best[:, 2 * FILTERS :] += (counts - 1)[:, None]
        if len(codes) > len(counts):
            largest = np.repeat(np.maximum.reduceat(pooled[:, inside], starts), counts, axis=0)
            there = np.where(pooled[:, inside] == largest, np.arange(len(codes))[:, None], len(codes))
            best[:, inside] = np.minimum.reduceat(there, starts)
        columns = np.arange(pooled.shape[1])
        return pooled[best, columns], places[best, columns], best

    def logits(self, codes: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        counts = np.ones(len(codes), dtype=np.int64) if counts is None else counts
        if not len(counts):
            return np.zeros(0, np.float32)
        pooled, _, _ = self._combined(codes, counts)
        hidden = np.maximum(np.maximum(pooled, 0) @ self.first + self.first_shift, 0)
        return hidden @ self.second + self.second_shift[0]

    def gradients(
        self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, counts: np.ndarray | None = None
    ) -> list[np.ndarray]:
        """Of the weighted logistic loss."""
        counts = np.ones(len(codes), dtype=np.int64) if counts is None else counts
        pooled, places, windows = self._combined(codes, counts)
        active = np.maximum(pooled, 0)
        before = active @ self.first + self.first_shift
        hidden = np.maximum(before, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.second + self.second_shift[0], -30, 30)))
        out = ((p - labels) * weights / weights.sum()).astype(np.float32)
        to_hidden = np.outer(out, self.second) * (before > 0)
        to_pooled = (to_hidden @ self.first.T) * (pooled > 0)
        padded = np.pad(codes, ((0, 0), (PAD, PAD)), constant_values=OUTSIDE)
        filters = np.tile(np.arange(FILTERS), len(REGIONS))
        tables = np.zeros_like(self.tables)
        for k in range(WIDTH):
            seen = padded[windows, places + k]
            slot = seen * FILTERS + filters
            tables[k] = np.bincount(slot.ravel(), to_pooled.ravel(), CODES * FILTERS).reshape(CODES, FILTERS)
        shift = to_pooled.sum(axis=0).reshape(len(REGIONS), FILTERS).sum(axis=0)
        return [tables, shift, active.T @ to_hidden, to_hidden.sum(axis=0), hidden.T @ out, out.sum(keepdims=True)]


EPOCHS, BATCH, LEAST_STEPS, SEED = 10, 256, 400, 3


def epochs_for(cases: int) -> int:
    """Small samples are gone over more often."""
    return max(EPOCHS, -(-LEAST_STEPS // -(-cases // BATCH)))


def fresh_state(seed: int = SEED) -> np.ndarray:
    """Parameters and both moments of each, in one row."""
    start = np.concatenate([p.ravel() for p in CharCnn.fresh(seed).parameters()])
    return np.concatenate([start, np.zeros(2 * len(start), np.float32)])


def _opened(state: np.ndarray) -> tuple[CharCnn, list[list[np.ndarray]]]:
    """The network and the moments, as views of a state."""
    shapes = [p.shape for p in CharCnn.fresh(0).parameters()]
    cuts = np.cumsum([int(np.prod(shape)) for shape in shapes])
    thirds = [
        [part.reshape(shape) for part, shape in zip(np.split(third, cuts[:-1]), shapes)] for third in np.split(state, 3)
    ]
    return CharCnn(*thirds[0]), thirds[1:]


def net_of(state: np.ndarray) -> CharCnn:
    return _opened(state)[0]


def trained(
    state: np.ndarray,
    codes: np.ndarray,
    labels: np.ndarray,
    weights: np.ndarray,
    counts: np.ndarray,
    these: range,
    epochs: int,
    batch: int = BATCH,
    seed: int = SEED,
) -> np.ndarray:
    """The state after these of all epochs: gradient steps of adaptive size over shuffled batches."""
    state = state.astype(np.float32)
    net, (firsts, seconds) = _opened(state)
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    for _ in range(these.start):
        rng.permutation(len(counts))
    step = these.start * -(-len(counts) // batch)
    for epoch in these:
        rate = 0.004 * (1 - epoch / epochs) + 0.0004
        order = rng.permutation(len(counts))
        for low in range(0, len(counts), batch):
            at = order[low : low + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in at.tolist()])
            step += 1
            found = net.gradients(codes[rows], labels[at], weights[at], counts[at])
            for p, g, first, second in zip(net.parameters(), found, firsts, seconds):
                first *= 0.9
                first += 0.1 * g
                second *= 0.999
                second += 0.001 * g * g
                p -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return state


def fit_cnn(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, counts: np.ndarray | None = None) -> CharCnn:
    """All epochs over cases that are at hand."""
    counts = np.ones(len(codes), dtype=np.int64) if counts is None else counts
    epochs = epochs_for(len(counts))
    return net_of(trained(fresh_state(), codes, labels, weights, counts, range(epochs), epochs))
