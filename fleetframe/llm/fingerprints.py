"""Document fingerprints by randomised edit embedding.

All texts take the same random walk: at step j a text stands at one of its characters, and a random bit
for (j, character) says whether it moves on. What it stands at in every step is its embedding. Texts a
few edits apart fall into step again soon after each edit, so their embeddings differ in few steps:
edit distance becomes Hamming distance. A fingerprint samples the embedding at fixed steps, the same
ones for all texts: all of the first ones, and equally many from each later range that doubles, with
four bits of the character there. The likeness of two fingerprints weighs the agreement in each range
by its length; steps that only one of the embeddings has disagree.

For near-duplicates, bands of sampled bits find candidates and the likeness of whole fingerprints
verifies them.

A null text counts as empty; its fingerprint has no samples, and two empty ones are alike. Repeated rows
and ties in doc_id follow each other by text, null ids come first. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetframe.llm.common import map_chunks, map_groups, roots_of, texts_of
from fleetframe.plans.components import components
from fleetframe.session import pin

# Random bits repeat after so many steps; characters fall into so many kinds.
PERIOD_BITS, KINDS = 12, 256
# Samples of each range of steps that doubles the one before.
SAMPLES = 64
RANGES = 40
SEED = 20_240_310
# Text characters for each range of ids that is read in order.
ORDERED_CHARS = 8_000_000
# Most ranges of ids; their cuts are known to the driver. Beyond, ranges get longer: a task reads its range in order.
MOST_RANGES = 50_000

BANDS, BAND_SAMPLES = 16, 6
ALIKE = 0.8
BLOCK = 500

RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


@functools.cache
def _steps() -> bytes:
    """Steps until a text moves on from a kind of character, by kind and by step within the period."""
    period = 1 << PERIOD_BITS
    moves = np.random.default_rng(SEED).integers(0, 2, (KINDS, period), dtype=np.uint8)
    moves[:, ::64] = 1
    twice = np.concatenate([moves, moves], axis=1)
    step = np.arange(2 * period)
    following = np.where(twice == 1, step, 2 * period)
    following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
    return (following[:, :period] - step[:period] + 1).astype(np.uint8).tobytes()


@functools.cache
def _samples() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in rising order, and the first step of each range."""
    rng = np.random.default_rng(SEED + 1)
    starts = [0] + [SAMPLES << k for k in range(RANGES - 1)]
    steps = [np.arange(SAMPLES)]
    steps += [np.sort(rng.choice(s, SAMPLES, replace=False) if s < 1 << 20 else rng.integers(0, s, SAMPLES)) + s for s in starts[1:]]
    return np.concatenate(steps), np.array(starts + [SAMPLES << (RANGES - 1)])


def kinds_of(text: str) -> bytes:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def walk(kinds: bytes, start: int = 0) -> list[int]:
    """The step at which each character is reached, and the one after the last."""
    steps, mask, shift = _steps(), (1 << PERIOD_BITS) - 1, PERIOD_BITS
    return list(accumulate(kinds, lambda j, c: j + steps[c << shift | j & mask], initial=start))


class Fingerprint:
    """Length of the embedding and its samples."""

    def __init__(self, length: int, samples: np.ndarray) -> None:
        self.length, self.samples = length, samples

    @classmethod
    def of(cls, kinds: bytes, reached: list[int]) -> Fingerprint:
        length = reached[-1]
        at, _ = _samples()
        at = at[: np.searchsorted(at, length)]
        standing = np.searchsorted(np.array(reached[:-1], dtype=np.int64), at, side="right") - 1
        return cls(length, np.frombuffer(kinds, np.uint8)[standing] & 15 if len(at) else np.zeros(0, np.uint8))

    def written(self) -> str:
        nibbles = self.samples if len(self.samples) % 2 == 0 else np.append(self.samples, 0)
        return f"{self.length:x}:{(nibbles[::2] << 4 | nibbles[1::2]).astype(np.uint8).tobytes().hex()}"

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        length, _, data = text.partition(":")
        both = np.frombuffer(bytes.fromhex(data), np.uint8)
        at, _ = _samples()
        count = int(np.searchsorted(at, int(length, 16)))
        return cls(int(length, 16), np.stack([both >> 4, both & 15], axis=1).ravel()[:count])

    def likeness(self, other: Fingerprint) -> float:
        """Share of steps in which the embeddings agree, estimated range by range; 1 for equal ones."""
        short, long = sorted((self.length, other.length))
        if not long:
            return 1.0
        n = min(len(self.samples), len(other.samples))
        if not n:
            return 0.0
        same = self.samples[:n] == other.samples[:n]
        starts = np.arange(0, n, SAMPLES)
        agree = np.add.reduceat(same, starts, dtype=np.int64) / np.minimum(SAMPLES, n - starts)
        bounds = np.minimum(_samples()[1][: len(starts) + 1], short)
        # A range of which nothing was sampled yet agrees like the one before.
        bounds[-1] = short
        return float(np.diff(bounds) @ agree / long)


def fingerprint(text: str) -> Fingerprint:
    kinds = kinds_of(text)
    return Fingerprint.of(kinds, walk(kinds))


class _Read:
    """A text with its walk, so that an edited ending goes on from where it begins."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.kinds = kinds_of(text)
        self.reached = walk(self.kinds)
        self.print = Fingerprint.of(self.kinds, self.reached)

    def against(self, following: _Read) -> tuple:
        n = len(self.kinds)
        cut = n // 4
        edited = self.text[: n - cut] + following.text[:cut]
        kinds = self.kinds[: n - cut] + following.kinds[:cut]
        reached = self.reached[: n - cut] + walk(following.kinds[:cut], self.reached[n - cut])
        changed = Fingerprint.of(kinds, reached)
        return (
            self.doc_id,
            n,
            hashlib.sha256(edited.encode("utf-8")).hexdigest(),
            self.print.written(),
            changed.written(),
            self.print.likeness(changed),
            self.print.likeness(following.print),
        )


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) by ranges of ids, each range followed by the row that comes next.

    ``look`` marks these copies. The ranges are cut at ids of rows, so the first row of a range is
    known from the cuts, and the range before gets a copy of it; the last one gets the first of all.
    """
    keyed = texts_of(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    size = keyed.agg(F.sum(F.length("text")).alias("chars"), F.min("k").alias("least")).first()
    parts = min(MOST_RANGES, max(1, -(-(size["chars"] or 0) // ORDERED_CHARS)))
    cuts = np.zeros(0, dtype=np.int64)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = keyed.agg(F.percentile_approx("k", shares, max(10_000, 4 * parts)).alias("cuts")).first()["cuts"]
        cuts = np.unique(np.array([c for c in found if c > size["least"]], dtype=np.int64))
    last, least = len(cuts), size["least"]

    @F.pandas_udf("struct<part: int, look: int>")
    def place(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy()
        part = np.searchsorted(cuts, k, side="right")
        first = (k == least) if not last else np.where(part > 0, k == cuts[np.maximum(part, 1) - 1], k == least)
        return pd.DataFrame({"part": part, "look": np.where(first, np.where(part > 0, part - 1, last), -1)})

    placed = keyed.withColumn("p", place("k"))
    own = F.struct(F.col("p.part").alias("part"), F.lit(0).alias("look"))
    copy = F.struct(F.col("p.look").alias("part"), F.lit(1).alias("look"))
    spread = placed.withColumn(
        "to", F.explode(F.when(F.col("p.look") >= 0, F.array(own, copy)).otherwise(F.array(own)))
    )
    return (
        spread.select("to.part", "to.look", "k", "doc_id", "text")
        .repartitionById(last + 1, "part")
        .sortWithinPartitions("part", "look", "k", "text")
        .select("part", "look", "doc_id", "text")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    In the edited form the last quarter of the characters is replaced by the first characters of the
    next document in the order of ids; the first one follows the last.
    """
    schema = T.StructType.fromDDL(RESULT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Read | None = None
        part = None
        for batch in batches:
            made = []
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64).to_pydict()
                for own, look, doc_id, text in zip(rows["part"], rows["look"], rows["doc_id"], rows["text"]):
                    if own != part:
                        part, before = own, None
                    elif before is None:
                        continue  # more copies with the same id
                    read = _Read(doc_id, text)
                    if before is not None:
                        made.append(before.against(read))
                    before = None if look else read
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(zip(*made), arrow)], schema=arrow
                )

    return _in_order(docs).mapInArrow(run, schema)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""

    def start():
        def step(columns):
            return {"doc_id": columns["doc_id"], "fingerprint": [fingerprint(t).written() for t in columns["text"]]}

        return step

    return map_chunks(texts_of(docs), start, "doc_id bigint, fingerprint string")


def _band_keys(print_: Fingerprint) -> list[str]:
    """Bands of samples from every range that the embedding fills: texts on both sides of a doubling share
    some, and where most of the difference falls into one range, the others still agree."""
    full = len(print_.samples) // SAMPLES
    if not full:
        return ["short:" + print_.written()]
    keys = []
    for k in range(full):
        own = print_.samples[k * SAMPLES : (k + 1) * SAMPLES]
        chosen = np.random.default_rng(SEED + 2 + k).integers(0, SAMPLES, (BANDS, BAND_SAMPLES))
        keys += [f"{k}:{b}:{own[row].tobytes().hex()}" for b, row in enumerate(chosen)]
    return keys


def near_duplicates(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(doc_id, class_id): documents that hang together through fingerprints at least so alike.

    Buckets of any size are compared in pairs of blocks; of buckets with the same members one is.
    """
    rows = pin(fingerprinted(docs).withColumn("class", F.xxhash64("fingerprint")))
    classes = rows.groupBy("class").agg(F.min("fingerprint").alias("fingerprint"))

    def bands():
        def step(columns):
            keys = [_band_keys(Fingerprint.read(f)) for f in columns["fingerprint"]]
            return {
                "class": [c for c, k in zip(columns["class"], keys) for _ in k],
                "key": [x for k in keys for x in k],
            }

        return step

    banded = map_chunks(classes, bands, "class bigint, key string").select("class", F.xxhash64("key").alias("bucket"))
    same = [F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"), F.count(F.lit(1)).alias("n")]
    shared = banded.groupBy("bucket").agg(*same).filter("n > 1")
    kept = shared.groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    work = (
        banded.join(kept, "bucket")
        .join(classes, "class")
        .withColumn("block", F.pmod(F.xxhash64("class", F.lit(3)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "class", "fingerprint")
    )

    def compare():
        def step(key, columns):
            prints = [Fingerprint.read(f) for f in columns["fingerprint"]]
            ids, block = columns["class"], columns["block"]
            pairs = [
                (i, j)
                for i in range(len(ids))
                for j in range(i + 1, len(ids))
                if (key[1] == key[2] or block[i] != block[j]) and prints[i].likeness(prints[j]) >= alike
            ]
            if not pairs:
                return None
            left, right = np.array(pairs).T
            roots = roots_of(len(ids), left, right)
            moved = np.flatnonzero(roots != np.arange(len(ids))).tolist()
            return {"class": [ids[i] for i in moved], "root": [ids[roots[i]] for i in moved]}

        return step

    links = map_groups(work, ["bucket", "first", "second"], compare, "class bigint, root bigint")
    parts = components(links, "class", "root").withColumnRenamed("node", "class")
    placed = rows.join(parts, "class", "left").withColumn("part", F.coalesce("component", "class"))
    least = placed.groupBy("part").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "part").select("doc_id", "class_id")
