"""Interpolated modified Kneser-Ney scores from sorted hash arrays in memory-mapped files.

Counting runs in Spark in three steps, each with partial sums before its shuffle: words by hash, pairs
of neighbouring words by a hash of their numbers, and for each word how many pairs it starts and ends.
Every step deals its keys to buckets of bounded size, and the task of a bucket writes it as a sorted
array to the shared checkpoint folder. Scoring tasks map these files and look up the sorted distinct
keys of a few texts at a time, so a lookup walks through the arrays in order.

The number of a word is its place in the sorted array of word hashes. A pair's key is a number made of
both words' numbers, scattered by an odd factor: frequent first words spread over all buckets, and the
key can be turned back into the two numbers.

A token is a word or the end of a text. A null or empty text is the end alone. Tokens not seen in
training share the mass left for one unseen word. Repeated rows are scored alike, and counted each.
Other columns are ignored. Without training texts, all tokens are unseen.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetframe.llm.common import Memo, id_remainder, map_chunks, shared_folder, store_of, texts_of
from fleetframe.session import pin

# Text characters for each bucket of words, and of pairs.
WORD_BUCKET_CHARS = 50_000_000
PAIR_BUCKET_CHARS = 10_000_000
# Tokens counted in memory before they are passed on.
TOKENS_AT_ONCE = 2_000_000
WORDS_KEPT = 900_000
WORD_KEPT_BYTES = 64
ROWS_AT_ONCE = 1_024

# An odd factor and what undoes it modulo 2 ** 64.
SCATTER = np.uint64(0x9E3779B97F4A7C15)
GATHER = np.uint64(pow(int(SCATTER), -1, 1 << 64))

RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double, perplexity double"
)
PARTS = "bucket int, keys binary, counts binary"


def hash_of(word: bytes) -> bytes:
    """A hash of 64 bits, the highest byte first."""
    return xxhash.xxh3_64_digest(word)


# No word holds a line break.
END = hash_of(b"\n")


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8").lower().split()


@functools.cache
def _hashes() -> Memo:
    return Memo(hash_of, WORDS_KEPT, WORD_KEPT_BYTES)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, each text with its end, and where each text stops."""
    memo = _hashes()
    found, stops, total = [], [], 0
    for text in texts:
        tokens = memo.all(words_of(text))
        found += tokens
        found.append(END)
        total += len(tokens) + 1
        stops.append(total)
    hashes = np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)
    return hashes, np.array(stops, dtype=np.int64)


# --- Sorted keys and counts as compact bytes ---------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: equal high bytes then cost nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    width = np.dtype(kind).itemsize
    rows = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(rows).view(kind).ravel()


def packed(values: np.ndarray, ascending: bool) -> bytes:
    values = values.astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0)) if ascending else values
    return zstandard.ZstdCompressor(level=1).compress(_planes(steps))


def unpacked(data: bytes, ascending: bool) -> np.ndarray:
    values = _from_planes(zstandard.ZstdDecompressor().decompress(data), np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = None if counts is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(counts[order], first)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the high half of 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ranges_of(sorted_groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, low, high) of each group that occurs in a sorted array; others cost nothing."""
    if len(sorted_groups):
        lows = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]))
        highs = np.append(lows[1:], len(sorted_groups))
        yield from zip(sorted_groups[lows].tolist(), lows.tolist(), highs.tolist())


def in_buckets(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys cut where the bucket changes."""
    for b, low, high in ranges_of(bucket_of(keys, buckets)):
        yield b, keys[low:high], counts[low:high]


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    buckets, keys, counts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
        names=["bucket", "keys", "counts"],
    )


def counted(texts: DataFrame, keys_of, buckets: int) -> DataFrame:
    """Partial counts of the keys that ``keys_of()`` makes from texts, as packed parts of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = keys_of()
        waiting: list[np.ndarray] = []
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            rows = [
                (b, packed(k, True), packed(c, False))
                for b, k, c in in_buckets(*summed(np.concatenate(waiting)), buckets)
            ]
            if rows:
                yield _part_rows(rows)

        for batch in batches:
            column = batch.column("text")
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                keys = make(column.slice(low, ROWS_AT_ONCE).to_pylist())
                waiting.append(keys)
                size += len(keys)
                if size >= TOKENS_AT_ONCE:
                    yield from passed_on()
                    waiting, size = [], 0
        if size:
            yield from passed_on()

    return texts.select("text").mapInArrow(run, PARTS)


def merged(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return summed(
        np.concatenate([unpacked(k, True) for k in part["keys"]]),
        np.concatenate([unpacked(c, False) for c in part["counts"]]).astype(np.int64),
    )


# --- Arrays in the shared folder ---------------------------------------------------------------


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write under a name of its own first: a task that is run again leaves one whole file."""
    files, path = store_of(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(values))
    files.move(own, f"{path}/{name}")


@functools.lru_cache(maxsize=20_000)
def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the shared folder, mapped; from a store without paths it is copied first."""
    files, path = store_of(folder)
    path = f"{path}/{name}"
    info = files.get_file_info(path)
    if info.type == pyarrow.fs.FileType.NotFound or not info.size:
        return np.zeros(0, dtype=kind)
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    # The copy has no name any more once it is mapped, so it goes with the worker.
    with tempfile.TemporaryFile() as local:
        with files.open_input_stream(path) as source:
            while chunk := source.read(1 << 24):
                local.write(chunk)
        local.flush()
        return np.memmap(local, dtype=kind, mode="r")


def write_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts in 32 bits each, or in 64 where one of them needs more."""
    wide = counts.size and int(counts.max()) >> 32
    write_array(folder, name, counts.astype("<u8" if wide else "<u4"))


def mapped_counts(folder: str, name: str, size: int) -> np.ndarray:
    """Counts written by ``write_counts``, of which there are ``size``."""
    held = mapped(folder, name, "u1")
    return held.view("<u8" if size and len(held) == 8 * size else "<u4")


# --- The model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Discounts:
    """What is taken off counts of 1, 2 and 3 or more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """From how many keys have the counts 1 to 4; where these are too few, the plain 0.5, 1, 1.5."""
        if min(n) <= 0:
            return cls(0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        return cls(*(float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(found)))

    def off(self, counts: np.ndarray) -> np.ndarray:
        return np.select([counts <= 0, counts == 1, counts == 2], [0.0, self.one, self.two], self.more)


@dataclass(frozen=True)
class Model:
    folder: str
    word_starts: np.ndarray  # number of the first word of each bucket, and of all words
    pair_buckets: int
    tokens: int
    texts: int
    pairs: int
    pair_discounts: Discounts
    word_discounts: Discounts
    word_rest: float  # mass that the words' own counts leave

    @property
    def words(self) -> int:
        return int(self.word_starts[-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 for words not seen."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        for b, low, high in ranges_of(bucket_of(hashes, len(self.word_starts) - 1)):
            places = _places(mapped(self.folder, f"words-{b}", "<u8"), hashes[low:high])
            found[low:high] = np.where(places < 0, -1, places + self.word_starts[b])
        return found

    def of_words(self, name: str, numbers: np.ndarray, columns: int = 1) -> np.ndarray:
        """Stored values of sorted distinct word numbers."""
        found = np.zeros((len(numbers), columns), dtype=np.int64)
        limits = np.append(self.word_starts[:-1], self.words + 1)
        for b, low, high in ranges_of(np.searchsorted(limits, numbers, side="right") - 1):
            values = mapped_counts(self.folder, f"{name}-{b}", columns * self.rows_of(name, b))
            if len(values):
                found[low:high] = values.reshape(-1, columns)[numbers[low:high] - limits[b]]
        return found

    def rows_of(self, name: str, bucket: int) -> int:
        """Entries of an array of words; the statistics have a row more, for the start of a text."""
        last = bucket == len(self.word_starts) - 2
        return int(self.word_starts[bucket + 1] - self.word_starts[bucket]) + (1 if last and name == "stats" else 0)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct scattered keys."""
        found = np.zeros(len(keys), dtype=np.int64)
        for b, low, high in ranges_of(bucket_of(keys, self.pair_buckets)):
            stored = mapped(self.folder, f"pairs-{b}", "<u8")
            places = _places(stored, keys[low:high])
            counts = mapped_counts(self.folder, f"pair-counts-{b}", len(stored))
            hit = places >= 0
            found[low:high][hit] = counts[places[hit]]
        return found


def _places(stored: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(stored):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
    return np.where(stored[at] == wanted, at, -1)


def pair_keys(first: np.ndarray, second: np.ndarray, words: int) -> np.ndarray:
    return (first.astype(np.uint64) * np.uint64(words + 1) + second.astype(np.uint64)) * SCATTER


def split_keys(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    plain = keys * GATHER
    return (plain // np.uint64(words + 1)).astype(np.int64), (plain % np.uint64(words + 1)).astype(np.int64)


def before(numbers: np.ndarray, stops: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; ``start`` at the start of a text."""
    shifted = np.empty_like(numbers)
    shifted[1:] = numbers[:-1]
    shifted[np.concatenate([[0], stops[:-1]])] = start
    return shifted


def train(texts: DataFrame) -> Model:
    """Count the texts of a (doc_id, text) frame and write the arrays to the shared folder."""
    spark: SparkSession = texts.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    size = texts.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    chars, n_texts = size["chars"] or 0, size["n"]
    word_buckets = max(2, -(-chars // WORD_BUCKET_CHARS))
    pair_buckets = max(4, -(-chars // PAIR_BUCKET_CHARS))

    def word_keys():
        return lambda chunk: hashed(chunk)[0]

    def write_words(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        keys, counts = merged(part)
        write_array(folder, f"words-{b}", keys.astype("<u8"))
        write_counts(folder, f"word-counts-{b}", counts)
        return pd.DataFrame({"bucket": [b], "words": [len(keys)], "tokens": [int(counts.sum())]})

    # One small row per bucket comes to the driver.
    rows = (
        counted(texts, word_keys, word_buckets)
        .groupBy("bucket")
        .applyInPandas(write_words, "bucket int, words bigint, tokens bigint")
        .collect()
    )
    per_bucket = np.zeros(word_buckets, dtype=np.int64)
    for row in rows:
        per_bucket[row["bucket"]] = row["words"]
    tokens = sum(row["tokens"] for row in rows)
    starts = np.concatenate([[0], per_bucket.cumsum()])
    numbers_only = Model(
        folder, starts, pair_buckets, tokens, n_texts, 0, Discounts.of([0] * 4), Discounts.of([0] * 4), 0.0
    )
    words = numbers_only.words

    def keys_of_pairs():
        def make(chunk: list[str]) -> np.ndarray:
            hashes, stops = hashed(chunk)
            distinct, place = np.unique(hashes, return_inverse=True)
            numbers = numbers_only.numbers(distinct)[place]
            return pair_keys(before(numbers, stops, words), numbers, words)

        return make

    limits = np.append(starts[:-1], words + 1)

    def write_pairs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        keys, counts = merged(part)
        write_array(folder, f"pairs-{b}", keys.astype("<u8"))
        write_counts(folder, f"pair-counts-{b}", counts)
        first, second = split_keys(keys, words)
        # For each word: pairs it starts that were seen once, twice, more often, and pairs it ends.
        seen = [first[counts == 1], first[counts == 2], first[counts > 2], second]
        rows = [(-1, i, np.int64(n), b"") for i, n in enumerate([(counts == k).sum() for k in (1, 2, 3, 4)])]
        rows.append((-1, 4, np.int64(len(keys)), b""))
        for column, ids in enumerate(seen):
            ids, sums = summed(ids.astype(np.uint64))
            for w, low, high in ranges_of(np.searchsorted(limits, ids.astype(np.int64), side="right") - 1):
                data = packed(ids[low:high], True) + b"|split|" + packed(sums[low:high], False)
                rows.append((w, column, np.int64(0), data))
        return pd.DataFrame(rows, columns=["bucket", "column", "n", "data"])

    found = pin(
        counted(texts, keys_of_pairs, pair_buckets)
        .groupBy("bucket")
        .applyInPandas(write_pairs, "bucket int, column int, n bigint, data binary")
    )
    n = {r["column"]: r["n"] for r in found.filter("bucket < 0").groupBy("column").agg(F.sum("n").alias("n")).collect()}

    def write_stats(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        values = np.zeros((int(limits[b + 1] - limits[b]), 4), dtype=np.int64)
        for column, data in zip(part["column"], part["data"]):
            ids, sums = data.split(b"|split|", 1)
            at = unpacked(ids, True).astype(np.int64) - int(limits[b])
            values[at, column] += unpacked(sums, False).astype(np.int64)
        write_counts(folder, f"stats-{b}", values)
        ends = values[:, 3]
        return pd.DataFrame([[*(int((ends == k).sum()) for k in (1, 2, 3, 4)), int((ends > 0).sum())]], columns=list("abcde"))

    stats = (
        found.filter("bucket >= 0")
        .groupBy("bucket")
        .applyInPandas(write_stats, "a bigint, b bigint, c bigint, d bigint, e bigint")
        .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcde"))
        .first()
    )
    word_discounts = Discounts.of([stats[c] for c in "abcd"])
    more = stats["e"] - stats["a"] - stats["b"]
    rest = word_discounts.one * stats["a"] + word_discounts.two * stats["b"] + word_discounts.more * more
    return Model(
        folder,
        starts,
        pair_buckets,
        tokens,
        n_texts,
        n.get(4, 0),
        Discounts.of([n.get(k, 0) for k in range(4)]),
        word_discounts,
        float(rest),
    )


def probabilities(model: Model, hashes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its count in training and its probability after the token before it."""
    distinct, place = np.unique(hashes, return_inverse=True)
    numbers = model.numbers(distinct)
    known = numbers >= 0
    count = np.zeros(len(distinct), dtype=np.int64)
    stats = np.zeros((len(distinct), 4), dtype=np.int64)
    count[known] = model.of_words("word-counts", numbers[known])[:, 0]
    stats[known] = model.of_words("stats", numbers[known], 4)
    start_stats = model.of_words("stats", np.array([model.words]), 4)[0]
    # The lower order: in how many pairs a word comes second, the rest spread over all words and one unseen.
    if model.pairs:
        ends = stats[:, 3]
        lower = np.maximum(ends - model.word_discounts.off(ends), 0) + model.word_rest / (model.words + 1)
        lower /= model.pairs
    else:
        lower = np.full(len(distinct), 1.0 / (model.words + 1))

    token = numbers[place]
    previous = before(np.arange(len(distinct))[place], stops, -1)
    starts_text = previous < 0
    context_count = np.where(starts_text, model.texts, count[previous])
    context_stats = np.where(starts_text[:, None], start_stats[None, :], stats[previous])
    context = np.where(starts_text, model.words, numbers[previous])
    pair = np.zeros(len(token), dtype=np.int64)
    both = (token >= 0) & (context >= 0)
    if both.any():
        keys, at = np.unique(pair_keys(context[both], token[both], model.words), return_inverse=True)
        pair[both] = model.pair_counts(keys)[at]
    d = model.pair_discounts
    left = context_stats[:, 0] * d.one + context_stats[:, 1] * d.two + context_stats[:, 2] * d.more
    seen = np.maximum(context_count, 1)
    interpolated = (np.maximum(pair - d.off(pair), 0) + left * lower[place]) / seen
    return count[place], np.where((context_count > 0) & (context >= 0), interpolated, lower[place])


def scored(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """Token counts, the unigram base score, the model's log10 probability and perplexity of each text."""
    marked = texts_of(docs, (F.lit(False) if held_out is None else held_out).alias("held_out"))

    def start():
        spread = model.tokens + 0.5 * (model.words + 1)

        def step(columns):
            hashes, stops = hashed(columns["text"])
            firsts = np.concatenate([[0], stops[:-1]])
            count, chance = probabilities(model, hashes, stops)
            base = np.add.reduceat(np.log10((count + 0.5) / spread), firsts)
            score = np.add.reduceat(np.log10(chance), firsts)
            sizes = stops - firsts
            with np.errstate(over="ignore"):
                perplexity = np.power(10.0, -score / sizes)
            return {
                "doc_id": columns["doc_id"],
                "held_out": columns["held_out"],
                "n_tokens": sizes,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), firsts),
                "train_tokens": np.full(len(sizes), model.tokens),
                "base_score": base,
                "score": score,
                "perplexity": perplexity,
            }

        return step

    return map_chunks(marked, start, RESULT, rows=ROWS_AT_ONCE)


def train_and_score(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """Learn from texts whose id does not have the given remainder and score all of them."""
    aside = id_remainder(modulus) == remainder
    model = train(texts_of(docs.filter(~aside)))
    return scored(docs, model, aside)
