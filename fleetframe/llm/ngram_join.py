"""Near-duplicate texts: Jaccard join on word n-grams with Bayesian pruning of candidates.

Texts with the same set of five-word shingles are one class and are compared once. Classes that agree
in a band of MinHash values are candidates. Their values are compared a few at a time, and a pair is
dropped as soon as the posterior probability that its similarity reaches the threshold falls below a
tolerance. What is left is verified on the whole shingle sets: classes that hang together through
surviving pairs are compared with each other exactly.

Pairs never become rows. A bucket or a group of any size is cut into blocks, each pair of blocks is one
piece of work, and it gives link counts and a spanning forest. Of buckets with the same members one
is worked on.

Words are what white space separates, in lower case; a text of one to four words is one shingle. A text
without words (also null) is linked with nothing. Repeated rows and equal texts are linked with each
other. A null id has no class of its own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from fleetframe.llm.common import Memo, map_chunks, map_groups, roots_of, texts_of
from fleetframe.plans.components import components
from fleetframe.plans.lookups import measured
from fleetframe.session import stored

WORDS = 5
THRESHOLD = 0.8
# A pair at the threshold agrees in some band with a probability of 1 - (1 - 0.8 ** 5) ** 26 > 0.9999.
BANDS, BAND_VALUES = 26, 5
VALUES = BANDS * BAND_VALUES
# Values compared between two looks at the posterior, and the tolerance of a look.
VALUES_A_LOOK = 26
TOLERANCE = 1e-6
# Classes that are compared with as many others at once, in a bucket and on whole sets.
BUCKET_BLOCK = 1_000
EXACT_BLOCK = 400
WORDS_KEPT = 400_000
WORD_KEPT_CHARS = 64

RESULT = "doc_id bigint, class_id bigint, n_links bigint, kept boolean"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@functools.cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_310)
    return (
        rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        rng.integers(0, 1 << 63, VALUES, dtype=np.uint64),
    )


@functools.cache
def _words() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8")), WORDS_KEPT, WORD_KEPT_CHARS)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    hashes = np.array(_words().all(text.lower().split()), dtype=np.uint64)
    if not len(hashes):
        return hashes
    runs = max(1, len(hashes) - words + 1)
    mixed = np.zeros(runs, dtype=np.uint64)
    for k in range(min(words, len(hashes))):
        mixed = mixed * _MIX[0] + hashes[k : k + runs]
    mixed ^= mixed >> np.uint64(30)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(27)
    mixed *= _MIX[2]
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 16 bits of each; equal values of different minima are rare chance."""
    factor, offset = _factors()
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None] * factor + offset
        low = np.minimum(low, part.min(axis=0))
    return (low >> np.uint64(20)).astype(np.uint16)


def class_of(hashes: np.ndarray) -> int | None:
    """A number of 64 bits for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())))) if len(hashes) else None


@functools.cache
def fewest_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each look, the fewest matches with which a pair stays.

    With an even prior, n comparisons and m matches leave a posterior probability of
    P(Binomial(n + 1, threshold) <= m) that the similarity reaches the threshold.
    """
    fewest = []
    for n in range(VALUES_A_LOOK, VALUES + 1, VALUES_A_LOOK):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        fewest.append(m)
    return tuple(fewest)


def surviving(
    values: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows, those not dropped at any look."""
    matches = np.zeros(len(left), dtype=np.int64)
    for look, fewest in enumerate(fewest_matches(threshold, tolerance)):
        part = slice(look * VALUES_A_LOOK, (look + 1) * VALUES_A_LOOK)
        matches += (values[left, part] == values[right, part]).sum(axis=1)
        stay = matches >= fewest
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def _pairs(blocks: list[int], first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one block, or of two different ones."""
    number = np.array(blocks)
    if first == second:
        return np.triu_indices(len(number), 1)
    a, b = np.flatnonzero(number == first), np.flatnonzero(number == second)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class, values) of every text."""

    def start():
        def step(columns):
            sets = [shingles(t) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"],
                "text_hash": columns["text_hash"],
                "class": [class_of(s) for s in sets],
                "values": [minhash(s).tobytes() if len(s) else None for s in sets],
            }

        return step

    texts = _with_hash(texts_of(docs))
    return map_chunks(texts, start, "doc_id bigint, text_hash bigint, class bigint, values binary")


def _with_hash(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text_hash", F.xxhash64("text"))


def _blocked(members: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Members of groups dealt to pairs of blocks; ``size`` holds the number of members of the group."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("class", F.lit(7)), blocks).cast("int")
    return (
        members.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .drop("other", size)
    )


def candidate_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BUCKET_BLOCK) -> DataFrame:
    """(class, root): a spanning forest of the pairs that agree in a band and survive all looks."""

    def bands():
        def step(columns):
            rows = np.frombuffer(b"".join(columns["values"]), dtype=np.uint16).reshape(-1, VALUES)
            keys = np.zeros((len(rows), BANDS), dtype=np.uint64)
            for k in range(BAND_VALUES):
                keys = (keys + rows[:, k::BAND_VALUES].astype(np.uint64) + np.uint64(1)) * _MIX[k % 3]
                keys ^= keys >> np.uint64(29)
            keys = (keys + np.arange(BANDS, dtype=np.uint64)) * _MIX[1]
            keys ^= keys >> np.uint64(31)
            return {"class": np.repeat(columns["class"], BANDS), "bucket": keys.ravel().view(np.int64)}

        return step

    in_buckets = map_chunks(classes.select("class", "values"), bands, "class bigint, bucket bigint", rows=4096)
    # Buckets with the same number of members and the same combined hashes have the same members.
    same = [F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"), F.count(F.lit(1)).alias("n")]
    shared = in_buckets.groupBy("bucket").agg(*same).filter("n > 1")
    kept = shared.groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = in_buckets.join(kept, "bucket").join(classes.select("class", "values"), "class")

    def compare():
        def work(key, rows):
            values = np.frombuffer(b"".join(rows["values"]), dtype=np.uint16).reshape(-1, VALUES)
            left, right = surviving(values, *_pairs(rows["block"], key[1], key[2]), threshold)
            if not len(left):
                return None
            ids = np.array(rows["class"])
            roots = roots_of(len(ids), left, right)
            moved = np.flatnonzero(roots != np.arange(len(ids)))
            return {"class": ids[moved], "root": ids[roots[moved]]}

        return work

    work = _blocked(members, "bucket", "n", block)
    return map_groups(work, ["bucket", "first", "second"], compare, "class bigint, root bigint")


def jaccard(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact similarity of two lists of sets, each set with each, from products of 0/1 columns."""
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, len(every), 4096):
        at = slice(*np.searchsorted(place, (low, low + 4096)))
        held = np.zeros((len(sets), min(4096, len(every) - low)), dtype=np.float32)
        held[owner[at], place[at] - low] = 1
        both += held[left] @ held[right].T
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    return both / (sizes[left][:, None] + sizes[right][None, :] - both)


def verified_links(groups: DataFrame, threshold: float = THRESHOLD, block: int = EXACT_BLOCK) -> DataFrame:
    """(class, links, root) from (component, n, class, weight, text): exact links within components."""

    def compare():
        def work(key, rows):
            if len(rows["class"]) < 2:
                return None
            sets = [shingles(t) for t in rows["text"]]
            ids, weights = np.array(rows["class"]), np.array(rows["weight"])
            number = np.array(rows["block"])
            left = np.flatnonzero(number == key[1])
            right = np.flatnonzero(number == key[2])
            if not len(left) or not len(right):
                return None
            close = jaccard(sets, left, right) >= threshold
            if key[1] == key[2]:
                np.fill_diagonal(close, False)
            a, b = np.nonzero(close)
            links = np.zeros(len(ids), dtype=np.int64)
            links[left] += close @ weights[right]
            if key[1] != key[2]:
                links[right] += close.T @ weights[left]
            roots = roots_of(len(ids), left[a], right[b])
            linked = np.flatnonzero(links)
            return {"class": ids[linked], "links": links[linked], "root": ids[roots[linked]]}

        return work

    work = _blocked(groups, "component", "n", block)
    return map_groups(
        work, ["component", "first", "second"], compare, "class bigint, links bigint, root bigint"
    )


def joined(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the smallest id its class is linked with, its direct links, whether it stays.

    Links count other documents with a similarity of at least ``threshold``, equal texts included.
    """
    texts = texts_of(docs)
    rows = stored(described(docs))
    # A class is represented by a row with its smallest id, or without ids by one of its texts.
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    classes = stored(
        rows.filter("class IS NOT NULL")
        .groupBy("class")
        .agg(
            named.alias("named"),
            F.min("text_hash").alias("any_hash"),
            F.count(F.lit(1)).alias("weight"),
            F.min("values").alias("values"),
        )
        .select(
            "class",
            F.col("named.doc_id").alias("rep"),
            F.coalesce("named.text_hash", "any_hash").alias("rep_hash"),
            "weight",
            "values",
        )
    )
    parts = components(candidate_links(classes, threshold), "class", "root")
    # Only the size of a component of several blocks matters. There are fewer of these than blocks, so they
    # are sent to the parts, and no component meets in one task.
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EXACT_BLOCK)
    wanted = (
        parts.join(measured(sizes).hinted(), "component", "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumnRenamed("node", "class")
        .join(classes.select("class", "rep", "rep_hash", "weight"), "class")
    )
    groups = _with_texts(wanted, texts)
    found = stored(verified_links(groups, threshold))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    whole = components(found.filter("class <> root"), "class", "root").withColumnRenamed("node", "class")
    linked = (
        classes.select("class", "rep", "weight")
        .join(links, "class", "left")
        .join(whole, "class", "left")
        .select(
            "class",
            "rep",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class").alias("part"),
        )
    )
    least = linked.groupBy("part").agg(F.min("rep").alias("class_id"))
    per_class = linked.join(least, "part").select("class", "n_links", "class_id")
    return (
        rows.select("doc_id", "class")
        .join(per_class, "class", "left")
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )


def _with_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the text of each class: that of its representative, checked by its shingles.

    Rows without an id are reduced to distinct texts first, so a join on a null id brings a class no more than
    the texts that share its hash.
    """
    hashed = _with_hash(texts)
    nameless = hashed.filter("doc_id IS NULL").groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"))
    of_class = wanted.select(F.col("class").alias("sought"), "rep", "rep_hash")
    read = (
        hashed.filter("doc_id IS NOT NULL")
        .join(of_class.filter("rep IS NOT NULL"), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
        .unionByName(nameless.join(of_class.filter("rep IS NULL"), F.col("text_hash") == F.col("rep_hash")))
    )

    def start():
        def step(columns):
            right = [
                i
                for i, (text, sought) in enumerate(zip(columns["text"], columns["sought"]))
                if class_of(shingles(text)) == sought
            ]
            return {
                "class": [columns["sought"][i] for i in right],
                "text": [columns["text"][i] for i in right],
            }

        return step

    one = (
        map_chunks(read.select("sought", "text"), start, "class bigint, text string")
        .groupBy("class")
        .agg(F.min("text").alias("text"))
    )
    return wanted.select("component", "n", "class", "weight").join(one, "class")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same columns, one row of each class: the one with the smallest id.

    Of rows with one id those with equal texts are taken once; if one of its texts stays, so do its others. Rows
    with a null id stay.
    """
    kept = joined(docs, threshold).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter(docs["doc_id"].isNull()))
