"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes.

Terms are all words of the examples, a bounded sample of labelled texts. How many documents hold each word is
counted over all documents. A word's weight is its inverse document frequency times how well it tells
toxic examples from others, a factor that is never zero: no word of an example is ignored.

The index keeps, of each word, the examples that hold it with their weights, cut where blocks of similar
examples end, and the largest weight of each piece. A text's nearest examples are exact: a block is passed
over only if the largest weights of the text's words in it cannot beat what was found.

The model is made in one task, from the bounded sample and the counts of its words, and lies in the checkpoint
folder, where the scoring tasks read it; the driver holds neither.

Examples with the same text are one, which votes as often as it was drawn. The votes of the nearest
examples, weighted by their cosine and by how common their label is, are turned into a probability by the
labelled texts themselves, each judged by all others; there a text counts once for each of its labels,
however many copies it has, as rows equal to an example find that example.

A text without any word of the examples (also null or empty) gets the share of toxic ones among such labelled
texts, or, if none was drawn, the probability of a text without toxic votes.
Without labels of both kinds all texts get the share of toxic labels, or 0. Repeated rows get equal
scores; other columns, labels included, are ignored when scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe.llm.boosted_trees import calibrated, monotone_levels
from fleetframe.llm.common import (
    ROWS_AT_ONCE, SAMPLE_SEED, fields_of, id_remainder, map_chunks, read_object, sampled_ids, shared_folder, texts_of,
    write_object,
)

# Bounds of what is learned from, for each kind: labelled texts, and their characters together. They also
# bound the index that is sent to the workers.
EXAMPLES_OF_A_KIND = 2_500
EXAMPLE_CHARS = 32_000_000
# At this chi-squared a word that tells the kinds apart has a quarter of the largest factor.
HALF_CHI = 100.0
LEAST_FACTOR = 0.001
NEIGHBOURS = 15
BLOCK = 32
# Words whose weights are kept for each example, strong and common ones, and texts that meet them at a time.
COMMON_WORDS = 512
QUERIES_AT_ONCE = 64
# Score from which on a text counts as toxic.
TOXIC_FROM = 0.3

RESULT = (
    "doc_id bigint, held_out boolean, score double, predicted int, nearest_doc_id bigint, "
    "nearest_cosine double, nearest_toxic int"
)

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Rows:
    """Sparse rows: row i holds ``values`` at ``terms`` from ``starts[i]`` up to ``starts[i + 1]``."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    @classmethod
    def of_texts(cls, texts: list[str], known: dict[str, int]) -> Rows:
        """How often each known word occurs in each text, words in the order of their numbers."""
        ids = [[i for i in map(known.get, words_of(text)) if i is not None] for text in texts]
        row_of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, ids), np.int64, len(ids)))
        keys, counts = np.unique(
            row_of * len(known) + np.array([i for found in ids for i in found], dtype=np.int64), return_counts=True
        )
        starts = np.searchsorted(keys, np.arange(len(texts) + 1) * len(known))
        return cls(starts, keys % max(len(known), 1), counts.astype(np.float64))

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i + 1])
        return self.terms[part], self.values[part]

    def weighted(self, weights: np.ndarray) -> Rows:
        """Counts as rows of length one, or without entries."""
        values = (1 + np.log(self.values)) * weights[self.terms]
        size = np.sqrt(np.bincount(self.row_of, values * values, minlength=len(self)))
        return Rows(self.starts, self.terms, values / size[self.row_of])


def _spans(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each span, one span after the other."""
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


@dataclass(frozen=True)
class Index:
    """Postings by word, then by place of the example; a piece is the part of them in one block of places.

    The words with the greatest weights together are kept as full rows instead. A list shorter than a block
    has no pieces and is read whole.
    """

    members: np.ndarray  # example at each place
    places: np.ndarray  # postings
    weights: np.ndarray
    term_starts: np.ndarray  # first posting of each word, and the end
    piece_starts: np.ndarray  # of lists that are not short
    piece_sizes: np.ndarray
    piece_blocks: np.ndarray
    piece_tops: np.ndarray
    term_pieces: np.ndarray  # first piece of each word, and the end
    common: np.ndarray  # row of each word in ``full``, or -1
    full: np.ndarray

    @classmethod
    def of(cls, rows: Rows, n_terms: int, common_words: int = COMMON_WORDS) -> Index:
        """Examples with the same strongest word stand together."""
        row_of = rows.row_of
        order = np.lexsort((rows.terms, -rows.values, row_of))
        some = np.flatnonzero(np.diff(rows.starts))
        strongest = order[rows.starts[some]]
        members = some[np.lexsort((rows.values[strongest], rows.terms[strongest]))]
        place = np.full(len(rows), -1)
        place[members] = np.arange(len(members))
        order = np.lexsort((place[row_of], rows.terms))
        terms, places, weights = rows.terms[order], place[row_of][order], rows.values[order]
        heaviest = np.argsort(-np.bincount(terms, weights, minlength=n_terms), kind="stable")[:common_words]
        common = np.full(n_terms, -1)
        common[heaviest] = np.arange(len(heaviest))
        in_full = common[terms] >= 0
        full = np.zeros((len(heaviest), -(-len(members) // BLOCK) * BLOCK))
        full[common[terms[in_full]], places[in_full]] = weights[in_full]
        terms, places, weights = terms[~in_full], places[~in_full], weights[~in_full]
        term_starts = np.searchsorted(terms, np.arange(n_terms + 1))
        long = np.repeat(np.diff(term_starts) >= BLOCK, np.diff(term_starts))
        blocks = places // BLOCK
        changes = (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])
        cuts = np.flatnonzero(np.concatenate([[len(terms) > 0], changes, [len(terms) > 0]]))
        tops = np.maximum.reduceat(weights, cuts[:-1]) if len(cuts) else np.zeros(0)
        kept = np.flatnonzero(long[cuts[:-1]])
        starts, ends, tops = cuts[kept], cuts[kept + 1], tops[kept]
        return cls(
            members, places.astype(np.int32), weights, term_starts, starts, (ends - starts).astype(np.int32),
            blocks[starts].astype(np.int32), tops, np.searchsorted(terms[starts], np.arange(n_terms + 1)), common, full,
        )

    def nearest(self, queries: Rows, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k nearest examples, best first, ties by number; -1 where there are fewer."""
        best = np.zeros((len(queries), k))
        who = np.full((len(queries), k), -1, dtype=np.int64)
        if not len(self.members):
            return best, who
        in_full, row_of = self.common[queries.terms] >= 0, queries.row_of
        for low in range(0, len(queries), QUERIES_AT_ONCE):
            high = min(low + QUERIES_AT_ONCE, len(queries))
            part = slice(queries.starts[low], queries.starts[high])
            known, terms, weights = in_full[part], queries.terms[part], queries.values[part]
            rows = np.zeros((high - low, len(self.full)))
            rows[row_of[part][known] - low, self.common[terms[known]]] = weights[known]
            for i, cosines in enumerate(rows @ self.full, low):
                terms, weights = queries.row(i)
                rare = ~in_full[queries.starts[i] : queries.starts[i + 1]]
                values, names = self._nearest(terms[rare], weights[rare], cosines, k)
                best[i, : len(values)], who[i, : len(names)] = values, names
        return best, who

    def _nearest(
        self, terms: np.ndarray, weights: np.ndarray, cosines: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Best of one query; ``cosines`` holds what the words with full rows gave to each place."""
        low = self.term_starts[terms]
        size = self.term_starts[terms + 1] - low
        short = size < BLOCK
        cosines = cosines + self._cosines(low[short], size[short], weights[short])
        terms, weights = terms[~short], weights[~short]
        low = self.term_pieces[terms]
        size = self.term_pieces[terms + 1] - low
        pieces, by = _spans(low, size), np.repeat(weights, size)
        blocks = self.piece_blocks[pieces]
        highest = cosines.reshape(-1, BLOCK).max(axis=1)
        bounds = highest + np.bincount(blocks, by * self.piece_tops[pieces], minlength=len(highest))
        # What is still to come only adds. A rounding error must not hide a tie.
        least = np.partition(cosines, -k)[-k] if len(cosines) > k else 0.0
        chosen = (bounds > 0) & (bounds >= least - 1e-12)
        taken = chosen[blocks]
        pieces = pieces[taken]
        cosines += self._cosines(self.piece_starts[pieces], self.piece_sizes[pieces], by[taken])
        cosines[~np.repeat(chosen, BLOCK)] = 0
        least = np.partition(cosines, -k)[-k] if len(cosines) > k else 0.0
        at = np.flatnonzero((cosines > 0) & (cosines >= least))
        at = at[np.lexsort((self.members[at], -cosines[at]))[:k]]
        return cosines[at], self.members[at]

    def _cosines(self, low: np.ndarray, size: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Sums by place of the postings in these spans, in the order of the words."""
        at = _spans(low, size)
        return np.bincount(self.places[at], np.repeat(by, size) * self.weights[at], minlength=self.full.shape[1])


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, int]
    weights: np.ndarray
    index: Index
    # Of each distinct text: its smallest doc_id with the label, and the clean and toxic examples drawn.
    doc_ids: np.ndarray
    toxic: np.ndarray
    drawn: np.ndarray
    # Labelled texts that a drawn one stands for, clean and toxic.
    kind_weights: np.ndarray
    levels: tuple[np.ndarray, np.ndarray]
    without_terms: float

    def votes(self, cosines: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of toxic votes among the nearest examples; -1 where there is no neighbour."""
        size = np.where(who >= 0, self.drawn.sum(axis=1)[who], 0)
        used = np.clip(NEIGHBOURS - (np.cumsum(size, axis=1) - size), 0, size)
        weight = cosines * used / np.maximum(size, 1)
        clean, toxic = (weight * (self.drawn[:, kind] * self.kind_weights[kind])[who] for kind in (0, 1))
        total = (clean + toxic).sum(axis=1)
        return np.where(total > 0, toxic.sum(axis=1) / np.maximum(total, 1e-300), -1.0)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return np.where(votes < 0, self.without_terms, calibrated(self.levels, votes))


@dataclass(frozen=True)
class StoredModel:
    """A model in the checkpoint folder."""

    folder: str

    def read(self) -> ToxicityModel:
        return read_object(self.folder, "model")

    def __getattr__(self, name: str):
        """What the model has."""
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.read(), name)


def _document_counts(texts: DataFrame, folder: str) -> DataFrame:
    """How many texts hold each known word; a task gives one row for each word that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_object(folder, "words")
        counts = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                found: list[int] = []
                for text in batch.column("text").slice(low, ROWS_AT_ONCE).to_pylist():
                    found += [known[w] for w in set(words_of(text)) if w in known]
                counts += np.bincount(np.array(found, dtype=np.int64), minlength=len(known))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "n"])

    return texts.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Factor of words that so many toxic and clean examples hold, from their chi-squared; never zero."""
    held = toxic + clean
    apart = (toxic * (n_clean - clean) - clean * (n_toxic - toxic)) ** 2 * (n_toxic + n_clean)
    chi = apart / (float(n_clean) * n_toxic * held * (n_toxic + n_clean - held + 1))
    return (chi / (chi + HALF_CHI)) ** 2 + LEAST_FACTOR


def _examples(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int], Rows]:
    """Of the distinct texts: smallest doc_id, its label, rows drawn of each kind; the words, and their counts."""
    ids, kinds, hashes = (found[name].to_numpy() for name in ("doc_id", "toxic", "text_hash"))
    # Texts in the order of their smallest ids.
    _, first, text = np.unique(hashes, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(first))
    first, text = np.sort(first), place[text]
    drawn = np.zeros((len(first), 2))
    np.add.at(drawn, (text, kinds), 1)
    words, counts = (pc.take(found[name].combine_chunks(), pa.array(first)) for name in ("words", "counts"))
    coded = pc.dictionary_encode(words.flatten())
    by_name = pc.array_sort_indices(coded.dictionary).to_numpy()
    known = {w: i for i, w in enumerate(coded.dictionary.take(pa.array(by_name)).to_pylist())}
    number = np.argsort(by_name)[coded.indices.to_numpy()]
    sizes = pc.list_value_length(words).to_numpy()
    order = np.lexsort((number, np.repeat(np.arange(len(first)), sizes)))
    rows = Rows(np.append(0, np.cumsum(sizes)), number[order], counts.flatten().to_numpy()[order].astype(np.float64))
    return ids[first], kinds[first], drawn, known, rows


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    examples: int = EXAMPLES_OF_A_KIND,
    example_chars: int = EXAMPLE_CHARS,
) -> StoredModel | float:
    """Learn from labelled rows that meet ``learn_from`` (a condition on doc_id).

    Without labels of both kinds there is only the share of toxic ones.
    """
    texts = texts_of(docs)
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(learn_from)
    marked = marked.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Counted where there is a text.
    marked = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    total = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return float(bool(total.get(1)))
    chosen = sampled_ids(marked, examples, F.col("toxic") == 1).withColumn("toxic", F.lit(1)).union(
        sampled_ids(marked, examples, F.col("toxic") == 0).withColumn("toxic", F.lit(0))
    )
    # At most twice ``examples`` ids; one text for each.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    # Those that come first while the bound on characters lasts; at most ``examples`` rows a kind.
    first_drawn = (F.xxhash64("doc_id", F.lit(SAMPLE_SEED)), "doc_id")
    so_far = Window.partitionBy("toxic").orderBy(*first_drawn).rowsBetween(Window.unboundedPreceding, 0)
    sample = sample.withColumn("chars", F.sum(F.length("text")).over(so_far)).filter(F.col("chars") <= example_chars)

    def counting():
        def step(columns):
            counts = [Counter(words_of(t)) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"],
                "toxic": columns["toxic"],
                "text_hash": columns["text_hash"],
                "words": [list(c) for c in counts],
                "counts": [list(c.values()) for c in counts],
            }

        return step

    named = sample.withColumn("text_hash", F.xxhash64("text"))
    ddl = "doc_id bigint, toxic int, text_hash bigint, words array<string>, counts array<int>"
    share = total[1] / (total[0] + total[1])
    folder = shared_folder(docs.sparkSession, "toxicity")

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches).combine_chunks()
        usable = len(np.unique(found["toxic"].to_numpy())) == 2
        if usable:
            doc_ids, toxic_of, drawn, known, rows = _examples(found)
            usable = bool(known)
            write_object(folder, "words", known)
            write_object(folder, "examples", (doc_ids, toxic_of, drawn, rows))
        yield pa.RecordBatch.from_pydict({"usable": [usable]})

    # At most twice ``examples`` rows.
    together = map_chunks(named, counting, ddl).repartition(1).sortWithinPartitions("doc_id")
    if not any(r["usable"] for r in together.mapInArrow(examine, "usable boolean").collect()):
        return share
    n_texts = texts.count()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_object(folder, "words")
        doc_ids, toxic_of, drawn, rows = read_object(folder, "examples")
        held = np.zeros(len(known))
        for batch in batches:
            held[batch.column("term").to_numpy()] = batch.column("n").to_numpy()
        once = drawn > 0
        clean, toxic = (np.bincount(rows.terms, once[rows.row_of, kind], minlength=len(known)) for kind in (0, 1))
        weights = (np.log((1 + n_texts) / (1 + held)) + 1) * telling(
            toxic, clean, int(once[:, 1].sum()), int(once[:, 0].sum())
        )
        rows = rows.weighted(weights)
        # Each example stands for as many labelled texts as its kind has for each one drawn.
        kind_weights = np.array([total[0], total[1]]) / drawn.sum(axis=0)
        model = ToxicityModel(
            known, weights, Index.of(rows, len(known)), doc_ids, toxic_of, drawn, kind_weights,
            (np.zeros(1), np.zeros(1)), share,
        )
        write_object(folder, "model", _calibrated(model, rows))
        yield pa.RecordBatch.from_pydict({"words": [len(known)]})

    # One row for each word of the examples.
    _document_counts(texts, folder).repartition(1).mapInArrow(fit, "words bigint").collect()
    return StoredModel(folder)


def _calibrated(model: ToxicityModel, rows: Rows) -> ToxicityModel:
    """Levels from the distinct texts, each judged by the others."""
    # One more neighbour than needed, as a text is passed over itself.
    cosines, who = model.index.nearest(rows, NEIGHBOURS + 1)
    other = (who >= 0) & (who != np.arange(len(who))[:, None])
    order = np.argsort(~other, axis=1, kind="stable")[:, :NEIGHBOURS]
    who = np.where(np.take_along_axis(other, order, axis=1), np.take_along_axis(who, order, axis=1), -1)
    votes = model.votes(np.take_along_axis(cosines, order, axis=1), who)
    weight = model.kind_weights
    # Whole repetitions stand for the weights of the kinds.
    times = np.maximum(1, np.round(weight / weight.min())).astype(np.int64)
    once = model.drawn > 0
    at, kind = np.nonzero(once & (votes >= 0)[:, None])
    levels = (
        monotone_levels(np.repeat(votes[at], times[kind]), np.repeat(kind, times[kind]))
        if len(at)
        else (np.zeros(1), np.array([model.without_terms]))
    )
    # Texts without words look alike, so all that were drawn count.
    blank = np.diff(rows.starts) == 0
    clean, toxic = model.drawn[blank].sum(axis=0) * weight
    without = (toxic + 0.5) / (clean + toxic + 1.0) if blank.any() else calibrated(levels, np.zeros(1))[0]
    return replace(model, levels=levels, without_terms=float(without))


def judged(texts: list[str], model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, and its nearest example with the cosine (-1 where there is none)."""
    rows = Rows.of_texts(texts, model.words).weighted(model.weights)
    cosines, who = model.index.nearest(rows)
    scores = model.scores(model.votes(cosines, who))
    nearest = who[:, 0]
    cosine = np.where(nearest >= 0, cosines[:, 0], 0)
    return scores, nearest, cosine


def scored(docs: DataFrame, model: StoredModel | float, held_out: Column) -> DataFrame:
    """Score, prediction and nearest example of every row."""
    marked = texts_of(docs).withColumn("held_out", held_out)

    def start():
        opened = model if isinstance(model, float) else model.read()

        def step(columns):
            n = len(columns["doc_id"])
            if isinstance(opened, float):
                scores, nearest, cosine = np.full(n, opened), np.full(n, -1), np.zeros(n)
            else:
                scores, nearest, cosine = judged(columns["text"], opened)
            found = [i if i >= 0 else None for i in nearest.tolist()]
            return {
                "doc_id": columns["doc_id"],
                "held_out": columns["held_out"],
                "score": scores,
                "predicted": (scores >= TOXIC_FROM).astype(np.int32),
                "nearest_doc_id": [None if i is None else int(opened.doc_ids[i]) for i in found],
                "nearest_cosine": [None if i is None else c for i, c in zip(found, cosine.tolist())],
                "nearest_toxic": [None if i is None else int(opened.toxic[i]) for i in found],
            }

        return step

    return map_chunks(marked, start, RESULT, rows=512)


def learnable(modulus: int = 4, remainder: int = 2) -> Column:
    """Rows whose labels may be learned from."""
    return id_remainder(modulus) != remainder


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels, learnable()), ~learnable())


def without_toxic(docs: DataFrame, model: StoredModel | float) -> DataFrame:
    """The same columns, without the rows whose score says toxic."""

    def start():
        opened = model if isinstance(model, float) else model.read()

        def step(columns):
            texts = [t or "" for t in columns["text"]]
            if isinstance(opened, float):
                stay = [opened < TOXIC_FROM] * len(texts)
            else:
                stay = (judged(texts, opened)[0] < TOXIC_FROM).tolist()
            return {name: [v for v, s in zip(values, stay) if s] for name, values in columns.items()}

        return step

    return map_chunks(docs, start, fields_of(docs), rows=512)
