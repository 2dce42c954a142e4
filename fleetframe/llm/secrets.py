"""Secrets: a character network over candidates and their surroundings, with recall-constrained thresholds.

Base spans (``spans.base_secrets``) always stay. Generators propose further ones: values after words
that name a credential in any spelling, and long tokens with digits. The network reads each candidate
whole, with its context. It learns from all texts: base findings and the same values written
in other ways are the positive cases; other candidates, masked or spelled-out values and plain numbers
are the negative ones. The cases are dealt into parts of bounded size. Tasks train one part each from the same
network, and after each round the networks are averaged by their cases. The threshold of a kind is the highest one
that still finds the wanted share of the positive cases set aside, a third of each part.

A null or empty text has no spans. Repeated rows give repeated results; other columns are ignored. Of further
spans that overlap, the likeliest stays; ties go to the one that starts first, then to the longer one.
Without a base span in any text there is nothing to learn from, and only base spans are returned.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetframe.llm.boosted_trees import calibrated, monotone_levels
from fleetframe.llm.char_cnn import (
    EPOCHS, PLACES, CharCnn, epochs_for, fit_cnn, fresh_state, net_of, trained, window, window_count,
)
from fleetframe.llm.common import levels_by_score, map_chunks, texts_of
from fleetframe.llm.spans import SECRET_KINDS, Span, Taken, base_secrets, digest, in_order, without_overlap, written
from fleetframe.session import stored

# Windows of the cases that a task trains at a time, and pieces in which networks are averaged.
PART_WINDOWS = 12_000
STATE_PIECES = 64
FEWEST_CASES = 40
# Cases with more windows are not learned from; they are read whole when texts are searched.
WINDOWS_LEARNED = 16
# Windows that the network reads at a time.
WINDOWS_AT_ONCE = 4_096
# Share of the positive cases set aside that a threshold must find, and the least probability kept.
RECALL = 0.95
LEAST_PROBABILITY = 0.5

RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

_NAMED = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|auth(?:orization)?|bearer|credentials?|private[_ -]?key)"
    r"[a-z0-9_]{0,12}[\"']? {0,2}(?:=>|:=|[:=]| is )[\"' ]{0,3}(?:bearer +|basic +)?([^\s\"',;]{6,})",
    re.IGNORECASE | re.ASCII,
)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_DIGIT = re.compile(r"[0-9]")


def candidates(text: str) -> list[Span]:
    """Base spans, named values and long tokens with digits; spans overlap."""
    found: set[Span] = set(base_secrets(text))
    if "=" in text or ":" in text or " is " in text:
        found |= {("assign", *m.span()) for m in _NAMED.finditer(text)}
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(m[0]):
            found.add(("hex" if _HEX_ONLY.fullmatch(m[0]) else "access", *m.span()))
    return in_order(list(found), SECRET_KINDS)


_NAMES = ("pwd", "passphrase", "db_pass", "auth", "AUTH_TOKEN", "client_secret", "api-key", "Authorization", "private_key")
_SIGNS = ("=", ": ", " = ", " => ", ":=", '="', "='")
_PLAIN = ("********", "xxxxxxxx", "required", "disabled", "<hidden>", "none-set", "changed today", "true,false", "see above")


def _random_value(rng: random.Random) -> str:
    letters = rng.choice((string.hexdigits.lower(), string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"))
    return "".join(rng.choice(letters) for _ in range(rng.randint(12, 44)))


def _made(text: str, span: Span, rng: random.Random) -> list[tuple[str, Span, int]]:
    """The surroundings of a base span with other contents, and whether these are secrets."""
    _, start, end = span
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    found = []

    def put(kind: str, body: str, label: int) -> None:
        found.append((before + body + after, (kind, len(before), len(before) + len(body)), label))

    named = rng.choice(_NAMES) + rng.choice(_SIGNS)
    put("assign", named + _random_value(rng), 1)
    put("assign", named + rng.choice(_PLAIN), 0)
    upper = "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randint(24, 64)))
    put("hex", upper, 1)
    put("hex", rng.choice("0123456789") * rng.randint(16, 40), 0)
    put("hex", "".join(rng.choice(string.digits) for _ in range(rng.randint(16, 19))), 0)
    put("access", rng.choice(("ASIA", "AGPA", "ghp", "sk")) + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(rng.randint(16, 36))), 1)
    words = re.findall(r"[A-Za-z]{2,}", text[:2000]) or ["name"]
    joint = rng.choice("_-/")
    put("access", joint.join(rng.choice(words).lower() for _ in range(4)) + joint + str(rng.randint(1, 2030)), 0)
    return found


def cases(text: str, rng: random.Random) -> list[tuple[Span, list[int], int]]:
    """Windows with labels. Tokens that the base patterns do not know and that mix letters and digits
    might be secrets and are left out."""
    base = base_secrets(text)
    taken = Taken(base)
    found = [(s, window(text, s[1], s[2]), 1) for s in base if window_count(s[1], s[2]) <= WINDOWS_LEARNED]
    for s in candidates(text):
        if window_count(s[1], s[2]) <= WINDOWS_LEARNED and taken.is_free(s) and text[s[1] : s[2]].isdigit():
            found.append((s, window(text, s[1], s[2]), 0))
    for s in base[:4]:
        found += [(place, window(words, place[1], place[2]), label) for words, place, label in _made(text, s, rng)]
    return found


@dataclass
class SecretModel:
    net: CharCnn
    levels: tuple[np.ndarray, np.ndarray]
    thresholds: dict[str, float]

    def probabilities(self, cases: list[list[int]]) -> np.ndarray:
        return calibrated(self.levels, self.net.logits(*stacked(cases)))


def stacked(cases: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all cases, and how many each has."""
    counts = np.array([len(c) // PLACES for c in cases], dtype=np.int64)
    return np.concatenate([np.array(c, dtype=np.int64) for c in cases]).reshape(-1, PLACES), counts


def set_aside(n: int) -> tuple[np.ndarray, int]:
    """The cases in random order, and how many of the first are learned from; the others are set aside."""
    return np.random.default_rng(9).permutation(n), n * 2 // 3


def case_weights(labels: np.ndarray, ones: int, n: int) -> np.ndarray:
    """Both labels weigh the same when ``ones`` of all ``n`` cases that are learned from are positive."""
    share = np.float32(ones / n)
    return np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)


def thresholds_of(levels: tuple[np.ndarray, np.ndarray], positives: dict[str, np.ndarray], recall: float) -> dict[str, float]:
    """``positives`` has for each kind how many positive cases lie on each level."""
    thresholds = {}
    order = np.argsort(levels[1], kind="stable")
    for kind in SECRET_KINDS:
        so_far = np.cumsum(positives[kind][order])
        n = int(so_far[-1])
        # The highest level that finds the share; a kind without cases is never added.
        level = levels[1][order[np.searchsorted(so_far, int((1 - recall) * n), side="right")]] if n else 1.1
        thresholds[kind] = float(max(level, LEAST_PROBABILITY))
    return thresholds


def level_numbers(levels: tuple[np.ndarray, np.ndarray], logits: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(levels[0], logits, side="left"), len(levels[0]) - 1)


def fit(cases: list[list[int]], labels: np.ndarray, kinds: list[str], recall: float = RECALL) -> SecretModel | None:
    """The model of cases that are at hand."""
    if len(cases) < FEWEST_CASES or len(set(labels.tolist())) < 2:
        return None
    order, kept = set_aside(len(cases))
    cases, labels, kinds_of = [cases[i] for i in order.tolist()], labels[order], np.array(kinds)[order]
    codes, counts = stacked(cases[:kept])
    net = fit_cnn(codes, labels[:kept], case_weights(labels[:kept], int(labels[:kept].sum()), kept), counts)
    logits, truth = net.logits(*stacked(cases[kept:])), labels[kept:]
    levels = monotone_levels(logits, truth)
    numbers = level_numbers(levels, logits)
    positives = {
        kind: np.bincount(numbers[(kinds_of[kept:] == kind) & (truth == 1)], minlength=len(levels[0]))
        for kind in SECRET_KINDS
    }
    return SecretModel(net, levels, thresholds_of(levels, positives, recall))


PART = "part bigint, n bigint, n_kept bigint, ones bigint, ones_kept bigint, codes binary, counts binary, labels binary, kinds binary"


def all_cases(docs: DataFrame) -> DataFrame:
    """One row for each case of each text."""

    def start():
        def step(columns):
            rows = [
                (doc_id, span[0], codes, label)
                for doc_id, text in zip(columns["doc_id"], columns["text"])
                for span, codes, label in cases(text, random.Random(doc_id or 0))
            ]
            return {name: [r[i] for r in rows] for i, name in enumerate(("doc_id", "kind", "codes", "label"))}

        return step

    return map_chunks(texts_of(docs), start, "doc_id bigint, kind string, codes array<int>, label int")


def in_parts(made: DataFrame, part_windows: int) -> DataFrame:
    """The cases dealt into parts of about so many windows, one row a part; within it, those learned from come first."""
    windows = made.agg(F.sum(F.size("codes"))).first()[0] or 0
    parts = max(1, -(-windows // (PLACES * part_windows)))
    # Equal cases of repeated rows are told apart by their numbers, so no part gets all of them.
    columns = ("place", "doc_id", "kind", "codes", "label")
    each = made.withColumn("place", F.xxhash64("doc_id", "codes")).groupBy(*columns).count()
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "count"))).drop("count")
    each = each.withColumn("part", F.pmod(F.xxhash64("place", "copy"), F.lit(parts)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("place", "doc_id", "label", "kind", "copy")])
        order, kept = set_aside(len(table))
        codes = table["codes"].take(pa.array(order)).combine_chunks()
        labels = table["label"].to_numpy()[order].astype(np.float32)
        kinds = np.array([SECRET_KINDS.index(k) for k in table["kind"].to_pylist()], dtype=np.uint8)[order]
        counts = codes.value_lengths().to_numpy() // PLACES
        return pa.table(
            {
                "part": table["part"][:1],
                "n": [len(table)],
                "n_kept": [kept],
                "ones": [int(labels.sum())],
                "ones_kept": [int(labels[:kept].sum())],
                "codes": [codes.flatten().to_numpy().astype(np.uint8).tobytes()],
                "counts": [counts.astype(np.int64).tobytes()],
                "labels": [labels.tobytes()],
                "kinds": [kinds.tobytes()],
            }
        )

    return stored(each.repartition(parts, "part").groupBy("part").applyInArrow(pack, PART))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, windows of each case, labels and kinds of a part."""
    codes = np.frombuffer(row["codes"], dtype=np.uint8).astype(np.int64).reshape(-1, PLACES)
    return codes, *(
        np.frombuffer(row[name], dtype=kind)
        for name, kind in (("counts", np.int64), ("labels", np.float32), ("kinds", np.uint8))
    )


def train_round(parts: DataFrame, state: np.ndarray, these: range, epochs: int, ones: int, kept: int) -> np.ndarray:
    """The mean of the states to which the parts lead, each weighted by its cases."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                n = row["n_kept"]
                if not n:
                    continue
                codes, counts, labels, _ = _opened(row)
                counts, labels = counts[:n], labels[:n]
                weights = case_weights(labels, ones, kept)
                pieces = np.array_split(
                    trained(state, codes[: counts.sum()], labels, weights, counts, these, epochs), STATE_PIECES
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "piece": pa.array(range(STATE_PIECES), pa.int64()),
                        "part": pa.array([row["part"]] * STATE_PIECES, pa.int64()),
                        "n": pa.array([n] * STATE_PIECES, pa.int64()),
                        "state": pa.array([p.tobytes() for p in pieces], pa.binary()),
                    }
                )

    def mean(table: pa.Table) -> pa.Table:
        # Always in the same order, so that the sums are the same on every run.
        table = table.sort_by("part")
        total = 0.0
        for n, values in zip(table["n"].to_pylist(), table["state"]):
            total = total + n * np.frombuffer(values.as_py(), dtype=np.float32).astype(np.float64)
        values = (total / sum(table["n"].to_pylist())).astype(np.float32)
        return pa.table({"piece": table["piece"][:1], "state": pa.array([values.tobytes()], pa.binary())})

    learned = parts.mapInArrow(learn, "piece bigint, part bigint, n bigint, state binary")
    means = learned.groupBy("piece").applyInArrow(mean, "piece bigint, state binary").orderBy("piece").collect()
    return np.concatenate([np.frombuffer(r["state"], dtype=np.float32) for r in means])


def judged_aside(parts: DataFrame, state: np.ndarray) -> DataFrame:
    """Logit, kind and label of each case set aside."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_of(state)
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                n = row["n_kept"]
                codes, counts, labels, kinds = _opened(row)
                logits = net.logits(codes[counts[:n].sum() :], counts[n:])
                yield pa.RecordBatch.from_pydict(
                    {
                        "logit": pa.array(logits.astype(np.float64), pa.float64()),
                        "kind": pa.array(kinds[n:].astype(np.int32), pa.int32()),
                        "label": pa.array(labels[n:].astype(np.int32), pa.int32()),
                    }
                )

    return stored(parts.mapInArrow(judge, "logit double, kind int, label int"))


def levels_aside(aside: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic levels of all cases set aside."""
    return levels_by_score(aside.select(F.col("logit").alias("score"), F.col("label").alias("ones"), F.lit(1).alias("n")))


def train(docs: DataFrame, part_windows: int = PART_WINDOWS, recall: float = RECALL) -> SecretModel | None:
    """Learn from the cases of all texts."""
    parts = in_parts(stored(all_cases(docs)), part_windows)
    total = parts.agg(
        F.count("*").alias("parts"), *(F.sum(n).alias(n) for n in ("n", "n_kept", "ones", "ones_kept"))
    ).first()
    if not total["parts"] or total["n"] < FEWEST_CASES or total["ones"] in (0, total["n"]):
        return None
    epochs = epochs_for(-(-total["n_kept"] // total["parts"]))
    # A part that is alone has nobody to wait for; small parts are gone over several times in a round.
    step = epochs if total["parts"] == 1 else -(-epochs // EPOCHS)
    state = fresh_state()
    for low in range(0, epochs, step):
        these = range(low, min(low + step, epochs))
        state = train_round(parts, state, these, epochs, total["ones_kept"], total["n_kept"])
    aside = judged_aside(parts, state)
    levels = levels_aside(aside)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = level_numbers(levels, batch.column("logit").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(numbers, pa.int64())], ["kind", "level"])

    on_levels = aside.filter("label = 1").mapInArrow(number, "kind int, level bigint")
    positives = {kind: np.zeros(len(levels[0]), dtype=np.int64) for kind in SECRET_KINDS}
    for r in on_levels.groupBy("kind", "level").count().collect():
        positives[SECRET_KINDS[r["kind"]]][r["level"]] = r["count"]
    return SecretModel(net_of(state), levels, thresholds_of(levels, positives, recall))


def found_in(texts: list[str], model: SecretModel | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base_secrets(t) for t in texts]
    if model is None:
        return [(b, b) for b in bases]
    extra: dict[int, list[tuple[float, Span]]] = {}
    waiting: list[tuple[list[int], int, Span]] = []
    windows = 0

    def read() -> None:
        nonlocal windows
        if waiting:
            for p, (_, i, s) in zip(model.probabilities([w[0] for w in waiting]).tolist(), waiting):
                if p >= model.thresholds[s[0]]:
                    extra.setdefault(i, []).append((p, s))
        waiting.clear()
        windows = 0

    for i, (text, base) in enumerate(zip(texts, bases)):
        taken = Taken(base)
        for s in candidates(text):
            if taken.is_free(s):
                waiting.append((window(text, s[1], s[2]), i, s))
                windows += window_count(s[1], s[2])
                if windows >= WINDOWS_AT_ONCE:
                    read()
    read()
    return [(b, without_overlap(b, extra[i], SECRET_KINDS) if i in extra else b) for i, b in enumerate(bases)]


def found(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """Counts and digest of the base spans and the text form of all spans, per row."""

    def start():
        def step(columns):
            both = found_in(columns["text"], model)
            counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in both] for k in SECRET_KINDS}
            return {
                "doc_id": columns["doc_id"],
                **counts,
                "base_sha256": [digest(base) for base, _ in both],
                "spans": [written(all_spans) for _, all_spans in both],
            }

        return step

    return map_chunks(texts_of(docs), start, RESULT)
