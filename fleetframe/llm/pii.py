"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated thresholds.

Generators propose every plausible span: windows of neighbouring digit groups, and names around an at
sign in any spelling. Base spans (``spans.base_pii``) always stay. The trees decide which further
candidates are kept, for instance a card number that the base pattern read together with a number
before it. They learn from all texts: base spans and spans rewritten the way people write them are the
positive cases, every other candidate around them is a negative one. Equal cases are counted. Two thirds of
each are learned from; levels and thresholds count the rest. Gradients are sums over the binned cases, so
tasks add them up part by part and every tree is that of all cases together.

A null or empty text has no spans. Repeated rows give repeated results. Of further spans that overlap, the
likeliest stays; ties go to the one that starts first, then to the longer one. With no base span in any
text there is nothing to learn from, and only base spans are returned.
"""

from __future__ import annotations

import pickle
import random
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetframe.llm.boosted_trees import (
    SHARES, Cases, Split, Tree, Trees, best_split, bins_of, calibrated, fit_trees, grown_from, grown_trees,
    monotone_levels, start_of,
)
from fleetframe.llm.common import ROWS_AT_ONCE, fields_of, levels_by_score, map_chunks, texts_of
from fleetframe.llm.spans import (
    PII_KINDS,
    Span,
    Taken,
    base_pii,
    digest,
    ips,
    is_card,
    luhn,
    only_digits,
    redacted,
    without_overlap,
    written,
)
from fleetframe.session import stored

# Different binned cases that a task sums up at a time.
PART_CASES = 100_000
# Share of kept candidates that must be right among the cases set aside.
PRECISION = 0.97
FEWEST_CASES = 20
# Candidates that the trees judge at a time, and different cases that a task counts before it passes them on.
CANDIDATES_AT_ONCE = 4_096

FORMAT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

_RUN = re.compile(r"[0-9](?:[ ().-]{0,3}[0-9])*+")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@| ?[(\[]at[)\]] ?")
_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)*")
_FEWEST_DIGITS, _MOST_DIGITS = 7, 19
# Words before a span that hint at its kind, in the order of PII_KINDS.
_HINTS = (
    re.compile(r"mail|contact|write|schreib|correo|courriel", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    re.compile(r"card|visa|master|karte|carte|tarjeta|cc\b", re.IGNORECASE),
    re.compile(r"tel|phone|call|fax|mobil|cell", re.IGNORECASE),
)
_HINT_CHARS = 24


def candidates(text: str) -> list[Span]:
    """Every span that could be personal data; spans overlap and may stand under several kinds."""
    found: list[Span] = []
    for run in _RUN.finditer(text):
        if run.end() - run.start() < _FEWEST_DIGITS:
            continue
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in _GROUP.finditer(run[0])]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > _MOST_DIGITS:
                    break
                end = groups[j][1]
                dotted = j - i == 3 and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, j))
                if dotted:
                    found.append(("ip", start, end))
                if digits < _FEWEST_DIGITS:
                    continue
                if digits >= 12:
                    found.append(("card", start, end))
                if digits <= 15 and not dotted:
                    lead = start
                    if lead and text[lead - 1] == "(":
                        lead -= 1
                    if lead and text[lead - 1] == "+":
                        lead -= 1
                    found.append(("phone", lead, end))
    if "@" in text or "at)" in text or "at]" in text:
        for sign in _AT.finditer(text):
            start = sign.start()
            while start and _NAME.match(text[start - 1]):
                start -= 1
            host = _HOST.match(text, sign.end())
            if host and start < sign.start():
                found.append(("email", start, host.end()))
    return found


def _neighbour(text: str, at: int) -> float:
    """Kind of a character: outside or space, letter, digit, other."""
    if not 0 <= at < len(text) or text[at].isspace():
        return 0.0
    return 1.0 if text[at].isalpha() else 2.0 if text[at].isdigit() else 3.0


def described(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, start, end = span
    body = text[start:end]
    digits = only_digits(body)
    groups = _GROUP.findall(body)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - _HINT_CHARS) : start], text[end : end + 3]
    hints = [float(bool(h.search(before))) for h in _HINTS]
    own = PII_KINDS.index(kind)
    host = re.split(r"@|[(\[]at[)\]]", body)[-1] if kind == "email" else ""
    labels = [x for x in re.split(r"\.|[(\[]dot[)\]]", host) if x.strip()]
    return [
        *(float(kind == k) for k in PII_KINDS),
        float(len(digits)),
        float(len(groups)),
        float(max(sizes)),
        float(min(sizes)),
        float(sizes[0]),
        float(sizes[-1]),
        float(body.startswith("+")),
        float("(" in body),
        float(body.count(" ")),
        float(body.count("-")),
        float(body.count(".")),
        float(bool(digits) and luhn(digits)),
        _neighbour(text, start - 1),
        _neighbour(text, end),
        float(bool(re.search(r"[0-9][ ().-]{1,3}$", before))),
        float(bool(re.match(r"[ ().-]{1,3}[0-9]", after))),
        hints[own],
        float(sum(hints) - hints[own]),
        float(len(set(digits))),
        float(max(min(int(g[:6]), 999) for g in groups)) if kind == "ip" and groups else 0.0,
        float(len(body)),
        float(len(labels)),
        float(len(labels[-1].strip())) if labels else 0.0,
        float("@" in body),
    ]


def _rewritten(text: str, span: Span, rng: random.Random) -> tuple[str, Span] | None:
    """The surroundings of a span, with the span written so that the base pattern misses it."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 60) : start], text[end : end + 30]
    lead = ""
    if kind == "email":
        body = body.replace("@", rng.choice((" (at) ", " [at] ", "(at)")), 1)
        if rng.random() < 0.5:
            at = body.rindex(".")
            body = body[:at] + rng.choice((" (dot) ", "[dot]")) + body[at + 1 :]
    elif kind == "phone":
        if rng.random() < 0.5:
            body = body.lstrip("+")
            lead = rng.choice(("tel ", "phone: ", "call ", "Tel. "))
        else:
            body = re.sub(r"[ ().-]+", rng.choice((".  ", " - ", "--")), body)
            lead = rng.choice(("", "tel "))
            if not body.startswith("+"):
                return None
    elif kind == "card":
        lead = rng.choice((f"{rng.randint(1, 99)} ", f"{rng.randint(100, 999)}-", f"No {rng.randint(1, 9)} "))
    else:
        return None
    return before + lead + body + after, (kind, len(before) + len(lead), len(before) + len(lead) + len(body))


def _wrong_digits(text: str, span: Span, rng: random.Random) -> tuple[str, Span] | None:
    """A card span whose check digit is wrong: no card."""
    kind, start, end = span
    if kind != "card":
        return None
    last = str((int(text[end - 1]) + rng.randint(1, 9)) % 10)
    before = text[max(0, start - 60) : start]
    changed = before + text[start : end - 1] + last + text[end : end + 30]
    return changed, (kind, len(before), len(before) + end - start)


def cases(text: str, rng: random.Random) -> Iterator[tuple[list[float], int]]:
    """Described candidates of a text and of rewritten surroundings, with their labels."""
    base = base_pii(text)
    right, taken = set(base), Taken(base)
    for c in candidates(text):
        if c in right or not _unsure(text, c, taken):
            yield described(text, c), int(c in right)
    for span in base:
        for change in (_rewritten, _wrong_digits):
            made = change(text, span, rng)
            if made:
                words, place = made
                held = {place} | set(base_pii(words)) if change is _rewritten else set(base_pii(words))
                for c in candidates(words):
                    yield described(words, c), int(c in held)


def _unsure(text: str, span: Span, taken: Taken) -> bool:
    """Whether a candidate keeps the rules of its kind where the base pattern found nothing: no label."""
    kind, start, end = span
    if kind == "card":
        plausible = is_card(text[start:end])
    else:
        plausible = kind == "ip" and bool(ips(text[start:end]))
    return plausible and taken.is_free(span)


@dataclass(frozen=True)
class PiiModel:
    trees: Trees
    levels: tuple[np.ndarray, np.ndarray]
    thresholds: dict[str, float]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return calibrated(self.levels, self.trees.margins(rows))


def packed(rows: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in rows.astype("<f8")]


def unpacked(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), dtype="<f8").reshape(len(rows), -1)


def learned_from(rows: list[bytes], n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, two thirds of its cases of either label, rounded up or down by chance, and the positive ones."""
    more = np.array([[zlib.crc32(row + label) % 3 for label in (b"0", b"1")] for row in rows]).reshape(-1, 2)
    ones_kept = (2 * ones + more[:, 1]) // 3
    return (2 * (n - ones) + more[:, 0]) // 3 + ones_kept, ones_kept


def enough(n: int, ones: int, n_kept: int) -> bool:
    return n >= FEWEST_CASES and 0 < ones < n and 0 < n_kept < n


def fit(rows: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> PiiModel | None:
    """The model of cases that are at hand."""
    rows, place, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    ones = np.bincount(place.reshape(-1), labels, len(rows)).astype(np.int64)
    n_kept, ones_kept = learned_from(packed(rows), n, ones)
    if not enough(n.sum(), ones.sum(), n_kept.sum()):
        return None
    some, aside = n_kept > 0, n_kept < n
    trees = fit_trees(rows[some], ones_kept[some], n_kept[some])
    rows, n, ones = rows[aside], (n - n_kept)[aside], (ones - ones_kept)[aside]
    margins = trees.margins(rows)
    levels = monotone_levels(margins, ones, n)
    p = calibrated(levels, margins)
    thresholds = {}
    for k, kind in enumerate(PII_KINDS):
        own = rows[:, k] > 0
        thresholds[kind] = lowest_precise(p[own], ones[own], precision, n[own])
    return PiiModel(trees, levels, thresholds)


def lowest_precise(p: np.ndarray, ones: np.ndarray, precision: float, counts: np.ndarray | None = None) -> float:
    """The lowest probability from which on the wanted share is right; above 1 if there is none."""
    levels, place = np.unique(p, return_inverse=True)
    right, n = (np.cumsum(np.bincount(place, x, len(levels))[::-1]) for x in (ones, counts))
    best = 1.1
    for level, share in zip(levels[::-1].tolist(), (right / n).tolist()):
        if level < 0.5 or share < precision:
            break
        best = level
    return best


CASES = "row binary, n bigint, ones bigint"
KEPT = "n_kept bigint, ones_kept bigint"
PART = "part bigint, bins binary, n binary, ones binary"


def all_cases(docs: DataFrame) -> DataFrame:
    """How often each case occurs in all texts, how often with a positive label, and how many are learned from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.binary()),
                    *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(2)),
                ],
                ["row", "n", "ones"],
            )
            counts.clear()
            return batch

        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = batch.slice(low, ROWS_AT_ONCE).to_pydict()
                for doc_id, text in zip(columns["doc_id"], columns["text"]):
                    for row, label in cases(text, random.Random(doc_id or 0)):
                        both = counts.setdefault(struct.pack(f"<{len(row)}d", *row), [0, 0])
                        both[0] += 1
                        both[1] += label
                        if len(counts) == CANDIDATES_AT_ONCE:
                            yield passed_on()
        yield passed_on()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ones = (batch.column(c).to_numpy() for c in ("n", "ones"))
            kept = learned_from(batch.column("row").to_pylist(), n, ones)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, kept)], [*batch.schema.names, "n_kept", "ones_kept"]
            )

    made = texts_of(docs).mapInArrow(count, CASES)
    return made.groupBy("row").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).mapInArrow(split, f"{CASES}, {KEPT}")


def all_cuts(kept: DataFrame) -> list[np.ndarray]:
    """The cuts of each feature between bins of as many cases."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_kept").to_numpy()
            for feature, column in enumerate(unpacked(batch.column("row")).T if len(n) else ()):
                each, place = np.unique(column, return_inverse=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature": pa.array([feature] * len(each), pa.int32()),
                        "value": pa.array(each),
                        "n": pa.array(np.bincount(place, n).astype(np.int64)),
                    }
                )

    counts = kept.mapInArrow(values, "feature int, value double, n bigint")
    counts = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    found = counts.groupBy("feature").agg(F.percentile("value", SHARES, F.col("n")).alias("at")).collect()
    return [np.unique(r["at"]) for r in sorted(found)]


def in_parts(kept: DataFrame, cuts: list[np.ndarray], part_cases: int) -> DataFrame:
    """The binned cases dealt into parts of about so many different ones, one row a part."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(unpacked(batch.column("row")), cuts) if batch.num_rows else ()
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("n_kept"), batch.column("ones_kept")],
                ["bins", "n", "ones"],
            )

    each = kept.mapInArrow(binned, "bins binary, n bigint, ones bigint")
    each = stored(each.groupBy("bins").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))
    parts = max(1, -(-each.count() // part_cases))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("bins")
        return pa.table(
            {
                "part": table["part"][:1],
                "bins": [b"".join(table["bins"].to_pylist())],
                **{c: [table[c].to_numpy().astype(np.float64).tobytes()] for c in ("n", "ones")},
            }
        )

    each = each.withColumn("part", F.pmod(F.xxhash64("bins"), F.lit(parts)))
    return stored(each.repartition(parts, "part").groupBy("part").applyInArrow(pack, PART))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, binned cases, positive ones and cases of each part."""
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            n, ones = (np.frombuffer(row[c], dtype=np.float64) for c in ("n", "ones"))
            yield row["part"], np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(n), -1), ones, n


def grown_in_tasks(parts: DataFrame, cuts: list[np.ndarray], start: float) -> Trees:
    """The trees of all parts: a part that is alone in one task, else a round of tasks for each split."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, *cases_of in _opened(batches):
            trees = pickle.dumps(grown_from(*cases_of, cuts, start))
            yield pa.RecordBatch.from_pydict({"trees": pa.array([trees], pa.binary())})

    if parts.count() == 1:
        return pickle.loads(parts.mapInArrow(alone, "trees binary").first()["trees"])

    def splits_of(grown: list[Tree], features: list[int], places: list[int]) -> list[Split]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, *cases_of in _opened(batches):
                found = Cases(*cases_of, start).sums(grown, features, places)
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature": pa.array(range(len(found)), pa.int64()),
                        "part": pa.array([part] * len(found), pa.int64()),
                        "sums": pa.array([f.tobytes() for f in found], pa.binary()),
                    }
                )

        def best(table: pa.Table) -> pa.Table:
            # Always in the same order, so that the sums are the same on every run.
            total = sum(np.frombuffer(x.as_py()) for x in table.sort_by("part")["sums"])
            feature = table["feature"][0].as_py()
            split = best_split(total.reshape(2, 1 << len(features), -1), len(cuts[feature]))
            return pa.table({"feature": [feature], "split": pa.array([pickle.dumps(split)], pa.binary())})

        made = parts.mapInArrow(sums, "feature bigint, part bigint, sums binary")
        rows = made.groupBy("feature").applyInArrow(best, "feature bigint, split binary").collect()
        return [pickle.loads(r["split"]) for r in sorted(rows)]

    return grown_trees(cuts, start, splits_of)


def judged_aside(made: DataFrame, trees: Trees) -> DataFrame:
    """Margin and kind of the cases set aside, with the numbers of cases and of positive ones."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unpacked(batch.column("row"))
                kinds = rows[:, : len(PII_KINDS)].argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees.margins(rows)), pa.array(kinds), batch.column("n"), batch.column("ones")],
                    ["score", "kind", "n", "ones"],
                )

    aside = made.filter("n_kept < n").selectExpr("row", "n - n_kept AS n", "ones - ones_kept AS ones")
    return stored(aside.mapInArrow(judge, "score double, kind int, n bigint, ones bigint"))


def train(docs: DataFrame, part_cases: int = PART_CASES, precision: float = PRECISION) -> PiiModel | None:
    """Learn from the cases of all texts."""
    made = stored(all_cases(docs))
    total = made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "ones", "n_kept", "ones_kept"))).first()
    if not enough(total["n"], total["ones"], total["n_kept"]):
        return None
    kept = made.filter("n_kept > 0")
    cuts = all_cuts(kept)
    trees = grown_in_tasks(in_parts(kept, cuts, part_cases), cuts, start_of(total["ones_kept"], total["n_kept"]))
    aside = judged_aside(made, trees)
    levels = levels_by_score(aside)

    def probability(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = calibrated(levels, batch.column("score").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(p), *batch.columns[1:]], ["p", *batch.schema.names[1:]])

    judged = aside.mapInArrow(probability, "p double, kind int, n bigint, ones bigint")
    rows = judged.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
    thresholds = {}
    for k, kind in enumerate(PII_KINDS):
        p, ones, n = np.array([(r["p"], r["ones"], r["n"]) for r in rows if r["kind"] == k]).reshape(-1, 3).T
        thresholds[kind] = lowest_precise(p, ones, precision, n)
    return PiiModel(trees, levels, thresholds)


def found_in(texts: list[str], model: PiiModel | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base_pii(t) for t in texts]
    if model is None:
        return [(b, b) for b in bases]
    extra: dict[int, list[tuple[float, Span]]] = {}
    waiting: list[tuple[list[float], int, Span]] = []

    def judge() -> None:
        if waiting:
            for p, (_, i, c) in zip(model.probabilities(np.array([w[0] for w in waiting])).tolist(), waiting):
                if p >= model.thresholds[c[0]]:
                    extra.setdefault(i, []).append((p, c))
        waiting.clear()

    for i, (text, base) in enumerate(zip(texts, bases)):
        taken = Taken(base)
        for c in candidates(text):
            if taken.is_free(c):
                waiting.append((described(text, c), i, c))
                if len(waiting) == CANDIDATES_AT_ONCE:
                    judge()
    judge()
    return [(b, without_overlap(b, extra[i], PII_KINDS) if i in extra else b) for i, b in enumerate(bases)]


def found(docs: DataFrame, model: PiiModel | None) -> DataFrame:
    """Counts and digest of the base spans and the text form of all spans, per row."""

    def start():
        def step(columns):
            both = found_in(columns["text"], model)
            counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in both] for k in PII_KINDS}
            return {
                "doc_id": columns["doc_id"],
                **counts,
                "base_sha256": [digest(base) for base, _ in both],
                "spans": [written(all_spans) for _, all_spans in both],
            }

        return step

    return map_chunks(texts_of(docs), start, FORMAT)


def redacted_documents(docs: DataFrame, model: PiiModel | None) -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by its kind.

    ``n_chars``, where there is such a column, is the length of the new text; a null text stays null.
    """

    def start():
        def step(columns):
            texts = columns["text"]
            new = [
                None if t is None else redacted(t, spans)
                for t, (_, spans) in zip(texts, found_in([t or "" for t in texts], model))
            ]
            columns["text"] = new
            if "n_chars" in columns:
                columns["n_chars"] = [
                    n if t is None else len(t) for n, t in zip(columns["n_chars"], new)
                ]
            return columns

        return step

    return map_chunks(docs, start, fields_of(docs))
