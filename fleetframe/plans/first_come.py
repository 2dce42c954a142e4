"""First-come admission: the sequential rule "a row is accepted unless an
earlier accepted row stands in its way", computed set by set."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetframe.plans.components import LAST_LINKS, components
from fleetframe.plans.intervals import with_overlap_count
from fleetframe.session import pin, stored


# Rounds of "earliest claim wins" before what is left is settled by components. More follow while one
# leaves at most this share of the claims.
SIMPLE_ROUNDS = 2
ROUND_SHARE = 0.5

# Rows handed to one Python call, about. A larger component or group is handled
# in further rounds.
GROUP_ROWS = 50_000


def key_claims(rows: DataFrame, arrival: str, keys: list[str], *more: str) -> DataFrame:
    """One row (arrival, kind, value) per key that is not NULL; the kind is the place of the key."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("kind"), F.col(key).cast("string").alias("value")) for i, key in enumerate(keys)]
    )
    claims = rows.select(F.col(arrival).alias("arrival"), *more, F.explode(pairs).alias("_claim"))
    return claims.select("arrival", *more, "_claim.kind", "_claim.value").filter(F.col("value").isNotNull())


def accept_unique(
    rows: DataFrame,
    arrival: str,
    keys: list[str],
    group_rows: int | None = None,
    last_links: int = LAST_LINKS,
    held: DataFrame | None = None,
) -> DataFrame:
    """Arrivals accepted when each key value may be taken once.

    Rows are handled as if one after another: a row is turned away when an
    earlier *accepted* row already took one of its key values; values of rows
    turned away stay free. ``arrival`` must be unique. NULL keys never collide.
    ``held`` has values (kind, value) that are taken before all rows.

    A simple round accepts every undecided row that arrived first for all its key
    values, then drops the rows that share a value with one of those, and all claims on values that no
    other row claims; first and last arrivals per key value are combined before the shuffle, so a value
    shared by very many rows is cheap. Rounds go on while they settle most of what is open. That settles all but
    long chains of collisions. At most ``group_rows`` open
    claims are settled in order of arrival by one pandas call; more of them fall into
    components that share no value; they are found in rounds that grow with the
    logarithm of the longest chain, and each is settled by one pandas call. Of a
    component above ``group_rows`` claims, about so many of the
    earliest are settled at a time.

    Returns one column, ``arrival``.
    """
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    open_claims = key_claims(rows, arrival, keys)
    unbound = F.lit(True)
    for key in keys:
        unbound = unbound & F.col(key).isNull()
    accepted = rows.filter(unbound).select(F.col(arrival).alias("arrival")).distinct()
    # Rows that repeat an arrival are one row.
    accepted = accepted.limit(0) if accepted.isEmpty() else accepted.join(open_claims, "arrival", "left_anti")

    left, before, turn = open_claims.count(), 0, 0
    while left > group_rows and (turn < SIMPLE_ROUNDS or left <= ROUND_SHARE * before):
        accepted, open_claims = _simple_round(accepted, open_claims, held)
        before, left, held, turn = left, open_claims.count(), None, turn + 1
    if left <= group_rows:
        if held is not None:
            hit = open_claims.join(held, ["kind", "value"], "left_semi").select("arrival").distinct()
            open_claims = open_claims.join(hit, "arrival", "left_anti")
        return accepted.unionByName(_settled(open_claims.withColumn("part", F.lit(0).cast("bigint")), 1))

    value_node = F.concat(F.lit("v"), F.col("kind").cast("string"), F.lit(":"), F.col("value").cast("string"))
    ends = open_claims.select(F.concat(F.lit("a"), F.col("arrival").cast("string")).alias("row"), value_node.alias("held"))
    labels = components(ends, "row", "held", last_links).filter("node LIKE 'a%'")
    named = labels.select(
        F.substring("node", 2, 20).cast("bigint").alias("arrival"), F.xxhash64("component").alias("part")
    )
    waiting = stored(open_claims.join(named, "arrival"))
    while True:
        sizes = waiting.groupBy("part").count()
        largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
        if not total:
            return accepted
        calls = _calls(waiting, total, group_rows)
        if largest <= group_rows:
            return accepted.unionByName(_settled(waiting, calls))
        cut = waiting.groupBy("part").agg(
            F.count("*").alias("_size"),
            F.percentile_approx("arrival", group_rows / largest, 100_000).alias("_cut"),
        )
        turn = (F.col("_size") <= group_rows) | (F.col("arrival") <= F.col("_cut"))
        marked = stored(waiting.join(cut, "part").select(*waiting.columns, turn.alias("_turn")))
        newly = stored(_settled(marked.filter("_turn").drop("_turn"), calls))
        accepted = accepted.unionByName(newly)
        taken = marked.join(newly, "arrival", "left_semi").select("kind", "value")
        later = marked.filter(~F.col("_turn")).drop("_turn")
        hit = later.join(taken, ["kind", "value"], "left_semi").select("arrival").distinct()
        waiting = stored(later.join(hit, "arrival", "left_anti"))


def _simple_round(accepted: DataFrame, claims: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The accepted arrivals with those that come first for all their values, and the claims that are still open."""
    spans = claims.groupBy("kind", "value").agg(F.min("arrival").alias("_first"), F.max("arrival").alias("_last"))
    free = F.lit(True)
    if held is not None:
        spans = spans.join(held.select("kind", "value", F.lit(True).alias("_held")).distinct(), ["kind", "value"], "left")
        free = F.col("_held").isNull()
    # From here on a value is known by the arrival that claimed it first.
    shared = F.when(F.col("_first") < F.col("_last"), F.struct("kind", F.col("_first").alias("value")))
    marked = stored(
        claims.join(spans, ["kind", "value"])
        .groupBy("arrival")
        .agg(
            F.min(free).alias("_free"),
            F.min(F.col("arrival") == F.col("_first")).alias("_wins"),
            F.collect_list(shared).alias("_shared"),
        )
        .filter("_free")
        .drop("_free")
    )
    winners = marked.filter("_wins").select("arrival")
    taken = marked.filter("_wins").select(F.explode("_shared").alias("_claim")).select("_claim.*")
    later = marked.filter(~F.col("_wins")).select("arrival", F.explode("_shared").alias("_claim")).select("arrival", "_claim.*")
    hit = later.join(taken, ["kind", "value"], "left_semi").select("arrival").distinct()
    return accepted.unionByName(winners), stored(later.join(hit, "arrival", "left_anti"))


def _calls(rows: DataFrame, total: int, group_rows: int) -> int:
    """Python calls for so many rows: enough for all cores, and for the bound on a call."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // group_rows))


def _settled(claims: DataFrame, calls: int) -> DataFrame:
    """Accepted arrivals of (arrival, kind, value, part); parts share no values.

    Whole parts are dealt to ``calls`` Python calls.
    """

    # Nested, so that it travels to the workers whole; they need not have this package.
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        asked: dict = {}
        for arrival, kind, value in zip(rows["arrival"].tolist(), rows["kind"], rows["value"]):
            asked.setdefault(arrival, []).append((kind, value))
        taken: set = set()
        fits = []
        for arrival in sorted(asked):
            if taken.isdisjoint(asked[arrival]):
                taken.update(asked[arrival])
                fits.append(arrival)
        return pd.DataFrame({"arrival": fits}, dtype="int64")

    dealt = claims.withColumn("call", F.pmod(F.xxhash64("part"), F.lit(calls)))
    kind = claims.schema["arrival"].dataType.simpleString()
    return dealt.groupBy("call").applyInPandas(settle, schema=f"arrival {kind}")


def accept_disjoint(
    rows: DataFrame, arrival: str, group: str, start: str, end: str, group_rows: int | None = None
) -> DataFrame:
    """Arrivals accepted when the accepted date ranges of a group may not touch.

    Rows are handled in order of ``arrival`` (unique); a row is accepted unless
    it shares a day with an earlier accepted row of its group. Ranges are closed
    and must satisfy ``start <= end``; ``group`` must not be NULL.

    Of equal ranges only the first can be accepted, so rows are first reduced to
    distinct ranges; the size of a group is then set by the calendar and not by
    the number of rows. Groups of up to ``group_rows`` ranges are settled by
    pandas calls on about so many rows. Of a larger group each round settles
    about so many of the earliest, then drops the later ones that overlap what
    was accepted.

    Returns one column, ``arrival``.
    """
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    waiting = pin(
        rows.groupBy(
            F.col(group).alias("grp"), F.col(start).alias("start"), F.col(end).alias("end")
        ).agg(F.min(arrival).alias("arrival"))
    )
    accepted = None
    while True:
        sizes = waiting.groupBy("grp").count()
        largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
        calls = _calls(waiting, total or 0, group_rows)
        if (largest or 0) <= group_rows:
            newly = _greedy(waiting, calls).select("arrival")
            return newly if accepted is None else accepted.unionByName(newly)
        # Per group, the arrival up to which the wanted share of its ranges lies.
        cut = waiting.groupBy("grp").agg(
            F.count("*").alias("_size"),
            F.percentile_approx("arrival", group_rows / largest, 100_000).alias("_cut"),
        )
        turn = (F.col("_size") <= group_rows) | (F.col("arrival") <= F.col("_cut"))
        marked = pin(waiting.join(cut, "grp").select(*waiting.columns, turn.alias("_turn")))
        taken = pin(_greedy(marked.filter("_turn").drop("_turn"), calls).withColumn("weight", F.lit(1)))
        later = with_overlap_count(
            marked.filter(~F.col("_turn")).drop("_turn"),
            ("grp", "start", "end"),
            taken,
            ("grp", "start", "end", "weight"),
        )
        waiting = pin(later.filter(F.col("overlaps") == 0).drop("overlaps"))
        newly = taken.select("arrival")
        accepted = newly if accepted is None else accepted.unionByName(newly)


def _greedy(ranges: DataFrame, calls: int) -> DataFrame:
    """The accepted rows of (grp, start, end, arrival).

    Whole groups are dealt to ``calls`` Python calls, which get plain numbers for days.
    """
    days = ranges.select(
        "grp",
        F.unix_date("start").alias("first"),
        F.unix_date("end").alias("last"),
        "arrival",
        F.pmod(F.xxhash64("grp"), F.lit(calls)).alias("call"),
    )
    schema = days.drop("call").schema

    # Nested, so that it travels to the workers whole; they need not have this package.
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("arrival", kind="stable")
        held: dict = {}
        fits = []
        for group, first, last in zip(rows["grp"], rows["first"].tolist(), rows["last"].tolist()):
            starts, end_of = held.setdefault(group, ([], {}))
            i = bisect_left(starts, first)
            clear_after = i == len(starts) or starts[i] > last
            clear_before = i == 0 or end_of[starts[i - 1]] < first
            fits.append(clear_after and clear_before)
            if fits[-1]:
                starts.insert(i, first)
                end_of[first] = last
        return rows.loc[fits, ["grp", "first", "last", "arrival"]]

    return days.groupBy("call").applyInPandas(settle, schema=schema).select(
        "grp",
        F.date_from_unix_date("first").alias("start"),
        F.date_from_unix_date("last").alias("end"),
        "arrival",
    )
