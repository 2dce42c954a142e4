"""Counting overlaps of closed date ranges without listing the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetframe.plans.lookups import measured


def with_overlap_count(
    probes: DataFrame,
    probe_columns: tuple[str, str, str],
    ranges: DataFrame,
    range_columns: tuple[str, str, str, str],
    name: str = "overlaps",
) -> DataFrame:
    """Append to each probe the summed weight of the ranges of its group it touches.

    ``probe_columns`` are (group, start, end), ``range_columns`` (group, start,
    end, weight). Touching end days overlap. A probe whose start is after its
    end, or with a NULL date, gets NULL. Ranges with a NULL date never count.

    A range touches [s, e] unless it starts after e or ends before s, hence
        touched = (weight starting on or before e) - (weight ending before s).
    A range recorded back to front, start after end, touches only when it starts
    on or after s and ends on or before e:
        touched = (weight starting on or after s) - (weight ending after e).
    Each part is a running sum over the days of one group. Ranges and probes are
    reduced to one row per group and day before the running sum, so a group is
    never longer than its calendar, however many ranges or probes it has.
    """
    p_group, p_start, p_end = probe_columns
    r_group, r_start, r_end, r_weight = range_columns

    usable = ranges.filter(F.col(r_start).isNotNull() & F.col(r_end).isNotNull()).select(
        F.col(r_group).alias("_g"),
        F.col(r_start).alias("_s"),
        F.col(r_end).alias("_e"),
        F.col(r_weight).cast("long").alias("_w"),
    )
    straight = F.col("_s") <= F.col("_e")
    zero = F.lit(0).cast("long")
    # At day d: starts/ends of straight ranges, and of reversed ones, on d.
    marks = usable.select(
        "_g",
        F.explode(
            F.array(
                F.struct(
                    F.col("_s").alias("day"),
                    F.when(straight, F.col("_w")).otherwise(zero).alias("starts"),
                    zero.alias("ends"),
                    F.when(straight, zero).otherwise(F.col("_w")).alias("r_starts"),
                    zero.alias("r_ends"),
                ),
                F.struct(
                    F.col("_e").alias("day"),
                    zero.alias("starts"),
                    F.when(straight, F.col("_w")).otherwise(zero).alias("ends"),
                    zero.alias("r_starts"),
                    F.when(straight, zero).otherwise(F.col("_w")).alias("r_ends"),
                ),
            )
        ).alias("_m"),
    ).select("_g", "_m.*")
    asked = probes.filter(F.col(p_start) <= F.col(p_end)).select(
        F.col(p_group).alias("_g"), F.explode(F.array(p_start, p_end)).alias("day")
    )
    for column in ("starts", "ends", "r_starts", "r_ends"):
        asked = asked.withColumn(column, zero)
    calendar = (
        marks.unionByName(asked)
        .groupBy("_g", "day")
        .agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "r_starts", "r_ends")])
    )

    days = Window.partitionBy("_g").orderBy("day")
    up_to = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")

    def running(column: str, frame) -> Column:
        return F.coalesce(F.sum(column).over(frame), zero)

    # As the last day of a probe, and as its first day. Both sums travel in one
    # array, so the two joins below read the same columns and share one shuffle, or one small table sent to all tasks.
    at_end = running("starts", up_to) - (F.sum("r_ends").over(whole) - running("r_ends", up_to))
    at_start = F.sum("r_starts").over(whole) - running("r_starts", before) - running("ends", before)
    sums = calendar.select("_g", "day", F.array(at_end, at_start).alias("_sums"))
    sums = measured(sums, keep=True).hinted()
    last = sums.select(F.col("_g").alias("_g1"), F.col("day").alias("_d1"), F.col("_sums").alias("_last"))
    first = sums.select(F.col("_g").alias("_g2"), F.col("day").alias("_d2"), F.col("_sums").alias("_first"))
    valid = F.col(p_start) <= F.col(p_end)
    return (
        probes.join(last, (F.col(p_group) == F.col("_g1")) & (F.col(p_end) == F.col("_d1")), "left")
        .join(first, (F.col(p_group) == F.col("_g2")) & (F.col(p_start) == F.col("_d2")), "left")
        .withColumn(name, F.when(valid, F.coalesce(F.col("_last")[0] + F.col("_first")[1], zero)))
        .select(*probes.columns, name)
    )
