"""Meeting a small frame with large tables.

The optimizer cannot know how few rows survive a search, a date filter or a
top-k cut, and would shuffle the large table to be safe. Here at most as many
rows are pinned as can be broadcast. If these are all, their size is known and
they are sent to the tasks that scan the large table. If there are more, nothing
else is written, and the join is left to the optimizer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe.plans.collations import under
from fleetframe.session import pin, stored

BROADCAST_BYTES = 32 * 1024 * 1024

# Fixed part of the estimate, per value.
_VALUE_BYTES = 16


@dataclass(frozen=True)
class Measured:
    """A frame and the bytes that each of its columns holds; None if they are too many to send."""

    frame: DataFrame
    column_bytes: dict[str, int] | None

    def fits_broadcast(self, *columns: str) -> bool:
        if self.column_bytes is None:
            return False
        wanted = columns or self.column_bytes
        return sum(self.column_bytes[c] for c in wanted) <= BROADCAST_BYTES

    def hinted(self) -> DataFrame:
        """The frame, with a broadcast hint if it is small enough."""
        return F.broadcast(self.frame) if self.fits_broadcast() else self.frame

    def where(self, condition: Column) -> Measured:
        """The rows that meet a condition; the sizes stay an upper bound."""
        return Measured(self.frame.filter(condition), self.column_bytes)


def measured(df: DataFrame, keep: bool = False) -> Measured:
    """Pin a frame that may be small enough to send, and add up its values.

    With ``keep`` the frame is stored whatever its size, for one that feeds several branches anyway or that is dear to
    compute again.
    """
    most = max(0, BROADCAST_BYTES // (_VALUE_BYTES * len(df.columns)))
    if keep:
        frame = stored(df)
        if frame.count() > most:
            return Measured(frame, None)
    elif most:
        frame = pin(df.limit(most + 1))
    else:
        return Measured(df, None)
    sizes = [
        F.sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(_VALUE_BYTES)).alias(f"size{i}")
        for i, c in enumerate(df.columns)
    ]
    found = frame.agg(F.count("*").alias("rows"), *sizes).first()
    if found["rows"] > most:
        return Measured(frame if keep else df, None)
    return Measured(frame, {c: found[f"size{i}"] or 0 for i, c in enumerate(df.columns)})


def matching_rows(big: DataFrame, key: str, few: Measured, few_key: str, collation: str | None = None) -> DataFrame:
    """Rows of ``big`` whose key occurs in ``few``, compared by bytes or under a collation."""
    keys = few.frame.select(F.col(few_key).alias("_wanted"))
    if few.fits_broadcast(few_key):
        keys = F.broadcast(keys)
    return big.join(keys, under(F.col(key), collation) == under(F.col("_wanted"), collation), "left_semi")
