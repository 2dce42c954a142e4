"""Comparing texts under a collation, as a database does in its unique keys, joins and groups.

Under ``UTF8_LCASE`` 'dl1' and 'DL1' are one value, under ``UNICODE_CI_AI`` also 'José' and 'jose'. Without a
collation texts are compared by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def under(column: Column, collation: str | None) -> Column:
    """The column, compared under a collation from here on."""
    return column if collation is None else F.collate(column, collation)


def with_canonical(rows: DataFrame, columns: list[str], collation: str) -> DataFrame:
    """Append for each column ``_as_<column>``: of the values that are equal under the collation the smallest by bytes.

    The values are reduced to distinct ones, partly on the map side, before they meet.
    """
    for column in columns:
        values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
        least = values.groupBy(under(F.col("_value"), collation).alias("_equal")).agg(F.min("_value").alias(f"_as_{column}"))
        rows = rows.join(least, under(F.col(column), collation) == F.col("_equal"), "left").drop("_equal")
    return rows
