"""Run named queries on Spark and their SQL on DuckDB and compare the rows.

    python -m verification.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from fleetframe.session import build_session
from verification.catalog import all_queries
from verification.oracles import all_oracles

SOURCES = "customer supplier part orders lineitem events".split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return "\0" if value is None else str(value)


def rows_by_name(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, name: str) -> tuple[bool, str]:
    began = time.time()
    result = all_queries()[name](spark, folder)
    rows = [tuple(r) for r in result.collect()]
    spent = time.time() - began
    began = time.time()
    cursor = connection.execute(all_oracles()[name])
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    checked = time.time() - began
    if sorted(result.columns) != sorted(expected_columns):
        return False, f"columns {sorted(result.columns)} / {sorted(expected_columns)}"
    left, right = rows_by_name(result.columns, rows), rows_by_name(expected_columns, expected)
    note = f"{len(left)} rows, {spent:.1f}s, sql {checked:.1f}s"
    if left == right:
        return True, note
    odd = [(a, b) for a, b in zip(left, right) if a != b][:3]
    return False, f"{note}, expected {len(right)} rows, {odd}"


def main(folder: str, names: list[str]) -> int:
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    failed = 0
    for name in names or list(all_oracles()):
        try:
            same, note = compare(spark, connection, folder, name)
        except Exception as error:
            same, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not same
        print("ok  " if same else "FAIL", name, note, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
