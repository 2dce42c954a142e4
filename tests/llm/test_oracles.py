import os

import duckdb
import pytest

from fleetframe.llm.queries import all_oracles, all_queries
from verification.compare import rows_by_name


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_agrees_with_its_sql(spark, bundled, name):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = connection.execute(all_oracles()[name])
    columns = [d[0] for d in expected.description]
    result = all_queries()[name](spark, folder)
    got = rows_by_name(result.columns, [tuple(r) for r in result.collect()])
    assert sorted(result.columns) == sorted(columns)
    assert got == rows_by_name(columns, expected.fetchall()) and got
