"""Every named query against its SQL on the smallest bundled tables."""

import os

import pytest

from verification.catalog import all_queries
from verification.compare import compare, oracle_connection
from verification.oracles import all_oracles

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_query_has_a_check():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="bundled tables are not here")
@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, connection, name):
    same, note = compare(spark, connection, FOLDER, name)
    assert same, note
