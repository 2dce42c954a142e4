"""Searches by posting lists find what a scan finds; the handlers search on every keystroke."""

import datetime as dt

import pytest

from fleetframe.functions import literal_runs
from fleetframe.operators import bookings, search
from fleetframe.sources import batches, trigrams
from fleetframe.sources.tables import read_parquet_tables
from fleetframe.streaming.micro_batch import edit_batch, write_base

NOW = dt.datetime(2024, 3, 10, 8, 30)
EDIT = "arrival bigint, action string, id_card string, name string, phone_number string, address string, drivers_license string"


def test_literal_runs():
    assert literal_runs("hot bolt") == ["hot bolt"]
    assert literal_runs("bk%7_3") == ["bk", "7", "3"]
    assert literal_runs(r"50\%\_x\\y") == ["50%_x\\y"]
    assert literal_runs("%_") == [] and literal_runs("") == []


@pytest.fixture()
def folder(spark, small, make_tables, tmp_path, monkeypatch):
    """Three batches with lists, among them an edit, and one without; short lists and small parts."""
    monkeypatch.setattr(trigrams, "LIST_KEYS", 3)
    monkeypatch.setattr(trigrams, "SCAN_SHARE", 0.9)
    folder = str(tmp_path)
    write_base(small, folder)
    many = [(f"9{i:03}", f"N{i}", f"Person {i} {'Straße' if i % 5 else 'İstanbul'}", f"0{i:05}", None) for i in range(40)]
    batches.write_batch(spark, folder, 0, {"customer": make_tables(customer=many).customer}, {})
    edits = [(1, "update", "1111", "Anastasia", "0811", "Nowhere", "L1"), (2, "delete", "9007", *[None] * 4)]
    edit_batch("customer", spark.createDataFrame(edits, EDIT), 1, folder, NOW)
    assert trigrams.update_index(spark, folder) == [-1, 0, 1]
    assert trigrams.update_index(spark, folder) == []
    late = make_tables(customer=[("8000", "L8", "Zacharias Person", "0877", "X")]).customer
    batches.write_batch(spark, folder, 2, {"customer": late}, {})
    return folder


TERMS = ["Ana", "person 1", "straße", "STRASSE", "istanbul", "north", "nowhere", "0811", "zach", "100%", "east_3", "9007", "person%9", "zz", "abcdef", "ers_n", "", "%"]


def test_same_rows_as_a_scan(spark, folder):
    plain, indexed = read_parquet_tables(spark, folder), trigrams.read_indexed_tables(spark, folder)
    assert indexed.unindexed == (2,)
    for term in TERMS:
        for run in (search.search_customers, search.customer_quick_search, search.customer_picker):
            assert run(indexed, term).collect() == run(plain, term).collect(), (run.__name__, term)
    for term in ("swift", "ana", "sari", "B1", "hiace"):
        got, expected = (bookings.search_bookings(t, term, NOW.date()).collect() for t in (indexed, plain))
        assert got == expected, term


def test_lists_are_short_and_new_batches_are_indexed_alone(spark, folder):
    lists = spark.read.parquet(f"{folder}/customer_grams")
    assert lists.filter("batch_id = 0").selectExpr("max(size(keys))").first()[0] < 14
    assert lists.filter("batch_id = 1").selectExpr("count(distinct gram)").first()[0] < 60
    assert trigrams.update_index(spark, folder) == [2]
    assert trigrams.read_indexed_tables(spark, folder).unindexed == ()


def test_files_of_few_buckets_are_read(spark, folder):
    tables = trigrams.read_indexed_tables(spark, folder)
    plan = tables.lists("customer", ["ana", "nas"])._jdf.queryExecution().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("bucket#" in f.split("PushedFilters")[0].split("PartitionFilters")[1] for f in filters), plan
    assert "In(gram, [ana,nas])" in plan
    read = set(tables.lists("customer", ["ana", "nas"]).selectExpr("input_file_name() AS f").distinct().toPandas()["f"])
    assert 0 < len(read) <= 2 * 3


def test_index_that_broke_off_is_made_anew(spark, folder):
    rows = spark.read.parquet(f"{folder}/customer_grams/batch_id=0").limit(1)
    rows.drop("bucket").write.mode("overwrite").parquet(f"{folder}/customer_grams/batch_id=2/bucket=0")
    assert trigrams.read_indexed_tables(spark, folder).unindexed == (2,)
    assert trigrams.update_index(spark, folder) == [2]
    found = search.search_customers(trigrams.read_indexed_tables(spark, folder), "zacharias").collect()
    assert [r.ID_Card for r in found] == ["8000"]


def test_keys_of_lists_are_shuffled_once(spark, small, capsys):
    lists, total = trigrams.posting_lists(small.customer, "customer")
    capsys.readouterr()
    lists.explain()
    plan = capsys.readouterr().out
    assert total == 3 and plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1
