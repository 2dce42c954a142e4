"""Dumps of the database, which the setup guide has users load before anything else."""

import datetime as dt
import io
import random

import pytest

from fleetframe.sources import dump
from fleetframe.sources.tables import SCHEMAS
from values import day, money

NAMES = ["id", "name", "note"]


def in_ranges(text, step, whole_file=False, table="t"):
    data = text.encode()
    rows = []
    for low in range(0, len(data), step):
        rows += dump.rows_in_range(io.BytesIO(data), low, min(low + step, len(data)), table, NAMES, whole_file)
    return rows


DUMP = r"""-- MySQL dump 10.13
/*!40000 ALTER TABLE `t` DISABLE KEYS */;
LOCK TABLES `t` WRITE;
INSERT INTO `t` VALUES ('1','a','x'),('2',NULL,'it''s'),('3','b\'c','\\');
INSERT INTO `other` VALUES ('9','9','9');
INSERT IGNORE INTO `db`.`t` (`Note`, `ID`) VALUES
('line\nbreak', '4'),
('); INSERT INTO `t` VALUES (\'5\',\'no\',\'no\');', '6');  INSERT INTO t VALUES ('7', _utf8 'né', '%');
replace into T values (8, -1.5e3, 'null');
INSERT INTO `t` SELECT * FROM `other`;
UNLOCK TABLES;
INSERT INTO `t` VALUES ('10','','(,;)')"""
ROWS = [
    ["1", "a", "x"],
    ["2", None, "it's"],
    ["3", "b'c", "\\"],
    ["4", None, "line\nbreak"],
    ["6", None, "); INSERT INTO `t` VALUES ('5','no','no');"],
    ["7", "né", "%"],
    ["8", "-1.5e3", "null"],
]


@pytest.mark.parametrize("read_bytes", [1, 7, 64, 1 << 20])
def test_every_row_once_for_any_ranges(monkeypatch, read_bytes):
    monkeypatch.setattr(dump, "READ_BYTES", read_bytes)
    text = DUMP + ";\n"
    for step in [1, 2, 3, 5, 17, 63, 64, 100, 250, 10_000]:
        if read_bytes > 1 or step > 60:
            assert in_ranges(text, step) == ROWS + [["10", "", "(,;)"]], step


def test_statement_without_an_end():
    with pytest.raises(ValueError, match="without an end"):
        in_ranges(DUMP, 10_000)


def test_raw_line_breaks_need_whole_files():
    text = "INSERT INTO t VALUES ('1','a\nINSERT INTO t VALUES (''2'')','b');\n"
    with pytest.raises(ValueError, match="raw line break"):
        in_ranges(text, 1_000)
    assert in_ranges(text, 1_000, whole_file=True) == [["1", "a\nINSERT INTO t VALUES ('2')", "b"]]


def test_wrong_number_of_values():
    with pytest.raises(ValueError, match="2 values for 3 columns"):
        in_ranges("INSERT INTO t VALUES (1, 2);\n", 100)


def test_random_dumps():
    rng = random.Random(5)
    alphabet = ["'", "\\", "\n", "\r", ",", "(", ")", ";", "a", "é", " ", "INSERT INTO t VALUES (", "\0", "%"]
    for _ in range(60):
        rows, text = [], ""
        for _ in range(rng.randrange(1, 8)):
            group = [["".join(rng.choices(alphabet, k=rng.randrange(9))) for _ in NAMES] for _ in range(rng.randrange(1, 4))]
            rows += group
            quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", rng.choice(["''", "\\'"])).replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"  # noqa: B023, E731
            values = rng.choice([",", ",\n", ", "]).join("(" + ",".join(map(quote, row)) + ")" for row in group)
            text += "INSERT INTO `t` VALUES" + rng.choice([" ", "\n", ""]) + values + ";" + rng.choice(["\n", "\r\n", "\n\n-- x\n", " "])
        assert in_ranges(text, rng.randrange(1, 90)) == rows


def test_tables_round_trip(spark, make_tables, tmp_path):
    """Every kind of column, texts that need escapes, NULLs, and small ranges."""
    tables = make_tables(
        booking=[(f"B{i}", day("2024-03-01"), None, day("2024-03-09"), "L'1\\", None, "\n); --") for i in range(40)],
        transaction=[(f"T{i}", None, money("-12.50"), dt.datetime(2024, 3, 1, 9, 0, 0, i), "S1", "B1") for i in range(40)],
        notification=[(None, "näme 'x'", "info", None, 1, dt.datetime(2024, 1, 1)), ("1", "", "", "", None, None)],
    )
    for name in ("booking", "transaction", "notification"):
        dump.write_dump(getattr(tables, name), str(tmp_path), dump.DATABASE_NAMES[name], statement_rows=7)
    for split in (0, 300, 1 << 20):
        read = dump.read_dump_tables(spark, str(tmp_path), split_bytes=split)
        for name, schema in SCHEMAS.items():
            got = getattr(read, name)
            assert got.schema == schema
            assert sorted(map(str, got.collect())) == sorted(map(str, getattr(tables, name).collect())), (name, split)
    assert dump.read_dump(spark, str(tmp_path), "Booking", SCHEMAS["booking"], 300).rdd.getNumPartitions() > 10


def test_zero_dates_and_missing_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO Booking (booking_id, start_date) VALUES ('B1','0000-00-00');\n")
    row = dump.read_dump(spark, str(tmp_path / "a.sql"), "booking", SCHEMAS["booking"]).first()
    assert row.booking_id == "B1" and row.start_date is None and row.end_date is None
    with pytest.raises(Exception, match="nowhere"):
        dump.read_dump(spark, f"{tmp_path}/nowhere", "booking", SCHEMAS["booking"]).count()


def test_small_ranges_share_a_task(spark, tmp_path):
    rows = spark.range(400).selectExpr("CAST(id AS STRING) AS car_car_id", "'it''s\\\\' AS transaction_transaction_id")
    dump.write_dump(rows.coalesce(2), str(tmp_path), "bridge", statement_rows=3)
    read = dump.read_dump(spark, str(tmp_path), "bridge", rows.schema, 50)
    most = 2 * dump.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert read.rdd.getNumPartitions() <= most
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))


def test_shares_keep_every_range_and_their_bound():
    ranges = [dump.FileRange(path, low, low + 10) for path in "ab" for low in range(0, 100, 10)]
    for tasks, bound, shares in [(1, 1000, 1), (4, 1000, 4), (1, 30, 7), (50, 1000, 20), (1, 5, 20)]:
        dealt = dump.dealt_ranges(ranges, tasks, bound)
        assert [r for d in dealt for r in d.ranges] == ranges
        assert len(dealt) == shares
