"""Tables from SQL dump files, as a data source of Spark (``format("sql_dump")``), and the writer of such files.

A dump is text with one INSERT or REPLACE statement after another, each for one row or for many, on one line or
over several. Files are cut into byte ranges. A statement belongs to the range in which its line starts;
the reader of a range looks for the first line that starts a statement, and reads the last statement of its
range to the end, however far that lies in the next one, and what follows on the same line. So every row is
read once, whatever the ranges.

Values are quoted texts with backslash escapes or doubled quotes, NULL, and plain numbers. Dump tools write line
breaks within texts as escapes; a text with a raw line break could hold a line that looks like a statement,
so it is an error unless ``split_bytes`` is 0, which reads each file in one range. Columns are matched by
name, ignoring case, where a statement names them, else by place. Dates of all zeros are NULL. Other
statements, other tables and comments are passed over. Files are opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from fleetframe.session import reach_workers
from fleetframe.sources.tables import DATABASE_NAMES, SCHEMAS, RentalTables

FORMAT = "sql_dump"
# Bytes of a range, bytes read at a time, rows of a batch.
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
BATCH_ROWS = 8_192
# Tasks that read a dump, before their shares reach the size of a range.
TASKS_PER_CORE = 4
# Longest head of a statement, up to its first row.
HEAD_BYTES = 1 << 16
# Rows of one statement that is written.
STATEMENT_ROWS = 500

_NAME = rb"(?:`(?:[^`]|``)+`|[\w$]+)"
_START = re.compile(
    rb"(?:INSERT\s+(?:IGNORE\s+)?|REPLACE\s+)INTO\s+(?:" + _NAME + rb"\s*\.\s*)?(?P<table>" + _NAME + rb")"
    rb"\s*(?:\((?P<columns>[^)]*)\))?\s*VALUES?(?=\s*\()",
    re.IGNORECASE,
)
# A line that may start a statement; the statement's head can go on in further lines.
_LINE = re.compile(rb"(?:INSERT|REPLACE)\s", re.IGNORECASE)
_QUOTED = rb"'(?:[^'\\]++|\\.|'')*+'"
_ROW = re.compile(rb"\s*+\(((?:[^'()]++|" + _QUOTED + rb")*+)\)\s*+([,;])", re.DOTALL)
_VALUE = re.compile(rb"\s*+(?:_\w+\s*+)?(?:'((?:[^'\\]++|\\.|'')*+)'|([^,'\s]++))\s*+(?:,|$)", re.DOTALL)
_PLAIN_ROW_VALUE = rb"\s*+(?:'((?:[^'\\]++|\\.|'')*+)'|([^,'\s()]++))\s*+"
_ESCAPED = re.compile(r"\\(.)|''", re.DOTALL)
# What a character after a backslash stands for; any other stands for itself.
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "%": "\\%", "_": "\\_"}


def _unescaped(text: bytes) -> str:
    plain = text.decode("utf-8")
    if "\\" not in plain and "''" not in plain:
        return plain
    return _ESCAPED.sub(lambda m: "'" if m.group(1) is None else _ESCAPES.get(m.group(1), m.group(1)), plain)


def row_values(body: bytes) -> list[str | None]:
    """The values between the brackets of a row, as text."""
    values, at = [], 0
    while at < len(body):
        found = _VALUE.match(body, at)
        if found is None:
            raise ValueError(f"cannot read values: {body[at : at + 80]!r}")
        quoted, plain = found.groups()
        if quoted is not None:
            values.append(_unescaped(quoted))
        else:
            values.append(None if plain.upper() == b"NULL" else plain.decode("ascii"))
        at = found.end()
    return values


@lru_cache(maxsize=64)
def _row_of(width: int) -> re.Pattern[bytes]:
    """A row of so many values, as dump tools write them: group 1 is what lies between the brackets, then come two
    groups a value, quoted or plain, and the sign after the row. Rows it does not match may still be rows."""
    return re.compile(rb"\s*+\((" + rb",".join([_PLAIN_ROW_VALUE] * width) + rb")\)\s*+([,;])", re.DOTALL)


def _bare(name: bytes) -> str:
    text = name.decode("utf-8").strip()
    return text[1:-1].replace("``", "`") if text.startswith("`") else text


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class FileRange:
    """Bytes ``low`` to ``high`` of a file."""

    path: str
    low: int
    high: int


@dataclass
class FileRanges(InputPartition):
    """Ranges that one task reads, one after another."""

    ranges: list[FileRange]


def dealt_ranges(ranges: list[FileRange], tasks: int, task_bytes: int) -> list[FileRanges]:
    """All ranges in their order, neighbours together: about ``tasks`` shares, each of ``task_bytes`` at most or one range."""
    share = min(task_bytes, -(-sum(r.high - r.low for r in ranges) // max(1, tasks)))
    dealt: list[FileRanges] = []
    room = 0
    for one in ranges:
        size = one.high - one.low
        if not dealt or size > room:
            dealt.append(FileRanges([]))
            room = share
        dealt[-1].ranges.append(one)
        room -= size
    return dealt


class _Text:
    """A file read forward in pieces; ``at`` is a place in what is held."""

    def __init__(self, source, start: int) -> None:
        source.seek(start)
        self.source, self.held, self.at, self.before = source, b"", 0, start

    @property
    def place(self) -> int:
        """Bytes of the file before ``at``."""
        return self.before + self.at

    def more(self) -> bool:
        """Read on; False at the end of the file."""
        piece = self.source.read(READ_BYTES)
        self.before += self.at
        self.held, self.at = self.held[self.at :] + piece, 0
        return bool(piece)

    def skip_blanks(self) -> bool:
        """Go past blanks; False at the end of the line or file."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b" \t":
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at] not in b"\r\n"
            if not self.more():
                return False

    def next_line(self) -> bool:
        """Go past the next line break; False if there is none."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            self.at = len(self.held)
            if not self.more():
                return False
        self.at = end + 1
        return True


def rows_in_range(source, low: int, high: int, table: str, names: list[str], whole_file: bool) -> Iterator[list[str | None]]:
    """The rows of ``table`` whose statements start in a range, with their values in the order of ``names``."""
    text = _Text(source, max(0, low - 1))
    # A statement at the very start of the range follows a line break just before it.
    if low and not text.next_line():
        return
    wanted = {name.lower(): i for i, name in enumerate(names)}
    goes_on = False
    while goes_on or text.place < high:
        while len(text.held) - text.at < 16 and text.more():
            pass
        head = None
        if _LINE.match(text.held, text.at):
            head = _START.match(text.held, text.at)
            # The head may reach beyond what is held.
            while head is None and len(text.held) - text.at < HEAD_BYTES and text.more():
                head = _START.match(text.held, text.at)
        if head is None:
            if not text.next_line():
                return
            goes_on = False
            continue
        takes = _bare(head["table"]).lower() == table.lower()
        columns = [_bare(c).lower() for c in head["columns"].split(b",")] if head["columns"] else [n.lower() for n in names]
        text.at = head.end()
        yield from _statement_rows(text, takes, [wanted.get(c) for c in columns], len(names), whole_file)
        goes_on = text.skip_blanks()


def _statement_rows(
    text: _Text, takes: bool, places: list[int | None], width: int, whole_file: bool
) -> Iterator[list[str | None]]:
    end = b","
    usual = _row_of(len(places))
    straight = places == list(range(width))
    while end == b",":
        # The usual form of a row is taken apart by one match.
        if found := usual.match(text.held, text.at):
            text.at = found.end()
            parts = found.groups()
            body, end = parts[0], parts[-1]
            if not whole_file and (b"\n" in body or b"\r" in body):
                raise ValueError(f"raw line break in a value before byte {text.place}; read with split_bytes=0")
            if takes:
                values = [
                    (None if p.upper() == b"NULL" else p.decode("ascii")) if q is None else _unescaped(q)
                    for q, p in zip(parts[1:-1:2], parts[2:-1:2])
                ]
                yield values if straight else _placed(values, places, width)
            continue
        while (found := _ROW.match(text.held, text.at)) is None:
            if not text.more():
                raise ValueError(f"statement without an end at byte {text.place}")
        body, end = found.groups()
        text.at = found.end()
        if not whole_file and (b"\n" in body or b"\r" in body):
            raise ValueError(f"raw line break in a value before byte {text.place}; read with split_bytes=0")
        if takes:
            values = row_values(body)
            if len(values) != len(places):
                raise ValueError(f"{len(values)} values for {len(places)} columns before byte {text.place}")
            yield _placed(values, places, width)


def _placed(values: list[str | None], places: list[int | None], width: int) -> list[str | None]:
    row: list[str | None] = [None] * width
    for place, value in zip(places, values):
        if place is not None:
            row[place] = value
    return row


def _column(values: list[str | None], kind: pa.DataType) -> pa.Array:
    texts = pa.array(values, pa.string())
    if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
        texts = pc.if_else(pc.starts_with(texts, "0000-00-00"), None, texts)
    return texts if pa.types.is_string(kind) else texts.cast(kind)


class DumpReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.names, self.arrow = schema.names, to_arrow_schema(schema)
        self.path, self.table = options["path"], options["table"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[FileRanges]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        ranges = []
        for file in sorted((f for f in files if f.is_file and f.size), key=lambda f: f.path):
            if not file.base_name.startswith(("_", ".")):
                step = self.split or file.size
                ranges += [FileRange(file.path, low, min(low + step, file.size)) for low in range(0, file.size, step)]
        return dealt_ranges(ranges, self.tasks, SPLIT_BYTES)

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        held: list[list[str | None]] = []
        for one in partition.ranges:
            with store.open_input_file(one.path) as source:
                for row in rows_in_range(source, one.low, one.high, self.table, self.names, not self.split):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        columns = [_column(list(values), f.type) for values, f in zip(zip(*rows), self.arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)


class DumpSource(DataSource):
    """Options: ``path`` (a file or folder), ``table`` (its name in the dump), ``split_bytes``, ``tasks``; the schema is given.

    Ranges are dealt to about so many tasks, in shares of at most ``SPLIT_BYTES``, so small ranges are no tasks of their own.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(schema, self.options)


def read_dump(
    spark: SparkSession, path: str, table: str, schema: T.StructType, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """One table of a dump, with the columns of ``schema``; columns the dump lacks are NULL."""
    reach_workers(spark)
    spark.dataSource.register(DumpSource)
    reader = spark.read.format(FORMAT).schema(schema).option("table", table).option("split_bytes", split_bytes)
    return reader.option("tasks", TASKS_PER_CORE * spark.sparkContext.defaultParallelism).load(path)


def read_dump_tables(
    spark: SparkSession, path: str, names: dict[str, str] | None = None, split_bytes: int = SPLIT_BYTES
) -> RentalTables:
    """All tables from a dump of the database; ``names`` replaces names of ``DATABASE_NAMES``."""
    known = {**DATABASE_NAMES, **(names or {})}
    return RentalTables(
        **{name: read_dump(spark, path, known[name], schema, split_bytes) for name, schema in SCHEMAS.items()}
    )


def _literal(column: Column, kind: T.DataType) -> Column:
    """A value as it stands in a statement; NULL is never quoted."""
    text = column.cast("string")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(text, F.lit("NULL"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))
    for plain, escape in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def write_dump(rows: DataFrame, path: str, table: str, statement_rows: int = STATEMENT_ROWS) -> None:
    """Write rows as INSERT statements that name their columns, one file per partition."""
    row = F.concat(F.lit("("), F.concat_ws(",", *[_literal(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema]), F.lit(")"))
    columns = ", ".join(f"`{name}`" for name in rows.columns)
    head = f"INSERT INTO `{table}` ({columns}) VALUES\n"

    def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, statement_rows):
                part = batch.column(0).slice(low, statement_rows).to_pylist()
                yield pa.RecordBatch.from_pydict({"value": [head + ",\n".join(part) + ";"]})

    rows.select(row.alias("value")).mapInArrow(statements, "value string").write.mode("append").text(path)
