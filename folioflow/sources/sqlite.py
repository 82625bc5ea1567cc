"""Tables of a SQLite file as a Spark source, read in several tasks by ranges of rowid.

    spark.dataSource.register(SqliteSource)
    spark.read.format("folio_sqlite").option("path", p).option("table", t).load()

The file must lie in a folder that driver and executors share; it is opened read-only. A table that the file doesn't
have is empty, and so is one of a file that doesn't exist; without a schema of the caller's it has no columns to infer, so one is needed then.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Rows of a task, where the number of tasks isn't given.
ROWS = 100_000
#: Declared types that hold what Spark calls so, by the rules for column affinity.
AFFINITY = [("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType())]


def _open(path: str) -> sqlite3.Connection | None:
    if not Path(path).is_file():
        return None
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _columns(con: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    return [(r[1], r[2] or "") for r in con.execute(f"PRAGMA table_info({_quoted(table)})")]


def _value(x, kind: DataType):
    """A stored value as one of the column's type; what can't be one is null, as SQLite lets any value into any column."""
    try:
        if x is None or isinstance(x, bytes) and not isinstance(kind, BinaryType):
            return None
        if isinstance(kind, (LongType, IntegerType)):
            n = int(x)
            most = 63 if isinstance(kind, LongType) else 31
            return n if float(x) == n and -(1 << most) <= n < 1 << most else None
        if isinstance(kind, DoubleType):
            return float(x)
        if isinstance(kind, BinaryType):
            return x if isinstance(x, bytes) else str(x).encode()
        return str(x)
    except (TypeError, ValueError, OverflowError):
        return None


class Rows(InputPartition):
    """Rowids from low to high, both included; None means all rows of a table without rowids."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, tasks: int | None):
        self.path, self.table, self.fields, self.tasks = path, table, schema.fields, tasks

    def partitions(self) -> list[Rows]:
        con = _open(self.path)
        if con is None:
            return []
        try:
            if not _columns(con, self.table):
                return []
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowids, or a view
                return [Rows(None, None)]
            if low is None:
                return []
            n = self.tasks or -(-(high - low + 1) // ROWS)
            n = max(1, min(n, high - low + 1))
            cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
            return [Rows(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        finally:
            con.close()

    def read(self, part: Rows | None) -> Iterator[tuple]:
        if part is None:  # Spark asks once where there are no partitions
            return
        con = _open(self.path)
        if con is None:
            raise FileNotFoundError(self.path)  # the driver saw it: the folder isn't shared
        try:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            there = {n.lower() for n, _ in _columns(con, self.table)}
            listed = ", ".join(_quoted(f.name) if f.name.lower() in there else "NULL" for f in self.fields) or "1"
            sql, args = f"SELECT {listed} FROM {_quoted(self.table)}", ()
            if part.low is not None:
                sql, args = f"{sql} WHERE rowid BETWEEN ? AND ?", (part.low, part.high)
            for row in con.execute(sql, args):
                yield tuple(_value(x, f.dataType) for x, f in zip(row, self.fields, strict=False))
        finally:
            con.close()


class SqliteSource(DataSource):
    """Options: path, table, tasks."""

    @classmethod
    def name(cls) -> str:
        return "folio_sqlite"

    def schema(self) -> StructType:
        con = _open(self.options["path"])
        columns = _columns(con, self.options["table"]) if con else []
        if con:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']} to infer a schema from; give one")
        kind = lambda declared: next((t for part, t in AFFINITY if part in declared.upper()), StringType())
        return StructType([StructField(n, kind(d)) for n, d in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        tasks = self.options.get("tasks")
        return SqliteReader(self.options["path"], self.options["table"], schema, int(tasks) if tasks else None)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, tasks: int | None = None) -> DataFrame:
    """A table of a SQLite file; columns that it lacks are null."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("folio_sqlite").option("path", path).option("table", table)
    if tasks:
        reader = reader.option("tasks", tasks)
    return (reader.schema(schema) if schema else reader).load()
