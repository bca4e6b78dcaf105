"""SQLite tables as a Python data source: read in ranges of row ids; written, or updated by a key, in one transaction."""

from __future__ import annotations

import os
import shutil
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "TEXT": "string", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.parts, self.names = options["path"], options["table"], int(options.get("partitions", "8")), schema.names

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part: RowRange) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (part.low, part.high))


@dataclass
class Part(WriterCommitMessage):
    """A task's rows, as an SQLite file of their own beside the target."""

    path: str


class SqliteWriter(DataSourceWriter):
    """Tasks write their rows as parts in a folder beside the file, which all executors must share; the commit takes the
    parts of the tasks that succeeded into the file, in one transaction, and the driver's memory holds a row at a time. A job
    that fails leaves the file as it was. With ``key`` rows that the table has are updated, and columns that it lacks are
    added as REAL; without, the table is made anew."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.table, self.key, self.names = options["path"], options["table"], options.get("key"), schema.names
        self.staging = options.get("staging") or f"{self.path}.parts-{uuid4().hex}"
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        self.columns = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in schema.fields)
        if overwrite == bool(self.key):
            raise ValueError("a table is overwritten without a key and updated, in mode append, with one")
        if self.key and self.key not in self.names:
            raise ValueError(f"no column {self.key}; the rows have {', '.join(self.names)}")
        os.makedirs(self.staging, exist_ok=True)  # here, so that a task which outlives an abort cannot make it again

    def write(self, iterator: Iterator[tuple]) -> Part:
        part = f"{self.staging}/{uuid4().hex}.part"  # each attempt has its own
        with sqlite3.connect(part) as db:
            db.execute(f"CREATE TABLE part ({self.columns})")
            db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.names))})", map(tuple, iterator))
        db.close()
        return Part(part)

    def commit(self, messages: list[Part | None]) -> None:
        db = sqlite3.connect(self.path, isolation_level=None)
        try:
            done = self._take(db, [m.path for m in messages if m])
        except BaseException:
            if db.in_transaction:
                db.execute("ROLLBACK")
            raise
        finally:
            db.close()
            self._clear()
        if self.key:
            os.makedirs(self.staging)
            with open(f"{self.staging}/updated", "w") as f:
                f.write(str(done))

    def _take(self, db: sqlite3.Connection, parts: list[str]) -> int:
        table, into = _quoted(self.table), "temp.fresh" if self.key else _quoted(self.table)
        db.execute("BEGIN IMMEDIATE")
        if self.key:
            db.execute(f"CREATE TEMP TABLE fresh ({self.columns}, PRIMARY KEY ({_quoted(self.key)}))")
        else:
            db.execute(f"DROP TABLE IF EXISTS {table}")
            db.execute(f"CREATE TABLE {table} ({self.columns})")
        for path in parts:
            part = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            db.executemany(f"INSERT OR REPLACE INTO {into} VALUES ({', '.join('?' * len(self.names))})", part.execute("SELECT * FROM part"))
            part.close()
        done = 0
        if self.key:
            present = {c[1] for c in db.execute(f"PRAGMA table_info({table})")}
            values = [c for c in self.names if c != self.key]
            for c in values:
                if c not in present:
                    db.execute(f"ALTER TABLE {table} ADD COLUMN {_quoted(c)} REAL")
            sets = ", ".join(f"{_quoted(c)} = f.{_quoted(c)}" for c in values)
            done = db.execute(f"UPDATE {table} SET {sets} FROM temp.fresh AS f WHERE f.{_quoted(self.key)} = {table}.{_quoted(self.key)}").rowcount
        db.execute("COMMIT")
        return done

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove the parts. The folder is moved first: a task that outlives the job could add a part while it is emptied."""
        gone = f"{self.staging}.gone"
        try:
            os.rename(self.staging, gone)
        except FileNotFoundError:
            return
        shutil.rmtree(gone, ignore_errors=True)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").option("table", ...).load(path)``, and ``df.write.format("sqlite_table")`` with the
    same option: mode ``overwrite`` makes the table, mode ``append`` with option ``key`` updates it (``SqliteWriter``). The
    file's folder must be one that every executor can reach."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            info = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return ", ".join(f"`{name}` {_TYPES.get(kind.upper().split('(')[0], 'string')}" for _, name, kind, *_ in info)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options, schema, overwrite)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("table", table).option("partitions", partitions).load(path)


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """``df`` as a table of the file, in place of one of that name."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite_table").option("table", table).mode("overwrite").save(path)


def update_sqlite(features: DataFrame, path: str, table: str, id_col: str, columns: tuple[str, ...], from_col: str | None = None) -> int:
    """Set ``columns`` of the rows with the features' ids, adding those that the table lacks; returns the rows set. ``from_col``:
    the features' name of the id. All rows are set in one transaction or none; a second run overwrites the same values."""
    features.sparkSession.dataSource.register(SqliteSource)
    staging = f"{path}.parts-{uuid4().hex}"
    named = features.withColumnRenamed(from_col or id_col, id_col).select(id_col, *columns)
    named.write.format("sqlite_table").option("table", table).option("key", id_col).option("staging", staging).mode("append").save(path)
    with open(f"{staging}/updated") as f:
        done = int(f.read())
    shutil.rmtree(staging)
    return done
