"""SQLite files through Spark's Python data source interface: reads by ranges of row numbers with pushed bounds, writes in one transaction.

Bounds of columns that a select leaves (``plans.select.bounds_of``) go into SQLite's query. Spark's own filter push-down for
Python sources is not used: in this version a scan without filters takes over those of an earlier scan of the same DataFrame.
A write's tasks put their rows into files of their own beside the database; the driver's commit takes them in as one
transaction, so a job that fails leaves no row, and a task that is run again counts once. Executors must reach the file's folder.
"""

from __future__ import annotations

import datetime
import decimal
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import datasource as ds

from ..functions.types import spark_type

NAME = "lakeloom_sqlite"
#: Rows of a partition.
PART_ROWS = 200_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str, write: bool = False) -> sqlite3.Connection:
    return sqlite3.connect(path, timeout=60) if write else sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=60)


def tables(path: str) -> list[str]:
    if not os.path.exists(path):
        return []
    with connect(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def columns(path: str, table: str) -> dict[str, dict]:
    """name -> type, null, default, primary, as declared; types that say nothing go by the file's own rules for them."""
    out = {}
    with connect(path) as c:
        for _, name, kind, strict, default, key in c.execute(f"PRAGMA table_info({quoted(table)})"):
            out[name] = {"type": kind.lower() or "bytea", "null": not strict and not key, "default": default, "primary": key > 0}
    keys = [n for n, c in out.items() if c["primary"]]
    for n in keys if len(keys) > 1 else []:
        out[n]["primary"] = False
    return out


def _kind(text: str) -> T.DataType:
    try:
        return spark_type(text)
    except Exception:
        low = text.lower()
        return T.LongType() if "int" in low else T.DoubleType() if any(x in low for x in ("real", "floa", "doub")) else T.BinaryType() if "blob" in low else T.StringType()


def schema(path: str, table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _kind(c["type"]), True) for n, c in columns(path, table).items()])


def stored(v: Any) -> Any:
    """A value as SQLite keeps it."""
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return str(v) if isinstance(v, decimal.Decimal) else bytes(v) if isinstance(v, bytearray) else v


def _reading(kind: T.DataType):
    if isinstance(kind, T.IntegralType):
        return int
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float
    if isinstance(kind, T.DecimalType):
        return lambda v: decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat
    return (lambda v: v if isinstance(v, bytes) else str(v).encode()) if isinstance(kind, T.BinaryType) else str


class Range(ds.InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict, kind: T.StructType):
        self.path, self.table, self.kind, self.rows = options["path"], options["table"], kind, int(options.get("rows", PART_ROWS))
        self.where: list[str] = []
        self.values: list[Any] = []
        for column, (low, high) in json.loads(options.get("bounds", "{}")).items():
            for bound, test in ((low, ">="), (high, "<=")):
                if bound is not None:
                    self.where.append(f"{quoted(column)} {test} ?")
                    self.values.append(bound)

    def partitions(self) -> list[Range]:
        with connect(self.path) as c:
            try:
                low, high, n = c.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row numbers
                return [Range(None, None)]
        if not n:
            return [Range(0, -1)]
        parts = -(-n // self.rows)
        step = -(-(high - low + 1) // parts)
        return [Range(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def query(self, part: Range) -> tuple[str, list]:
        where = [*self.where, *(["rowid BETWEEN ? AND ?"] if part.low is not None else [])]
        text = f"SELECT {', '.join(map(quoted, self.kind.names))} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        return text, [*self.values, *([part.low, part.high] if part.low is not None else [])]

    def read(self, part: Range) -> Iterator[tuple]:
        reading = [_reading(f.dataType) for f in self.kind]
        with connect(self.path) as c:
            for row in c.execute(*self.query(part)):
                yield tuple(None if v is None else f(v) for f, v in zip(reading, row, strict=True))


class Staged(ds.WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class Writer(ds.DataSourceWriter):
    def __init__(self, options: dict, kind: T.StructType):
        self.path, self.table, self.create, self.names = options["path"], options["table"], options.get("create"), kind.names
        self.stem = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        path = f"{self.stem}-{uuid.uuid4().hex}"
        with sqlite3.connect(path) as c:
            c.execute(f"CREATE TABLE rows ({', '.join(map(quoted, self.names))})")
            c.executemany(f"INSERT INTO rows VALUES ({', '.join('?' * len(self.names))})", (tuple(map(stored, r)) for r in rows))
        c.close()
        return Staged(path)

    def commit(self, messages: list[Staged | None]) -> None:
        c = connect(self.path, write=True)
        c.isolation_level = None
        try:
            staged = [m.path for m in messages if m is not None]
            c.execute("BEGIN IMMEDIATE")
            if self.create:
                c.execute(f"DROP TABLE IF EXISTS {quoted(self.table)}")
                c.execute(self.create)
            names, marks = ", ".join(map(quoted, self.names)), ", ".join("?" * len(self.names))
            for path in staged:
                with connect(path) as s:
                    c.executemany(f"INSERT INTO {quoted(self.table)} ({names}) VALUES ({marks})", s.execute("SELECT * FROM rows"))
            c.execute("COMMIT")
        except BaseException:
            if c.in_transaction:
                c.execute("ROLLBACK")
            raise
        finally:
            c.close()
            self.clear()

    def abort(self, messages: list) -> None:
        self.clear()

    def clear(self) -> None:
        folder, stem = os.path.split(self.stem)
        for n in os.listdir(folder or "."):
            if n.startswith(stem):
                os.remove(os.path.join(folder, n))


class Source(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return schema(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def create_text(table: str, meta: dict) -> str:
    """CREATE TABLE with types as they are called here, so that they are read back as such."""
    parts = [f"{quoted(n)} {c['type']}{'' if c['null'] else ' NOT NULL'}" for n, c in meta["columns"].items()]
    for k in meta["constraints"].values():
        if k["type"] in ("primary", "unique"):
            parts.append(f"{'PRIMARY KEY' if k['type'] == 'primary' else 'UNIQUE'} ({', '.join(map(quoted, k['columns']))})")
    return f"CREATE TABLE {quoted(table)} ({', '.join(parts)})"


def known(spark: SparkSession) -> None:
    """Register the source, for this thread too: sources of Python are looked up in the thread's active session."""
    spark.dataSource.register(Source)
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def read(spark: SparkSession, path: str, table: str, rows: int = PART_ROWS, bounds: dict[str, tuple[Any, Any]] | None = None) -> DataFrame:
    """A table's rows; with ``bounds`` (column -> least, largest; numbers and texts) those within them."""
    known(spark)
    reader = spark.read.format(NAME).option("path", path).option("table", table).option("rows", rows)
    return (reader.option("bounds", json.dumps(bounds)) if bounds else reader).load()


def write(rows: DataFrame, path: str, table: str, create: str | None = None) -> None:
    """Add rows to a table, or with ``create`` put them in place of it."""
    known(rows.sparkSession)
    out = rows.write.format(NAME).option("path", path).option("table", table).mode("append")
    (out.option("create", create) if create else out).save()


def drop(path: str, table: str) -> None:
    with connect(path, write=True) as c:
        c.execute(f"DROP TABLE {quoted(table)}")
