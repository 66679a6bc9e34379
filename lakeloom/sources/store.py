"""Tables as immutable Parquet snapshots with a log of metadata records.

``root/schema/table/_log/<number>.json`` names the parts of a snapshot (folders with a name of their own, or single files
of them) and holds columns, constraints and indexes; the highest number in force is the table. A change writes a new part,
with the new rows (an insert) or with the rows of the files it touches (an update, a delete), and then puts the next record
in one step (``log.py``), so readers see either state and a lost executor costs nothing but a rerun.

A statement, or a transaction, sees each table as it was at its first look. At its end an insert goes on top of
whatever others have committed meanwhile; a change of files holds if those files are still there; anything else, and a
foreign key's other table having changed, is a ``Conflict``: the statement is run again on the new state, a transaction fails as a whole.
Plain files ``root/table.parquet`` are tables of the default schema, to be read only.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type, type_name
from .files import Files
from .log import LEASE, Conflict, Log, commit_together
from . import sqlite
from .readers import FORMATS, kind_of, read_file, read_jdbc, sqlite_path
from .results import Results

DEFAULT = "main"
#: So many parts of about one size (within a factor of as much) are merged into one.
TIER = 8
#: Seconds that files of no current snapshot stay, for readers that began before.
RETAIN = 300.0
COLUMN = {"type": "text", "default": None, "null": True, "sequence": False, "primary": False, "unique": False, "related": None, "choices": None}


class StoreError(ValueError):
    """A table, schema or constraint that isn't as a statement needs it."""


def split_name(name: Any, schema: str | None = None) -> tuple[str, str]:
    parts = name if isinstance(name, (list, tuple)) else str(name).split(".")
    parts = [p.strip("\"`") for p in parts]
    return (parts[-2] if len(parts) > 1 else schema or DEFAULT), parts[-1]


def bind(table: str, meta: dict) -> dict:
    """Complete column flags and single-column constraints from each other."""
    columns, constraints = meta["columns"], meta["constraints"]
    for name, c in columns.items():
        for flag, kind, tail in (("primary", "primary", "pk"), ("unique", "unique", "uk"), ("related", "foreign", "fk")):
            if c.get(flag) and not any(k["type"] == kind and k["columns"] == [name] for k in constraints.values()):
                extra = {}
                if kind == "foreign":
                    to, _, column = str(c["related"]).rpartition(".")
                    extra = {"related_name": to, "related_columns": [column]}
                constraints[f"{table}__{name}__{tail}"] = {"type": kind, "columns": [name], "deferrable": False, "deferred": False, "check": None, **extra}
    for k in constraints.values():
        if len(k.get("columns") or []) == 1 and (c := columns.get(k["columns"][0])):
            if k["type"] == "primary":
                c["primary"], c["null"] = True, False
            elif k["type"] == "unique":
                c["unique"] = True
            elif k["type"] == "foreign" and k.get("related_name"):
                c["related"] = f"{k['related_name']}.{(k.get('related_columns') or ['id'])[0]}"
    return meta


def definition(table: str, given: dict) -> dict:
    """A table definition in full: lists become dicts by name, defaults are filled in."""
    named = lambda x, stem: {v.get("name", f"{table}__{stem}_{i}"): {k: w for k, w in v.items() if k != "name"} for i, v in enumerate(x)} if isinstance(x, list) else {k: dict(v) if isinstance(v, dict) else v for k, v in (x or {}).items()}
    columns = {k: COLUMN | (v if isinstance(v, dict) else {"type": v}) for k, v in named(given.get("columns"), "column").items()}
    constraints = {}
    for k, v in named(given.get("constraints"), "constraint").items():
        cols = v.get("columns") or []
        full = {"type": v["type"], "columns": [cols] if isinstance(cols, str) else list(cols), "deferrable": bool(v.get("deferrable")), "deferred": bool(v.get("deferred")), "check": v.get("check")}
        if v["type"] == "foreign":
            full |= {"related_name": v.get("related_name"), "related_columns": v.get("related_columns")}
        if v["type"] == "exclude" and v.get("overlap"):  # two of the columns: a span's low and high end
            full |= {"overlap": list(v["overlap"])}
            kinds = [columns[c]["type"] for c in full["overlap"] if c in columns]
            if len(full["overlap"]) != 2 or set(full["overlap"]) - set(full["columns"]) or any(spark_type(x).simpleString() == "string" for x in kinds):
                raise StoreError(f"{k}: overlap names two columns of the constraint, a span's low and high end")
        constraints[k] = full
    indexes = {}
    for k, v in named(given.get("indexes"), "index").items():
        if not v.get("primary") and not (v.get("unique") and any(c["columns"] == v.get("columns") for c in constraints.values())):
            cols = v.get("columns") or []
            indexes[k] = {"type": v.get("type", "btree"), "columns": [cols] if isinstance(cols, str) else list(cols), "unique": bool(v.get("unique")), "primary": False}
    return bind(table, {"type": "table", "columns": columns, "constraints": constraints, "indexes": indexes})


def parts_of(meta: dict | None) -> list[str]:
    return list(meta.get("parts") or []) if meta else []


def folders(parts: list[str]) -> set[str]:
    return {p.split("/")[0] for p in parts}


class _View:
    """What a statement or transaction has seen and done: records by table at first look, its own ones, and tables only read."""

    def __init__(self):
        self.seen: dict[tuple[str, str], dict | None] = {}
        self.own: dict[tuple[str, str], dict | None] = {}
        self.rested: set[tuple[str, str]] = set()
        self.undo: list[Callable[[], None]] = []
        self.fresh: list[str] = []
        self.stamps: dict[tuple[str, str], list] = {}


class Store:
    """All tables below one root, or of one catalog or server (both read only)."""

    def __init__(self, spark: SparkSession, root: str, results: str | None = None):
        self.spark, self.kind = spark, kind_of(root)
        self.root = root.removeprefix("file://") if root.startswith("file:///") else root.rstrip("/")
        self.file = sqlite_path(root) if self.kind == "sqlite" else None
        if self.file:  # what is staged on the way lies beside the file
            self.root = f"{self.file}.stages"
        self.files, self.lease = Files(spark), LEASE
        self.results = Results(self, results)
        self.plain: dict[tuple[str, str], dict] = {}
        self.logs: dict[str, Log] = {}
        self.stages: dict[tuple, list[str]] = {}
        self.temporary: set[tuple[str, str]] = set()
        self.session = uuid.uuid4().hex
        self.shared: _View | None = None
        self.local = threading.local()

    # places

    def path(self, schema: str, table: str | None = None) -> str:
        if table and (schema, table) in self.temporary:  # a session's own tables hide those of the same name
            return f"{self.root}/_sessions/{self.session}/{schema}/{table}"
        return f"{self.root}/{schema}" + (f"/{table}" if table else "")

    def schemas(self) -> list[str]:
        if self.kind == "catalog":
            return [d.name for d in self.spark.catalog.listDatabases()]
        if self.file:
            return [DEFAULT]
        names = self.files.names(self.root)
        plain = [n for n in names if n.rsplit(".", 1)[-1] in FORMATS]
        own = [n for n in names if n not in plain and not n.startswith(("_", ".")) and not (self.files.exists(f"{self.root}/{n}/_gone") and not self.tables(n))]
        return sorted({*own, *([DEFAULT] if plain else [])})

    def tables(self, schema: str = DEFAULT) -> list[str]:
        if self.kind == "catalog":
            return [t.name for t in self.spark.catalog.listTables(schema)]
        if self.file:
            return sqlite.tables(self.file) if schema == DEFAULT else []
        names = {n for n in self.files.names(self.path(schema)) if not n.startswith("_")} | {t for s, t in [*self.temporary, *(self.view.own if self.view else ())] if s == schema}
        own = [n for n in names if self.record(schema, n) is not None]
        plain = [n.rsplit(".", 1)[0] for n in self.files.names(self.root) if n.rsplit(".", 1)[-1] in FORMATS] if schema == DEFAULT else []
        return sorted({*own, *plain})

    def _plain(self, schema: str, table: str) -> str | None:
        if schema == DEFAULT:
            for f in FORMATS:
                if self.files.exists(f"{self.root}/{table}.{f}"):
                    return f"{self.root}/{table}.{f}"
        return None

    def log(self, schema: str, table: str) -> Log:
        folder = f"{self.path(schema, table)}/_log"
        if folder not in self.logs:
            self.logs[folder] = Log(self.files, self.root, folder, self.lease)
        return self.logs[folder]

    def place(self, schema: str, table: str, meta: dict | None) -> str:
        """Where a table's parts lie: below its own path, or below that under which they were written before it was renamed."""
        return f"{self.root}/{meta['home']}" if meta and meta.get("home") else self.path(schema, table)

    # views: what is seen

    @property
    def view(self) -> _View | None:
        return self.shared or getattr(self.local, "view", None)

    @contextmanager
    def statement(self):
        """All reads of a block, in this thread, see one state of each table; its change is committed as it is made."""
        if self.view is not None:
            yield self
            return
        view = self.local.view = _View()
        try:
            yield self
        except BaseException as e:
            if not getattr(e, "committed", False):
                _undo(self, view)
            raise
        finally:
            self.local.view = None

    def record(self, schema: str, table: str) -> dict | None:
        """The record in force of a table of our own (None: there is none), as this statement sees it."""
        at, view = (schema, table), self.view
        if self.kind != "files":
            return None
        if view is not None and at in view.own:
            return view.own[at]
        if view is not None and at in view.seen:
            return view.seen[at]
        found = self.log(schema, table).last()[1]
        found = None if found is not None and found.get("dropped") else found
        if view is not None:
            view.seen[at] = found
        return found

    def looked_at(self) -> list[tuple[str, str]]:
        """The tables that the statement or transaction has looked for so far."""
        return [*self.view.seen, *self.view.own] if self.view is not None else []

    def stamps(self, schema: str, table: str, path: str, now: bool = False) -> list:
        """Sizes and times of a plain table's files, at the statement's first look (or ``now``)."""
        if self.view is None or now:
            return self.files.stamps(path)
        if (schema, table) not in self.view.stamps:
            self.view.stamps[schema, table] = self.files.stamps(path)
        return self.view.stamps[schema, table]

    # reading

    def meta(self, schema: str, table: str) -> dict:
        if (found := self.record(schema, table)) is not None:
            return found
        if self.file and self.exists(schema, table):
            found = {n: COLUMN | c | {"default": None} for n, c in sqlite.columns(self.file, table).items()}
            return bind(table, {"type": "table", "columns": found, "constraints": {}, "indexes": {}, "version": None})
        if (schema, table) not in self.plain:
            df = self.read(schema, table)
            self.plain[schema, table] = {"type": "table", "columns": {f.name: COLUMN | {"type": type_name(f.dataType), "null": f.nullable} for f in df.schema}, "constraints": {}, "indexes": {}, "version": None}
        return self.plain[schema, table]

    def exists(self, schema: str, table: str) -> bool:
        if self.kind != "files":
            return table in self.tables(schema)
        return self.record(schema, table) is not None or self._plain(schema, table) is not None

    def read(self, schema: str, table: str) -> DataFrame:
        if self.kind == "catalog":
            return self.spark.table(f"`{schema}`.`{table}`")
        if self.kind == "jdbc":
            return read_jdbc(self.spark, self.root, f"{schema}.{table}")
        if self.file and self.exists(schema, table):
            return sqlite.read(self.spark, self.file, table)
        if (meta := self.record(schema, table)) is not None:
            return self._parts(schema, table, parts_of(meta), meta)
        if plain := self._plain(schema, table):
            if self.results.given:
                self.stamps(schema, table, plain)
            return read_file(self.spark, plain)
        raise StoreError(f"no table {schema}.{table}")

    @staticmethod
    def schema(meta: dict) -> T.StructType:
        return T.StructType([T.StructField(k, spark_type(c["type"]), True) for k, c in meta["columns"].items()])

    # indexes: files are sorted by range and known by it (btree), or hold Bloom filters (hash)

    def ranges(self, schema: str, table: str, meta: dict, column: str) -> DataFrame:
        """file, n, lo, hi of each file of a snapshot, for one column; a folder's lines are computed once, as its files never change."""
        parts, base = parts_of(meta), f"{self.place(schema, table, meta)}/_ranges/{uuid.uuid5(uuid.NAMESPACE_OID, column + meta['columns'][column]['type']).hex}"
        held = {}
        for f in sorted(folders(parts)):
            done = lambda f=f: next((f"{base}/{f}/{n}" for n in self.files.names(f"{base}/{f}") if self.files.exists(f"{base}/{f}/{n}/_SUCCESS")), None)
            if done() is None:
                path = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2)).alias("file")
                rows = self._parts(schema, table, [f], meta).select(path, F.col(f"`{column}`").alias("k"))
                rows.groupBy("file").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).coalesce(1).write.parquet(f"{base}/{f}/m-{uuid.uuid4().hex}")
            held[f] = done()
        lines = self.spark.read.parquet(*held.values())
        single = [p for p in parts if "/" in p]
        if not single:
            return lines
        named = self.spark.createDataFrame([(p,) for p in single], "file string")
        return lines.filter(F.substring_index("file", "/", 1).isin([p for p in parts if "/" not in p])).unionByName(lines.join(named, "file", "left_semi"))

    def between(self, schema: str, table: str, meta: dict, column: str, low: Any, high: Any) -> list[str]:
        """Names of the files that may hold values of an indexed column from ``low`` to ``high`` (None: no bound)."""
        kind = self.schema(meta)[column].dataType
        lines = self.ranges(schema, table, meta, column)
        for bound, test in ((low, lambda b: F.col("hi") >= b), (high, lambda b: F.col("lo") <= b)):
            lines = lines.filter(test(F.lit(bound).cast(kind))) if bound is not None else lines
        return sorted(r["file"] for r in lines.select("file").collect())

    def read_where(self, schema: str, table: str, bounds: dict[str, tuple[Any, Any]]) -> DataFrame:
        """As ``read``, less files that surely hold no row within the ``bounds`` of an indexed column."""
        if self.file and self.exists(schema, table):
            kinds, plain = sqlite.schema(self.file, table), (T.IntegralType, T.DoubleType, T.StringType)
            given = {c: b for c, b in bounds.items() if c in kinds.names and isinstance(kinds[c].dataType, plain) and all(x is None or (isinstance(x, str) == isinstance(kinds[c].dataType, T.StringType) and isinstance(x, (int, float, str))) for x in b)}
            return sqlite.read(self.spark, self.file, table, bounds=given)
        meta = self.record(schema, table)
        fits = lambda c: all(b is None or _alike(b, self.schema(meta)[c].dataType) for b in bounds[c])
        column = next((c for c in sorted_by(meta) if c in bounds and fits(c)), None) if meta is not None and parts_of(meta) else None
        if column is None:
            return self.read(schema, table)
        return self._parts(schema, table, self.between(schema, table, meta, column, *bounds[column]), meta)

    def _beside(self, schema: str, table: str, meta: dict, new: DataFrame) -> Callable[[list[str] | None], DataFrame]:
        """The old rows among which keys of the new ones may be found: where the key's first column is indexed, those of files in its range."""

        def rows(columns: list[str] | None) -> DataFrame:
            if columns and columns[0] in sorted_by(meta) and parts_of(meta):
                low, high = new.agg(F.min(F.col(f"`{columns[0]}`")), F.max(F.col(f"`{columns[0]}`"))).first()
                return self._parts(schema, table, self.between(schema, table, meta, columns[0], low, high) if low is not None else [], meta)
            return self._parts(schema, table, parts_of(meta), meta)

        return rows

    # writing: a new part, then the record

    def _new_part(self, schema: str, table: str, meta: dict, rows: DataFrame, sort: bool = True) -> tuple[str, DataFrame, int]:
        """``rows`` as a part of a name of its own: the name, the part read back, its bytes."""
        kind, part = self.schema(meta), f"d-{uuid.uuid4().hex}"
        path = f"{self.place(schema, table, meta)}/{part}"
        if self.view is not None:
            self.view.fresh.append(path)
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind])
        if sort and (lead := sorted_by(meta)[:1]):
            rows = rows.repartitionByRange(F.col(f"`{lead[0]}`")).sortWithinPartitions(f"`{lead[0]}`")
        options = {f"parquet.bloom.filter.enabled#{c}": "true" for i in (meta.get("indexes") or {}).values() if i["type"] == "hash" for c in i["columns"]}
        rows.write.options(**options).parquet(path)
        return part, self.spark.read.schema(kind).parquet(path), self.files.size(path)

    def _checked(self, schema: str, table: str, meta: dict, part: str, found: list[str]) -> None:
        if found:
            self.files.delete(f"{self.place(schema, table, meta)}/{part}")
            raise StoreError(f"{schema}.{table} breaks {', '.join(found)}")

    def write(self, schema: str, table: str, meta: dict, rows: DataFrame | None, check: bool = True, sort: bool = True) -> int:
        """Save ``rows`` (None: no change of rows) under ``meta``, in place of all that is there; returns the new version."""
        if self.file:
            rows = self.read(schema, table) if rows is None else rows
            kind = self.schema(meta)
            sqlite.write(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind]), self.file, table, sqlite.create_text(table, meta))
            return 0
        if self.kind != "files":
            raise StoreError("this store is read only")
        old = self.record(schema, table)
        meta = {**meta, "home": (old or {}).get("home"), "parts": parts_of(old), "sizes": (old or {}).get("sizes", {})}
        if rows is not None:
            part, new, size = self._new_part(schema, table, meta, rows, sort)
            if check:
                self._checked(schema, table, meta, part, self.violations(schema, table, meta, new, deferred=False))
            meta |= {"parts": [part], "sizes": {part: size}}

        def onto(now: dict | None) -> dict:
            if _stamp(now) != _stamp(old):
                raise Conflict(f"{schema}.{table} was changed by another writer")
            return meta

        return self._commit(schema, table, onto)

    def append(self, schema: str, table: str, meta: dict, rows: DataFrame) -> int:
        """Add ``rows``: they are one more part, and only they are checked, their keys also against the old rows'.

        Others' commits in between are no conflict unless they changed the table's definition: their new rows are checked as well.
        """
        if self.file:
            kind = self.schema(meta)
            sqlite.write(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind]), self.file, table)
            return 0
        old = self.record(schema, table)
        if self.kind != "files" or old is None:
            return self.write(schema, table, meta, self.read(schema, table).unionByName(rows))
        part, new, size = self._new_part(schema, table, old, rows)
        self._checked(schema, table, old, part, self.violations(schema, table, old, new, deferred=False, beside=self._beside(schema, table, old, new)))
        known = [set(parts_of(old))]

        def onto(now: dict | None) -> dict:
            self._same_definition(schema, table, old, now)
            if more := [p for p in parts_of(now) if p not in known[0]]:
                self._checked(schema, table, old, part, self._taken(schema, table, old, new, self._parts(schema, table, more, now)))
                known[0] |= set(more)
            return {**now, "parts": [*parts_of(now), part], "sizes": {**now.get("sizes", {}), part: size}}

        version = self._commit(schema, table, onto)
        if self.shared is None:
            self.merge_parts(schema, table)
        return version

    @staticmethod
    def _same_definition(schema: str, table: str, old: dict, now: dict | None) -> None:
        if now is None or now.get("dropped") or any(now.get(k) != old.get(k) for k in ("columns", "constraints", "home", "created")):
            raise Conflict(f"{schema}.{table} was altered by another writer")

    def _taken(self, schema: str, table: str, meta: dict, rows: DataFrame, beside: DataFrame) -> list[str]:
        """Keys of ``rows`` that rows which came in meanwhile have, too."""
        keys = {n: k for n, k in meta["constraints"].items() if k["type"] in ("primary", "unique", "exclude")}
        flags = {n: {**c, "null": True} for n, c in meta["columns"].items()}
        return self.violations(schema, table, {**meta, "columns": flags, "constraints": keys}, rows, deferred=False, beside=beside) if keys else []

    def merge_parts(self, schema: str, table: str) -> None:
        """Where ``TIER`` parts have about one size, they become one: a row is written anew once for each size, not at every change."""
        meta = self.record(schema, table) if self.view is None else self.log(schema, table).last()[1]
        if meta is None or meta.get("dropped"):
            return
        tiers: dict[int, list[str]] = {}
        for f in sorted(folders(parts_of(meta))):
            tiers.setdefault(int(math.log(max(1, meta.get("sizes", {}).get(f, 1)), TIER)), []).append(f)
        full = next((fs for _, fs in sorted(tiers.items()) if len(fs) >= TIER), None)
        if not full:
            return
        gone = [p for p in parts_of(meta) if p.split("/")[0] in set(full)]
        rows = self._parts(schema, table, gone, meta)
        size = sum(meta.get("sizes", {}).get(f, 0) for f in full)
        part, _, size = self._new_part(schema, table, meta, rows.coalesce(max(1, math.ceil(size / (128 << 20)))))

        def onto(now: dict | None) -> dict:
            self._same_definition(schema, table, meta, now)
            if not set(gone) <= set(parts_of(now)):
                raise Conflict("the parts have gone")
            left = [p for p in parts_of(now) if p not in set(gone)]
            return {**now, "parts": [*left, part], "sizes": {**{f: n for f, n in now.get("sizes", {}).items() if f in folders(left)}, part: size}}

        try:
            self._commit(schema, table, onto)
        except Conflict:  # somebody changed them: the next one merges
            self.files.delete(f"{self.place(schema, table, meta)}/{part}")

    def by_file(self, schema: str, table: str) -> bool:
        """Whether a change may rewrite single files: not where the table refers to itself, as all its rows are checked then."""
        meta = self.meta(schema, table)
        own = (split_name(k["related_name"], schema) for k in meta["constraints"].values() if k["type"] == "foreign" and k.get("related_name"))
        return self.kind == "files" and bool(parts_of(meta)) and (schema, table) not in own

    def located(self, rows: DataFrame, file: str, row: str) -> DataFrame:
        """Rows of files with the columns ``file`` and ``row``: their file and place in it, the same at every read."""
        return rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))

    def _parts(self, schema: str, table: str, parts: list[str], meta: dict | None = None) -> DataFrame:
        meta = meta or self.meta(schema, table)
        kind, base = self.schema(meta), self.place(schema, table, meta)
        return self.spark.read.schema(kind).parquet(*[f"{base}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], kind)

    def part_at(self, schema: str, table: str, files: list[str]) -> tuple[list[str], list[str], DataFrame, DataFrame]:
        """The snapshot parted at ``files`` (paths): names of these and of the other parts, and the rows of each."""
        touched = {"/".join(f.rsplit("/", 2)[-2:]) for f in files}
        meta = self.meta(schema, table)
        others = self._without(schema, table, meta, touched)
        return sorted(touched), others, self._parts(schema, table, sorted(touched), meta), self._parts(schema, table, others, meta)

    def _without(self, schema: str, table: str, meta: dict, touched: set[str]) -> list[str]:
        """The parts of a snapshot less the files ``touched``; a folder that holds some of them is named file by file."""
        hit, others = folders(list(touched)), []
        for p in parts_of(meta):
            if p not in touched:
                names = [p] if "/" in p or p not in hit else [f"{p}/{n}" for n in self.files.names(f"{self.place(schema, table, meta)}/{p}") if n.endswith(".parquet")]
                others += [n for n in names if n not in touched]
        return others

    def replace(self, schema: str, table: str, meta: dict, touched: list[str], others: list[str], rows: DataFrame, check: bool = True, sort: bool = True) -> int:
        """``rows`` take the place of the files ``touched``; ``others`` stay as they are. ``check``: hold the rows against the constraints.

        Others' commits in between are no conflict if these files are still there and the definition is the same.
        """
        old = self.record(schema, table)
        part, new, size = self._new_part(schema, table, old, rows, sort)
        if check:
            self._checked(schema, table, old, part, self.violations(schema, table, meta, new, deferred=False, beside=self._parts(schema, table, others)))
        known = [set(parts_of(old)) | set(others)]

        def onto(now: dict | None) -> dict:
            self._same_definition(schema, table, old, now)
            there = set(parts_of(now))
            if any(f not in there and f.split("/")[0] not in there for f in touched):
                raise Conflict(f"files of {schema}.{table} were changed by another writer")
            left = self._without(schema, table, now, set(touched))
            if check and (more := [p for p in left if p not in known[0] and p.split("/")[0] not in known[0]]):
                self._checked(schema, table, old, part, self._taken(schema, table, old, new, self._parts(schema, table, more, now)))
                known[0] |= set(more)
            return {**now, "parts": [*left, part], "sizes": {**{f: n for f, n in now.get("sizes", {}).items() if f in folders(left)}, part: size}}

        return self._commit(schema, table, onto)

    def _commit(self, schema: str, table: str, onto: Callable[[dict | None], dict]) -> int:
        """Make what ``onto`` says of the record in force the next one: now, or, in a transaction, at its end."""
        view, at = self.view, (schema, table)

        due: list[str] = []

        def stamped(now: dict | None) -> dict:
            old = None if now is not None and now.get("dropped") else now
            new = onto(old)
            due[:] = [p for p, since in (now or {}).get("dead", []) if time.time() - since > RETAIN]
            return _next(old, new, (now or {}).get("version") or 0)

        if self.shared is not None:
            old = self.record(*at)
            self.shared.own[at] = _next(old, onto(old), (old or {}).get("version") or 0)
            return self.shared.own[at]["version"]
        rested = [x for x in (view.rested if view else ()) if x != at]
        if rested:
            (new,) = commit_together(self.files, self.root, [(self.log(*at), stamped)], lambda change: self._unchanged(view, rested, change))
        else:
            new = self.log(*at).commit(stamped)
        if view is not None:
            view.own.pop(at, None)
            view.seen[at] = new
            view.fresh.clear()
        self._sweep(schema, table, new, due)
        return new["version"]

    def _unchanged(self, view: _View, tables: list[tuple[str, str]], change: str) -> bool:
        """Whether the tables are as the view saw them; an undecided change of somebody else's counts as one."""
        for t in tables:
            _, now, waiting = self.log(*t).last()
            if waiting is not None and waiting.get("change") != change:
                return False
            if _stamp(None if now is not None and now.get("dropped") else now) != _stamp(view.seen.get(t)):
                return False
        return True

    def _sweep(self, schema: str, table: str, meta: dict, due: list[str]) -> None:
        """Delete the parts ``due`` of a snapshot long gone, but not what the record or a recent reader still needs."""
        base, needed = self.place(schema, table, meta), {*parts_of(meta), *(p for p, _ in meta.get("dead", []))}
        for f in folders(due):
            if f not in folders(list(needed)):
                self.files.delete(f"{base}/{f}")
            elif f not in needed:
                for n in self.files.names(f"{base}/{f}"):
                    if n.endswith(".parquet") and f"{f}/{n}" not in needed:
                        self.files.delete(f"{base}/{f}/{n}")

    def stage(self, schema: str, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` written beside the table and read back, so that later uses agree; the last two of a table and thread are kept."""
        path = f"{self.path(schema, table)}/_stage_{uuid.uuid4().hex}"
        rows.write.parquet(path)
        held = self.stages.setdefault((schema, table, threading.get_ident()), [])
        held.append(path)
        while len(held) > 2:
            self.files.delete(held.pop(0))
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, schema: str, table: str) -> None:
        """The table is gone with its next record; a transaction's drop takes effect with it, and only then do the files go."""
        at, meta = (schema, table), self.record(schema, table)
        if self.file:
            sqlite.drop(self.file, table)
            return
        if meta is None:
            if self._plain(*at):
                raise StoreError(f"{schema}.{table} is a plain file, to be read only")
            return
        if at in self.temporary:
            self.files.delete(self.path(*at))
            self.temporary.discard(at)
            for found in (self.view.seen, self.view.own) if self.view else ():
                found.pop(at, None)
            self.logs.clear()
            return
        if self.shared is not None:
            self.shared.own[at] = None
            return
        self._put_drop(at, meta)

    def _put_drop(self, at: tuple[str, str], meta: dict) -> None:
        def onto(now: dict | None) -> dict:
            return {"dropped": True, "version": ((now or {}).get("version") or 0) + 1, "stamp": uuid.uuid4().hex, "change": None}

        self.log(*at).commit(onto)
        if (view := self.view) is not None:
            view.seen[at] = None
        self._clear(at, meta)

    def _clear(self, at: tuple[str, str], meta: dict) -> None:
        """Files of a dropped table; its log stays, so that a writer who comes late sees the drop."""
        for base in {self.place(*at, meta), self.path(*at)}:
            for n in self.files.names(base):
                if n.startswith("_stage_") or n in folders(parts_of(meta)) | folders([d[0] for d in meta.get("dead", [])]):
                    self.files.delete(f"{base}/{n}")

    def rename(self, at: tuple[str, str], to: tuple[str, str]) -> None:
        """A table under another name: its parts stay where they are."""
        meta = self.record(*at)
        moved = {**meta, "home": meta.get("home") or self.path(*at).removeprefix(f"{self.root}/")}
        view = self.shared
        if view is not None:
            view.own[to] = {**moved, "stamp": uuid.uuid4().hex}
            view.own[at] = None
            return

        def taken(now: dict | None) -> dict:
            if now is not None and not now.get("dropped"):
                raise StoreError(f"table {to[1]} exists")
            return {**moved, "stamp": uuid.uuid4().hex, "change": None}

        def left(now: dict | None) -> dict:
            if _stamp(now) != _stamp(meta):
                raise Conflict(f"{'.'.join(at)} was changed by another writer")
            return {"dropped": True, "version": meta["version"] + 1, "stamp": uuid.uuid4().hex, "change": None}

        commit_together(self.files, self.root, [(self.log(*to), taken), (self.log(*at), left)], lambda change: True)
        if (view := self.view) is not None:
            view.seen.pop(at, None)
            view.seen.pop(to, None)

    def retire(self, schema: str) -> None:
        """A schema without tables goes; its folder stays while a renamed table's parts lie in it."""
        homes = {m.get("home") for s in self.schemas() for t in self.tables(s) if (m := self.record(s, t))}
        if any(h and h.startswith(f"{schema}/") for h in homes) or self.shared is not None:
            self.files.make(f"{self.path(schema)}/_gone")
        else:
            self.files.delete(self.path(schema))

    def reset(self) -> None:
        """Forgets the definitions of plain files; those of our own tables are never kept longer than a statement."""
        self.plain.clear()

    def transaction(self):
        """All statements inside take effect together, also if the driver is killed half-way; after an error, none."""
        return _Transaction(self)

    # constraints

    def violations(self, schema: str, table: str, meta: dict, rows: DataFrame, deferred: bool = True, beside: DataFrame | Callable[[list[str] | None], DataFrame] | None = None) -> list[str]:
        """Names of the constraints (and not-null columns) that ``rows`` break; one job for nulls, one for each key.

        ``beside``: sound rows of the same table that the new ones come to, or what gives them for a key's columns.
        """
        near = beside if callable(beside) else lambda columns: beside
        from ..functions.expressions import Context, to_column

        out, must = [], [k for k, c in meta["columns"].items() if not c["null"]]
        checks = {n: k["check"] for n, k in meta["constraints"].items() if k["type"] == "check" and k.get("check") and (deferred or not k["deferred"])}
        ctx = Context()
        ctx.relations[table] = list(meta["columns"])
        tests = [F.count(F.when(F.col(f"`{k}`").isNull(), 1)) for k in must] + [F.count(F.when(~to_column(c, ctx), 1)) for c in checks.values()]
        if tests:
            found = rows.alias(table).agg(*[t.alias(f"c{i}") for i, t in enumerate(tests)]).first()
            out += [f"not null {k}" for k, n in zip(must, found[: len(must)], strict=True) if n] + [k for k, n in zip(checks, found[len(must) :], strict=True) if n]
        for name, k in meta["constraints"].items():
            if k.get("deferred") and not deferred or not k["columns"]:
                continue
            cols = [F.col(f"`{c}`") for c in k["columns"]]
            if k.get("overlap"):
                from ..operators import bands

                equal = [c for c in k["columns"] if c not in k["overlap"]]
                if bands.clashes(rows, equal, k["overlap"]) or beside is not None and bands.clashes(rows, equal, k["overlap"], near(equal or None)):
                    out.append(name)
            elif k["type"] in ("primary", "unique", "exclude"):  # an exclusion without operators of its own is one of equal values
                whole = rows.dropna(subset=k["columns"]) if k["type"] != "primary" else rows
                if whole.groupBy(*cols).count().filter("count > 1").limit(1).count():
                    out.append(name)
                elif beside is not None and near(k["columns"]).select(*k["columns"]).join(whole.select(*k["columns"]), k["columns"], "left_semi").limit(1).count():
                    out.append(name)
            elif k["type"] == "foreign" and k.get("related_name"):
                to = split_name(k["related_name"], schema)
                if to != (schema, table) and self.view is not None:
                    self.view.rested.add(to)
                if self.exists(*to):
                    other = rows if to == (schema, table) else self.read(*to)
                    other = other.unionByName(near(None)) if to == (schema, table) and beside is not None else other
                    theirs = k.get("related_columns") or k["columns"]
                    same = [F.col(f"a.`{a}`") == F.col(f"b.`{b}`") for a, b in zip(k["columns"], theirs, strict=True)]
                    if rows.dropna(subset=k["columns"]).alias("a").join(other.alias("b"), same, "left_anti").limit(1).count():
                        out.append(name)
        return out

    def referring(self, schema: str, table: str) -> list[tuple[tuple[str, str], str, list[str], list[str]]]:
        """(table, constraint, its columns, columns here) of each foreign key of another table to this one."""
        out = []
        for s in self.schemas() if self.kind == "files" else []:
            for t in self.tables(s):
                for name, k in self.meta(s, t)["constraints"].items():
                    if (s, t) != (schema, table) and k["type"] == "foreign" and k.get("related_name") and split_name(k["related_name"], s) == (schema, table):
                        out.append(((s, t), name, k["columns"], k.get("related_columns") or k["columns"]))
        return out

    def check_referring(self, schema: str, table: str, gone: DataFrame, staying: DataFrame, columns: set[str] | None = None) -> None:
        """An error if rows of another table refer to keys of ``gone`` that no row of ``staying`` has."""
        for other, name, theirs, here in self.referring(schema, table):
            if self.view is not None:
                self.view.rested.add(other)
            if columns is not None and not columns & set(here):
                continue
            keys = gone.select(*here).dropna().join(staying.select(*here), here, "left_anti")
            same = [F.col(f"a.`{a}`") == F.col(f"b.`{b}`") for a, b in zip(theirs, here, strict=True)]
            if self.read(*other).alias("a").join(keys.alias("b"), same, "left_semi").limit(1).count():
                raise StoreError(f"{'.'.join(other)} refers to rows that would go ({name})")

    # sequences

    def _sequence_log(self, schema: str) -> Log:
        return self.log(schema, "_sequences")

    def sequences(self, schema: str = DEFAULT) -> dict[str, dict]:
        return (self._sequence_log(schema).last()[1] or {}).get("sequences", {}) if self.kind == "files" else {}

    def change_sequences(self, schema: str, change: Callable[[dict], Any]) -> Any:
        """Let ``change`` alter the sequences' definitions and values, on whatever others made of them; what it returned."""
        out: list[Any] = []

        def onto(now: dict | None) -> dict:
            counters = {k: dict(v) for k, v in (now or {}).get("sequences", {}).items()}
            out[:] = [change(counters)]
            return {"sequences": counters, "change": None}

        self._sequence_log(schema).commit(onto)
        return out[0]

    def define_sequence(self, schema: str, name: str, value: dict | None) -> None:
        """Make, or with None drop, a sequence; a transaction that fails takes it back (numbers that were given stay given)."""
        before = self.sequences(schema).get(name)
        put = lambda v: self.change_sequences(schema, lambda c: c.pop(name, None) if v is None else c.update({name: v}))
        put(value)
        if self.shared is not None:
            self.shared.undo.append(lambda: put(before))


def _alike(bound: Any, kind: T.DataType) -> bool:
    """Whether a value and a column of this type are compared in the column's own order."""
    if isinstance(bound, str):
        return isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(kind, T.NumericType) if isinstance(bound, (int, float)) else isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def sorted_by(meta: dict | None) -> list[str]:
    """Columns by which a table's files can be chosen: the first ones of its btree indexes, in order."""
    return list(dict.fromkeys(i["columns"][0] for i in (meta or {}).get("indexes", {}).values() if i.get("type", "btree") == "btree" and i.get("columns")))


def _stamp(meta: dict | None) -> str | None:
    return None if meta is None else meta.get("stamp")


def _next(old: dict | None, new: dict, version: int) -> dict:
    """``new`` as the record that follows ``old``; parts that leave the snapshot are noted with the time."""
    gone = [[p, time.time()] for p in parts_of(old) if p not in new["parts"]]
    kept = [d for d in (old or {}).get("dead", []) if time.time() - d[1] <= RETAIN and d[0] not in new["parts"]]
    return {**new, "version": version + 1, "created": (old or {}).get("created") or uuid.uuid4().hex, "stamp": uuid.uuid4().hex, "dead": [*kept, *gone], "change": None}


def _undo(store: Store, view: _View) -> None:
    """What a failed statement or transaction has done beside its records."""
    for f in reversed(view.undo):
        f()
    for path in view.fresh:
        store.files.delete(path)


class _Transaction:
    def __init__(self, store: Store):
        self.store = store

    def __enter__(self):
        self.outer = self.store.shared is not None
        if not self.outer:
            self.store.shared = _View()
        return self.store

    def __exit__(self, kind, *rest):
        if self.outer:
            return
        store, view = self.store, self.store.shared
        store.shared = None
        try:
            if not kind:
                self._commit(store, view)
                return
        except BaseException as e:
            if not getattr(e, "committed", False):
                _undo(store, view)
            raise
        _undo(store, view)

    @staticmethod
    def _commit(store: Store, view: _View) -> None:
        def onto(at, new):
            def make(now: dict | None) -> dict:
                old = None if now is not None and now.get("dropped") else now
                if _stamp(old) != _stamp(view.seen.get(at)):
                    raise Conflict(f"{'.'.join(at)} was changed by another writer")
                if new is None:
                    return {"dropped": True, "version": ((now or {}).get("version") or 0) + 1, "stamp": uuid.uuid4().hex, "change": None}
                return {**new, "version": max(new.get("version") or 0, ((now or {}).get("version") or 0) + 1), "change": None}

            return make

        for at in view.own:
            if at not in view.seen:
                view.seen[at] = None
        changed = {at: new for at, new in view.own.items() if new is not None or view.seen.get(at) is not None}
        rested = [x for x in view.rested if x not in changed]
        if len(changed) > 1 or changed and rested:
            commit_together(store.files, store.root, [(store.log(*at), onto(at, new)) for at, new in changed.items()], lambda change: store._unchanged(view, rested, change))
        else:
            for at, new in changed.items():
                store.log(*at).commit(onto(at, new))
        moved = {n.get("home") for n in changed.values() if n}
        for at, new in changed.items():
            if new is None and store.path(*at).removeprefix(f"{store.root}/") not in moved:
                store._clear(at, view.seen[at])
