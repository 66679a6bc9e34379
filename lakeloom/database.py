"""The engine's front: queries, models, information, differences, copies."""

from __future__ import annotations

import random
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import QueryError
from .operators import ddl, diffing, manifest, mutate, replicate, transfer
from .operators.fingerprint import SHARD_ROWS, shard_hashes
from .plans import scope as scopes
from .plans.model import Model
from .plans import sqltext, validate
from .plans.select import Compiler
from .sources.log import Conflict
from .sources.store import DEFAULT, Store, split_name

COMMANDS = ("select", "insert", "update", "delete", "truncate", "create", "alter", "drop", "show", "explain", "set")

#: Tables that a copy brings over at a time.
COPY_THREADS = 4
#: How often a statement is run anew because other writers were faster.
RETRIES = 20

FEATURES = frozenset({"schema", "table", "sequence", "constraint", "index", "transaction", "array", "json", "returning", "with", "lateral", "stream"})


class Database:
    """One root folder (or catalog, or server) of tables, seen through a scope.

    ``tag`` says under which name ("source", "target") the scope lists this database's own names. ``results`` is a folder for
    kept results; without one those of its own tables lie below the root, and those of plain files are not kept.
    """

    def __init__(self, spark: SparkSession, url: str, name: str | None = None, scope: Any = None, tag: str | None = None, alias: str | None = None, verbose: bool = False, prompt: Callable[[str], bool] | None = None, results: str | None = None):
        self.spark, self.url, self.name, self.scope, self.tag = spark, url, name or url, scope, tag
        self.alias, self.verbose, self.prompt = alias or name or url, verbose, prompt
        self.store = Store(spark, url, results)
        self.shard_rows = SHARD_ROWS

    # catalogue

    @property
    def full_version(self) -> str:
        return self.spark.version

    @property
    def version(self) -> float:
        return float(re.match(r"\d+\.\d+", self.spark.version)[0])

    def reset(self) -> None:
        self.store.reset()

    def close(self) -> None:
        """Forgets what is cached; temporary tables go."""
        self.store.files.delete(f"{self.store.root}/_sessions/{self.store.session}")
        self.store.temporary.clear()
        self.store.reset()

    def has(self, feature: str) -> bool:
        """Whether the engine has a feature: a kind of statement or object, or a function."""
        return feature in FEATURES or self.has_function(feature)

    @contextmanager
    def use(self, session: SparkSession) -> Iterator[Database]:
        """This database through another session (its temporary views and settings), for the time of a block."""
        own, self.spark, self.store.spark = self.spark, session, session
        try:
            yield self
        finally:
            self.spark = self.store.spark = own

    def has_function(self, name: str) -> bool:
        return self.spark.catalog.functionExists(name)

    def register_function(self, name: str, f: Any, returns: Any = None) -> None:
        """Make a Python or pandas function callable by name in queries."""
        self.spark.udf.register(name, f, returns) if returns is not None else self.spark.udf.register(name, f)

    def schemas(self, scope: Any = None) -> dict[str, tuple[str, Any]]:
        return scopes.translation(self.scope if scope is None else scope, "schemas", self.store.schemas(), self.tag)

    def tables(self, schema: str, scope: Any = True) -> dict[str, tuple[str, Any]]:
        return scopes.translation(scope, "tables", self.store.tables(schema), self.tag)

    def get_children(self, scope: Any = None) -> list[str]:
        return list(self.schemas(scope))

    def table(self, name: Any, schema: str | None = None) -> DataFrame:
        return self.store.read(*split_name(name, schema))

    def get_model(self, table: str, schema: str | None = None) -> Model:
        return Model(self, split_name(table, schema))

    # queries

    def compiler(self) -> Compiler:
        return Compiler(self.spark, self.table, lambda name, bounds: self.store.read_where(*split_name(name), bounds))

    def compile(self, query: Any) -> DataFrame:
        """A select (JSON, or SQL text over this database's tables) as a DataFrame."""
        return self._sql(query, None) if isinstance(query, str) else self.compiler().run(query)

    def kept(self, query: Any, params: Any = None) -> DataFrame:
        """The rows of a select, from an earlier run of the same statement (in any session) while no table it looks at has changed.

        The statement is compiled each time, as that tells the tables; only its run is spared. Statements whose rows may differ
        from run to run (chance, the clock, registered functions, names that aren't this database's) are run each time.
        """

        def run() -> DataFrame:
            outside: list[str] = []
            if isinstance(query, str):
                if sqltext.statement(query) is not None:
                    raise QueryError("only the rows of a select are kept")
                with sqltext.Views(self.store) as views:
                    rows = self._sql(query, params, views)
                    outside += views.outside
            else:
                rows = self.compiler().run(query)
                _each_raw(query, lambda raw: (outside.append(raw) if re.search(r"\bselect\b", raw, re.I) else None, raw)[1])
            return rows if outside else self.store.results.rows(["select", query, params], self.store.looked_at(), rows)

        self._asked(str(query))
        return again(self.store, run)

    def forget(self) -> None:
        """Deletes all kept results."""
        self.store.results.clear()

    def query(self, query: Any, params: Any = None, many: bool = True, columns: bool = True) -> Any:
        """Rows, one row, one column or one value; more than one row where one was asked for is an error."""
        result = self._run(query, params)
        rows = result.rows if isinstance(result, mutate.Result) else result
        if rows is None:
            return [] if many else None
        if many:
            found = rows.collect()
            return found if columns else [r[0] for r in found]
        found = rows.limit(2).collect()
        if len(found) > 1:
            raise QueryError("more than one row")
        return None if not found else found[0] if columns else found[0][0]

    def query_one_row(self, query: Any, params: Any = None) -> Row | None:
        return self.query(query, params, many=False)

    def query_one_column(self, query: Any, params: Any = None) -> list:
        return self.query(query, params, columns=False)

    def query_one_value(self, query: Any, params: Any = None) -> Any:
        return self.query(query, params, many=False, columns=False)

    def execute(self, query: Any, params: Any = None, transaction: bool = False) -> Any:
        """Run one statement or several; the last one's count of rows, or its rows."""
        if transaction:
            with self.store.transaction():
                return self.execute(query, params)
        result = self._run(query, params)
        return result.count if isinstance(result, mutate.Result) and result.rows is None else result.rows if isinstance(result, mutate.Result) else result

    def stream(self, query: Any, params: Any = None) -> Iterator[Row]:
        """Rows one by one; the driver holds one partition at a time."""
        result = self._run(query, params)
        yield from (result.rows if isinstance(result, mutate.Result) else result).toLocalIterator(prefetchPartitions=True)

    def transaction(self):
        return self.store.transaction()

    @staticmethod
    def validate(query: Any) -> list[str]:
        """What is wrong with a statement's outline, without running it."""
        return validate.problems(query)

    def _asked(self, what: str) -> None:
        if self.verbose:
            print(what)
        if self.prompt and not self.prompt(what):
            raise QueryError("stopped at the prompt")

    # rows as bytes

    def copy_from(self, output: Any, table_name: str | None = None, query: Any = None, schema_name: str | None = None, columns: list[str] | None = None, params: Any = None, close: Any = False, **options: Any) -> int:
        """Rows of a table (or of some columns of it) or of a query to ``output``, a path or a binary file object; how many.

        Options: ``format`` (text, csv), ``header``, ``delimiter``, ``null``. ``close`` closes the output, or is itself closed.
        """
        if table_name is None and query is None:
            raise QueryError("a table or a query is needed")
        self._asked(f"copy from {table_name or query}")
        options["fmt"] = options.pop("format", "text")
        if table_name is None:
            found = self._run(query, params)
            rows = found.rows if isinstance(found, mutate.Result) else found
            if rows is None:
                raise QueryError("the query has no rows to copy")
        else:
            rows = self.table(table_name, schema_name)
            rows = rows.select(*[F.col(f"`{c}`") for c in columns]) if columns else rows
        count = transfer.write_rows(rows, output, **options)
        if close:
            (close if hasattr(close, "close") else output).close()
        return count

    def copy_to(self, table_name: str, source: Any, schema_name: str | None = None, columns: list[str] | None = None, transaction: bool = False, **options: Any) -> int:
        """Rows of ``source``, a path or a binary file object, come to a table as an insert does (defaults, sequences, checks); how many."""
        if transaction:
            with self.store.transaction():
                return self.copy_to(table_name, source, schema_name, columns, **options)
        self._asked(f"copy to {table_name}")
        options["fmt"] = options.pop("format", "text")
        at = split_name(table_name, schema_name)
        meta = self.store.meta(*at)
        kinds = self.store.schema(meta)
        if unknown := set(columns or ()) - set(kinds.names):
            raise QueryError(f"no columns {sorted(unknown)} in {table_name}")
        kind = type(kinds)([kinds[c] for c in columns or kinds.names])
        held = None if isinstance(source, str) else f"{self.store.path(*at)}/_copy_{uuid.uuid4().hex}/rows"
        try:
            if held:
                transfer.spool(self.spark, source, held)
            rows = transfer.read_rows(self.spark, held or source, kind, **options)
            return again(self.store, lambda: mutate.insert(self.store, self.compiler(), {"table": ".".join(at), "columns": kind.names, "values": rows}).count)
        finally:
            if held:
                self.store.files.delete(held.rsplit("/", 1)[0])

    def _run(self, query: Any, params: Any = None) -> Any:
        if isinstance(query, list):
            out = None
            for q in query:
                out = self._run(q)
            return out
        self._asked(str(query))
        return again(self.store, lambda: self._run_one(query, params))

    def _run_one(self, query: Any, params: Any = None) -> Any:
        if isinstance(query, str):
            found = sqltext.statement(query)
            return self._sql(query, params) if found is None else self._change(query, found, params)
        if not isinstance(query, dict) or len(query) != 1 or next(iter(query)) not in COMMANDS:
            raise QueryError(f"not a statement: {query!r}")
        (command, clause), = query.items()
        c = self.compiler()
        if command == "select":
            return c.run(query)
        if command in ("insert", "update", "delete"):
            return getattr(mutate, command)(self.store, c, clause)
        if command == "truncate":
            return mutate.truncate(self.store, clause)
        if command == "create":
            ddl.create(self.store, c, clause)
        elif command == "alter":
            ddl.alter(self.store, c, clause)
        elif command == "drop":
            ddl.drop(self.store, clause)
        elif command == "explain":
            plan = c.run(clause)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        elif command == "show":
            names = self.store.schemas() if clause == "schemas" else self.store.tables(clause.get("tables", DEFAULT) if isinstance(clause, dict) else DEFAULT)
            return self.spark.createDataFrame([(n,) for n in names], "name string")
        elif command == "set":
            for k, v in clause.items():
                self.spark.conf.set(k, v)
        return mutate.Result(0)

    _MARK = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|(\$\d+)|(\$[A-Za-z_]\w*)|(%s)")

    def _marked(self, text: str, params: Any) -> tuple[str, Any]:
        """``$1``, ``$name`` and ``%s`` outside quotes as Spark's own markers, and the values in that order."""
        order: list[int] = []

        def marker(m: re.Match) -> str:
            if m[2]:
                order.append(int(m[2][1:]) - 1)
                return "?"
            return f":{m[3][1:]}" if m[3] else "?" if m[4] else m[0]

        text = self._MARK.sub(marker, text)
        if params is None or isinstance(params, dict):
            return text, params
        return text, [params[i] for i in order] if order else list(params)

    def _sql(self, text: str, params: Any, views: sqltext.Views | None = None) -> DataFrame:
        """SQL that reads this database's tables; a schema's name chooses its own table, and quoted text stays as it is."""
        if views is None:
            with sqltext.Views(self.store) as views:
                return self._sql(text, params, views)
        text, values = self._marked(text, params)
        text = sqltext.bind_tables(text, views.resolve)
        return self.spark.sql(text) if values is None else self.spark.sql(text, args=values)

    def _change(self, text: str, found: sqltext.Change, params: Any) -> mutate.Result:
        """A statement given as text that changes tables or schemas, through the same code as its JSON form."""
        if params is not None and (found.ctes or found.source is None):
            found, params = sqltext.statement(_filled({"raw": text}, params)["raw"]), None
        clause = found.clause
        with sqltext.Views(self.store) as views:
            for name, query in found.ctes:
                views.define(name, self._sql(query, None, views))
            bound = lambda x: _each_raw(x, lambda raw: sqltext.bind_tables(raw, views.resolve))
            if found.source is not None:
                rows = self._sql(found.source, params, views)
                if "insert" in clause:
                    return mutate.insert(self.store, self.compiler(), bound({**clause["insert"], "values": rows}))
                ddl.create(self.store, self.compiler(), {"table": {**clause["create"]["table"], "as": rows}})
                return mutate.Result(0)
            (command, inner), = clause.items()
            if command in ("update", "delete"):
                inner = dict(inner)
                for key in {"from", "using"} & set(inner):
                    inner[key] = [self._given(x, views) for x in inner[key]]
                return getattr(mutate, command)(self.store, self.compiler(), bound(inner))
            return self._run(bound(clause))

    def _given(self, source: Any, views: sqltext.Views) -> Any:
        """A source of a change as text: the rows of a query or common table expression, or a table's name."""
        alias, what = next(iter(source.items())) if isinstance(source, dict) else (source.rpartition(".")[2], source)
        if isinstance(what, dict):
            return {alias: self._sql(what["raw"], None, views)}
        if (view := views.ctes.get(what.lower())) is not None:
            return {alias: self.spark.table(view)}
        return {alias: what}

    # information

    def table_info(self, schema: str, table: str, scope: Any = True, data: bool = True, with_schema: bool = True, hashes: bool = False, exclude: Any = None) -> dict:
        """Rows (count, ranges, hashes), columns, constraints and indexes, all of one state of the table."""
        with self.store.statement():
            return self._table_info(schema, table, scope, data, with_schema, hashes, exclude)

    def _table_info(self, schema: str, table: str, scope: Any, data: bool, with_schema: bool, hashes: bool, exclude: Any) -> dict:
        meta = self.store.meta(schema, table)
        names = {g: scopes.translation(scope, g, list(meta[g]), self.tag) for g in ("columns", "constraints", "indexes")}
        alias = {g: {real: a for real, (a, _) in found.items()} for g, found in names.items()}
        out: dict[str, Any] = {}
        keys = primary_keys(meta)
        if data and names["columns"]:
            df = self.store.read(schema, table)
            options = scope if isinstance(scope, dict) else {}
            ranged = [k for k in dict.fromkeys([*keys, options.get("on_create"), options.get("on_update")]) if k in alias["columns"]]
            keep = lambda what, make: self.store.results.document([what, schema, table], [(schema, table)], make)
            r = keep(["range", ranged], lambda: list(df.agg(F.count("*"), *[f(F.col(f"`{k}`")) for k in ranged for f in (F.min, F.max)]).first()))
            rows: dict[str, Any] = {"count": r[0], "range": {alias["columns"][k]: {"min": r[1 + 2 * i], "max": r[2 + 2 * i]} for i, k in enumerate(ranged)}}
            if hashes:
                by = {a: real for real, a in alias["columns"].items()}
                if len(keys) == 1:
                    rows["hashes"] = keep(["md5", keys, by, self.shard_rows], lambda: {h["min_pk"]: h["md5"] for h in shard_hashes(df, keys[0], by, self.shard_rows).collect()})
                else:
                    from .operators.replicate import _prints

                    def prints() -> dict:
                        p = df.select(*by.values()).agg(*_prints(list(by.values()))).first()
                        return {None: f"{p['n']}:{p['hash']}:{p['hash_b']}"}

                    rows["hashes"] = keep(["prints", by], prints)
            out["rows"] = rows
        if with_schema:
            for g in ("columns", "constraints", "indexes"):
                rule = (exclude or {}).get(g)
                drop_names, fields, types = (rule.get("names", []), rule.get("fields", []), rule.get("types", [])) if isinstance(rule, dict) else ([], rule or [], [])
                out[g] = {}
                for real, a in alias[g].items():
                    item = meta[g][real]
                    if a in drop_names or item.get("type") in types:
                        continue
                    item = {k: v for k, v in item.items() if k not in fields}
                    if "columns" in item:
                        item["columns"] = [alias["columns"].get(c, c) for c in item["columns"]]
                    out[g][a] = item
            out["type"] = "table"
        return out

    def get_info(self, scope: Any = None, data: bool = True, schema: bool = True, hashes: bool = False, exclude: Any = None) -> dict:
        """{schema: {table: {rows, columns, constraints, indexes, type}}}, by alias."""
        out: dict[str, Any] = {}
        for real, (alias, inner) in self.schemas(scope).items():
            here = out.setdefault(alias, {})
            for t, (a, s) in self.tables(real, inner).items():
                here[a] = self.table_info(real, t, s, data, schema, hashes, exclude)
            for name, seq in self.store.sequences(real).items() if schema and data else ():
                here[name] = {"value": seq.get("value"), "type": "sequence"}
        return {k: v for k, v in out.items() if v or scope is None}

    def diff(self, target: Database, scope: Any = None, data: bool = True, schema: bool = True, info: bool = False, hashes: bool = False, exclude: Any = None) -> Any:
        """What differs from this database to ``target``; with ``info`` also both documents."""
        a = self._as("source").get_info(scope, data, schema, hashes, exclude)
        b = target._as("target").get_info(scope, data, schema, hashes, exclude)
        d = diffing.diff(_without_sequences(a), _without_sequences(b))
        return (a, b, d) if info else d

    def _as(self, tag: str) -> Database:
        if self.tag:
            return self
        out = Database(self.spark, self.url, self.name, self.scope, tag, self.alias, self.verbose, self.prompt)
        out.store, out.shard_rows = self.store, self.shard_rows
        return out

    # changes

    def merge(self, wanted: dict, scope: Any = None, exclude: Any = None, drop: bool = True) -> dict:
        """Bring the schema of what the scope includes to ``wanted`` (an info document by alias); returns what changed."""
        changes: dict[str, Any] = {}
        found = self.get_info(scope, data=False, exclude=exclude)
        if scope is None:
            scope = self.scope
        for alias, tables in wanted.items():
            real = scopes.real_name(scope, "schemas", alias, self.tag)
            inner = _child(scope, "schemas", alias)
            if real not in self.store.schemas():
                self.store.files.make(self.store.path(real))
            fresh = {}
            for a, want in tables.items():
                if want.get("type") == "sequence":
                    continue
                at = (real, scopes.real_name(inner, "tables", a, self.tag))
                below = _child(inner, "tables", a)
                names = {g: {k: scopes.real_name(below, g, k, self.tag) for k in want.get(g, {})} for g in ("columns", "constraints", "indexes")}
                for k in found.get(alias, {}).get(a, {}).get("columns", {}):
                    names["columns"].setdefault(k, scopes.real_name(below, "columns", k, self.tag))
                if not self.store.exists(*at):
                    replicate.create_table(self.store, at, _completed(want), names["columns"])
                    fresh[a] = want
                elif c := replicate.merge_table(self.store, at, want, found[alias][a], names):
                    changes.setdefault(alias, {})[a] = c
            gone = {a: v for a, v in found.get(alias, {}).items() if a not in tables and v.get("type") != "sequence"}
            for a in gone if drop else ():
                self.store.drop(real, scopes.real_name(inner, "tables", a, self.tag))
            if fresh and alias not in found:
                changes.setdefault(diffing.INSERT, {})[alias] = fresh
            elif fresh:
                changes.setdefault(alias, {})[diffing.INSERT] = fresh
            if gone and drop:
                changes.setdefault(alias, {})[diffing.DELETE] = gone
        self.reset()
        return changes

    def apply(self, schema: dict, scope: Any = None) -> dict:
        """Bring the schema to a definition document {schema: {table: {columns, constraints, indexes}}}."""
        from .sources.store import definition

        wanted = {s: {t: definition(t, d) for t, d in tables.items()} for s, tables in schema.items()}
        return self.merge(wanted, {"schemas": {s: True for s in schema}} if scope is None else scope)

    def copy(self, target: Database, scope: Any = None, check_all: bool = True, final_diff: bool = True, exclude: Any = None) -> dict:
        """Replicate the scope to ``target``: schema first, then the shards that differ; returns what was done.

        ``check_all`` compares every table's shards; without it only tables whose counts or ranges differ.
        """
        a, b = self._as("source"), target._as("target")
        mine = a.get_info(scope, data=False, exclude=exclude)
        mine = {s: {t: v for t, v in ts.items() if v.get("type") != "sequence"} for s, ts in mine.items()}
        schema_changes = b.merge(mine, scope, exclude)
        data: dict[str, Any] = {}
        differing = None if check_all else self.diff(target, scope, schema=False)
        sc = scope if scope is not None else self.scope
        jobs = []
        for alias, tables in mine.items():
            inner = _child(sc, "schemas", alias)
            s_name, t_name = (scopes.real_name(sc, "schemas", alias, d.tag) for d in (a, b))
            for t in tables:
                if differing is not None and not (isinstance(differing, list) or _touched(differing, alias, t)):
                    continue
                below = _child(inner, "tables", t)
                src = (s_name, scopes.real_name(inner, "tables", t, a.tag))
                dst = (t_name, scopes.real_name(inner, "tables", t, b.tag))
                cols = {c: (scopes.real_name(below, "columns", c, a.tag), scopes.real_name(below, "columns", c, b.tag)) for c in tables[t]["columns"]}
                jobs.append((src, dst, cols))

        def one(job: tuple) -> dict:
            src, dst, cols = job
            meta = b.store.meta(*dst)
            kinds = b.store.schema(meta)
            keys = primary_keys(meta)
            key = keys[0] if len(keys) == 1 and any(c.get("primary") for c in meta["columns"].values()) else None
            shard_rows = min(a.shard_rows, b.shard_rows)
            left = {y: F.col(f"`{x}`").cast(kinds[y].dataType) for x, y in cols.values()}
            done = None
            if b.store.record(*dst) is not None and set(left) == set(kinds.names):
                done = manifest.copy_files(manifest.Side(a.store, src, left, key), manifest.Side(b.store, dst, {y: F.col(f"`{y}`").cast(kinds[y].dataType) for y in left}, key), shard_rows)
            if done is None:  # null keys, or columns of the target's own
                mine = a.store.read(*src).select(*[c.alias(y) for y, c in left.items()])
                rows, *done = replicate.copy_rows(mine, b.store.read(*dst), key, shard_rows, lambda df: b.store.stage(*dst, df))
                if rows is not None:
                    b.store.write(*dst, meta, rows, check=False)
            return {"copied": done[0], "skipped": done[1]}

        with ThreadPoolExecutor(COPY_THREADS) as pool:  # the stages of several tables fill the cluster together
            for (_, dst, _), done in zip(jobs, pool.map(lambda job: again(b.store, lambda: one(job)), jobs), strict=True):
                data.setdefault(dst[0], {})[dst[1]] = done
        target.reset()
        return {"schema_changes": schema_changes, "data_changes": data, "final_diff": self.diff(target, scope, exclude=exclude) if final_diff else False}

    def create_schema(self, name: str, maybe: bool = False) -> None:
        self._run({"create": {"schema": {"name": name, "maybe": maybe}}})

    create_database = create_schema

    def create_table(self, name: str, table: dict, schema: str | None = None, temporary: bool = False, maybe: bool = False) -> None:
        self._run({"create": {"table": {**table, "name": f"{schema or DEFAULT}.{name}", "temporary": temporary, "maybe": maybe}}})

    def _create_part(self, kind: str, table: str, name: str, given: dict, schema: str | None) -> None:
        self._run({"create": {kind: {**given, "name": name, "on": f"{schema or DEFAULT}.{table}"}}})

    def create_column(self, table: str, name: str, column: dict, schema: str | None = None) -> None:
        self._create_part("column", table, name, column, schema)

    def create_constraint(self, table: str, name: str, constraint: dict, schema: str | None = None) -> None:
        self._create_part("constraint", table, name, constraint, schema)

    def create_index(self, table: str, name: str, index: dict, schema: str | None = None) -> None:
        self._create_part("index", table, name, index, schema)

    def drop_schema(self, name: str, maybe: bool = False, cascade: bool = False) -> None:
        self._run({"drop": {"schema": {"name": name, "maybe": maybe, "cascade": cascade}}})

    drop_database = drop_schema

    def drop_table(self, name: str, schema: str | None = None, maybe: bool = False, cascade: bool = False) -> None:
        self._run({"drop": {"table": {"name": f"{schema or DEFAULT}.{name}", "maybe": maybe, "cascade": cascade}}})

    def _drop_part(self, kind: str, table: str, name: str, schema: str | None, maybe: bool = False) -> None:
        self._run({"drop": {kind: {"name": name, "on": f"{schema or DEFAULT}.{table}", "maybe": maybe}}})

    def drop_column(self, table: str, name: str, schema: str | None = None) -> None:
        self._drop_part("column", table, name, schema)

    def drop_constraint(self, table: str, name: str, schema: str | None = None) -> None:
        self._drop_part("constraint", table, name, schema)

    def drop_index(self, table: str, name: str, schema: str | None = None) -> None:
        self._drop_part("index", table, name, schema)

    def alter_column(self, table: str, name: str, patch: dict, schema: str | None = None) -> None:
        self._run({"alter": {"column": {**patch, "name": name, "on": f"{schema or DEFAULT}.{table}"}}})


def again(store: Store, run: Callable[[], Any]) -> Any:
    """``run`` as one statement of ``store``, on the new state whenever another writer was faster; inside one, or a transaction, once."""
    if store.view is not None:
        return run()
    for left in range(RETRIES, -1, -1):
        try:
            with store.statement():
                return run()
        except Conflict:
            if not left:
                raise
            time.sleep(random.random() * 0.1 * (RETRIES + 1 - left))


def primary_keys(meta: dict) -> list[str]:
    """The single primary key, or else all columns."""
    found = [k for k, c in meta["columns"].items() if c.get("primary")]
    return found if len(found) == 1 else list(meta["columns"])


def _child(scope: Any, kind: str, alias: str) -> Any:
    entries = scopes._entries(scope, kind)
    if entries is None:
        return True
    value = entries.get(alias, entries.get("*", True))
    return value if isinstance(value, dict) else True


def _completed(want: dict) -> dict:
    from .sources.store import COLUMN

    return {**want, "columns": {k: COLUMN | v for k, v in want.get("columns", {}).items()}}


def _touched(d: dict, schema: str, table: str) -> bool:
    for part in (d, d.get(diffing.INSERT, {}), d.get(diffing.DELETE, {})):
        t = part.get(schema) if isinstance(part, dict) else None
        if isinstance(t, list):
            return True
        if isinstance(t, dict) and any(table in x for x in (t, t.get(diffing.INSERT, {}), t.get(diffing.DELETE, {}))):
            return True
    return False


def _without_sequences(info: dict) -> dict:
    return {s: {t: v for t, v in ts.items() if v.get("type") != "sequence"} for s, ts in info.items()}


def _each_raw(x: Any, f: Callable[[str], str]) -> Any:
    if isinstance(x, dict):
        return {k: f(v) if k == "raw" and isinstance(v, str) else _each_raw(v, f) for k, v in x.items()}
    return [_each_raw(v, f) for v in x] if isinstance(x, list) else x


def _filled(clause: dict, params: Any) -> dict:
    """Values in place of ``$1``, ``$name`` and ``%s`` in the texts of a change, as SQL literals."""
    given = iter(params) if not isinstance(params, dict) else None

    def literal(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool) or isinstance(v, (int, float)):
            return str(v)
        kind = {"datetime": "TIMESTAMP ", "date": "DATE "}.get(type(v).__name__, "")
        return kind + "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def fill(text: str) -> str:
        def marker(m: re.Match) -> str:
            if m[2]:
                return literal(params[int(m[2][1:]) - 1])
            return literal(params[m[3][1:]]) if m[3] else literal(next(given)) if m[4] else m[0]

        return Database._MARK.sub(marker, text)

    return _each_raw(clause, fill)
