"""Immutable fluent queries on one table."""

from __future__ import annotations

import copy
import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from ..functions.expressions import QueryError, literal

if TYPE_CHECKING:
    from ..database import Database


class Model:
    """``db.get_model("t").where(...).sort("-id").limit(5).get()``; every step returns a new query."""

    def __init__(self, db: Database, at: tuple[str, str], state: dict | None = None):
        self.db, self.at, self.state = db, at, state or {}

    def _with(self, **more: Any) -> Model:
        return Model(self.db, self.at, {**copy.deepcopy(self.state), **more})

    # steps

    def key(self, *values: Any) -> Model:
        return self._with(key=values[0] if len(values) == 1 else list(values))

    def field(self, name: str) -> Model:
        return self._with(field=name)

    def values(self, *rows: Any, **row: Any) -> Model:
        return self._with(values=rows[0] if len(rows) == 1 and not row else [*rows, row] if rows else row)

    def take(self, *names: Any, **exprs: Any) -> Model:
        """Names, ``"*"``, ``"-name"``, or expressions by alias; a later call wins for the same alias."""
        taken = dict(self.state.get("take") or {})
        for n in names:
            taken |= n if isinstance(n, dict) else {n: True}
        return self._with(take=taken | exprs)

    def where(self, *exprs: Any, **equal: Any) -> Model:
        """Expressions, and ``name=value`` or ``name__op=value`` with plain values; all must hold."""
        found = list(self.state.get("where") or []) + list(exprs)
        for k, v in equal.items():
            name, _, op = k.partition("__")
            op = {"": "=", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}.get(op, op.replace("_", " "))
            if op in ("is null", "is not null"):
                found.append({op: name} if v else {"not": {op: name}})
            else:
                found.append({op: [name, literal(v)]} if op != "=" or v is not None else {"is null": name})
        return self._with(where=found)

    def sort(self, *names: str) -> Model:
        return self._with(sort=list(names))

    def limit(self, n: int) -> Model:
        return self._with(limit=n)

    def join(self, *joins: dict) -> Model:
        return self._with(join=list(joins))

    def method(self, name: str) -> Model:
        return self._with(method=name)

    # compilation

    def _keys(self) -> list[str]:
        from ..database import primary_keys

        return primary_keys(self.db.store.meta(*self.at))

    def _where(self) -> Any:
        parts = list(self.state.get("where") or [])
        if self.state.get("key") is not None:
            key, keys = self.state["key"], self._keys()
            values = key if isinstance(key, list) else [key]
            if len(values) != len(keys):
                raise QueryError(f"a key of {self.at[1]} has {len(keys)} values")
            parts += [{"=": [[self.at[1], k], literal(v)]} for k, v in zip(keys, values, strict=True)]
        return None if not parts else parts[0] if len(parts) == 1 else {"and": parts}

    def _data(self) -> Any:
        columns = list(self.db.store.meta(*self.at)["columns"])
        if self.state.get("field"):
            return [{self.state["field"]: [self.at[1], self.state["field"]]}]
        taken = self.state.get("take") or {}
        drop = {k[1:] for k, v in taken.items() if k.startswith("-")}
        plain = {k for k, v in taken.items() if v is True and not k.startswith("-")}
        exprs = {k: v for k, v in taken.items() if v is not True and not k.startswith("-") and v is not False}
        names = set(columns) if "*" in plain or not (plain or exprs) else plain
        out: dict[str, Any] = {n: [self.at[1], n] if n in columns else n for n in sorted(names - {"*"} - drop)}
        return [out | exprs]

    def select(self, count: bool = False) -> dict:
        """The query as JSON."""
        s = self.state
        clause: dict[str, Any] = {"data": {"count": {"count": "*"}} if count else self._data(), "from": {self.at[1]: ".".join(self.at)}}
        if s.get("join"):
            clause["join"] = s["join"]
        if (w := self._where()) is not None:
            clause["where"] = w
        if s.get("sort") and not count:
            clause["order"] = [{"by": n.lstrip("-"), "desc": n.startswith("-")} for n in s["sort"]]
        limit = 1 if s.get("key") is not None else s.get("limit")
        if limit is not None and not count:
            clause["limit"] = limit
        if count and limit is not None:
            inner = {**clause, "data": {"one": {"literal": 1}}, "limit": limit}
            clause = {"data": {"count": {"count": "*"}}, "from": {"t": {"select": inner}}}
        return {"select": clause}

    # ends

    def get(self, key: Any = None, field: str | None = None, zql: bool = False, json: bool = False) -> Any:
        """Rows; a row for a key, a column for a field, a value for both; ``json`` gives text, ``zql`` the query."""
        q = self._folded(key, field)
        if zql:
            return q.select()
        if json:
            return q._json(False)
        one, column = q.state.get("key") is not None, bool(q.state.get("field"))
        return self.db.query(q.select(), many=not one, columns=not column)

    def one(self, key: Any = None, field: str | None = None, zql: bool = False, json: bool = False) -> Any:
        q = self._folded(key, field)
        q = q if q.state.get("key") is not None else q._with(limit=1)
        if zql:
            return q.select()
        return q._json(True) if json else self.db.query(q.select(), many=False, columns=not q.state.get("field"))

    def count(self, key: Any = None, zql: bool = False) -> Any:
        q = self._folded(key, None)
        return q.select(count=True) if zql else self.db.query_one_value(q.select(count=True))

    def add(self, *rows: Any, zql: bool = False, **row: Any) -> Any:
        """Insert; the number of rows, or what ``take`` asks for."""
        values = rows[0] if len(rows) == 1 and not row else list(rows) or row or self.state.get("values")
        many = values if isinstance(values, list) else [values]
        if not many or any(set(r) != set(many[0]) for r in many):
            raise QueryError("rows to add have the same columns")
        columns = list(many[0])
        clause: dict[str, Any] = {"table": ".".join(self.at), "columns": columns, "values": [[literal(r[c]) if not isinstance(r[c], dict) else r[c] for c in columns] for r in many]}
        return self._change("insert", clause, zql, isinstance(values, dict))

    def set(self, values: Any = None, zql: bool = False, key: Any = None, **more: Any) -> Any:
        q = self._folded(key, None)
        given = values if values is not None else self.state.get("values")
        if q.state.get("field") and not isinstance(given, dict):
            given = {q.state["field"]: given}
        given = {**(given or {}), **more}
        clause: dict[str, Any] = {"table": {self.at[1]: ".".join(self.at)}, "set": {k: literal(v) if not isinstance(v, dict) else v for k, v in given.items()}}
        if (w := q._where()) is not None:
            clause["where"] = w
        return self._change("update", clause, zql, q.state.get("key") is not None)

    def delete(self, key: Any = None, zql: bool = False) -> Any:
        q = self._folded(key, None)
        clause: dict[str, Any] = {"table": {self.at[1]: ".".join(self.at)}}
        if (w := q._where()) is not None:
            clause["where"] = w
        return self._change("delete", clause, zql, q.state.get("key") is not None)

    def truncate(self, zql: bool = False) -> Any:
        q = {"truncate": ".".join(self.at)}
        return q if zql else self.db.execute(q)

    def execute(self, **options: Any) -> Any:
        return getattr(self, self.state.get("method") or "get")(**options)

    def _folded(self, key: Any, field: str | None) -> Model:
        q = self if key is None else self.key(*key) if isinstance(key, (list, tuple)) else self.key(key)
        return q if field is None else q.field(field)

    def _change(self, command: str, clause: dict, zql: bool, one: bool) -> Any:
        if self.state.get("take"):
            clause["return"] = self._data()
        if zql:
            return {command: clause}
        out = self.db._run({command: clause})
        if out.rows is None:
            return out.count
        rows = out.rows.collect()
        return (rows[0] if rows else None) if one else rows

    def _json(self, one: bool) -> str | None:
        rows = self.db.compile(self.select())
        if one:
            found = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(1).collect()
            return json.dumps(json.loads(found[0][0])) if found else None
        found = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        return json.dumps(found)
