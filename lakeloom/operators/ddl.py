"""create, alter and drop: changes of metadata records, and of rows where a column's content changes."""

from __future__ import annotations

import re
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Context, QueryError, to_column
from ..functions.types import spark_type
from ..plans.select import Compiler
from ..sources.store import COLUMN, DEFAULT, Store, StoreError, bind, definition, split_name

KINDS = {"database", "schema", "table", "column", "constraint", "index", "sequence"}
CONSTRAINTS = {"primary", "foreign", "unique", "check", "exclude"}
INDEXES = {"btree", "hash", "gist", "gin"}


def _items(x: Any) -> list[dict]:
    """One definition, a list of them, or a dict by name."""
    if isinstance(x, list):
        return [y if isinstance(y, dict) else {"name": y} for y in x]
    if isinstance(x, str):
        return [{"name": x}]
    if "name" in x or "table" in x or "on" in x:
        return [x]
    return [{"name": k, **(v if isinstance(v, dict) else {"type": v})} for k, v in x.items()]


def create(store: Store, compiler: Compiler, clause: Any, schema: str | None = None) -> None:
    """A list is applied in order, column, constraint and index items of it last."""
    parts = clause if isinstance(clause, list) else [clause]
    late = ("column", "constraint", "index")
    for part in sorted(parts, key=lambda p: next(iter(p)) in late):
        if set(part) - KINDS or not part:
            raise QueryError(f"can't create {sorted(part)}")
        for kind, given in part.items():
            for item in _items(given):
                {"database": _schema, "schema": _schema, "table": _table, "sequence": _sequence}.get(kind, _part(kind))(store, compiler, item, schema)


def _schema(store, compiler, item, schema):
    name = item["name"]
    if name in store.schemas() and not item.get("maybe"):
        raise StoreError(f"schema {name} exists")
    store.files.make(store.path(name))


def _table(store, compiler, item, schema):
    at = split_name(item["name"], item.get("schema") or schema)
    if store.exists(*at) and not (item.get("temporary") and at not in store.temporary):
        if item.get("maybe"):
            return
        raise StoreError(f"table {at[0]}.{at[1]} exists")
    if item.get("as"):
        rows = item["as"] if isinstance(item["as"], DataFrame) else compiler.run(item["as"])
        from ..functions.types import type_name

        meta = definition(at[1], {"columns": {f.name: {"type": type_name(f.dataType)} for f in rows.schema}})
        _begin(store, at, item)
        store.write(*at, meta, rows)
        return
    meta = definition(at[1], item)
    for k in meta["constraints"].values():
        if k["type"] not in CONSTRAINTS:
            raise QueryError(f"unknown constraint type: {k['type']}")
    _begin(store, at, item)
    store.write(*at, meta, store.spark.createDataFrame([], store.schema(meta)))
    for name, c in meta["columns"].items():
        if c.get("sequence"):
            store.define_sequence(at[0], f"{at[1]}__{name}__seq", {"type": "sequence", "value": None, "increment": 1})


def _begin(store: Store, at: tuple[str, str], item: dict) -> None:
    """A temporary table is one of this session's own folder from now on."""
    if item.get("temporary"):
        store.temporary.add(at)
        if (view := store.view) is not None:
            view.seen.pop(at, None)
            view.undo.append(lambda: store.temporary.discard(at))


def _sequence(store, compiler, item, schema):
    at = split_name(item["name"], schema)
    if at[1] in store.sequences(at[0]):
        if item.get("maybe"):
            return
        raise StoreError(f"sequence {at[1]} exists")
    step = item.get("increment", 1)
    first = item.get("start", item.get("min", 1))
    store.define_sequence(at[0], at[1], {"type": "sequence", "value": first - step, "increment": step, "min": item.get("min"), "max": item.get("max"), "owned_by": item.get("owned_by")})


def _part(kind):
    def run(store, compiler, item, schema):
        on = item.get("on") or item.get("table")
        if not on:
            on, _, item["name"] = item["name"].rpartition(".")
        change(store, on, {"add": [{kind: {k: v for k, v in item.items() if k not in ("on", "table")}}]}, schema)

    return run


def alter(store: Store, compiler: Compiler, clause: Any, schema: str | None = None) -> None:
    """``{table: {name, add, drop, alter, rename}}``, or ``{column|constraint|schema|sequence: …}`` with ``on`` or a dotted name.

    All changes of one table are merged into one, renames last: constraints, columns, then the table.
    """
    merged: dict[str, dict] = {}
    last = []
    for part in clause if isinstance(clause, list) else [clause]:
        for kind, given in part.items():
            if kind == "table":
                for item in _items(given):
                    into = merged.setdefault(item["name"], {"add": [], "drop": [], "alter": [], "rename": None})
                    for k in ("add", "drop", "alter"):
                        into[k] += _listed(item.get(k))
                    if isinstance(item.get("rename"), str):
                        into["rename"] = item["rename"]
                    elif item.get("rename"):
                        for sub in _listed(item["rename"]):
                            (what, names), = sub.items()
                            into["alter"] += [{what: {"name": n, "rename": to}} for n, to in names.items() if n not in ("name", "to")] or [{what: {"name": names["name"], "rename": names["to"]}}]
            elif kind in ("column", "constraint"):
                for item in _items(given):
                    on = item.get("on") or item.get("table") or item["name"].rpartition(".")[0]
                    into = merged.setdefault(on, {"add": [], "drop": [], "alter": [], "rename": None})
                    into["alter"].append({kind: {**{k: v for k, v in item.items() if k not in ("on", "table")}, "name": item["name"].rpartition(".")[2]}})
            elif kind == "schema" and given.get("rename"):
                last.append(given)
            else:
                raise QueryError(f"can't alter a {kind} this way")
    for on, c in merged.items():
        change(store, on, c, schema)
    for given in last:
        for t in store.tables(given["rename"]) if given["rename"] in store.schemas() else []:
            raise StoreError(f"schema {given['rename']} holds {t}")
        store.files.make(store.path(given["rename"]))
        for t in store.tables(given["name"]):
            store.rename((given["name"], t), (given["rename"], t))
        for name, value in store.sequences(given["name"]).items():
            store.define_sequence(given["rename"], name, value)
        store.retire(given["name"])


def _listed(x: Any) -> list[dict]:
    """add, drop and alter groups as a list of ``{kind: item}``."""
    out = []
    for part in x if isinstance(x, list) else [x] if x else []:
        for kind, given in part.items():
            out += [{kind: i} for i in (_items(given) if not isinstance(given, str) else [{"name": given}])]
    return out


def change(store: Store, on: Any, c: dict, schema: str | None = None) -> None:
    """Apply the changes ``c`` to one table: a new record, and a new snapshot only if rows change."""
    at = split_name(on, schema)
    meta = deepcopy(store.meta(*at))
    rows, old = None, store.read(*at)
    current = lambda: old if rows is None else rows
    for part in c.get("drop") or []:
        (kind, item), = part.items()
        name, group = item["name"], {"column": "columns", "constraint": "constraints", "index": "indexes"}[kind]
        if name not in meta[group]:
            if item.get("maybe"):
                continue
            raise StoreError(f"no {kind} {name} in {at[1]}")
        gone = meta[group].pop(name)
        if kind == "column":
            rows = current().drop(name)
            meta["constraints"] = {k: v for k, v in meta["constraints"].items() if name not in v["columns"]}
            meta["indexes"] = {k: v for k, v in meta["indexes"].items() if name not in v["columns"]}
        elif kind == "constraint" and len(gone["columns"]) == 1 and gone["columns"][0] in meta["columns"]:
            column = meta["columns"][gone["columns"][0]]
            column |= {"primary": {"primary": False}, "unique": {"unique": False}, "foreign": {"related": None}}.get(gone["type"], {})
    for part in c.get("add") or []:
        (kind, item), = part.items()
        name = item.get("name") or f"{at[1]}__{'_'.join(item.get('columns', []))}__{kind[:2]}"
        body = {k: v for k, v in item.items() if k != "name"}
        if kind == "column":
            if name in meta["columns"]:
                if item.get("maybe"):
                    continue
                raise StoreError(f"column {name} exists")
            column = COLUMN | body
            meta["columns"][name] = column
            value = F.lit(None) if column["default"] is None else to_column(column["default"], Context())
            rows = current().withColumn(name, value.cast(spark_type(column["type"])))
        elif kind == "constraint":
            if body.get("type") not in CONSTRAINTS:
                raise QueryError(f"unknown constraint type: {body.get('type')}")
            if name in meta["constraints"] and item.get("maybe"):
                continue
            meta["constraints"] |= definition(at[1], {"constraints": {name: body}})["constraints"]
            rows = current()
        elif kind == "index":
            if body.get("type", "btree") not in INDEXES:
                raise QueryError(f"unknown index type: {body['type']}")
            if name in meta["indexes"] and item.get("maybe"):
                continue
            meta["indexes"] |= definition(at[1], {"indexes": {name: body}})["indexes"]
            rows = current()  # its files are written anew, in the index's order
        else:
            raise QueryError(f"can't add a {kind} to a table")
    renames: list[tuple[str, str, str]] = []
    for part in c.get("alter") or []:
        (kind, item), = part.items()
        name, group = item["name"], {"column": "columns", "constraint": "constraints", "index": "indexes"}[kind]
        if name not in meta[group]:
            raise StoreError(f"no {kind} {name} in {at[1]}")
        if item.get("rename"):
            renames.append((kind, name, item["rename"]))
        column = meta[group][name]
        if kind == "column":
            if item.get("type") and item["type"] != column["type"]:
                column["type"] = item["type"]
                rows = current().withColumn(name, F.col(f"`{name}`").cast(spark_type(item["type"])))
            if "null" in item:
                column["null"] = bool(item["null"])
                rows = current() if not item["null"] else rows
            column |= {k: item[k] for k in ("default", "sequence", "choices") if k in item}
        else:
            column |= {k: bool(item[k]) for k in ("deferrable", "deferred") if k in item}
    for kind, name, to in sorted(renames, key=lambda r: ("constraint", "index", "column").index(r[0])):
        group = {"column": "columns", "constraint": "constraints", "index": "indexes"}[kind]
        if to in meta[group]:
            raise StoreError(f"{kind} {to} exists")
        meta[group] = {to if k == name else k: v for k, v in meta[group].items()}
        if kind == "column":
            rows = current().withColumnRenamed(name, to)
            for other in (*meta["constraints"].values(), *meta["indexes"].values()):
                other |= {part: [to if x == name else x for x in other[part]] for part in ("columns", "overlap") if part in other}
    meta = bind(at[1], meta)
    store.write(*at, meta, rows)
    if c.get("rename"):
        new = split_name(c["rename"], at[0])
        if store.exists(*new):
            raise StoreError(f"table {new[1]} exists")
        store.rename(at, new)


def drop(store: Store, clause: Any, schema: str | None = None) -> None:
    """``maybe`` tolerates what isn't there; ``cascade`` takes along what a schema holds or what refers to a table."""
    for part in clause if isinstance(clause, list) else [clause]:
        for kind, given in part.items():
            for item in _items(given):
                name, maybe, cascade = item["name"], item.get("maybe"), item.get("cascade")
                if kind in ("schema", "database"):
                    if name not in store.schemas():
                        if not maybe:
                            raise StoreError(f"no schema {name}")
                        continue
                    if store.tables(name) and not cascade:
                        raise StoreError(f"schema {name} is not empty")
                    for t in store.tables(name):
                        store.drop(name, t)
                    store.retire(name)
                elif kind == "table":
                    at = split_name(name, schema)
                    if not store.exists(*at):
                        if not maybe:
                            raise StoreError(f"no table {name}")
                        continue
                    for other in store.tables(at[0]):
                        keys = [k for k, v in store.meta(at[0], other)["constraints"].items() if v["type"] == "foreign" and v.get("related_name") and split_name(v["related_name"], at[0]) == at and other != at[1]]
                        if keys and not cascade:
                            raise StoreError(f"{other} refers to {name}")
                        if keys:
                            change(store, [at[0], other], {"drop": [{"constraint": {"name": k}} for k in keys]})
                    store.drop(*at)
                elif kind == "sequence":
                    at = split_name(name, schema)
                    if at[1] not in store.sequences(at[0]) and not maybe:
                        raise StoreError(f"no sequence {name}")
                    store.define_sequence(at[0], at[1], None)
                elif kind in ("column", "constraint", "index"):
                    on = item.get("on") or item.get("table")
                    if not on:
                        on, _, name = name.rpartition(".")
                    if not on and kind == "index":
                        on = next((t for t in store.tables(schema or DEFAULT) if name in store.meta(schema or DEFAULT, t)["indexes"]), None)
                        if on is None:
                            if maybe:
                                continue
                            raise StoreError(f"no index {name}")
                    change(store, on, {"drop": [{kind: {"name": name, "maybe": maybe}}]}, schema)
                else:
                    raise QueryError(f"can't drop a {kind}")


_CREATE = re.compile(r"\s*create\s+(temp(?:orary)?\s+)?table\s+(if\s+not\s+exists\s+)?([\w.\"`]+)\s*\((.*)\)\s*;?\s*", re.I | re.S)
_NAMED = re.compile(r"(?:constraint\s+([\w\"`]+)\s+)?(primary\s+key|unique|foreign\s+key|check)\s*\((.*?)\)\s*(?:references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?)?(.*)", re.I | re.S)

_EXCLUDE = re.compile(r"(?:constraint\s+([\w\"`]+)\s+)?exclude\s*(?:using\s+\w+\s*)?\((.*)\)(.*)", re.I | re.S)
_SPAN = re.compile(r"\w*range\s*\(([^,()]+),([^,()]+)\)\s*with\s*&&", re.I)


def _split(text: str) -> list[str]:
    """Parts between top-level commas; quotes and brackets hold together."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [p for p in [*out, text[at:].strip()] if p]


def parse_expression(text: str) -> Any:
    """The text of a default as a JSON expression: ``f(x)`` is a call, ``::type`` is dropped, quoted text is a literal."""
    text = re.sub(r"::[\w ]+(\(\d+\))?(\[\])?", "", text.strip())
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    if m := re.fullmatch(r"(\w[\w.]*)\s*\((.*)\)", text, re.S):
        args = [parse_expression(a) for a in _split(m[2])]
        return {m[1]: args[0] if len(args) == 1 else args}
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?\d*\.\d+", text):
        return float(text)
    low = text.lower()
    return {"null": None, "true": True, "false": False}.get(low, {low: None} if low in ("current_timestamp", "current_date") else text)


def parse_statement(text: str) -> dict:
    """The text of a CREATE TABLE statement as a JSON statement."""
    m = _CREATE.fullmatch(text)
    if not m:
        raise QueryError("not a CREATE TABLE statement")
    plain = lambda x: x.strip().strip('"`')
    table: dict[str, Any] = {"name": ".".join(map(plain, m[3].split("."))), "columns": {}, "constraints": {}, "indexes": {}}
    table |= {"temporary": True} if m[1] else {}
    table |= {"maybe": True} if m[2] else {}
    for part in _split(m[4]):
        if k := _EXCLUDE.fullmatch(part):
            body = {"type": "exclude", "columns": []}
            for element in _split(k[2]):
                if span := _SPAN.fullmatch(element.strip()):
                    body["overlap"] = [plain(span[1]), plain(span[2])]
                    body["columns"] += body["overlap"]
                elif one := re.fullmatch(r"([\w\"`]+)\s+with\s*=", element.strip(), re.I):
                    body["columns"].append(plain(one[1]))
                else:
                    raise QueryError(f"an exclusion compares columns with = and one span with &&: {element.strip()}")
            tail = k[3].lower()
            body |= {"deferrable": True} if "deferrable" in tail and "not deferrable" not in tail else {}
            body |= {"deferred": True} if "initially deferred" in tail else {}
            table["constraints"][plain(k[1]) if k[1] else f"{table['name']}__{'_'.join(body['columns'])}__exclude"] = body
            continue
        if (k := _NAMED.fullmatch(part)) and re.match(r"(constraint|primary|unique\s*\(|foreign|check)\b", part, re.I):
            kind = k[2].lower().split()[0]
            name = plain(k[1]) if k[1] else f"{table['name']}__{re.sub(r'[^0-9A-Za-z]+', '_', k[3])}__{kind}"
            body: dict[str, Any] = {"type": kind}
            if kind == "check":
                body |= {"check": {"raw": k[3]}}
            else:
                body |= {"columns": [plain(c) for c in k[3].split(",")]}
            if kind == "foreign":
                body |= {"related_name": plain(k[4]), "related_columns": [plain(c) for c in (k[5] or "id").split(",")]}
            tail = (k[6] or "").lower()
            body |= {"deferrable": True} if "deferrable" in tail and "not deferrable" not in tail else {}
            body |= {"deferred": True} if "initially deferred" in tail else {}
            table["constraints"][name] = body
            continue
        head = re.match(r"(\"[^\"]+\"|`[^`]+`|\w+)\s*(.*)", part, re.S)
        rest = head[2]
        stop = re.search(r"\b(not\s+null|null|default|primary|unique|references|check|autoincrement|constraint|collate)\b", rest, re.I)
        kind, flags = (rest[: stop.start()], rest[stop.start() :]) if stop else (rest, "")
        low = flags.lower()
        column: dict[str, Any] = {"type": kind.strip() or "text", "null": not re.search(r"not\s+null|primary\s+key", low)}
        if d := re.search(r"default\s+('(?:[^']|'')*'(?:::[\w ]+)?|\([^)]*\)|[\w.]+\s*\([^)]*\)|[^\s]+)", flags, re.I):
            column["default"] = parse_expression(d[1])
        column |= {"primary": True} if "primary key" in low else {}
        column |= {"unique": True} if re.search(r"\bunique\b", low) else {}
        column |= {"sequence": True} if "autoincrement" in low else {}
        if r := re.search(r"references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?", flags, re.I):
            column["related"] = f"{plain(r[1])}.{plain(r[2] or 'id')}"
        table["columns"][plain(head[1])] = column
    return {"create": {"table": table}}
