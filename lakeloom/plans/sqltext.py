"""SQL text: table names bound to a database's own tables, and changes as text read into JSON statements.

Only what Spark's SQL doesn't do on these tables is read here, clause by clause; expressions and queries stay the text they are, for Spark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.expressions import QueryError

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\s+|[A-Za-z_]\w*|\d[\w.]*|.", re.S)
_NAME = re.compile(r"[A-Za-z_]\w*\Z|`[^`]*`\Z|\"[^\"]*\"\Z")
#: Words after which a table name comes, words that end a list of tables, and words that are no alias.
_BEFORE = {"from", "join", "into", "update", "table"}
_ENDS = {"where", "group", "order", "having", "limit", "union", "intersect", "except", "select", "set", "values", "on", "using", "window", "qualify", "returning", "offset"}
_NO_ALIAS = _ENDS | {"join", "inner", "left", "right", "full", "cross", "natural", "lateral", "semi", "anti", "outer", "tablesample", "pivot", "unpivot"}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _solid(t: str) -> bool:
    return not t.isspace() and not t.startswith(("--", "/*"))


def _plain(t: str) -> str:
    return t.strip("`\"")


def common_names(parts: list[str]) -> set[str]:
    """Names of common table expressions: a name before AS and a bracket, anywhere after WITH."""
    solid = [t for t in parts if _solid(t)]
    if not any(t.lower() == "with" for t in solid):
        return set()
    return {_plain(a).lower() for a, b, c in zip(solid, solid[1:], solid[2:], strict=False) if _NAME.match(a) and b.lower() == "as" and c == "("}


def bind_tables(text: str, resolve: Callable[[str | None, str], str | None]) -> str:
    """``text`` with table names replaced by what ``resolve(schema, table)`` gives (None: left alone); quotes and comments stay.

    A table without an alias keeps its own name as alias, so ``u.id`` and ``s.u.id`` still mean its columns.
    """
    parts = tokens(text)
    ctes, out, i = common_names(parts), [], 0
    expecting, in_list, depth, lists = False, False, 0, {}

    def following(at: int) -> int:
        while at < len(parts) and not _solid(parts[at]):
            at += 1
        return at

    while i < len(parts):
        t, low = parts[i], parts[i].lower()
        if not _solid(t):
            out.append(t)
            i += 1
            continue
        if t == "(":
            lists[depth] = in_list
            depth, in_list, expecting = depth + 1, False, False
        elif t == ")":
            depth -= 1
            in_list, expecting = lists.get(depth, False), False
        elif t == ",":
            expecting = in_list
        elif low in _BEFORE and not (out and "".join(out).rstrip().endswith(".")):
            expecting, in_list = True, low in ("from", "join")
            out.append(t)
            i += 1
            continue
        elif low in _ENDS:
            expecting = in_list = False
        elif _NAME.match(t):
            schema, name, end = None, t, i + 1
            dot = following(end)
            if dot < len(parts) and parts[dot] == "." and (nxt := following(dot + 1)) < len(parts) and _NAME.match(parts[nxt]):
                schema, name, end = t, parts[nxt], nxt + 1
            after = following(end)
            call = after < len(parts) and parts[after] == "("
            if expecting and not (schema is None and (_plain(name).lower() in ctes or call)):
                found = resolve(_plain(schema) if schema else None, _plain(name))
                if found:
                    nxt = parts[after].lower() if after < len(parts) else ""
                    bare = not (nxt == "as" or (_NAME.match(nxt) and nxt not in _NO_ALIAS))
                    out.append(found + (f" AS `{_plain(name)}`" if bare else ""))
                    i, expecting = end, False
                    continue
            elif schema is not None and after < len(parts) and parts[after] == "." and resolve(_plain(schema), _plain(name)):
                out.append(name)  # schema.table.column
                i, expecting = end, False
                continue
            expecting = False
            out.append("".join(parts[i:end]))
            i = end
            continue
        out.append(t)
        i += 1
    return "".join(out)


class Views:
    """Temporary views of the tables that a text names, gone after use."""

    def __init__(self, store):
        self.store, self.made, self.ctes = store, {}, {}
        self.outside: list[str] = []  # names that are left to Spark

    def define(self, name: str, rows) -> None:
        """A common table expression: its name means these rows, before any table's."""
        self.ctes[name.lower()] = view = f"_lk_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)

    def resolve(self, schema: str | None, table: str) -> str | None:
        from ..sources.store import DEFAULT

        if schema is None and table.lower() in self.ctes:
            return self.ctes[table.lower()]
        if schema is None:
            homes = [s for s in [DEFAULT, *self.store.schemas()] if self.store.exists(s, table)]
            homes = list(dict.fromkeys(homes))
            if not homes:
                self.outside.append(table)
                return None
            if homes[0] != DEFAULT and len(homes) > 1:
                raise QueryError(f"{table} is in several schemas: {', '.join(homes)}")
            schema = homes[0]
        elif not self.store.exists(schema, table):
            self.outside.append(f"{schema}.{table}")
            return None
        if (schema, table) not in self.made:
            name = f"_lk_{uuid.uuid4().hex}"
            self.store.read(schema, table).createOrReplaceTempView(name)
            self.made[schema, table] = name
        return self.made[schema, table]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in [*self.made.values(), *self.ctes.values()]:
            self.store.spark.catalog.dropTempView(name)


@dataclass
class Change:
    """A statement that changes something: its JSON form, the text of a query whose rows it takes, and its common table expressions."""

    clause: dict
    source: str | None = None
    ctes: list[tuple[str, str]] = field(default_factory=list)


#: Words that begin a clause of each statement, outside brackets.
_CLAUSES = {"set", "from", "using", "where", "returning"}
_COMMANDS = {"insert", "update", "delete", "create", "drop", "alter", "truncate"}


class Reader:
    """Reads a text from its first word to its last; what it doesn't expect is an error that names the place."""

    def __init__(self, text: str):
        self.text, self.at, self.parts = text, 0, []
        place = 0
        for t in tokens(text):
            if _solid(t):
                self.parts.append((t, place, place + len(t)))
            place += len(t)
        while self.parts and self.parts[-1][0] == ";":
            self.parts.pop()

    def fail(self, wanted: str) -> QueryError:
        begin = self.parts[self.at][1] if self.at < len(self.parts) else len(self.text.rstrip())
        line, column = self.text.count("\n", 0, begin) + 1, begin - (self.text.rfind("\n", 0, begin) + 1) + 1
        found = repr(self.parts[self.at][0]) if self.at < len(self.parts) else "the end"
        return QueryError(f"line {line}, column {column}: {wanted} expected, not {found}")

    def word(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.parts[at][0].lower() if at < len(self.parts) else ""

    def take(self, *words: str) -> bool:
        """Step over these words if they are next."""
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def one_of(self, *words: str) -> str:
        for w in words:
            if self.take(*w.split()):
                return w
        raise self.fail(" or ".join(w.upper() for w in words))

    def must(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words).upper())

    def name(self) -> str:
        if not _NAME.match(self.parts[self.at][0] if self.at < len(self.parts) else ""):
            raise self.fail("a name")
        self.at += 1
        return _plain(self.parts[self.at - 1][0])

    def path(self) -> str:
        out = [self.name()]
        while self.take("."):
            out.append(self.name())
        return ".".join(out)

    def names(self) -> list[str]:
        self.must("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.must(")")
        return out

    def whole(self, number: str = "a number") -> int:
        sign = -1 if self.take("-") else 1
        if not self.word().isdigit():
            raise self.fail(number)
        self.at += 1
        return sign * int(self.parts[self.at - 1][0])

    def raw(self, stops: set[str] = frozenset(), comma: bool = False, wanted: str = "an expression") -> str:
        """The text up to the end, to an unopened bracket, or to one of the words ``stops`` (or a comma) outside brackets."""
        first, depth = self.at, 0
        while self.at < len(self.parts):
            t = self.word()
            if depth == 0 and (t == ")" or (comma and t == ",") or t in stops and not (t == "from" and self.word(-1) == "distinct")):
                break
            depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
            self.at += 1
        if first == self.at:
            raise self.fail(wanted)
        return self.text[self.parts[first][1] : self.parts[self.at - 1][2]]

    def bracketed(self) -> str:
        self.must("(")
        out = self.raw()
        self.must(")")
        return out

    def maybe(self, present: bool) -> bool:
        return self.take("if", "exists") if present else self.take("if", "not", "exists")

    def end(self) -> None:
        if self.at < len(self.parts):
            raise self.fail("the end")

    # statements

    def statement(self) -> Change | None:
        ctes = self.common() if self.word() == "with" else []
        command = self.word()
        if command not in _COMMANDS or ctes and command not in ("insert", "update", "delete"):
            return None
        self.at += 1
        out = getattr(self, command)()
        self.end()
        out.ctes = ctes
        return out

    def common(self) -> list[tuple[str, str]]:
        start, out = self.at, []
        self.must("with")
        if self.take("recursive"):
            self.at = start
            return []
        while True:
            name = self.name()
            columns = self.names() if self.word() == "(" else None
            self.must("as")
            text = self.bracketed()
            out.append((name, f"SELECT * FROM ({text}) AS t({', '.join(columns)})" if columns else text))
            if not self.take(","):
                return out

    def target(self, stops: set[str]) -> Any:
        table = self.path()
        if self.take("as") or (_NAME.match(self.word() or "(") and self.word() not in stops):
            return {self.name(): table}
        return table

    def returning(self) -> dict:
        if not self.take("returning"):
            return {}
        out: list[Any] = []
        while True:
            text = self.raw({"as"}, comma=True)
            alias = self.name() if self.take("as") else None
            simple = re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*|\*", text)
            out.append({alias: text if simple else {"raw": text}} if alias else text if simple else {f"column{len(out) + 1}": {"raw": text}})
            if not self.take(","):
                return {"return": out}

    def insert(self) -> Change:
        self.must("into")
        clause: dict[str, Any] = {"table": self.target({"values", "select", "with", "default", "table", "from", "returning"})}
        if self.word() == "(" and self.word(1) not in ("select", "with", "values"):
            clause["columns"] = self.names()
        if self.take("default", "values"):
            return Change({"insert": {**clause, **self.returning()}})
        if self.word() == "values" and (rows := self.rows()):
            return Change({"insert": {**clause, "values": rows, **self.returning()}})
        source = self.raw({"returning"}, wanted="VALUES, DEFAULT VALUES or a query")
        return Change({"insert": {**clause, **self.returning()}}, source)

    def rows(self) -> list[list[Any]] | None:
        """The rows of VALUES if one of them has DEFAULT in it (Spark reads the others)."""
        begin, out, any_default = self.at, [], False
        self.must("values")
        while True:
            self.must("(")
            row: list[Any] = []
            while True:
                if self.word() == "default" and self.word(1) in (",", ")"):
                    self.at += 1
                    row.append({"default": None})
                    any_default = True
                else:
                    row.append({"raw": self.raw(comma=True)})
                if not self.take(","):
                    break
            self.must(")")
            out.append(row)
            if not self.take(","):
                break
        if any_default:
            return out
        self.at = begin
        return None

    def update(self) -> Change:
        body: dict[str, Any] = {"table": self.target({"set"})}
        self.must("set")
        sets: dict[str, Any] = {}
        while True:
            if self.word() == "(":
                columns = self.names()
                self.must("=")
                if self.take("row") or self.word(1) != "select":
                    self.must("(")
                    for i, c in enumerate(columns):
                        if i:
                            self.must(",")
                        sets[c] = self.assigned()
                    self.must(")")
                else:
                    query = self.bracketed()
                    for i, c in enumerate(columns):
                        sets[c] = {"raw": f"(SELECT s.c{i} FROM ({query}) AS s({', '.join(f'c{k}' for k in range(len(columns)))}))"}
            else:
                column = self.path().rpartition(".")[2]
                self.must("=")
                sets[column] = self.assigned()
            if not self.take(","):
                break
        body["set"] = sets
        if self.take("from"):
            body["from"] = self.sources()
        return Change({"update": {**body, **self.where(), **self.returning()}})

    def assigned(self) -> Any:
        if self.word() == "default" and (self.word(1) in ("", ",", ")") or self.word(1) in _CLAUSES):
            self.at += 1
            return {"default": None}
        return {"raw": self.raw(_CLAUSES, comma=True)}

    def sources(self) -> list[Any]:
        out = []
        while True:
            if self.word() == "(":
                query = self.bracketed()
                self.take("as")
                out.append({self.name(): {"raw": query}})
            else:
                out.append(self.target(_NO_ALIAS))
            if not self.take(","):
                return out

    def where(self) -> dict:
        return {"where": {"raw": self.raw({"returning"}, wanted="a condition")}} if self.take("where") else {}

    def delete(self) -> Change:
        self.must("from")
        body: dict[str, Any] = {"table": self.target({"where", "using", "returning"})}
        if self.take("using"):
            body["using"] = self.sources()
        return Change({"delete": {**body, **self.where(), **self.returning()}})

    def truncate(self) -> Change:
        self.take("table")
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        cascade = self.take("cascade")
        self.take("restrict")
        return Change({"truncate": [{"name": n, "cascade": cascade} for n in out]})

    def create(self) -> Change:
        from ..operators.ddl import parse_statement

        temporary = self.take("temporary") or self.take("temp")
        unique = self.take("unique")
        kind = self.one_of("index") if unique else self.one_of("table") if temporary else self.one_of("table", "schema", "database", "sequence", "index")
        maybe = self.maybe(present=False)
        if kind in ("schema", "database"):
            return Change({"create": {"schema": {"name": self.name(), "maybe": maybe}}})
        if kind == "index":
            name = "" if self.word() == "on" else self.name()
            self.must("on")
            table = self.path()
            method = self.name().lower() if self.take("using") else "btree"
            columns = self.names()
            body = {"name": name or f"{table.rpartition('.')[2]}__{'_'.join(columns)}__ix", "on": table, "type": method, "columns": columns, "unique": unique, "maybe": maybe}
            return Change({"create": {"index": body}})
        at = self.at
        name = self.path()
        if kind == "sequence":
            body = {"name": name, "maybe": maybe}
            while self.word():
                option = self.one_of("increment by", "increment", "minvalue", "maxvalue", "start with", "start", "no minvalue", "no maxvalue", "cycle", "no cycle")
                key = {"increment": "increment", "minvalue": "min", "maxvalue": "max", "start": "start"}.get(option.split()[0])
                if key:
                    body[key] = self.whole()
            return Change({"create": {"sequence": body}})
        if self.take("as"):
            return Change({"create": {"table": {"name": name, "temporary": temporary, "maybe": maybe}}}, self.raw(wanted="a query"))
        self.bracketed()
        self.end()
        made = parse_statement(f"CREATE TABLE {self.text[self.parts[at][1] : self.parts[-1][2]]}")
        made["create"]["table"] |= {"temporary": temporary, "maybe": maybe}
        return Change(made)

    def drop(self) -> Change:
        kind = self.one_of("schema", "database", "table", "sequence", "index")
        maybe = self.maybe(present=True)
        names = [self.path()]
        while self.take(","):
            names.append(self.path())
        on = {"on": self.path()} if kind == "index" and self.take("on") else {}
        cascade = self.take("cascade")
        self.take("restrict")
        return Change({"drop": [{("schema" if kind == "database" else kind): {"name": n, "maybe": maybe, "cascade": cascade, **on}} for n in names]})

    def alter(self) -> Change:
        self.must("table")
        table, steps = self.path(), {"add": [], "drop": [], "alter": []}
        body: dict[str, Any] = {"name": table}
        while True:
            self.action(table, steps, body)
            if not self.take(","):
                break
        return Change({"alter": {"table": {**body, **{k: v for k, v in steps.items() if v}}}})

    def action(self, table: str, steps: dict, body: dict) -> None:
        from ..operators.ddl import parse_expression, parse_statement

        kind = self.one_of("add", "drop", "rename", "alter")
        if kind == "add" and self.word() in ("constraint", "primary", "unique", "foreign", "check"):
            made = parse_statement(f"CREATE TABLE {table.rpartition('.')[2]} ({self.raw(comma=True)})")["create"]["table"]["constraints"]
            steps["add"] += [{"constraint": {"name": k, **v}} for k, v in made.items()]
        elif kind == "add":
            self.take("column")
            maybe = self.maybe(present=False)
            (name, column), = parse_statement(f"CREATE TABLE t ({self.raw(comma=True, wanted='a column')})")["create"]["table"]["columns"].items()
            steps["add"].append({"column": {"name": name, **column, "maybe": maybe}})
        elif kind == "drop":
            what = "constraint" if self.take("constraint") else "column"
            self.take("column")
            maybe = self.maybe(present=True)
            steps["drop"].append({what: {"name": self.name(), "maybe": maybe}})
        elif kind == "rename" and self.take("to"):
            body["rename"] = self.name()
        elif kind == "rename":
            what = "constraint" if self.take("constraint") else "column"
            self.take("column")
            name = self.name()
            self.must("to")
            steps["alter"].append({what: {"name": name, "rename": self.name()}})
        else:
            self.take("column")
            name = self.name()
            what = self.one_of("set not null", "drop not null", "set default", "drop default", "set data type", "type")
            given: dict[str, Any] = {"null": what.startswith("drop")} if what.endswith("not null") else {}
            if what.endswith("default"):
                given["default"] = parse_expression(self.raw(comma=True)) if what == "set default" else None
            elif what.endswith("type"):
                given["type"] = self.raw({"using"}, comma=True, wanted="a type")
            steps["alter"].append({"column": {"name": name, **given}})


def statement(text: str) -> Change | None:
    """A text that changes something, read; None for one that reads."""
    return Reader(text).statement()


def within(text: str, condition: str) -> str:
    """A query (or change) as text, of whose rows only those that meet ``condition`` count: joined to the outermost WHERE, in brackets."""
    r = Reader(text)
    if r.word() == "with":
        r.common()
    command = r.word()
    ends = {"returning"} if command in ("update", "delete") else {"group", "order", "having", "limit", "offset", "window", "qualify"}
    if command not in ("select", "update", "delete"):
        raise r.fail("SELECT, UPDATE or DELETE")
    depth, where, stop = 0, None, len(r.parts)
    for i in range(r.at, len(r.parts)):
        t = r.parts[i][0].lower()
        depth += (t == "(") - (t == ")")
        if depth == 0 and t in ("union", "intersect", "except"):
            r.at = i
            raise r.fail("one query")
        if depth == 0 and t == "where" and where is None:
            where = i
        elif depth == 0 and t in ends:
            stop = i
            break
    cut = r.parts[stop][1] if stop < len(r.parts) else r.parts[-1][2]
    if where is None:
        return f"{text[:cut].rstrip()} WHERE {condition} {text[cut:].lstrip() if stop < len(r.parts) else ''}".rstrip()
    old = text[r.parts[where][2] : cut].strip()
    return f"{text[: r.parts[where][1]]}WHERE ({old}) AND {condition} {text[cut:].lstrip() if stop < len(r.parts) else ''}".rstrip()
