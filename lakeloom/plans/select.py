"""A select statement as a DataFrame; Catalyst plans and optimises the rest."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Context, QueryError, arguments, identifier, is_literal_text, to_column
from ..operators import bands

JOINS = {"inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right", "full": "full", "full outer": "full", "cross": "cross"}
CLAUSES = {"with", "data", "from", "join", "where", "group", "having", "union", "order", "limit", "offset"}
Tables = Callable[[str], DataFrame]


class Compiler:
    """Compiles selects against ``tables`` (name -> DataFrame); CTE names come first."""

    def __init__(self, spark: SparkSession, tables: Tables, narrowed: Callable[[str, dict], DataFrame] | None = None):
        self.spark, self.tables, self.narrowed = spark, tables, narrowed
        self.ctes: list[dict[str, DataFrame]] = []

    def run(self, query: dict, outer: Context | None = None) -> DataFrame:
        if not isinstance(query, dict) or set(query) != {"select"}:
            raise QueryError(f"not a select: {query!r}")
        clause = query["select"]
        if isinstance(clause, list):  # several selects: all rows of each
            parts = [self.run(q if isinstance(q, dict) and "select" in q else {"select": q}, outer) for q in clause]
            if not parts:
                raise QueryError("an empty list of selects")
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out
        if not isinstance(clause, dict):
            clause = {"data": clause}
        if unknown := set(clause) - CLAUSES:
            raise QueryError(f"unknown clauses: {sorted(unknown)}")
        if clause.get("data") in (None, "", [], {}):
            raise QueryError('select must have "data"')
        depth = len(self.ctes)
        try:
            self.bind(clause.get("with"), outer)
            return self._select(clause, outer)
        finally:
            del self.ctes[depth:]

    def bind(self, ctes: Any, outer: Context | None = None) -> None:
        """Common table expressions: each may use those before it."""
        for c in ctes if isinstance(ctes, list) else [ctes] if ctes else []:
            self.ctes.append({c["as"]: self.run(c["query"], outer)})

    def table(self, name: str) -> DataFrame:
        for frame in reversed(self.ctes):
            if name in frame:
                return frame[name]
        return self.tables(name)

    # sources

    def relation(self, source: Any, alias: str | None, ctx: Context) -> DataFrame:
        if isinstance(source, DataFrame):
            df = source
        elif isinstance(source, str) or (path := identifier(source)) is not None:
            name = source if isinstance(source, str) else ".".join(path)
            bounds, alias = ctx.defaults.pop("bounds", None), alias or name.split(".")[-1]
            own = self.narrowed is None or not bounds or any(name in frame for frame in self.ctes)
            df = self.table(name) if own else self.narrowed(name, bounds)
        elif isinstance(source, dict) and set(source) == {"lateral"}:
            raise QueryError("lateral follows another source")
        elif isinstance(source, dict) and set(source) == {"select"}:
            if not alias:
                raise QueryError("a derived table needs an alias")
            df = self.run(source, ctx.outer)
        elif isinstance(source, dict) and len(source) == 1:
            (name, arg), = source.items()
            alias = alias or name
            df = self.table_function(name, arguments(arg), alias, ctx)
        else:
            raise QueryError(f"not a source: {source!r}")
        if alias in ctx.relations:
            raise QueryError(f"two sources are called {alias}")
        ctx.relations[alias] = df.columns
        return df.alias(alias)

    def table_function(self, name: str, args: list, alias: str, ctx: Context) -> DataFrame:
        """A function that makes rows. A series includes its end and has one column, called like the alias."""
        if name.lower() == "generate_series" and all(isinstance(a, int) and not isinstance(a, bool) for a in args):
            step = args[2] if len(args) > 2 else 1
            return self.spark.range(args[0], args[1] + (1 if step > 0 else -1), step).toDF(alias)
        empty = Context(self.run)
        c = to_column({name: args}, empty)
        if name.lower() not in ("unnest", "generate_series", "explode"):
            c = F.explode(c)
        return self.spark.range(1).select(c.alias(alias))

    def sources(self, source: Any, ctx: Context, where: Any = None, before: DataFrame | None = None) -> DataFrame:
        """The sources side by side, and beside ``before``; a band in ``where`` joins two of them, the rest of it is the caller's to apply."""
        if source is None:
            return self.spark.range(1).select()
        items: list[tuple[str | None, Any]] = []
        for s in source if isinstance(source, list) else [source]:
            if isinstance(s, dict) and not (len(s) == 1 and "select" in s):
                items += list(s.items())
            else:
                items.append((None, s))
        out = before
        for alias, s in items:
            if isinstance(s, dict) and set(s) == {"lateral"}:
                if out is None:
                    raise QueryError("lateral follows another source")
                sub = self.run(s["lateral"], ctx)
                ctx.relations[alias] = [a or self._name(x) for a, x in self.outputs(s["lateral"]["select"]["data"], ctx)[0]]  # not analysable on its own
                out = out.lateralJoin(sub.alias(alias))
                continue
            known = set(ctx.relations)
            df = self.relation(s, alias, ctx)
            banded = bands.joined(out, df, where, ctx, set(ctx.relations) - known, whole=False) if out is not None and where is not None else None
            out = df if out is None else out.crossJoin(df) if banded is None else banded
        return out

    def join(self, df: DataFrame, joins: Any, ctx: Context) -> DataFrame:
        for j in joins if isinstance(joins, (list, tuple)) else [joins] if joins else []:
            if not isinstance(j, dict) or "to" not in j:
                raise QueryError(f"a join has to: {j!r}")
            how = JOINS.get(str(j.get("type", "inner")).lower())
            if how is None:
                raise QueryError(f"unknown join type: {j['type']}")
            if isinstance(j["to"], dict) and "select" in j["to"] and not j.get("as"):
                raise QueryError("a joined subquery needs an alias")
            to, alias = j["to"], j.get("as")
            if isinstance(to, dict) and len(to) == 1 and "select" not in to:
                (alias, to), = to.items()
            known = set(ctx.relations)
            other = self.relation(to, alias, ctx)
            if how == "cross" or (j.get("on") is None and how == "inner"):
                df = df.crossJoin(other)
                df = df.filter(to_column(j["on"], ctx)) if j.get("on") is not None else df
            elif j.get("on") is None:
                raise QueryError(f"a {how} join needs on")
            elif (banded := bands.joined(df, other, j["on"], ctx, set(ctx.relations) - known, how)) is not None:
                df = banded
            else:
                df = df.join(other, to_column(j["on"], ctx), how)
        return df

    # clauses

    def outputs(self, data: Any, ctx: Context) -> tuple[list[tuple[str | None, Any]], bool]:
        """(alias, expression) of each output, and whether equal rows become one."""
        items: list[tuple[str | None, Any]] = []
        for d in data if isinstance(data, list) else [data]:
            if isinstance(d, dict) and not (set(d) == {"distinct"} and not isinstance(data, list) and self._is_distinct(d, ctx)):
                items += list(d.items())
            else:
                items.append((None, d))
        if len(items) == 1 and isinstance(items[0][1], dict) and set(items[0][1]) == {"distinct"} and items[0][0] is None:
            return [(None, a) for a in arguments(items[0][1]["distinct"])], True
        return items, False

    @staticmethod
    def _is_distinct(d: dict, ctx: Context) -> bool:
        return isinstance(d["distinct"], (str, list))

    def _select(self, clause: dict, outer: Context | None) -> DataFrame:
        ctx = Context(self.run, outer)
        if (source := single_table(clause)) is not None and (found := bounds_of(clause.get("where"), source)):
            ctx.defaults["bounds"] = found
        items, distinct = self.outputs(clause["data"], ctx)
        if (folded := self._folded(clause, items, distinct, ctx)) is not None:
            return self._finished(folded, clause, distinct, ctx, outer)
        ctx.defaults["needed"] = bands.words(clause)
        df = self.join(self.sources(clause.get("from"), ctx, clause.get("where")), clause.get("join"), ctx)
        if clause.get("where") is not None:
            df = df.filter(to_column(clause["where"], ctx))
        named = [(a or self._name(x), x) for a, x in items]
        columns = [to_column(x, ctx).alias(a) if a else to_column(x, ctx) for a, x in named]
        if clause.get("group") is not None or clause.get("having") is not None:
            df = self._grouped(df, clause, [(a, x) for a, x in named if a], columns, ctx)
        else:
            df = df.select(*columns)
        return self._finished(df, clause, distinct, ctx, outer)

    def _folded(self, clause: dict, items: list, distinct: bool, ctx: Context) -> DataFrame | None:
        """Groups of two tables that a band joins, without their pairs; None for any other statement."""
        joins, group = self._list(clause.get("join")), self._list(clause.get("group"))
        first, named = clause.get("from"), [(a or self._name(x), x) for a, x in items]
        if len(joins) != 1 or clause.get("group") is None or clause.get("where") is not None or clause.get("having") is not None or isinstance(clause["group"], dict):
            return None
        if not isinstance(j := joins[0], dict) or JOINS.get(str(j.get("type", "inner")).lower()) != "inner" or j.get("on") is None or not isinstance(j.get("to"), str) or ctx.outer is not None:
            return None
        if not (isinstance(first, dict) and len(first) == 1 and isinstance(next(iter(first.values())), str)) or any(identifier(g) is None for g in group) or not all(a for a, _ in named):
            return None
        (alias, name), = first.items()
        own = Context(self.run)
        df, known = self.relation(name, alias, own), set(own.relations)
        other = self.relation(j["to"], j.get("as"), own)
        (right,) = set(own.relations) - known
        found = bands.folded(df, other, j["on"], own, right, group, named)
        if found is not None:
            ctx.relations |= own.relations
        return found

    def _finished(self, df: DataFrame, clause: dict, distinct: bool, ctx: Context, outer: Context | None) -> DataFrame:
        if distinct:
            df = df.distinct()
        for u in self._list(clause.get("union")):
            df = df.union(self.run(u if "select" in u else {"select": u}, outer)).distinct()
        if clause.get("order") is not None:
            df = df.orderBy(*self.order(clause["order"], df, ctx))
        if clause.get("offset"):
            df = df.offset(int(clause["offset"]))
        if clause.get("limit") is not None:
            df = df.limit(int(clause["limit"]))
        return df

    @staticmethod
    def _list(x: Any) -> list:
        return x if isinstance(x, list) else [x] if x else []

    @staticmethod
    def _name(x: Any) -> str | None:
        path = identifier(x)
        return None if path is None or path[-1] == "*" else path[-1]

    def _grouped(self, df: DataFrame, clause: dict, named: list, columns: list, ctx: Context) -> DataFrame:
        group, rollup = clause.get("group"), False
        if isinstance(group, dict):
            group, rollup = group.get("by"), bool(group.get("rollup"))
        keys = []
        for g in self._list(group):
            if isinstance(g, dict) and set(g) == {"by"}:
                g = g["by"]
            if identifier(g) is None:
                raise QueryError(f"group takes identifiers: {g!r}")
            keys.append(to_column(g, ctx))
        hidden = []
        if clause.get("having") is not None:
            ctx.outputs = {a: x for a, x in named}
            hidden = [to_column(clause["having"], ctx).alias("__having")]
            ctx.outputs = {}
        n = len(keys)
        rows = (df.rollup(*keys) if rollup else df.groupBy(*keys)).agg(*columns, *hidden)
        names = rows.columns
        rows = rows.toDF(*[f"__{i}" for i in range(len(names))])
        if hidden:
            rows = rows.filter(F.col(f"__{len(names) - 1}"))
            names = names[:-1]
        return rows.select(*[F.col(f"__{i}").alias(names[i]) for i in range(n, len(names))])

    def order(self, order: Any, df: DataFrame, ctx: Context) -> list:
        """Nulls come last going up and first going down."""
        out = []
        for o in self._list(order):
            if isinstance(o, dict) and "by" in o:
                by, down = o["by"], bool(o.get("desc")) or o.get("ascending") is False
            else:
                by, down = o, False
            for b in by if isinstance(by, list) else [by]:
                path = identifier(b)
                if path is None:
                    raise QueryError(f"order takes identifiers: {b!r}")
                c = F.col(f"`{path[-1]}`") if path[-1] in df.columns else ctx.column(path)
                out.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        return out


def literal_value(x: Any) -> Any:
    return x[1:-1] if isinstance(x, str) and is_literal_text(x) else x


def single_table(clause: dict) -> str | None:
    """The alias of the one table that a select reads."""
    source = clause.get("from")
    source = source[0] if isinstance(source, list) and len(source) == 1 else source
    if clause.get("join") or not source:
        return None
    if isinstance(source, str):
        return source.split(".")[-1]
    (alias, what), *more = source.items() if isinstance(source, dict) else ((None, None),)
    return alias if isinstance(what, str) and not more else None


def _value(x: Any) -> Any:
    """A literal's value; None for anything else."""
    if isinstance(x, dict) and set(x) == {"literal"} and not isinstance(x["literal"], (list, dict)):
        x = x["literal"]
        return None if isinstance(x, bool) else x
    if isinstance(x, str):
        return x[1:-1] if is_literal_text(x) else None
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def bounds_of(where: Any, alias: str) -> dict[str, tuple[Any, Any]]:
    """column -> (least, largest) that the conditions which all must hold leave to it; a bound itself counts as inside."""
    if not isinstance(where, dict) or len(where) != 1:
        return {}
    (name, args), = where.items()
    out: dict[str, tuple[Any, Any]] = {}
    if name.lower() == "and" and isinstance(args, list):
        for a in args:
            for c, (low, high) in bounds_of(a, alias).items():
                before = out.get(c, (None, None))
                out[c] = (low if before[0] is None else before[0], high if before[1] is None else before[1])
        return out
    if name.lower() == "between" and isinstance(args, dict) and not args.get("symmetric"):
        pairs = [(args.get("value"), _value(args.get("min")), _value(args.get("max")))]
    elif name in ("=", "<", "<=", ">", ">=") and isinstance(args, list) and len(args) == 2:
        left, right = args
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        pairs = []
        for c, v, op in ((left, _value(right), name), (right, _value(left), turned.get(name, name))):
            pairs.append((c, v if op[0] in "=>" else None, v if op[0] in "=<" else None))
    else:
        return {}
    for c, low, high in pairs:
        path = identifier(c) if not isinstance(c, (int, float)) else None
        if path and (len(path) == 1 or path[-2] == alias) and (low is not None or high is not None):
            out[path[-1]] = (low, high)
    return out
