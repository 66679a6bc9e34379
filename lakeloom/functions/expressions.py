"""JSON expressions as Spark columns.

A string is an identifier unless quoted; a quoted string, number, boolean or null is a literal; a list of strings is an
identifier path; an object with one key is an operator, a clause, a subquery or a function call.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_.]*$")


class QueryError(ValueError):
    """A query that can't be understood."""


class Context:
    """What names mean: relations by alias, the enclosing context, output aliases, and how to compile a subquery."""

    def __init__(self, subquery: Callable[[dict, Context], DataFrame] | None = None, outer: Context | None = None):
        self.subquery, self.outer = subquery, outer
        self.relations: dict[str, list[str]] = {}
        self.outputs: dict[str, Any] = {}
        self.defaults: dict[str, Any] = {}

    def knows(self, path: list[str]) -> bool:
        if len(path) == 1:
            return any(path[0] in cols for cols in self.relations.values())
        return path[-2] in self.relations

    def column(self, path: list[str]) -> Column:
        if path == ["*"]:
            return F.col("*")
        if len(path) == 1 and path[0] in self.relations and not self.knows(path) and len(self.relations[path[0]]) == 1:
            return F.col(_quoted([path[0], self.relations[path[0]][0]]))  # a table function with one column
        if not self.knows(path):
            scope = self.outer
            while scope:
                if scope.knows(path):
                    return F.col(_quoted(path[-2:])).outer()
                scope = scope.outer
        return F.col(_quoted(path[-2:]))


def _quoted(path: list[str]) -> str:
    return ".".join(p if p == "*" else f"`{p.replace('`', '``')}`" for p in path)


def is_literal_text(x: str) -> bool:
    return len(x) >= 2 and x[0] == x[-1] and x[0] in "'\"`"


def identifier(x: Any) -> list[str] | None:
    """The path that an expression names, if it is an identifier."""
    if isinstance(x, str) and not is_literal_text(x):
        return x.split(".")
    if isinstance(x, list) and x and all(isinstance(p, str) for p in x):
        return x
    if isinstance(x, dict) and set(x) == {"identifier"}:
        return x["identifier"] if isinstance(x["identifier"], list) else x["identifier"].split(".")
    return None


def _fold(f):
    return lambda *xs: reduce(f, xs)


#: Infix operators: fixed meanings by symbol.
OPERATORS: dict[str, Callable[..., Column]] = {
    "and": _fold(lambda a, b: a & b), "or": _fold(lambda a, b: a | b), "=": _fold(lambda a, b: a == b), "!=": _fold(lambda a, b: a != b),
    "<>": _fold(lambda a, b: a != b), "<": _fold(lambda a, b: a < b), "<=": _fold(lambda a, b: a <= b), ">": _fold(lambda a, b: a > b),
    ">=": _fold(lambda a, b: a >= b), "+": _fold(lambda a, b: a + b), "-": _fold(lambda a, b: a - b), "*": _fold(lambda a, b: a * b), "/": _fold(lambda a, b: a / b),
    "%": _fold(lambda a, b: a % b), "^": _fold(F.pow), "#": _fold(lambda a, b: a.bitwiseXOR(b)), "&": _fold(lambda a, b: a.bitwiseAND(b)),
    "|": _fold(lambda a, b: a.bitwiseOR(b)), "||": lambda *xs: F.concat(*[x.cast("string") for x in xs]), "is": _fold(lambda a, b: a.eqNullSafe(b)),
    "<<": _fold(lambda a, b: F.call_function("shiftleft", a, b.cast("int"))), ">>": _fold(lambda a, b: F.call_function("shiftright", a, b.cast("int"))),
    "like": lambda a, b: F.call_function("like", a, b), "ilike": lambda a, b: F.call_function("ilike", a, b),
    "~~": lambda a, b: F.call_function("like", a, b), "!~~": lambda a, b: ~F.call_function("like", a, b),
}
#: Infix operators that take ``any`` or ``all`` of an array on their right.
COMPARISONS = frozenset({"=", "!=", "<>", "<", "<=", ">", ">=", "like", "ilike", "~~", "!~~"})
#: Operators of one operand.
UNARY: dict[str, Callable[[Column], Column]] = {
    "not": lambda a: ~a, "is null": lambda a: a.isNull(), "is not null": lambda a: a.isNotNull(), "-": lambda a: -a, "+": lambda a: a,
    "~": F.bitwise_not, "@": F.abs, "|/": F.sqrt, "!": lambda a: F.factorial(a.cast("int")), "!!": lambda a: F.factorial(a.cast("int")),
}


def _object(*xs: Column) -> Column:
    if len(xs) % 2:
        raise QueryError("json_build_object needs names and values in turn")
    return F.concat(F.lit("{"), *_between([F.concat(json_text(F.coalesce(k.cast("string"), F.lit("null"))), F.lit(": "), json_text(v)) for k, v in zip(xs[::2], xs[1::2], strict=True)]), F.lit("}"))


def _between(xs: list[Column]) -> list[Column]:
    return [y for i, x in enumerate(xs) for y in ([F.lit(", "), x] if i else [x])]


def json_text(c: Column) -> Column:
    """A value as JSON text; null is null; any type."""
    j = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("null")).otherwise(j.substr(F.lit(6), F.length(j) - 6))


#: Functions whose name or meaning differs from Spark's; all others are called by name, registered ones too.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "concat": lambda *xs: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs]),
    "age": lambda a, b=None: (F.current_timestamp() - a) if b is None else a - b,
    "json_build_array": lambda *xs: F.concat(F.lit("["), *_between([json_text(x) for x in xs]), F.lit("]")),
    "json_array": lambda *xs: F.concat(F.lit("["), *_between([json_text(x) for x in xs]), F.lit("]")),
    "json_build_object": _object, "json_object": _object,
    "json_agg": lambda x: F.to_json(F.collect_list(x), {"ignoreNullFields": "false"}),
    "json_aggregate": lambda x: F.to_json(F.collect_list(x), {"ignoreNullFields": "false"}),
    "json_group_array": lambda x: F.to_json(F.collect_list(x), {"ignoreNullFields": "false"}),
    "array_to_json": lambda x: F.to_json(x, {"ignoreNullFields": "false"}), "array_agg": F.collect_list, "unnest": F.explode,
    "generate_series": lambda a, b, *step: F.explode(F.sequence(a, b, *step)), "array_length": lambda a, dim=None: F.size(a),
    "array_to_string": lambda a, sep: F.call_function("array_join", F.transform(a, lambda x: x.cast("string")), sep),
    "group_concat": lambda x, sep=None: F.listagg(x.cast("string"), F.lit(",") if sep is None else sep),
    "string_agg": lambda x, sep: F.listagg(x.cast("string"), sep), "div": lambda a, b: F.call_function("div", a, b),
    "length": F.char_length, "count_distinct": F.count_distinct, "row": lambda *xs: F.struct(*xs),
}
KEYWORDS = {"null": lambda: F.lit(None), "current_timestamp": F.current_timestamp, "current_date": F.current_date, "true": lambda: F.lit(True), "false": lambda: F.lit(False)}


def to_column(x: Any, ctx: Context) -> Column:
    """``x`` as a column; raises ``QueryError`` for what isn't an expression."""
    if x is None or isinstance(x, (bool, int, float, decimal.Decimal, datetime.date, datetime.datetime, bytes)):
        return F.lit(x)
    if isinstance(x, str):
        if is_literal_text(x):
            return F.lit(x[1:-1])
        if not x:
            raise QueryError("an empty identifier")
        if x in ctx.outputs:
            return to_column(ctx.outputs[x], _without_outputs(ctx))
        return ctx.column(x.split("."))
    if isinstance(x, list):
        path = identifier(x)
        if path is None:
            raise QueryError(f"not an identifier path: {x!r}")
        return ctx.column(path)
    if not isinstance(x, dict) or len(x) != 1:
        raise QueryError(f"an expression has one key: {x!r}")
    (key, arg), = x.items()
    name = key.lower()
    if name == "literal":
        return F.array(*[to_column({"literal": v}, ctx) for v in arg]) if isinstance(arg, list) else F.lit(arg)
    if name == "raw":
        return F.expr(arg)
    if name == "identifier":
        return ctx.column(identifier(x))
    if name == "select":
        return _subquery(x, ctx).scalar()
    if name == "case":
        return _case(arg, ctx)
    if name == "between":
        return _range(arg, ctx)
    if name in ("in", "not in"):
        c = _member(arg, ctx)
        return ~c if name == "not in" else c
    if name in ("contains", "icontains"):
        return _contains(arg, name == "icontains", ctx)
    if name in ("exists", "not exists"):
        c = _subquery(arg, ctx).exists()
        return ~c if name == "not exists" else c
    if name == "cast":
        from .types import spark_type

        return to_column(arg[0], ctx).cast(spark_type(arg[1].strip("'\"`")))
    if arg is None and name == "default":
        raise QueryError("default is only a value of insert and update")
    if arg is None and name in KEYWORDS:
        return KEYWORDS[name]()
    args = arguments(arg)
    if name in UNARY and len(args) == 1:
        return UNARY[name](to_column(args[0], ctx))
    if name in OPERATORS:
        if len(args) < 2 and name not in ("and", "or", "||"):
            raise QueryError(f"{key} needs two operands or more")
        if len(args) == 2 and isinstance(args[1], dict) and len(args[1]) == 1 and (how := next(iter(args[1])).lower()) in ("any", "some", "all") and name in COMPARISONS:
            return _quantified(name, args[0], how, next(iter(args[1].values())), ctx)
        return OPERATORS[name](*[to_column(a, ctx) for a in args])
    if name == "count" and len(args) == 1:
        if args[0] == "*":
            return F.count("*")
        if isinstance(args[0], dict) and set(args[0]) == {"distinct"}:
            return F.count_distinct(*[to_column(a, ctx) for a in arguments(args[0]["distinct"])])
    if len(args) == 1 and isinstance(args[0], dict) and set(args[0]) == {"distinct"} and name in ("sum", "avg"):
        inner = to_column(args[0]["distinct"], ctx)
        return F.sum_distinct(inner) if name == "sum" else F.aggregate(F.collect_set(inner), F.lit(0.0), lambda a, v: a + v) / F.count_distinct(inner)
    if name == "array" and len(args) == 1 and isinstance(args[0], dict) and "select" in args[0]:
        sub = _subquery(args[0], ctx)
        return sub.agg(F.collect_list(F.col(_quoted([sub.columns[0]])))).scalar()
    if not NAME.match(key):
        raise QueryError(f"not a function name: {key!r}")
    cols = [to_column(a, ctx) for a in args]
    return FUNCTIONS[name](*cols) if name in FUNCTIONS else F.call_function(key, *cols)


def arguments(arg: Any) -> list:
    """A list is the arguments, a single value is one; None and empty containers are none. 0, False and "" are values."""
    if arg is None or arg == [] or arg == {}:
        return []
    return arg if isinstance(arg, list) else [arg]


def _without_outputs(ctx: Context) -> Context:
    out = Context(ctx.subquery, ctx.outer)
    out.relations = ctx.relations
    return out


def _subquery(x: Any, ctx: Context) -> DataFrame:
    if isinstance(x, list) and len(x) == 1:
        x = x[0]
    if ctx.subquery is None or not isinstance(x, dict) or "select" not in x:
        raise QueryError(f"a subquery is a select: {x!r}")
    return ctx.subquery(x, ctx)


def _quantified(name: str, left: Any, how: str, arg: Any, ctx: Context) -> Column:
    """``left`` compared with any or all elements of an array or values of a subquery (of one column)."""
    value = to_column(left, ctx)
    only = arg[0] if isinstance(arg, list) and len(arg) == 1 else arg
    if isinstance(only, dict) and "select" in only:
        rows, every = _subquery(only, ctx), how == "all"
        if (name == "=" and not every) or (name in ("!=", "<>") and every):
            return ~value.isin(rows) if every else value.isin(rows)
        if name not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise QueryError(f"{name} {how} takes an array, not a select")
        v = F.col(_quoted([rows.columns[0]]))
        found = rows.agg(F.struct(F.count("*").alias("rows"), F.count(v).alias("known"), F.min(v).alias("low"), F.max(v).alias("high")).alias("s")).scalar()
        n = F.coalesce(found["rows"], F.lit(0))
        if name in ("=", "!=", "<>"):  # equal to all: to the smallest and to the largest; unlike any: unlike one of them
            ends = [OPERATORS[name](value, found[e]) for e in ("low", "high")]
            test = ends[0] & ends[1] if every else ends[0] | ends[1]
        else:  # above all: above the largest; above any: above the smallest
            test = OPERATORS[name](value, found["high" if (name[0] == ">") == every else "low"])
        # a null among the values leaves open what the others don't settle; of no values all are, and none is
        settled = F.when(~test, F.lit(False)) if every else F.when(test, F.lit(True))
        return F.when(n == 0, F.lit(every)).otherwise(F.coalesce(settled, F.when(found["known"] == n, test)))
    elements = to_column(only, ctx)
    test = F.exists if how in ("any", "some") else F.forall
    return test(elements, lambda e: OPERATORS[name](value, e))


def _case(entries: Any, ctx: Context) -> Column:
    if not isinstance(entries, list) or len(entries) < 2:
        raise QueryError("case needs two entries or more")
    out = None
    for i, e in enumerate(entries):
        if "when" in e and "then" in e:
            w, t = to_column(e["when"], ctx), to_column(e["then"], ctx)
            out = F.when(w, t) if out is None else out.when(w, t)
        elif "else" in e and i == len(entries) - 1 and out is not None:
            out = out.otherwise(to_column(e["else"], ctx))
        else:
            raise QueryError(f"bad case entry: {e!r}")
    return out


def _range(arg: dict, ctx: Context) -> Column:
    if not isinstance(arg, dict) or not {"value", "min", "max"} <= set(arg):
        raise QueryError("between needs value, min and max")
    v, lo, hi = (to_column(arg[k], ctx) for k in ("value", "min", "max"))
    return v.between(F.least(lo, hi), F.greatest(lo, hi)) if arg.get("symmetric") else v.between(lo, hi)


def _member(arg: Any, ctx: Context) -> Column:
    if not isinstance(arg, list) or len(arg) != 2:
        raise QueryError("in needs a value and a list or select")
    value, among = to_column(arg[0], ctx), arg[1]
    if isinstance(among, dict) and "select" in among:
        return value.isin(_subquery(among, ctx))
    if isinstance(among, dict) and set(among) == {"literal"}:
        among = [{"literal": v} for v in among["literal"]]
    if not isinstance(among, list):
        among = [among]
    return value.isin(*[to_column(a, ctx) for a in among]) if among else F.lit(False)


def _contains(arg: Any, fold: bool, ctx: Context) -> Column:
    """Wildcards in a literal keep their meaning; a column is looked for as it is."""
    if not isinstance(arg, list) or len(arg) != 2:
        raise QueryError("contains needs two operands")
    c, what = to_column(arg[0], ctx), arg[1]
    text = what[1:-1] if isinstance(what, str) and is_literal_text(what) else what.get("literal") if isinstance(what, dict) and set(what) == {"literal"} else None
    if text is not None:
        return c.ilike(f"%{text}%") if fold else c.like(f"%{text}%")
    w = to_column(what, ctx)
    return F.contains(F.lower(c), F.lower(w)) if fold else F.contains(c, w)


def literal(x: Any) -> Any:
    """``x`` with every string marked as a literal."""
    if isinstance(x, str):
        return {"literal": x}
    if isinstance(x, (list, tuple)):
        return [literal(v) for v in x]
    return {k: literal(v) for k, v in x.items()} if isinstance(x, dict) else x


def show(x: Any) -> str:
    return json.dumps(x, default=str)
