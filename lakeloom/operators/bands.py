"""Joins by overlap: a value inside a band, or two bands that meet, found through bins instead of by comparing all pairs.

Each row has a span of numbers (a point has no length). Spans are put on levels by their length, a power of four that is at
least 4/3 of it, so that a span touches two bins of its level at most. A row stands in the bins of its own level and looks
into those of the other side's higher levels; the two meet in one equi-join on level and bin, and each pair is taken in one
bin only, that of the later of the two beginnings. So a row makes two keys for each level the other side has (a dozen or
so), however long its span, and no bin holds spans much shorter than itself. A crowded bin is cut into blocks of about
4,096 times 4,096 rows by the two sides' counts, and the blocks are dealt out like bins, so that no task gets all of one.
The levels are found by an aggregation (at most 1,001 numbers) inside the same plan.

Rows that are equal in all that the condition reads have the same partners, so it is judged once for all of them: an
aggregate or the least partner is taken from such classes' own aggregates, and pairs of rows come from pairs of lists.

Bounds are mapped to doubles without changing their order, which may only add candidates; the condition as given decides.
Rows with a null bound have no partner. Spans that end before they begin are taken from the smaller bound to the larger.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Context, identifier, is_literal_text, to_column

#: The level of spans without length: their bin is the value itself.
POINT = -501
FAR = 1e300  # infinities and larger numbers stand here
#: Rows of one side in a block of a crowded bin, and in a list of equal ones.
BLOCK, LIST = 4096, 512


def number(c: Column, kind: T.DataType) -> Column | None:
    """``c`` as a double in the same order; None for kinds without one."""
    if isinstance(kind, T.DateType):
        x = F.unix_date(c).cast("double")
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(c).cast("double")
    elif isinstance(kind, T.TimestampNTZType):  # by its parts, as no time zone keeps the order
        x = F.unix_date(c.cast("date")) * F.lit(86400.0) + F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")
    elif isinstance(kind, T.NumericType):
        x = c.cast("double")
    else:
        return None
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-FAR)), F.lit(FAR)))


def _level(low: Column, high: Column) -> Column:
    length = high - low
    return F.when(length > 0, F.greatest(F.ceil(F.log(4.0, length / 0.75)).cast("int"), F.lit(-500))).otherwise(POINT)


def _bin(x: Column, level: Column) -> Column:
    return F.when(level == POINT, x + 0.0).otherwise(F.floor(x / F.pow(F.lit(4.0), level)).cast("double"))


def _keyed(df: DataFrame, names: list[str], others: Column, side: int) -> DataFrame:
    """A row for each (group, level, bin) of a span: at home on its own level, and as a visitor on the other side's higher ones.

    Group 0 is the left side at home and the right one looking in, group 1 the other way; equal levels meet in group 0 only.
    """
    low, high, own, level, place, at, key = names
    df = df.withColumn(level, others)  # apart, as a subquery can't stand in a function of a lambda
    df = df.withColumn(level, F.explode(F.array_union(F.array(own), level))).filter(F.col(level) >= F.col(own))
    home = F.col(level) == F.col(own)
    groups = F.when(home, F.array(F.lit(0))).otherwise(F.array(F.lit(1))) if side == 0 else F.when(home, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    bins = F.array_distinct(F.array(_bin(F.col(low), F.col(level)), _bin(F.col(high), F.col(level))))
    keys = F.transform(groups, lambda g: F.transform(bins, lambda b: F.struct((F.col(level) * 2 + g).alias("p"), b.alias("b"))))
    return df.select("*", F.inline(F.flatten(keys)).alias(place, at)).withColumn(key, F.xxhash64(place, at))


def _dealt(a: DataFrame, b: DataFrame, keys: tuple[str, str], weights: tuple[Column, Column]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_lk_*_row`` and ``_lk_*_column``, the block of a crowded key in which a row of each meets; dealt by key and block.

    The keys of more than a block, one in thousands of rows at most, are broadcast with the numbers of their rows and columns.
    """
    counts = [df.groupBy(F.col(k).alias("_lk_busy")).agg(F.ceil(F.sum(w) / BLOCK).alias(n)) for df, k, w, n in zip((a, b), keys, weights, ("_lk_rows", "_lk_columns"), strict=True)]
    busy = F.broadcast(counts[0].join(counts[1], "_lk_busy").filter("_lk_rows > 1 OR _lk_columns > 1"))
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    out = []
    for df, key, name, mine, theirs in ((a, keys[0], "left", "row", "column"), (b, keys[1], "right", "column", "row")):
        n = {x: F.coalesce(F.col(f"_lk_{x}s"), F.lit(1)) for x in (mine, theirs)}
        df = df.join(busy, F.col(key) == F.col("_lk_busy"), "left").withColumn(f"_lk_{name}_{mine}", F.floor(F.rand(11) * n[mine]))
        df = df.withColumn(f"_lk_{name}_{theirs}", F.explode(F.sequence(F.lit(0).cast("long"), n[theirs] - 1))).drop("_lk_busy", "_lk_rows", "_lk_columns")
        out.append(df.repartition(tasks, key, f"_lk_{name}_row", f"_lk_{name}_column"))
    return out[0], out[1]


def overlapping(left: DataFrame, right: DataFrame, of_left: tuple[Column, Column], of_right: tuple[Column, Column], condition: Column, points: tuple[bool, bool] = (False, False), weights: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs of rows whose spans of doubles overlap, ends included, and which ``condition`` holds for; all columns of both.

    With ``weights`` (how many rows one stands for) crowded bins are cut into blocks.
    """
    sides = []
    for df, (a, b), name in ((left, of_left, "left"), (right, of_right, "right")):
        names = [f"_lk_{name}_{x}" for x in ("low", "high", "own", "level", "place", "bin", "key", "row", "column")]
        low, high, own = names[:3]
        df = df.select("*", F.least(a, b).alias(low), F.greatest(a, b).alias(high)).filter(a.isNotNull() & b.isNotNull())
        sides.append((df.withColumn(own, _level(F.col(low), F.col(high))), *names))
    levels = [F.array(F.lit(POINT)) if point else df.agg(F.collect_set(own)).scalar() for (df, _, _, own, *_), point in zip(sides, points, strict=True)]
    a, b = (_keyed(df, names[:7], levels[1 - i], i) for i, (df, *names) in enumerate(sides))
    on = F.lit(True)
    equal = ["key"]
    if weights is not None:
        a, b = _dealt(a, b, (sides[0][7], sides[1][7]), weights)
        equal += ["row", "column"]
    for x in equal:
        on &= F.col(f"_lk_left_{x}") == F.col(f"_lk_right_{x}")
    for x in ("place", "bin"):  # as what hashes are the same; no equality, so that the rows stay where they were dealt to
        on &= (F.col(f"_lk_left_{x}") <= F.col(f"_lk_right_{x}")) & (F.col(f"_lk_left_{x}") >= F.col(f"_lk_right_{x}"))
    first = F.greatest(F.col(sides[0][1]), F.col(sides[1][1]))
    on &= (F.col("_lk_left_bin") == _bin(first, F.shiftright("_lk_left_place", 1))) & condition
    return a.join(b, on).drop(*[c for s in sides for c in s[1:]])


def clashes(rows: DataFrame, equal: list[str], bounds: list[str], beside: DataFrame | None = None) -> bool:
    """Whether two of ``rows``, or one of them and one of ``beside``, are equal in ``equal`` and overlap in ``bounds`` (low, high).

    The low end belongs to a span, the high one does not; a null end is open. Rows with nulls in ``equal`` and spans that end
    where or before they begin meet nothing. Rows are told apart by what is compared, so equal ones are counted first.
    """
    kinds = [rows.schema[b].dataType for b in bounds]
    if any(number(F.lit(None), k) is None for k in kinds) or kinds[0] != kinds[1]:
        raise ValueError(f"{bounds[0]} and {bounds[1]} are no ends of a span")

    def spans(df: DataFrame) -> DataFrame:
        df = df.dropna(subset=equal) if equal else df
        df = df.select(*[F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(equal)], *[F.col(f"`{c}`").alias(n) for c, n in zip(bounds, ("low", "high"), strict=True)])
        return df.filter(F.col("low").isNull() | F.col("high").isNull() | (F.col("low") < F.col("high")))

    mine = spans(rows)
    if beside is None:
        mine = mine.groupBy(*mine.columns).count()
        if mine.filter("count > 1").limit(1).count():
            return True
    low, high, theirs, until = (F.col(c) for c in ("a.low", "a.high", "b.low", "b.high"))
    condition = (low.isNull() | until.isNull() | (low < until)) & (theirs.isNull() | high.isNull() | (theirs < high))
    for i in range(len(equal)):
        condition &= F.col(f"a.e{i}") == F.col(f"b.e{i}")
    if beside is None:
        condition &= F.struct(low, high) < F.struct(theirs, until)
    span = lambda s: (F.coalesce(number(F.col(f"{s}.low"), kinds[0]), F.lit(-FAR)), F.coalesce(number(F.col(f"{s}.high"), kinds[1]), F.lit(FAR)))
    other = mine if beside is None else spans(beside)
    return bool(overlapping(mine.alias("a"), other.alias("b"), span("a"), span("b"), condition).limit(1).count())


def _reads(x: Any, ctx: Context) -> set[tuple[str, str]] | None:
    """(relation, column) of all that an expression reads; None where that can't be told."""
    path = identifier(x)
    if path is not None:
        if len(path) == 1:
            found = [a for a, columns in ctx.relations.items() if path[0] in columns]
            return {(found[0], path[0])} if len(found) == 1 else None
        return {(path[-2], path[-1])} if path[-2] in ctx.relations and path[-1] in ctx.relations[path[-2]] else None
    if isinstance(x, dict):
        if set(x) == {"literal"}:
            return set()
        if set(x) & {"select", "raw", "sql", "exists", "over"}:
            return None
        parts = [y for v in x.values() for y in (v if isinstance(v, list) else v.values() if isinstance(v, dict) and set(v) == {"value", "min", "max"} else [v])]
    elif isinstance(x, str):
        return set() if is_literal_text(x) else None
    else:
        parts = x if isinstance(x, list) else []
    out: set[tuple[str, str]] = set()
    for p in parts:
        if (found := _reads(p, ctx)) is None:
            return None
        out |= found
    return out


def _reads_of(xs: list[Any], ctx: Context) -> set[tuple[str, str]] | None:
    """What several expressions read; a list of names alone would be read as one path."""
    found = [_reads(x, ctx) for x in xs]
    return None if None in found else set().union(*found)


def _must_hold(condition: Any) -> list[Any]:
    """The conditions that all have to hold, ``between`` as its two halves."""
    if isinstance(condition, dict) and len(condition) == 1:
        (name, args), = condition.items()
        if name.lower() == "and" and isinstance(args, list):
            return [c for a in args for c in _must_hold(a)]
        if name.lower() == "between" and isinstance(args, dict) and set(args) == {"value", "min", "max"}:
            return [{"<=": [args["min"], args["value"]]}, {"<=": [args["value"], args["max"]]}]
    return [condition]


def _band(condition: Any, ctx: Context, left: set[str], right: set[str]) -> tuple[tuple[Any, Any], tuple[Any, Any], list[Any]] | None:
    """Bounds of the left and of the right spans, and the two comparisons they are from; none where an equality will do."""
    below, above = [], []  # left <= right, right <= left
    for c in _must_hold(condition):
        if not isinstance(c, dict) or len(c) != 1:
            continue
        (name, args), = c.items()
        if name not in ("<", "<=", ">", ">=", "=", "is") or not isinstance(args, list) or len(args) != 2:
            continue
        sides = [_reads(a, ctx) for a in args]
        if not all(sides):
            continue
        of = [{r for r, _ in s} for s in sides]
        if of[0] <= right and of[1] <= left:
            turned = True
        elif of[0] <= left and of[1] <= right:
            turned = False
        else:
            continue
        if name in ("=", "is"):
            return None
        l, r = (args[1], args[0]) if turned else args
        (below if (name[0] == "<") != turned else above).append((l, r, c))
    found = [((b[0], a[0]), (a[1], b[1]), [b[2], a[2]]) for b in below for a in above]
    return min(found, key=lambda f: (f[0][0] != f[0][1]) and (f[1][0] != f[1][1])) if found else None


def _spans(df: DataFrame, other: DataFrame, condition: Any, ctx: Context, right: set[str]) -> tuple[tuple, tuple, tuple[bool, bool], list[Any]] | None:
    """Both sides' bounds as doubles, which of them are points, and the two comparisons that bound them; None where there are none."""
    if ctx.outer is not None or (found := _band(condition, ctx, set(ctx.relations) - right, right)) is None:
        return None
    of_left, of_right, both = found
    spans = []
    for side, bounds in ((df, of_left), (other, of_right)):
        columns = [to_column(b, ctx) for b in bounds]
        kinds = [f.dataType for f in side.select(*[c.alias(f"b{i}") for i, c in enumerate(columns)]).schema]
        spans.append(([number(c, k) for c, k in zip(columns, kinds, strict=True)], kinds))
    if any(x is None for numbers, _ in spans for x in numbers) or len({k if not isinstance(k, T.NumericType) else T.NumericType for _, kinds in spans for k in kinds}) > 1:
        return None
    return tuple(spans[0][0]), tuple(spans[1][0]), (of_left[0] == of_left[1], of_right[0] == of_right[1]), both


def _columns(reads: set[tuple[str, str]], alias: str) -> list[str]:
    return sorted(c for r, c in reads if r == alias)


def _of(alias: str, column: str) -> Column:
    return F.col(".".join(f"`{x.replace('`', '``')}`" for x in (alias, column)))


def _classes(df: DataFrame, alias: str, columns: list[str], *more: Column) -> DataFrame:
    """One row for all of ``df`` that are equal in ``columns``, with their aggregates."""
    keys = [_of(alias, c) for c in columns]
    return (df.groupBy(*keys).agg(*more) if more else df.select(*keys).distinct()).alias(alias)


def _listed(df: DataFrame, alias: str, columns: list[str], needed: list[str]) -> DataFrame:
    """Rows that are equal in ``columns`` as lists ``_lk_list`` of about ``LIST`` rows, however many there are."""
    names = [f"_lk_{i}" for i in range(len(columns))]
    rows = df.select(*[_of(alias, c).alias(n) for c, n in zip(columns, names, strict=True)], F.struct(*[_of(alias, c).alias(c) for c in needed]).alias("_lk_list"))
    many = rows.groupBy(*[F.col(n).alias(f"{n}m") for n in names]).agg(F.ceil(F.count("*") / LIST).alias("_lk_lists")).filter("_lk_lists > 1")
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}m"))
    placed = rows.join(many, same, "left").withColumn("_lk_which", F.floor(F.rand(5) * F.coalesce("_lk_lists", F.lit(1))))
    lists = placed.groupBy(*names, "_lk_which").agg(F.collect_list("_lk_list").alias("_lk_list"))
    return lists.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], F.col("_lk_list").alias(f"_lk_list_{alias}")).alias(alias)


def _unlisted(pairs: DataFrame, sides: list[tuple[str, list[str]]]) -> DataFrame:
    """Pairs of lists as pairs of rows, with the columns of both relations under their names."""
    quoted = lambda x: "`" + x.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`"
    views = [f"LATERAL VIEW inline({quoted(f'_lk_list_{r}')}) {quoted(r)} AS {', '.join(quoted(c) for c in columns)}" for r, columns in sides]
    lists = pairs.select(*[f"`_lk_list_{r}`" for r, _ in sides])
    return pairs.sparkSession.sql(f"SELECT {', '.join(f'{quoted(r)}.*' for r, _ in sides)} FROM {{pairs}} {' '.join(views)}", pairs=lists)


def words(*clauses: Any) -> set[str] | None:
    """Every word of the clauses, in lower case, so that a column with another name isn't asked for; None where a star may stand for any."""
    out: set[str] = set()
    for x in clauses:
        if isinstance(x, dict):
            x = [y for k, v in x.items() for y in ([k.replace("*", "")] if k.lower() == "count" and v == "*" else [k.replace("*", ""), v])]
        if isinstance(x, (list, tuple)):
            if (found := words(*x)) is None:
                return None
            out |= found
        elif isinstance(x, str):
            if "*" in x:
                return None
            out |= set(re.findall(r"\w+", x.lower()))
        elif isinstance(x, DataFrame):
            continue
    return out


def joined(df: DataFrame, other: DataFrame, condition: Any, ctx: Context, right: set[str], how: str = "inner", whole: bool = True) -> DataFrame | None:
    """``df`` joined with ``other`` (the relations ``right``) where ``condition`` bounds a span on both ends; None if it does not.

    ``whole``: all of the condition is the join's; else the two comparisons alone, and the caller filters by the rest.
    Rows of an outer join without a partner are those whose columns in the condition no pair has; equal ones share their fate.
    Where the statement says which columns it needs (``ctx.defaults``), the others are left out.
    """
    left = set(ctx.relations) - right
    if (found := _spans(df, other, condition, ctx, right)) is None:
        return None
    *spans, points, both = found
    reads = _reads(condition, ctx) if whole else _reads_of(both, ctx)
    if reads is None and how != "inner":
        return None
    exact = to_column(condition, ctx) if whole else to_column(both[0], ctx) & to_column(both[1], ctx)
    one = (F.lit(1), F.lit(1))
    needed = ctx.defaults.get("needed")
    if reads is None or needed is None or len(left) != 1 or len(right) != 1:
        out = pairs = overlapping(df, other, *spans, exact, points, one)
    else:
        sides = []
        for d, (r,) in ((df, left), (other, right)):
            wanted = set(_columns(reads, r))
            columns = [c for c in ctx.relations[r] if c in wanted or c.lower() in needed or not re.fullmatch(r"\w+", c)]
            sides.append((d.select(*[_of(r, c) for c in columns]), r, columns, sorted(wanted)))
        df, other = (s[0] for s in sides)
        lists = [_listed(d, r, keys, columns) for d, r, columns, keys in sides]
        out = _unlisted(overlapping(*lists, *spans, exact, points, tuple(F.size(f"_lk_list_{r}") for _, r, *_ in sides)), [(r, columns) for _, r, columns, _ in sides])
        if how != "inner":
            pairs = overlapping(*[_classes(d, r, keys) for d, r, _, keys in sides], *spans, exact, points, one)
    for mine, names, outer, before in ((df, left, ("left", "full"), True), (other, right, ("right", "full"), False)):
        if how not in outer:
            continue
        keys = [_of(r, c) for r, c in sorted(reads) if r in names]
        seen = pairs.select(*[k.alias(f"_lk_seen_{i}") for i, k in enumerate(keys)]).distinct()
        alone = mine.join(seen, [k.eqNullSafe(F.col(f"_lk_seen_{i}")) for i, k in enumerate(keys)], "left_anti")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in (other if before else df).schema]
        out = out.union(alone.select("*", *empty) if before else alone.select(*empty, "*"))
    return out


def least(rows: DataFrame, alias: str, other: DataFrame, where: Any, ctx: Context, sets: dict[str, Any], value: Callable[[str, Any], Column], name: str) -> DataFrame | None:
    """``rows`` that have partners in ``other`` by a band in ``where``, with the least struct of ``sets`` that a partner gives, as ``name``.

    None where that isn't told by classes of equal rows. Values of the partner alone are taken from its class beforehand.
    """
    (right,) = set(ctx.relations) - {alias}
    reads, given = _reads(where, ctx), _reads_of(list(sets.values()), ctx)
    if reads is None or given is None or any(not isinstance(v, (dict, str, int, float)) or v == {"default": None} for v in sets.values()):
        return None
    if (found := _spans(rows, other, where, ctx, {right})) is None:
        return None
    *spans, points, _ = found
    made = F.struct(*[value(c, v).alias(c) for c, v in sets.items()])
    if {r for r, _ in given} <= {right}:
        theirs, made = _classes(other, right, _columns(reads, right), F.min(made).alias(name)), F.col(name)
    else:
        theirs = _classes(other, right, _columns(reads | given, right))
    keys = _columns(reads | given, alias)
    pairs = overlapping(_classes(rows, alias, keys), theirs, *spans, to_column(where, ctx), points, (F.lit(1), F.lit(1)))
    best = pairs.groupBy(*[_of(alias, c).alias(f"_lk_best_{i}") for i, c in enumerate(keys)]).agg(F.min(made).alias(name))
    return rows.join(best, [_of(alias, c).eqNullSafe(F.col(f"_lk_best_{i}")) for i, c in enumerate(keys)])


def folded(df: DataFrame, other: DataFrame, on: Any, ctx: Context, right: str, group: list[Any], outputs: list[tuple[str, Any]]) -> DataFrame | None:
    """Counts, least and largest values of groups of an inner join by a band, from classes of equal rows; None where that isn't told by them."""
    (left,) = set(ctx.relations) - {right}
    reads, by = _reads(on, ctx), _reads_of(group, ctx)
    if reads is None or by is None or (found := _spans(df, other, on, ctx, {right})) is None:
        return None
    *spans, points, _ = found
    parts: dict[str, list[Column]] = {r: [F.count(F.lit(1)).alias(f"_lk_n_{r}")] for r in (left, right)}
    columns, n = [], {r: F.col(f"_lk_n_{r}") for r in (left, right)}
    for i, (name, x) in enumerate(outputs):
        if identifier(x) is not None:
            if (where := _reads(x, ctx)) is None or not where <= by:
                return None
            columns.append(to_column(x, ctx).alias(name))
            continue
        if not isinstance(x, dict) or len(x) != 1:
            return None
        (f, arg), = x.items()
        if f == "count" and arg == "*":
            columns.append(F.coalesce(F.sum(n[left] * n[right]), F.lit(0)).alias(name))
            continue
        args = _reads(arg, ctx) if f in ("count", "min", "max") and (identifier(arg) is not None or isinstance(arg, dict) and set(arg) & {"+", "-", "*"}) else None
        if not args or len(of := {r for r, _ in args}) != 1:
            return None
        (r,), part = of, f"_lk_part_{i}"
        parts[r].append({"count": F.count, "min": F.min, "max": F.max}[f](to_column(arg, ctx)).alias(part))
        columns.append((F.coalesce(F.sum(F.col(part) * n[right if r == left else left]), F.lit(0)) if f == "count" else F.min(part) if f == "min" else F.max(part)).alias(name))
    sides = [_classes(d, r, _columns(reads | by, r), *parts[r]) for d, r in ((df, left), (other, right))]
    pairs = overlapping(*sides, *spans, to_column(on, ctx), points, (F.lit(1), F.lit(1)))
    keys = [to_column(g, ctx) for g in group]
    if not keys:
        return pairs.agg(*columns)
    rows = pairs.groupBy(*keys).agg(*columns)
    out = rows.toDF(*[f"__{i}" for i in range(len(rows.columns))])
    return out.select(*[F.col(f"__{i + len(keys)}").alias(name) for i, (name, _) in enumerate(outputs)])
