"""insert, update, delete and truncate: each writes a new snapshot (an update or delete anew only the files it touches) and says which rows it touched."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import Context, QueryError, identifier, to_column
from ..plans.select import Compiler
from ..sources.store import Store, StoreError, split_name
from . import bands


class Result:
    """How many rows a statement touched, and the rows it returns if it was asked to."""

    def __init__(self, count: int, rows: DataFrame | None = None):
        self.count, self.rows = count, rows


def _target(clause: Any) -> tuple[str, str | None]:
    table = clause.get("table", clause.get("name"))
    if isinstance(table, dict):
        (alias, name), = table.items()
        return name, alias
    return table, None


def _context(compiler: Compiler, alias: str, columns: list[str]) -> Context:
    ctx = Context(compiler.run)
    ctx.relations[alias] = columns
    return ctx


def _returned(clause: dict, rows: DataFrame, alias: str, compiler: Compiler) -> DataFrame | None:
    what = clause.get("return")
    if not what:
        return None
    ctx = _context(compiler, alias, rows.columns)
    items, _ = compiler.outputs(what, ctx)
    cols = []
    for a, x in items:
        name = a or (identifier(x) or [None])[-1]
        c = to_column(x, ctx)
        cols.append(c.alias(name) if name and name != "*" else c)
    return rows.alias(alias).select(*cols)


def counter_of(table: str, name: str, column: dict) -> str | None:
    """The sequence that numbers a column: the one its ``nextval`` default names, or its own."""
    d = column.get("default")
    if isinstance(d, dict) and set(d) == {"nextval"}:
        arg = d["nextval"]
        arg = arg[0] if isinstance(arg, list) else arg
        arg = arg["literal"] if isinstance(arg, dict) and "literal" in arg else arg
        return str(arg).strip("'\"").rpartition(".")[2].strip("'\"")
    return f"{table}__{name}__seq" if column.get("sequence") else None


def default_of(store: Store, schema: str, column: dict):
    """The default of a column as an expression; sequences are handled apart."""
    d = column.get("default")
    if isinstance(d, dict) and set(d) == {"nextval"}:
        return F.lit(None)
    return to_column(d, Context()) if d is not None else F.lit(None)


def with_sequence(store: Store, schema: str, table: str, meta: dict, rows: DataFrame, missing: list[str]) -> DataFrame:
    """Fill sequence columns: partitions count their rows first, then number them from the counter on (no global sort)."""
    for name in missing:
        key = counter_of(table, name, meta["columns"][name])
        part, row, before_col = (_own(rows, c) for c in ("part", "row", "before"))
        kept = store.stage(schema, table, rows.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
        parts = {r[0]: r[1] for r in kept.groupBy(part).count().collect()}  # one row a partition
        before, total = {}, 0
        for p in sorted(parts):
            before[p], total = total, total + parts[p]
        largest = None
        if store.sequences(schema).get(key, {}).get("value") is None:
            largest = store.read(schema, table).agg(F.max(F.col(f"`{name}`"))).first()[0] or 0

        def take(counters: dict, key=key, total=total, largest=largest) -> tuple[int, int]:
            """Numbers for all rows at once: nobody else gets them."""
            c = counters.setdefault(key, {"type": "sequence", "increment": 1, "value": None})
            last, step = largest if c.get("value") is None else c["value"], c.get("increment", 1)
            final = last + total * step
            if total and ((c.get("max") is not None and final > c["max"]) or (c.get("min") is not None and final < c["min"])):
                raise StoreError(f"sequence {key} ends at {c['max' if step > 0 else 'min']}")
            c["value"] = final
            return last, step

        last, step = store.change_sequences(schema, take)
        offsets = F.broadcast(store.spark.createDataFrame(list(before.items()), f"{part} int, {before_col} long"))
        kept = kept.join(offsets, part)
        number = F.row_number().over(Window.partitionBy(part).orderBy(row)) + F.col(before_col)
        rows = kept.withColumn(name, F.coalesce(F.col(name), F.lit(last) + number * F.lit(step))).drop(part, row, before_col)
    return rows


def _own(rows: DataFrame, stem: str) -> str:
    """A column's name that none of ``rows`` has."""
    taken, name = {c.lower() for c in rows.columns}, f"_lk_{stem}"
    while name in taken:
        name += "_"
    return name


def insert(store: Store, compiler: Compiler, clause: Any, schema: str | None = None) -> Result:
    clause = {"table": clause} if isinstance(clause, str) else clause
    name, alias = _target(clause)
    at = split_name(name, schema)
    meta = store.meta(*at)
    names = list(meta["columns"])
    compiler.bind(clause.get("with"))
    columns = clause.get("columns") or names
    columns = [identifier(c)[-1] for c in ([columns] if isinstance(columns, str) else columns)]
    if unknown := set(columns) - set(names):
        raise QueryError(f"no columns {sorted(unknown)} in {name}")
    values, numbered = clause.get("values"), []
    if isinstance(values, DataFrame) or isinstance(values, dict) and "select" in values:
        new = values if isinstance(values, DataFrame) else compiler.run(values)
        if len(new.columns) != len(columns):
            raise QueryError("insert has another number of columns than its select")
        new = new.toDF(*columns)
        given = set(columns)
    elif values in (None, []):
        new, given = store.spark.range(1).select(), set()
    else:
        rows = values if isinstance(values[0], list) and not (identifier(values[0]) and len(columns) == 1) else [values]
        if any(len(r) != len(columns) for r in rows):
            raise QueryError("a row has another number of values than there are columns")
        ctx = Context(compiler.run)
        plain = lambda v: isinstance(v, dict) and set(v) == {"literal"}
        if all(plain(v) or not isinstance(v, (dict, list, str)) for r in rows for v in r):  # many rows of plain values: one local relation
            from pyspark.sql import types as T

            kind = T.StructType([f for c in columns for f in store.schema(meta) if f.name == c])
            data = [tuple(v["literal"] if plain(v) else v for v in r) for r in rows]
            new = store.spark.createDataFrame([tuple(_fit(v, f.dataType) for v, f in zip(r, kind, strict=True)) for r in data], kind)
        else:
            made = []
            for r in rows:
                cells = [default_of(store, at[0], meta["columns"][c]) if v == {"default": None} else to_column(v, ctx) for c, v in zip(columns, r, strict=True)]
                made.append(F.struct(*[x.cast(store.schema(meta)[c].dataType).alias(c) for c, x in zip(columns, cells, strict=True)]))
            new = store.spark.range(1).select(F.inline(F.array(*made)))
        given = set(columns)
        numbered = [c for i, c in enumerate(columns) if counter_of(at[1], c, meta["columns"][c]) and any(r[i] == {"default": None} for r in rows)]
    absent = [c for c in names if c not in given]
    new = new.select("*", *[default_of(store, at[0], meta["columns"][c]).cast(store.schema(meta)[c].dataType).alias(c) for c in absent])
    new = with_sequence(store, *at, meta, new.select(*[F.col(f"`{c}`").cast(store.schema(meta)[c].dataType).alias(c) for c in names]), [*numbered, *(c for c in absent if counter_of(at[1], c, meta["columns"][c]))])
    new = store.stage(*at, new)
    count = new.count()
    if count:
        store.append(*at, meta, new)
    return Result(count, _returned(clause, new, alias or at[1], compiler))


def _fit(v: Any, kind: Any) -> Any:
    if v is None:
        return None
    s = kind.simpleString()
    if s == "string":
        return v if isinstance(v, str) else str(v)
    if s in ("int", "bigint", "smallint") and isinstance(v, str):
        return int(v)
    return float(v) if s in ("double", "float") else v


def _one_source(source: Any) -> tuple[str | None, Any] | None:
    """(alias, source) where there is but one, and it is a table."""
    source = source[0] if isinstance(source, list) and len(source) == 1 else source
    (alias, source), *more = source.items() if isinstance(source, dict) and source else ((None, source),)
    return (alias, source) if not more and isinstance(source, (str, DataFrame)) else None


def _least(compiler: Compiler, clause: dict, source: Any, rows: DataFrame, alias: str, ctx: Context, sets: dict[str, Any], value: Any, name: str) -> DataFrame | None:
    """Rows that have partners by a band, with their least values as ``name``; None where the pairs are needed for that."""
    if clause.get("where") is None or clause.get("join") or (one := _one_source(source)) is None:
        return None
    before, ctx.relations = ctx.relations, dict(ctx.relations)
    found = bands.least(rows, alias, compiler.relation(one[1], one[0], ctx), clause["where"], ctx, sets, value, name)
    ctx.relations = before if found is None else ctx.relations
    return found


def update(store: Store, compiler: Compiler, clause: dict, schema: str | None = None) -> Result:
    name, alias = _target(clause)
    at = split_name(name, schema)
    alias = alias or at[1]
    meta = store.meta(*at)
    kinds = store.schema(meta)
    compiler.bind(clause.get("with"))
    given, old = clause["set"], store.read(*at)
    ctx = _context(compiler, alias, old.columns)
    if isinstance(given, list):
        *cols, sub = given
        targets = [identifier(c)[-1] for c in cols]
        pair = compiler.run(sub, ctx)
        if len(targets) == 1:
            sets = {targets[0]: sub}
        else:
            one = pair.select(F.struct(*[F.col(f"`{c}`").alias(t) for c, t in zip(pair.columns, targets, strict=True)]).alias("s"))
            sets = {t: ("struct", one, t) for t in targets}
    else:
        sets = {k.split(".")[-1]: v for k, v in given.items()}
    if unknown := set(sets) - set(old.columns):
        raise QueryError(f"no columns {sorted(unknown)} in {name}")

    def value(c: str, v: Any):
        if isinstance(v, tuple):
            x = v[1].scalar()[v[2]]
        elif v == {"default": None}:
            x = default_of(store, at[0], meta["columns"][c])
        else:
            x = to_column(v, ctx)
        return x.cast(kinds[c].dataType)

    by_file = store.by_file(*at)
    file, row, hit, to = (_own(old, c) for c in ("file", "row", "hit", "to"))
    rows = store.located(old, file, row) if by_file else store.stage(*at, old.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row)))
    if clause.get("from") is None:
        where = F.lit(True) if clause.get("where") is None else F.coalesce(to_column(clause["where"], ctx), F.lit(False))
        files = rows.alias(alias).filter(where)
    else:  # one partner a row: the one with the smallest values, so reruns agree
        place = [F.col(f"`{alias}`.`{c}`").alias(c) for c in (file, row)]
        found = _least(compiler, clause, clause["from"], rows.alias(alias), alias, ctx, sets, value, to)
        if found is not None:
            files = picked = store.stage(*at, found.select(*place, F.col(to)))
        else:
            both = compiler.sources(clause["from"], ctx, clause.get("where"), rows.alias(alias))
            both = compiler.join(both, clause.get("join"), ctx)
            if clause.get("where") is not None:
                both = both.filter(to_column(clause["where"], ctx))
            files = picked = store.stage(*at, both.groupBy(*place).agg(F.min(F.struct(*[value(c, v).alias(c) for c, v in sets.items()])).alias(to)))
    files = [r[0] for r in files.select(file).distinct().collect()]  # names of files, as a snapshot's record holds them
    if not files:
        return Result(0, _returned(clause, old.limit(0), alias, compiler))
    if by_file:
        touched, others, rows, rest = store.part_at(*at, files)
        rows = store.located(rows, file, row)
    kept = [F.col(f"`{c}`") for c in old.columns]
    if clause.get("from") is None:
        marked = rows.alias(alias).select(*kept, where.alias(hit), F.struct(*[value(c, v).alias(c) for c, v in sets.items()]).alias(to))
    else:
        marked = rows.join(picked, [file, row], "left").select(*kept, F.col(to).isNotNull().alias(hit), F.col(to))
    marked = store.stage(*at, marked)
    new = marked.select(*[F.when(F.col(hit), F.col(to)[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in old.columns], hit)
    count = new.filter(hit).count()
    if count:
        after = new.drop(hit)
        store.check_referring(*at, marked.filter(hit).select(*kept), after.unionByName(rest) if by_file else after, set(sets))
        if by_file:
            store.replace(*at, meta, touched, others, after)
        else:
            store.write(*at, meta, after)
    return Result(count, _returned(clause, new.filter(hit).drop(hit), alias, compiler))


def delete(store: Store, compiler: Compiler, clause: Any, schema: str | None = None) -> Result:
    clause = {"table": clause} if isinstance(clause, str) else clause
    name, alias = _target(clause)
    at = split_name(name, schema)
    alias = alias or at[1]
    meta, old = store.meta(*at), store.read(*at)
    compiler.bind(clause.get("with"))
    ctx, where = _context(compiler, alias, old.columns), F.lit(True)
    using, by_file = clause.get("using"), store.by_file(*at) and (clause.get("where") is not None or clause.get("using") is not None)
    file, row, mark = (_own(old, c) for c in ("file", "row", "hit"))
    rows = store.located(old, file, row) if by_file else store.stage(*at, old.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row))) if using is not None else old
    if using is None:
        where = F.lit(True) if clause.get("where") is None else F.coalesce(to_column(clause["where"], ctx), F.lit(False))
        files = rows.alias(alias).filter(where)
    else:  # rows with one partner or more
        place = [F.col(f"`{alias}`.`{c}`").alias(c) for c in (file, row)]
        both = _least(compiler, clause, using, rows.alias(alias), alias, ctx, {mark: {"literal": True}}, lambda c, v: F.lit(True), mark)
        if both is None:
            both = compiler.join(compiler.sources(using, ctx, clause.get("where"), rows.alias(alias)), clause.get("join"), ctx)
            both = both.filter(to_column(clause["where"], ctx)) if clause.get("where") is not None else both
        files = picked = store.stage(*at, both.select(*place).distinct())
    if by_file:
        names = [r[0] for r in files.select(file).distinct().collect()]
        if not names:
            return Result(0, _returned(clause, old.limit(0), alias, compiler))
        touched, others, rows, rest = store.part_at(*at, names)
        rows = store.located(rows, file, row)
    kept = [F.col(f"`{c}`") for c in old.columns]
    if using is None:
        marked = rows.alias(alias).select(*kept, where.alias(mark))
    else:
        marked = rows.join(picked.withColumn(mark, F.lit(True)), [file, row], "left").select(*kept, F.coalesce(F.col(mark), F.lit(False)).alias(mark))
    marked = store.stage(*at, marked)
    hit, left = marked.filter(F.col(mark)).drop(mark), marked.filter(~F.col(mark)).drop(mark)
    count = hit.count()
    if count:
        store.check_referring(*at, hit, left.unionByName(rest) if by_file else left)
        if by_file:
            store.replace(*at, meta, touched, others, left, check=False)
        else:
            store.write(*at, meta, left)
    return Result(count, _returned(clause, hit, alias, compiler))


def truncate(store: Store, clause: Any, schema: str | None = None) -> Result:
    """Empties one table or several; cascade empties the tables that refer to it, too."""
    items = clause if isinstance(clause, list) else [clause]
    done: set[tuple[str, str]] = set()
    for item in items:
        name, cascade = (item.get("name") or item.get("table"), item.get("cascade")) if isinstance(item, dict) else (item, False)
        todo = [split_name(name, schema)]
        while todo:
            at = todo.pop()
            if at in done:
                continue
            done.add(at)
            meta = store.meta(*at)
            store.write(*at, meta, store.read(*at).limit(0))
            for other in store.tables(at[0]) if cascade else []:
                for k in store.meta(at[0], other)["constraints"].values():
                    if k["type"] == "foreign" and k.get("related_name") and split_name(k["related_name"], at[0]) == at:
                        todo.append((at[0], other))
    return Result(0)
