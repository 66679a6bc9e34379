"""Bringing a target to a source's schema and rows: merge, apply, and copy by shards."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store, definition
from . import ddl, diffing
from .fingerprint import SHARD_ROWS, bucket_of, cut_points, numbered

GROUPS = {"columns": "column", "constraints": "constraint", "indexes": "index"}


def merge_table(store: Store, at: tuple[str, str], want: dict, found: dict, names: dict[str, dict[str, str]]) -> dict:
    """Change table ``at`` from ``found`` to ``want`` (by alias); ``names``: group -> alias -> real name here. Returns the changes."""
    changes: dict[str, Any] = {}
    steps: dict[str, list] = {"add": [], "drop": [], "alter": []}
    for group in ("constraints", "indexes", "columns"):
        kind, real = GROUPS[group], lambda k, g=group: names.get(g, {}).get(k, k)
        d = diffing.diff(found.get(group, {}), want.get(group, {}))
        if isinstance(d, list):
            d = {diffing.DELETE: d[0], diffing.INSERT: d[1]}
        if not d:
            continue
        changes[group] = d
        for k, v in d.get(diffing.INSERT, {}).items():
            body = dict(v)
            if "columns" in body and group != "columns":
                body["columns"] = [names.get("columns", {}).get(c, c) for c in body["columns"]]
            steps["add"].append({kind: {"name": real(k), **body}})
        steps["drop"] += [{kind: {"name": real(k), "maybe": True}} for k in d.get(diffing.DELETE, {})]
        for k, v in d.items():
            if k in (diffing.INSERT, diffing.DELETE):
                continue
            full = want[group][k]
            if group == "columns":
                fields = {f: full[f] for f in v if f in ("type", "null", "default", "sequence", "choices")}
                if fields:
                    steps["alter"].append({"column": {"name": real(k), **fields}})
            else:
                steps["drop"].append({kind: {"name": real(k)}})
                steps["add"].append({kind: {"name": real(k), **full, **({"columns": [names.get("columns", {}).get(c, c) for c in full["columns"]]})}})
    if any(steps.values()):
        order = {"column": 0, "constraint": 1, "index": 2}
        steps["add"].sort(key=lambda s: order[next(iter(s))])
        steps["drop"].sort(key=lambda s: -order[next(iter(s))])
        ddl.change(store, list(at), steps)
    return changes


def create_table(store: Store, at: tuple[str, str], want: dict, names: dict[str, str]) -> None:
    real = lambda cs: [names.get(c, c) for c in cs]
    table = {
        "columns": {names.get(k, k): v for k, v in want.get("columns", {}).items()},
        "constraints": {k: {**v, "columns": real(v["columns"])} for k, v in want.get("constraints", {}).items()},
        "indexes": {k: {**v, "columns": real(v["columns"])} for k, v in want.get("indexes", {}).items()},
    }
    meta = definition(at[1], table)
    store.write(*at, meta, store.spark.createDataFrame([], store.schema(meta)))


def row_hashes(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row. Spark's hash skips nulls, so whether a value is null is hashed beside it."""
    values = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def _sums(a: Column, b: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(a.cast("decimal(20,0)")).alias("hash"), F.sum(b.cast("decimal(20,0)")).alias("hash_b")]


def _prints(columns: list[str]) -> list[Column]:
    """Count and order-free 128-bit hash of a group of rows."""
    return _sums(*row_hashes(columns))


def copy_rows(
    source: DataFrame, target: DataFrame, key: str | None, shard_rows: int = SHARD_ROWS, stage: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame | None, int, int]:
    """(new rows of the target or None if it is equal, rows copied, rows skipped); both sides have the same columns.

    The source's keys fall into shards of ``shard_rows``; target rows belong to the shard whose key range they lie in.
    Keys and hashes of the source are numbered once (and kept by ``stage``); both sides are parted at the same cut
    points, so a shard's rows meet in the join of their fingerprints alone. Equal shards stay as they are; of the others
    the source's rows are read. Rows outside every range go. Without a single key the whole table is one shard.
    """
    cols = source.columns
    target = target.select(*cols)
    if key is None:
        a, b = (d.agg(*_prints(cols)).first() for d in (source, target))
        return (None, 0, a["n"]) if a == b else (source, a["n"], 0)
    k = F.col(f"`{key}`")
    a, b = row_hashes(cols)
    cuts = cut_points(source, key)
    mine = numbered(source.select(k, a.alias("_a"), b.alias("_b")), key, shard_rows, cuts)
    mine = stage(mine) if stage else mine
    bounds = mine.groupBy("_bucket", "_shard").agg(F.min(k).alias("_lo"), F.max(k).alias("_hi"))
    whole = bounds.groupBy("_shard").agg(F.max("_hi").alias("_top"))
    prior = whole.select((F.col("_shard") + 1).alias("_shard"), F.col("_top").alias("_below"))
    ranges = bounds.join(whole, "_shard").join(prior, "_shard", "left")
    # a gap between two shards belongs to the later one: it may start in an earlier part of the key range
    ranges = ranges.withColumn("_first", F.when(F.col("_below").isNull(), F.col("_bucket")).otherwise(bucket_of(F.col("_below"), cuts)))
    ranges = ranges.groupBy("_shard", "_top", "_below").agg(F.min("_first").alias("_first"), F.max("_bucket").alias("_last"), F.min("_lo").alias("_lo"))
    ranges = ranges.withColumn("_bucket", F.explode(F.sequence("_first", "_last"))).select("_bucket", "_shard", "_top", "_below", "_lo")

    def sharded(df: DataFrame) -> DataFrame:
        near = df.withColumn("_bucket", bucket_of(k, cuts)).join(ranges, "_bucket")
        return near.filter((k <= F.col("_top")) & F.when(F.col("_below").isNull(), k >= F.col("_lo")).otherwise(k > F.col("_below")))

    left = mine.groupBy("_shard").agg(*_sums(F.col("_a"), F.col("_b")))
    right = sharded(target.select(k, a.alias("_a"), b.alias("_b"))).groupBy("_shard").agg(*_sums(F.col("_a"), F.col("_b")))
    right = right.select("_shard", *[F.col(c).alias(f"_{c}") for c in ("n", "hash", "hash_b")])
    same = F.lit(True)
    for c in ("n", "hash", "hash_b"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = left.join(right, "_shard", "left").select("_shard", "n", same.alias("same"))
    both = stage(both) if stage else both
    totals = both.agg(F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("c"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("s")).first()
    copied, skipped = int(totals["c"] or 0), int(totals["s"] or 0)
    if not copied and target.count() == skipped:
        return None, 0, skipped
    if not skipped:
        return source, copied, 0
    kept = sharded(target).join(both.filter("same").select("_shard"), "_shard", "left_semi").select(*cols)
    nulls = source.filter(k.isNull())  # a key of no range: its shard is the last one
    fresh = sharded(source).join(both.filter("not same").select("_shard"), "_shard", "left_semi").select(*cols)
    return kept.unionByName(fresh).unionByName(nulls), copied, skipped
