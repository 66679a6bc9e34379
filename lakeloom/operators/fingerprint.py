"""Counts, ranges and hashes of tables, by shards of consecutive keys."""

from __future__ import annotations

import datetime
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 16000
#: Rows between two cut points, and how many cut points there may be.
PART_ROWS, MOST_CUTS = 1_000_000, 1 << 16


def row_text(columns: dict[str, str], kinds: dict[str, str]) -> Column:
    """A row as a JSON array of its columns in order of alias; timestamps keep their microseconds."""
    parts: list[Column] = []
    for alias in sorted(columns):
        c = F.col(f"`{columns[alias]}`")
        if kinds.get(columns[alias], "").startswith(("timestamp", "date")):
            c = c.cast("string")
        j = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        parts += [F.lit(", ")] if parts else []
        parts.append(F.when(c.isNull(), F.lit("null")).otherwise(j.substr(F.lit(6), F.length(j) - 6)))
    return F.concat(F.lit("["), *parts, F.lit("]"))


def how_many_cuts(rows: int) -> int:
    """A cut for about every ``PART_ROWS`` rows, so that no task has to sort more than about that many, however large the table."""
    return max(64, min(MOST_CUTS, rows // PART_ROWS))


class Cuts:
    """Values that part a column's range, in order, as texts from which its type reads them back exactly."""

    def __init__(self, texts: list[str], kind: str):
        self.texts, self.kind = texts, kind

    @classmethod
    def of(cls, values: list) -> Cuts:
        """Plain values of one kind, in order."""
        kinds = {int: "bigint", float: "double", datetime.date: "date", datetime.datetime: "timestamp_ntz"}
        return cls([str(v) for v in values], kinds.get(type(values[0]), "string") if values else "string")

    def __len__(self) -> int:
        return len(self.texts)

    def value(self, i: int) -> Column:
        return F.lit(self.texts[i]).cast(self.kind)

    def table(self) -> Column:
        """All of them as one constant: one literal is parsed once, however many there are."""
        return F.from_json(F.lit(json.dumps(self.texts)), "array<string>").cast(f"array<{self.kind}>")


def cuts_of(values: DataFrame) -> Cuts:
    """The distinct values of a bounded one-column table."""
    kind = values.schema[0].dataType.simpleString()
    k = F.col(f"`{values.columns[0]}`")
    text = F.base64(k).cast("string") if kind == "binary" else k.cast("string")
    return Cuts([r[0] for r in values.filter(k.isNotNull()).distinct().orderBy(k).select(text).collect()], kind)


def cut_points(df: DataFrame, key: str, most: int | None = None) -> Cuts:
    """Key values that part the rows about evenly: those whose hash lies below a threshold, about ``most`` of them, the same in every run.

    A task sends its share of the sample, not ``most`` rows, and no task gets more than the sample as a whole.
    """
    k = F.col(f"`{key}`")
    n = df.count()
    most = how_many_cuts(n) if most is None else most
    share = min(1.0, most / max(1, n))
    some = df.filter(F.pmod(F.xxhash64(k, F.lit("cut")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else df
    return cuts_of(some.select(k.alias("k")))


def bucket_of(key: Column, cuts: Cuts | list, strict: bool = False) -> Column:
    """How many cut points are at or below (``strict``: below) the key: a binary search, log2 comparisons a row."""
    cuts = cuts if isinstance(cuts, Cuts) else Cuts.of(cuts)
    above = (lambda c: key <= c) if strict else (lambda c: key < c)

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(above(cuts.value(mid)), between(lo, mid)).otherwise(between(mid + 1, hi))

    if len(cuts) <= 64 and cuts.kind != "binary":
        return between(0, len(cuts))
    table = F.transform(cuts.table(), lambda x: F.unbase64(x.cast("string"))) if cuts.kind == "binary" else cuts.table()
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    ahead = lambda at, step: (at + step <= len(cuts)) & F.coalesce(~above(F.get(table, at + step - 1)), key.isNull())
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))


def numbered(df: DataFrame, key: str, shard_rows: int = SHARD_ROWS, cuts: Cuts | None = None) -> DataFrame:
    """``df`` with ``_bucket`` and ``_shard``: rows in order of ``key``, ``shard_rows`` to a shard.

    Rows are parted at sampled cut points (one for about a million rows) and numbered inside each part; the parts'
    counts, one row each, say how many rows come before. Nothing depends on how the input is laid out.
    """
    cuts = cut_points(df, key) if cuts is None else cuts
    placed = df.withColumn("_bucket", bucket_of(F.col(f"`{key}`"), cuts))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", before.alias("_before"))  # at most MOST_CUTS + 1 rows
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(f"`{key}`").asc_nulls_last())) - 1
    rows = placed.withColumn("_place", place).join(F.broadcast(counts), "_bucket")
    return rows.withColumn("_shard", F.floor((F.col("_place") + F.col("_before")) / shard_rows)).select(*df.columns, "_bucket", "_shard")


def md5_of(rows: Column, key: Column) -> Column:
    """md5 of the texts of a group's rows in key order, joined by commas."""
    listed = F.sort_array(F.collect_list(F.struct(key.alias("k"), rows.alias("r"))))
    return F.md5(F.array_join(F.transform(listed, lambda x: x["r"]), ","))


def shard_hashes(df: DataFrame, key: str, columns: dict[str, str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """min_pk, max_pk, count, md5 of each shard."""
    k = F.col(f"`{key}`")
    rows = numbered(df, key, shard_rows).withColumn("_text", row_text(columns, dict(df.dtypes)))
    out = rows.groupBy("_shard").agg(F.min(k).alias("min_pk"), F.max(k).alias("max_pk"), F.count("*").alias("count"), md5_of(F.col("_text"), k).alias("md5"))
    return out.drop("_shard")


def statistics(df: DataFrame, key: str, columns: dict[str, str] | None = None, limit: int | None = None, cursor: Any = None, md5: bool = False) -> DataFrame:
    """count, min, max and md5 over the first ``limit`` rows whose key is beyond ``cursor``."""
    k = F.col(f"`{key}`")
    rows = df.filter(k > F.lit(cursor)) if cursor is not None else df
    rows = rows.orderBy(k).limit(limit) if limit is not None else rows
    aggs = [F.count("*").alias("count"), F.min(k).alias("min"), F.max(k).alias("max")]
    if md5:
        rows = rows.withColumn("_text", row_text(columns or {c: c for c in df.columns}, dict(df.dtypes)))
        aggs.append(md5_of(F.col("_text"), k).alias("md5"))
    return rows.agg(*aggs)


def keyset_page(df: DataFrame, key: str, limit: int | None, cursor: Any = None) -> DataFrame:
    rows = df.filter(F.col(f"`{key}`") > F.lit(cursor)) if cursor is not None else df
    return rows.orderBy(F.col(f"`{key}`").asc_nulls_last()).limit(limit) if limit is not None else rows


def edges(df: DataFrame, column: str, key: str | None = None, limit: int | None = None, cursor: Any = None) -> DataFrame:
    """The smallest and the largest value of a column; in the first ``limit`` rows whose ``key`` (by default the column) is beyond ``cursor``."""
    rows = keyset_page(df, key or column, limit, cursor)
    return rows.agg(F.min(F.col(f"`{column}`")).alias("min"), F.max(F.col(f"`{column}`")).alias("max"))
