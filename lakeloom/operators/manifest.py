"""Manifests: for each data file of a table its rows, key range and order-free 128-bit hash; and copies that follow them.

Files never change, so a file's line is computed once, when it is first asked for, and kept beside the table. A shard of the
target is a run of its files whose key ranges overlap (files written here don't, so mostly a file is a shard; small ones are taken together). Source files
that lie in one shard count by their line; only those across a border are read. Shards with equal sums are settled without
reading a row; of the others the target's files are replaced by the source's rows of that key range.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import Store, folders, parts_of
from .fingerprint import MOST_CUTS, PART_ROWS, Cuts, bucket_of, cuts_of
from .replicate import row_hashes

SUMS = ("n", "hash", "hash_b")


class Side:
    """A table seen through ``columns`` (name in the copy -> column), which both sides have alike."""

    def __init__(self, store: Store, at: tuple[str, str], columns: dict[str, Column], key: str | None):
        self.store, self.at, self.columns, self.key, self.meta = store, at, columns, key, store.record(*at)
        spec = json.dumps([key, *((name, str(c)) for name, c in columns.items())])
        self.digest = hashlib.md5(spec.encode()).hexdigest()

    def rows(self, df: DataFrame) -> DataFrame:
        return df.select(*[c.alias(name) for name, c in self.columns.items()])

    def hashed(self, df: DataFrame, *more: Column) -> DataFrame:
        """key, a, b of each row."""
        a, b = row_hashes(list(self.columns))
        k = F.col(f"`{self.key}`") if self.key else F.lit(None).cast("int")
        rows = df.select(*[c.alias(name) for name, c in self.columns.items()], *more)
        return rows.select(k.alias("_key"), a.alias("_a"), b.alias("_b"), *[F.col(m) for m in rows.columns if m not in self.columns])

    def _held(self, folder: str) -> str | None:
        base = f"{self.store.place(*self.at, self.meta)}/_manifest/{self.digest}/{folder}"
        return next((f"{base}/{n}" for n in self.store.files.names(base) if self.store.files.exists(f"{base}/{n}/_SUCCESS")), None)

    def files(self) -> DataFrame:
        """file, n, lo, hi, nulls, hash, hash_b of each file of the snapshot; folders without lines get them by reading their rows once."""
        parts, base = parts_of(self.meta), self.store.place(*self.at, self.meta)
        whole = sorted(folders(parts))
        for f in whole:
            if self._held(f) is None:
                name = "_lk_file"
                source = self.store._parts(*self.at, [f], self.meta)
                path = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2)).alias(name)
                lines = self.hashed(source.select("*", path), F.col(name)).groupBy(F.col(name).alias("file")).agg(*sums(), F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count(F.when(F.col("_key").isNull(), 1)).alias("nulls"))
                lines.coalesce(1).write.parquet(f"{base}/_manifest/{self.digest}/{f}/m-{uuid.uuid4().hex}")
        if not whole:
            return self.hashed(self.store._parts(*self.at, [], self.meta)).select(F.lit("").alias("file"), *[F.lit(0).cast("decimal(38,0)").alias(c) for c in SUMS], F.col("_key").alias("lo"), F.col("_key").alias("hi"), F.lit(0).alias("nulls"))
        lines = self.store.spark.read.parquet(*[self._held(f) for f in whole])
        single = [p for p in parts if "/" in p]
        if single:
            named = self.store.spark.createDataFrame([(p,) for p in single], "file string")
            folder = F.substring_index("file", "/", 1)
            lines = lines.filter(folder.isin([p for p in parts if "/" not in p])).unionByName(lines.join(named, "file", "left_semi"))
        return lines


def sums() -> list[Column]:
    return [F.count("*").cast("decimal(38,0)").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(name) for c, name in (("_a", "hash"), ("_b", "hash_b"))]]


def added() -> list[Column]:
    return [F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS]


def shard_tops(lines: DataFrame, shard_rows: int) -> Cuts:
    """The upper ends of all shards but the last: runs of files whose ranges overlap, neighbours being taken together up to
    ``shard_rows`` rows, and further beyond ``MOST_CUTS`` shards.

    One line a file goes through one task, as the runs follow one another.
    """
    by = Window.partitionBy(F.lit(0)).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    seen = lines.filter("lo is not null").select("lo", F.max("hi").over(by).alias("top"), F.floor(F.sum("n").over(by) / shard_rows).alias("shard"))
    ends = seen.filter(F.col("top") < F.col("lo"))
    after = F.coalesce(F.lag("shard").over(Window.partitionBy(F.lit(0)).orderBy("lo")), F.lit(0))
    ends = ends.withColumn("new", F.col("shard") > after).filter("new").select("top")
    n = ends.count()
    if n > MOST_CUTS:
        step = math.ceil(n / MOST_CUTS)
        ends = ends.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("top"))).filter(F.col("i") % step == 0).select("top")
    return cuts_of(ends)


def rows_per_file(total: int, shard_rows: int) -> int:
    """At most about a million, but some dozens of files where there are shards enough."""
    return max(shard_rows, min(PART_ROWS, total // 64))


def laid_out(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """``n`` rows in files of about ``most`` with disjoint key ranges."""
    return rows.repartitionByRange(max(1, math.ceil(n / most)), f"`{key}`").sortWithinPartitions(f"`{key}`")


def copy_files(source: Side, target: Side, shard_rows: int) -> tuple[int, int] | None:
    """(rows copied, rows settled), the target being brought to the source's rows; None where a key is null (``copy_rows`` can do that).

    The source may be any table; one of our own is read only where its files lie across the target's shards or differ.
    """
    store, at, key = target.store, target.at, target.key
    theirs = target.files()
    have = theirs.agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("hash").alias("hash"), F.sum("hash_b").alias("hash_b")).first()
    own = source.meta is not None
    if own:
        mine = source.files()
        want = mine.agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("hash").alias("hash"), F.sum("hash_b").alias("hash_b")).first()
        if (want["n"] or 0) == (have["n"] or 0) and all((want[c] or 0) == (have[c] or 0) for c in SUMS):
            return 0, int(want["n"] or 0)  # not a row was read
    everything = source.store.read(*source.at)
    if not (have["n"] or 0) or key is None:
        if not own and have["n"]:
            now = source.hashed(everything).agg(*sums()).first()
            if all((now[c] or 0) == (have[c] or 0) for c in SUMS):
                return 0, int(now["n"] or 0)
        total = int(want["n"] or 0) if own else everything.count()
        if key is not None and everything.select(source.columns[key].alias("k")).filter("k is null").limit(1).count():
            return None
        rows = source.rows(everything)
        store.write(*at, store.meta(*at), laid_out(rows, key, total, rows_per_file(total, shard_rows)) if key is not None and total else rows, check=False, sort=key is None)
        return total, 0
    if have["nulls"] or own and want["nulls"]:
        return None
    tops = shard_tops(theirs, shard_rows)
    shard = lambda c: bucket_of(F.col(c), tops, strict=True)
    placed = theirs.withColumn("shard", shard("hi"))
    right = placed.filter("n > 0").groupBy("shard").agg(*added())
    if own:
        spans = mine.filter("n > 0").withColumns({"first": shard("lo"), "last": shard("hi")})
        inside = spans.filter("first = last").withColumnRenamed("first", "shard").select("shard", *SUMS)
        across = [r["file"] for r in spans.filter("first < last").select("file").collect()]  # names of files
        read = source.hashed(source.store._parts(*source.at, across, source.meta))
    else:
        read = source.hashed(everything)
        if read.filter("_key is null").limit(1).count():
            return None
    left = read.groupBy(shard("_key").alias("shard")).agg(*sums())
    left = (left.unionByName(inside) if own else left).groupBy("shard").agg(*added())
    other = right.select("shard", *[F.col(c).alias(f"_{c}") for c in SUMS])
    same = F.lit(True)
    for c in SUMS:
        same = same & F.coalesce(c, F.lit(0)).eqNullSafe(F.coalesce(f"_{c}", F.lit(0)))
    both = store.stage(*at, left.join(other, "shard", "full").select("shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"), same.alias("same")))
    total = both.agg(F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("c"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("s"), F.count(F.when(~F.col("same"), 1)).alias("d")).first()
    copied, settled = int(total["c"] or 0), int(total["s"] or 0)
    if not total["d"]:
        return 0, settled
    bad = F.broadcast(both.filter("not same").select(F.col("shard").alias("_lk_shard")))  # at most MOST_CUTS + 1 numbers
    if own:
        needed = [r["file"] for r in spans.join(bad, F.col("_lk_shard").between(F.col("first"), F.col("last")), "left_semi").select("file").collect()]
        everything = source.store._parts(*source.at, needed, source.meta)
    rows = source.rows(everything)
    rows = rows.join(bad, bucket_of(F.col(f"`{key}`"), tops, strict=True) == F.col("_lk_shard"), "left_semi")
    touched = [r["file"] for r in placed.join(bad, F.col("shard") == F.col("_lk_shard"), "left_semi").select("file").collect()]
    touched, others, _, _ = store.part_at(*at, touched)
    store.replace(*at, store.meta(*at), touched, others, laid_out(rows, key, copied, rows_per_file(copied + settled, shard_rows)), check=False, sort=False)
    return copied, settled
