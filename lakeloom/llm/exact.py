"""Exact duplicates: 128-bit content hash, byte comparison inside groups, one row stays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _normal(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(batch.column(column).cast(pa.large_string()), ""))


def _halves(raw: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """The 128-bit content hash of each text, as two columns."""
    both = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in raw), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _sign(batches):
    for b in batches:
        low = _normal(b, "text")
        raw = [x.encode() for x in low.to_pylist()]
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_t"), *_halves(raw), sha], ["doc_id", "_t", "h1", "h2", "text_sha256"])


def _lowered(batches):
    for b in batches:
        low = _normal(b, "text")
        raw = [x.encode() for x in low.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_halves(raw), low.cast(pa.string())], ["doc_id", "h1", "h2", "body"])


def exact_dedup(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text", row_keys: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; with ``row_keys`` also _k and _t of ``common.row_key``.

    Texts are equal if identical after lower-casing A-Z. Rows are grouped by a 128-bit hash; in hashes that more than
    one row has, whole texts are compared (they are the grouping key, so two texts that share a hash form two groups).
    The counts are combined before the shuffle, so a text that a third of all rows share costs one row for each task.
    ``keep``: the smallest or largest doc_id of a group stays.

    Null and empty texts are equal. A null doc_id counts as smaller than all; only if all ids of a group are null is its
    keep_id null, and then every row of it is kept. Rows that repeat id and text are all marked kept or all dropped.
    Empty input gives no rows; other columns are ignored.
    """
    common.ship_code(docs.sparkSession)
    best = {"smallest": F.min, "largest": F.max}[keep]
    k, t = common.row_key()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = rows.withColumn("_t", t if row_keys else F.lit(None).cast("long"))
    signed = keyed.mapInArrow(_sign, "doc_id long, _t long, h1 long, h2 long, text_sha256 string")
    groups = signed.groupBy("h1", "h2").agg(F.count("*").alias("rows"))
    shared = common.durable(groups.filter("rows > 1").select("h1", "h2"))
    # bytes are compared here: the text itself is part of the grouping key
    bodies = (
        rows.mapInArrow(_lowered, "doc_id long, h1 long, h2 long, body string")
        .join(common.small(shared.select("h1", "h2")), ["h1", "h2"])
    )
    classes = common.durable(
        bodies.groupBy("h1", "h2", "body")
        .agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h1", "h2", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    out = signed.join(common.small(classes), ["h1", "h2", "text_sha256"], "left")
    one = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(one | F.col("keep_id").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        *([k, "_t"] if row_keys else []),
    )


#: The same rows in SQL.
SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
