"""Helpers shared by the text operators: word hashing, shipping code, durable cuts of lineage, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters, so ``bytes.split()`` yields exactly the words.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


#: Rows go to Python in batches of about so many bytes: Spark's own bound of 10,000 rows says nothing of their size, and copies of a batch stand in the JVM and in Python.
BATCH_BYTES = 4 << 20


def ship_code(spark: SparkSession) -> None:
    """Make this package importable on executors that don't share the driver's folders (once per application), and have batches for Python bounded, unless the session says how."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "lakeloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lakeloom", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage is cut and its rows survive executors.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests) a local one is set.
    Parquet is written rather than ``checkpoint()`` so that later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lk_path = path
    return out


def settled(spark: SparkSession, make) -> DataFrame:
    """The result of ``make()``, durable; every other table that was made durable on the way goes."""
    from ..sources.files import Files

    paths = _written.setdefault(spark.sparkContext.applicationId, [])
    before = set(paths)
    out = durable(make())
    for path in [p for p in paths if p not in before and p != out._lk_path]:
        Files(spark).delete(path)
        paths.remove(path)
    sweep(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete durable tables from which nothing is read any more."""
    from ..sources.files import Files

    for t in tables:
        paths = _written.get(t.sparkSession.sparkContext.applicationId, [])
        if getattr(t, "_lk_path", None) in paths:
            Files(t.sparkSession).delete(t._lk_path)
            paths.remove(t._lk_path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` (written already, narrow rows) marked for broadcast if it has at most ``most`` rows; beyond that joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bits of a table for each key, and how many there are at most (32 MB, broadcast): enough for 2 ** 25 keys.
KEY_BITS, MOST_BITS = 8, 1 << 28


def _parted(rows: DataFrame, keys: DataFrame, on: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``on`` may be among the ``n`` ``keys``, and those where it surely isn't (all but about an eighth of these).

    A bit stands for each hash of a key; 64 make a word, 128 words a row of the table that is broadcast.
    """
    bits = 1 << max(13, (KEY_BITS * n - 1).bit_length())
    hashed = F.xxhash64(*on, F.lit("bits")).bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = keys.select(hashed.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    table = words.groupBy(F.shiftright("_word", 7).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_word").bitwiseAND(F.lit(127)).cast("int"), "_bits"))).alias("_words"))
    table = table.select("_row", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.try_element_at("_words", i), F.lit(0))).alias("_words"))
    told = rows.withColumn("_bit", hashed).withColumn("_row", F.shiftright("_bit", 13)).join(F.broadcast(durable(table)), "_row", "left")
    word = F.get("_words", F.shiftright("_bit", 6).bitwiseAND(F.lit(127)).cast("int"))
    may = F.coalesce(word.bitwiseAND(one) != 0, F.lit(False))
    return told.filter(may).drop("_row", "_bit", "_words"), told.filter(~may).drop("_row", "_bit", "_words")


def matching(rows: DataFrame, keys: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """Inner join of wide ``rows`` with narrow ``keys`` (written already); where these are too many to broadcast, rows without a key
    aren't shuffled, unless the keys are so many that a table of bits would say nothing (from ``MOST_BITS / KEY_BITS`` on)."""
    n = keys.count()
    if n <= most:
        return rows.join(F.broadcast(keys), on)
    return (_parted(rows, keys, on, n)[0] if KEY_BITS * n <= MOST_BITS else rows).join(keys, on)


def lacking(rows: DataFrame, keys: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """Wide ``rows`` without one of the narrow ``keys`` (written already); shuffled are the same rows as in ``matching``, the others are read in a second pass."""
    n = keys.count()
    if n <= most:
        return rows.join(F.broadcast(keys), on, "left_anti")
    if KEY_BITS * n > MOST_BITS:
        return rows.join(keys, on, "left_anti")
    some, rest = _parted(rows, keys, on, n)
    return rest.select(*rows.columns).union(some.join(keys, on, "left_anti").select(*rows.columns))


def release(spark: SparkSession) -> int:
    """Delete what ``durable`` wrote for this application, once no result that was made from it is needed any more; how many folders."""
    from ..sources.files import Files

    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        Files(spark).delete(path)
    return len(paths)


def sweep(spark: SparkSession) -> None:
    """Have the driver's collector run: Spark deletes the shuffle files of queries that have ended once it finds them unreachable."""
    spark.sparkContext._jvm.java.lang.System.gc()


def by_hash(df: DataFrame, key: str, most: int, n: int) -> DataFrame:
    """About ``most`` of the ``n`` rows of ``df``: those whose hash of ``key`` lies below a threshold (all rows if n is no more)."""
    share = min(1.0, most / max(1, n))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else df


def shared_dir(spark: SparkSession) -> str:
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="lakeloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


CHUNK = 1 << 20
_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
_LETTER[_BREAK] = 0
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(max(n, CHUNK + 4096), base, np.uint64)
            step[0] = 1
            _powers.append(np.cumprod(step))
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and where each text begins (one more than there are texts).

    A word's hash is a polynomial in random values of its bytes, taken from running sums over whole chunks of text;
    chunks end between words, so a hash depends on nothing but the word.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
    hashes, places, at = [], [], 0
    while at < len(raw):
        stop = min(at + CHUNK, len(raw))
        while not _BREAK[raw[stop - 1]]:
            more = np.flatnonzero(_BREAK[raw[stop : stop + CHUNK]])
            stop = stop + int(more[0]) + 1 if len(more) else min(stop + CHUNK, len(raw))
        part = raw[at:stop]
        up, down = _power_tables(len(part))
        inside = np.concatenate([[False], ~_BREAK[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[part] * up[: len(part)])])
        hashes.append(scramble((sums[last] - sums[first]) * down[first]))
        places.append(first + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.searchsorted(np.concatenate(places), ends)])
    return np.concatenate(hashes), begin


def text_groups(texts: list[str | None], most_chars: int):
    """Runs of texts (a null one is empty) of about ``most_chars`` together; a longer one is whole, and alone or last."""
    group, chars = [], 0
    for t in texts:
        group.append(t or "")
        chars += len(group[-1])
        if chars >= most_chars:
            yield group
            group, chars = [], 0
    if group:
        yield group


def text_slices(batches, most_bytes: int = 1 << 21):
    """Arrow batches in parts of about ``most_bytes`` bytes of their column ``text``; a longer text is whole, and alone."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most_bytes, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; empty where there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        out = out * base + words[j : j + n]
    return scramble(out)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(_k, _t): tells rows apart by id and text. Repeated rows share it and so get the same result; a null id sorts first."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_k"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"),
    ]


def literal_table(values: list[float]) -> Column:
    """A column holding a table of bounded size as one constant (it is parsed once, by the optimizer), to 0.001."""
    return F.split(F.lit(",".join(f"{v:.3f}" for v in values)), ",").cast("array<float>")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b: long): label is the smallest node of the component.

    Each round gives the smallest label among a node's neighbours to the node and to the node that its old label names
    (so whole basins move, not single nodes), then jumps to the label's own label. That is Liu and Tarjan's extended
    connect with shortcutting, whose rounds grow with the square of the logarithm of the nodes at most. Rounds go on until
    no label moves; labels only fall, so they end. The joins are plain sort-merge joins whose hot keys adaptive execution splits.
    Every round is written to the shared folder: nothing is collected but one count.
    """
    both = durable(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    )
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    moved, prior = 1, labels
    while moved:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("seen"))
            .withColumnRenamed("a", "node")
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        # one row to the node itself, one to its old label's node, which has a row of its own too
        told = step.select(
            F.explode(F.array(F.struct("node", "old", "label"), F.struct(F.col("old").alias("node"), F.lit(None).cast("long").alias("old"), "label"))).alias("r")
        ).select("r.*")
        step = durable(told.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = durable(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = after.filter("old <> label").limit(1).count()
        discard(prior, step)
        prior, labels = after, after.select("node", "label")
    discard(both)
    return labels
