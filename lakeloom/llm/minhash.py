"""Near duplicates by a join of minhash signatures through an inverted index of (coordinate, value) pairs.

A set of word shingles has a signature of ``coordinates`` minima. Every set is posted under each of its pairs of a
coordinate and its value; two sets collide in as many lists as their signatures agree. Sets that agree in at least
``least`` coordinates are wanted:

* lists of one set, and sets with fewer than ``least`` lists left, go: nothing can collide with them often enough;
* a set names its lists from the rarest on. Of two wanted sets both have the first list they share among the first
  ``lists - least + 1`` (prefix), with at least ``least`` lists from there on (skip): only there are pairs made, once, and
  their collisions are counted by merging the two sets' lists;
* a list of more than ``crowd`` sets makes no pairs: its members are chained to one of them.

The components of pairs and chains are cells, and each is joined exactly on whole sets (``ngram_join.links_and_roots``), so
no link comes from the sketch, and none is lost inside a cell. What can be lost is a link whose signatures agree in fewer than ``least``
coordinates: for two texts at a similarity of 0.8 that has a probability of 2e-8 with 64 coordinates and 32 agreements, and less above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngram_join

#: Coordinates of a signature; agreements that make a pair of sets likely; sets in a list that still give pairs.
COORDINATES, LEAST, CROWD = 64, 32, 64
#: Of the lists before one, a row names so many, to tell whether a pair has met already.
LAST = 4


def _mixers(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(13)
    draw = lambda: rng.integers(0, 1 << 63, coordinates, np.uint64)
    return draw() << np.uint64(1) | np.uint64(1), draw() * np.uint64(2) + draw()


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The minima of ``coordinates`` hashes over each set of shingle hashes (none empty), as int32."""
    out = np.empty((len(sets), coordinates), np.int32)
    if sets:
        all_, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for i, (factor, mask) in enumerate(zip(*_mixers(coordinates), strict=True)):
            mixed = (all_ ^ mask) * factor
            mixed ^= mixed >> np.uint64(32)
            out[:, i] = np.minimum.reduceat(((mixed * factor) >> np.uint64(32)).astype(np.uint32), starts).view(np.int32)
    return out


_LISTED = "doc_id long, _k long, _t long, low long, high long, n long, sig array<int>"


def _signed(size: int, coordinates: int):
    """A row for each document: its set's 128-bit hash, size and signature (null for an empty set)."""

    def run(batches):
        for b in batches:
            at = 0
            for group in common.text_groups(b.column("text").to_pylist(), 1 << 21):
                part = b.slice(at, len(group))
                at += len(group)
                sets = ngram_join.shingle_sets(group, size)
                full = np.array([len(s) > 0 for s in sets])
                ids = [ngram_join.set_id(s) if len(s) else (None, None) for s in sets]
                offsets = np.concatenate([[0], np.cumsum(full * coordinates)]).astype(np.int32)
                sig = signatures([s for s in sets if len(s)], coordinates)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~full, False)), pa.array(sig.ravel()))
                cols = [part.column("doc_id"), part.column("_k"), part.column("_t"), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _LISTED.split(", ")])

    return run


def candidates(sets: DataFrame, least: int = LEAST, crowd: int = CROWD, percent: int = 80) -> DataFrame:
    """Pairs (a, b) of ``sets`` (sid, n, sig): those whose signatures agree in ``least`` coordinates or more, and chains of crowded lists.

    No list is gathered in one task: lists are counted with partial counts, their members meet in joins, whose hot keys
    adaptive execution splits, and those of a crowded list meet its pivot only. The plan is the same one at every size.
    """
    posted = sets.select("sid", F.posexplode("sig").alias("at", "value")).select("sid", F.xxhash64("at", "value").alias("h"))
    met = common.durable(posted.groupBy("h").agg(F.count("*").alias("met")).filter("met > 1"))
    common.sweep(sets.sparkSession)  # the counts' shuffle goes before the lists' members are shuffled
    shared = posted.join(met, "h").groupBy("sid").agg(F.collect_list(F.struct("met", "h")).alias("hs"))
    # fewer shared lists than a wanted pair must share: no partner
    shared = shared.filter(F.size("hs") >= least).select("sid", F.array_sort("hs")["h"].alias("hs"))
    lists = common.durable(shared.join(sets.select("sid", "n"), "sid").select("sid", "n", "hs"))
    common.sweep(sets.sparkSession)
    prefix = F.slice("hs", 1, F.size("hs") - least + 1)
    at = lists.select("sid", "n", F.size("hs").alias("all"), prefix.alias("hs")).select("sid", "n", "all", "hs", F.posexplode("hs").alias("i", "h"))
    last = F.slice("hs", F.greatest(F.lit(1), F.col("i") + 1 - LAST), F.least(F.lit(LAST), F.col("i")))
    at = at.select("h", "sid", "n", (F.col("all") - F.col("i")).alias("left"), last.alias("last"))
    counts = common.durable(at.groupBy("h").agg(F.count("*").alias("c"), F.min("sid").alias("pivot")).filter("c > 1"))
    crowded = common.small(counts.filter(F.col("c") > crowd).select("h", "pivot"))
    chains = at.select("sid", "h").join(crowded, "h").filter("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    at = at.join(counts.filter(F.col("c") <= crowd).select("h"), "h", "left_semi")  # the pairs' join has the same partitioning
    x, y = at.alias("x"), at.alias("y")
    pairs = x.join(y, F.col("x.h") == F.col("y.h")).filter(
        (F.col("x.sid") < F.col("y.sid"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.least("x.left", "y.left") >= least)
        & ~F.arrays_overlap("x.last", "y.last")
    )
    pairs = common.durable(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct())
    common.sweep(sets.sparkSession)
    a = lists.select(F.col("sid").alias("a"), F.col("hs").alias("ha"))
    b = lists.select(F.col("sid").alias("b"), F.col("hs").alias("hb"))
    collide = pairs.join(a, "a").join(b, "b").filter(F.size(F.array_intersect("ha", "hb")) >= least).select("a", "b")
    out = common.durable(chains.distinct().union(collide))
    common.discard(met, lists, counts, pairs)
    return out


def minhash_components(
    docs: DataFrame, size: int = 4, percent: int = 80, coordinates: int = COORDINATES, least: int = LEAST, crowd: int = CROWD, cell_items: int = 2_000_000,
    doc_id: str = "doc_id", text: str = "text", leaf: int = ngram_join.LEAF,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    A document's set is that of its ``size``-word shingles after lower-casing A-Z (with fewer words, the whole sequence).
    Documents link if 100 * intersection >= ``percent`` * union, which is confirmed on whole sets; component_id is the
    smallest doc_id reachable by links, kept whether it is the document's own.

    Equal sets are one set of the index, so copies cost neither lists nor pairs. Texts without words (null and empty ones too) have
    an empty set and are alone and kept. A null id is ignored for component_id unless all ids of the component are null (then
    its rows are kept). Rows that repeat an id are each a document. Other columns are ignored; empty input gives no rows.
    """
    common.ship_code(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *common.row_key())
    listed = common.durable(rows.mapInArrow(_signed(size, coordinates), _LISTED))
    full = listed.filter("low is not null")
    # two sets with one first half: the second half names them (few at any size, if any)
    clashing = [r["low"] for r in full.groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b")).filter("a <> b").select("low").collect()]
    sid = F.when(F.col("low").isin(*clashing), F.col("high")).otherwise(F.col("low")) if clashing else F.col("low")
    ids = listed.select("doc_id", sid.alias("sid"), "n")
    sets = full.withColumn("sid", sid).groupBy("sid").agg(
        F.min("n").alias("n"), F.min(F.struct("_k", "_t")).alias("r"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("sig").alias("sig")
    )
    sets = common.durable(sets)
    likely = candidates(sets, least, crowd, percent)
    found = ngram_join.links_and_roots(rows, sets.drop("sig"), common.connected_components(likely), size, percent, cell_items, leaf)
    labelled = common.durable(sets.join(found, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), "least"))
    best = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = common.durable(labelled.join(best, "label").select("sid", "component_id"))
    out = ids.join(common.small(by_set), "sid", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
