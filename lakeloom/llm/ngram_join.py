"""Exact similarity join on word shingles in the Jaccard metric space, and its components.

Almost all texts are at Jaccard distance 1 from one another, so whole documents make poor pivots for the first
division: every document would lie in every region. Here the first pivots are single shingles: under one order of all
shingles a document lies nearest its first one, and the triangle inequality bounds how far down its own order a partner
within the distance can have its nearest pivot, so the document is replicated to that many regions and no more (the
boundary window). Small regions give the pairs of sets that share enough regions; members of a large region are only
chained to its pivot. The components of these pairs and chains are the cells: two linked texts always lie in one cell.
Each cell is joined on whole sets, recursively: document pivots part it into Voronoi regions, the triangle inequality
decides which boundary documents are replicated to which region, and regions are parted again until they are small or
too dense to be parted; those are measured in blocks. Links are counted there, so a crowd of near copies costs rows in
proportion to its documents, not to its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Of so many sets one (by its hash) reports all its shingles, and so many reports tell a frequent one.
SAMPLE, SIGHTINGS = 64, 3
#: How many regions before its own each row of a region names, so that a pair comes from the first region it shares.
LAST = 4
#: A region of a cell that is no larger is measured as it is; a larger one is parted by so many pivots.
LEAF, PIVOTS = 512, 8


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The set of word shingles of each text, as sorted 64-bit hashes; a text of fewer words is one shingle."""
    words, begin = common.word_hashes([(t or "").encode().lower() for t in texts])
    grams = common.gram_hashes(words, size)
    out = []
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(grams[a : z - size + 1]))
        elif z > a:
            out.append(common.gram_hashes(words[a:z], z - a) ^ np.uint64(z - a))
        else:
            out.append(words[:0])
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit hash of a set, as two signed halves; the first one names the set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[8:], "little", signed=True), int.from_bytes(d[:8], "little", signed=True)


def _name(s: np.ndarray, clashing: frozenset[int]) -> int:
    low, high = set_id(s)
    return high if low in clashing else low


_LISTED = "doc_id long, _k long, _t long, low long, high long, n long, h long, c long"


def _listed_rows(*given) -> pa.RecordBatch:
    n = len(given[0] if given[0] is not None else given[-1])
    cols = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in given]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _LISTED.split(", ")])


def _identity(size, most=1 << 20):
    """A row for each document: its set's id and size; rows (h, c) for shingles that several documents of the part hold; and
    rows (h, -c) for all shingles of one set in ``SAMPLE``, so that those that stand once in each of many parts are told of, too.

    The table of shingles keeps at most about ``most``: when full it forgets the rarest (they only decide an order).
    """

    def told(shingles):
        k, c = np.unique(np.concatenate(shingles), return_counts=True)
        return _listed_rows(None, None, None, None, None, None, k.view(np.int64), -c)

    def run(batches):
        keys, times = np.empty(0, np.uint64), np.empty(0, np.int64)
        some, held = [], 0
        for b in batches:
            at = 0
            for group in common.text_groups(b.column("text").to_pylist(), 1 << 21):
                sets = shingle_sets(group, size)
                part = b.slice(at, len(group))
                at += len(group)
                ids = [set_id(s) if len(s) else (None, None) for s in sets]
                yield _listed_rows(
                    part.column("doc_id"), part.column("_k"), part.column("_t"), [x for x, _ in ids], [y for _, y in ids], [len(s) for s in sets], None, None
                )
                chosen = [s for s, (low, _) in zip(sets, ids, strict=True) if low is not None and low % SAMPLE == 0]
                some, held = some + chosen, held + sum(map(len, chosen))
                if held >= most:
                    yield told(some)
                    some, held = [], 0
                k, c = np.unique(np.concatenate(sets), return_counts=True)
                at_key = np.searchsorted(keys, k)
                hit = keys[np.minimum(at_key, len(keys) - 1)] == k if len(keys) else np.zeros(len(k), bool)
                times[at_key[hit]] += c[hit]
                keys, times = np.concatenate([keys, k[~hit]]), np.concatenate([times, c[~hit]])
                floor = 1
                while len(keys) > most and floor < 1 << 40:
                    ok = times > floor
                    keys, times, floor = keys[ok], times[ok], 2 * floor
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
        ok = times > 1
        yield _listed_rows(None, None, None, None, None, None, keys[ok].view(np.int64), times[ok])
        if held:
            yield told(some)

    return run


def frequent_shingles(listed: DataFrame, least: int, most: int) -> np.ndarray:
    """Shingles held by at least ``least`` rows (as the parts told of them, or the sampled sets), the ``most`` most frequent: a bounded list.

    It only decides the order of shingles, never the result. A shingle that both miss is held by few rows: each part has it once, and the sample hardly ever.
    """
    parts = F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("c"))), F.lit(0))
    sample = F.coalesce(-F.sum(F.when(F.col("c") < 0, F.col("c"))), F.lit(0))
    counted = F.greatest(parts, F.when(sample >= SIGHTINGS, sample * SAMPLE).otherwise(0))
    seen = listed.filter("h is not null").groupBy("h").agg(counted.alias("c"))
    top = seen.filter(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(most).select("h").toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def extra(n: int) -> int:
    """How many shared regions a pair must have, by set size."""
    return max(1, min(8, n // 12))


def _regions(size, percent, frequent, clashing):
    """Rows (h, sid, place): the regions of each set, once a part; place is 0 in those of ordinary shingles, else it deals rows out."""

    def run(batches):
        hot, seen = frequent.value, set()
        for b in batches:
            for group in common.text_groups(b.column("text").to_pylist(), 1 << 21):
                hs, ids, ps = [], [], []
                for s in shingle_sets(group, size):
                    n = len(s)
                    if not n or (sid := _name(s, clashing)) in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(sid)
                    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
                    p = min(n, n - -(-percent * n // 100) + extra(n))
                    many = int(late.sum())
                    if many:
                        s = np.concatenate([s[~late], s[late]])
                    hs.append(s[:p])
                    ids.append(np.full(p, sid, np.int64))
                    ps.append(np.where(np.arange(p) >= n - many, 1 + (sid & 255), 0))
                if hs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ps).astype(np.int16))], ["h", "sid", "place"]
                    )

    return run


def _need(n: str):
    return F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col(n) / 12)))


def _alike(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that share as many regions as two similar sets must."""
    a = regions.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    b = regions.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.filter(F.size(F.array_intersect("ha", "hb")) >= F.least(_need("na"), _need("nb"))).select("a", "b")


def candidates(rows: DataFrame, listed: DataFrame, sizes: DataFrame, clashing: frozenset[int], size: int, percent: int, share: float, most_frequent: int, crowd: int) -> DataFrame:
    """Pairs (a, b) of sets whose components hold every link: likely pairs of small regions, and pivot and member of large ones."""
    total = listed.filter("h is null").count()
    least = int(max(3, min(share * total, crowd / 2)))
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(listed, least, most_frequent))
    # one shuffle: regions of ordinary shingles meet whole, rows of frequent ones are spread; regions of one set go
    w = Window.partitionBy("h", "place")
    placed = rows.select("text").mapInArrow(_regions(size, percent, frequent, clashing), "h long, sid long, place short")
    met = F.when(F.col("place") == 0, F.least(F.count("*").over(w), F.lit(2**31 - 2))).otherwise(F.lit(2**31 - 1)).cast("int").alias("met")
    placed = placed.select("h", "sid", "place", met, F.min("sid").over(w).alias("lo"), F.max("sid").over(w).alias("hi"))
    shared = placed.filter("lo <> hi or place <> 0").groupBy("sid").agg(F.collect_set(F.struct("met", "h")).alias("hs"))
    # sets with too few shared regions to be similar to any other go; the others list theirs from the rarest on
    regions = shared.join(sizes.select("sid", "n"), "sid").withColumn("_low", F.floor(F.col("n") * percent / 100)).filter(F.size("hs") >= _need("_low"))
    regions = common.durable(regions.select("sid", "n", F.array_sort("hs")["h"].alias("hs")))
    common.sweep(rows.sparkSession)
    at = regions.withColumn("_low", F.floor(F.col("n") * percent / 100)).select("sid", "n", "_low", "hs", F.posexplode("hs").alias("_i", "h"))
    at = at.select("h", "sid", "n", "_low", (F.size("hs") - F.col("_i")).alias("left"), F.slice("hs", F.greatest(F.lit(1), F.col("_i") + 1 - LAST), F.least(F.lit(LAST), F.col("_i"))).alias("last"))
    # the first region that similar sets share is followed, in both lists, by the others they must share
    at = at.filter(F.col("left") >= _need("_low")).drop("_low")
    counts = common.durable(at.groupBy("h").agg(F.count("*").alias("c"), F.min("sid").alias("pivot")).filter("c > 1"))
    large = common.small(counts.filter(F.col("c") > crowd).select("h", "pivot"))
    chains = at.select("sid", "h").join(large, "h").filter("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    at = at.join(common.small(counts.filter(F.col("c") <= crowd).select("h")), "h", "left_semi")
    x, y = at.alias("x"), at.alias("y")
    pairs = x.join(y, F.col("x.h") == F.col("y.h")).filter(
        (F.col("x.sid") < F.col("y.sid"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.least("x.left", "y.left") >= F.least(_need("x.n"), _need("y.n")))
        & ~F.arrays_overlap("x.last", "y.last")
    )
    pairs = common.durable(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct())
    common.sweep(rows.sparkSession)
    out = common.durable(chains.distinct().union(_alike(pairs, regions)))
    common.discard(regions, counts, pairs)
    return out


class Cell:
    """Exact join of sets by recursion on Voronoi regions. Counts links (weighted by copies) and unites what is linked."""

    def __init__(self, sets: list[np.ndarray], copies: np.ndarray, percent: int, leaf: int = LEAF):
        self.percent, self.copies, self.leaf = percent, copies.astype(np.float64), leaf
        self.n = np.array([len(s) for s in sets], np.int64)
        names, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), self.n)
        more = times[col] > 1  # a shingle of one set adds nothing to an intersection
        number = np.cumsum(times > 1) - 1
        self.row, self.col = row[more], number[col[more]]
        self.begin = np.searchsorted(self.row, np.arange(len(sets) + 1))
        self.others = np.zeros(len(sets))
        self.up = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def _entries(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``of``, shingle) of all shingles of the sets ``of``."""
        count = self.begin[of + 1] - self.begin[of]
        at = np.repeat(self.begin[of] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.repeat(np.arange(len(of)), count), self.col[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Sizes of the intersections of the sets ``a`` with the sets ``b``: products of 0/1 tables, some columns at a time."""
        (ra, ca), (rb, cb) = self._entries(a), self._entries(b)
        both = np.intersect1d(ca, cb)
        out = np.zeros((len(a), len(b)), np.float32)
        if not len(both):
            return out
        step = max(1, most // max(len(a), len(b)))
        pa_, pb = np.minimum(np.searchsorted(both, ca), len(both) - 1), np.minimum(np.searchsorted(both, cb), len(both) - 1)
        ina, inb = both[pa_] == ca, both[pb] == cb
        ra, pa_, rb, pb = ra[ina], pa_[ina], rb[inb], pb[inb]
        for at in range(0, len(both), step):
            x, y = np.zeros((len(a), min(step, len(both) - at)), np.float32), np.zeros((len(b), min(step, len(both) - at)), np.float32)
            i, j = (pa_ >= at) & (pa_ < at + step), (pb >= at) & (pb < at + step)
            x[ra[i], pa_[i] - at] = 1
            y[rb[j], pb[j] - at] = 1
            out += x @ y.T
        return out

    def measure(self, own: np.ndarray, guests: np.ndarray, within: bool) -> None:
        """Measures pairs of ``own`` (if ``within``) and of ``own`` with ``guests``, in blocks."""
        for i in range(0, len(own), self.leaf):
            a = own[i : i + self.leaf]
            for b in [*([own[j : j + self.leaf] for j in range(i, len(own), self.leaf)] if within else []), *[guests[j : j + self.leaf] for j in range(0, len(guests), self.leaf)]]:
                inter = self.common(a, b).astype(np.int64)
                linked = 100 * inter >= self.percent * (self.n[a][:, None] + self.n[b] - inter)
                if a[0] == b[0]:  # a block with itself
                    linked &= np.arange(len(a))[:, None] < np.arange(len(b))
                if not linked.any():
                    continue
                self.others[a] += linked @ self.copies[b]
                self.others[b] += linked.T @ self.copies[a]
                la, lb = np.arange(len(a)), np.full(len(b), len(a))
                while True:  # the smallest row reachable inside the block
                    lb_new = np.minimum(lb, np.where(linked, la[:, None], len(a)).min(0))
                    la_new = np.minimum(la, np.where(linked, lb_new, len(a)).min(1))
                    if (la_new == la).all() and (lb_new == lb).all():
                        break
                    la, lb = la_new, lb_new
                for x, y in zip(a.tolist(), a[la].tolist(), strict=True):
                    self.unite(x, y)
                ok = lb < len(a)
                for x, y in zip(b[ok].tolist(), a[lb[ok]].tolist(), strict=True):
                    self.unite(x, y)

    def join(self, own: np.ndarray, guests: np.ndarray, within: bool = True) -> None:
        """Finds all links of ``own`` with each other (if ``within``) and with ``guests``.

        Each pivot's region holds the members nearest to it. A partner of one of them, within ``limit``, that is nearest
        to another pivot is at most 2 * limit further from this one than from its own, and within limit of the region's
        radius: such boundary sets are replicated to the region (of two regions, to the one with the smaller number).
        """
        if not len(own) or not len(own) + len(guests) > 1:
            return
        if len(own) + len(guests) <= self.leaf:
            return self.measure(own, guests, within)
        limit = 1 - self.percent / 100 + 1e-9
        every = np.concatenate([own, guests])
        pivots = own[np.linspace(0, len(own) - 1, min(PIVOTS, len(own))).astype(int)]
        inter = np.concatenate([self.common(every[i : i + self.leaf], pivots) for i in range(0, len(every), self.leaf)]).astype(np.float64)
        d = 1 - inter / (self.n[every][:, None] + self.n[pivots] - inter)
        home = d.argmin(1)
        mine = np.arange(len(every)) < len(own)
        near = d - d[np.arange(len(every)), home][:, None] <= 2 * limit
        parts, work = [], 0
        for i in range(len(pivots)):
            inside = mine & (home == i)
            if not inside.any():
                continue
            close = near[:, i] & (d[:, i] <= d[inside, i].max() + limit)
            visiting = close & (~mine | (home > i) if within else ~mine)
            parts.append((every[inside], every[visiting]))
            work += inside.sum() * (inside.sum() / 2 + visiting.sum())
        if work > 0.7 * len(own) * ((len(own) / 2 if within else 0) + len(guests)):  # too dense to be parted
            return self.measure(own, guests, within)
        for inside, visiting in parts:
            self.join(inside, visiting, within)


def _whole(size):
    """Adds the set (items) of the text."""

    def run(batches):
        for b in batches:
            at = 0
            for group in common.text_groups(b.column("text").to_pylist(), 1 << 21):
                part = b.slice(at, len(group)).drop_columns(["text"])
                at += len(group)
                sets = shingle_sets(group, size)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, items], [*part.schema.names, "items"])

    return run


def _joined(percent, leaf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid").sort_values(["label", "sid"], kind="stable").reset_index(drop=True)
        label, sid = pdf["label"].to_numpy(np.int64), pdf["sid"].to_numpy(np.int64)
        others, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        heads = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        side = (pdf["part"] == pdf["i"]).to_numpy()
        same = (pdf["i"] == pdf["j"]).to_numpy()
        for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(pdf)], strict=True):
            sets = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["items"].iloc[a:z]]
            cell = Cell(sets, pdf["copies"].to_numpy()[a:z], percent, leaf)
            here = np.arange(z - a)
            if same[a]:
                cell.join(here, here[:0])
            else:
                cell.join(here[side[a:z]], here[~side[a:z]], within=False)
            others[a:z] = cell.others
            root[a:z] = [a + cell.root(i) for i in range(z - a)]
        return pd.DataFrame({"sid": sid, "others": others, "root": sid[root]})

    return run


def links_and_roots(rows: DataFrame, sizes: DataFrame, labels: DataFrame, size: int, percent: int, cell_items: int, leaf: int) -> DataFrame:
    """sid, others (documents of other, linked sets), label (smallest sid of the component) for the sets of ``labels`` (node, label).

    Cells of fewer than ``cell_items`` shingles are dealt to buckets of about that size; a larger one is cut into parts
    and every pair of its parts is a task of its own.
    """
    of = sizes.join(labels.withColumnRenamed("node", "sid"), "sid").select("sid", "label", "n", "r", "copies")
    cells = common.durable(of.groupBy("label").agg(F.sum("n").alias("items"), F.count("*").alias("sets")))
    total = cells.agg(F.sum("items").alias("n"), F.max("items").alias("m")).first()
    buckets = max(1, -(-(total["n"] or 0) // cell_items))
    parts = F.ceil(F.col("items") / cell_items).cast("int")
    keys = of.join(common.small(cells.select("label", parts.alias("parts"))), "label")
    keys = common.durable(keys.select("r._k", "r._t", "sid", "label", "copies", "parts", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part")))
    common.sweep(rows.sparkSession)
    sets = common.matching(rows, keys, ["_k", "_t"]).drop("doc_id", "_k", "_t")
    sets = sets.select("sid", "label", "copies", "parts", "part", "text").mapInArrow(
        _whole(size), "sid long, label long, copies long, parts int, part int, items array<long>"
    )
    sets = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_other"))
    sets = sets.select(
        F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(buckets))).alias("cell"), (F.col("parts") > 1).alias("large"),
        F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j"), "part", "label", "sid", "copies", "items",
    )
    found = common.durable(sets.groupBy("large", "cell", "i", "j").applyInPandas(_joined(percent, leaf), "sid long, others long, root long"))
    common.discard(cells, keys)
    common.sweep(rows.sparkSession)
    if (total["m"] or 0) <= cell_items:
        return found.select("sid", "others", F.col("root").alias("label"))
    united = common.connected_components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("sid").agg(F.sum("others").alias("others"))
    return sums.join(united.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "others", F.coalesce("label", "sid").alias("label"))


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, share: float = 0.0002, most_frequent: int = 1_000_000, crowd: int = 64, cell_items: int = 2_000_000,
    doc_id: str = "doc_id", text: str = "text", row_keys: bool = False, leaf: int = LEAF,
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row per document.

    A document's set is that of its ``size``-word shingles after lower-casing A-Z (with fewer words, the whole sequence).
    Documents link if 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id reachable by links.
    n_links is the number of other documents that a document links with, copies too; every link between different sets is
    measured, but none is written out. Equal sets are one point of the space, so copies cost no pairs.
    ``row_keys`` adds _k and _t (``common.row_key``) and label, which names the component even where ids repeat and is null
    for an empty set. Shingles that more than ``share`` of the documents (or more than half of ``crowd``) hold come last in
    the order, which keeps common lines from forming regions; regions of more than ``crowd`` sets give no pairs but a
    chain. Sets are told apart by 128-bit hashes, and shingles compared by 64-bit hashes within a pair of sets.

    Texts without words (null and empty ones too) have an empty set and are alone: component_id is their own id, n_links 0. A null id is
    ignored for component_id unless all ids of the component are null. Rows that repeat an id are each a document.
    Other columns are ignored; empty input gives no rows.
    """
    common.ship_code(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *common.row_key())
    listed = common.durable(rows.mapInArrow(_identity(size), _LISTED))
    held = listed.filter("low is not null")
    # two sets with one first half: the second half names them (few at any size, if any)
    clashing = frozenset(r["low"] for r in held.groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b")).filter("a <> b").select("low").collect())
    sid = F.when(F.col("low").isin(*clashing), F.col("high")).otherwise(F.col("low")) if clashing else F.col("low")
    ids = listed.filter("h is null").select("doc_id", "_k", "_t", sid.alias("sid"), "n")
    sizes = ids.filter("sid is not null").groupBy("sid").agg(
        F.min("n").alias("n"), F.min(F.struct("_k", "_t")).alias("r"), F.count("*").alias("copies"), F.min("doc_id").alias("least")
    )
    sizes = common.durable(sizes)
    likely = candidates(rows, listed, sizes, clashing, size, percent, share, most_frequent, crowd)
    found = links_and_roots(rows, sizes, common.connected_components(likely), size, percent, cell_items, leaf)
    labelled = sizes.join(found, "sid", "left").select(
        "sid", F.coalesce("label", "sid").alias("label"), "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    labelled = common.durable(labelled)
    best = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = common.durable(labelled.join(best, "label").select("sid", "label", "component_id", "n_links"))
    out = ids.join(common.small(by_set), "sid", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        *(["_k", "_t", "label"] if row_keys else []),
    )
