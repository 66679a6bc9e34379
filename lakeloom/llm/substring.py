"""Repeated passages: compressed FM-indexes over wavelet matrices, one per shard, and matching statistics.

A passage is a window of ``size`` words. Windows are routed to shards by content: the smallest hash among a window's
word ``gram``-grams (its anchor) decides, so equal windows meet and most text, whose anchors occur once, goes nowhere.
A shard's index holds each distinct piece of text once, with its first place. Pieces are streamed through the index by
backward search; a window's interval has more than one row exactly if its words occur in more than one piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class WaveletMatrix:
    """Rank over a sequence of symbols below ``2 ** bits``: one bit vector a level, 64 bits a word, a count a word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        s = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            self.levels.append((BitRank(bit), int(len(bit) - bit.sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """For each pair: place of ``upto`` after sorting stably by symbol, within the block of ``symbol``; not yet less its start."""
        at = upto.copy()
        for level, (vector, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = vector.ones(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


class BitRank:
    """A bit vector in 64-bit words with a count a word: ones below a place."""

    def __init__(self, bit: np.ndarray):
        self.packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(64 + (-len(bit)) % 64, np.uint8)]), bitorder="little").view(np.uint64)
        self.counts = np.zeros(len(self.packed), np.int32)
        np.cumsum(np.bitwise_count(self.packed[:-1]), out=self.counts[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class Runs:
    """Where the rows that share a prefix begin and end: a bit a row, and the first row of each run."""

    def __init__(self, head: np.ndarray):
        self.bits, self.n = BitRank(head), len(head)
        self.first = np.append(np.flatnonzero(head), len(head)).astype(np.int32)

    def around(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.bits.ones(row + 1)
        return self.first[k - 1].astype(np.int64), self.first[k].astype(np.int64)


class FMIndex:
    """Index over pieces, each some words; exact for patterns of up to ``depth`` symbols (a power of two).

    Suffixes are sorted by their first ``depth`` symbols, which is all that backward search needs for such patterns.
    """

    def __init__(self, pieces: list[bytes], size: int):
        self.size = size
        words = b" \x00 ".join([*pieces, b""]).split()  # a word of one zero byte can't occur otherwise: see below
        if any(b"\x00" in p for p in pieces):
            words = [w for p in pieces for w in (*p.split(), None)]
            symbol = dict.fromkeys(words)
            symbol = {w: i for i, w in enumerate([None, *(w for w in symbol if w is not None)])}
        else:
            symbol = {w: i for i, w in enumerate(dict.fromkeys([b"\x00", *words]))}
        depth = 1
        while depth < size:
            depth *= 2
        text = np.fromiter(map(symbol.__getitem__, words), np.int64, len(words))
        self.end = np.flatnonzero(text == 0)  # of each piece: the place of its terminator, which is symbol 0
        self.length = np.diff(self.end, prepend=-1) - 1
        self.text, n = text, len(text)
        rank, width, kept = text, 1, {1: text}
        while True:
            shifted = np.zeros(n, np.int64)
            shifted[: n - width] = rank[width:]
            key = rank * (int(rank.max()) + 1) + shifted
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
            rank, width = new, width * 2
            kept = {width // 2: kept[width // 2], width: rank}
            if width >= depth:
                break
        self.parent = Runs(self._heads(order, kept[width // 2], size - 1 - width // 2))
        sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(sigma - 1).bit_length()))
        every = np.arange(sigma)
        self.start = self.bwt.rank(every, np.zeros(sigma, np.int64))

    @staticmethod
    def _heads(sa: np.ndarray, names: np.ndarray, more: int) -> np.ndarray:
        """Which rows differ from the one before in their first symbols: those that ``names`` tells apart, and ``more`` after."""
        a, b = names[sa], names[np.minimum(sa + more, len(names) - 1)]
        return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Place in the text and lowest row of every window of ``size`` symbols, by matching statistics from right to left.

        All pieces advance together, a symbol a step: once ``size`` symbols match, the interval is widened to its parent
        of ``size - 1`` symbols (dropping the rightmost) and extended to the left again.
        """
        by = np.argsort(-self.length, kind="stable")
        end, length = self.end[by], self.length[by]
        lo, hi = np.zeros(len(by), np.int64), np.full(len(by), len(self.text), np.int64)
        places, rows = [], []
        for step in range(int(length[0])):
            m = int(np.searchsorted(-length, -step, side="left"))  # pieces longer than step
            at = end[:m] - 1 - step
            c, l, h = self.text[at], lo[:m], hi[:m]
            if step >= self.size:
                l, h = self.parent.around(l)
            base = self.first[c] - self.start[c]
            l, h = base + self.bwt.rank(c, l), base + self.bwt.rank(c, h)
            lo[:m], hi[:m] = l, h
            if step >= self.size - 1:
                places.append(at)
                rows.append(l)
        return np.concatenate(places), np.concatenate(rows)


def first_places(texts: list[bytes], doc: np.ndarray, tie: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The first place of every distinct window of the pieces ``texts``, as runs (doc, tie, from, to).

    Piece i holds the words of (doc, tie) from word ``start[i]``. Words are compared as they are, not by hash.
    """
    index = FMIndex(texts, size)
    at, row = index.windows()
    begin = index.end - index.length
    piece = np.searchsorted(index.end, at)
    order = np.lexsort((tie, doc))
    same = np.concatenate([[0], np.cumsum((np.diff(doc[order]) != 0) | (np.diff(tie[order]) != 0))])
    number = np.empty(len(doc), np.int64)
    number[order] = same
    names = order[np.concatenate([[True], np.diff(same) != 0])]
    place = (number[piece] << 32) | (start[piece] + at - begin[piece])
    by = np.argsort(row, kind="stable")  # the lowest row of a window's interval names its words
    heads = np.flatnonzero(np.concatenate([[True], np.diff(row[by]) != 0]))
    least = np.sort(np.minimum.reduceat(place[by], heads))
    heads = np.concatenate([[True], np.diff(least) != 1])
    ends = np.concatenate([heads[1:], [True]])
    who = names[least[heads] >> 32]
    return doc[who], tie[who], least[heads] & 0xFFFFFFFF, (least[ends] & 0xFFFFFFFF) + 1


#: A run of windows is cut after so many, so that no piece of text is longer, however often one phrase repeats.
MOST_RUN = 1024


def _anchors(hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, from, to, times): runs of windows that share their anchor, of ``MOST_RUN`` at most; times is 2 if it may repeat inside its run."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    g, need, have = common.gram_hashes(hashes, gram), size - gram + 1, 1
    every = np.sort(g)
    again = every[1:][every[1:] == every[:-1]]
    while have < need:
        step = min(have, need - have)
        g = np.minimum(g[: len(g) - step], g[step:])
        have += step
    change = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    if np.diff(np.append(change, n)).max() > MOST_RUN:
        since = np.arange(n) - np.repeat(change, np.diff(np.append(change, n)))
        heads = np.flatnonzero(since % MOST_RUN == 0)
    else:
        heads = change
    times = 1 + np.isin(g[heads], again) if len(again) else np.ones(len(heads), np.int64)
    return g[heads], heads, np.concatenate([heads[1:], [n]]), times


def _list_anchors(size, gram):
    def run(batches):
        for b in common.text_slices(batches):
            ks, ts, hs, fs, es, ns = [], [], [], [], [], []
            words, begin = common.word_hashes([(x or "").encode() for x in b.column("text").to_pylist()])
            for i, (k, t) in enumerate(zip(b.column("_k").to_pylist(), b.column("_t").to_pylist(), strict=True)):
                h, f, e, n = _anchors(words[begin[i] : begin[i + 1]], size, gram)
                ks.append(np.full(len(h), k, np.int64))
                ts.append(np.full(len(h), t, np.int64))
                hs.append(h)
                fs.append(f)
                es.append(e)
                ns.append(n)
            if ks:
                cols = [np.concatenate(x) for x in (ks, ts, hs, fs, es, ns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].view(np.int64)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4].astype(np.int32)), pa.array(cols[5].astype(np.int32))],
                    ["_k", "_t", "anchor", "begin", "end", "times"],
                )

    return run


def _flat(column, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(first, last, *fields) of a column of lists of structs: where each row's items stand, and the items end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    items = column.flatten()
    count = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    last = np.cumsum(count)
    return last - count, last, *[np.asarray(items.field(n)) for n in names]


def _list_pieces(size):
    def run(batches):
        for b in common.text_slices(batches):
            first, last, begins, ends, anchors, hot = _flat(b.column("runs"), ("begin", "end", "anchor", "hot"))
            begins, ends, anchors, hot = begins.tolist(), ends.tolist(), anchors.tolist(), hot.tolist()
            routes, pieces, starts, rows = [], [], [], []
            for i, (text, x, y) in enumerate(zip(b.column("text").to_pylist(), first.tolist(), last.tolist(), strict=True)):
                words = (text or "").encode().split()
                for j in range(x, y):
                    if hot[j]:  # one window at a time, dealt by its own words; of equal ones in a run the first
                        seen = set()
                        for s in range(begins[j], ends[j]):
                            piece = b" ".join(words[s : s + size])
                            if piece not in seen:
                                seen.add(piece)
                                routes.append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                                pieces.append(piece)
                                starts.append(s)
                    else:
                        routes.append(anchors[j])
                        pieces.append(b" ".join(words[begins[j] : ends[j] + size - 1]))
                        starts.append(begins[j])
                rows.append(len(routes))
            each = np.repeat(np.arange(b.num_rows), np.diff(rows, prepend=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(routes, pa.int64()), pa.array(pieces, pa.binary()), b.column("_k").take(pa.array(each)), b.column("_t").take(pa.array(each)), pa.array(starts, pa.int32())],
                ["route", "piece", "_k", "_t", "start"],
            )

    return run


def _index_shard(size):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, tie, f, e = first_places(
            pdf["piece"].tolist(), pdf["_k"].to_numpy(np.int64), pdf["_t"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), size
        )
        return pd.DataFrame({"_k": doc, "_t": tie, "begin": f.astype(np.int32), "end": e.astype(np.int32)})

    return run


def _removed(n_words: int, runs: tuple[np.ndarray, np.ndarray], firsts: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Which words lie in a window that starts earlier elsewhere: candidate windows less the first places."""
    window = np.zeros(n_words + 1, np.int32)
    np.add.at(window, runs[0], 1)
    np.add.at(window, runs[1], -1)
    first = np.zeros(n_words + 1, np.int32)
    np.add.at(first, firsts[0], 1)
    np.add.at(first, firsts[1], -1)
    at = np.flatnonzero((np.cumsum(window) > 0) & (np.cumsum(first) == 0))
    edge = np.zeros(n_words + 1, np.int32)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def _keep(size):
    def run(batches):
        for b in common.text_slices(batches):
            rx, ry, rb, re = _flat(b.column("runs"), ("begin", "end"))
            fx, fy, fb, fe = _flat(b.column("firsts"), ("begin", "end"))
            removed, sha, spans = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = (text or "").encode().split()
                r, f = slice(rx[i], ry[i]), slice(fx[i], fy[i])
                gone = _removed(len(words), (rb[r], re[r]), (fb[f], fe[f]), size)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                removed.append(int(gone.sum()))
                spans.append(",".join(f"{x}:{y}" for x, y in zip(edges[::2], edges[1::2], strict=True)))
                kept, at = [], 0
                for x, y in zip([*edges[::2], len(words)], [*edges[1::2], None], strict=True):
                    kept += words[at:x]
                    at = y
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("_k"), b.column("_t"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["_k", "_t", "n_removed", "kept_sha256", "removed_spans"],
            )

    return run


def _whole(batches):
    for b in common.text_slices(batches):
        words = [(x or "").encode().split() for x in b.column("text").to_pylist()]
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_k"), b.column("_t"), pa.array(list(map(len, words)), pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "_k", "_t", "n_words", "all_sha256"],
        )


def repeated_passages(docs: DataFrame, size: int = 20, gram: int = 8, hot: int = 512, shard_words: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed_spans (word positions ``from:to``), one row per document.

    A word goes if a window of ``size`` words over it starts earlier in the corpus: at a smaller doc_id, or earlier in
    the same document. Anchors that more than ``hot`` runs share (a phrase repeated on and on is many runs) are dealt out by whole windows instead, so a
    passage that a third of all documents hold does not fill one shard. Equal pieces are combined before the shuffle.

    Null and empty texts have no words. A null doc_id comes before all others; among rows of one doc_id but different
    texts a hash of the text decides; rows that repeat id and text count as one and get the same result.
    Documents of fewer than ``size`` words lose nothing. Other columns are ignored; empty input gives no rows.
    """
    common.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *common.row_key())
    listed = rows.mapInArrow(_list_anchors(size, gram), "_k long, _t long, anchor long, begin int, end int, times int")
    times = listed.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1")
    times = common.durable(times.select("anchor", (F.col("n") > hot).alias("hot")))
    runs = (
        listed.drop("times").join(times, "anchor")
        .groupBy("_k", "_t")
        .agg(F.collect_set(F.struct("begin", "end", "anchor", "hot")).alias("runs"))
    )
    held = common.durable(rows.join(runs, ["_k", "_t"]).select("_k", "_t", "text", "runs"))
    total = held.select(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"] + size - 1)).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // shard_words))
    pieces = held.mapInArrow(_list_pieces(size), "route long, piece binary, _k long, _t long, start int")
    place = F.struct("_k", "_t", "start")
    pieces = pieces.groupBy("route", "piece").agg(F.min(place).alias("p"))
    pieces = pieces.select(F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int").alias("_shard"), "piece", "p._k", "p._t", "p.start")
    firsts = pieces.groupBy("_shard").applyInPandas(_index_shard(size), "_k long, _t long, begin int, end int")
    firsts = firsts.groupBy("_k", "_t").agg(F.collect_list(F.struct("begin", "end")).alias("firsts"))
    cut = held.join(firsts, ["_k", "_t"], "left").mapInArrow(_keep(size), "_k long, _t long, n_removed long, kept_sha256 string, removed_spans string")
    cut = cut.dropDuplicates(["_k", "_t"])
    whole = rows.mapInArrow(_whole, "doc_id long, _k long, _t long, n_words long, all_sha256 string")
    return whole.join(cut, ["_k", "_t"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
        F.coalesce("removed_spans", F.lit("")).alias("removed_spans"),
    )


#: The same rows in SQL, by writing out every window.
SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS s FROM w)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM dup) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: ps IS NULL OR NOT list_contains(ps, i - 1)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
