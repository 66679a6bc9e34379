"""Packing tokenised documents into sequences by vector best fit."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
TAIL = "([0-9A-Za-z])([" + "".join(f"\\x{b:02x}" for b in MARKS) + "]+)([\\x09-\\x0D\\x20]|$)"  # a word's marks behind a letter or digit
PLAIN = re.compile("[a-zß-öø-ÿ]+")  # lower-case letters that no normaliser changes and no pre-tokeniser parts
BYTES = {c: chr(0xC3) + chr(b if b > 0xA0 and b != 0xAD else 323 if b == 0xAD else b + 162) for c in range(0xDF, 0x100) if c != 0xF7 for b in chr(c).encode()[1:]}  # as byte-level models spell them
WORD_BYTES = 112  # a remembered word takes about so much besides its letters and ids (of four bytes, no more than one for each byte of letters)
SEPARATOR = b"\x7f"  # a token of its own between spaces; words that hold it are encoded singly


class WordTokens(dict):
    """word (UTF-8, without ASCII white space) -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokeniser never joins characters across white space, so a text's ids are those of its words
    in order; words last in use are remembered, up to about twice ``most`` bytes besides the words of the texts at hand. New
    words of plain letters go straight to the tokeniser's model, where that was found to give the same; others are encoded many
    at a time, as one text with ``SEPARATOR`` between words, whose token tells which ids belong to which word.
    """

    def __init__(self, vocabulary: str, most: int = 40 << 20, at_once: int = 4096):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.held, self.at_once, self.old = Tokenizer.from_str(vocabulary), most, 0, at_once, {}
        (self.separator,) = self._ids(SEPARATOR.decode())
        # A-Z mean no more than a-z, beside other letters too
        self.folds = all(self._ids(w) == self._ids(w.encode().lower().decode()) for w in ("The", "THE", "WORLD", "Xq", "ÉA", "Éa", "Aß", "IÏI", "AΣ", "ΣA", "A\u0301", "漢A"))

        probe = [f"{x}{chr(c)}{y}" for c in [*range(97, 123), *BYTES] for x, y in (("", ""), ("the", "ing"), ("é", "qx"), ("zu", "ß"))]
        added = any(PLAIN.search(x.content) and "<|" not in x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.direct = not added and all(self._model(w) == self._ids(w) for w in probe)

    def _model(self, word: str) -> list[int]:
        return [x.id for x in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(BYTES))]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, words: list[bytes]) -> None:
        """Remember ``words``, as they are."""
        alone = [w for w in words if b"<|" in w or SEPARATOR in w]  # may hold a special token, or what parts the others
        for w in alone:
            ids = self._ids(w.decode())
            self[w] = struct.pack(f"<{len(ids)}I", *ids)
        if alone:
            words = [w for w in words if w not in self]
        if self.direct:
            tokenize, others = self.tokenizer.model.tokenize, []
            for w in words:
                if PLAIN.fullmatch(text := w.decode()):
                    ids = [x.id for x in tokenize(text if text.isascii() else text.translate(BYTES))]
                    self[w] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    others.append(w)
            words = others
        between = b" " + SEPARATOR + b" "
        for i in range(0, len(words), self.at_once):
            some = words[i : i + self.at_once]
            ids = np.array(self._ids((between.join(some) + between).decode()), "<u4")
            ends = np.flatnonzero(ids == self.separator)
            if len(ends) != len(some):
                raise ValueError("the vocabulary joins words")
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * ends).tolist(), strict=True):
                self[w] = raw[start:end]
                start = end + 4

    def learn(self, words: list[bytes]) -> None:
        """Remember every one of the distinct ``words``; the ids of a word in capitals, or with marks behind, are put together from plainer words."""
        if self.held >= self.most:  # words in use move over from the older half
            self.old = None
            self.old, self.held = dict(self), 0
            self.clear()
        words = [w for w in words if w not in self]
        before, letters = len(self), sum(map(len, words))
        if self.old:
            new = []
            for w in words:
                if (ids := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self[w] = ids
            words = new
        plain, marked, bases, capitals = set(), [], [], []
        for w in words:
            base = w
            if w and w[-1] in MARKS and b"<|" not in w:
                base = w.rstrip(MARKS)
                if base[-1:].isalnum():  # marks after a letter or digit are encoded on their own
                    marked.append(w)
                    bases.append(base)
                    plain.add(w[len(base) :])
                else:
                    base = w
            if self.folds and base.isascii() and b"<|" not in base and (low := base.lower()) != base:
                capitals.append(base)
                base = low
            plain.add(base)
        self.encode([w for w in plain if w not in self])
        for w in capitals:
            self[w] = self[w.lower()]
        for w, base in zip(marked, bases, strict=True):
            self[w] = self[base] + self[w[len(base) :]]
        self.held += WORD_BYTES * (len(self) - before) + 5 * letters

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Equal words of the texts are looked up once, marks behind a word as a word of their own, and A-Z as a-z where they mean the same."""
        column = pa.array(texts, pa.large_string())
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # no special token can be there
            column = pc.replace_substring_regex(pc.ascii_lower(column) if self.folds else column, TAIL, r"\1 \2\3")
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.learn(words)
        found = [self[w] for w in words]
        ids, n = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, codes = np.cumsum(n) - n, coded.indices.to_numpy()
        ends, out, at = split.offsets.to_numpy().tolist(), [], 0
        kind = np.int32 if len(ids) + 4096 * len(codes) < 1 << 31 else np.int64
        while at < len(texts):  # the ids of some words at a time
            stop = at + 1
            while stop < len(texts) and ends[stop + 1] - ends[at] <= 1 << 17:
                stop += 1
            here = codes[ends[at] : ends[stop]]
            size = n[here]
            upto = np.concatenate([[0], np.cumsum(size)])
            at_id = np.repeat((begin[here] - upto[:-1]).astype(kind), size)
            at_id += np.arange(upto[-1], dtype=kind)
            raw = ids[at_id].tobytes()
            cuts = (4 * upto[np.array(ends[at : stop + 1]) - ends[at]]).tolist()
            out += [raw[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            at = stop
        return out


_tokens: dict[int, WordTokens] = {}


def _pieces(vocabulary, limit: int, end_id: int):
    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = zlib.crc32(vocabulary.value.encode())
        if key not in _tokens:
            _tokens[key] = WordTokens(vocabulary.value)
        t, end, step = _tokens[key], struct.pack("<I", end_id), 4 * limit
        for b in common.text_slices(batches, 1 << 22):
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, raw in zip(b.column("doc_id").to_pylist(), t.of([x or "" for x in b.column("text").to_pylist()]), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, closed by ``end_id``, cut only where it is longer than ``limit``."""
    common.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with open(vocabulary, encoding="utf-8") as f:  # executors need not see the driver's file
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return rows.mapInArrow(_pieces(shared, limit, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, capacity: tuple[float, float, float], rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the order of bins is that of their opening.

    An item takes (tokens, 1 document, length squared as attention cost); a bin holds ``capacity`` of each. Items go in
    by falling length. Every open bin that has room in every dimension is scored: by the weighted dot-product of item and
    residual, both relative to capacity (smallest first: the bin it fills most closely), or by the norm of what would be
    left (``rule`` "norm"); of equal scores the bin opened first is taken, and a bin opens only if none has room. Bins too
    full for the smallest item are no longer looked at.
    """
    cap, weight = np.array(capacity, float), np.array([1.0, 0.05, 0.05])
    order = np.argsort(-length, kind="stable")
    least = int(length.min()) if len(length) else 0
    left = np.empty((3, len(length)))  # of open bins: what is left of each capacity
    name = np.empty(len(length), np.int64)
    bins, offsets, n_open, n_bins = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0, 0
    for i in order:
        n = int(length[i])
        item = np.array([n, 1.0, float(n) * n])
        rest = left[:, :n_open]
        room = (rest >= item[:, None]).all(0)
        if room.any():
            if rule == "dot":
                score = (weight * item / cap / cap) @ rest
            else:
                score = weight @ ((rest - item[:, None]) / cap[:, None]) ** 2
            at = int(np.where(room, score, np.inf).argmin())
        else:
            at = n_open
            left[:, at], name[at] = cap, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = name[at], cap[0] - left[0, at]
        left[:, at] -= item
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # closed; the others keep their order
            left[:, at : n_open - 1] = left[:, at + 1 : n_open].copy()
            name[at : n_open - 1] = name[at + 1 : n_open].copy()
            n_open -= 1
    return bins, offsets


def _packed(capacity, rule):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, rule)
        shard = int(pdf["_shard"].iloc[0])
        pdf["sequence_id"] = (np.int64(shard) << np.int64(32)) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="_shard")

    return pack


def pack_documents(
    docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 0, most_documents: int | None = None,
    most_cost: float | None = None, shard_pieces: int = 8192, rule: str = "dot",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document, placed.

    Pieces are dealt by hash to shards of about ``shard_pieces`` each and packed there; a shard leaves a few bins
    partly empty. By default documents and attention cost bind no earlier than tokens do (a sequence of ``limit`` tokens
    has at most ``limit`` documents and a cost of at most limit squared): a smaller capacity would need more sequences.
    They still weigh in the choice of a bin.
    A null text is empty (one piece, the end id); rows that repeat an id are packed each on its own; a null id is
    dealt like any other. Other columns are ignored; empty input gives no rows.
    """
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    pieces = common.durable(token_pieces(docs, vocabulary, limit, end_id))
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    capacity = (float(limit), float(most_documents or limit), float(most_cost or limit * limit))
    return dealt.groupBy("_shard").applyInPandas(_packed(capacity, rule), out)
