"""Personal data: fixed patterns, and a skip-chain conditional random field that carries labels to similar tokens."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
ANY = re.compile(r"[0-9@]")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; each kind leftmost and non-overlapping; linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LETTERS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= len(m[0]) <= 40 and 14 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word: str) -> str:
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", word))[:16]


class Nodes:
    """Tokens with a digit or an at sign, of several texts, as one graph: features, chain edges and skip edges.

    ``span`` is the token without outer marks, ``label`` the kind of the base span that covers it (0: none), ``mention``
    numbers the base spans, so that a span of several tokens is masked as a whole.
    """

    FEATURES = 1 << 12
    MARKS = ".,;:!?()[]\"'"

    def __init__(self):
        self.span, self.doc, self.word, self.features, self.edges, self.label, self.mention = [], [], [], [], [], [], []

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        last, seen, at, before = None, {}, 0, ""
        tokens = TOKEN.finditer(text)
        m = next(tokens, None)
        words = 0
        while m is not None:
            after, words = next(tokens, None), words + 1
            if ANY.search(m[0]):
                while at < len(spans) and spans[at][2] <= m.start():
                    at += 1
                label, mention, j = 0, -1, at
                while j < len(spans) and spans[j][0] < m.end():
                    if spans[j][2] > m.start():
                        label, mention = spans[j][1] + 1, spans[j][0]
                        break
                    j += 1
                me = len(self.span)
                core = m[0].strip(self.MARKS)
                digits = re.sub("[^0-9]", "", core)
                parts = core.split(".")
                marks = {
                    "shape": _shape(m[0]), "core": _shape(core), "digits": min(len(digits), 20), "dots": core.count("."), "at": "@" in core,
                    "plus": m[0].startswith("+"), "length": min(len(core), 24) // 3, "luhn": 14 <= len(digits) <= 19 and luhn(digits),
                    "octets": len(parts) == 4 and all(x.isascii() and x.isdigit() and int(x[-9:]) <= 255 for x in parts),
                    "before": _shape(before), "after": _shape(after[0]) if after else "",
                }
                self.features.append([1 + zlib.crc32(f"{k}={v}".encode()) % (self.FEATURES - 1) for k, v in marks.items()])
                lead = len(m[0]) - len(m[0].lstrip(self.MARKS))
                self.span.append((m.start() + lead, m.start() + lead + len(core)))
                self.doc.append(doc)
                self.word.append(words)
                self.label.append(label)
                self.mention.append(mention)
                if last is not None and words - last[1] <= 2:
                    self.edges.append((last[0], me, 0))
                for key in {core.lower(), digits if len(digits) >= 6 else core.lower()}:  # repeated, or similar: the same digits
                    if key in seen:
                        self.edges.append((seen[key], me, 1))
                    seen[key] = me
                last = (me, words)
            m, before = after, m[0]


class SkipChain:
    """Node weights by feature, and tables for chain and for skip edges, trained together; sum-product message passing.

    Trained by gradient ascent on the likelihood of all labels of a text given part of them: spans drawn at random (the
    same in every run) are masked, the others are evidence. Tokens outside every base span count less (``unlabelled``), as
    the patterns miss some. The expected counts in the gradient are the beliefs of loopy
    message passing, for nodes and for edges.
    """

    EVIDENCE = 6.0

    def __init__(self):
        n = len(KINDS) + 1
        self.w = np.zeros((Nodes.FEATURES, n))
        self.pair = np.zeros((2, n, n))

    @staticmethod
    def _directed(nodes: Nodes):
        a, b, kind = np.array(nodes.edges, np.int64).reshape(-1, 3).T
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        return np.concatenate([a, b]), np.concatenate([b, a]), kind, back

    def _pass(self, z, graph, rounds, msg=None):
        """Messages and beliefs (log) after some rounds."""
        src, dst, kind, back = graph
        pair = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        msg = np.zeros((len(src), z.shape[1])) if msg is None else msg
        for _ in range(rounds if len(src) else 0):
            belief = z.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pair
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
        belief = z.copy()
        np.add.at(belief, dst, msg)
        return msg, belief, pair

    def fit(self, nodes: Nodes, rounds: int = 80, rate: float = 0.15, masked: float = 0.5, decay: float = 1e-3, unlabelled: float = 0.3) -> None:
        if not nodes.span:
            return
        x, y, n = np.array(nodes.features), np.array(nodes.label), len(KINDS) + 1
        graph = self._directed(nodes)
        half = len(graph[0]) // 2
        spots = np.array([zlib.crc32(f"{d}/{m}".encode()) for d, m in zip(nodes.doc, nodes.mention, strict=True)])
        want, rng, msg = np.eye(n)[y], np.random.default_rng(11), None
        weight = np.where(y > 0, 1.0, unlabelled)[:, None] / len(x)  # what the patterns miss may be personal data all the same
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (self.w, self.pair)]
        for step in range(1, rounds + 1):
            hidden = rng.random(1 << 12)[spots % (1 << 12)] < masked  # tokens of one span share their fate
            z = self.w[x].sum(1)
            z[np.arange(len(y)), y] += np.where((y > 0) & ~hidden, self.EVIDENCE, 0)
            msg, belief, pair = self._pass(z, graph, 3, msg)
            p = _softmax(belief, (1,))
            grad_w, grad_pair = -decay * self.w, -decay * self.pair
            np.add.at(grad_w, x.ravel(), np.repeat((want - p) * weight, x.shape[1], 0))
            if half:
                a, b, kind, back = graph[0][:half], graph[1][:half], graph[2], graph[3][:half]
                joint = _softmax((belief[a] - msg[back])[:, :, None] + (belief[b] - msg[:half])[:, None, :] + pair[:half], (1, 2))
                np.add.at(joint, (np.arange(half), y[a], y[b]), -1.0)
                np.add.at(grad_pair, kind, -joint * np.minimum(weight[a], weight[b])[:, :, None])
            for value, grad, (m, v) in zip((self.w, self.pair), (grad_w, grad_pair), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def posterior(self, nodes: Nodes, rounds: int = 10, evidence: np.ndarray | None = None) -> np.ndarray:
        """Marginals by loopy message passing; ``evidence`` tells whose labels are given (by default every base span's)."""
        z = self.w[np.array(nodes.features)].sum(1)
        y = np.array(nodes.label)
        given = y > 0 if evidence is None else (y > 0) & evidence
        z[np.arange(len(y)), y] += np.where(given, self.EVIDENCE, 0)
        return _softmax(self._pass(z, self._directed(nodes), rounds)[1], (1,))


def _softmax(z: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    p = np.exp(z - z.max(axes, keepdims=True))
    return p / p.sum(axes, keepdims=True)


def extra_spans(model: SkipChain, texts: list[str], bases: list[list[tuple[int, int, int]]], least: float, at_once: int = 100_000) -> list[list[tuple[int, int, int]]]:
    """What the field adds to each text: tokens of a kind with probability ``least`` or more that no base span touches.

    Neighbouring tokens of one telephone number are one span. Texts without tokens of the field cost nothing; no edge joins
    two texts, so they are judged in groups of about ``at_once`` tokens.
    """
    out = [[] for _ in texts]

    def judge(nodes: Nodes) -> None:
        if not nodes.span:
            return
        p = model.posterior(nodes)
        best = p.argmax(1)
        last = -2
        for i in np.flatnonzero((best > 0) & (p.max(1) >= least) & (np.array(nodes.label) == 0)).tolist():
            start, end = nodes.span[i]
            if start >= end:
                continue
            mine, kind = out[nodes.doc[i]], int(best[i]) - 1
            if kind == 3 and last == i - 1 and nodes.doc[last] == nodes.doc[i] and nodes.word[last] == nodes.word[i] - 1 and mine and mine[-1][1] == 3:
                mine[-1] = (mine[-1][0], 3, end)
            else:
                mine.append((start, kind, end))
            last = i

    nodes = Nodes()
    for i, (t, s) in enumerate(zip(texts, bases, strict=True)):
        if s or ANY.search(t):
            nodes.add(i, t, s)
        if len(nodes.span) >= at_once:
            judge(nodes)
            nodes = Nodes()
    judge(nodes)
    return out


def _graphs(batches):
    """The graph of each text, flat: what the fit needs, and no text."""
    for b in batches:
        rows = [[], [], [], [], [], []]
        for k, t, text in zip(b.column("_k").to_pylist(), b.column("_t").to_pylist(), b.column("text").to_pylist(), strict=True):
            nodes = Nodes()
            nodes.add(0, text or "", base_spans(text or ""))
            for col, v in zip(rows, (k, t, [f for x in nodes.features for f in x], nodes.label, nodes.mention, [e for x in nodes.edges for e in x]), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in _GRAPH.split(", ")])


_GRAPH = "_k long, _t long, features array<int>, label array<int>, mention array<int>, edges array<int>"


def fitting_graph(docs: DataFrame, most_sample: int, most_bytes: int = 100_000) -> Nodes:
    """One graph of about ``most_sample`` texts (fewer than ``most_bytes`` bytes each) with a digit or at sign, by the hash of their ids."""
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") < most_bytes)).select("text", *common.row_key())
    chosen = common.by_hash(some, "_k", most_sample, some.count())
    nodes = Nodes()
    for i, r in enumerate(sorted(chosen.mapInArrow(_graphs, _GRAPH).collect(), key=lambda r: (r["_k"], r["_t"]))):
        first, n = len(nodes.label), len(r["label"])
        width = len(r["features"]) // n if n else 0
        nodes.features += [r["features"][j * width : (j + 1) * width] for j in range(n)]
        nodes.label += r["label"]
        nodes.mention += r["mention"]
        nodes.doc += [i] * n
        nodes.span += [(0, 0)] * n
        nodes.edges += [(first + r["edges"][j], first + r["edges"][j + 1], r["edges"][j + 2]) for j in range(0, len(r["edges"]), 3)]
    return nodes


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _find(model, least):
    def run(batches):
        m = model.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            bases = [base_spans(t) if ANY.search(t) else [] for t in texts]
            more = extra_spans(m, texts, bases, least)
            counts = [[sum(k == kind for _, k, _ in s) for s in bases] for kind in range(4)]
            sha = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in bases]
            every = [_joined([*s, *x]) for s, x in zip(bases, more, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return run


def find_personal_data(docs: DataFrame, most_sample: int = 3000, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The patterns give the base spans (which the counts and base_sha256 are of). In every text, with base spans or
    without, each token with a digit or an at sign is a node of a conditional random field: neighbours are joined by chain edges, repeated tokens
    and tokens of the same digits by skip edges, so a number that is written again without its prefix gets its label.
    The field learns from the patterns' labels, some of them masked at a time, in about ``most_sample`` texts of fewer than
    100,000 bytes, those with the smallest hash of their id (this bounds the fit only; every text is judged whole). Spans
    are kind:start:end in code points, end exclusive, by start and then kind.

    Null and empty texts have no spans. Rows are judged one by one: repeated rows agree. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = SkipChain()
    model.fit(fitting_graph(rows, most_sample))
    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_find(spark.sparkContext.broadcast(model), least), out)
