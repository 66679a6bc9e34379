"""Toxicity by a small convolutional text classifier trained in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15  # of a row number: three fit one integer
EDGE = ".,;:!?#*$%&|<>()[]{}\"'`~-_=+/"


class WordRows(dict):
    """word (bytes) -> the numbers of its embedding rows in one integer: the word's, and those of its first 4 and 5 characters.

    Case and punctuation at the ends don't count; row 0 is padding, also for a part that a short word doesn't have.
    """

    def __missing__(self, raw: bytes) -> int:
        import xxhash

        if len(self) >= 400_000:
            self.clear()
        word = raw.decode("utf-8", "replace").strip(EDGE).lower()
        row = lambda x: 1 + xxhash.xxh3_64_intdigest(x) % ((1 << BITS) - 1)
        out = row(word) if word else 0
        for k, n in enumerate((4, 5), 1):
            if len(word) > n:
                out |= row(f"{n}{word[:n]}") << (BITS * k)
        self[raw] = out
        return out


_rows = WordRows()


def word_ids(text: str | None) -> np.ndarray:
    """(words, 3): embedding rows of the words of a text; a text without words is one padding word."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros((1, 3), np.int32)
    packed = np.fromiter(map(_rows.__getitem__, words), np.int64, len(words))
    mask = (1 << BITS) - 1
    return np.stack([packed & mask, packed >> BITS & mask, packed >> (2 * BITS)], 1).astype(np.int32)


class ConvText:
    """Hashed word embeddings, filters of several widths, maximum over the text, logistic output.

    ``forward`` takes documents laid end to end; windows that reach past a document's end see padding.
    """

    def __init__(self, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, seed: int = 7):
        rng, buckets = np.random.default_rng(seed), 1 << BITS
        self.buckets, self.widths = buckets, widths
        self.p = {"E": rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), "out": rng.normal(0, 0.3, filters * len(widths)).astype(np.float32), "b": np.zeros(1, np.float32)}
        for w in widths:
            self.p[f"W{w}"] = rng.normal(0, 0.5, (w, dim, filters)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(filters, np.float32)
        self.p["E"][0] = 0
        self.scale = np.array([1.0, 0.0], np.float32)  # calibration of the output

    def _embedded(self, ids: np.ndarray) -> np.ndarray:
        table = self.p["E"]
        return table[ids[..., 0]] + table[ids[..., 1]] + table[ids[..., 2]]

    def _pooled(self, ids: np.ndarray, starts: np.ndarray, where: bool):
        """Maximum of each filter in each document, after relu; and the places of the maxima if asked for."""
        ends = np.append(starts[1:], len(ids))
        e = self._embedded(ids)
        out, at = [], []
        for w in self.widths:
            k = self.p[f"W{w}"]
            s = e @ k[0]
            for j in range(1, w):
                part = e[j:] @ k[j]
                cut = ends[:, None] - 1 - np.arange(j)  # last words of a document have no word j places on
                part[cut[(cut >= 0) & (cut < len(part)) & (cut >= starts[:, None])]] = 0
                s[:-j] += part
            s += self.p[f"c{w}"]
            top = np.maximum.reduceat(s, starts, axis=0)
            if where:
                row = np.repeat(np.arange(len(starts)), ends - starts)
                place = np.empty(top.shape, np.int64)
                for f in range(top.shape[1]):
                    hit = np.flatnonzero(s[:, f] == top[row, f])
                    place[row[hit[::-1]], f] = hit[::-1]
                at.append(place)
            out.append(np.maximum(top, 0))
        return np.concatenate(out, 1), at, ends

    def logit(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._pooled(ids, starts, False)[0] @ self.p["out"] + self.p["b"]

    def start(self, hits: np.ndarray, total: np.ndarray) -> None:
        """Embeddings start with a column of log odds: ``hits`` has the documents of each class that hold a row, ``total`` those of each class."""
        odds = np.log((hits[1] + 0.5) / (total[1] + 1)) - np.log((hits[0] + 0.5) / (total[0] + 1))
        odds[hits.sum(0) < 3] = 0
        self.p["E"][:, 0] = np.clip(odds, -3, 3)
        self.p["E"][0] = 0
        for w in self.widths:
            self.p[f"W{w}"][0, 0, : max(1, self.p[f"W{w}"].shape[2] // 2)] = 1

    def train(self, docs: list[np.ndarray], y: np.ndarray, total: np.ndarray, epochs: int = 6, batch: int = 64, most_words: int = 200_000, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on cross-entropy weighted by ``total`` of each class; the gradient passes through the maxima only.

        A batch has fewer documents where they have more than ``most_words`` words together.
        """
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, total.sum() / (2 * max(1, total[1])), total.sum() / (2 * max(1, total[0])))
        length = np.array([len(d) for d in docs], np.int64)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order, lo = rng.permutation(len(docs)), 0
            while lo < len(order):
                pick = order[lo : lo + batch]
                pick = pick[: max(1, int(np.searchsorted(np.cumsum(length[pick]), most_words, side="right")))]
                lo += len(pick)
                starts = np.cumsum([0, *[len(docs[i]) for i in pick[:-1]]])
                ids = np.concatenate([docs[i] for i in pick]).astype(np.int32)
                pooled, at, ends = self._pooled(ids, starts, True)
                z = pooled @ self.p["out"] + self.p["b"]
                dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                g = {"out": pooled.T @ dz, "b": np.array([dz.sum()], np.float32)}
                rows, parts, f0 = [], [], 0
                for w, place in zip(self.widths, at, strict=True):
                    k, nf = self.p[f"W{w}"], place.shape[1]
                    d = dz[:, None] * self.p["out"][f0 : f0 + nf] * (pooled[:, f0 : f0 + nf] > 0)
                    f0 += nf
                    g[f"c{w}"], g[f"W{w}"] = d.sum(0), np.zeros_like(k)
                    for j in range(w):
                        spot = place + j
                        ok = spot < ends[:, None]
                        word = ids[np.minimum(spot, len(ids) - 1)]
                        dj = d * ok
                        g[f"W{w}"][j] = np.einsum("bfd,bf->df", self._embedded(word), dj)
                        back = (dj[:, :, None] * k[j].T[None]).reshape(-1, k.shape[1])
                        for part in range(3):
                            rows.append(word[..., part].ravel())
                            parts.append(back)
                step += 1
                r, back = np.unique(np.concatenate(rows), return_inverse=True)
                ge = np.zeros((len(r), self.p["E"].shape[1]), np.float32)
                np.add.at(ge, back, np.concatenate(parts))
                fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for key, grad in g.items():
                    m[key] += 0.1 * (grad - m[key])
                    v[key] += 0.001 * (grad * grad - v[key])
                    self.p[key] -= (fix * m[key] / (np.sqrt(v[key]) + 1e-8)).astype(np.float32)
                m["E"][r] += 0.1 * (ge - m["E"][r])
                v["E"][r] += 0.001 * (ge * ge - v["E"][r])
                self.p["E"][r] -= fix * m["E"][r] / (np.sqrt(v["E"][r]) + 1e-8)
                self.p["E"][0] = 0


def _logits(model: ConvText, docs: list[np.ndarray], at_once: int = 200_000) -> np.ndarray:
    """Logits of many documents, about ``at_once`` words at a time."""
    out, held, words = [], [], 0

    def flush():
        out.append(model.logit(np.concatenate(held).astype(np.int32), np.cumsum([0, *map(len, held[:-1])])))

    for d in docs:
        if held and words + len(d) > at_once:
            flush()
            held, words = [], 0
        held.append(d)
        words += len(d)
    if held:
        flush()
    return np.concatenate(out) if out else np.empty(0)


def _scores(model: ConvText, docs: list[np.ndarray]) -> np.ndarray:
    z = model.scale[0] * _logits(model, docs) + model.scale[1]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


#: Logits of the calibration are counted in bins, so many to one.
BINS = 1024


def _cut(at: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float | None:
    """The logit of best F1, midway between neighbouring bins ``at`` of ``n`` rows, ``toxic`` of them so labelled; None without both classes."""
    if not 0 < toxic.sum() < n.sum():
        return None
    order = np.argsort(-at)
    z, hit = at[order] / BINS, np.cumsum(toxic[order])
    i = int(np.argmax(2 * hit / (np.cumsum(n[order]) + toxic.sum())))
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i]) - 0.5 / BINS


_PACKED = "aside boolean, part int, ids binary, words binary, toxic binary, langs array<string>"


def _pack(pdf):
    """The rows of a part as one: their word ids end to end, numbers of words, labels and languages."""
    import pandas as pd

    pdf = pdf.sort_values(["doc_id", "text"], kind="stable", na_position="first")
    docs = [word_ids(t).astype(np.uint16) for t in pdf["text"]]
    return pd.DataFrame([{
        "aside": pdf["aside"].iloc[0], "part": pdf["part"].iloc[0], "ids": np.concatenate(docs).tobytes(), "words": np.array([len(d) for d in docs], np.int64).tobytes(),
        "toxic": pdf["toxic"].to_numpy(np.int8).tobytes(), "langs": pdf["lang"].tolist(),
    }])


def _unpacked(row) -> tuple[list[np.ndarray], np.ndarray]:
    ids, words = np.frombuffer(row.ids, np.uint16).reshape(-1, 3), np.frombuffer(row.words, np.int64)
    return np.split(ids, np.cumsum(words)[:-1]), np.frombuffer(row.toxic, np.int8).astype(np.float32)


def _summed(vectors: DataFrame, parts: int, fan: int = 16) -> np.ndarray:
    """The sum of the rows (part, vec: float32 as bytes), ``fan`` at a time; at most so many come to the driver."""

    def add(pdf):
        import pandas as pd

        vecs = [np.frombuffer(v, np.float32) for v in pdf.sort_values("part")["vec"]]
        return pd.DataFrame({"part": [int(pdf["part"].min()) // fan], "vec": [np.sum(vecs, 0).tobytes()]})

    while parts > fan:
        vectors = vectors.groupBy(F.floor(F.col("part") / fan)).applyInPandas(add, "part int, vec binary")
        parts = -(-parts // fan)
    rows = vectors.collect()
    return np.sum([np.frombuffer(r["vec"], np.float32) for r in sorted(rows, key=lambda r: r["part"])], 0)


def _each(packed: DataFrame, f) -> DataFrame:
    """(part, vec): ``f`` of the documents and labels of each part."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples():
                yield pd.DataFrame({"part": [row.part], "vec": [f(*_unpacked(row)).astype(np.float32).tobytes()]})

    return packed.mapInPandas(run, "part int, vec binary")


def _hits(docs, y) -> np.ndarray:
    hits = np.zeros((2, 1 << BITS), np.float32)
    for d, t in zip(docs, y, strict=True):
        hits[int(t)][np.unique(d)] += 1
    return np.concatenate([hits.ravel(), [len(y) - y.sum(), y.sum()]])


def fit(packed: DataFrame, parts: int, epochs: int = 6) -> tuple[ConvText, dict[str, float]]:
    """Model and thresholds by language from all rows of ``packed``: parts not aside train, the others calibrate.

    Each part is trained on by a task of its own; after each epoch the parameters are averaged by numbers of rows. A
    single part is trained on without a stop.
    """
    spark, model = packed.sparkSession, ConvText()
    train, aside = packed.filter("not aside"), packed.filter("aside")
    counted = _summed(_each(train, _hits), parts)
    total = counted[-2:].astype(np.float64) if np.size(counted) > 1 else np.zeros(2)
    if not total.all():
        model.p["out"][:] = 0  # nothing to learn from: every score is one half, less a little
        model.scale = np.array([1.0, -0.1], np.float32)
        return model, {}
    model.start(counted[:-2].reshape(2, -1), total)
    for i in range(1 if parts == 1 else epochs):
        shared = spark.sparkContext.broadcast(model.p)

        def one(docs, y, shared=shared, i=i):
            m = ConvText()
            m.p = {k: v.copy() for k, v in shared.value.items()}
            m.train(docs, y, total, epochs if parts == 1 else 1, seed=11 + i)
            return np.concatenate([v.ravel() for v in m.p.values()]) * (len(y) / total.sum())

        flat, at = _summed(_each(train, one), parts), 0
        for k, v in model.p.items():
            model.p[k], at = flat[at : at + v.size].reshape(v.shape).copy(), at + v.size
        shared.destroy()
    shared = spark.sparkContext.broadcast(model)

    def bins(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples():
                docs, y = _unpacked(row)
                z = np.clip(_logits(shared.value, docs), -32, 32)
                yield pd.DataFrame({"lang": list(row.langs), "at": np.rint(z * BINS).astype(np.int64), "toxic": y.astype(np.int64)})

    held = aside.mapInPandas(bins, "lang string, at long, toxic long").groupBy("lang", "at").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas()
    cut = _cut(*(held.groupby("at").sum(numeric_only=True).reset_index()[c].to_numpy() for c in ("at", "n", "toxic"))) or 0.0
    model.scale = np.array([1.0, -cut], np.float32)  # one half lies where F1 is best over all languages
    cuts = {}
    for lang, of in held.groupby("lang"):
        z = _cut(*(of[c].to_numpy() for c in ("at", "n", "toxic")))
        cuts[lang] = 0.5 if z is None else float(1 / (1 + np.exp(cut - z)))
    return model, cuts


def _apply(model):
    def run(batches):
        m = model.value
        for b in common.text_slices(batches):
            texts = b.column("text").to_pylist()
            s = _scores(m, [word_ids(t) for t in texts])
            ids = b.column("doc_id").to_pylist()
            fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(fold), pa.array(s, pa.float64())], ["doc_id", "lang", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, part_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged.

    The classifier learns from every labelled row whose crc32(doc_id as text) mod 5 is not 0, its text whole: by the hash of their ids a
    quarter of them calibrates, the others train, in parts of about ``part_bytes`` bytes. Only the words of a text decide its score; predicted is 1 from
    0.5 on. flagged applies the threshold calibrated for the row's language (0.5 for languages not seen).

    Null and empty texts are one padding word and get a score too. Without labels of both kinds every score lies just
    below 0.5. Null ids are never learnt from; repeated rows agree; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    )
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 3
    usable = common.small(common.durable(usable.withColumn("aside", aside)), 1_000_000)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = dict(rows.select("doc_id", size.alias("size")).join(usable, "doc_id").groupBy("aside").agg(F.sum("size")).collect())
    parts = {k: max(1, -(-sizes.get(k, 0) // part_bytes)) for k in (False, True)}
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.when(F.col("aside"), F.lit(parts[True])).otherwise(F.lit(parts[False]))).cast("int")
    learnt = rows.join(usable, "doc_id").withColumn("part", part)
    packed = common.durable(learnt.repartition(4 * sum(parts.values()), "aside", "part").groupBy("aside", "part").applyInPandas(_pack, _PACKED))
    common.sweep(spark)
    model, cuts = fit(packed, parts[False])
    shared = spark.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_apply(shared), "doc_id long, lang string, held_out boolean, score double")
    cut = F.lit(0.5)
    for lang, at in cuts.items():  # a language or few
        cut = F.when(F.col("lang") == lang, F.lit(at)).otherwise(cut)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
