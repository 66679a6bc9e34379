"""Whitening of embeddings from an exact scatter matrix in a residue number system.

Vectors become whole numbers. Each partition multiplies their residues by several primes (products of doubles that stay
below 2 ** 53, so they are exact), partitions' sums are reduced modulo the primes in a tree of small tasks, and Chinese
remaindering gives the scatter as whole numbers: the same ones in every run, however the rows are dealt. The covariance
is rounded to doubles once, entry by entry, and decomposed by a double-precision ``eigh``; the exact scatter in those
components is then freed of what ``eigh`` left beside its diagonal, and gives the eigenvalues, so that small ones beside
large ones keep their digits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a product and bits of a prime: BLOCK * 2 ** (2 * BITS - 2) is below 2 ** 53 for residues around zero.
BLOCK, BITS = 4096, 20
#: A component whose variance is no more than this share of the largest one's has none.
NO_VARIANCE = 1e-24
#: So many partial sums are added by one task.
FAN_IN = 32
_LONG = 1 << 63


def primes(bits: int) -> list[int]:
    """The largest primes below 2 ** BITS, until their product has more than ``bits`` bits."""
    out, product, x = [], 1, (1 << BITS) - 1
    while product.bit_length() <= bits:
        if all(x % f for f in range(3, isqrt(x) + 1, 2)):
            out.append(x)
            product *= x
        x -= 2
    return out


def remainder(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers around zero that have these residues (Chinese remaindering), as Python's."""
    product = reduce(lambda a, b: a * b, moduli, 1)
    total = sum(r.astype(object) * (product // p * pow(product // p, -1, p)) for r, p in zip(residues, moduli, strict=True)) % product
    return np.where(total > product // 2, total - product, total)


def _steps(batch: pa.RecordBatch, size: int | None, scale: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has only finite entries, and floor(scale * entry) as whole numbers held in doubles or (beyond 2 ** 53) Python's."""
    v = batch.column("v")
    v = v.cast(pa.list_(pa.float64())) if v.type != pa.list_(pa.float64()) else v
    flat, owner = v.flatten(), pc.list_parent_indices(v).to_numpy()
    values = flat.to_numpy(zero_copy_only=False)  # nulls become not-a-number
    ok = v.is_valid().to_numpy(zero_copy_only=False)
    ok[owner[~np.isfinite(values)]] = False
    batch = batch.filter(pa.array(ok))
    keep = ok[owner]
    values, owner = values[keep], (np.cumsum(ok) - 1)[owner[keep]]
    count = np.bincount(owner, minlength=len(batch)) if len(batch) else np.zeros(0, int)
    size = int(count.max(initial=0)) if size is None else size
    whole = np.zeros((len(batch), size))
    starts = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        whole[owner, np.arange(len(owner)) - starts[owner]] = np.clip(np.floor(scale * values), -float(_LONG), float(_LONG))
    return batch, whole


def _exact(whole: np.ndarray) -> np.ndarray:
    """Whole numbers as int64, or as Python's where they come near its ends."""
    return whole.astype(np.int64) if np.abs(whole).max(initial=0) < 1 << 62 else np.array([[int(x) for x in r] for r in whole], object).reshape(whole.shape)


def _blocks(batches, size: int | None, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, len(b), BLOCK):
            yield _steps(b.slice(at, BLOCK), size, scale)


def _measure(scale: int):
    def run(batches):
        n = size = most = 0
        for b, whole in _blocks(batches, None, scale):
            n, size, most = n + len(b), max(size, whole.shape[1]), max(most, int(np.abs(whole).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"n": [n], "size": [size], "bits": [most.bit_length()]}, schema=_MEASURED)

    return run


_MEASURED = pa.schema([("n", pa.int64()), ("size", pa.int32()), ("bits", pa.int32())])
_PART = "part binary"


def _part(value) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [pickle.dumps(value)]}, schema=pa.schema([("part", pa.binary())]))


def _scatter(size: int, scale: int, moduli: list[int]):
    """One row a partition: for each prime the residues of the sums and of the scatter matrix of its vectors."""

    def run(batches):
        sums = [np.zeros(size, np.int64) for _ in moduli]
        products = [np.zeros((size, size), np.int64) for _ in moduli]
        for _, whole in _blocks(batches, size, scale):
            x = _exact(whole)
            for i, p in enumerate(moduli):
                r = (x % p).astype(np.float64)
                r[r > p // 2] -= p
                sums[i] = (sums[i] + r.sum(0).astype(np.int64)) % p
                products[i] = (products[i] + (r.T @ r).astype(np.int64)) % p
        yield _part(list(zip(sums, products, strict=True)))

    return run


def _add_residues(moduli: list[int]) -> Callable:
    return lambda a, b: [((s + t) % p, (x + y) % p) for (s, x), (t, y), p in zip(a, b, moduli, strict=True)]


def _merge_moments(a, b):
    """Count, mean and centred products of two groups together."""
    (n, m, c), (k, l, d) = a, b
    if not n or not k:
        return b if not n else a
    gap = l - m
    return n + k, m + gap * (k / (n + k)), c + d + np.outer(gap, gap) * (n * k / (n + k))


def _moments(model: Whitening):
    def run(batches):
        total = (0, np.zeros(model.rank), np.zeros((model.rank, model.rank)))
        for b, whole in _blocks(batches, model.size, model.scale):
            if len(b):
                y = model.project(whole)[:, : model.rank]
                mean = y.mean(0)
                total = _merge_moments(total, (len(b), mean, (y - mean).T @ (y - mean)))
        yield _part(total)

    return run


def _folded(add: Callable):
    def run(batches):
        total = None
        for b in batches:
            for x in b.column("part").to_pylist():
                total = pickle.loads(x) if total is None else add(total, pickle.loads(x))
        if total is not None:
            yield _part(total)

    return run


def _reduced(parts: DataFrame, add: Callable):
    """The sum of all partial values: in a tree of tasks, of which only the last level (at most ``FAN_IN`` values) comes to the driver."""
    n = parts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_folded(add), _PART)
    return reduce(add, [pickle.loads(bytes(r["part"])) for r in parts.collect()])


@dataclass
class Whitening:
    """What was fitted: n vectors of ``size`` entries, their exact sums (of the whole numbers), and ``count`` components.

    ``rank``: how many of them have variance. ``components`` are rows of unit length, by falling ``variance``.
    """

    n: int
    size: int
    scale: int
    sums: list[int]
    components: np.ndarray
    variance: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def count(self) -> int:
        return len(self.components)

    @property
    def rank(self) -> int:
        return int((self.variance > 0).sum())

    def project(self, whole: np.ndarray) -> np.ndarray:
        """Whitened coordinates of vectors of whole numbers; not-a-number in components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return (whole - mean) @ self.components.T / np.where(self.variance > 0, np.sqrt(self.variance), np.nan)

    def deviation(self, whole: np.ndarray) -> list[int]:
        """Sum over the entries of (n * entry - sum) ** 2, exactly: n n xx - 2 n xs + ss, of which xx and xs are sums of 64-bit products."""
        x, sums = _exact(whole), np.array(self.sums, object)
        if x.dtype == object or np.abs(whole).max(initial=0) * max(1, self.size) >= 1 << 30:
            return [int(r) for r in ((self.n * x.astype(object) - sums) ** 2).sum(1)] if self.size else [0] * len(x)
        squares, base = (x * x).sum(1), 1 << 31
        digits, rest = [], sums
        while any(not -base <= s < base for s in rest):
            digits.append(np.array([int(s) % base for s in rest], np.int64))
            rest = np.array([int(s) // base for s in rest], object)
        digits.append(np.array([int(s) for s in rest], np.int64))
        crossed = [(x @ d).tolist() for d in digits]
        n, own = self.n, int((sums * sums).sum()) if self.size else 0
        return [n * n * q - 2 * n * sum(c << 31 * i for i, c in enumerate(cs)) + own for q, *cs in zip(squares.tolist(), *crossed, strict=True)]


def _exact_in(units: np.ndarray, centred: np.ndarray) -> np.ndarray:
    """units . centred . units' in doubles, each entry from exact sums over the units' 52 binary places."""
    whole = np.array([[int(x) for x in row] for row in np.rint(units * 2.0**52)], object).reshape(units.shape)
    inner = whole @ (centred @ whole.T)
    return np.array([[int(x) / (1 << 104) for x in row] for row in inner], float).reshape(inner.shape)


def _rotated(units: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``units`` after Jacobi's rotations of the nearly diagonal ``b`` (their products with the matrix): each pair is judged at its own scale."""
    units, b = units.copy(), b.copy()
    for _ in range(12):
        d = np.sqrt(np.maximum(np.diag(b), 0))
        far = np.argwhere(np.triu(np.abs(b) > 1e-14 * np.outer(d, d), 1))
        if not len(far):
            break
        for i, j in far:
            if b[i, j]:
                tau = (b[j, j] - b[i, i]) / (2 * b[i, j])
                t = np.copysign(1, tau) / (abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                turn = np.array([[c, -t * c], [t * c, c]])
                units[[i, j]] = turn @ units[[i, j]]
                b[[i, j]] = turn @ b[[i, j]]
                b[:, [i, j]] = b[:, [i, j]] @ turn.T
    return units / np.linalg.norm(units, axis=1, keepdims=True)


def decompose(n: int, sums: np.ndarray, scatter: np.ndarray, most: int, scale: int) -> Whitening:
    """Components of the covariance of n vectors, from their exact sums and sums of products (Python's whole numbers)."""
    size = len(sums)
    centred = n * scatter - np.outer(sums, sums)  # n * n times the covariance, exactly that of the centred vectors
    square = n * n
    v = np.array([[x / square for x in row] for row in centred], float).reshape(size, size)
    _, vectors = np.linalg.eigh(v)
    units = vectors.T[::-1]
    units = _rotated(units, _exact_in(units, centred) / square)
    # Rayleigh's quotients from the exact matrix: their error is that of the vectors, squared
    variance = np.diag(_exact_in(units, centred)) / (units * units).sum(1) / square
    order = np.argsort(-variance, kind="stable")[:most]
    units, variance = units[order], variance[order]
    variance = np.where(variance > NO_VARIANCE * variance.max(initial=0), variance, 0.0)
    trace = sum(int(centred[i, i]) for i in range(size)) / square if size else 0.0
    return Whitening(n, size, scale, [int(s) for s in sums], units, variance, [e / trace if trace else None for e in variance.tolist()])


def fit_whitening(vectors: DataFrame, most: int = 32, scale: int = 64, vector: str = "embedding") -> Whitening | None:
    """The whitening of all rows' vectors (None without any): two passes for the scatter, one that measures the whitened rows.

    identity_error is the largest entry of the whitened rows' covariance less the identity, among components with variance.
    What comes to the driver has the size of one matrix of products, whatever the number of rows. See ``whiten`` for awkward rows.
    """
    common.ship_code(vectors.sparkSession)
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    seen = rows.mapInArrow(_measure(scale), "n long, size int, bits int").agg(F.sum("n"), F.max("size"), F.max("bits")).first()
    n, size = seen[0] or 0, seen[1] or 0
    if not n:
        return None
    moduli = primes(max(1, n.bit_length() + 2 * seen[2] + 2))
    parts = _reduced(rows.mapInArrow(_scatter(size, scale, moduli), _PART), _add_residues(moduli))
    sums, scatter = (remainder([x[i] for x in parts], moduli) for i in (0, 1))
    model = decompose(n, sums, scatter, most, scale)
    if model.rank:
        count, _, products = _reduced(rows.mapInArrow(_moments(model), _PART), _merge_moments)
        model.identity_error = float(np.abs(products / count - np.eye(model.rank)).max())
    return model


_WHITENED = "vec_id long, deviation decimal(38,0), whitened array<double>"


def _whitened(model: Whitening):
    def run(batches):
        kind = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
        for b, whole in _blocks(batches, model.size, model.scale):
            y = model.project(whole)
            flat = pa.array(y.ravel(), mask=np.isnan(y).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * model.count), flat)
            dev = pa.array([d if d < 10**38 else None for d in model.deviation(whole)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), dev, lists], schema=kind)

    return run


def whiten(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (an array, a value for each component) of each vector.

    Rows whose vector is null or holds a null, infinite or not-a-number entry give no row, in the fit either. A vector
    shorter than the longest one ends in zeros. floor(scale * entry) beyond 64 bits is held at their ends. A null vec_id is kept, repeated rows
    are rows of their own, other columns are ignored. Where all vectors agree in a component (one row; fewer rows than
    entries) the value is null. deviation is exact, and null from 10 ** 38 on.
    """
    common.ship_code(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(_whitened(model), _WHITENED)


def whitened_components(vectors: DataFrame, most: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry c stands for the whole number floor(64 * c); a constant added to all of them would change nothing here.
    deviation is a long here, null where it doesn't fit one (from about 10 ** 8 vectors of spread 30 on; ``whiten`` has it).
    explained is null where nothing varies, identity_error where no component does. Without vectors there are no rows.
    """
    model = fit_whitening(vectors, most, vector=vector)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained]).cast("array<double>")
    rows = whiten(vectors, model, vec_id, vector).select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
