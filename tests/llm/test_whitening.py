"""Whitening against NumPy on whole matrices and against exact fractions, on sample and awkward vectors."""

from fractions import Fraction

import numpy as np
import pytest

from lakeloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], "vec_id long, embedding array<double>, v string, component int")


def steps(x):
    return [[int(np.floor(64 * c)) + 1_000_000 for c in r] for r in x]


def test_sample_table(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = queries.op11_embedding_whitening(spark, SF).toPandas()
    x = np.array(steps(np.stack(raw.embedding).astype(float)), np.int64)
    n, s = len(x), x.sum(0)
    e, q = np.linalg.eigh(np.cov((x - x.mean(0)).T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    most = min(32, x.shape[1])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == n * most and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    p = got.pivot(index="vec_id", columns="component", values="whitened").loc[raw.vec_id].to_numpy()
    want = (x - s / n) @ q[:, :most] / np.sqrt(e[:most])
    assert np.abs(want * np.sign((want * p).sum(0)) - p).max() < 1e-7
    assert np.allclose(got.groupby("component").explained.first(), e[:most] / e.sum(), rtol=1e-9)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[raw.vec_id].tolist() == ((n * x - s) ** 2).sum(1).tolist()


def test_scatter_is_exact_and_does_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (9000, 5)) * [1, 10, 1e3, 1e7, 1e10]
    df = frame(spark, [(i, r) for i, r in enumerate(x.tolist())])
    w = [[int(np.floor(64 * c)) for c in r] for r in x]
    sums = [sum(c) for c in zip(*w, strict=True)]
    found = [whitening.fit_whitening(df.repartition(k), most=5) for k in (1, 7, 40)]
    for m in found:
        assert m.sums == sums and m.variance.tolist() == found[0].variance.tolist() and m.identity_error < 1e-4
    k = found[0]
    whole = np.array(w[:50], object)
    assert k.deviation(whole.astype(float)) == [sum((9000 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in w[:50]]
    # relative error of every eigenvalue, against the exact matrix
    square = [[Fraction(9000 * sum(r[i] * r[j] for r in w) - sums[i] * sums[j], 9000**2) for j in range(5)] for i in range(5)]
    for unit, e in zip(k.components, k.variance, strict=True):
        v = [Fraction(float(c)) for c in unit]
        exact = sum(v[i] * square[i][j] * v[j] for i in range(5) for j in range(5)) / sum(c * c for c in v)
        assert abs(float(exact) / e - 1) < 1e-9
    assert abs(sum(k.explained) - 1) < 1e-9


def test_residues():
    rng = np.random.default_rng(1)
    values = [int(x) << int(s) for x, s in zip(rng.integers(-(1 << 40), 1 << 40, 30), rng.integers(0, 60, 30), strict=True)]
    moduli = whitening.primes(102)
    assert whitening.remainder([np.array([v % p for v in values]) for p in moduli], moduli).tolist() == values
    assert all(p < 1 << whitening.BITS and all(p % f for f in range(2, 1000)) for p in moduli) and len(set(moduli)) == len(moduli)
    assert whitening.BLOCK * (1 << whitening.BITS - 1) ** 2 < 1 << 53


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [0.5]), (7, []), (1, [1.0, 2.0])]
    got = whitening.whitened_components(frame(spark, rows)).toPandas()
    kept = np.array(steps([[1, 2], [3, 1], [0.5, 0], [0, 0], [1, 2]]))  # shorter ones end in zeros
    assert len(got) == 10 and set(got.n) == {5}
    assert sorted(got.vec_id.fillna(-1)) == sorted([1, 1, 1, 1, -1, -1, 6, 6, 7, 7])
    assert sorted(got.deviation) == sorted(2 * ((5 * kept - kept.sum(0)) ** 2).sum(1).tolist())
    one = whitening.whitened_components(frame(spark, rows[:1])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(i, 1, 0, None, None, None) for i in (1, 2)]
    flat = whitening.whitened_components(frame(spark, [(i, [float(i), 5.0]) for i in range(4)])).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 2].explained.tolist() == [0.0] * 4
    assert abs((flat[flat.component == 1].whitened ** 2).mean() - 1) < 1e-12 and flat.identity_error.max() < 1e-9
    for none in ([], rows[2:6]):
        assert whitening.whitened_components(frame(spark, none)).collect() == []
    vast = frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 9.0])])
    assert whitening.whitened_components(vast).count() == 6
    assert whitening.whitened_components(vast).select("deviation").first()[0] is None


@pytest.mark.parametrize("parts", [1, 100])
def test_partial_sums_are_added_in_a_tree(spark, parts):
    df = frame(spark, [(i, [float(i % 7), float(i % 3)]) for i in range(300)]).repartition(parts)
    m = whitening.fit_whitening(df)
    assert m.n == 300 and m.sums == [64 * sum(i % 7 for i in range(300)), 64 * sum(i % 3 for i in range(300))] and m.identity_error < 1e-12
