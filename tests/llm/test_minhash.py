"""The signature join against brute force on whole sets, on sample, crowded and awkward texts."""

import re
from math import comb

import numpy as np
import pytest

from lakeloom.llm import common, minhash, ngram_join

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=4):
    """{row number: (set size, smallest id of its component)}"""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [WORD.findall((t or "").translate(low)) for _, t in rows]
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set() for w in words]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(k)
    return [(k, len(s), min((x for x in ids[root(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(df, **options):
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = minhash.minhash_components(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=key)


def same(df, rows, **options):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert found(df, **options) == sorted(brute(rows), key=key)


def test_sample_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    same(df, [(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("crowd", [2, 8, 64])
def test_crowds_of_near_copies(spark, crowd):
    """Edits at all rates, around the threshold too, in families of many copies; lists of any length give the same rows."""
    rng = np.random.default_rng(3)
    rows = []
    for family in range(6):
        base = [f"f{family}w{x}" for x in rng.integers(0, 400, 90)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 5)):
                w[at] = f"e{rng.integers(0, 5)}"
            rows.append((len(rows), " ".join(w) + " the same last line of every text in the whole table"))
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, crowd=crowd, cell_items=4000, leaf=16)


def test_awkward_texts(spark):
    long = " ".join(f"w{i % 700}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, long), (7, long + " end"), (None, "no id"), (None, "NO id"), (8, "same row here now yes"),
        (8, "same row here now yes"), (9, "é ü 漢字 " * 30), (10, "É ü 漢字 " * 30), (11, "x" * 50000), (None, "one two"), (12, "a\x0bb\x1cc d"),
    ]
    df = spark.createDataFrame([(k, t, 1, "clash", [1]) for k, t in rows], "doc_id long, text string, sid int, h string, sig array<int>")
    df = df.withColumns({c: df["h"] for c in ("_k", "_t", "n", "label", "low", "kept", "component_id")})
    same(df, rows)
    assert minhash.minhash_components(df.limit(0)).collect() == []


def test_signatures_agree_as_sets_do():
    """At a similarity of 0.8 the agreements of 64 coordinates are those of a binomial; 32 of them are missed about never."""
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(3000):
        n = int(rng.integers(5, 200)) * 9
        x = rng.integers(0, 1 << 63, n * 10 // 9, np.uint64)
        # 8 parts common, 1 part each: a union of 10
        part = n // 9
        a, b = np.unique(x[: 9 * part]), np.unique(np.concatenate([x[: 8 * part], x[9 * part :]]))
        sig = minhash.signatures([a, b], 64)
        agree.append(int((sig[0] == sig[1]).sum()))
    assert abs(np.mean(agree) - 51.2) < 0.3 and abs(np.std(agree) - 3.2) < 0.2 and min(agree) > 36
    assert sum(comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(minhash.LEAST)) < 2e-8


def test_shingles_that_parts_hold_once_are_told_of(spark):
    """One passage in every one of many parts, once in each: no part sees it twice, the sample of sets does."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 8)) + " one passage that stands in every text") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(750)
    listed = df.select("doc_id", "text", *common.row_key()).mapInArrow(ngram_join._identity(5), ngram_join._LISTED)
    passage = ngram_join.shingle_sets(["one passage that stands in every text"], 5)[0]
    found = ngram_join.frequent_shingles(listed, 32, 1000)
    assert set(passage.tolist()) <= set(found.tolist()) and len(found) < 20


def test_joins_of_wide_rows_by_bits(spark):
    """Whatever the number of keys: the same rows as a plain join, and about an eighth of the others looked at."""
    rows = spark.range(40_000).selectExpr("id AS _k", "id % 7 AS _t", "repeat('x', 50) AS text")
    keys = common.durable(spark.range(0, 80_000, 9).selectExpr("id AS _k", "id % 7 AS _t"))
    for most in (100, 100_000):
        assert common.matching(rows, keys, ["_k", "_t"], most).count() == rows.join(keys, ["_k", "_t"]).count() == 4445
        assert common.lacking(rows, keys, ["_k", "_t"], most).count() == 40_000 - 4445
    some, rest = common._parted(rows, keys, ["_k", "_t"], keys.count())
    assert some.count() + rest.count() == 40_000 and 4445 <= some.count() < 4445 + 40_000 / 5


def test_tables_go_when_nothing_is_read_from_them(spark):
    made = len(common._written.get(spark.sparkContext.applicationId, []))
    df = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id long, text string")
    out = common.settled(spark, lambda: minhash.minhash_components(df))
    assert out.count() == 20 and len(common._written[spark.sparkContext.applicationId]) == made + 1
    common.discard(out)
    assert len(common._written[spark.sparkContext.applicationId]) == made
