"""Copies by manifests: which files a copy reads and writes, on tables of many files; cut points on many partitions."""

import time

import pytest
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.operators import fingerprint, manifest
from lakeloom.sources.store import Store

TIDE = {"columns": {"id": {"type": "bigint", "primary": True}, "height": {"type": "double precision"}, "note": {"type": "text"}}}


@pytest.fixture
def two(spark, tmp_path):
    return [Database(spark, str(tmp_path / n), n) for n in ("north", "south")]


def filled(db, n, files):
    db.create_table("tide", TIDE)
    rows = db.spark.range(n).selectExpr("id", "cast(id as double) AS height", "concat('n', id) AS note")
    db.store.write("main", "tide", db.store.meta("main", "tide"), rows.repartitionByRange(files, "id"))


def files(db):
    return {r[0] for r in db.table("tide").select("_metadata.file_path").distinct().collect()}


def moved(a, b, **options):
    return a.copy(b, **options)["data_changes"]["main"]["tide"]


def test_one_changed_row_rewrites_the_files_of_its_shard(two, monkeypatch):
    a, b = two
    a.shard_rows = b.shard_rows = 20
    filled(a, 4000, 200)
    began = time.time()
    assert moved(a, b) == {"copied": 4000, "skipped": 0}
    first = time.time() - began
    before = files(b)
    assert len(before) > 50
    a.execute("UPDATE tide SET height = -1 WHERE id = 1234")
    out = moved(a, b)
    assert 0 < out["copied"] <= 200 and out["copied"] + out["skipped"] == 4000
    gone, new = before - files(b), files(b) - before
    assert 1 <= len(gone) <= 2 and 1 <= len(new) <= 3
    assert b.table("tide").exceptAll(a.table("tide")).count() == a.table("tide").exceptAll(b.table("tide")).count() == 0
    moved(a, b)  # the lines of the new files
    read = []
    real = Store._parts
    monkeypatch.setattr(Store, "_parts", lambda self, s, t, parts, meta=None: (read.extend(parts), real(self, s, t, parts, meta))[1])
    began = time.time()
    a.copy(b, final_diff=False)
    assert time.time() - began < first / 2
    read.clear()
    side = lambda db: manifest.Side(db.store, ("main", "tide"), {c: F.col(c) for c in TIDE["columns"]}, "id")
    manifest.copy_files(side(a), side(b), 20)
    read.clear()
    assert manifest.copy_files(side(a), side(b), 20) == (0, 4000) and read == []  # settled by manifests: no file was opened for rows


def test_rows_of_all_kinds_arrive(two):
    """Rows added, changed and gone at both ends and in gaps, files of the source that overlap, and changes of the target's own."""
    a, b = two
    a.shard_rows = b.shard_rows = 25
    filled(a, 500, 7)
    a.store.write("main", "tide", a.store.meta("main", "tide"), a.table("tide").filter("id % 100 < 60").repartition(5, "note"))
    equal = lambda: b.table("tide").exceptAll(a.table("tide")).count() == a.table("tide").exceptAll(b.table("tide")).count() == 0
    for change in (
        [], ["INSERT INTO tide VALUES (-5, 1, 'low'), (70, 2, 'gap'), (9000, 3, 'high')"], ["DELETE FROM tide WHERE id BETWEEN 100 AND 140"], ["UPDATE tide SET note = NULL WHERE id % 50 = 3"],
        ["DELETE FROM tide WHERE id > 300"],
    ):
        for q in change:
            a.execute(q)
        out = moved(a, b)
        assert equal() and out["copied"] + out["skipped"] == a.table("tide").count()
        assert moved(a, b) == {"copied": 0, "skipped": a.table("tide").count()}
    b.execute(["INSERT INTO tide VALUES (20000, 0, 'own'), (-20000, 0, 'own')", "UPDATE tide SET height = 7 WHERE id = 5", "DELETE FROM tide WHERE id = 110 OR id = 205"])
    moved(a, b)
    assert equal()
    a.execute("TRUNCATE tide")
    moved(a, b)
    assert b.table("tide").count() == 0


def test_a_plain_file_as_source(two, spark, tmp_path):
    spark.range(300).selectExpr("id", "cast(id as string) AS word").write.parquet(str(tmp_path / "plain/t.parquet"))
    b = two[1]
    a = Database(spark, str(tmp_path / "plain"))
    b.create_table("t", {"columns": {"id": {"type": "bigint", "primary": True}, "word": {"type": "text"}}})
    a.shard_rows = b.shard_rows = 10
    exclude = {"columns": ["null", "primary", "constraints"], "constraints": {"names": ["t__id__pk"]}}
    b.execute("INSERT INTO t VALUES (7, 'wrong'), (1000, 'too much')")
    a.copy(b, exclude=exclude)
    assert b.table("t").exceptAll(a.table("t")).count() == 0 and b.table("t").count() == 300


def test_cut_points_of_many_partitions(spark):
    """Tasks send their share of a sample, whatever their number: no task takes as many rows as there are cuts from each other one."""
    df = spark.range(0, 100_000, 1, 2000).withColumn("k", F.col("id") * 7 % 100_003)
    seen = []
    real = fingerprint.cuts_of
    fingerprint.cuts_of = lambda v: (seen.append(v), real(v))[1]
    try:
        cuts = fingerprint.cut_points(df, "k", 500)
    finally:
        fingerprint.cuts_of = real
    assert 400 < len(cuts) < 600 and "TakeOrdered" not in seen[0]._jdf.queryExecution().toString() and seen[0].count() < 600
    values = sorted(int(t) for t in cuts.texts)
    assert [int(t) for t in cuts.texts] == values
    for strict in (False, True):
        got = df.select("k", fingerprint.bucket_of(F.col("k"), cuts, strict).alias("b")).collect()
        assert all(r["b"] == sum(v < r["k"] or (v == r["k"] and not strict) for v in values) for r in got[:300])


@pytest.mark.parametrize("kind", ["double", "string", "timestamp", "decimal(20,3)", "date", "binary"])
def test_cut_points_of_any_type(spark, kind):
    made = {"timestamp": "timestamp_micros(id * 86400000123)", "date": "date_add(DATE '2000-01-01', cast(id as int))", "binary": "cast(concat('k', lpad(id, 6, '0')) AS binary)", "string": "concat('k\"', chr(39), chr(92), lpad(id, 6, '0'))"}
    df = spark.range(2000).selectExpr(f"{made.get(kind, f'cast(id / 7 AS {kind})')} AS k")
    rows = fingerprint.numbered(df, "k", 100).groupBy("_shard").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_shard").collect()
    assert [r["n"] for r in rows] == [100] * 20 and all(x["hi"] <= y["lo"] for x, y in zip(rows, rows[1:], strict=False))
