"""What indexes do: files in order, lookups that open few of them, key checks of inserts that look beside the new rows only."""

import pytest

from lakeloom.database import Database
from lakeloom.plans.select import bounds_of
from lakeloom.sources.store import Store, StoreError


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("t", {"columns": {"id": {"type": "integer", "primary": True}, "word": {"type": "text"}, "day": {"type": "date"}}, "indexes": {"by_id": {"columns": ["id"]}}})
    rows = spark.range(4000).selectExpr("cast(id as int) AS id", "concat('w', lpad(id % 1000, 4, '0')) AS word", "date_add(DATE '2020-01-01', cast(id / 10 as int)) AS day")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny files, as many as there are partitions
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    db.store.write("main", "t", db.store.meta("main", "t"), rows.repartition(9))
    yield db
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_lookup_opens_one_file_of_many(db):
    assert len(db.table("t").inputFiles()) >= 30
    found = db.compile(db.get_model("t").key(1234).select())
    assert len(found.inputFiles()) == 1 and [r["word"] for r in found.collect()] == ["w0234"]
    scans = [m for m in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in m]
    assert scans and db.get_model("t").key(99999).one() is None
    page = db.compile({"select": {"data": ["id"], "from": {"x": "t"}, "where": {"and": [{">": ["x.id", 2000]}, {"<": ["id", 2100]}]}, "order": "id", "limit": 5}})
    assert len(page.inputFiles()) <= 3 and [r["id"] for r in page.collect()] == [2001, 2002, 2003, 2004, 2005]


def test_changed_and_merged_files_are_known(db):
    db.execute("UPDATE t SET word = 'new' WHERE id BETWEEN 100 AND 300")
    db.execute([f"INSERT INTO t VALUES ({i}, 'late', NULL)" for i in range(5000, 5010)])
    for k, word in ((200, "new"), (5004, "late"), (3999, "w0999")):
        found = db.compile(db.get_model("t").key(k).select())
        assert [r["word"] for r in found.collect()] == [word] and len(found.inputFiles()) <= 2
    db.execute("CREATE INDEX by_word ON t (word)")
    assert db.compile({"select": {"data": {"n": {"count": "*"}}, "from": "t", "where": {"=": ["word", "'late'"]}}}).first()[0] == 10
    assert db.compile({"select": {"data": {"n": {"count": "*"}}, "from": "t", "where": {"=": ["word", 7]}}}) is not None  # compared as numbers: no use of the order


def test_key_checks_look_beside_the_new_rows(db, monkeypatch):
    read = []
    real = Store._parts
    monkeypatch.setattr(Store, "_parts", lambda self, s, t, parts, meta=None: (read.append(len(parts)), real(self, s, t, parts, meta))[1])
    db.execute("INSERT INTO t VALUES (9000, 'far', NULL)")
    assert 0 in read  # no file in its range
    with pytest.raises(StoreError):
        db.execute("INSERT INTO t VALUES (1500, 'again', NULL)")


def test_bounds():
    both = {"and": [{">": ["a", 1]}, {"<=": ["x.a", 9]}, {"or": [{"=": ["b", 1]}, {"=": ["b", 2]}]}, {"=": ["'k'", "c"]}, {"between": {"value": "d", "min": 2, "max": {"literal": 5}}}, {"=": ["y.e", 3]}, {"=": ["f", "g"]}]}
    assert bounds_of(both, "x") == {"a": (1, 9), "c": ("k", "k"), "d": (2, 5)}
    assert bounds_of({"not": {"=": ["a", 1]}}, "x") == bounds_of({"raw": "a = 1"}, "x") == bounds_of(None, "x") == {}
