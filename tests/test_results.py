"""Kept results: what is spared, and that no result outlives the state of the tables that it came from."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.functions.expressions import QueryError
from lakeloom.sources import results, store
from lakeloom.sources.store import Store

SUMS = {"select": {"data": ["kind", {"n": {"count": "*"}}], "from": "coin", "group": "kind"}}


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "mint"))
    db.create_table("coin", {"columns": {"id": {"type": "bigint", "primary": True}, "kind": {"type": "text"}, "struck": {"type": "date"}}})
    rows = spark.range(90).selectExpr("id", "concat('k', id % 3) AS kind", "date_add(DATE '2001-01-01', cast(id as int)) AS struck")
    db.store.write("main", "coin", db.store.meta("main", "coin"), rows)
    return db


@pytest.fixture
def opened(monkeypatch):
    """Names of the parts that are read."""
    read = []
    real = Store._parts
    monkeypatch.setattr(Store, "_parts", lambda self, s, t, parts, meta=None: (read.extend(parts), real(self, s, t, parts, meta))[1])
    return read


def from_kept(df):
    return all("/_results/" in f for f in df.inputFiles()) and bool(df.inputFiles())


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_rows_are_kept_until_a_commit(spark, db):
    first = db.kept(SUMS)
    assert from_kept(first) and got(first) == [("k0", 30), ("k1", 30), ("k2", 30)]
    other = Database(spark, db.url)
    again = other.kept(SUMS)
    assert again.inputFiles() == first.inputFiles()  # another object, the same result
    other.execute("INSERT INTO coin VALUES (900, 'k1', NULL)")
    after = db.kept(SUMS)
    assert got(after) == [("k0", 30), ("k1", 31), ("k2", 30)] and after.inputFiles() != first.inputFiles()
    assert got(first) == [("k0", 30), ("k1", 30), ("k2", 30)]  # who has read begun may end
    other.execute("UPDATE coin SET kind = 'k0' WHERE id = 900")
    assert got(db.kept(SUMS)) == [("k0", 31), ("k1", 30), ("k2", 30)]
    other.execute("DELETE FROM coin WHERE kind = 'k2'")
    assert got(db.kept(SUMS)) == [("k0", 31), ("k1", 30)]
    other.execute("TRUNCATE coin")
    assert got(db.kept(SUMS)) == []
    other.execute("ALTER TABLE coin RENAME COLUMN kind TO sort")
    with pytest.raises(Exception, match="kind"):
        db.kept(SUMS).collect()


def test_text_parameters_and_other_tables(db):
    text = "SELECT c.kind, count(*) AS n FROM coin c WHERE c.id < $1 AND NOT EXISTS (SELECT 1 FROM worn w WHERE w.coin_id = c.id) GROUP BY c.kind"
    db.create_table("worn", {"columns": {"coin_id": {"type": "bigint"}}})
    a, b = db.kept(text, [30]), db.kept(text, [60])
    assert from_kept(a) and from_kept(b) and got(a) == [("k0", 10), ("k1", 10), ("k2", 10)] and got(b)[0] == ("k0", 20)
    db.execute("INSERT INTO worn VALUES (0), (3)")  # the table of the inner select
    assert got(db.kept(text, [30])) == [("k0", 8), ("k1", 10), ("k2", 10)]
    db.execute("DROP TABLE worn")
    db.execute({"create": {"table": {"name": "worn", "columns": {"coin_id": {"type": "bigint"}}}}})
    assert got(db.kept(text, [30])) == [("k0", 10), ("k1", 10), ("k2", 10)]
    with pytest.raises(QueryError):
        db.kept("DELETE FROM coin")


def test_order_is_kept(db):
    q = {"select": {"data": ["id", "kind"], "from": "coin", "order": [{"by": "kind", "desc": True}, "id"], "limit": 50}}
    want = [tuple(r) for r in db.compile(q).collect()]
    for _ in range(2):
        rows = db.kept(q)
        assert from_kept(rows) and rows.columns == ["id", "kind"] and [tuple(r) for r in rows.collect()] == want


def test_what_is_not_kept(spark, db):
    spark.udf.register("lk_twice", lambda x: 2 * x, "long")
    spark.range(3).createOrReplaceTempView("lk_outside")
    for q in (
        "SELECT id, rand() AS r FROM coin", "SELECT id, now() AS t FROM coin", "SELECT id FROM coin WHERE struck < current_date()", "SELECT lk_twice(id) AS x FROM coin",
        "SELECT * FROM coin WHERE id IN (SELECT id FROM lk_outside)", "SELECT id, NULL AS nothing FROM coin", "SELECT id FROM coin WHERE (SELECT max(lk_twice(id)) FROM coin) > 1",
        {"select": {"data": ["id"], "from": {"c": db.table("coin")}}}, {"select": {"data": {"a": {"raw": "(SELECT max(id) FROM lk_outside)"}}, "from": "coin"}},
    ):
        rows = db.kept(q)
        assert not any("/_results/" in f for f in rows.inputFiles()) and rows.count() > 0, q
    spark.catalog.dropTempView("lk_outside")


def test_a_transaction_called_off_leaves_no_wrong_result(spark, db):
    assert got(db.kept(SUMS))[0] == ("k0", 30)
    with pytest.raises(ZeroDivisionError), db.transaction():
        db.execute("DELETE FROM coin WHERE kind = 'k0'")
        assert got(db.kept(SUMS)) == [("k1", 30), ("k2", 30)]
        raise ZeroDivisionError
    assert got(db.kept(SUMS))[0] == ("k0", 30) and got(Database(spark, db.url).kept(SUMS))[0] == ("k0", 30)


def test_session_settings_are_part_of_the_question(spark, db):
    q = "SELECT id, cast(timestamp_seconds(id) AS string) AS t FROM coin WHERE id = 1"
    assert got(db.kept(q)) == [(1, "1970-01-01 00:00:01")]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert got(db.kept(q)) == [(1, "1970-01-01 09:00:01")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_information_opens_no_file_twice(spark, db, opened):
    first = db.get_info(hashes=True)
    assert opened
    opened.clear()
    assert Database(spark, db.url).get_info(hashes=True) == first
    info = first["main"]["coin"]["rows"]
    assert info["count"] == 90 and info["range"]["id"] == {"min": 0, "max": 89} and list(info["hashes"]) == [0]
    db.execute("UPDATE coin SET kind = 'other' WHERE id = 5")
    assert Database(spark, db.url).get_info(hashes=True)["main"]["coin"]["rows"]["hashes"] != info["hashes"]


def test_a_second_copy_runs_over_no_rows(spark, db, tmp_path):
    to = Database(spark, str(tmp_path / "vault"))
    assert db.copy(to)["final_diff"] == {}
    db.copy(to)  # lines of the target's files
    asked = []
    real = results.Results.document
    results.Results.document = lambda self, what, tables, make: real(self, what, tables, lambda: asked.append(what) or make())
    try:
        out = db.copy(to)
        assert out["final_diff"] == {} and out["data_changes"]["main"]["coin"] == {"copied": 0, "skipped": 90} and asked == []
        Database(spark, to.url).execute("DELETE FROM coin WHERE id = 7")  # another writer at the target
        assert db.diff(to) != {} and asked
        assert db.copy(to)["final_diff"] == {}
        assert to.table("coin").filter("id = 7").count() == 1
    finally:
        results.Results.document = real


def test_plain_files_are_kept_in_a_folder_of_choice(spark, tmp_path):
    at = str(tmp_path / "plain/leaf.parquet")
    spark.range(5).write.parquet(at)
    q = "SELECT sum(id) AS s FROM leaf"
    assert not any("/_results/" in f for f in Database(spark, str(tmp_path / "plain")).kept(q).inputFiles())
    db = Database(spark, str(tmp_path / "plain"), results=str(tmp_path / "kept"))
    rows = db.kept(q)
    assert got(rows) == [(10,)] and "/kept/" in rows.inputFiles()[0] and db.kept(q).inputFiles() == rows.inputFiles()
    assert db.get_info()["main"]["leaf"]["rows"]["count"] == 5
    spark.range(7).write.mode("append").parquet(at)
    spark.catalog.refreshByPath(at)
    assert got(db.kept(q)) == [(31,)] and db.get_info()["main"]["leaf"]["rows"]["count"] == 12
    db.forget()
    assert not (tmp_path / "kept").exists() and got(db.kept(q)) == [(31,)]


def test_old_rows_go_once_their_readers_are_through(db, monkeypatch):
    old = db.kept(SUMS).inputFiles()[0]
    folder = old.rsplit("/", 3)[0]
    for i in range(2):
        db.execute(f"INSERT INTO coin VALUES ({1000 + i}, 'k9', NULL)")
        db.kept(SUMS)
    assert len(db.store.files.names(folder)) == 3  # within the time that files of no snapshot stay
    monkeypatch.setattr(store, "RETAIN", -1.0)
    db.execute("INSERT INTO coin VALUES (2000, 'k9', NULL)")
    assert got(db.kept(SUMS))[-1] == ("k9", 3) and len(db.store.files.names(folder)) == 2  # the last one before is only marked now
    assert not db.store.files.exists(old)


def test_values_come_back_as_they_were():
    values = [None, True, 3, "x", -0.1, float("inf"), decimal.Decimal("1.50"), datetime.datetime(2020, 1, 2, 3, 4, 5, 6), datetime.date(1999, 1, 1), bytearray(b"\0\xff"), {1: [2, {"a": None}]}, {None: "n"}]
    back = results.unpacked(results.packed(values))
    assert back == values and [type(x) for x in back] == [type(x) for x in values]
    with pytest.raises(TypeError):
        results.packed(F)
