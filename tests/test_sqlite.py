"""SQLite files: read in ranges with pushed filters, written whole or not at all, copied from and to."""

import datetime
import decimal
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.sources import sqlite


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "harbour.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE ship (id integer PRIMARY KEY, name text, tons real, built date, seen timestamp, price numeric(10,2), flag boolean, raw blob)")
        c.executemany(
            "INSERT INTO ship VALUES (?, ?, ?, ?, ?, ?, ?, ?)",
            [(i * 3, None if i % 7 == 0 else f"s{i}", i / 4, "2001-02-03", "2020-01-01 10:00:00.5", "12.50", i % 2, b"\x00x") for i in range(1, 101)],
        )
        c.execute('CREATE TABLE "odd name" (k text, v integer, PRIMARY KEY (k, v)) WITHOUT ROWID')
        c.execute("INSERT INTO \"odd name\" VALUES ('a', 1), ('b', 2)")
    return path


def test_reading(spark, file):
    df = sqlite.read(spark, file, "ship", rows=20)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 100
    first = df.filter("id = 6").first()
    assert tuple(first) == (6, "s2", 0.5, datetime.date(2001, 2, 3), datetime.datetime(2020, 1, 1, 10, 0, 0, 500000), decimal.Decimal("12.50"), False, bytearray(b"\x00x"))
    assert df.filter("name IS NULL AND tons > 10").count() == sum(i % 7 == 0 and i > 40 for i in range(1, 101))
    assert sorted(map(tuple, sqlite.read(spark, file, "odd name").collect())) == [("a", 1), ("b", 2)]


def test_bounds_reach_the_query(spark, file, monkeypatch):
    r = sqlite.Reader({"path": file, "table": "ship", "bounds": '{"id": [30, null], "name": ["s1", "s2"]}'}, sqlite.schema(file, "ship"))
    text, values = r.query(sqlite.Range(1, 9))
    assert text.endswith('WHERE "id" >= ? AND "name" >= ? AND "name" <= ? AND rowid BETWEEN ? AND ?') and values == [30, "s1", "s2", 1, 9]
    asked = []
    real = sqlite.read
    monkeypatch.setattr(sqlite, "read", lambda *a, **b: (asked.append(b.get("bounds")), real(*a, **b))[1])
    db = Database(spark, f"sqlite:{file}")
    both = {"and": [{">": ["id", 290]}, {"like": ["name", "'%9'"]}, {">=": ["built", "'2001-01-01'"]}, {"=": ["name", 5]}]}
    assert db.compile({"select": {"data": "id", "from": "ship", "where": both}}) is not None and asked == [{"id": (290, None)}]
    assert [r["id"] for r in db.compile({"select": {"data": "id", "from": "ship", "where": {"and": both["and"][:3]}}}).collect()] == [297]


def test_a_failed_task_leaves_no_row(spark, file):
    bad = spark.range(1000, 1100, 1, 4).select(F.col("id"), F.when(F.col("id") == 1099, F.raise_error("broken")).otherwise("x").alias("name"))
    with pytest.raises(Exception, match="broken"):
        sqlite.write(bad, file, "ship")
    with pytest.raises(Exception, match="UNIQUE"):  # the commit, too, is all or nothing
        sqlite.write(spark.createDataFrame([(5000, "new"), (3, "taken")], "id long, name string"), file, "ship")
    with sqlite3.connect(file) as c:
        assert c.execute("SELECT count(*), max(id) FROM ship").fetchone() == (100, 300)
    assert os.listdir(os.path.dirname(file)) == ["harbour.db"]
    sqlite.write(spark.range(1000, 1100, 1, 4).select("id", F.lit("x").alias("name")), file, "ship")
    with sqlite3.connect(file) as c:
        assert c.execute("SELECT count(*), max(id) FROM ship").fetchone() == (200, 1099)


def test_copies_from_and_to_a_file(spark, file, tmp_path):
    lake, other = Database(spark, str(tmp_path / "lake")), Database(spark, f"sqlite://{tmp_path}/other.db")
    server = Database(spark, f"sqlite://{file}")
    assert server.store.tables() == ["odd name", "ship"] and server.get_model("ship").key(9).one()["name"] == "s3"
    scope = {"schemas": {"main": {"tables": {"ship": True}}}}
    out = server.copy(lake, scope)
    assert out["data_changes"]["main"]["ship"] == {"copied": 100, "skipped": 0}
    same = lambda a, b: a.table("ship").exceptAll(b.table("ship")).count() == b.table("ship").exceptAll(a.table("ship")).count() == 0
    assert same(server, lake)
    lake.execute(["DELETE FROM ship WHERE id < 10", "UPDATE ship SET name = 'new' WHERE id = 30", "INSERT INTO ship (id, name) VALUES (4000, 'late')"])
    lake.copy(other, scope, final_diff=False)
    assert same(lake, other)
    with sqlite3.connect(f"{tmp_path}/other.db") as c:
        assert c.execute("SELECT name FROM ship WHERE id = 30").fetchone() == ("new",) and c.execute("SELECT count(*) FROM ship").fetchone() == (98,)
        c.execute("UPDATE ship SET tons = 99 WHERE id = 300")
    out = lake.copy(other, scope, final_diff=False)["data_changes"]["main"]["ship"]
    assert out["copied"] > 0 and same(lake, other)
    other.execute("INSERT INTO ship (id, name) VALUES (7, 'direct')")
    assert other.query_one_value("SELECT name FROM ship WHERE id = 7") == "direct"
