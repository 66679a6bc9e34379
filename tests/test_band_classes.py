"""Joins by bands on many equal rows: what is judged is classes of them, and crowded bins are cut."""

import pytest
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.operators import bands

ON = {"and": [{">=": ["x.at", "y.low"]}, {"<": ["x.at", "y.high"]}]}


@pytest.fixture
def db(spark, tmp_path):
    """400 values of 4 kinds, one of them null, and 300 spans of 3 kinds, one without partners."""
    db = Database(spark, str(tmp_path / "db"))
    tables = {"a": spark.range(400).selectExpr("cast(id AS int) id", "cast(if(id % 4 = 3, null, id % 4 * 10) AS double) at"), "b": spark.range(300).selectExpr("cast(id AS int) id", "cast(id % 3 * 10 - 5 AS double) low", "cast(id % 3 * 10 + if(id % 3 = 2, -2, 7) AS double) high")}
    for name, rows in tables.items():
        db.create_table(name, {"columns": {f.name: {"type": "integer" if f.name == "id" else "double"} for f in rows.schema}})
        db.store.write("main", name, db.store.meta("main", name), rows)
    return db


@pytest.fixture
def judged(monkeypatch):
    """How many pairs each join by bins made."""
    counts, real = [], bands.overlapping

    def counted(*args):
        out = real(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(bands, "overlapping", counted)
    return counts


def test_update_takes_the_least_partner_of_a_class(db, judged):
    assert db.execute({"update": {"table": {"x": "a"}, "set": {"id": "y.id"}, "from": {"y": "b"}, "where": ON}}) == 200
    assert judged == [2]
    got = {(r["at"], r["id"]) for r in db.table("a").collect() if r["at"] in (0.0, 10.0)}
    assert got == {(0.0, 0), (10.0, 1)}


def test_delete_by_classes(db, judged):
    assert db.execute({"delete": {"table": {"x": "a"}, "using": {"y": "b"}, "where": ON}}) == 200
    assert judged == [2] and {r["at"] for r in db.table("a").collect()} == {20.0, None}


def test_groups_are_counted_by_classes(db, judged):
    data = [{"high": "y.high"}, {"n": {"count": "*"}}, {"m": {"count": "x.at"}}, {"least": {"min": {"+": ["x.id", 1]}}}, {"most": {"max": "y.id"}}]
    df = db.compile({"select": {"data": data, "from": {"x": "a"}, "join": {"to": "b", "as": "y", "on": ON}, "group": "y.high"}})
    assert sorted(tuple(r) for r in df.collect()) == [(7.0, 10000, 10000, 1, 297), (17.0, 10000, 10000, 2, 298)] and judged == [2]


def test_full_join_gives_all_pairs_from_lists(db, judged):
    df = db.compile({"select": {"data": [{"p": "x.id"}, {"q": "y.id"}], "from": {"x": "a"}, "join": {"to": "b", "as": "y", "type": "full", "on": ON}}})
    n = df.agg(F.count("*"), F.count_distinct("p", "q"), F.count_if(F.col("p").isNull()), F.count_if(F.col("q").isNull())).first()
    assert tuple(n) == (20300, 20000, 100, 200) and max(judged) == 2


@pytest.mark.parametrize("data", [[{"p": "x.id"}, {"q": "y.id"}], ["*"]])
def test_blocks_of_crowded_bins(db, monkeypatch, data):
    monkeypatch.setattr(bands, "BLOCK", 37)
    monkeypatch.setattr(bands, "LIST", 5)
    df = db.compile({"select": {"data": data, "from": {"x": "a"}, "join": {"to": "b", "as": "y", "on": ON}}})
    names = ["p", "q", *df.columns[2:]] if data != ["*"] else ["p", "at", "q", "low", "high"]
    rows = df.toDF(*names).select("p", "q").collect()
    assert sorted(map(tuple, rows)) == [(p, q) for p in range(400) for q in range(300) if p % 4 == q % 3 and p % 4 < 2]
