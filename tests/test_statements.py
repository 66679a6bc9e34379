"""Statements as text: what they give, and errors that name the place; queries split into ranges."""

import datetime

import pytest

from lakeloom.database import Database
from lakeloom.functions.expressions import QueryError
from lakeloom.plans import sqltext
from lakeloom.plans.workflow import split_query


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, str(tmp_path_factory.mktemp("log")))
    db.execute(["CREATE TABLE crew (id integer PRIMARY KEY, name text DEFAULT 'nobody', pay integer)", "CREATE TABLE watch (day date, hour integer)"])
    db.create_table("berth", {"columns": {"no": {"type": "integer", "sequence": True}, "who": {"type": "text"}}})
    return db


def rows(found):
    return sorted(map(tuple, found.collect()), key=str)


def test_changes(db):
    assert rows(db.execute("INSERT INTO crew AS c VALUES (1, DEFAULT, 10), (2, 'ida', 20) RETURNING id, concat(name, '!') AS n")) == [(1, "nobody!"), (2, "ida!")]
    assert rows(db.execute("UPDATE crew SET name = DEFAULT, pay = pay + 1 WHERE id = 2 RETURNING *")) == [(2, "nobody", 21)]
    assert rows(db.execute("WITH best AS (SELECT max(pay) AS m FROM crew) UPDATE crew c SET (name, pay) = ('best', best.m * 2) FROM best WHERE c.pay = best.m RETURNING c.id, c.pay")) == [(2, 42)]
    assert rows(db.execute("DELETE FROM crew USING (SELECT 1 AS k) AS gone WHERE crew.id = gone.k RETURNING name")) == [("nobody",)]
    assert db.execute("INSERT INTO crew VALUES ($1, $2, 5)", [7, "o'neil; WHERE"]) == 1
    assert db.execute("UPDATE crew SET pay = 6 WHERE name = $who AND pay IS DISTINCT FROM 6", {"who": "o'neil; WHERE"}) == 1
    db.execute(["INSERT INTO berth VALUES (DEFAULT, 'a')", "INSERT INTO berth DEFAULT VALUES", "INSERT INTO berth (who) VALUES ('returning')"])
    assert rows(db.table("berth")) == [(1, "a"), (2, None), (3, "returning")]
    db.execute("ALTER TABLE crew ADD COLUMN IF NOT EXISTS pay integer, ADD ship text DEFAULT 'Vik', ALTER pay DROP DEFAULT;")
    assert db.query_one_value("SELECT ship FROM crew WHERE id = 2") == "Vik"
    db.execute(["TRUNCATE TABLE berth, watch", "DROP TABLE IF EXISTS none, berth"])
    assert db.store.tables() == ["crew", "watch"]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("UPDATE crew\nSETT pay = 1", "line 2, column 6: SET expected, not 'pay'"), ("INSERT crew VALUES (1)", "line 1, column 8: INTO expected, not 'crew'"),
        ("DELETE FROM crew WHERE", "line 1, column 23: a condition expected, not the end"), ("INSERT INTO crew (id, VALUES (1)", "line 1, column 30: ) expected, not '('"),
        ("CREATE INDEX i ON crew id", "line 1, column 24: ( expected, not 'id'"), ("ALTER TABLE crew ALTER pay SET", "line 1, column 28: SET NOT NULL"), ("DROP crew", "line 1, column 6: SCHEMA or"),
        ("TRUNCATE crew CASCADE now", "line 1, column 23: the end expected"), ("UPDATE crew SET pay = WHERE id = 1", "line 1, column 23: an expression expected"),
        ("CREATE SEQUENCE s START WITH x", "line 1, column 30: a number expected"),
    ],
)
def test_errors_name_the_place(db, text, error):
    with pytest.raises(QueryError) as e:
        db.execute(text)
    assert str(e.value).startswith(error)


def test_reading_statements_are_left_to_spark():
    for text in ("SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "VALUES (1)", "SHOW TABLES", "(SELECT 1) UNION (SELECT 2)", "-- update\nSELECT 'insert into'"):
        assert sqltext.statement(text) is None


def test_ranges_are_put_into_the_statement():
    in_range = lambda text: sqltext.within(text, "d >= 1 AND d < 2")
    assert in_range("DELETE FROM t WHERE a = 1 OR b = 2") == "DELETE FROM t WHERE (a = 1 OR b = 2) AND d >= 1 AND d < 2"
    assert in_range("UPDATE t SET x = (SELECT max(y) FROM s WHERE s.k = t.k)") == "UPDATE t SET x = (SELECT max(y) FROM s WHERE s.k = t.k) WHERE d >= 1 AND d < 2"
    assert in_range("SELECT a, count(*) FROM t GROUP BY a ORDER BY a") == "SELECT a, count(*) FROM t WHERE d >= 1 AND d < 2 GROUP BY a ORDER BY a"
    assert in_range("WITH c AS (SELECT 1 WHERE true) SELECT * FROM c WHERE a OR b LIMIT 3") == "WITH c AS (SELECT 1 WHERE true) SELECT * FROM c WHERE (a OR b) AND d >= 1 AND d < 2 LIMIT 3"
    with pytest.raises(QueryError):
        in_range("SELECT 1 UNION SELECT 2")


def test_a_split_touches_each_row_once(db):
    days = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=3 * i), i) for i in range(7)]
    db.execute({"insert": {"table": "watch", "values": [[{"literal": d}, h] for d, h in days]}})
    parts = list(split_query(db, "UPDATE watch SET hour = hour + 100 WHERE hour < 2 OR hour > 3", {"on": "watch.day", "size": 5 * 86400}))
    assert len(parts) == 4 and sum(db.execute(p) for p in parts) == 5
    assert sorted(db.query_one_column("SELECT hour FROM watch")) == [2, 3, 100, 101, 104, 105, 106]
    assert len(list(split_query(db, "SELECT * FROM watch", {"on": "watch.day", "size": 10}))) == 19  # whole days, and an end
    assert len(list(split_query(db, {"select": {"data": "hour", "from": "watch"}}, {"on": "watch.hour", "size": 50}))) == 3
