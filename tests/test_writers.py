"""Several writers on one table, changes of several tables, and drivers that die half-way: nothing that was committed is lost."""

import threading
import time

import pytest

from lakeloom.database import Database
from lakeloom.sources import log as logs
from lakeloom.sources import store as stores
from lakeloom.sources.log import Conflict
from lakeloom.sources.store import StoreError

CARGO = {"columns": {"id": {"type": "integer", "primary": True}, "port": {"type": "text"}, "tons": {"type": "integer"}}}


@pytest.fixture
def pair(spark, tmp_path):
    """Two databases on one root, as two drivers would have them."""
    both = [Database(spark, str(tmp_path / "docks")) for _ in range(2)]
    both[0].create_table("cargo", CARGO)
    return both


def run_all(jobs):
    failed = []

    def guarded(job):
        try:
            job()
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=guarded, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def ids(db):
    return sorted(r["id"] for r in db.table("cargo").select("id").collect())


def test_a_number_is_given_once(spark, tmp_path):
    files = stores.Files(spark)
    won = []
    run_all([lambda i=i: won.append(i) if files.create_json(f"{tmp_path}/log/1.json", {"by": i}) else None for i in range(16)])
    assert len(won) == 1 and files.read_json(f"{tmp_path}/log/1.json") == {"by": won[0]} and files.names(f"{tmp_path}/log") == ["1.json"]


def test_200_inserts_of_two_writers_all_stay(pair):
    """Both see one another's rows, parts are merged in tiers, and the whole table is not written anew at each step."""
    insert = lambda db, i: db.store.append("main", "cargo", db.store.meta("main", "cargo"), db.spark.createDataFrame([(i, f"p{i % 5}", i)], "id int, port string, tons int").coalesce(1))
    failed = run_all([lambda db=db, k=k: [insert(db, i) for i in range(k, 200, 4)] for k, db in zip(range(4), pair * 2, strict=True)])
    assert failed == [] and ids(pair[0]) == ids(pair[1]) == list(range(200))
    meta = pair[0].store.meta("main", "cargo")
    assert len(meta["parts"]) < 40 and meta["version"] > 200


def test_statements_of_two_writers(pair):
    a, b = pair
    a.execute("INSERT INTO cargo VALUES (1, 'vik', 10), (2, 'vik', 20)")
    assert ids(b) == [1, 2]  # a reader sees new versions at once
    failed = run_all([lambda: [a.execute(f"INSERT INTO cargo VALUES ({i}, 'a', 0)") for i in (10, 11)], lambda: [b.execute(f"INSERT INTO cargo VALUES ({i}, 'b', 0)") for i in (20, 21)], lambda: Database(a.spark, a.url).execute("UPDATE cargo SET tons = tons + 1 WHERE id = 1")])
    assert failed == [] and ids(a) == ids(b) == [1, 2, 10, 11, 20, 21]
    assert a.query_one_value("SELECT tons FROM cargo WHERE id = 1") == 11


def test_updates_of_the_same_rows_are_run_again(pair):
    pair[0].execute("INSERT INTO cargo VALUES (1, 'vik', 0)")
    failed = run_all([lambda db=db: [db.execute("UPDATE cargo SET tons = tons + 1") for _ in range(3)] for db in pair])
    assert failed == [] and pair[0].query_one_value("SELECT tons FROM cargo") == 6


def test_one_key_from_two_writers(pair):
    failed = run_all([lambda db=db: db.execute("INSERT INTO cargo VALUES (7, 'x', 1)") for db in pair])
    assert [type(e) for e in failed] == [StoreError] and ids(pair[0]) == [7]


def test_a_transaction_that_comes_late_fails_whole(pair):
    a, b = pair
    a.execute(["CREATE TABLE port (name text)", "INSERT INTO cargo VALUES (1, 'vik', 0)"])
    with pytest.raises(Conflict), a.transaction():
        a.execute("UPDATE cargo SET tons = 5")
        a.execute("INSERT INTO port VALUES ('vik')")
        assert a.query_one_value("SELECT tons FROM cargo") == 5 and b.query_one_value("SELECT tons FROM cargo") == 0
        b.execute("UPDATE cargo SET tons = 9")
    assert b.query_one_value("SELECT tons FROM cargo") == 9 and a.table("port").count() == 0
    with a.transaction():
        before = a.table("cargo")
        b.execute("INSERT INTO cargo VALUES (2, 'late', 0)")
        assert a.table("cargo").count() == before.count() == 1  # one state for the whole transaction
    assert a.table("cargo").count() == 2


def test_numbers_are_given_once(pair):
    pair[0].create_table("ticket", {"columns": {"no": {"type": "integer", "sequence": True, "primary": True}, "who": {"type": "text"}}})
    failed = run_all([lambda db=db, k=k: [db.execute(f"INSERT INTO ticket (who) VALUES ('{k}')") for _ in range(3)] for k, db in enumerate(pair)])
    assert failed == [] and sorted(pair[0].query_one_column("SELECT no FROM ticket")) == [1, 2, 3, 4, 5, 6]


def test_foreign_keys_hold_between_writers(pair):
    """One deletes a port, the other adds cargo for it: one of them must fail, whoever is first."""
    a, b = pair
    a.execute(["CREATE TABLE port (name text PRIMARY KEY)", "CREATE TABLE visit (id integer, port text REFERENCES port(name))"])
    for i in range(3):
        a.execute(f"INSERT INTO port VALUES ('p{i}')")
        failed = run_all([lambda i=i: a.execute(f"DELETE FROM port WHERE name = 'p{i}'"), lambda i=i: b.execute(f"INSERT INTO visit VALUES ({i}, 'p{i}')")])
        assert len(failed) == 1 and isinstance(failed[0], StoreError)
        assert a.query_one_value("SELECT count(*) FROM visit LEFT ANTI JOIN port ON visit.port = port.name") == 0


@pytest.mark.parametrize("die_at", ["before", "first", "all", "after"])
def test_a_killed_driver_leaves_either_state(pair, monkeypatch, die_at):
    a, b = pair
    a.execute(["CREATE TABLE port (name text)", "INSERT INTO cargo VALUES (1, 'vik', 0)"])

    class Killed(BaseException):
        pass

    real_put, real_decide, puts = logs.Log.put, logs.decide, []

    def put(self, number, record):
        if die_at == "before" or (die_at == "first" and puts):
            raise Killed
        puts.append(number)
        return real_put(self, number, record)

    def decide(files, root, change, verdict):
        if verdict == "abort" or die_at == "all":  # a dead driver doesn't call anything off
            raise Killed
        real_decide(files, root, change, verdict)
        raise Killed

    monkeypatch.setattr(logs.Log, "put", put)
    monkeypatch.setattr(logs, "decide", decide)
    monkeypatch.setattr(stores, "_undo", lambda store, view: None)
    with pytest.raises(Killed), a.transaction():
        a.execute("UPDATE cargo SET tons = 5")
        a.execute("INSERT INTO port VALUES ('vik')")
    monkeypatch.undo()
    state = lambda db: (db.query_one_value("SELECT tons FROM cargo"), db.table("port").count())
    assert state(b) == ((5, 1) if die_at == "after" else (0, 0))
    b.store.lease = 0.5  # the others wait for the dead one's lease, then call its change off
    b.store.logs.clear()
    began = time.time()
    b.execute("INSERT INTO port VALUES ('sines')")
    b.execute("UPDATE cargo SET tons = tons + 1")
    assert time.time() - began < 60 and state(b) == ((6, 2) if die_at == "after" else (1, 1)) == state(Database(a.spark, a.url))


def test_sessions_have_temporary_tables_of_their_own(pair):
    a, b = pair
    a.execute("INSERT INTO cargo VALUES (1, 'lasting', 0)")
    for db, name in ((a, "north"), (b, "south")):
        db.create_table("cargo", {"columns": {"word": {"type": "text"}}}, temporary=True)
        db.execute(f"INSERT INTO cargo VALUES ('{name}')")
    assert [db.query_one_value("SELECT word FROM cargo") for db in pair] == ["north", "south"]
    a.drop_table("cargo")
    assert ids(a) == [1] and b.query_one_value("SELECT word FROM cargo") == "south"
    b.close()
    assert ids(b) == [1]


def test_columns_named_as_inner_ones(pair):
    a, _ = pair
    names = ["_file", "_row", "_hit", "_to", "_lk_file", "_lk_hit"]
    a.create_table("odd", {"columns": {"id": {"type": "integer", "sequence": True}, **{n: {"type": "integer"} for n in names}}})
    a.execute({"insert": {"table": "odd", "columns": names, "values": [[i] * 6 for i in range(4)]}})
    assert a.execute("UPDATE odd SET _hit = 10, _lk_file = 11 WHERE _file = 2") == 1
    a.execute("UPDATE odd SET _to = c.tons FROM cargo c WHERE odd._row = c.id")
    assert a.execute("DELETE FROM odd WHERE _row = 0") == 1
    assert sorted(tuple(r) for r in a.table("odd").select("_file", "_hit", "_lk_file").collect()) == [(1, 1, 1), (2, 10, 11), (3, 3, 3)]


def test_old_files_go_after_a_while(pair, monkeypatch):
    a, _ = pair
    a.execute("INSERT INTO cargo VALUES (1, 'x', 1), (2, 'y', 2)")
    reader = a.table("cargo")
    for i in range(3):
        a.execute(f"UPDATE cargo SET tons = {i}")
    assert reader.count() == 2  # its files are still there
    monkeypatch.setattr(stores, "RETAIN", -1.0)
    a.execute("UPDATE cargo SET tons = 8")
    a.execute("UPDATE cargo SET tons = 9 WHERE id = 1")
    kept = [n for n in a.store.files.names(a.store.path("main", "cargo")) if n.startswith("d-")]
    assert len(kept) <= 3 and ids(a) == [1, 2]  # the first, empty part among them
