"""Joins by overlap against all pairs, and what their plans must not have."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.operators import bands


def _rows(n, seed, crowd):
    r = random.Random(seed)
    out = []
    for i in range(n):
        low = 50.0 if r.random() < crowd else r.choice([r.uniform(-100, 100), r.uniform(-1e6, 1e6), float(r.randrange(-9, 9)), -0.0])
        length = r.choice([0.0, 0.0, 1e-9, r.random(), r.uniform(0, 40), 10.0 ** r.randrange(7), -3.0])
        out.append((i, low, low + length))
    return [*out, (n, None, 3.0), (n + 1, 3.0, None), (n + 2, float("-inf"), float("inf")), (n + 3, float("nan"), float("nan")), (n + 4, 0.0, 0.0), (n + 4, 0.0, 0.0)]


def _key(x):
    return (1, 0.0) if math.isnan(x) else (0, x)  # NaN is above all numbers and equal to itself


def _meet(a, b, strict):
    if None in (a[1], a[2], b[1], b[2]):
        return False
    first, second = (_key(a[1]), _key(b[2])), (_key(b[1]), _key(a[2]))
    return first[0] < first[1] and second[0] < second[1] if strict else first[0] <= first[1] and second[0] <= second[1]


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    for name, seed in (("a", 1), ("b", 2)):
        db.create_table(name, {"columns": {"id": {"type": "integer"}, "low": {"type": "double"}, "high": {"type": "double"}}})
        db.store.write("main", name, db.store.meta("main", name), spark.createDataFrame(_rows(120, seed, 0.3), "id int, low double, high double"))
    db.create_table("none", {"columns": {"id": {"type": "integer"}, "low": {"type": "double"}, "high": {"type": "double"}}})
    return db


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_spans_that_meet(db, how, strict):
    op = "<" if strict else "<="
    on = {"and": [{op: ["x.low", "y.high"]}, {op: ["y.low", "x.high"]}]}
    df = db.compile({"select": {"data": [{"p": "x.id"}, {"q": "y.id"}], "from": {"x": "a"}, "join": {"to": "b", "as": "y", "type": how, "on": on}}})
    assert "NestedLoop" not in _plan(df) and "Cartesian" not in _plan(df)
    a, b = _rows(120, 1, 0.3), _rows(120, 2, 0.3)
    want = [(x[0], y[0]) for x in a for y in b if _meet(x, y, strict)]
    if how in ("left", "full"):
        want += [(x[0], None) for x in a if not any(_meet(x, y, strict) for y in b)]
    if how in ("right", "full"):
        want += [(None, y[0]) for y in b if not any(_meet(x, y, strict) for x in a)]
    sort = lambda rows: sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))
    assert sort(tuple(r) for r in df.collect()) == sort(want) and len(want) > 500


def test_values_in_bands_side_by_side_and_in_changes(db):
    where = {"and": [{"between": {"value": "x.low", "min": "y.low", "max": "y.high"}}, {">": ["y.id", 3]}, {"<": ["x.id", 90]}]}
    df = db.compile({"select": {"data": [{"p": "x.id"}, {"q": "y.id"}], "from": {"x": "a", "y": "b"}, "where": where}})
    assert "NestedLoop" not in _plan(df) and "Cartesian" not in _plan(df)
    a, b = _rows(120, 1, 0.3), _rows(120, 2, 0.3)
    inside = lambda x, y: None not in (x[1], y[1], y[2]) and _key(y[1]) <= _key(x[1]) <= _key(y[2])
    want = sorted((x[0], y[0]) for x in a for y in b if inside(x, y) and y[0] > 3 and x[0] < 90)
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > 100
    least = {}
    for x in a:
        found = [y[0] for y in b if inside(x, y)]
        least[x[0]] = min(found) + 1000 if found else x[0]
    done = db.execute({"update": {"table": {"x": "a"}, "set": {"id": {"+": ["y.id", 1000]}}, "from": {"y": "b"}, "where": where["and"][0]}})
    assert done == sum(v >= 1000 for k, v in least.items()) + (least[124] >= 1000)
    assert sorted(r[0] for r in db.table("a").select("id").collect()) == sorted(least[x[0]] for x in a)


def test_empty_sides_and_conditions_that_are_no_bands(db):
    on = {"and": [{"<=": ["x.low", "y.high"]}, {"<=": ["y.low", "x.high"]}]}
    count = lambda first, second, how: db.compile({"select": {"data": {"n": {"count": "*"}}, "from": {"x": first}, "join": {"to": second, "as": "y", "type": how, "on": on}}}).first()[0]
    assert [count("a", "none", h) for h in ("inner", "left", "right", "full")] == [0, 126, 0, 126] and count("none", "none", "full") == 0 and count("none", "b", "full") == 126
    from lakeloom.functions.expressions import Context

    ctx = Context()
    ctx.relations |= {"x": ["id", "low", "high"], "y": ["id", "low", "high"]}
    band = lambda c: bands._band(c, ctx, {"x"}, {"y"})
    assert band(on) and band({"<": ["x.low", "y.low"]}) is None and band({"or": [on, on]}) is None
    assert band({"and": [on, {"=": ["x.id", "y.id"]}]}) is None and band({"and": [{"<": ["low", "y.high"]}, {">": ["x.high", "y.low"]}]}) is None
    assert band({"between": {"value": {"-": ["x.low", "y.low"]}, "min": 0, "max": 1}}) is None


def test_bounds_of_other_kinds(spark):
    days = spark.range(400).select(F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("day"), "id")
    spans = spark.range(40).select(F.expr("date_add(DATE '2020-01-01', cast(id * 9 as int))").alias("since"), F.expr("date_add(DATE '2020-01-01', cast(id * 9 + id % 5 as int))").alias("until"), F.col("id").alias("day"))
    from lakeloom.functions.expressions import Context

    ctx = Context()
    ctx.relations |= {"d": days.columns, "s": spans.columns}
    got = bands.joined(days.alias("d"), spans.alias("s"), {"between": {"value": "d.day", "min": "s.since", "max": "s.until"}}, ctx, {"s"})
    assert sorted(tuple(r) for r in got.select("d.id", "s.day").collect()) == [(i * 9 + k, i) for i in range(40) for k in range(i % 5 + 1)]
    times = spark.sql("SELECT TIMESTAMP_NTZ '2021-03-28 01:59:59.999999' + make_interval(0, 0, 0, 0, 0, id * 40, id / 1000) AS t FROM range(90)")
    shown = [r[0] for r in times.select(bands.number(F.col("t"), times.schema[0].dataType)).orderBy("t").collect()]
    assert all(x < y for x, y in zip(shown, shown[1:]))
    mixed = {"and": [{"<=": ["s.since", "d.day"]}, {"<=": ["d.id", "s.day"]}]}
    assert bands.joined(days.alias("d"), spans.alias("s"), mixed, ctx, {"s"}) is None


def test_exclusion_by_overlap(db, spark):
    """Low ends belong to a span, high ones do not; null ends are open, null keys and empty spans meet nothing."""
    from lakeloom.sources.store import StoreError

    db.execute("CREATE TABLE stay (id integer PRIMARY KEY, room text, since date, until date, CONSTRAINT one_guest EXCLUDE USING gist (room WITH =, daterange(since, until) WITH &&))")
    assert db.store.meta("main", "stay")["constraints"]["one_guest"]["overlap"] == ["since", "until"]
    db.execute("INSERT INTO stay VALUES (1, 'a', DATE '2024-01-01', DATE '2024-01-05'), (2, 'a', DATE '2024-01-05', DATE '2024-02-01'), (3, 'b', DATE '2024-01-03', NULL), (4, NULL, DATE '2024-01-01', DATE '2024-03-01'), (5, 'a', DATE '2024-01-02', DATE '2024-01-02')")
    for i, (room, since, until, right) in enumerate([("'a'", "DATE '2024-01-31'", "DATE '2024-02-02'", False), ("'a'", "DATE '2024-02-01'", "DATE '2024-02-02'", True), ("'b'", "DATE '2030-01-01'", "DATE '2030-01-02'", False), ("'b'", "NULL", "DATE '2024-01-03'", True), ("'b'", "NULL", "NULL", False), ("NULL", "NULL", "NULL", True), ("'a'", "DATE '2024-01-03'", "DATE '2024-01-03'", True)]):
        text = f"INSERT INTO stay VALUES ({10 + i}, {room}, {since}, {until})"
        if right:
            db.execute(text)
        else:
            with pytest.raises(StoreError, match="one_guest"):
                db.execute(text)
    with pytest.raises(StoreError, match="one_guest"):  # a copy of one span twice, and a change onto another row's
        db.execute("INSERT INTO stay VALUES (30, 'c', DATE '2024-01-01', DATE '2024-01-05'), (31, 'c', DATE '2024-01-01', DATE '2024-01-05')")
    with pytest.raises(StoreError, match="one_guest"):
        db.execute("UPDATE stay SET until = DATE '2024-01-06' WHERE id = 1")
    db.execute("UPDATE stay SET until = DATE '2024-01-04' WHERE id = 1")
    db.execute({"alter": {"table": {"name": "stay", "rename": [{"column": {"name": "until", "to": "upto"}}]}}})
    assert db.store.meta("main", "stay")["constraints"]["one_guest"]["overlap"] == ["since", "upto"]
    with pytest.raises(StoreError):
        db.create_table("bad", {"columns": {"x": {"type": "text"}, "y": {"type": "text"}}, "constraints": {"k": {"type": "exclude", "columns": ["x", "y"], "overlap": ["x", "y"]}}})


def test_exclusion_against_all_pairs(db, spark):
    from lakeloom.operators.bands import clashes

    r = random.Random(5)
    for n in (2, 6, 12, 40):
        for _ in range(3):
            rows = [(r.randrange(3), low := r.randrange(400), low + r.choice([0, 1, 5, 60])) for _ in range(n)]
            meet = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]
            want = any(meet(x, y) for i, x in enumerate(rows) for y in rows[:i])
            df = spark.createDataFrame(rows, "k int, a int, b int")
            assert clashes(df, ["k"], ["a", "b"]) == want
            assert clashes(df.limit(n // 2), ["k"], ["a", "b"], df.subtract(df.limit(n // 2))) in (want, False)
