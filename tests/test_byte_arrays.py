"""Arrays in streams of bytes: as text and csv, there and back, and as other writers write them."""

import datetime
import io
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakeloom.database import Database
from lakeloom.operators import transfer

ROWS = [
    Row(id=1, words=["plain", "two words", 'a "quote"', "back\\slash", "{brace}", "a,b", "", "null", "NULL", None, "tab\there", "line\nend", " lead", "über\u2028", "\\N", "'"], nums=[1, None, -3], flags=[True, False, None], nested=[[1, 2], [], None, [None]], days=[datetime.date(2020, 2, 29)], raw=[bytearray(b"\x00\xffA"), None]),
    Row(id=2, words=[], nums=[], flags=[], nested=[], days=[], raw=[]),
    Row(id=3, words=None, nums=None, flags=None, nested=None, days=None, raw=None),
    Row(id=4, words=[None], nums=[0], flags=[None], nested=[[]], days=[None], raw=[bytearray()]),
    Row(id=5, words=['x\\"' * 30000 + "y" * 100000], nums=list(range(5000)), flags=[True], nested=[[9]], days=[], raw=[]),
]
SHAPE = "id int, words array<string>, nums array<int>, flags array<boolean>, nested array<array<int>>, days array<date>, raw array<binary>"
COLUMNS = {"id": "integer", "words": "text[]", "nums": "integer[]", "flags": "boolean[]", "nested": "integer[][]", "days": "date[]", "raw": "bytea[]"}


@pytest.mark.parametrize("form", ["text", "csv"])
def test_arrays_come_back(spark, tmp_path, form):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("lists", {"columns": {k: {"type": v} for k, v in COLUMNS.items()}})
    db.execute({"insert": {"table": "lists", "values": spark.createDataFrame(ROWS, SHAPE)}})
    want = sorted(db.table("lists").collect(), key=lambda r: r["id"])
    assert [r.asDict() for r in want] == [r.asDict() for r in ROWS]
    stream = io.BytesIO()
    assert db.copy_from(stream, "lists", format=form) == 5
    db.copy_from(str(tmp_path / "files"), "lists", format=form)
    for source in (io.BytesIO(stream.getvalue()), str(tmp_path / "files")):
        db.execute("TRUNCATE lists")
        assert db.copy_to("lists", source, format=form) == 5
        assert sorted(db.table("lists").collect(), key=lambda r: r["id"]) == want


def test_text_of_arrays(spark):
    lines = [r["value"] for r in transfer.lines_of(spark.createDataFrame(ROWS[:4], SHAPE).select("nums", "nested", "flags", "raw")).collect()]
    assert lines == ["{1,NULL,-3}\t{{1,2},{},NULL,{NULL}}\t{t,f,NULL}\t" + r'{"\\\\x00ff41",NULL}', "{}\t{}\t{}\t{}", "\\N\t\\N\t\\N\t\\N", "{0}\t{{}}\t{NULL}\t" + r'{"\\\\x"}']


def test_arrays_of_other_writers(spark, tmp_path):
    at = tmp_path / "in.txt"
    at.write_text('{ a , "b", \\\\c d ,nUlL,"null"}\t{ {1 ,2}, {3,4} }\n{}\t{}\n')
    kind = spark.createDataFrame([], "w array<string>, n array<array<int>>").schema
    got = transfer.read_rows(spark, str(at), kind).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c d", None, "null"], [[1, 2], [3, 4]]), ([], [])]


@pytest.mark.parametrize("text", ['{"open}', "1,2", "{1", "{{1},2}", "[1]", '{"a"b"}', "{1}}"])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    at = tmp_path / "in.txt"
    at.write_text(f"{text}\n")
    kind = spark.createDataFrame([], "n array<array<int>>" if text == "{{1},2}" else "n array<string>").schema
    with pytest.raises(Exception, match="COPY|MALFORMED|array"):
        transfer.read_rows(spark, str(at), kind).collect()


def test_random_texts_come_back(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [None if rng.random() < 0.1 else "".join(rng.choice('a{},"\\ \t\n\rNULnul\u00e9') for _ in range(rng.randrange(7))) for _ in range(rng.randrange(5))]) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, w array<string>")
    for form in transfer.FORMATS:
        at = str(tmp_path / form)
        transfer.write_rows(df, at, form)
        assert sorted(tuple(r) for r in transfer.read_rows(spark, at, df.schema, form).collect()) == rows


@pytest.mark.parametrize("form", ["text", "csv"])
def test_plain_lists_need_no_json(spark, tmp_path, monkeypatch, form):
    """Arrays without inner ones, as this writer shows them, are read by their elements; other shapes still go by way of JSON."""
    df = spark.createDataFrame([r for r in ROWS if r.words is None or len(r.words) != 1], SHAPE).select("id", "words", "nums", "flags", "days")
    transfer.write_rows(df, str(tmp_path / "rows"), form)
    (tmp_path / "spaced").write_text("{ a ,b}\n" if form == "text" else '"{ a ,b}"\n')
    monkeypatch.setattr(transfer.F, "from_json", lambda *_: F.struct(F.raise_error(F.lit("by way of JSON")).cast("array<string>").alias("a")))
    read = transfer.read_rows(spark, str(tmp_path / "rows"), df.schema, form).collect()
    assert sorted(read, key=lambda r: r.id) == df.orderBy("id").collect()
    with pytest.raises(Exception, match="by way of JSON"):
        transfer.read_rows(spark, str(tmp_path / "spaced"), df.select("words").schema, form).collect()
