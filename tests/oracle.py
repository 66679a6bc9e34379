"""Compare a query with its SQL, as sets of rows, columns in order of name."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 1000000 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = rows_of(names, want.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert found == expected
