import pytest
from oracle import same

from lakeloom.operators import fingerprint
from lakeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_diff_rows_by_shard(spark):
    row = catalogue.QUERIES["diff_rows_by_shard"](spark, SF).first()
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert row["copied"] + row["skipped"] == n and row["copied"] > 0


def test_edges_of_a_page(spark):
    df = spark.createDataFrame([(i, f"v{9 - i}") for i in range(10)], "id long, v string")
    got = lambda *a: tuple(fingerprint.edges(df, *a).first())
    assert got("v") == ("v0", "v9") and got("v", "id", 3, 4) == ("v2", "v4")
    assert got("v", "id", 3) == ("v7", "v9") and got("id", "id", None, 4) == (5, 9) and got("v", "id", 3, 99) == (None, None)
    assert got("id", None, 2) == (0, 1)
    holes = spark.createDataFrame([(None,), (3,), (None,), (5,)], "x long")
    assert tuple(fingerprint.edges(holes, "x", None, 2).first()) == (3, 5)
