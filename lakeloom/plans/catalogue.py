"""Named queries over the sample tables, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..database import Database
from ..operators import fingerprint, replicate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A fresh folder for tables of our own: below the shared checkpoint folder; on one machine (tests) a local one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='lakeloom-')}/tables-{uuid.uuid4().hex}"


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = workspace(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def query(name: str, clause: dict | list, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir, c=clause: Database(spark, sf_dir).compile({"select": c})
    ORACLE_SQL[name] = sql


def made(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


query(
    "revenue_by_nation",
    {
        "data": [{"nation": "n.n_name"}, {"revenue": {"round": [{"sum": {"*": ["l.l_extendedprice", {"-": [1, "l.l_discount"]}]}}, 2]}}, {"n_orders": {"count": {"distinct": "o.o_orderkey"}}}],
        "from": {"l": "lineitem"},
        "join": [
            {"to": "orders", "as": "o", "on": {"=": ["l.l_orderkey", "o.o_orderkey"]}},
            {"to": "customer", "as": "c", "on": {"=": ["o.o_custkey", "c.c_custkey"]}},
            {"to": "nation", "as": "n", "on": {"=": ["c.c_nationkey", "n.n_nationkey"]}},
        ],
        "where": {"<": ["l.l_discount", 0.05]},
        "group": "n.n_name",
        "having": {">": ["n_orders", 3]},
        "order": {"by": "revenue", "desc": True},
        "limit": 20,
    },
    """SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_discount < 0.05 GROUP BY n_name HAVING count(DISTINCT o_orderkey) > 3 ORDER BY revenue DESC LIMIT 20""",
)
query("select_star", {"data": "*", "from": "nation"}, "SELECT * FROM nation")
query("select_alias_list", {"data": ["n_name", {"key": "n_nationkey", "twice": {"*": ["n_nationkey", 2]}}], "from": "nation"}, "SELECT n_name, n_nationkey AS key, n_nationkey * 2 AS twice FROM nation")
query("select_literals_no_from", {"data": {"a": 1, "b": "'text'", "c": 2.5, "d": True}}, "SELECT 1 AS a, 'text' AS b, 2.5::DOUBLE AS d0, true AS d".replace("d0", "c"))
query("filter_and_or_not", {"data": "o_orderkey", "from": "orders", "where": {"and": [{"or": [{"=": ["o_orderstatus", "'F'"]}, {"<": ["o_totalprice", 5000]}]}, {"not": {"=": ["o_orderpriority", "'1-URGENT'"]}}]}}, "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 5000) AND NOT o_orderpriority = '1-URGENT'")
query("filter_between", {"data": "p_partkey", "from": "part", "where": {"between": {"value": "p_size", "min": 5, "max": 9}}}, "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
query("filter_between_symmetric", {"data": "p_partkey", "from": "part", "where": {"between": {"value": "p_size", "min": 9, "max": 5, "symmetric": True}}}, "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
query("filter_in_list", {"data": "n_name", "from": "nation", "where": {"in": ["n_nationkey", [1, 3, 5]]}}, "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)")
query("filter_is_null", {"data": {"with_value": {"count": "value"}, "n": {"count": "*"}}, "from": "events", "where": {"or": [{"is null": "props"}, {"is not null": "value"}]}}, "SELECT count(value) AS with_value, count(*) AS n FROM events WHERE props IS NULL OR value IS NOT NULL")
query("filter_is", {"data": "n_name", "from": "nation", "where": {"is": [{">": ["n_nationkey", 20]}, True]}}, "SELECT n_name FROM nation WHERE (n_nationkey > 20) IS TRUE")
query("like_ilike", {"data": ["c_custkey"], "from": "customer", "where": {"or": [{"like": ["c_mktsegment", "'AUTO%'"]}, {"ilike": ["c_name", "'%9'"]}, {"!~~": ["c_name", "'C%'"]}]}}, "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'AUTO%' OR c_name ILIKE '%9' OR c_name NOT LIKE 'C%'")
query("contains_icontains", {"data": "c_custkey", "from": "customer", "where": {"or": [{"contains": ["c_mktsegment", "'BUILD'"]}, {"icontains": ["c_mktsegment", "'house'"]}]}}, "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%BUILD%' OR c_mktsegment ILIKE '%house%'")
query("case_when", {"data": {"k": "p_partkey", "band": {"case": [{"when": {"<": ["p_size", 10]}, "then": "'small'"}, {"when": {"<": ["p_size", 30]}, "then": "'medium'"}, {"else": "'large'"}]}}, "from": "part"}, "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part")
query("arith_ops", {"data": {"k": "p_partkey", "a": {"+": ["p_size", 1, 2]}, "b": {"-": ["p_size", 3]}, "c": {"/": ["p_size", 4]}, "d": {"%": ["p_size", 7]}, "e": {"-": "p_size"}}, "from": "part"}, "SELECT p_partkey AS k, p_size + 1 + 2 AS a, p_size - 3 AS b, p_size / 4 AS c, p_size % 7 AS d, -p_size AS e FROM part")
query("bitwise_ops", {"data": {"k": "n_nationkey", "a": {"&": ["n_nationkey", 6]}, "b": {"|": ["n_nationkey", 6]}, "c": {"<<": ["n_nationkey", 2]}, "d": {">>": ["n_nationkey", 1]}, "e": {"~": "n_nationkey"}}, "from": "nation"}, "SELECT n_nationkey AS k, n_nationkey & 6 AS a, n_nationkey | 6 AS b, n_nationkey << 2 AS c, n_nationkey >> 1 AS d, ~n_nationkey AS e FROM nation")
query("pow_xor_abs_sqrt_fact", {"data": {"k": "n_nationkey", "p": {"^": ["n_nationkey", 2]}, "x": {"#": ["n_nationkey", 5]}, "a": {"@": {"-": [3, "n_nationkey"]}}, "s": {"|/": "n_nationkey"}, "f": {"!": {"%": ["n_nationkey", 10]}}}, "from": "nation"}, "SELECT n_nationkey AS k, pow(n_nationkey, 2) AS p, xor(n_nationkey, 5) AS x, abs(3 - n_nationkey) AS a, sqrt(n_nationkey) AS s, factorial(n_nationkey % 10)::BIGINT AS f FROM nation")
query("concat_ops", {"data": {"a": {"||": ["n_name", "'-'", "n_nationkey"]}, "b": {"concat": ["n_name", None, "'x'"]}, "c": {"upper": {"lower": "n_name"}}}, "from": "nation"}, "SELECT n_name || '-' || n_nationkey AS a, concat(n_name, NULL, 'x') AS b, upper(lower(n_name)) AS c FROM nation")

ON = {"=": ["n.n_regionkey", "r.r_regionkey"]}
SOME = {"and": [ON, {"<": ["n.n_nationkey", 7]}]}
for kind, how in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"join_{kind}", {"data": ["n.n_name", "r.r_name"], "from": {"n": "nation"}, "join": {"to": "region", "as": "r", "on": SOME, "type": kind}}, f"SELECT n_name, r_name FROM nation n {how} region r ON n_regionkey = r_regionkey AND n_nationkey < 7")
query("join_cross", {"data": ["n.n_name", "r.r_name"], "from": {"n": "nation"}, "join": {"to": "region", "as": "r", "type": "cross"}}, "SELECT n_name, r_name FROM nation CROSS JOIN region")
query("join_comma", {"data": ["n.n_name", "r.r_name"], "from": [{"n": "nation"}, {"r": "region"}], "where": ON}, "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
query("join_theta", {"data": {"a": "n.n_nationkey", "b": "r.r_regionkey"}, "from": {"n": "nation"}, "join": {"to": "region", "as": "r", "on": {"<": ["n.n_nationkey", "r.r_regionkey"]}}}, "SELECT n_nationkey AS a, r_regionkey AS b FROM nation JOIN region ON n_nationkey < r_regionkey")
query("join_self", {"data": {"a": "x.n_name", "b": "y.n_name"}, "from": {"x": "nation"}, "join": {"to": "nation", "as": "y", "on": {"and": [{"=": ["x.n_regionkey", "y.n_regionkey"]}, {"<": ["x.n_nationkey", "y.n_nationkey"]}]}}}, "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
query("join_subquery", {"data": {"c": "c.c_custkey", "n": "t.n"}, "from": {"c": "customer"}, "join": {"to": {"select": {"data": ["o_custkey", {"n": {"count": "*"}}], "from": "orders", "group": "o_custkey"}}, "as": "t", "on": {"=": ["c.c_custkey", "t.o_custkey"]}}}, "SELECT c_custkey AS c, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON c_custkey = o_custkey")
INNER = {"select": {"data": 1, "from": {"o": "orders"}, "where": {"and": [{"=": ["o.o_custkey", "c.c_custkey"]}, {">": ["o.o_totalprice", 100000]}]}}}
query("semi_exists", {"data": "c.c_custkey", "from": {"c": "customer"}, "where": {"exists": INNER}}, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
query("anti_not_exists", {"data": "c.c_custkey", "from": {"c": "customer"}, "where": {"not": {"exists": INNER}}}, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
query("in_subquery", {"data": "n_name", "from": "nation", "where": {"in": ["n_regionkey", {"select": {"data": "r_regionkey", "from": "region", "where": {"like": ["r_name", "'A%'"]}}}]}}, "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
query("lateral_join", {"data": ["r.r_name", "u.top"], "from": [{"r": "region"}, {"u": {"lateral": {"select": {"data": {"top": {"max": "n.n_nationkey"}}, "from": {"n": "nation"}, "where": ON}}}}]}, "SELECT r_name, top FROM region r, LATERAL (SELECT max(n_nationkey) AS top FROM nation n WHERE n.n_regionkey = r.r_regionkey) u")

query("group_by", {"data": ["l_returnflag", "l_linestatus", {"n": {"count": "*"}, "qty": {"sum": "l_quantity"}, "top": {"max": "l_extendedprice"}, "least": {"min": "l_discount"}}], "from": "lineitem", "group": ["l_returnflag", "l_linestatus"]}, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS top, min(l_discount) AS least FROM lineitem GROUP BY ALL")
query("group_rollup", {"data": ["n_regionkey", {"odd": "n_name"}, {"n": {"count": "*"}}], "from": "nation", "group": {"by": ["n_regionkey", "n_name"], "rollup": True}}, "SELECT n_regionkey, n_name AS odd, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
query("having_alias", {"data": ["o_custkey", {"n": {"count": "*"}}], "from": "orders", "group": "o_custkey", "having": {">": ["n", 12]}}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
query("global_agg", {"data": {"n": {"count": "*"}, "lo": {"min": "o_totalprice"}, "hi": {"max": "o_totalprice"}}, "from": "orders"}, "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
query("count_distinct", {"data": {"n": {"count": {"distinct": "o_custkey"}}}, "from": "orders"}, "SELECT count(DISTINCT o_custkey) AS n FROM orders")
query("select_distinct", {"data": {"distinct": ["c_mktsegment", "c_nationkey"]}, "from": "customer"}, "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
query("array_agg_join", {"data": ["n_regionkey", {"names": {"array_to_string": [{"array_sort": {"array_agg": "n_name"}}, "','"]}}], "from": "nation", "group": "n_regionkey"}, "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
query("json_agg_rows", {"data": {"rows": {"json_build_array": ["r_regionkey", "r_name", None]}, "object": {"json_build_object": ["'k'", "r_regionkey"]}}, "from": "region"}, "SELECT '[' || r_regionkey || ', \"' || r_name || '\", null]' AS rows, '{\"k\": ' || r_regionkey || '}' AS object FROM region")
query("other_aggregates", {"data": ["o_orderstatus", {"spread": {"round": [{"stddev": "o_totalprice"}, 4]}, "mean": {"round": [{"avg": "o_totalprice"}, 4]}}], "from": "orders", "group": "o_orderstatus"}, "SELECT o_orderstatus, round(stddev(o_totalprice), 4) AS spread, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus")

query("order_desc_nulls", {"data": {"k": "p_partkey", "s": {"nullif": ["p_size", 1]}}, "from": "part", "order": [{"by": "s", "desc": True}, "k"], "limit": 30}, "SELECT p_partkey AS k, nullif(p_size, 1) AS s FROM part ORDER BY s DESC NULLS FIRST, k LIMIT 30")
query("limit_offset", {"data": "o_orderkey", "from": "orders", "order": "o_orderkey", "limit": 25, "offset": 50}, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
query("topk", {"data": ["o_orderkey", "o_totalprice"], "from": "orders", "order": [{"by": "o_totalprice", "ascending": False}, "o_orderkey"], "limit": 10}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
query("union_all", [{"data": {"k": "n_nationkey"}, "from": "nation"}, {"data": {"k": "r_regionkey"}, "from": "region"}], "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
query("union_distinct_order_limit", {"data": {"k": "n_regionkey"}, "from": "nation", "union": [{"select": {"data": {"k": "r_regionkey"}, "from": "region"}}, {"select": {"data": {"k": "n_nationkey"}, "from": "nation"}}], "order": {"by": "k", "desc": True}, "limit": 8}, "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT n_nationkey FROM nation ORDER BY k DESC LIMIT 8")
query("cte_single", {"with": {"as": "big", "query": {"select": {"data": "*", "from": "orders", "where": {">": ["o_totalprice", 200000]}}}}, "data": {"n": {"count": "*"}}, "from": "big"}, "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT count(*) AS n FROM big")
query("cte_multi", {"with": [{"as": "a", "query": {"select": {"data": "*", "from": "nation", "where": {"<": ["n_nationkey", 10]}}}}, {"as": "b", "query": {"select": {"data": ["n_regionkey", {"n": {"count": "*"}}], "from": "a", "group": "n_regionkey"}}}], "data": ["b.n_regionkey", "b.n"], "from": "b"}, "WITH a AS (SELECT * FROM nation WHERE n_nationkey < 10), b AS (SELECT n_regionkey, count(*) AS n FROM a GROUP BY n_regionkey) SELECT * FROM b")
query("derived_table", {"data": {"k": "t.k"}, "from": {"t": {"select": {"data": {"k": {"+": ["n_nationkey", 100]}}, "from": "nation"}}}}, "SELECT n_nationkey + 100 AS k FROM nation")
query("scalar_subquery", {"data": {"r": "r_name", "n": {"select": {"data": {"c": {"count": "*"}}, "from": {"n": "nation"}, "where": {"=": ["n.n_regionkey", "region.r_regionkey"]}}}}, "from": "region"}, "SELECT r_name AS r, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
query("generate_series", {"data": {"v": "S", "w": {"concat": ["'name'", "S"]}}, "from": {"S": {"generate_series": [1, 100]}}}, "SELECT i AS v, concat('name', i) AS w FROM range(1, 101) t(i)")
query("call_function_md5", {"data": {"k": "n_nationkey", "h": {"md5": "n_name"}}, "from": "nation"}, "SELECT n_nationkey AS k, md5(n_name) AS h FROM nation")


@made("udf_call", "SELECT n_nationkey AS k, length(n_name) + 1 AS v FROM nation")
def _udf(spark, sf_dir):
    @F.pandas_udf("bigint")
    def longer(s: pd.Series) -> pd.Series:
        return s.str.len() + 1

    db = Database(spark, sf_dir)
    db.register_function("longer", longer)
    return db.compile({"select": {"data": {"k": "n_nationkey", "v": {"longer": "n_name"}}, "from": "nation"}})


def _model(name, build, sql):
    QUERIES[name] = lambda spark, sf_dir: (lambda db: db.compile(build(db)))(Database(spark, sf_dir))
    ORACLE_SQL[name] = sql


_model("model_where_kwargs", lambda db: db.get_model("orders").where(o_orderstatus="F", o_totalprice__gt=150000).take("o_orderkey").select(), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
_model("model_take_exclude", lambda db: db.get_model("nation").take("*", "-n_name", up={"upper": "n_name"}).select(), "SELECT n_nationkey, n_regionkey, upper(n_name) AS up FROM nation")
_model("model_sort_limit", lambda db: db.get_model("orders").take("o_orderkey", "o_totalprice").sort("-o_totalprice", "o_orderkey").limit(15).select(), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
_model("model_count", lambda db: db.get_model("orders").where(o_orderstatus="O").select(count=True), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'")
_model("model_join", lambda db: db.get_model("nation").take("n_name", region="r.r_name").join({"to": "region", "as": "r", "on": {"=": ["nation.n_regionkey", "r.r_regionkey"]}}).select(), "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")


@made("model_key_lookup", "SELECT n_name, n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 7")
def _key(spark, sf_dir):
    db = _loaded(spark, sf_dir, "nation", "n_nationkey")
    return db.compile(db.get_model("nation").key(7).select())


def _loaded(spark: SparkSession, sf_dir: str, table: str, key: str | None = None, rows: DataFrame | None = None, alias: str | None = None) -> Database:
    """A database of our own with a copy of one table."""
    from ..sources.store import definition

    db = Database(spark, workspace(spark))
    source = Database(spark, sf_dir)
    rows = rows if rows is not None else source.table(table)
    meta = {"columns": source.store.meta("main", table)["columns"]}
    if key:
        meta["columns"] = {k: v | ({"primary": True} if k == key else {}) for k, v in meta["columns"].items()}
    db.store.write("main", alias or table, definition(alias or table, meta), rows, check=False)
    return db


def _change(name: str, table: str, statements: list[dict], sql: str, key: str | None = None, returned: bool = False) -> None:
    def run(spark, sf_dir):
        db = _loaded(spark, sf_dir, table, key)
        out = None
        for s in statements:
            out = db.execute(s)
        return out if returned else db.table(table)

    QUERIES[name], ORACLE_SQL[name] = run, sql


_change("insert_values_default", "region", [{"insert": {"table": "region", "columns": ["r_regionkey", "r_name"], "values": [[10, "'NEW'"], [11, {"concat": ["'X'", "'Y'"]}]]}}, {"insert": {"table": "region", "columns": ["r_regionkey"], "values": [12]}}], "SELECT * FROM region UNION ALL VALUES (10, 'NEW'), (11, 'XY'), (12, NULL)")
_change("insert_returning", "region", [{"insert": {"table": "region", "values": [[20, "'A'"]], "return": {"k": {"+": ["r_regionkey", 1]}}}}], "SELECT 21 AS k", returned=True)
_change("update_where", "nation", [{"update": {"table": "nation", "set": {"n_name": {"concat": ["n_name", "'!'"]}}, "where": {"<": ["n_nationkey", 5]}}}], "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
_change("delete_where", "nation", [{"delete": {"table": "nation", "where": {"=": ["n_regionkey", 2]}}}], "SELECT * FROM nation WHERE n_regionkey <> 2")
_change("delete_returning", "nation", [{"delete": {"table": "nation", "where": {"=": ["n_regionkey", 2]}, "return": ["n_nationkey", {"name": "n_name"}]}}], "SELECT n_nationkey, n_name AS name FROM nation WHERE n_regionkey = 2", returned=True)
_change("truncate", "nation", [{"truncate": "nation"}], "SELECT * FROM nation WHERE false")
_change("alter_add_column_default", "region", [{"alter": {"table": {"name": "region", "add": {"column": {"name": "size", "type": "integer", "default": 7}}}}}, {"alter": {"column": {"name": "region.r_name", "rename": "title"}}}], "SELECT r_regionkey, r_name AS title, 7 AS size FROM region")


def _two(spark: SparkSession, sf_dir: str) -> Database:
    db = _loaded(spark, sf_dir, "nation")
    other = _loaded(spark, sf_dir, "region")
    db.store.write("main", "region", other.store.meta("main", "region"), other.table("region"))
    return db


@made("insert_select", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def _insert_select(spark, sf_dir):
    db = _two(spark, sf_dir)
    db.execute({"insert": {"table": "region", "columns": ["r_regionkey", "r_name"], "values": {"select": {"data": [{"k": {"+": ["n_nationkey", 100]}}, "n_name"], "from": "nation", "where": {"=": ["n_regionkey", 1]}}}}})
    return db.table("region")


@made("update_from_join", "SELECT n_nationkey, r_name AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name LIKE 'A%' UNION ALL SELECT nation.* FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name NOT LIKE 'A%'")
def _update_from(spark, sf_dir):
    db = _two(spark, sf_dir)
    db.execute({"update": {"table": {"n": "nation"}, "set": {"n_name": "r.r_name"}, "from": {"r": "region"}, "where": {"and": [{"=": ["n.n_regionkey", "r.r_regionkey"]}, {"like": ["r.r_name", "'A%'"]}]}}})
    return db.table("nation")


@made("update_subquery", "SELECT r_regionkey, (SELECT max(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS r_name FROM region")
def _update_subquery(spark, sf_dir):
    db = _two(spark, sf_dir)
    db.execute({"update": {"table": {"r": "region"}, "set": ["r_name", {"select": {"data": {"m": {"max": "n.n_name"}}, "from": {"n": "nation"}, "where": {"=": ["n.n_regionkey", "r.r_regionkey"]}}}]}})
    return db.table("region")


@made("ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _ctas(spark, sf_dir):
    db = _two(spark, sf_dir)
    db.execute({"create": {"table": {"name": "counts", "as": {"select": {"data": ["n_regionkey", {"n": {"count": "*"}}], "from": "nation", "group": "n_regionkey"}}}}})
    return db.table("counts")


@made("constraint_violations_pk_fk_check", "SELECT unnest(['a__pk', 'b__ck']) AS name")
def _violations(spark, sf_dir):
    db = _two(spark, sf_dir)
    rows = db.table("nation").unionByName(db.table("nation").limit(1))
    meta = db.store.meta("main", "nation")
    meta = {**meta, "constraints": {"a__pk": {"type": "primary", "columns": ["n_nationkey"]}, "b__ck": {"type": "check", "columns": [], "check": {"<": ["n_nationkey", 20]}}, "c__fk": {"type": "foreign", "columns": ["n_regionkey"], "related_name": "region", "related_columns": ["r_regionkey"]}}}
    meta["constraints"] = {k: {"deferred": False, "deferrable": False, "check": None, **v} for k, v in meta["constraints"].items()}
    return spark.createDataFrame([(v,) for v in db.store.violations("main", "nation", meta, rows)], "name string")


@made("info_count_range", "SELECT count(*) AS count, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def _info(spark, sf_dir):
    info = _loaded(spark, sf_dir, "orders", "o_orderkey").get_info(schema=False)["main"]["orders"]["rows"]
    r = info["range"]["o_orderkey"]
    return spark.createDataFrame([(info["count"], r["min"], r["max"])], "count long, lo long, hi long")


SHARDS = "(SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 AS shard FROM orders)"


@made("shard_stats", f"SELECT min(o_orderkey) AS min_pk, max(o_orderkey) AS max_pk, count(*) AS count FROM {SHARDS} GROUP BY shard")
def _shards(spark, sf_dir):
    rows = fingerprint.numbered(Database(spark, sf_dir).table("orders"), "o_orderkey", 4000)
    return rows.groupBy("_shard").agg(F.min("o_orderkey").alias("min_pk"), F.max("o_orderkey").alias("max_pk"), F.count("*").alias("count")).drop("_shard")


@made("shard_md5", f"""SELECT min(o_orderkey) AS min_pk, max(o_orderkey) AS max_pk, count(*) AS count, md5(string_agg('[' || to_json(o_custkey) || ', ' || to_json(o_orderkey) || ', ' || to_json(o_orderpriority) || ', ' || to_json(o_orderstatus) || ']', ',' ORDER BY o_orderkey)) AS md5
    FROM {SHARDS} GROUP BY shard""")
def _md5(spark, sf_dir):
    names = ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return fingerprint.shard_hashes(Database(spark, sf_dir).table("orders"), "o_orderkey", {c: c for c in names}, 4000)


@made("keyset_page", "SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def _page(spark, sf_dir):
    return fingerprint.keyset_page(Database(spark, sf_dir).table("orders"), "o_orderkey", 100, 500)


@made("page_statistics", "SELECT count(*) AS count, min(o_orderkey) AS min, max(o_orderkey) AS max FROM (SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100)")
def _statistics(spark, sf_dir):
    return fingerprint.statistics(Database(spark, sf_dir).table("orders"), "o_orderkey", limit=100, cursor=500)


@made("edge_min_max", "SELECT min(c_name) AS min, max(c_name) AS max FROM customer")
def _edges(spark, sf_dir):
    return fingerprint.edges(Database(spark, sf_dir).table("customer"), "c_name")


CHANGED = "o_orderkey % 97 = 5"


def _altered(df: DataFrame) -> DataFrame:
    """A target that lacks some rows, has others changed, and holds some that the source lacks."""
    k = F.col("o_orderkey")
    top = df.agg(F.max("o_orderkey")).first()[0] or 0
    kept = df.filter((k % 211 != 3) & (k < top - 5)).withColumn("o_totalprice", F.when(F.expr(CHANGED), 0.0).otherwise(F.col("o_totalprice")))
    return kept.unionByName(df.limit(3).withColumn("o_orderkey", k + 10 * (top + 1)))


@made("copy_first_run", "SELECT * FROM orders")
def _copy_first(spark, sf_dir):
    source = Database(spark, sf_dir)
    target = Database(spark, workspace(spark))
    source.copy(target, {"schemas": {"main": {"tables": {"orders": True}}}}, final_diff=False)
    return target.table("orders")


@made("copy_incremental", "SELECT * FROM orders")
def _copy_again(spark, sf_dir):
    rows = Database(spark, sf_dir).table("orders")
    source = _loaded(spark, sf_dir, "orders", "o_orderkey")
    target = _loaded(spark, sf_dir, "orders", "o_orderkey", _altered(rows))
    source.shard_rows = target.shard_rows = 1000
    source.copy(target, final_diff=False)
    return target.table("orders")


@made("diff_rows_by_shard", f"""WITH top AS (SELECT max(o_orderkey) AS top FROM orders), s AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders),
    bad AS (SELECT DISTINCT shard FROM s, top WHERE o_orderkey % 211 = 3 OR o_orderkey >= top - 5 OR ({CHANGED} AND o_totalprice <> 0))
    SELECT count(*) FILTER (shard IN (SELECT shard FROM bad)) AS copied, count(*) FILTER (shard NOT IN (SELECT shard FROM bad)) AS skipped FROM s""")
def _diff(spark, sf_dir):
    rows = Database(spark, sf_dir).table("orders")
    new, copied, skipped = replicate.copy_rows(rows, _altered(rows), "o_orderkey", 1000, lambda df: _kept(spark, df))
    return spark.createDataFrame([(copied, skipped)], "copied long, skipped long")


# functions

query(
    "json_agg_values",
    {"data": ["n_regionkey", {"names": {"json_agg": "n_name"}}], "from": {"n": {"select": {"data": ["n_regionkey", {"n_name": {"min": "n_name"}}], "from": "nation", "group": "n_regionkey"}}}, "group": "n_regionkey"},
    "SELECT n_regionkey, '[\"' || min(n_name) || '\"]' AS names FROM nation GROUP BY n_regionkey",
)
query(
    "group_concat_lengths",
    {"data": ["n_regionkey", {"chars": {"length": {"group_concat": "n_name"}}}], "from": "nation", "group": "n_regionkey"},
    "SELECT n_regionkey, length(string_agg(n_name, ',')) AS chars FROM nation GROUP BY n_regionkey",
)
query(
    "age_of_orders",
    {"data": ["o_orderkey", {"days": {"datediff": [{"cast": [{"+": [{"cast": ["o_orderdate", "'timestamp'"]}, {"age": [{"cast": ["o_orderdate", "'timestamp'"]}, {"literal": datetime.datetime(1990, 1, 1)}]}]}, "'date'"]}, "o_orderdate"]}}], "from": "orders"},
    "SELECT o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS days FROM orders",
)
query("now_is_later", {"data": {"n": {"count": "*"}}, "from": "orders", "where": {"<": ["o_orderdate", {"now": None}]}}, "SELECT count(*) AS n FROM orders WHERE o_orderdate < now()::TIMESTAMP")
query("unnest_array", {"data": ["n_nationkey", {"v": {"unnest": {"array": ["n_regionkey", 100]}}}], "from": "nation"}, "SELECT n_nationkey, unnest([n_regionkey, 100]) AS v FROM nation")
query(
    "array_length_of_groups", {"data": ["n_regionkey", {"n": {"array_length": [{"array_agg": "n_name"}, 1]}}], "from": "nation", "group": "n_regionkey"},
    "SELECT n_regionkey, count(n_name)::INTEGER AS n FROM nation GROUP BY n_regionkey",
)
query("array_to_json_pairs", {"data": ["n_nationkey", {"j": {"array_to_json": {"array": ["n_nationkey", "n_regionkey"]}}}], "from": "nation"}, "SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS j FROM nation")
query("equals_any_array", {"data": ["n_nationkey", "n_name"], "from": "nation", "where": {"=": ["n_regionkey", {"any": {"array": [1, 3]}}]}}, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
query(
    "above_all_of_select", {"data": "c_custkey", "from": "customer", "where": {">": ["c_acctbal", {"all": {"select": {"data": "c_acctbal", "from": "customer", "where": {"=": ["c_nationkey", 3]}}}}]}},
    "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = 3)",
)
query("keyword_values", {"data": ["r_regionkey", {"nothing": {"coalesce": [{"null": None}, "r_name"]}}, {"past": {"<": [{"cast": ["'2001-02-03'", "'timestamp'"]}, {"current_timestamp": None}]}}], "from": "region"}, "SELECT r_regionkey, r_name AS nothing, true AS past FROM region")


@made("edge_after_cursor", "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM (SELECT * FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 250)")
def _edge_page(spark, sf_dir):
    return fingerprint.edges(Database(spark, sf_dir).table("orders"), "o_totalprice", "o_orderkey", 250, 700)


# statements as text, and what they leave

_NATION = "CREATE TABLE nation (id integer PRIMARY KEY, name text, region integer)"


def _text(spark, sf_dir, *statements: str) -> Database:
    db = Database(spark, workspace(spark))
    db.create_schema("raw")
    replicated = {"schemas": {"main": {"target": "raw", "tables": {"nation": True, "region": True}}}}
    Database(spark, sf_dir).copy(db, replicated, final_diff=False)
    db.execute([_NATION, "INSERT INTO nation SELECT n_nationkey, n_name, n_regionkey FROM raw.nation", *statements])
    return db


@made("text_changes", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN r_name ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN -n_regionkey ELSE n_regionkey END AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7")
def _text_changes(spark, sf_dir):
    return _text(
        spark, sf_dir, "DELETE FROM nation WHERE id = 7", "UPDATE nation SET region = -region WHERE id % 2 = 0",
        "UPDATE nation SET name = r.r_name FROM raw.region r WHERE abs(nation.region) = r.r_regionkey AND nation.id < 5",
    ).table("nation")


@made("text_same_name_in_two_schemas", "SELECT a.n_nationkey AS id, a.n_name || ' main.nation' AS name, b.n_regionkey AS region FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1")
def _text_schemas(spark, sf_dir):
    return _text(spark, sf_dir).compile("SELECT nation.id, concat(name, ' main.nation') AS name, n_regionkey AS region FROM nation JOIN raw.nation AS r ON nation.id = r.n_nationkey + 1")


@made("text_alter_rename_drop", "SELECT n_nationkey AS id, n_name AS title, 1 AS seen FROM nation")
def _text_alter(spark, sf_dir):
    db = _text(
        spark, sf_dir, "ALTER TABLE nation ADD COLUMN seen integer DEFAULT 1", "ALTER TABLE nation RENAME COLUMN name TO title", "ALTER TABLE nation DROP COLUMN region",
        "ALTER TABLE nation RENAME TO state", "DROP SCHEMA raw CASCADE",
    )
    assert db.store.schemas() == ["main"]
    return db.table("state")


@made("insert_with_nextval", "SELECT 95 + 5 * row_number() OVER (ORDER BY n_nationkey) AS no, n_nationkey AS id FROM nation")
def _nextval(spark, sf_dir):
    db = _text(spark, sf_dir, "CREATE SEQUENCE ticket START WITH 100 INCREMENT BY 5")
    db.create_table("queue", {"columns": {"no": {"type": "integer", "default": {"nextval": "'ticket'"}}, "id": {"type": "integer"}}})
    db.execute({"insert": {"table": "queue", "columns": ["id"], "values": {"select": {"data": "id", "from": "nation", "order": "id"}}}})
    got = db.table("queue")  # which row gets which number is open: pair them in order
    w = Window.partitionBy(F.lit(0))
    return got.select(F.row_number().over(w.orderBy("no")).alias("k"), "no").join(got.select(F.row_number().over(w.orderBy("id")).alias("k"), "id"), "k").select(F.col("no").cast("long"), "id")


@made("insert_with_clause", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT n_nationkey + 100, n_name, 9 FROM nation WHERE n_regionkey = 2")
def _insert_with(spark, sf_dir):
    db = _text(spark, sf_dir)
    few = {"as": "few", "query": {"select": {"data": ["id", "name"], "from": "nation", "where": {"=": ["region", 2]}}}}
    db.execute({"insert": {"table": "nation", "with": few, "values": {"select": {"data": [{"i": {"+": ["id", 100]}}, "name", {"r": 9}], "from": "few"}}}})
    return db.table("nation")


@made("copy_null_swap", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS b FROM orders")
def _null_swap(spark, sf_dir):
    source, target = Database(spark, workspace(spark)), Database(spark, workspace(spark))
    orders = Database(spark, sf_dir).table("orders")
    for db, even in ((source, 0), (target, 1)):
        odd = F.col("o_orderkey") % 2 == even
        db.create_table("t", {"columns": {"k": {"type": "bigint", "primary": True}, "a": {"type": "text"}, "b": {"type": "text"}}})
        part = orders.select(F.col("o_orderkey").alias("k"), F.when(odd, F.col("o_orderpriority")).alias("a"), F.when(~odd, F.col("o_orderpriority")).alias("b"))
        db.store.write("main", "t", db.store.meta("main", "t"), part)
    source.copy(target, final_diff=False)
    return target.table("t")


@made("diff_of_databases", "SELECT count(*) AS source_rows, count(*) FILTER (o_orderkey % 10 <> 0) AS target_rows, min(o_orderkey) FILTER (o_orderkey % 10 <> 0) AS target_min FROM orders")
def _diff_databases(spark, sf_dir):
    orders = Database(spark, sf_dir).table("orders")
    source, target = _loaded(spark, sf_dir, "orders", "o_orderkey"), _loaded(spark, sf_dir, "orders", "o_orderkey", orders.filter("o_orderkey % 10 <> 0"))
    d = source.diff(target, schema=False)["main"]["orders"]["rows"]
    low = d.get("range", {}).get("o_orderkey", {}).get("min") or [None, source.table("orders").agg(F.min("o_orderkey")).first()[0]]
    return spark.createDataFrame([(d["count"][0], d["count"][1], low[1])], "source_rows long, target_rows long, target_min long")


@made("apply_definition", "SELECT * FROM (VALUES ('id', 'integer', true), ('name', 'text', false), ('note', 'text', false)) AS t(name, type, is_key)")
def _apply(spark, sf_dir):
    db = _text(spark, sf_dir)
    wanted = {"id": {"type": "integer", "null": False, "primary": True}, "name": {"type": "text"}, "note": {"type": "text"}}
    db.apply({"main": {"nation": {"columns": wanted}}})
    assert db.apply({"main": {"nation": {"columns": wanted}}}) == {}
    columns = db.get_info(data=False)["main"]["nation"]["columns"]
    return spark.createDataFrame([(k, v["type"], bool(v["primary"])) for k, v in columns.items()], "name string, type string, is_key boolean")


# more statements as text


@made("text_update_returning", "SELECT n_nationkey AS id, upper(n_name) AS title, n_regionkey * 2 AS twice FROM nation WHERE n_regionkey = 1")
def _text_update_returning(spark, sf_dir):
    return _text(spark, sf_dir).execute("UPDATE nation SET name = upper(name) WHERE region = 1 RETURNING id, name AS title, region * 2 AS twice")


@made("text_insert_returning", "SELECT n_nationkey + 100 AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 3")
def _text_insert_returning(spark, sf_dir):
    return _text(spark, sf_dir).execute("INSERT INTO nation (id, name, region) SELECT id + 100, name, region FROM nation WHERE region = 3 RETURNING *")


@made("text_with_before_changes", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'in ' || n_regionkey ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_name NOT LIKE '%A' UNION ALL SELECT n_nationkey + 500, n_name, 0 FROM nation WHERE n_nationkey < 4")
def _text_with(spark, sf_dir):
    return _text(
        spark, sf_dir,
        "WITH gone AS (SELECT n_nationkey AS k FROM raw.nation WHERE n_name LIKE '%A') DELETE FROM nation AS n USING gone WHERE n.id = gone.k",
        "WITH two (k, label) AS (SELECT id, concat('in ', region) FROM nation WHERE region = 2), again AS (SELECT * FROM two) UPDATE nation SET name = again.label FROM again WHERE nation.id = again.k",
        "WITH few AS (SELECT * FROM raw.nation WHERE n_nationkey < 4) INSERT INTO nation SELECT n_nationkey + 500, n_name, 0 FROM few",
    ).table("nation")


@made("text_defaults", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT n_nationkey + 200, n_name, 42 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey + 300, 'none', 42 FROM nation WHERE n_nationkey = 8 UNION ALL SELECT 999, 'none', 42")
def _text_defaults(spark, sf_dir):
    db = _text(
        spark, sf_dir, "ALTER TABLE nation ALTER COLUMN region SET DEFAULT 42, ALTER name SET DEFAULT 'none'", "INSERT INTO nation (id, name) SELECT id + 200, name FROM nation WHERE region = 0",
        "INSERT INTO nation VALUES ((SELECT max(id) FROM nation WHERE id < 100) + 284, DEFAULT, DEFAULT)", "ALTER TABLE nation ALTER id SET DEFAULT 999", "INSERT INTO nation DEFAULT VALUES",
    )
    return db.table("nation")


@made("text_delete_using", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE 'A%'")
def _text_delete_using(spark, sf_dir):
    return _text(spark, sf_dir, "DELETE FROM nation USING raw.region r WHERE nation.region = r.r_regionkey AND r.r_name LIKE 'A%'").table("nation")


@made("text_update_row_of_select", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 9 THEN r_name ELSE n_name END AS name, CASE WHEN n_nationkey < 9 THEN n_regionkey + 10 ELSE n_regionkey END AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _text_update_row(spark, sf_dir):
    return _text(spark, sf_dir, "UPDATE nation SET (name, region) = (SELECT max(r_name), max(r_regionkey) + 10 FROM raw.region WHERE r_regionkey = region) WHERE id < 9").table("nation")


@made("text_index_and_tables", "SELECT * FROM (VALUES ('main', 'nation', 'nation__id__pk,nation__name__ix,by_region'), ('raw', 'nation', ''), ('raw', 'region', '')) AS t(schema, name, objects)")
def _text_index(spark, sf_dir):
    db = _text(spark, sf_dir, "CREATE INDEX ON nation (name)", "CREATE INDEX IF NOT EXISTS by_region ON nation USING hash (region, id)", "CREATE INDEX IF NOT EXISTS by_region ON nation (region)")
    info = db.get_info(data=False)
    return spark.createDataFrame([(s, t, ",".join([*v["constraints"], *v["indexes"]])) for s, ts in info.items() for t, v in ts.items() if s == "main" or t in db.store.tables(s)], "schema string, name string, objects string")


# any and all of a select: empty sets, and sets with nulls


def _quantified(name: str, test: Any, condition: str) -> None:
    query(f"quantified_{name}", {"data": ["n_nationkey", {"negated": {"coalesce": [{"not": test}, None]}}], "from": "nation"}, f"SELECT n_nationkey, NOT ({condition}) AS negated FROM nation")


_quantified("above_all_of_none", {">": ["n_nationkey", {"all": {"select": {"data": "r_regionkey", "from": "region", "where": {"<": ["r_regionkey", 0]}}}}]}, "n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 0)")
_quantified("above_any_of_none", {">": ["n_nationkey", {"any": {"select": {"data": "r_regionkey", "from": "region", "where": {"<": ["r_regionkey", 0]}}}}]}, "n_nationkey > ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 0)")
_quantified("not_below_all_with_null", {">=": ["n_nationkey", {"all": {"select": {"data": {"v": {"nullif": ["r_regionkey", 3]}}, "from": "region"}}}]}, "n_nationkey >= ALL (SELECT nullif(r_regionkey, 3) FROM region)")
_quantified("below_any_with_null", {"<": ["n_nationkey", {"any": {"select": {"data": {"v": {"nullif": ["r_regionkey", 4]}}, "from": "region"}}}]}, "n_nationkey < ANY (SELECT nullif(r_regionkey, 4) FROM region)")
_quantified("equal_to_all", {"=": ["n_regionkey", {"all": {"select": {"data": "r_regionkey", "from": "region", "where": {"=": ["r_regionkey", 2]}}}}]}, "n_regionkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 2)")
_quantified("equal_to_all_with_null", {"=": ["n_regionkey", {"all": {"select": {"data": {"v": {"nullif": ["r_regionkey", 3]}}, "from": "region", "where": {">": ["r_regionkey", 1]}}}}]}, "n_regionkey = ALL (SELECT nullif(r_regionkey, 3) FROM region WHERE r_regionkey > 1)")
_quantified("unlike_any", {"<>": ["n_regionkey", {"any": {"select": {"data": "r_regionkey", "from": "region", "where": {"=": ["r_regionkey", 2]}}}}]}, "n_regionkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey = 2)")
_quantified("null_value", {"<=": [{"nullif": ["n_regionkey", 1]}, {"all": {"select": {"data": "r_regionkey", "from": "region", "where": {">": ["r_regionkey", 1]}}}}]}, "nullif(n_regionkey, 1) <= ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 1)")

query(
    "json_rows_with_nulls",
    {"data": ["n_nationkey", {"j": {"json_build_object": ["'k'", {"named_struct": ["'x'", "n_nationkey", "'y'", {"nullif": ["n_regionkey", 1]}]}]}}, {"a": {"json_build_array": [{"named_struct": ["'y'", {"nullif": ["n_regionkey", 1]}]}]}}], "from": "nation"},
    "SELECT n_nationkey, '{\"k\": {\"x\":' || n_nationkey || ',\"y\":' || coalesce(nullif(n_regionkey, 1)::VARCHAR, 'null') || '}}' AS j, '[{\"y\":' || coalesce(nullif(n_regionkey, 1)::VARCHAR, 'null') || '}]' AS a FROM nation",
)


# indexes: a lookup opens the files that may hold its rows


def _indexed(spark, sf_dir, column: str, kind: str = "btree") -> Database:
    db = _loaded(spark, sf_dir, "orders", "o_orderkey")
    db.store.write("main", "orders", db.store.meta("main", "orders"), db.table("orders").repartition(12), check=False)
    db.create_index("orders", f"by_{column}", {"columns": [column], "type": kind})
    return db


@made("index_key_lookup", "SELECT * FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def _index_lookup(spark, sf_dir):
    db = _indexed(spark, sf_dir, "o_orderkey")
    return db.compile(db.get_model("orders").key(db.query_one_value("SELECT max(o_orderkey) FROM orders")).select())


@made("index_range_with_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 300000.5 ORDER BY o_totalprice, o_orderkey LIMIT 40")
def _index_range(spark, sf_dir):
    both = [{">=": ["o_totalprice", 200000]}, {">": [300000.5, "o_totalprice"]}]
    return _indexed(spark, sf_dir, "o_totalprice").compile({"select": {"data": ["o_orderkey", "o_totalprice"], "from": "orders", "where": {"and": both}, "order": ["o_totalprice", "o_orderkey"], "limit": 40}})


@made("index_hash_lookup", "SELECT o_orderkey FROM orders WHERE o_custkey = 77")
def _index_hash(spark, sf_dir):
    return _indexed(spark, sf_dir, "o_custkey", "hash").compile({"select": {"data": "o_orderkey", "from": "orders", "where": {"=": ["o_custkey", 77]}}})


# joins by bands, and exclusion by overlap: no equality, hot values

query(
    "range_join_between",
    {
        "data": ["p.p_brand", {"n": {"count": "*"}}, {"least": {"min": "o.o_totalprice"}}],
        "from": {"o": "orders"},
        "join": {"to": "part", "as": "p", "on": {"between": {"value": "o.o_totalprice", "min": {"*": ["p.p_retailprice", 100]}, "max": {"+": [{"*": ["p.p_retailprice", 100]}, "p.p_size"]}}}},
        "group": "p.p_brand",
    },
    "SELECT p_brand, count(*) AS n, min(o_totalprice) AS least FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + p_size GROUP BY p_brand",
)
query(
    "range_join_hot_left",
    {
        "data": ["l.l_quantity", {"n": {"count": "*"}}, {"found": {"count": "n.n_name"}}],
        "from": {"l": "lineitem"},
        "join": {"to": "nation", "as": "n", "type": "left", "on": {"and": [{">=": ["l.l_quantity", {"*": ["n.n_nationkey", 3]}]}, {"<": ["l.l_quantity", {"+": [{"*": ["n.n_nationkey", 3]}, {"%": ["n.n_nationkey", 7]}]}]}]}},
        "group": "l.l_quantity",
    },
    "SELECT l_quantity, count(*) AS n, count(n_name) AS found FROM lineitem LEFT JOIN nation ON l_quantity >= n_nationkey * 3 AND l_quantity < n_nationkey * 3 + n_nationkey % 7 GROUP BY l_quantity",
)
query(
    "overlap_join_full",
    {
        "data": ["s.s_suppkey", "p.p_partkey"],
        "from": {"s": "supplier"},
        "join": {"to": "part", "as": "p", "type": "full", "on": {"and": [{"<=": [{"-": ["s.s_acctbal", 5]}, {"+": ["p.p_retailprice", "p.p_size"]}]}, {">": [{"+": ["s.s_acctbal", "s.s_nationkey"]}, "p.p_retailprice"]}]}},
    },
    "SELECT s_suppkey, p_partkey FROM supplier FULL JOIN part ON s_acctbal - 5 <= p_retailprice + p_size AND s_acctbal + s_nationkey > p_retailprice",
)
query(
    "range_join_side_by_side",
    {
        "data": ["n.n_name", {"n": {"count": "*"}}],
        "from": {"e": "events", "n": "nation"},
        "where": {"and": [{"between": {"value": "e.value", "min": {"*": ["n.n_nationkey", 10]}, "max": {"+": [{"*": ["n.n_nationkey", 12]}, 1]}}}, {"<>": ["e.user_id", 3]}]},
        "group": "n.n_name",
    },
    "SELECT n_name, count(*) AS n FROM events, nation WHERE value BETWEEN n_nationkey * 10 AND n_nationkey * 12 + 1 AND user_id <> 3 GROUP BY n_name",
)


@made("range_update_from", "SELECT s_suppkey, coalesce((SELECT min(p_partkey) FROM part WHERE s_acctbal >= p_retailprice AND s_acctbal < p_retailprice + p_size), -1 - s_nationkey) AS mark FROM supplier")
def _range_update(spark, sf_dir):
    source = Database(spark, sf_dir)
    db = _loaded(spark, sf_dir, "supplier")
    band = {"and": [{">=": ["s.s_acctbal", "p.p_retailprice"]}, {"<": ["s.s_acctbal", {"+": ["p.p_retailprice", "p.p_size"]}]}]}
    db.execute({"update": {"table": {"s": "supplier"}, "set": {"s_nationkey": {"-": [-1, "s.s_nationkey"]}}}})
    db.execute({"update": {"table": {"s": "supplier"}, "set": {"s_nationkey": "p.p_partkey"}, "from": {"p": source.table("part")}, "where": band}})
    return db.table("supplier").selectExpr("s_suppkey", "cast(s_nationkey as bigint) AS mark")


@made("exclusion_by_overlap", """SELECT width, NOT EXISTS (SELECT 1 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) < width) AS accepted
    FROM (VALUES (CAST(0.001 AS DOUBLE)), (100), (10000)) AS t(width)""")
def _exclusion(spark, sf_dir):
    """Orders as spans of their price, put in as two halves: what of one customer overlaps is refused."""
    from ..sources.store import StoreError

    orders, out = spark.read.parquet(f"{sf_dir}/orders.parquet"), []
    for i, width in enumerate((0.001, 100.0, 10000.0)):
        db = Database(spark, workspace(spark))
        db.create_table("held", {"columns": {"cust": {"type": "bigint"}, "low": {"type": "double"}, "high": {"type": "double"}}, "constraints": {"apart": {"type": "exclude", "columns": ["cust", "low", "high"], "overlap": ["low", "high"]}}})
        spans = orders.select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("low"), (F.col("o_totalprice") + width).alias("high"))
        try:
            for half in (0, 1):
                db.execute({"insert": {"table": "held", "values": spans.filter(F.col("o_orderkey") % 2 == half).drop("o_orderkey")}})
            out.append((width, True))
        except StoreError:
            out.append((width, False))
    return spark.createDataFrame(out, "width double, accepted boolean")


# results kept by the state of their tables


@made("kept_rows_after_commits", """WITH now AS (SELECT o_orderpriority AS p, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderpriority, 'new' FROM orders WHERE o_orderkey % 3 = 0)
    SELECT 'before' AS seen, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'after', p, s, count(*) FROM now GROUP BY ALL""")
def _kept_rows(spark, sf_dir):
    """One statement before and after another writer's changes, each time asked twice: the second answer is the first one's files."""
    db = _loaded(spark, sf_dir, "orders", "o_orderkey")
    text = "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus"
    other, gone = Database(spark, db.url), Database(spark, sf_dir).table("orders").filter("o_orderkey % 3 = 0")
    db.kept(text)
    before = other.kept(text).withColumn("seen", F.lit("before"))
    other.execute(["DELETE FROM orders WHERE o_orderkey % 3 = 0", "UPDATE orders SET o_orderstatus = 'X' WHERE o_custkey % 5 = 0"])
    other.execute({"insert": {"table": "orders", "values": gone.withColumn("o_orderstatus", F.lit("new"))}})
    other.kept(text)
    return before.unionByName(db.kept(text).withColumn("seen", F.lit("after")))


@made("model_adds_sets_deletes", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT max(c_custkey) + 1, 'late', 'NONE' FROM customer")
def _model_changes(spark, sf_dir):
    db = _loaded(spark, sf_dir, "customer", "c_custkey")
    customers = db.get_model("customer")
    top = customers.sort("-c_custkey").limit(1).field("c_custkey").get()[0]
    customers.where(c_acctbal__lt=0).set(c_mktsegment="debtor")
    customers.where(c_nationkey=3).delete()
    customers.add({"c_custkey": top + 1, "c_name": "late", "c_nationkey": 0, "c_acctbal": 0.0, "c_mktsegment": "NONE"})
    return db.compile(customers.take("c_custkey", "c_name", "c_mktsegment").select())


@made("byte_stream_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders")
def _byte_streams(spark, sf_dir):
    """Rows to lines in files and back, nulls among them."""
    db, lines = Database(spark, workspace(spark)), f"{workspace(spark)}/lines"
    source = Database(spark, sf_dir)
    source.copy_from(lines, query="SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders")
    columns = {k: v for k, v in source.store.meta("main", "orders")["columns"].items() if k != "o_orderstatus"}
    db.create_table("orders", {"columns": columns})
    db.copy_to("orders", lines)
    return db.table("orders")


@made("workflow_split_update", "SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS o_custkey FROM orders")
def _workflow_split(spark, sf_dir):
    """An update in ranges of a time column: each row that it is for is touched once."""
    from .workflow import Workflow

    db = _loaded(spark, sf_dir, "orders")
    lo, hi = db.query_one_row("SELECT min(o_orderdate), max(o_orderdate) FROM orders")
    step = {"type": "query", "source": "here", "query": "UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'", "split": {"on": "o_orderdate", "size": int((hi - lo).total_seconds()) // 3 + 1}}
    Workflow(spark, {"databases": {"here": db.url}, "workflows": {"bump": [step]}}, "bump").run()
    return db.table("orders").select("o_orderkey", "o_custkey")


@made("schema_parts_made_and_dropped", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier UNION ALL SELECT max(s_suppkey) + 1, NULL, 7 FROM supplier")
def _schema_parts(spark, sf_dir):
    """Columns and constraints come, change and go; what they demand holds for the row put in last."""
    db = _loaded(spark, sf_dir, "supplier", "s_suppkey")
    db.create_column("supplier", "seen", {"type": "integer", "null": True})
    db.create_constraint("supplier", "named", {"type": "unique", "columns": ["s_name"]})
    db.alter_column("supplier", "s_nationkey", {"type": "bigint", "default": 7})
    db.alter_column("supplier", "s_name", {"null": True})
    db.drop_constraint("supplier", "named")
    db.drop_column("supplier", "seen")
    db.drop_column("supplier", "s_acctbal")
    db.execute("INSERT INTO supplier (s_suppkey) SELECT max(s_suppkey) + 1 FROM supplier")
    return db.table("supplier")


@made("copy_of_included_names", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'land', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def _included(spark, sf_dir):
    """A scope of wildcards, an exclusion and a new name says which tables a copy brings over."""
    target = Database(spark, workspace(spark))
    scope = {"schemas": {"main": {"tables": {"c*r": True, "ord*": True, "conv*": False, "land": {"source": "nation", "target": "land"}}}}}
    Database(spark, sf_dir).copy(target, scope, final_diff=False)
    counts = [target.table(t).select(F.lit(t).alias("name")).groupBy("name").agg(F.count("*").alias("n")) for t in target.store.tables("main")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@made("rows_of_two_databases", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_name")
def _two_databases(spark, sf_dir):
    other = _loaded(spark, sf_dir, "nation", "n_nationkey")
    few = {"c": Database(spark, sf_dir).table("customer")}
    return other.compile({"select": {"data": ["n.n_name", {"n": {"count": "*"}}], "from": few, "join": {"to": "nation", "as": "n", "on": {"=": ["c.c_nationkey", "n.n_nationkey"]}}, "where": {"=": ["n.n_regionkey", 1]}, "group": "n.n_name"}})


@made("rows_numbered_by_sequence", "SELECT count(*) AS n, count(*) AS distinct_ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, count(DISTINCT event_type) AS kinds FROM events")
def _sequence(spark, sf_dir):
    """Rows without a key get one from the column's sequence: numbers from 1 on, none twice, none left out."""
    db = Database(spark, workspace(spark))
    db.create_table("event", {"columns": {"id": {"type": "bigint", "primary": True, "sequence": True}, "kind": {"type": "text"}}})
    db.execute({"insert": {"table": "event", "columns": "kind", "values": Database(spark, sf_dir).table("events").select("event_type")}})
    return db.table("event").agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("kind").alias("kinds"))


@made("array_stream_round_trip", "SELECT doc_id, len(string_split(text, ' ')) AS n_words, md5(text) AS digest FROM documents")
def _array_streams(spark, sf_dir):
    """Whole texts as arrays of words, written as lines and read back."""
    db, lines = Database(spark, workspace(spark)), f"{workspace(spark)}/lines"
    Database(spark, sf_dir).copy_from(lines, query="SELECT doc_id, split(text, ' ') AS words FROM documents")
    db.create_table("said", {"columns": {"doc_id": {"type": "bigint"}, "words": {"type": "text[]"}}})
    db.copy_to("said", lines)
    return db.compile("SELECT doc_id, cast(size(words) AS bigint) AS n_words, md5(array_join(words, ' ')) AS digest FROM said")
