"""Readers by URL: a folder of Parquet files, a Spark catalog, an SQLite file, or a server through JDBC."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv")


def kind_of(url: str) -> str:
    """``jdbc`` for server URLs, ``catalog`` for catalog:name, ``sqlite`` for sqlite:path, else ``files``."""
    scheme = urlsplit(url).scheme.lower()
    if scheme == "sqlite":
        return "sqlite"
    if scheme in ("postgres", "postgresql", "mysql", "jdbc"):
        return "jdbc"
    return "catalog" if scheme == "catalog" else "files"


def sqlite_path(url: str) -> str:
    rest = url.split(":", 1)[1]
    return rest[2:] if rest.startswith("//") else rest


def jdbc_url(url: str) -> str:
    if url.startswith("jdbc:"):
        return url
    u = urlsplit(url)
    name = {"postgres": "postgresql"}.get(u.scheme, u.scheme)
    host = f"{u.hostname}:{u.port}" if u.port else u.hostname
    return f"jdbc:{name}://{host}{u.path}"


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple | None = None, parts: int = 8) -> DataFrame:
    """A server's table, read in ``parts`` ranges of ``column`` if bounds are given. Needs the server's driver on the class path."""
    u = urlsplit(url)
    reader = spark.read.format("jdbc").option("url", jdbc_url(url)).option("dbtable", table)
    if u.username:
        reader = reader.option("user", u.username).option("password", u.password or "")
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_file(spark: SparkSession, path: str) -> DataFrame:
    fmt = next((f for f in FORMATS if path.rstrip("/").endswith(f".{f}")), "parquet")
    return spark.read.option("header", True).format(fmt).load(path) if fmt == "csv" else spark.read.format(fmt).load(path)
