"""A corpus pipeline: quality rules, exact duplicates, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; further columns of docs, whatever their names, go.

Null and empty texts have no words, so the quality rules reject them; a null doc_id is a document like others (never
trusted, smaller than all ids). Rows that repeat an id are each judged by their own text; of rows that repeat id and text
one stays after the exact stage. Texts of any length are judged whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import common, exact, mixing, ngram_join, packing, quality
from lakeloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, key: list[Column], dropped: DataFrame, staying: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``key`` (_k, _t: id and text) is in ``dropped``; of rows that share a key in ``staying`` one stays.

    ``staying`` has a row for each row of a group that stays.
    """
    narrow = ["_k", "_t"]
    rows = docs.select(*COLUMNS, *key)
    rest = common.lacking(rows, common.durable(dropped.select(narrow).distinct()), narrow)
    again = common.durable(staying.groupBy(narrow).count().filter("count > 1").select(narrow))
    common.sweep(docs.sparkSession)
    if not again.limit(1).count():
        return rest.select(*COLUMNS)
    one = common.matching(rest, again, narrow).groupBy(narrow).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return common.lacking(rest, again, narrow).select(*COLUMNS).union(one.select(*COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; trusted are those labelled so in ``labels``."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return quality.quality_rules(docs, trusted, carry=rest).filter("kept").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays."""
    found = common.settled(spark, lambda: exact.exact_dedup(docs, keep="largest", row_keys=True).select("_k", "_t", "text_sha256", "kept"))
    # kept rows of one id whose texts differ in capitals only: one of the texts stays
    twice = found.filter("kept").groupBy("_k", "text_sha256").agg(F.min("_t").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twice = common.small(common.durable(twice.drop("n")))
    of = found.join(twice, ["_k", "text_sha256"], "left").withColumn("stays", F.col("kept") & F.coalesce(F.col("_t") == F.col("first"), F.lit(True)))
    return _without(docs, common.row_key(), of.filter("not stays"), of.filter("stays"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) one row with the smallest doc_id stays."""
    found = common.settled(spark, lambda: ngram_join.jaccard_components(docs, row_keys=True).filter("label is not null"))
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_k", "_t")).alias("best"), F.count("*").alias("n"))
    best = common.small(common.durable(best.filter("n > 1").select("label", "best")))
    of = found.join(best, "label").withColumn("stays", (F.col("best._k") == F.col("_k")) & (F.col("best._t") == F.col("_t")))
    return _without(docs, common.row_key(), of.filter("not stays"), of.filter("stays"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A budget of nine tenths of the words, dealt so that large sources give more of the rest."""
    rest = tuple(c for c in COLUMNS if c not in ("doc_id", "lang", "source"))
    return mixing.mix_sources(docs, share=0.9, carry=rest).filter("kept").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The quality model, the seeded order and the packing can't be written in SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        before, docs = docs, common.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        common.discard(before)
