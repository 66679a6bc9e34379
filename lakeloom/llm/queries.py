"""The subpackage's queries, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact, minhash, mixing, ngram_join, packing, pii, quality, secrets, substring, toxicity, warc, whitening


def vocabulary() -> str:
    """The tokenizer file; LAKELOOM_VOCABULARY names another."""
    if path := os.environ.get("LAKELOOM_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents")).drop("removed_spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common

    archives = common.durable(warc.write_warc(_table(spark, sf_dir, "pages")))
    return warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, share=0.9, weights=mixing.TARGETS, most_epochs=3, domain=mixing.length_class(F.col("text")))


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _trusted(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_pii, op3_exact_dedup, op4_warc, op5_mixing, op6_quality, op7_ngram_join, op8_toxicity,
        op9_packing, op10_secrets, op11_embedding_whitening, op12_conversation_repair, op13_minhash_dedup,
    )
}

#: The other operators' methods can't be written in SQL; tests/llm hold them against brute force.
ORACLE_SQL = {"op1_substring_dedup": substring.SQL, "op3_exact_dedup": exact.SQL, "op4_warc": warc.SQL, "op12_conversation_repair": conversations.SQL}
