"""One named query per operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetframe.llm import (
    byte_bpe,
    embedding_dedup,
    fingerprints,
    hard_negatives,
    kneser_ney,
    nearest,
    ngram_join,
    packing,
    pii,
    quality,
    runs,
    secrets,
    toxicity,
)
from fleetframe.llm.common import table
from fleetframe.llm.oracles import EMBEDDING_DEDUP, HARD_NEGATIVES, NEAREST, NGRAM_JOIN

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.found(docs, pii.train(docs))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_bpe.encoded(table(spark, folder, "documents"), keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.found(docs, secrets.train(docs))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.grouped(table(spark, folder, "embeddings"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_next(table(spark, folder, "documents"))


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.train_and_score(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, folder, "labels")))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.joined(table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digested(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def all_queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_secrets": op4_secrets,
        "op5_packing": op5_packing,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_fingerprints": op7_fingerprints,
        "op8_lm_scores": op8_lm_scores,
        "op9_quality": op9_quality,
        "op10_ngram_join": op10_ngram_join,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_nearest": op13_nearest,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op6_embedding_dedup": EMBEDDING_DEDUP,
        "op10_ngram_join": NGRAM_JOIN,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_nearest": NEAREST,
    }
