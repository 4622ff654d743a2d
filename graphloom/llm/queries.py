"""Registered queries of the training-data operators: thin digests of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (
    byte_bpe, decontaminate, importance, licenses, line_dedup, mixing, near_dedup, ngram_lm, quality, token_counts, toxicity,
    vector_file, whitening,
)
from graphloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


@query("op2_license_scan", licenses.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    copy = lambda c: F.concat_ws(":", c["shard"], c["position"], c["words"])
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn(
        "copies", F.array_join(F.transform("copies", copy), ","))


@query("op5_line_dedup", line_dedup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(
        "doc_id", "n_lines", F.col("n_dropped").cast("long"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op6_exact_search", vector_file.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_file.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = rows.select("id", vector_file.integers("v").alias("v"))
    return vector_file.exact_top_k(vectors, vectors.filter("id % 100 = 0"))


@query("op7_lm_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op11_importance", importance.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_decontaminate", decontaminate.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(
        decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation AS long)"))
