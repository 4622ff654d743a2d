"""A corpus pipeline: documents in, token ids of a clean, mixed corpus out.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, line_dedup, mixing, near_dedup, quality
from graphloom.llm.common import prepared, table, whole
from graphloom.session import checkpointed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of a changed text."""
    return docs.withColumn("n_chars", F.length(whole("text")).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands let pass."""
    prepared(spark)
    return docs.select(*COLUMNS, quality.verdict().alias("verdict")).filter("verdict.kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, freed of the lines that many of them share."""
    prepared(spark)
    return _documents(line_dedup.line_dedup(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8; documents
    without an id are not compared and stay."""
    prepared(spark)
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").unionByName(
        docs.select(*COLUMNS).filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, shard by shard in shuffled order."""
    prepared(spark)
    mixed = mixing.mixed(docs.select(*COLUMNS))
    part = F.shiftright("mix_position", 60)  # a shard may fill several partitions
    ordered = mixed.repartition("mix_shard", part).sortWithinPartitions("mix_shard", "mix_position")
    return _documents(ordered)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text as little-endian 32-bit integers, their digest and
    that of the bytes they decode to."""
    prepared(spark)
    return byte_bpe.round_trip(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, tokens=True)


STAGES = [
    ("quality_rules", quality_rules), ("drop_lines", drop_lines), ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources), ("encode", encode),
]

#: SQL cannot express compression or merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
