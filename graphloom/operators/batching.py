"""Chunking and numbering of ordered groups (WN7-WN9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import row_numbers


def chunk_groups(df: DataFrame, group: list[str], order: list[str], size: int, out: str = "chunk") -> DataFrame:
    """Consecutive chunks of ``size`` rows per group (WN7)."""
    ranked = row_numbers(df, group, order, "_rn")
    return ranked.withColumn(out, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def even_split(df: DataFrame, group: str, order: list[str], limit: int, out: str = "part") -> DataFrame:
    """Split groups above ``limit`` into equal parts (WN8)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = row_numbers(df, [group], order, "_rn").join(sizes, group)
    per_part = F.ceil(F.col("_n") / F.ceil(F.col("_n") / limit))
    part = F.when(F.col("_n") > limit, F.floor((F.col("_rn") - 1) / per_part)).otherwise(F.lit(0))
    return ranked.withColumn(out, part).drop("_rn", "_n")


def renumber(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense numbers from 1 in key order (WN9): only the distinct keys are ranked."""
    keys = row_numbers(df.select(key).distinct(), [], [key], out)
    return df.join(keys, key)
