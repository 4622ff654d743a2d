"""Ranks and top-k that hold no group in one task (WN5, WN7-WN9, TK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpointed


def row_numbers(df: DataFrame, group: list[str], order: list[str], out: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Exact 1-based row numbers per group, for groups of any size.

    Rows are range-partitioned by (group, order), so a large group spreads over
    many partitions; each partition numbers its own rows and adds the number of
    rows of the group in the partitions before it. ``order`` must be unique
    within a group. The checkpoint pins the partition of each row.

    Columns named in ``carry`` have their nulls filled with the last earlier
    value of the group, in the same two steps.
    """
    ordered = df.repartitionByRange(*[F.col(c) for c in [*group, *order]])
    parts = checkpointed(ordered.withColumn("_part", F.spark_partition_id()))
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_last_{c}") for c in carry
    ]
    sums = parts.groupBy(*group, "_part").agg(F.count("*").alias("_size"), *latest)
    # one row per group and partition: bounded by the number of partitions
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in carry],
    )
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    filled = {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_last_{c}")
        )
        for c in carry
    }
    numbered = (
        parts.withColumn("_rank", F.row_number().over(local))
        .join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_rank").cast("long") + F.col("_offset"))
    )
    if filled:
        numbered = numbered.withColumns(filled)
    return numbered.select(*df.columns, out)


def top_k(df: DataFrame, group: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group. The rank filter is applied before the
    shuffle too, so a task receives at most k rows per group and map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
