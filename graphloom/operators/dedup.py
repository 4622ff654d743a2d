"""Deduplication policies (WN1-WN4, MM1).

All are grouped max_by/min_by aggregates: they combine map-side, so a key that
owns a third of the rows still reaches its reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import numeric_weight
from graphloom.session import checkpointed

EDGE_KEY3 = ("source", "target", "type")
EDGE_KEY4 = ("source", "target", "type", "direction")
# Hashes of repeated keys that are sent to every task.
SENT_HASHES = 1 << 20


def pick_one(df: DataFrame, key: list[str], order: list, keep: str = "max") -> DataFrame:
    """One row per key: the one with the largest (or smallest) ``order``."""
    rest = [c for c in df.columns if c not in key]
    choose = F.max_by if keep == "max" else F.min_by
    row = choose(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(row).select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def dedup_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Last row per id wins (WN1)."""
    return pick_one(nodes, ["id"], [F.col(seq)])


def pick_one_stored(df: DataFrame, key: list[str], order: list, keep: str = "max") -> DataFrame:
    """:func:`pick_one` for a stored table of text keys that mostly stand once.

    Only the hashes of the keys move at first: a row whose hash no other row has
    stays where it is, and the others are compared by their whole keys. With more
    repeated hashes than a task may hold, all rows move.
    """
    digest = F.xxhash64(*key)
    repeated = checkpointed(
        df.groupBy(digest.alias("_h")).agg(F.count("*").alias("n")).filter("n > 1").select("_h"))
    if repeated.count() > SENT_HASHES:
        return pick_one(df, key, order, keep)
    hashed, sent = df.withColumn("_h", digest), F.broadcast(repeated)
    alone = hashed.join(sent, "_h", "left_anti").select(*df.columns)
    return alone.union(pick_one(hashed.join(sent, "_h", "left_semi").select(*df.columns), key, order, keep))


def dedup_edges(
    edges: DataFrame, key: tuple[str, ...] = EDGE_KEY4, keep: str = "heaviest", seq: str = "seq", stored: bool = False
) -> DataFrame:
    """``heaviest`` (ties: earliest; WN2, WN3) or ``first`` (WN4) row per key;
    ``stored`` edges are read more than once."""
    pick = pick_one_stored if stored else pick_one
    if keep == "first":
        return pick(edges, list(key), [F.col(seq)], keep="min")
    if keep != "heaviest":
        raise ValueError(f"unknown policy {keep!r}")
    weight = numeric_weight(F.col("weight").cast("string")) if dict(edges.dtypes)["weight"] == "string" else F.coalesce(
        F.col("weight"), F.lit(0.0)
    )
    return pick(edges, list(key), [weight.alias("w"), (-F.col(seq)).alias("s")])
