"""Edge endpoint joins: rewriting, dangling checks, import recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpointed


def rewrite_endpoints(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace endpoints through ``id_map(old_id, new_id)``; absent ids stay (JN1).

    ``old_id`` is unique, so neither join grows the edge table.
    """
    src = id_map.select(F.col("old_id").alias("source"), F.col("new_id").alias("_src"))
    tgt = id_map.select(F.col("old_id").alias("target"), F.col("new_id").alias("_tgt"))
    return (
        edges.join(src, "source", "left")
        .join(tgt, "target", "left")
        .withColumn("source", F.coalesce("_src", "source"))
        .withColumn("target", F.coalesce("_tgt", "target"))
        .select(*edges.columns)
    )


def keep_connected(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges whose two ends exist in ``node_ids(id)`` (JN2)."""
    ids = node_ids.select("id").distinct()
    return (
        edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select(*edges.columns)
    )


def drop_dangling(edges: DataFrame, source: DataFrame, node_ids: DataFrame) -> DataFrame:
    """:func:`keep_connected` for edges that mostly are: ``source`` holds all ends
    of ``edges``, and only the distinct ends that no node has are joined with them."""
    missing = missing_ends(source, node_ids)
    kept = with_ends(edges)
    for end in ("source", "target"):
        kept = kept.join(missing.withColumnRenamed("id", end), end, "left_anti")
    return kept.select(*edges.columns)


def missing_ends(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """The distinct ends of edges that ``node_ids(id)`` lacks, stored."""
    ends = edges.select("source").union(edges.select("target")).toDF("id").distinct()
    return checkpointed(ends.join(node_ids.select("id"), "id", "left_anti"))


def with_ends(edges: DataFrame) -> DataFrame:
    return edges.filter("source IS NOT NULL AND target IS NOT NULL")


# More kinds than this are not looked at one by one.
_KINDS = 64


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end in the stored ``gone(id)``. Ends whose kind (the id up to
    its first colon) no gone id has need no join, so their rows stay where they are."""

    def kind(end: str) -> Column:
        return F.substring_index(end, ":", 1)

    kinds = [r[0] for r in gone.filter("id IS NOT NULL").select(kind("id")).distinct().limit(_KINDS + 1).collect()]
    rows = [edges]
    for end in ("source", "target"):
        ids = gone.withColumnRenamed("id", end)
        if len(kinds) > _KINDS:
            rows = [r.join(ids, end, "left_anti") for r in rows]
        else:
            near = F.coalesce(kind(end).isin(kinds), F.lit(False))
            rows = [part for r in rows for part in (r.filter(near).join(ids, end, "left_anti"), r.filter(~near))]
    out = rows[0].select(*edges.columns)
    for part in rows[1:]:
        out = out.union(part.select(*edges.columns))
    return out


def dangling_edges(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges with a missing end, with ``reason`` (JN2)."""
    ids = node_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    src = ids.select(F.col("id").alias("source"), F.col("_hit").alias("_s"))
    tgt = ids.select(F.col("id").alias("target"), F.col("_hit").alias("_t"))
    no_src, no_tgt = F.col("_s").isNull(), F.col("_t").isNull()
    reason = (
        F.when(no_src & no_tgt, "missing-both").when(no_src, "missing-source").when(no_tgt, "missing-target")
    )
    return (
        edges.join(src, "source", "left")
        .join(tgt, "target", "left")
        .withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .select(*edges.columns, "reason")
    )


def recover_imports(nodes: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Import edges known to the scan but missing from the graph (JN14)."""
    files = nodes.filter("type = 'file'").select("id").distinct()
    wanted = (
        imports.select(
            F.concat(F.lit("file:"), "src_path").alias("source"), F.concat(F.lit("file:"), "tgt_path").alias("target")
        )
        .filter("source <> target")
        .distinct()
    )
    existing = edges.filter("type = 'imports'").select("source", "target").distinct()
    return keep_connected(wanted, files).join(existing, ["source", "target"], "left_anti").select(
        "source", "target", F.lit("imports").alias("type"), F.lit("forward").alias("direction"),
        F.lit(0.7).alias("weight"), F.lit(True).alias("recovered"),
    )
