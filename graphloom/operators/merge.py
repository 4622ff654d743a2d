"""Batch and sub-graph merges (ST1, ST2, ST3, ST4, GA20, GA23, GA24)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions.columns import blank, lookup
from graphloom.functions.paths import collapsed
from graphloom.operators import dedup, endpoints, linking
from graphloom.operators.ranking import row_numbers
from graphloom.session import checkpointed
from graphloom import dims


@dataclass
class MergedGraph:
    nodes: DataFrame
    edges: DataFrame
    fixes: DataFrame


def normalise_nodes(raw: DataFrame) -> DataFrame:
    """Canonical id and complexity plus the fix columns (CL1)."""
    new_id = ids.canonical_id(F.col("id"), F.col("type"), F.col("name"), F.col("file_path"))
    return (
        raw.filter(~blank(F.col("id")))
        .withColumn("old_id", F.col("id"))
        .withColumn("id", new_id)
        .withColumn("id_fix", ids.id_fix_pattern(F.col("old_id"), F.col("id")))
        .withColumn("complexity_status", ids.complexity_status(F.col("complexity")))
        .withColumn("raw_complexity", F.col("complexity"))
        .withColumn("complexity", ids.complexity(F.col("complexity")))
    )


def id_mapping(normalised: DataFrame) -> DataFrame:
    """``(old_id, new_id)`` for the ids that changed; the last row wins."""
    return (
        normalised.filter("old_id <> id")
        .groupBy("old_id")
        .agg(F.max_by("id", "seq").alias("new_id"))
    )


def fix_report(normalised: DataFrame) -> DataFrame:
    """Counts per correction pattern (GA20)."""
    raw = F.coalesce(F.concat(F.lit('"'), "raw_complexity", F.lit('"')), F.lit("None"))
    complexity_fix = F.when(
        F.col("complexity_status") == "mapped",
        F.concat(F.lit("complexity "), raw, F.lit(' -> "'), "complexity", F.lit('"')),
    ).when(
        F.col("complexity_status") == "unknown",
        F.concat(F.lit("complexity "), raw, F.lit(' -> defaulted to "moderate"')),
    )
    unknown_type = F.when(
        ~blank(F.col("type")) & ~F.col("type").isin([*dims.NODE_TYPES, "func"]),
        F.concat(F.lit('unknown node type "'), "type", F.lit('"')),
    )
    section = F.when(F.col("complexity_status") == "mapped", "fixed").otherwise("could-not-fix")
    patterns = F.array(
        F.struct(F.lit("fixed").alias("section"), F.col("id_fix").alias("pattern")),
        F.struct(section.alias("section"), complexity_fix.alias("pattern")),
        F.struct(F.lit("could-not-fix").alias("section"), unknown_type.alias("pattern")),
    )
    return (
        normalised.select(F.explode(patterns).alias("p"))
        .select("p.*")
        .filter("pattern IS NOT NULL")
        .groupBy("section", "pattern")
        .agg(F.count("*").alias("n"))
    )


def prepared_batches(raw_nodes: DataFrame, raw_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised nodes and re-pointed edges, each stored once: the dedups,
    the linker and the report all read them, and the raw scans are the cost."""
    normalised = checkpointed(normalise_nodes(raw_nodes))
    edges = checkpointed(endpoints.rewrite_endpoints(raw_edges, id_mapping(normalised)))
    return normalised, edges


def merge_batches(raw_nodes: DataFrame, raw_edges: DataFrame, link: bool = True) -> MergedGraph:
    """Union of partial graphs -> one consistent graph (ST1)."""
    normalised, edges = prepared_batches(raw_nodes, raw_edges)
    nodes = dedup.dedup_nodes(normalised.select(*raw_nodes.columns))
    if link:
        nodes, edges, _ = linking.link_tests(nodes, edges)
    edges = (
        endpoints.keep_connected(edges, nodes)
        .withColumn("direction", ids.direction(F.col("direction")))
        .withColumn("weight", F.col("weight").try_cast("double"))
    )
    return MergedGraph(nodes, dedup.dedup_edges(edges, dedup.EDGE_KEY4), fix_report(normalised))


def merge_subgraphs(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Later graph wins on nodes, heavier edge wins (ST2)."""

    def stacked(frames: list[DataFrame]) -> DataFrame:
        out = None
        for rank, f in enumerate(frames):
            f = f.withColumn("_rank", F.lit(rank))
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    all_nodes, all_edges = stacked(nodes), stacked(edges)
    merged = dedup.pick_one(all_nodes, ["id"], [F.col("_rank"), F.col("seq")]).drop("_rank")
    weight = F.coalesce(F.col("weight"), F.lit(0.0)).alias("w")
    rest = [c for c in all_edges.columns if c not in (*dedup.EDGE_KEY3, "_rank", "seq")]
    # rank and number are part of the order, so a row carries them once
    best = F.max(F.struct(weight, (-F.col("_rank")).alias("r"), (-F.col("seq")).alias("s"), *rest)).alias("_row")
    kept = (
        all_edges.groupBy(*dedup.EDGE_KEY3).agg(best)
        .select(*dedup.EDGE_KEY3, *[F.col("_row")[c].alias(c) for c in rest], (-F.col("_row.s")).alias("seq"))
        .select(*[c for c in all_edges.columns if c != "_rank"])
    )
    return merged, endpoints.drop_dangling(kept, all_edges, merged)


def merge_knowledge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Knowledge merge (ST3): alias types, drop unknown nodes, unknown edges
    become ``related``, entities of one normalised name collapse."""
    node_type = F.coalesce(lookup(dims.NODE_TYPE_ALIASES, F.lower("type")), F.lower("type"))
    typed = dedup.dedup_nodes(nodes.withColumn("type", node_type).filter(F.col("type").isin(dims.NODE_TYPES)))
    entities = typed.filter("type = 'entity'").withColumn("_norm", collapsed(F.col("name")))
    leader = entities.groupBy("_norm").agg(F.min_by("id", "seq").alias("new_id"))
    remap = (
        entities.join(leader, "_norm").filter("id <> new_id").select(F.col("id").alias("old_id"), "new_id")
    )
    kept = typed.join(remap.select(F.col("old_id").alias("id")), "id", "left_anti").select(*nodes.columns)
    edge_type = F.coalesce(lookup(dims.EDGE_TYPE_ALIASES, F.lower("type")), F.lower("type"))
    moved = endpoints.rewrite_endpoints(
        edges.withColumn("type", F.when(edge_type.isin(dims.EDGE_TYPES), edge_type).otherwise("related")), remap
    )
    return kept, dedup.dedup_edges(endpoints.keep_connected(moved, kept), dedup.EDGE_KEY3, keep="first")


def patch_graph(
    nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame, new_nodes: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace the rows of changed files (ST4); ``changed_paths(path)``."""
    gone = nodes.join(changed_paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    gone_ids = checkpointed(gone.select("id").distinct())
    kept_nodes = nodes.join(gone_ids, "id", "left_anti").select(*nodes.columns)
    return kept_nodes.unionByName(new_nodes), endpoints.without(edges, gone_ids).unionByName(new_edges)


def merge_layer_members(members: DataFrame) -> DataFrame:
    """Set union of the member lists of equal layer ids (GA23)."""
    return members.groupBy("layer_id", "node_id").agg(
        F.min("member_pos").alias("member_pos"), F.min_by("layer_name", "layer_pos").alias("layer_name")
    )


def merge_tours(steps: DataFrame) -> DataFrame:
    """Tour steps merged by title and renumbered (GA23).

    ``steps(title, description, node_id, seq)`` -> one row per step and member;
    the longer description wins, members keep their first position.
    """
    header = steps.groupBy("title").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
        F.min("seq").alias("first_seq"),
    )
    numbered = row_numbers(header, [], ["first_seq"], "step_order").drop("first_seq")
    members = steps.groupBy("title", "node_id").agg(F.min("seq").alias("pos"))
    return members.join(numbered, "title").select("step_order", "title", "description", "node_id", "pos")


def merge_projects(projects: DataFrame) -> DataFrame:
    """One project row (GA24). Project rows are one per sub-graph, and the
    language and framework names are reduced to distinct values first."""

    def ordered(values: str) -> DataFrame:
        first = (
            projects.select("seq", F.posexplode(values).alias("pos", "v"))
            .groupBy("v")
            .agg(F.min(F.struct("seq", "pos")).alias("at"))
        )
        rows = F.array_sort(F.collect_list(F.struct("at", "v")))
        return first.agg(F.transform(rows, lambda r: r["v"]).alias(values))

    texts = projects.filter(~blank(F.col("description"))).groupBy("description").agg(F.min("seq").alias("seq"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda r: r["description"])
    description = texts.agg(F.array_join(joined, " | ").alias("description"))
    latest = projects.agg(
        F.max_by("git_commit_hash", F.struct(F.col("analyzed_at"), -F.col("seq"))).alias("git_commit_hash"),
        F.max("analyzed_at").alias("analyzed_at"),
        F.max_by("name", F.when(~blank(F.col("name")), F.col("seq"))).alias("name"),
    )
    out = latest.withColumn("_one", F.lit(1))
    for part in (ordered("languages"), ordered("frameworks"), description):
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")
