"""Join-shaped graph and path operators (JN3-JN19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions.columns import last_segment
from graphloom.operators.dedup import pick_one
from graphloom.operators.ranking import top_k
from graphloom.operators.views import induced_edges
from graphloom.session import checkpointed


def valid_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Member rows whose node exists (JN3)."""
    ids = nodes.select(F.col("id").alias("node_id"))
    return members.join(ids, "node_id", "left_semi").select(*members.columns)


def dropped_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("node_id"))
    return members.join(ids, "node_id", "left_anti").select(*members.columns)


def first_layer(members: DataFrame) -> DataFrame:
    """First declared layer of each node (JN4)."""
    return members.groupBy("node_id").agg(F.min_by("layer_id", F.struct("layer_pos", "layer_id")).alias("layer_id"))


def all_layers(members: DataFrame) -> DataFrame:
    """Every (node, layer) pair once (JN4)."""
    return members.select("node_id", "layer_id").distinct()


def expand_one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds and their neighbours in either direction, ``seeds(id)`` (JN5). The
    stored seeds have a real size, so a few hits are sent to the edges and no edge moves."""
    seeds = checkpointed(seeds.select("id").distinct())
    out = edges.join(seeds.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    back = edges.join(seeds.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    return seeds.select("id").union(out).union(back).distinct()


def touched_layers(members: DataFrame, ids: DataFrame) -> DataFrame:
    return (
        members.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("layer_id").distinct()
    )


def query_context(nodes: DataFrame, edges: DataFrame, members: DataFrame, seeds: DataFrame):
    """(nodes, edges, layers) around a set of search hits (JN5)."""
    ids = expand_one_hop(edges, seeds)
    shown = nodes.join(ids, "id", "left_semi").select(*nodes.columns)
    return shown, induced_edges(edges, ids), touched_layers(members, ids)


class ChangeImpact:
    """Effect of changed files on the graph (JN6, GA26)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, members: DataFrame, changed_files: DataFrame):
        files = changed_files.select(F.col("path").alias("file_path")).distinct()
        direct = nodes.join(files, "file_path", "left_semi").select("id")
        kids = (
            edges.filter("type = 'contains'")
            .join(direct.withColumnRenamed("id", "source"), "source", "left_semi")
            .select(F.col("target").alias("id"))
        )
        self.changed_ids = direct.union(kids).distinct()
        self.changed = nodes.join(self.changed_ids, "id", "left_semi").select(*nodes.columns)
        src = self.changed_ids.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
        tgt = self.changed_ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
        marked = edges.join(src, "source", "left").join(tgt, "target", "left")
        self.impacted_edges = marked.filter("_s OR _t").select(*edges.columns)
        other = F.when(F.col("_s") & F.col("_t").isNull(), F.col("target")).when(
            F.col("_t") & F.col("_s").isNull(), F.col("source")
        )
        self.affected_ids = marked.select(other.alias("id")).filter("id IS NOT NULL").distinct()
        self.affected = nodes.join(self.affected_ids, "id", "left_semi").select(*nodes.columns)
        self.layers = touched_layers(members, self.changed_ids.union(self.affected_ids))
        self.unmapped = files.join(nodes.select("file_path").distinct(), "file_path", "left_anti").select(
            F.col("file_path").alias("path")
        )

    def risk(self) -> DataFrame:
        """One row of counts and flags (GA26)."""

        def counted(df: DataFrame, name: str) -> DataFrame:
            return df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))

        out = counted(self.changed.filter("complexity = 'complex'"), "complex_changed")
        for df, name in (
            (self.layers, "layers"), (self.affected, "affected"), (self.unmapped, "unmapped"),
        ):
            out = out.join(counted(df, name), "_k")
        low = (
            (F.col("complex_changed") == 0) & (F.col("layers") <= 1) & (F.col("affected") <= 5)
            & (F.col("unmapped") == 0)
        )
        return out.drop("_k").withColumns(
            {"cross_layer": F.col("layers") > 1, "wide": F.col("affected") > 5, "low_risk": low}
        )


def explain_target(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Node per looked-up ``target``: ``path:name`` first, then ``path`` (JN7)."""
    cut = targets.select(
        "target",
        F.when(~F.col("target").contains("://"), F.regexp_extract("target", r"^(.+):([^:]*)$", 1)).alias("path"),
        F.regexp_extract("target", r"^(.+):([^:]*)$", 2).alias("name"),
    )
    named = nodes.select(F.col("file_path").alias("path"), "name", "id", "seq")
    exact = cut.join(named, ["path", "name"]).select("target", "id", F.lit(0).alias("rank"), "seq")
    plain = cut.join(named.select(F.col("path").alias("target"), "id", "seq"), "target").select(
        "target", "id", F.lit(1).alias("rank"), "seq"
    )
    return pick_one(exact.unionByName(plain), ["target"], [F.col("rank"), F.col("seq")], keep="min").select(
        "target", "id"
    )


def connections(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Edges of a node split into contained children and others (JN8)."""
    out_edge = F.col("source") == node_id
    other = F.when(out_edge, F.col("target")).otherwise(F.col("source"))
    rows = edges.filter(out_edge | (F.col("target") == node_id)).select(
        other.alias("id"), "type", "seq", F.when(out_edge, "out").otherwise("in").alias("way"),
        (out_edge & (F.col("type") == "contains")).alias("is_child"),
    )
    return rows.join(nodes.select("id", "name"), "id")


def suffix_matches(names: DataFrame, files: DataFrame) -> DataFrame:
    """Dotted names -> every file whose path ends with them (JN10):
    ``names(name)``, ``files(path)``."""
    index = files.select("path", F.explode(paths.suffixes(F.regexp_replace("path", r"\.[^./]*$", ""))).alias("suffix"))
    wanted = names.select("name", F.translate("name", ".", "/").alias("suffix"))
    return wanted.join(index, "suffix").select("name", "path")


def nearest_ancestor(files: DataFrame, config_dirs: DataFrame) -> DataFrame:
    """Closest directory above each file that holds a config (JN11)."""
    ladders = files.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "dir"))
    return (
        ladders.join(config_dirs.select("dir").distinct(), "dir")
        .groupBy("path")
        .agg(F.max_by("dir", "depth").alias("dir"))
    )


def resolve_links(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Link text -> article: full path, else unambiguous base name, else path
    suffix (JN12). ``links(link_id, source, link)``, ``articles(path)``. Adds
    ``target`` and ``status`` (resolved, self, missing)."""
    keyed = articles.select("path", F.lower("path").alias("key"))
    exact = keyed.select("key", F.col("path").alias("target"), F.lit(0).alias("rank"))
    base = keyed.select(last_segment(F.col("key")).alias("key"), "path")
    unique = (
        base.groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("target"))
        .filter("n = 1").select("key", "target", F.lit(1).alias("rank"))
    )
    suffix = (
        keyed.select(F.explode(paths.suffixes(F.col("key"))).alias("key"), "path")
        .groupBy("key").agg(F.min("path").alias("target")).select("key", "target", F.lit(2).alias("rank"))
    )
    names = pick_one(exact.union(unique).union(suffix), ["key"], [F.col("rank"), F.col("target")], keep="min")
    asked = links.withColumn("key", F.lower("link"))
    found = asked.join(names.select("key", "target"), "key", "left")
    status = (
        F.when(F.col("target").isNull(), "missing").when(F.col("target") == F.col("source"), "self")
        .otherwise("resolved")
    )
    return found.withColumn("status", status).drop("key")


def cross_batch_neighbours(imports: DataFrame, batches: DataFrame, cap: int = 50) -> DataFrame:
    """Import neighbours living in other batches; a file with more than ``cap``
    neighbours keeps those of highest degree, then path (JN15). The cut is what
    the report means by neighbours, not a shortcut."""
    pairs = imports.select("src_path", "tgt_path").filter("src_path <> tgt_path")
    both = pairs.toDF("path", "nbr_path").union(pairs.select(F.col("tgt_path"), F.col("src_path"))).distinct()
    ends = pairs.toDF("path", "nbr_path").union(pairs.select("tgt_path", "src_path"))  # a mutual import counts twice
    degree = ends.groupBy("path").agg(F.count("*").alias("degree"))
    home = batches.select("path", "batch_index")
    away = batches.select(F.col("path").alias("nbr_path"), F.col("batch_index").alias("nbr_batch"))
    rows = (
        both.join(home, "path").join(away, "nbr_path").filter("batch_index <> nbr_batch")
        .join(degree.withColumnRenamed("path", "nbr_path"), "nbr_path")
    )
    return top_k(rows, ["path"], [F.col("degree").desc(), F.col("nbr_path")], cap).select(
        "path", "nbr_path", "nbr_batch", F.col("degree").alias("nbr_degree")
    )


def similar_sessions(sessions: DataFrame, session_id: str) -> DataFrame:
    """Other sessions sharing a tag with the given one (JN16)."""
    wanted = (
        sessions.filter(F.col("id") == session_id).select(F.explode("tags").alias("tag")).distinct()
    )
    tagged = sessions.filter(F.col("id") != session_id).select("id", F.explode("tags").alias("tag"))
    return tagged.join(wanted, "tag").select("id").distinct()


def cross_layer_files(nodes: DataFrame, edges: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """File nodes of layer ``a`` with an edge into layer ``b`` (JN17)."""

    def ids(layer: str, name: str) -> DataFrame:
        return members.filter(F.col("layer_id") == layer).select(F.col("node_id").alias(name))

    crossing = edges.join(ids(a, "source"), "source", "left_semi").join(ids(b, "target"), "target", "left_semi")
    return nodes.filter("type = 'file'").join(
        crossing.select(F.col("source").alias("id")).distinct(), "id", "left_semi"
    ).select("id")


def route_keywords(
    insights: DataFrame, keywords: DataFrame, min_weight: float = 0.0, k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Skills ranked by summed weights of matched keywords (JN18):
    ``insights(skill, keyword, weight)``, ``keywords(keyword)``, matched as
    given; insights below ``min_weight`` count for nothing. Returns the
    ranking and its matched keywords."""
    hits = insights.filter(F.col("weight") >= min_weight).join(keywords.select("keyword").distinct(), "keyword")
    ranked = (
        hits.groupBy("skill").agg(F.sum("weight").alias("score"))
        .orderBy(F.col("score").desc(), "skill").limit(k)
    )
    return ranked, hits.join(ranked, "skill", "left_semi").select("skill", "keyword").distinct()


def batches_with_changes(batches: DataFrame, changed: DataFrame) -> DataFrame:
    """Whole batches holding a changed file (JN19)."""
    hot = batches.join(changed.select("path").distinct(), "path", "left_semi").select("batch_index").distinct()
    return batches.join(hot, "batch_index", "left_semi").select(*batches.columns)
