"""Aggregations over graphs, layers, folders and file tables (GA, TK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions.columns import last_segment
from graphloom.operators.joins import first_layer
from graphloom.operators.views import node_category


def file_stats(files: DataFrame) -> DataFrame:
    """Counts by category, by language and in total, in one pass (GA1)."""
    sets = files.groupingSets([["file_category"], ["language"], []], "file_category", "language")
    return sets.agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("size_lines").alias("lines"),
    ).select(
        F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "language").otherwise("total").alias("dimension"),
        F.coalesce("file_category", "language", F.lit("all")).alias("value"), "n", "lines",
    )


def graph_overview(nodes: DataFrame) -> DataFrame:
    """Node counts by type, complexity and category (GA2)."""
    facets = F.array(
        F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")),
        F.struct(F.lit("complexity").alias("facet"), F.col("complexity").alias("value")),
        F.struct(F.lit("category").alias("facet"), node_category(F.col("type")).alias("value")),
    )
    return nodes.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes")).withColumn("_k", F.lit(1))
    e = edges.agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1))
    degree = F.coalesce(F.round(F.try_divide(F.lit(2.0) * F.col("edges"), F.col("nodes")), 1), F.lit(0.0))
    return n.join(e, "_k").select("nodes", "edges", degree.alias("avg_degree"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree over all edges; fan-in and fan-out over distinct neighbours (GA3).

    A hub's edges reach it pre-counted; fan counts dedupe by (node, neighbour),
    which spreads a hub over the cluster.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    pairs = edges.filter("source <> target").select("source", "target").distinct()
    fan_in = pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    fan_out = pairs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    out = nodes.select("id").join(ends, "id", "left").join(fan_in, "id", "left").join(fan_out, "id", "left")
    return out.na.fill(0, ["degree", "fan_in", "fan_out"])


def top_by(df: DataFrame, measure: str, k: int, tie: str = "id") -> DataFrame:
    """Top-k report with a stable tie order (TK1, TK3)."""
    return df.orderBy(F.col(measure).desc(), tie).limit(k)


def layer_stats(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolved members and complexity label per layer (GA4)."""
    known = nodes.select(F.col("id").alias("node_id"), F.col("complexity"))
    total = F.count("complexity")
    share = lambda level: F.count_if(F.col("complexity") == level) / total
    return (
        members.select("layer_id", "node_id")
        .join(known, "node_id", "left")
        .groupBy("layer_id")
        .agg(
            total.alias("n"),
            F.when(total == 0, "simple").when(share("complex") > 0.3, "complex")
            .when(share("moderate") > 0.3, "moderate").otherwise("simple").alias("label"),
        )
    )


def container_edges(edges: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges inside containers, and counts between them (GA5): ``homes(id,
    container)`` with unique ids; ends without a container are ignored."""
    src = homes.select(F.col("id").alias("source"), F.col("container").alias("source_container"))
    tgt = homes.select(F.col("id").alias("target"), F.col("container").alias("target_container"))
    placed = edges.join(src, "source").join(tgt, "target")
    inside = placed.filter("source_container = target_container").select(*edges.columns)
    between = (
        placed.filter("source_container <> target_container")
        .groupBy("source_container", "target_container")
        .agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    )
    return inside, between


def layer_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edge counts between first layers (GA6)."""
    homes = first_layer(members).select(F.col("node_id").alias("id"), F.col("layer_id").alias("container"))
    return container_edges(edges, homes)[1]


def portals(edges: DataFrame, members: DataFrame, layer: str) -> DataFrame:
    """Other layers connected to ``layer``, in either direction (GA7)."""
    between = layer_edges(edges, members)
    other = F.when(F.col("source_container") == layer, F.col("target_container")).otherwise(F.col("source_container"))
    return (
        between.filter((F.col("source_container") == layer) | (F.col("target_container") == layer))
        .groupBy(other.alias("layer_id")).agg(F.sum("n").alias("connections"))
    )


def hits_per_layer(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Search hits ``hits(id)`` per first layer (GA8)."""
    homes = first_layer(members).withColumnRenamed("node_id", "id")
    return hits.join(homes, "id").groupBy("layer_id").agg(F.count("*").alias("hits"))


def with_folder_group(df: DataFrame, path: str = "file_path", out: str = "folder") -> DataFrame:
    """First directory after the directory prefix all rows share (GA9).

    The common prefix of a set of strings is that of its minimum and maximum,
    so one aggregate finds it. Rows without a directory left get ``~``.
    """
    dirs = df.filter(F.col(path).isNotNull()).select(paths.dirname(F.col(path)).alias("d"))
    ends = dirs.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    same = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length("lo"), F.lit(1))),
        lambda i: (F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i))
        & (i <= F.length("hi")) & (i <= F.length("lo")),
    )
    common = F.expr("substring(lo, 1, n)")
    prefix = ends.withColumn("n", F.coalesce(F.array_max(same), F.lit(0))).select(
        F.length(F.regexp_replace(common, r"[^/]*$", "")).alias("_cut")
    )
    cut = F.expr(f"substring({path}, _cut + 1)")
    group = F.when(F.col(path).isNull() | ~cut.contains("/"), "~").otherwise(F.split_part(cut, F.lit("/"), F.lit(1)))
    return df.join(F.broadcast(prefix)).withColumn(out, group).drop("_cut")


def group_imports(imports: DataFrame, homes: DataFrame) -> DataFrame:
    """Import counts between groups (GA10 matrix): ``homes(path, folder)``."""
    src = homes.select(F.col("path").alias("src_path"), F.col("folder").alias("src_group"))
    tgt = homes.select(F.col("path").alias("tgt_path"), F.col("folder").alias("tgt_group"))
    return (
        imports.join(src, "src_path").join(tgt, "tgt_path")
        .groupBy("src_group", "tgt_group").agg(F.count("*").alias("n"))
    )


def group_density(matrix: DataFrame) -> DataFrame:
    """Internal and total import edges per group (GA10)."""
    inner = F.col("src_group") == F.col("tgt_group")
    sides = matrix.select(
        F.explode(F.array_distinct(F.array("src_group", "tgt_group"))).alias("folder"), "n",
        F.when(inner, F.col("n")).otherwise(0).alias("inside"),
    )
    return sides.groupBy("folder").agg(
        F.sum("inside").alias("internal"), F.sum("n").alias("total"),
        (F.sum("inside") / F.sum("n")).alias("density"),
    )


def dominant_directions(matrix: DataFrame) -> DataFrame:
    """For each pair of groups, who depends on whom (GA10)."""
    lo, hi = F.least("src_group", "tgt_group"), F.greatest("src_group", "tgt_group")
    pairs = (
        matrix.filter("src_group <> tgt_group")
        .groupBy(lo.alias("a"), hi.alias("b"))
        .agg(
            F.sum(F.when(F.col("src_group") == lo, F.col("n")).otherwise(0)).alias("ab"),
            F.sum(F.when(F.col("src_group") == hi, F.col("n")).otherwise(0)).alias("ba"),
        )
    )
    return pairs.filter("ab <> ba").select(
        F.when(F.col("ab") > F.col("ba"), F.col("a")).otherwise(F.col("b")).alias("dependent"),
        F.when(F.col("ab") > F.col("ba"), F.col("b")).otherwise(F.col("a")).alias("dependency"),
        F.greatest("ab", "ba").alias("n"),
    )


def category_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge counts by (source type, target type, edge type) (GA11)."""
    src = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    tgt = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    return (
        edges.join(src, "source").join(tgt, "target")
        .groupBy("source_type", "target_type", F.col("type").alias("edge_type")).agg(F.count("*").alias("n"))
    )


def doc_coverage(files: DataFrame) -> DataFrame:
    """Whether each folder group has documentation (GA12): ``files(path, folder)``."""
    is_doc = paths.category(F.col("path")) == "docs"
    return files.groupBy("folder").agg(F.bool_or(is_doc).alias("documented"))


def coverage_ratio(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count_if("documented").alias("with_docs"), F.count("*").alias("groups"),
        F.round(F.try_divide(F.count_if("documented"), F.count("*")), 2).alias("ratio"),
    )


# File patterns of the deployment and data-pipeline inventories.
INVENTORY = {
    "dockerfile": r"(^|/)Dockerfile(\.[^/]*)?$",
    "compose": r"(^|/)(docker-)?compose[^/]*\.ya?ml$",
    "k8s": r"(^|/)(k8s|kubernetes|helm|charts)/",
    "terraform": r"\.(tf|tfvars)$",
    "ci": r"(^|/)\.github/workflows/|(^|/)\.gitlab-ci\.yml$|(^|/)Jenkinsfile$",
    "schema": r"\.(sql|graphql|gql|proto|prisma)$",
    "migration": r"(^|/)migrations?/",
    "data_model": r"(^|/)(models?|entities|entity)/",
    "api_handler": r"(^|/)(routes?|api|controllers?|handlers?|endpoints?)/",
}


def inventory(files: DataFrame) -> DataFrame:
    """(kind, path) of deployment and data-pipeline files (GA13)."""
    kinds = F.array(*[F.when(F.col("path").rlike(rx), F.lit(kind)) for kind, rx in INVENTORY.items()])
    return files.select("path", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def inventory_flags(files: DataFrame) -> DataFrame:
    return files.agg(*[F.bool_or(F.col("path").rlike(rx)).alias(f"has_{kind}") for kind, rx in INVENTORY.items()])


def temporal_counts(nodes: DataFrame, edges: DataFrame, at) -> DataFrame:
    """Rows created strictly before and after a time (GA18)."""
    t = F.lit(at)

    def counted(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(
            F.count_if(F.col("created_at") < t).alias("before"), F.count_if(F.col("created_at") > t).alias("after")
        ).withColumn("kind", F.lit(kind))

    return counted(nodes, "nodes").unionByName(counted(edges, "edges"))


def domain_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Flows per domain and steps per flow; zero counts kept (GA19)."""

    def counted(kind: str, edge_type: str) -> DataFrame:
        counts = edges.filter(F.col("type") == edge_type).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
        return (
            nodes.filter(F.col("type") == kind).select("id", "type").join(counts, "id", "left").na.fill(0, ["n"])
        )

    return counted("domain", "contains_flow").unionByName(counted("flow", "flow_step"))


def folder_tree(nodes: DataFrame) -> DataFrame:
    """Every ancestor folder with its file count (GA21)."""
    files = file_entries(nodes)
    return (
        files.select(F.explode(paths.ancestors(F.col("path"))).alias("folder"))
        .filter("folder <> ''").groupBy("folder").agg(F.count("*").alias("files"))
    )


def file_entries(nodes: DataFrame) -> DataFrame:
    """One node per safe path, file nodes preferred (GA21)."""
    placed = nodes.select(paths.safe_relative(F.col("file_path")).alias("path"), "id", "type", "seq").filter(
        "path IS NOT NULL"
    )
    preference = F.struct(F.when(F.col("type") == "file", 0).otherwise(1).alias("p"), F.col("seq"))
    return placed.groupBy("path").agg(F.min_by("id", preference).alias("id"))


def file_metrics(definitions: DataFrame, files: DataFrame) -> DataFrame:
    """Definition counts per file (GA22): ``definitions(path, kind, ...)``."""
    kinds = ["function", "class", "import", "export", "section", "definition"]
    counts = definitions.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    out = files.select("path", "size_lines").join(counts, "path", "left")
    return out.na.fill(0, [f"n_{k}" for k in kinds])


#: File names that usually start a program.
ENTRY_NAMES = [
    "index.ts", "index.js", "main.ts", "main.js", "app.ts", "app.js", "server.ts", "server.js", "mod.rs", "main.go",
    "main.py", "main.rs", "manage.py", "app.py", "wsgi.py", "asgi.py", "run.py", "__main__.py", "Application.java",
    "Main.java", "Program.cs", "config.ru", "index.php", "App.swift", "Application.kt", "main.cpp", "main.c",
]


def entry_candidates(files: DataFrame, fan: DataFrame) -> DataFrame:
    """Additive entry-point score per file (TK2): ``fan(path, fan_in,
    fan_out)``. The cuts are exact ranks taken from the histogram of degree
    values, never from a sort of all files in one task."""
    base = last_segment(F.col("path"))
    depth = F.size(F.split("path", "/")) - 1
    rows = files.select("path").join(fan, "path", "left").na.fill(0, ["fan_in", "fan_out"])
    top = percent_ranks(rows, "fan_out").withColumnRenamed("percent_rank", "_out_rank")
    low = percent_ranks(rows, "fan_in").withColumnRenamed("percent_rank", "_in_rank")
    is_doc = paths.extension(base).isin(".md")
    code = (
        F.when(base.isin(ENTRY_NAMES), 3).otherwise(0)
        + F.when(depth <= 1, 1).otherwise(0)
        + F.when(F.col("_out_rank") >= 0.9, 1).otherwise(0)
        + F.when(F.col("_in_rank") <= 0.25, 1).otherwise(0)
    )
    doc = F.when(F.col("path") == "README.md", 5).when(depth == 0, 2).otherwise(0)
    return rows.join(top, "fan_out").join(low, "fan_in").select(
        "path", F.when(is_doc, doc).otherwise(code).alias("score")
    )


def percent_ranks(df: DataFrame, measure: str) -> DataFrame:
    """(value, percent_rank) over a measure with few distinct values: the window
    runs over the histogram, not over the rows."""
    histogram = df.groupBy(measure).agg(F.count("*").alias("_n"))
    below = Window.orderBy(measure).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    return histogram.select(
        measure,
        F.coalesce(
            F.try_divide(F.coalesce(F.sum("_n").over(below), F.lit(0)), F.sum("_n").over(total) - 1), F.lit(0.0)
        ).alias("percent_rank"),
    )


# Words that mark business logic in a path.
PRIORITY_WORDS = [
    "controller", "service", "handler", "router", "route", "api",
    "model", "entity", "repository", "usecase", "use_case",
    "command", "query", "event", "subscriber", "listener",
    "middleware", "guard", "interceptor", "resolver",
    "workflow", "flow", "process", "pipeline", "job", "task",
]


def priority_files(files: DataFrame, words: list[str] | None = None, k: int = 40) -> DataFrame:
    """The k paths with most keyword hits (TK4)."""
    path = F.lower("path")
    score = sum((path.contains(w).cast("int") for w in words or PRIORITY_WORDS), F.lit(0))
    return files.select("path", score.alias("score")).orderBy(F.col("score").desc(), "path").limit(k)


def onboarding(nodes: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Datasets of the onboarding guide (GA27)."""
    return {
        "layers": members.groupBy("layer_id").agg(F.count("*").alias("members")),
        "concepts": nodes.filter("type = 'concept'").select("id", "name", "summary"),
        "file_map": nodes.filter("type = 'file' AND file_path IS NOT NULL").select("file_path", "summary", "complexity"),
        "hotspots": nodes.filter("complexity = 'complex'").select("id", "name", "summary"),
    }


def health(counts: DataFrame) -> DataFrame:
    """Weighted mastery of a memory system (GA17): one row with the columns
    rules, insights, facts, skills, sessions, lessons."""
    c = F.col

    def capped(x: Column) -> Column:
        return F.least(F.lit(1.0), x)

    parts = {
        "rules_health": F.when(c("rules") == 0, 0.0).otherwise(1.0),
        "insights_health": F.when(c("skills") == 0, 0.0).otherwise(
            capped(F.try_divide(c("insights"), c("skills") * 3))
        ),
        "facts_health": capped(c("facts") / 10),
        "skills_health": capped(c("skills") / 5),
        "sessions_health": capped(c("sessions") / 5),
        "lessons_health": F.when(
            c("sessions") == 0, F.when(c("lessons") > 0, 1.0).otherwise(0.0)
        ).otherwise(capped(F.try_divide(c("lessons"), c("sessions")))),
    }
    weights = dict(zip(parts, [0.20, 0.10, 0.25, 0.25, 0.10, 0.10]))
    out = counts.withColumns(parts)
    return out.withColumn("mastery", sum((c(p) * w for p, w in weights.items()), F.lit(0.0)))


def health_advice(counts: DataFrame) -> DataFrame:
    """One row per applicable recommendation code (GA17)."""
    c = F.col
    advice = {
        "define-rules": c("rules") == 0,
        "add-insights": (c("skills") > 0) & (c("insights") < c("skills")),
        "capture-facts": c("facts") < 5,
        "crystallize-skills": c("skills") < 3,
        "archive-sessions": c("sessions") < 3,
        "distill-lessons": (c("lessons") == 0) & (c("sessions") >= 3),
        "enable-audit": c("audit_entries") == 0,
    }
    codes = F.array(*[F.when(cond, F.lit(code)) for code, cond in advice.items()])
    return counts.select(F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("advice"))


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
        out = one if out is None else out.join(one, "_k")
    return out.drop("_k")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issue counts per level in severity order (GA29)."""
    rank = F.when(F.col("level") == "fatal", 0).when(F.col("level") == "dropped", 1).otherwise(2)
    return issues.groupBy("level", "category").agg(F.count("*").alias("n")).withColumn("rank", rank).orderBy(
        "rank", "category"
    )
