"""Filtered views of a graph and of memory tables (FP1-FP13)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions import globs
from graphloom.functions.columns import lookup
from graphloom.operators import endpoints

SUB_FILE_TYPES = ["function", "class"]


def edge_category(edge_type: Column) -> Column:
    return lookup(dims.inverted(dims.EDGE_CATEGORIES), edge_type)


def node_category(node_type: Column) -> Column:
    return F.coalesce(lookup(dims.inverted(dims.NODE_CATEGORIES), node_type), F.lit("code"))


def filter_nodes(
    nodes: DataFrame, layer_members: DataFrame, types: list[str], complexities: list[str], layers: list[str]
) -> DataFrame:
    """Type, complexity and any-layer filter; no layers means no layer filter (FP1)."""
    out = nodes.filter(
        F.col("type").isin(types) & (F.col("complexity").isNull() | F.col("complexity").isin(complexities))
    )
    if layers:
        inside = layer_members.filter(F.col("layer_id").isin(layers)).select(F.col("node_id").alias("id"))
        out = out.join(inside, "id", "left_semi")
    return out.select(*nodes.columns)


def induced_edges(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``node_ids(id)``."""
    return (
        edges.join(node_ids.select(F.col("id").alias("source")), "source", "left_semi")
        .join(node_ids.select(F.col("id").alias("target")), "target", "left_semi")
        .select(*edges.columns)
    )


def filter_edges(edges: DataFrame, visible: DataFrame, categories: list[str]) -> DataFrame:
    """Visible ends and an allowed, or unknown, category (FP2)."""
    category = edge_category(F.col("type"))
    return induced_edges(edges.filter(category.isNull() | category.isin(categories)), visible)


def layer_detail(
    nodes: DataFrame, edges: DataFrame, layer_members: DataFrame, layer: str,
    child_types: Iterable[str] = ("class", "function"), categories: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Members of a layer, their contained children, induced edges (FP3)."""
    members = layer_members.filter(F.col("layer_id") == layer).select(F.col("node_id").alias("id")).distinct()
    kids = (
        edges.filter("type = 'contains'")
        .join(members.withColumnRenamed("id", "source"), "source", "left_semi")
        .select(F.col("target").alias("id"))
        .join(nodes.filter(F.col("type").isin(list(child_types))).select("id"), "id", "left_semi")
    )
    hidden = ["article", "entity", "topic", "claim", "source"]
    shown = nodes.join(members.union(kids).distinct(), "id", "left_semi").filter(~F.col("type").isin(hidden))
    if categories is not None:
        shown = shown.filter(node_category(F.col("type")).isin(list(categories)))
    shown = shown.select(*nodes.columns)
    return shown, induced_edges(edges, shown.select("id"))


def list_memory(
    memory: DataFrame, scope: str | None = None, tags: list[str] | None = None,
    lifecycles: list[str] | None = None, min_confidence: float = 0.0, combine: bool = False,
) -> DataFrame:
    """Scope, else all tags; then lifecycle and confidence (FP4). ``combine``
    applies scope and tags together."""
    out = memory
    if scope:
        out = out.filter(F.col("scope") == scope)
    if tags and (combine or not scope):
        out = out.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0)
    if lifecycles:
        out = out.filter(F.col("lifecycle").isin(lifecycles))
    return out.filter(F.col("confidence") >= min_confidence)


def audit_for_entity(audit: DataFrame, id_: str) -> DataFrame:
    return audit.filter(F.col("id") == id_)


def audit_for_op(audit: DataFrame, op: str) -> DataFrame:
    return audit.filter(F.col("op") == op)


def audit_recent(audit: DataFrame, n: int) -> DataFrame:
    return audit.orderBy(F.col("seq").desc()).limit(n)


def sessions_by_tag(sessions: DataFrame, tag: str) -> DataFrame:
    return sessions.filter(F.array_contains("tags", tag))


def sessions_by_outcome(sessions: DataFrame, outcome: str) -> DataFrame:
    return sessions.filter(F.col("outcome") == outcome)


def skills_by_trigger(skills: DataFrame, text: str) -> DataFrame:
    return skills.filter(F.exists("triggers", lambda t: F.lower(t).contains(text.lower())))


def in_time_range(rows: DataFrame, start, end) -> DataFrame:
    """Rows created in [start, end], both ends included (FP7)."""
    return rows.filter(F.col("created_at").between(F.lit(start), F.lit(end)))


def rule_violations(rows: DataFrame, rules: list[tuple[str, str, Column]], key: str = "id") -> DataFrame:
    """One row per failed rule: ``rules`` holds (rule id, severity, predicate) (FP8, UD4)."""
    checks = F.array(
        *[
            F.when(
                ~F.coalesce(ok, F.lit(False)),
                F.struct(F.lit(i).alias("rule_pos"), F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity")),
            )
            for i, (rid, sev, ok) in enumerate(rules)
        ]
    )
    failed = F.filter(checks, lambda c: c.isNotNull())
    return rows.select(key, F.explode(failed).alias("v")).select(key, "v.*")


def first_blocker(violations: DataFrame, key: str = "id") -> DataFrame:
    return violations.filter("severity = 'block'").groupBy(key).agg(F.min_by("rule_id", "rule_pos").alias("rule_id"))


def focus(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """A node, its neighbours and the edges among them (FP9)."""
    touching = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    ids = touching.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    shown = nodes.filter(F.col("id") == node_id).unionByName(
        nodes.filter(F.col("id") != node_id).join(ids, "id", "left_semi").select(*nodes.columns)
    )
    return shown, induced_edges(edges, shown.select("id"))


def domain_steps(nodes: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """Flows of a domain and their steps, ordered by edge weight (FP10)."""
    flows = edges.filter((F.col("type") == "contains_flow") & (F.col("source") == domain)).select(
        F.col("target").alias("flow_id")
    )
    steps = edges.filter("type = 'flow_step'").select(
        F.col("source").alias("flow_id"), F.col("target").alias("step_id"), F.col("weight").alias("step_order")
    )
    names = nodes.select(F.col("id").alias("step_id"), F.col("name").alias("step_name"))
    return steps.join(flows.distinct(), "flow_id", "left_semi").join(names, "step_id").select(
        "flow_id", "step_id", "step_name", "step_order"
    )


def ignore_filter(files: DataFrame, rules: list[tuple[str, bool, bool]]) -> DataFrame:
    """Last matching rule wins (FP11). ``rules`` holds (regex, negated, is_user)
    in order; adds ``ignored`` and ``ignored_by_default`` columns."""

    def verdict(chosen: list[tuple[str, bool, bool]]) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for regex, negated, _ in reversed(chosen):
            out = out.when(F.col("path").rlike(regex), F.lit(not negated))
        return out.otherwise(False)

    return files.withColumn("ignored", verdict(rules)).withColumn(
        "ignored_by_default", verdict([r for r in rules if not r[2]])
    )


def ignore_globs(files: DataFrame, rules: list[str], defaults: list[str] = dims.DEFAULT_IGNORES) -> DataFrame:
    """Ignore files by globs as they stand in ignore files (FP11): the defaults,
    then ``rules`` (lines of all the user's files, in order), last match wins.
    Adds ``ignored`` and ``ignored_by_default``; a null path is not ignored."""
    first = globs.parsed(defaults)
    path = F.coalesce("path", F.lit(""))
    return files.withColumn("ignored", globs.ignored(path, first + globs.parsed(rules))).withColumn(
        "ignored_by_default", globs.ignored(path, first))


def export_view(
    nodes: DataFrame, edges: DataFrame, layer_members: DataFrame, types: list[str], complexities: list[str],
    layers: list[str], categories: list[str], technical: bool,
) -> tuple[DataFrame, DataFrame]:
    """Filtered graph for export (FP12); non-technical readers get no sub-file rows.

    An export without layers mostly keeps its edges, so only the ends that it hides
    are looked up, and edges whose ends are of other kinds stay where they are."""
    kept = nodes if technical else nodes.filter(~F.col("type").isin(SUB_FILE_TYPES))
    shown = filter_nodes(kept, layer_members, types, complexities, layers)
    if layers:
        return shown, filter_edges(edges, shown.select("id"), categories)
    category = edge_category(F.col("type"))
    allowed = edges.filter(category.isNull() | category.isin(categories))
    return shown, endpoints.without(endpoints.with_ends(allowed), endpoints.missing_ends(allowed, shown))


def features_by_tag(features: DataFrame, tag: str) -> DataFrame:
    return features.filter(F.array_contains("tags", tag))


def search_features(features: DataFrame, text: str) -> DataFrame:
    needle = text.lower()
    return features.filter(
        F.lower("title").contains(needle)
        | F.lower("description").contains(needle)
        | F.exists("tags", lambda t: F.lower(t).contains(needle))
    )
