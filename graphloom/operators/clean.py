"""Validation and review of raw graphs (CL2-CL7, EP1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions.columns import blank, lookup
from graphloom.functions.paths import kebab


def sanitise_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"type": F.lower("type"), "complexity": F.lower("complexity")})


def sanitise_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"type": F.lower("type"), "direction": F.lower("direction")})


def alias_types(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return df.withColumn("type", F.coalesce(lookup(aliases, F.col("type")), F.col("type")))


def _issue(cond: Column, field: str, category: str) -> Column:
    return F.when(
        cond, F.struct(F.lit("auto-corrected").alias("level"), F.lit(category).alias("category"), F.lit(field).alias("field"))
    )


def fix_nodes(nodes: DataFrame) -> DataFrame:
    """Defaults and aliases, with the corrections in ``issues`` (CL3)."""
    c = F.col
    alias = lookup(dims.COMPLEXITY_ALIASES, c("complexity"))
    issues = F.array(
        _issue(blank(c("type")), "type", "missing-field"),
        _issue(blank(c("complexity")), "complexity", "missing-field"),
        _issue(alias.isNotNull(), "complexity", "alias"),
        _issue(c("tags").isNull(), "tags", "missing-field"),
        _issue(blank(c("summary")), "summary", "missing-field"),
    )
    return nodes.withColumn("issues", F.filter(issues, lambda i: i.isNotNull())).withColumns(
        {
            "type": F.when(blank(c("type")), "file").otherwise(c("type")),
            "complexity": F.when(blank(c("complexity")), "moderate").otherwise(F.coalesce(alias, c("complexity"))),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "summary": F.when(blank(c("summary")), F.coalesce(F.nullif("name", F.lit("")), F.lit("No summary"))).otherwise(
                c("summary")
            ),
        }
    )


def fix_edges(edges: DataFrame) -> DataFrame:
    """Defaults, aliases, weight coercion and clamping (CL3); ``weight`` comes
    as text and leaves as a double. ``weight_is_text``, where the reader gives
    it, tells the weights that were text in the source; without it all were."""
    c = F.col
    as_text = c("weight_is_text") if "weight_is_text" in edges.columns else F.lit(True)
    alias = lookup(dims.DIRECTION_ALIASES, c("direction"))
    leading = F.regexp_extract("weight", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    number = F.when(c("weight").isNull(), 0.5).otherwise(F.coalesce(leading.try_cast("double"), F.lit(0.5)))
    issues = F.array(
        _issue(blank(c("type")), "type", "missing-field"),
        _issue(blank(c("direction")), "direction", "missing-field"),
        _issue(alias.isNotNull(), "direction", "alias"),
        _issue(c("weight").isNull(), "weight", "missing-field"),
        _issue(c("weight").isNotNull() & as_text, "weight", "type-coercion"),
        _issue((c("_number") < 0) | (c("_number") > 1), "weight", "out-of-range"),
    )
    return (
        edges.withColumn("_number", number)
        .withColumn("issues", F.filter(issues, lambda i: i.isNotNull()))
        .withColumns(
            {
                "type": F.when(blank(c("type")), "depends_on").otherwise(c("type")),
                "direction": F.when(blank(c("direction")), "forward").otherwise(F.coalesce(alias, c("direction"))),
                "weight": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_number")),
            }
        )
        .drop("_number")
    )


@dataclass
class Validated:
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame


def validate_graph(raw_nodes: DataFrame, raw_edges: DataFrame, project: DataFrame | None = None) -> Validated:
    """Four tiers: sanitise, fix, drop broken rows, fatal checks (CL5).

    Issues are ``(level, category, collection, seq, field)``; ``seq`` is the
    row's arrival order.
    """
    c = F.col
    nodes = fix_nodes(alias_types(sanitise_nodes(raw_nodes), dims.NODE_TYPE_ALIASES)).withColumn(
        "_ok",
        c("id").isNotNull() & c("name").isNotNull() & c("type").isin(dims.NODE_TYPES)
        & c("complexity").isin(dims.COMPLEXITIES),
    )
    edges = fix_edges(alias_types(sanitise_edges(raw_edges), dims.EDGE_TYPE_ALIASES)).withColumn(
        "_ok",
        c("source").isNotNull() & c("target").isNotNull() & c("type").isin(dims.EDGE_TYPES)
        & c("direction").isin(dims.DIRECTIONS),
    )
    ids = nodes.filter("_ok").select("id").distinct().withColumn("_hit", F.lit(True))
    placed = edges.join(ids.toDF("source", "_s"), "source", "left").join(ids.toDF("target", "_t"), "target", "left")
    fate = (
        F.when(~c("_ok"), F.struct(F.lit("invalid-edge").alias("category"), F.lit("").alias("field")))
        .when(c("_s").isNull(), F.struct(F.lit("invalid-reference").alias("category"), F.lit("source").alias("field")))
        .when(c("_t").isNull(), F.struct(F.lit("invalid-reference").alias("category"), F.lit("target").alias("field")))
    )
    placed = placed.withColumn("_fate", fate)
    good_nodes = nodes.filter("_ok").select(*raw_nodes.columns)
    # of the kept edges only whole ones meet the ids, and only those whose source is known their target
    good_edges = (
        edges.filter("_ok").select(*raw_edges.columns)
        .join(ids.select(c("id").alias("source")), "source", "left_semi")
        .join(ids.select(c("id").alias("target")), "target", "left_semi").select(*raw_edges.columns)
    )

    def fixes(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("collection"), "seq", F.inline("issues"))

    def drops(df: DataFrame, name: str, category: Column, field: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("collection"), "seq", F.lit("dropped").alias("level"), category.alias("category"),
            field.alias("field"),
        )

    fatal = F.lit("fatal")
    issues = (
        fixes(nodes, "nodes")
        .unionByName(fixes(edges, "edges"))
        .unionByName(drops(nodes.filter("NOT _ok"), "nodes", F.lit("invalid-node"), F.lit("")))
        .unionByName(
            drops(placed.filter("_fate IS NOT NULL"), "edges", c("_fate.category"), c("_fate.field"))
        )
        .unionByName(
            good_nodes.agg(F.count("*").alias("n")).filter("n = 0").select(
                F.lit("nodes").alias("collection"), F.lit(0).cast("long").alias("seq"), fatal.alias("level"),
                F.lit("no-valid-nodes").alias("category"), F.lit("").alias("field"),
            )
        )
    )
    if project is not None:
        issues = issues.unionByName(
            project.agg(F.count("*").alias("n")).filter("n <> 1").select(
                F.lit("project").alias("collection"), F.lit(0).cast("long").alias("seq"), fatal.alias("level"),
                F.lit("missing-project").alias("category"), F.lit("").alias("field"),
            )
        )
    return Validated(good_nodes, good_edges, issues)


@dataclass
class Checked:
    rows: DataFrame
    members: DataFrame
    issues: DataFrame


def validate_listed(raw: DataFrame, nodes: DataFrame, collection: str, required: list[str]) -> Checked:
    """Layers or tour steps with their lists of node ids (CL5, tier 3).

    ``raw(seq, node_ids, ...)`` must hold every ``required`` field and a list of
    ids without nulls; other rows are dropped with an issue. Ids that no valid
    node has leave the list without one. ``rows`` are the valid rows without
    their list, ``members(seq, pos, node_id)`` its remaining ids: ``pos`` is the
    place in the given list, and a long list is spread, never held in one row.
    """
    c = F.col
    whole = c("node_ids").isNotNull() & F.coalesce(F.forall("node_ids", lambda i: i.isNotNull()), F.lit(False))
    lacking = F.array_compact(F.array(
        *[F.when(c(f).isNull(), F.lit(f)) for f in required], F.when(~whole, F.lit("nodeIds"))))
    checked = raw.withColumn("_lack", lacking)
    good = checked.filter(F.size("_lack") == 0)
    listed = good.select("seq", F.posexplode("node_ids").alias("pos", "node_id"))
    known = nodes.select(c("id").alias("node_id")).distinct()
    issues = checked.filter(F.size("_lack") > 0).select(
        F.lit(collection).alias("collection"), "seq", F.lit("dropped").alias("level"),
        F.lit("invalid-layer" if collection == "layers" else "invalid-tour-step").alias("category"),
        F.get("_lack", F.lit(0)).alias("field"))
    return Checked(good.drop("_lack", "node_ids"), listed.join(known, "node_id", "left_semi").select("seq", "pos", "node_id"), issues)


def validate_layers(layers: DataFrame, nodes: DataFrame) -> Checked:
    return validate_listed(layers, nodes, "layers", ["id", "name", "description"])


def validate_tour(tour: DataFrame, nodes: DataFrame) -> Checked:
    return validate_listed(tour, nodes, "tour", ["step_order", "title", "description"])


def described(issues: DataFrame) -> DataFrame:
    """Issues with the ``path`` of what they are about and a ``message`` (CL5)."""
    c = F.col
    row = F.concat("collection", F.lit("["), c("seq").cast("string"), F.lit("]"))
    lost = F.when(c("category") == "invalid-reference", F.concat(row, F.lit(": "), "field", F.lit(" does not exist in nodes"))).when(
        c("field") != "", F.concat(row, F.lit(": "), "field", F.lit(" is missing or invalid"))).otherwise(
        F.concat(row, F.lit(": missing or invalid fields")))
    # a reference names its field in the path; a row that is dropped whole does not
    inside = (c("field") != "") & ((c("level") != "dropped") | (c("category") == "invalid-reference"))
    return issues.withColumns({
        "path": F.when(c("level") == "fatal", F.lit("")).when(inside, F.concat(row, F.lit("."), "field")).otherwise(row),
        "message": F.when(c("category") == "no-valid-nodes", F.lit("No valid nodes found in knowledge graph"))
        .when(c("level") == "fatal", F.lit("Missing or invalid project metadata"))
        .when(c("level") == "dropped", F.concat(lost, F.lit(" — removed")))
        .otherwise(F.concat(row, F.lit("."), "field", F.lit(": "), "category", F.lit(", set right"))),
    })


# File-level node types and the edges some types are expected to have.
FILE_LEVEL = ["file", "config", "document", "service", "pipeline", "table", "schema", "resource", "endpoint"]
EXPECTED_EDGES = {
    "document": ["documents"],
    "service": ["deploys", "depends_on"],
    "pipeline": ["triggers"],
    "table": ["migrates", "defines_schema"],
    "schema": ["defines_schema"],
    "domain": ["contains_flow"],
    "flow": ["flow_step"],
}


def review_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, tour: DataFrame) -> DataFrame:
    """All review checks as ``(check, severity, key)`` rows (CL6)."""
    c = F.col

    def found(df: DataFrame, check: str, severity: str, key: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"))

    ids = nodes.select("id").distinct()
    fields = F.array(
        *[F.when(blank(c(f)), F.lit(f)) for f in ("type", "name", "summary")],
        F.when(c("tags").isNull() | (F.size("tags") == 0), F.lit("tags")),
    )
    missing = nodes.select("id", F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("f"))
    src_ids, tgt_ids = ids.withColumnRenamed("id", "source"), ids.withColumnRenamed("id", "target")
    member_ids = ids.withColumnRenamed("id", "node_id")
    layered = members.select("node_id", "layer_id").distinct().groupBy("node_id").agg(F.count("*").alias("n"))
    file_level = nodes.filter(c("type").isin(FILE_LEVEL)).select(c("id").alias("node_id")).distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    steps = tour.groupBy("step_order").agg(F.count("node_id").alias("n"))
    step_stats = steps.agg(F.count("*").alias("n"), F.min("step_order").alias("lo"), F.max("step_order").alias("hi"))
    # one row an id with a flag for each type that some node expects, so that it meets the nodes where it is counted
    looked_for = sorted({t for types in EXPECTED_EDGES.values() for t in types})
    typed_ends = (
        edges.filter(c("type").isin(looked_for)).select("type", F.explode(F.array("source", "target")).alias("id"))
        .groupBy("id").agg(*[F.max(c("type") == t).alias(t) for t in looked_for])
        .select("id", F.array_compact(F.array(*[F.when(c(t), F.lit(t)) for t in looked_for])).alias("types"))
    )
    wanted = nodes.select(
        "id",
        lookup({k: ",".join(v) for k, v in EXPECTED_EDGES.items()}, c("type")).alias("want"),
    ).filter("want IS NOT NULL")
    satisfied = wanted.join(typed_ends, "id").filter(F.arrays_overlap(F.split("want", ","), "types"))
    name_only = (c("summary") == c("name")) | (c("summary") == F.element_at(F.split("file_path", "/"), -1))
    checks = [
        found(missing, "missing-field", "critical", F.concat_ws("|", "id", "f")),
        found(
            nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate-id", "critical", c("id")
        ),
        found(edges.join(src_ids, "source", "left_anti"), "dangling-source", "critical", c("seq")),
        found(edges.join(tgt_ids, "target", "left_anti"), "dangling-target", "critical", c("seq")),
        found(
            members.join(member_ids, "node_id", "left_anti"), "dangling-layer-member", "critical",
            F.concat_ws("|", "layer_id", "node_id"),
        ),
        found(
            tour.join(member_ids, "node_id", "left_anti"), "dangling-tour-member", "critical",
            F.concat_ws("|", c("step_order").cast("string"), "node_id"),
        ),
        found(file_level.join(layered, "node_id", "left_anti"), "no-layer", "critical", c("node_id")),
        found(layered.filter("n > 1"), "many-layers", "critical", c("node_id")),
        found(edges.filter("source = target"), "self-edge", "warning", c("seq")),
        found(ids.join(ends, "id", "left_anti"), "orphan", "warning", c("id")),
        found(step_stats.filter("lo <> 1 OR hi <> n"), "tour-order", "warning", F.concat_ws("|", "lo", "hi", "n")),
        found(step_stats.filter("n < 5 OR n > 15"), "tour-length", "warning", c("n")),
        found(nodes.filter(name_only), "summary-is-name", "warning", c("id")),
        found(
            nodes.filter(F.split_part("id", F.lit(":"), F.lit(1)) != c("type")), "prefix-mismatch", "warning", c("id")
        ),
        found(wanted.join(satisfied.select("id"), "id", "left_anti"), "expected-edge", "warning", c("id")),
    ]
    out = checks[0]
    for df in checks[1:]:
        out = out.unionByName(df)
    return out


def review_stats(nodes: DataFrame, edges: DataFrame, members: DataFrame, tour: DataFrame) -> DataFrame:
    """Totals and per-type counts of a reviewed graph (GA28)."""

    def by_type(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).withColumn("stat", F.lit(name))

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit("all").alias("value"), "n", F.lit(name).alias("stat"))

    return (
        by_type(nodes, "node-type").unionByName(by_type(edges, "edge-type"))
        .unionByName(total(nodes, "nodes")).unionByName(total(edges, "edges"))
        .unionByName(total(members.select("layer_id").distinct(), "layers"))
        .unionByName(total(tour.select("step_order").distinct(), "tour-steps"))
    )


def _prefixed(node_id: Column) -> Column:
    return F.when(node_id.rlike(rf"^({'|'.join(FILE_LEVEL)}):"), node_id).otherwise(F.concat(F.lit("file:"), node_id))


def normalise_layers(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """``raw(layer_id, name, node_ids, nodes, layer_pos)`` with legacy columns
    -> clean member rows (CL7)."""
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    layer = F.when(blank(F.col("layer_id")), F.concat(F.lit("layer:"), kebab(F.col("name")))).otherwise(F.col("layer_id"))
    rows = raw.select(
        layer.alias("layer_id"), F.col("name").alias("layer_name"), "layer_pos",
        F.posexplode(F.coalesce("node_ids", "nodes")).alias("member_pos", "node_id"),
    )
    return rows.withColumn("node_id", _prefixed(F.col("node_id"))).join(ids, "node_id", "left_semi")


def normalise_tour(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """``raw(step_order, title, description, why_it_matters, node_ids,
    nodes_to_inspect)`` -> clean member rows (CL7)."""
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    rows = raw.select(
        "step_order", "title", F.coalesce("description", "why_it_matters").alias("description"),
        F.posexplode(F.coalesce("node_ids", "nodes_to_inspect")).alias("pos", "node_id"),
    )
    return rows.withColumn("node_id", _prefixed(F.col("node_id"))).join(ids, "node_id", "left_semi").orderBy(
        "step_order", "pos"
    )


def step_flow_slugs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Step id -> slug of its flow; the last edge wins (EP1)."""
    flows = nodes.filter("type = 'flow'").select(F.col("id").alias("source"), F.col("name").alias("_name"))
    slug = kebab(F.col("_name"))
    return (
        edges.filter("type = 'flow_step'").join(flows, "source")
        .groupBy(F.col("target").alias("step_id")).agg(F.max_by(slug, "seq").alias("flow_slug"))
    )
