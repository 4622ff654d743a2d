"""Queries: validation and review (CL2-CL7, EP1, GA28, GA29)."""

from pyspark.sql import functions as F

from graphloom import dims
from graphloom.operators import clean, stats
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.q_merge import NT
from graphloom.plans.registry import query, values_cte

ET = ", ".join(f"'{t}'" for t in dims.EDGE_TYPES)
O_NA = "o_na AS (" + values_cte(["a", "t"], list(dims.NODE_TYPE_ALIASES.items())) + ")"
O_EA = "o_ea AS (" + values_cte(["a", "t"], list(dims.EDGE_TYPE_ALIASES.items())) + ")"
O_CL = f"""{O_NA}, {O_EA},
o_n AS (SELECT id, name, seq, tags IS NULL AS no_tags, coalesce(summary,'') = '' AS no_summary,
   coalesce(type,'') = '' AS no_type, coalesce(complexity,'') = '' AS no_complexity, lower(complexity) IN ('low','easy','medium','intermediate','high','hard','difficult') AS al,
   coalesce(o_na.t, nullif(lower(type), ''), 'file') AS type,
   CASE WHEN coalesce(complexity,'') = '' THEN 'moderate' WHEN lower(complexity) IN ('low','easy') THEN 'simple' WHEN lower(complexity) IN ('medium','intermediate') THEN 'moderate'
     WHEN lower(complexity) IN ('high','hard','difficult') THEN 'complex' ELSE lower(complexity) END AS complexity,
   CASE WHEN coalesce(summary,'') = '' THEN coalesce(nullif(name,''), 'No summary') ELSE summary END AS summary,
   coalesce(array_to_string(tags, ','), '') AS tags
   FROM v_dirty_nodes LEFT JOIN o_na ON o_na.a = lower(type)),
o_nok AS (SELECT *, id IS NOT NULL AND name IS NOT NULL AND type IN ({NT}) AND complexity IN ('simple','moderate','complex') AS ok FROM o_n),
o_e AS (SELECT source, target, seq, coalesce(type,'') = '' AS no_type, coalesce(direction,'') = '' AS no_dir, weight IS NULL AS no_weight,
   lower(direction) IN ('to','outbound','from','inbound','both','mutual') AS al, coalesce(o_ea.t, nullif(lower(type),''), 'depends_on') AS type,
   CASE WHEN coalesce(direction,'') = '' THEN 'forward' WHEN lower(direction) IN ('to','outbound') THEN 'forward' WHEN lower(direction) IN ('from','inbound') THEN 'backward'
     WHEN lower(direction) IN ('both','mutual') THEN 'bidirectional' ELSE lower(direction) END AS direction,
   coalesce(TRY_CAST(weight AS DOUBLE), 0.5) AS w FROM v_dirty_edges LEFT JOIN o_ea ON o_ea.a = lower(type)),
o_eok AS (SELECT *, greatest(0, least(1, w))::DOUBLE AS weight, source IS NOT NULL AND target IS NOT NULL AND type IN ({ET}) AND direction IN ('forward','backward','bidirectional') AS ok,
   source IN (SELECT id FROM o_nok WHERE ok) AS s, target IN (SELECT id FROM o_nok WHERE ok) AS t FROM o_e),
o_iss AS (
  SELECT 'nodes' AS collection, 'auto-corrected' AS level, 'missing-field' AS category, 'type' AS field, seq FROM o_n WHERE no_type
  UNION ALL SELECT 'nodes', 'auto-corrected', 'missing-field', 'complexity', seq FROM o_n WHERE no_complexity
  UNION ALL SELECT 'nodes', 'auto-corrected', 'alias', 'complexity', seq FROM o_n WHERE al
  UNION ALL SELECT 'nodes', 'auto-corrected', 'missing-field', 'tags', seq FROM o_n WHERE no_tags
  UNION ALL SELECT 'nodes', 'auto-corrected', 'missing-field', 'summary', seq FROM o_n WHERE no_summary
  UNION ALL SELECT 'nodes', 'dropped', 'invalid-node', '', seq FROM o_nok WHERE NOT ok
  UNION ALL SELECT 'edges', 'auto-corrected', 'missing-field', 'type', seq FROM o_e WHERE no_type
  UNION ALL SELECT 'edges', 'auto-corrected', 'missing-field', 'direction', seq FROM o_e WHERE no_dir
  UNION ALL SELECT 'edges', 'auto-corrected', 'alias', 'direction', seq FROM o_e WHERE al
  UNION ALL SELECT 'edges', 'auto-corrected', CASE WHEN no_weight THEN 'missing-field' ELSE 'type-coercion' END, 'weight', seq FROM o_e
  UNION ALL SELECT 'edges', 'auto-corrected', 'out-of-range', 'weight', seq FROM o_e WHERE w < 0 OR w > 1
  UNION ALL SELECT 'edges', 'dropped', 'invalid-edge', '', seq FROM o_eok WHERE NOT ok
  UNION ALL SELECT 'edges', 'dropped', 'invalid-reference', CASE WHEN NOT s THEN 'source' ELSE 'target' END, seq FROM o_eok WHERE ok AND NOT (s AND t))"""


def _validated(get):
    return clean.validate_graph(get("v_dirty_nodes"), get("v_dirty_edges"))


@query("cl2_sanitise_nodes", "SELECT seq, lower(type) AS type, lower(complexity) AS complexity FROM v_dirty_nodes")
def _(get):
    return clean.sanitise_nodes(get("v_dirty_nodes")).select("seq", "type", "complexity")


@query(
    "cl3_fix_edges",
    """SELECT seq, CASE WHEN coalesce(direction,'') = '' THEN 'forward' WHEN lower(direction) = 'inbound' THEN 'backward'
      WHEN lower(direction) = 'both' THEN 'bidirectional' ELSE lower(direction) END AS direction,
      greatest(0, least(1, coalesce(TRY_CAST(weight AS DOUBLE), 0.5)))::DOUBLE AS weight FROM v_dirty_edges""",
)
def _(get):
    return clean.fix_edges(clean.sanitise_edges(get("v_dirty_edges"))).select("seq", "direction", "weight")


@query(
    "cl4_alias_types",
    f"WITH {O_EA} SELECT seq, coalesce(o_ea.t, lower(type)) AS type FROM v_dirty_edges LEFT JOIN o_ea ON o_ea.a = lower(type)",
)
def _(get):
    return clean.alias_types(clean.sanitise_edges(get("v_dirty_edges")), dims.EDGE_TYPE_ALIASES).select("seq", "type")


@query("cl5_valid_nodes", f"WITH {O_CL} SELECT id, type, name, complexity, summary, tags, seq FROM o_nok WHERE ok")
def _(get):
    return _validated(get).nodes.withColumn("tags", F.array_join("tags", ",")).select(
        "id", "type", "name", "complexity", "summary", "tags", "seq"
    )


@query("cl5_valid_edges", f"WITH {O_CL} SELECT source, target, type, direction, weight, seq FROM o_eok WHERE ok AND s AND t")
def _(get):
    return _validated(get).edges.select("source", "target", "type", "direction", "weight", "seq")


@query("cl5_issues", f"WITH {O_CL} SELECT collection, level, category, field, seq FROM o_iss")
def _(get):
    return _validated(get).issues.select("collection", "level", "category", "field", "seq")


# Layers and tour steps with lists of ids, some of them broken or naming unknown nodes.
VIEWS["v_listed_layers"] = """
SELECT CAST(seq AS BIGINT) AS seq, layer_id AS id, CASE WHEN seq % 5 = 3 THEN NULL ELSE layer_id END AS name,
       CASE WHEN seq % 6 = 5 THEN NULL ELSE 'about ' || layer_id END AS description,
       CASE WHEN seq % 7 = 4 THEN NULL ELSE node_ids END AS node_ids
FROM (SELECT layer_id, row_number() OVER (ORDER BY layer_id) - 1 AS seq, array_sort(array_agg(node_id)) AS node_ids
      FROM v_layer_members GROUP BY layer_id) t"""
VIEWS["v_listed_tour"] = """
SELECT CAST(seq AS BIGINT) AS seq, CASE WHEN seq % 4 = 2 THEN NULL ELSE step_order END AS step_order,
       CASE WHEN seq % 9 = 7 THEN NULL ELSE title END AS title, 'step ' || title AS description, node_ids
FROM (SELECT step_order, title, row_number() OVER (ORDER BY step_order, title) - 1 AS seq, array_sort(array_agg(node_id)) AS node_ids
      FROM v_tour_members GROUP BY step_order, title) t"""

O_LIST = f"""{O_CL}, o_ids AS (SELECT DISTINCT id FROM o_nok WHERE ok),
o_ll AS (SELECT seq, node_ids, CASE WHEN name IS NULL THEN 'name' WHEN description IS NULL THEN 'description' WHEN node_ids IS NULL THEN 'nodeIds' END AS lack FROM v_listed_layers),
o_lt AS (SELECT seq, node_ids, CASE WHEN step_order IS NULL THEN 'step_order' WHEN title IS NULL THEN 'title' END AS lack FROM v_listed_tour),
o_lm AS (SELECT 'layers' AS collection, seq, unnest(node_ids) AS node_id, unnest(range(len(node_ids))) AS pos FROM o_ll WHERE lack IS NULL
  UNION ALL SELECT 'tour', seq, unnest(node_ids), unnest(range(len(node_ids))) FROM o_lt WHERE lack IS NULL)"""


def _listed(get):
    nodes = _validated(get).nodes
    tour = get("v_listed_tour")
    return clean.validate_layers(get("v_listed_layers"), nodes), clean.validate_tour(tour, nodes)


@query("cl5_listed_members", f"WITH {O_LIST} SELECT collection, seq, pos, node_id FROM o_lm WHERE node_id IN (SELECT id FROM o_ids)")
def _(get):
    layers, tour = _listed(get)
    return layers.members.withColumn("collection", F.lit("layers")).unionByName(
        tour.members.withColumn("collection", F.lit("tour"))).withColumn("pos", F.col("pos").cast("long"))


@query(
    "cl5_described_issues",
    f"""WITH {O_LIST}, o_all AS (SELECT collection, level, category, field, seq FROM o_iss
      UNION ALL SELECT 'layers', 'dropped', 'invalid-layer', lack, seq FROM o_ll WHERE lack IS NOT NULL
      UNION ALL SELECT 'tour', 'dropped', 'invalid-tour-step', lack, seq FROM o_lt WHERE lack IS NOT NULL),
    o_row AS (SELECT *, collection || '[' || seq || ']' AS r FROM o_all)
    SELECT level, category, CASE WHEN level = 'fatal' THEN '' WHEN field <> '' AND (level <> 'dropped' OR category = 'invalid-reference') THEN r || '.' || field ELSE r END AS path,
      CASE WHEN category = 'no-valid-nodes' THEN 'No valid nodes found in knowledge graph' WHEN level = 'fatal' THEN 'Missing or invalid project metadata'
           WHEN category = 'invalid-reference' THEN r || ': ' || field || ' does not exist in nodes — removed'
           WHEN level = 'dropped' AND field <> '' THEN r || ': ' || field || ' is missing or invalid — removed'
           WHEN level = 'dropped' THEN r || ': missing or invalid fields — removed'
           ELSE r || '.' || field || ': ' || category || ', set right' END AS message FROM o_row""",
)
def _(get):
    layers, tour = _listed(get)
    every = _validated(get).issues.unionByName(layers.issues).unionByName(tour.issues)
    return clean.described(every).select("level", "category", "path", "message")


@query(
    "ga29_issue_counts",
    f"WITH {O_CL} SELECT level, category, count(*) AS n, CASE level WHEN 'fatal' THEN 0 WHEN 'dropped' THEN 1 ELSE 2 END AS rank FROM o_iss GROUP BY ALL",
)
def _(get):
    return stats.issue_counts(_validated(get).issues)


O_CL6 = """o_t AS (SELECT DISTINCT id, type FROM (SELECT source AS id, type FROM v_edges UNION ALL SELECT target, type FROM v_edges)),
o_ly AS (SELECT node_id, count(DISTINCT layer_id) AS n FROM v_dangling_members GROUP BY 1),
o_st AS (SELECT count(DISTINCT step_order) AS n, min(step_order) AS lo, max(step_order) AS hi FROM v_tour_members),
o_chk AS (
 SELECT 'missing-field' AS "check", 'critical' AS severity, id || '|type' AS key FROM v_review_nodes WHERE coalesce(type,'') = ''
 UNION ALL SELECT 'missing-field', 'critical', id || '|name' FROM v_review_nodes WHERE coalesce(name,'') = ''
 UNION ALL SELECT 'missing-field', 'critical', id || '|summary' FROM v_review_nodes WHERE coalesce(summary,'') = ''
 UNION ALL SELECT 'missing-field', 'critical', id || '|tags' FROM v_review_nodes WHERE coalesce(len(tags),0) = 0
 UNION ALL SELECT 'duplicate-id', 'critical', id FROM v_review_nodes GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'dangling-source', 'critical', seq::VARCHAR FROM v_edges WHERE source NOT IN (SELECT id FROM v_review_nodes)
 UNION ALL SELECT 'dangling-target', 'critical', seq::VARCHAR FROM v_edges WHERE target NOT IN (SELECT id FROM v_review_nodes)
 UNION ALL SELECT 'dangling-layer-member', 'critical', layer_id || '|' || node_id FROM v_dangling_members WHERE node_id NOT IN (SELECT id FROM v_review_nodes)
 UNION ALL SELECT 'dangling-tour-member', 'critical', step_order::VARCHAR || '|' || node_id FROM v_tour_members WHERE node_id NOT IN (SELECT id FROM v_review_nodes)
 UNION ALL SELECT DISTINCT 'no-layer', 'critical', id FROM v_review_nodes WHERE type IN ('file','config','document','service','pipeline','table','schema','resource','endpoint')
   AND id NOT IN (SELECT node_id FROM o_ly)
 UNION ALL SELECT 'many-layers', 'critical', node_id FROM o_ly WHERE n > 1
 UNION ALL SELECT 'self-edge', 'warning', seq::VARCHAR FROM v_edges WHERE source = target
 UNION ALL SELECT DISTINCT 'orphan', 'warning', id FROM v_review_nodes WHERE id NOT IN (SELECT id FROM o_t)
 UNION ALL SELECT 'tour-order', 'warning', lo || '|' || hi || '|' || n FROM o_st WHERE lo <> 1 OR hi <> n
 UNION ALL SELECT 'tour-length', 'warning', n::VARCHAR FROM o_st WHERE n < 5 OR n > 15
 UNION ALL SELECT 'summary-is-name', 'warning', id FROM v_review_nodes WHERE summary = name OR summary = split_part(file_path, '/', -1)
 UNION ALL SELECT 'prefix-mismatch', 'warning', id FROM v_review_nodes WHERE split_part(id, ':', 1) <> type
 UNION ALL SELECT 'expected-edge', 'warning', id FROM v_review_nodes n WHERE
   (type = 'document' AND id NOT IN (SELECT id FROM o_t WHERE type = 'documents'))
   OR (type = 'service' AND id NOT IN (SELECT id FROM o_t WHERE type IN ('deploys','depends_on')))
   OR (type = 'domain' AND id NOT IN (SELECT id FROM o_t WHERE type = 'contains_flow'))
   OR (type = 'flow' AND id NOT IN (SELECT id FROM o_t WHERE type = 'flow_step')))"""

VIEWS["v_review_nodes"] = """SELECT id, CASE WHEN seq % 41 = 0 THEN 'service' ELSE type END AS type,
  CASE WHEN seq % 43 = 0 THEN '' ELSE name END AS name, file_path, CASE WHEN seq % 47 = 0 THEN name ELSE summary END AS summary,
  CASE WHEN seq % 53 = 0 THEN NULL ELSE tags END AS tags, seq FROM v_nodes WHERE seq % 59 <> 0
 UNION ALL SELECT id, type, name, file_path, summary, tags, seq FROM v_nodes WHERE type = 'step' AND seq % 3 = 0"""


def _review(get):
    return clean.review_graph(
        get("v_review_nodes"), get("v_edges"), get("v_dangling_members"), get("v_tour_members")
    )


@query("cl6_review_checks", f'WITH {O_CL6} SELECT "check", severity, key FROM o_chk')
def _(get):
    return _review(get)


@query("ga28_grouped_issues", f'WITH {O_CL6} SELECT "check", severity, count(*) AS n FROM o_chk GROUP BY ALL')
def _(get):
    return _review(get).groupBy("check", "severity").agg(F.count("*").alias("n"))


@query(
    "ga28_review_stats",
    """SELECT 'node-type' AS stat, type AS value, count(*) AS n FROM v_nodes GROUP BY 2 UNION ALL SELECT 'edge-type', type, count(*) FROM v_edges GROUP BY 2
    UNION ALL SELECT 'nodes', 'all', count(*) FROM v_nodes UNION ALL SELECT 'edges', 'all', count(*) FROM v_edges
    UNION ALL SELECT 'layers', 'all', count(DISTINCT layer_id) FROM v_layer_members UNION ALL SELECT 'tour-steps', 'all', count(DISTINCT step_order) FROM v_tour_members""",
)
def _(get):
    return clean.review_stats(get("v_nodes"), get("v_edges"), get("v_layer_members"), get("v_tour_members"))


VIEWS["v_raw_layers"] = """SELECT CASE WHEN p_size % 2 = 0 THEN '' ELSE 'layer:x' || CAST(p_partkey AS STRING) END AS layer_id,
  upper(p_name) AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE ARR(path, 'file:' || path, 'gone') END AS node_ids,
  ARR(path, 'document:o' || CAST(p_partkey AS STRING)) AS nodes, p_partkey AS layer_pos FROM v_part"""


@query(
    "cl7_normalise_layers",
    """WITH o_r AS (SELECT CASE WHEN layer_id = '' THEN 'layer:' || regexp_replace(lower(name), '\\s+', '-', 'g') ELSE layer_id END AS layer_id, layer_pos,
      coalesce(node_ids, nodes) AS ids FROM v_raw_layers),
     o_x AS (SELECT layer_id, layer_pos, unnest(ids) AS nid, generate_subscripts(ids, 1) - 1 AS member_pos FROM o_r),
     o_y AS (SELECT layer_id, layer_pos, member_pos, CASE WHEN regexp_matches(nid, '^(file|document):') THEN nid ELSE 'file:' || nid END AS node_id FROM o_x)
     SELECT layer_id, layer_pos, node_id FROM o_y WHERE node_id IN (SELECT id FROM v_nodes)""",
)
def _(get):
    return clean.normalise_layers(get("v_raw_layers"), get("v_nodes")).select("layer_id", "layer_pos", "node_id")


@query(
    "cl7_normalise_tour",
    """SELECT layer_pos AS step_order, lower(name) AS description, 'file:' || regexp_replace(nid, '^file:', '') AS node_id FROM
     (SELECT layer_pos, name, unnest(coalesce(node_ids, ARR(nodes[1]))) AS nid FROM v_raw_layers) WHERE nid <> 'gone'""",
)
def _(get):
    raw = get("v_raw_layers").select(
        F.col("layer_pos").alias("step_order"), F.col("name").alias("title"),
        F.lit(None).cast("string").alias("description"), F.lower("name").alias("why_it_matters"), "node_ids",
        F.slice("nodes", 1, 1).alias("nodes_to_inspect"),
    )
    return clean.normalise_tour(raw, get("v_nodes")).select("step_order", "description", "node_id")


@query(
    "ep1_step_flow_slugs",
    """SELECT e.target AS step_id, arg_max(replace(lower(n.name), ' ', '-'), e.seq) AS flow_slug FROM v_edges e
    JOIN v_nodes n ON n.id = e.source AND n.type = 'flow' WHERE e.type = 'flow_step' GROUP BY 1""",
)
def _(get):
    return clean.step_flow_slugs(get("v_nodes"), get("v_edges"))
