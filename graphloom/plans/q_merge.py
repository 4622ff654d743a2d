"""Queries: id functions, cleaning of batches, dedup policies, merges."""

from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions import ids
from graphloom.operators import dedup, endpoints, linking, merge
from graphloom.plans.registry import query

P = ", ".join(f"'{p}'" for p in dims.ID_PREFIXES)
NT = ", ".join(f"'{p}'" for p in dims.NODE_TYPES)

O_COMPLEXITY = """CASE WHEN lower(trim(complexity)) IN ('simple','moderate','complex') THEN lower(trim(complexity))
 WHEN lower(trim(complexity)) IN ('low','easy') THEN 'simple'
 WHEN lower(trim(complexity)) IN ('medium','intermediate') THEN 'moderate'
 WHEN lower(trim(complexity)) IN ('high','hard','difficult') THEN 'complex'
 WHEN trunc(TRY_CAST(complexity AS DOUBLE)) <= 3 THEN 'simple'
 WHEN trunc(TRY_CAST(complexity AS DOUBLE)) <= 6 THEN 'moderate'
 WHEN TRY_CAST(complexity AS DOUBLE) IS NOT NULL THEN 'complex' ELSE 'moderate' END"""
O_STATUS = """CASE WHEN lower(trim(complexity)) IN ('simple','moderate','complex') THEN 'valid'
 WHEN lower(trim(complexity)) IN ('low','easy','medium','intermediate','high','hard','difficult')
  OR TRY_CAST(complexity AS DOUBLE) IS NOT NULL THEN 'mapped' ELSE 'unknown' END"""
O_DIRECTION = """CASE WHEN lower(direction) IN ('both','mutual','bidirectional') THEN 'bidirectional'
 WHEN lower(direction) = 'backward' THEN 'backward' ELSE 'forward' END"""

O_NORM = f"""
o_n1 AS (SELECT *, CASE WHEN split_part(id,':',1) IN ({P}) AND split_part(id,':',1) = split_part(id,':',2)
     AND substr(id, 2*length(split_part(id,':',1))+2, 1) = ':' THEN substr(id, length(split_part(id,':',1))+2)
     ELSE id END AS s1 FROM v_dirty_nodes WHERE id IS NOT NULL AND id <> ''),
o_n2 AS (SELECT *, CASE WHEN split_part(s1,':',1) NOT IN ({P}) AND split_part(s1,':',2) IN ({P})
     AND split_part(s1,':',3) <> '' THEN substr(s1, length(split_part(s1,':',1))+2) ELSE s1 END AS s2 FROM o_n1),
o_n3 AS (SELECT *, CASE WHEN starts_with(s2,'func:') THEN 'function:' || substr(s2,6) ELSE s2 END AS s3 FROM o_n2),
o_norm AS (SELECT id AS old_id, type, name, file_path, summary, tags, complexity AS raw_complexity,
  CASE WHEN split_part(s3,':',1) IN ({P}) AND contains(s3,':') THEN s3
       WHEN type IN ('function','class') THEN type || ':' || coalesce(nullif(file_path,''),'__nofilepath__') || ':' || coalesce(name, s3)
       ELSE CASE WHEN type = 'func' THEN 'function' WHEN type IN ({NT}) THEN type ELSE 'file' END || ':' || s3 END AS id,
  {O_COMPLEXITY} AS complexity, {O_STATUS} AS status, seq FROM o_n3)"""

O_MAP = """
o_map AS (SELECT old_id, arg_max(id, seq) AS new_id FROM o_norm WHERE old_id <> id GROUP BY old_id),
o_edges AS (SELECT coalesce(s.new_id, e.source) AS source, coalesce(t.new_id, e.target) AS target, e.type,
   e.direction, e.weight, e.description, e.seq
   FROM v_dirty_edges e LEFT JOIN o_map s ON s.old_id = e.source LEFT JOIN o_map t ON t.old_id = e.target),
o_nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM o_norm) WHERE rn = 1)"""

O_LINK = """
o_files AS (SELECT id, coalesce(nullif(file_path,''), substr(id,6)) AS path, seq,
   regexp_matches(coalesce(nullif(file_path,''), substr(id,6)), '[^/][.](test|spec)[.](ts|tsx|js|jsx|mjs|cjs|vue)$')
   OR regexp_matches(coalesce(nullif(file_path,''), substr(id,6)), '(^|/)(test_[^/]*|[^/]*_test)[.]py$') AS is_test
   FROM o_nodes WHERE starts_with(id,'file:')),
o_given AS (SELECT e.*, s.is_test AS st, t.is_test AS tt FROM o_edges e
   LEFT JOIN o_files s ON s.id = e.source LEFT JOIN o_files t ON t.id = e.target WHERE e.type = 'tested_by'),
o_usable AS (
   SELECT source, target, direction, weight, description, seq, false AS swapped FROM o_given WHERE NOT st AND tt
   UNION ALL
   SELECT target, source, 'forward', weight, CASE WHEN description IS NULL OR description = ''
     THEN 'Direction corrected (was test -> production)' ELSE description || ' [direction corrected]' END, seq, true
   FROM o_given WHERE st AND NOT tt),
o_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target
   ORDER BY coalesce(TRY_CAST(weight AS DOUBLE),0) DESC, seq) AS rn FROM o_usable) WHERE rn = 1),
o_exts AS (SELECT * FROM (VALUES ('.ts',1),('.tsx',2),('.js',3),('.jsx',4),('.mjs',5),('.cjs',6),('.vue',7)) AS x(ext, rank)),
o_cands AS (SELECT f.id AS target, f.seq, p.id AS source,
   row_number() OVER (PARTITION BY f.id ORDER BY x.rank, p.seq DESC) AS rn
   FROM o_files f JOIN o_exts x ON true
   JOIN o_files p ON p.path = regexp_replace(f.path, '[.]test[.]ts$', x.ext) AND NOT p.is_test
   WHERE f.is_test AND f.id NOT IN (SELECT target FROM o_kept)),
o_added AS (SELECT source, target, seq FROM o_cands WHERE rn = 1),
o_linked AS (
   SELECT source, target, 'tested_by' AS type, direction, weight, description, seq FROM o_kept
   UNION ALL SELECT source, target, 'tested_by', 'forward', '0.5', 'Path-based pairing (deterministic)', seq FROM o_added),
o_all AS (SELECT * FROM o_linked UNION ALL SELECT * FROM o_edges WHERE type IS NULL OR type <> 'tested_by')"""

O_FINAL = f"""
o_conn AS (SELECT source, target, type, {O_DIRECTION} AS direction, TRY_CAST(weight AS DOUBLE) AS weight, description, seq
   FROM o_all WHERE source IN (SELECT id FROM o_nodes) AND target IN (SELECT id FROM o_nodes)),
o_final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type, direction
   ORDER BY coalesce(weight,0) DESC, seq) AS rn FROM o_conn) WHERE rn = 1)"""


@query("fn1_canonical_id", f"WITH {O_NORM} SELECT seq, old_id, id FROM o_norm")
def _(get):
    n = merge.normalise_nodes(get("v_dirty_nodes"))
    return n.select("seq", "old_id", "id")


@query("fn2_complexity", f"SELECT seq, {O_COMPLEXITY} AS complexity, {O_STATUS} AS status FROM v_dirty_nodes")
def _(get):
    return get("v_dirty_nodes").select(
        "seq", ids.complexity(F.col("complexity")).alias("complexity"),
        ids.complexity_status(F.col("complexity")).alias("status"),
    )


@query("fn3_direction", f"SELECT {O_DIRECTION} AS direction, count(*) AS n FROM v_dirty_edges GROUP BY 1")
def _(get):
    return get("v_dirty_edges").groupBy(ids.direction(F.col("direction")).alias("direction")).agg(
        F.count("*").alias("n")
    )


@query(
    "cl1_normalise_nodes",
    f"""WITH {O_NORM} SELECT seq, id, complexity, status,
    CASE WHEN old_id = id THEN NULL
      WHEN split_part(old_id,':',1) IN ({P}) AND split_part(old_id,':',1) = split_part(old_id,':',2) THEN
        split_part(old_id,':',1) || ':' || split_part(old_id,':',1) || ': -> ' || split_part(old_id,':',1) || ': (double prefix)'
      WHEN split_part(old_id,':',1) NOT IN ({P}) AND split_part(old_id,':',2) IN ({P}) AND length(old_id) - length(replace(old_id,':','')) >= 2
        THEN '<project>:' || split_part(old_id,':',2) || ': -> ' || split_part(old_id,':',2) || ': (project-name prefix)'
      WHEN starts_with(old_id,'func:') THEN 'func: -> function: (prefix canonicalization)'
      ELSE 'bare path -> ' || split_part(id,':',1) || ': (missing prefix)' END AS id_fix FROM o_norm""",
)
def _(get):
    n = merge.normalise_nodes(get("v_dirty_nodes"))
    return n.select("seq", "id", "complexity", F.col("complexity_status").alias("status"), "id_fix")


@query("wn1_dedup_nodes_last", f"WITH {O_NORM}, {O_MAP} SELECT id, type, name, summary, seq FROM o_nodes")
def _(get):
    n = dedup.dedup_nodes(merge.normalise_nodes(get("v_dirty_nodes")))
    return n.select("id", "type", "name", "summary", "seq")


def _edge_oracle(key: str, order: str) -> str:
    return (
        f"SELECT source, target, type, direction, weight, seq FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY {order}) AS rn FROM v_edges) WHERE rn = 1"
    )


_EDGE_COLS = ["source", "target", "type", "direction", "weight", "seq"]


@query("wn2_dedup_edges_heaviest4", _edge_oracle("source, target, type, direction", "weight DESC, seq"))
def _(get):
    return dedup.dedup_edges(get("v_edges"), dedup.EDGE_KEY4, stored=True).select(*_EDGE_COLS)


@query("wn3_dedup_edges_heaviest3", _edge_oracle("source, target, type", "weight DESC, seq"))
def _(get):
    return dedup.dedup_edges(get("v_edges"), dedup.EDGE_KEY3, stored=True).select(*_EDGE_COLS)


@query("wn4_dedup_edges_first", _edge_oracle("source, target, type", "seq"))
def _(get):
    return dedup.dedup_edges(get("v_edges"), dedup.EDGE_KEY3, keep="first", stored=True).select(*_EDGE_COLS)


@query("jn1_rewrite_endpoints", f"WITH {O_NORM}, {O_MAP} SELECT source, target, seq FROM o_edges")
def _(get):
    n = merge.normalise_nodes(get("v_dirty_nodes"))
    return endpoints.rewrite_endpoints(get("v_dirty_edges"), merge.id_mapping(n)).select("source", "target", "seq")


@query(
    "jn2_dangling_edges",
    f"""WITH {O_NORM}, {O_MAP} SELECT source, target, seq,
    CASE WHEN s AND t THEN 'missing-both' WHEN s THEN 'missing-source' ELSE 'missing-target' END AS reason
    FROM (SELECT *, source NOT IN (SELECT id FROM o_nodes) AS s, target NOT IN (SELECT id FROM o_nodes) AS t FROM o_edges)
    WHERE s OR t""",
)
def _(get):
    n, e = merge.prepared_batches(get("v_dirty_nodes"), get("v_dirty_edges"))
    return endpoints.dangling_edges(e, n).select("source", "target", "seq", "reason")


@query(
    "jn14_recover_imports",
    """SELECT DISTINCT 'file:' || src_path AS source, 'file:' || tgt_path AS target, 'imports' AS type,
      'forward' AS direction, 0.7::DOUBLE AS weight, true AS recovered
    FROM v_imports WHERE src_path <> tgt_path
    AND 'file:' || src_path IN (SELECT id FROM v_nodes WHERE type = 'file')
    AND 'file:' || tgt_path IN (SELECT id FROM v_nodes WHERE type = 'file')
    AND ('file:' || src_path, 'file:' || tgt_path) NOT IN
      (SELECT (source, target) FROM v_edges WHERE type = 'imports' AND weight < 0.05)""",
)
def _(get):
    partial = get("v_edges").filter("NOT (type = 'imports' AND weight >= 0.05)")
    return endpoints.recover_imports(get("v_nodes"), partial, get("v_imports"))


@query(
    "lt1_link_tests",
    f"""WITH {O_NORM}, {O_MAP}, {O_LINK} SELECT source, target, direction, weight, description, seq FROM o_linked""",
)
def _(get):
    n, e = merge.prepared_batches(get("v_dirty_nodes"), get("v_dirty_edges"))
    _, edges, _ = linking.link_tests(dedup.dedup_nodes(n), e)
    return edges.filter("type = 'tested_by'").select("source", "target", "direction", "weight", "description", "seq")


@query(
    "lt1_tested_tags",
    f"""WITH {O_NORM}, {O_MAP}, {O_LINK} SELECT id, array_to_string(tags, ',') AS tags FROM (
      SELECT id, list_append(coalesce(tags, []::VARCHAR[]), 'tested') AS tags FROM o_nodes
      WHERE id IN (SELECT source FROM o_linked))""",
)
def _(get):
    n, e = merge.prepared_batches(get("v_dirty_nodes"), get("v_dirty_edges"))
    nodes, _, _ = linking.link_tests(dedup.dedup_nodes(n), e)
    return nodes.filter(F.array_contains("tags", "tested")).select("id", F.array_join("tags", ",").alias("tags"))


@query(
    "jn9_ranked_candidates",
    f"""WITH {O_NORM}, {O_MAP}, o_all_tests AS (
      SELECT f.path AS path, f2.path AS found, x.rank, row_number() OVER (PARTITION BY f.path ORDER BY x.rank) AS rn
      FROM v_files f JOIN (VALUES ('.ts',1),('.tsx',2),('.js',3),('.jsx',4),('.mjs',5),('.cjs',6),('.vue',7)) AS x(ext, rank) ON true
      JOIN v_files f2 ON f2.path = regexp_replace(f.path, '[.]test[.]ts$', x.ext)
      WHERE f.path LIKE '%.test.ts') SELECT path, found FROM o_all_tests WHERE rn = 1""",
)
def _(get):
    from graphloom.functions import paths

    files = get("v_files")
    tests = paths.with_production_candidates(files.filter(paths.is_test(F.col("path"))), "path").select(
        F.col("path").alias("test"), "candidates"
    )
    known = files.select("path", F.col("path").alias("found"))
    return linking.first_existing_candidate(tests, known, ["test"]).select(F.col("test").alias("path"), "found")


@query(
    "st1_merged_edges",
    f"WITH {O_NORM}, {O_MAP}, {O_LINK}, {O_FINAL} SELECT source, target, type, direction, weight, description FROM o_final",
)
def _(get):
    g = merge.merge_batches(get("v_dirty_nodes"), get("v_dirty_edges"))
    return g.edges.select("source", "target", "type", "direction", "weight", "description")


@query(
    "st1_merged_nodes",
    f"""WITH {O_NORM}, {O_MAP}, {O_LINK} SELECT id, type, name, file_path, summary, complexity,
    array_to_string(CASE WHEN id IN (SELECT source FROM o_linked) THEN list_append(coalesce(tags, []::VARCHAR[]), 'tested')
      ELSE tags END, ',') AS tags, seq FROM o_nodes""",
)
def _(get):
    g = merge.merge_batches(get("v_dirty_nodes"), get("v_dirty_edges"))
    return g.nodes.withColumn("tags", F.array_join("tags", ",")).select(
        "id", "type", "name", "file_path", "summary", "complexity", "tags", "seq"
    )


@query(
    "ga20_fix_report",
    f"""WITH {O_NORM}, o_p AS (
    SELECT 'fixed' AS section, CASE WHEN old_id = id THEN NULL
      WHEN split_part(old_id,':',1) IN ({P}) AND split_part(old_id,':',1) = split_part(old_id,':',2) THEN
        split_part(old_id,':',1) || ':' || split_part(old_id,':',1) || ': -> ' || split_part(old_id,':',1) || ': (double prefix)'
      WHEN split_part(old_id,':',1) NOT IN ({P}) AND split_part(old_id,':',2) IN ({P}) AND length(old_id) - length(replace(old_id,':','')) >= 2
        THEN '<project>:' || split_part(old_id,':',2) || ': -> ' || split_part(old_id,':',2) || ': (project-name prefix)'
      WHEN starts_with(old_id,'func:') THEN 'func: -> function: (prefix canonicalization)'
      ELSE 'bare path -> ' || split_part(id,':',1) || ': (missing prefix)' END AS pattern FROM o_norm
    UNION ALL SELECT 'fixed', 'complexity "' || raw_complexity || '" -> "' || complexity || '"' FROM o_norm WHERE status = 'mapped'
    UNION ALL SELECT 'could-not-fix', 'complexity ' || CASE WHEN raw_complexity IS NULL THEN 'None' ELSE '"' || raw_complexity || '"' END
      || ' -> defaulted to "moderate"' FROM o_norm WHERE status = 'unknown'
    UNION ALL SELECT 'could-not-fix', 'unknown node type "' || type || '"' FROM o_norm WHERE type <> '' AND type NOT IN ({P}))
    SELECT section, pattern, count(*) AS n FROM o_p WHERE pattern IS NOT NULL GROUP BY 1, 2""",
)
def _(get):
    return merge.fix_report(merge.normalise_nodes(get("v_dirty_nodes")))


# Sub-graph fixtures: the part/order graph and a second graph that re-states some rows.
_SECOND_NODES = "SELECT id, type, upper(name) AS name, seq + 1 AS seq FROM v_nodes WHERE type IN ('file', 'step')"


@query(
    "st2_merged_nodes",
    f"""WITH o_b AS ({_SECOND_NODES}) SELECT id, type, name FROM o_b
    UNION ALL SELECT id, type, name FROM v_nodes WHERE id NOT IN (SELECT id FROM o_b)""",
)
def _(get):
    a = get("v_nodes").select("id", "type", "name", "seq")
    b = a.filter("type IN ('file', 'step')").withColumn("name", F.upper("name")).withColumn("seq", F.col("seq") + 1)
    e = get("v_edges")
    nodes, _ = merge.merge_subgraphs([a, b], [e, e])
    return nodes.select("id", "type", "name")


@query(
    "st2_merged_edges",
    """WITH o_u AS (SELECT 0 AS r, source, target, type, weight, seq FROM v_edges
      UNION ALL SELECT 1, source, target, type, weight * 2, seq FROM v_edges WHERE type IN ('imports','serves'))
    SELECT source, target, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type
      ORDER BY weight DESC, r, seq) AS rn FROM o_u) WHERE rn = 1
      AND source IN (SELECT id FROM v_nodes) AND target IN (SELECT id FROM v_nodes)""",
)
def _(get):
    a = get("v_nodes").select("id", "type", "name", "seq")
    e = get("v_edges").select("source", "target", "type", "weight", "seq")
    f = e.filter("type IN ('imports', 'serves')").withColumn("weight", F.col("weight") * 2)
    _, edges = merge.merge_subgraphs([a, a], [e, f])
    return edges.select("source", "target", "type", "weight")


# Knowledge fixture: customers as person/organization rows whose names repeat by nation.
_KB_NODES = """SELECT 'entity:k' || CAST(c_custkey AS STRING) AS id,
  CASE c_custkey % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'organization' WHEN 2 THEN 'entity' ELSE 'gizmo' END AS type,
  CASE c_custkey % 3 WHEN 0 THEN ' Group   ' ELSE 'group ' END || CAST(c_custkey % 400 AS STRING) AS name, c_custkey AS seq FROM customer
 UNION ALL SELECT 'topic:t' || CAST(n_nationkey AS STRING), 'tag', n_name, 1000000000 + n_nationkey FROM nation"""
_KB_EDGES = """SELECT 'entity:k' || CAST(o_custkey AS STRING) AS source,
  'topic:t' || CAST(o_orderkey % 25 AS STRING) AS target,
  CASE o_orderkey % 4 WHEN 0 THEN 'belongs_to' WHEN 1 THEN 'likes' WHEN 2 THEN 'CITES' ELSE 'refines' END AS type,
  'forward' AS direction, CAST(0.5 AS DOUBLE) AS weight, o_orderkey AS seq FROM orders"""
from graphloom.plans.fixtures import VIEWS  # noqa: E402

VIEWS["v_kb_nodes"] = _KB_NODES
VIEWS["v_kb_edges"] = _KB_EDGES

_O_KB = """o_t AS (SELECT id, CASE lower(type) WHEN 'person' THEN 'entity' WHEN 'organization' THEN 'entity'
    WHEN 'tag' THEN 'topic' ELSE lower(type) END AS type, name, seq,
    trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS nn FROM v_kb_nodes WHERE type <> 'gizmo'),
  o_lead AS (SELECT *, arg_min(id, seq) OVER (PARTITION BY CASE WHEN type = 'entity' THEN nn ELSE id END) AS canon FROM o_t),
  o_kn AS (SELECT id, type, name FROM o_lead WHERE canon = id),
  o_ke AS (SELECT coalesce(a.canon, e.source) AS source, e.target,
    CASE e.type WHEN 'belongs_to' THEN 'categorized_under' WHEN 'likes' THEN 'related' WHEN 'refines' THEN 'builds_on'
      ELSE lower(e.type) END AS type, e.seq FROM v_kb_edges e LEFT JOIN o_lead a ON a.id = e.source)"""


@query("st3_knowledge_nodes", f"WITH {_O_KB} SELECT id, type, name FROM o_kn")
def _(get):
    nodes, _ = merge.merge_knowledge(get("v_kb_nodes"), get("v_kb_edges"))
    return nodes.select("id", "type", "name")


@query(
    "st3_knowledge_edges",
    f"""WITH {_O_KB} SELECT source, target, type, min(seq) AS seq FROM o_ke
    WHERE source IN (SELECT id FROM o_kn) AND target IN (SELECT id FROM o_kn) GROUP BY ALL""",
)
def _(get):
    _, edges = merge.merge_knowledge(get("v_kb_nodes"), get("v_kb_edges"))
    return edges.select("source", "target", "type", "seq")


@query(
    "st4_patch_edges",
    """WITH o_gone AS (SELECT id FROM v_nodes WHERE file_path IN (SELECT path FROM v_files WHERE language = 'sql'))
    SELECT source, target, type, seq FROM v_edges WHERE source NOT IN (SELECT id FROM o_gone)
      AND target NOT IN (SELECT id FROM o_gone)
    UNION ALL SELECT source, target, 'related', seq FROM v_edges WHERE type = 'flow_step'""",
)
def _(get):
    nodes, edges = get("v_nodes"), get("v_edges")
    new_edges = edges.filter("type = 'flow_step'").withColumn("type", F.lit("related"))
    changed = get("v_files").filter("language = 'sql'").select("path")
    _, e = merge.patch_graph(nodes, edges, changed, nodes.limit(0), new_edges)
    return e.select("source", "target", "type", "seq")


@query(
    "st4_patch_nodes",
    """SELECT id, name FROM v_nodes WHERE file_path IS NULL OR file_path NOT IN (SELECT path FROM v_files WHERE language = 'sql')
    UNION ALL SELECT id, upper(name) FROM v_nodes WHERE type = 'file' AND file_path IN (SELECT path FROM v_files WHERE language = 'sql')""",
)
def _(get):
    nodes, edges = get("v_nodes"), get("v_edges")
    changed = get("v_files").filter("language = 'sql'").select("path")
    fresh = nodes.filter("type = 'file'").join(changed.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    n, _ = merge.patch_graph(
        nodes, edges, changed, fresh.select(*nodes.columns).withColumn("name", F.upper("name")), edges.limit(0)
    )
    return n.select("id", "name")


@query(
    "ga23_merge_layer_members",
    """WITH o_u AS (SELECT layer_id, node_id, member_pos, layer_name, layer_pos FROM v_layer_members
      UNION ALL SELECT 'layer:economy', node_id, member_pos, 'economy', 1 FROM v_layer_members WHERE layer_name = 'promo')
    SELECT layer_id, node_id, min(member_pos) AS member_pos, arg_min(layer_name, layer_pos) AS layer_name FROM o_u GROUP BY 1, 2""",
)
def _(get):
    m = get("v_layer_members")
    extra = m.filter("layer_name = 'promo'").withColumns(
        {"layer_id": F.lit("layer:economy"), "layer_name": F.lit("economy"), "layer_pos": F.lit(1)}
    )
    return merge.merge_layer_members(m.unionByName(extra))


@query(
    "ga23_merge_tours",
    """WITH o_s AS (SELECT p_brand AS title, p_type || ' ' || p_name AS description, 'file:' || CAST(p_size AS STRING) AS node_id,
      p_partkey AS seq FROM part),
    o_h AS (SELECT title, arg_max(description, (length(description), -seq)) AS description, min(seq) AS first_seq FROM o_s GROUP BY 1)
    SELECT (SELECT count(*) FROM o_h x WHERE x.first_seq <= h.first_seq) AS step_order, h.title, h.description, m.node_id, m.pos FROM
     (SELECT title, node_id, min(seq) AS pos FROM o_s GROUP BY 1, 2) m JOIN o_h h USING (title)""",
)
def _(get):
    part = get("part")
    steps = part.select(
        F.col("p_brand").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("description"),
        F.concat(F.lit("file:"), F.col("p_size").cast("string")).alias("node_id"), F.col("p_partkey").alias("seq"),
    )
    return merge.merge_tours(steps)


@query(
    "ga24_merge_projects",
    """WITH o_p AS (SELECT r_name AS name, ARR(lower(r_name), 'sql', 'py') AS languages, ARR('fw' || CAST(r_regionkey % 2 AS STRING)) AS frameworks,
      'region ' || CAST(r_regionkey % 3 AS STRING) AS description, CAST(2020 + r_regionkey % 4 AS STRING) AS analyzed_at,
      'h' || CAST(r_regionkey AS STRING) AS git_commit_hash, r_regionkey AS seq FROM region),
    o_l AS (SELECT v, min((seq, pos)) AS at_pos FROM (SELECT seq, unnest(languages) AS v, generate_subscripts(languages, 1) AS pos FROM o_p) GROUP BY v),
    o_f AS (SELECT v, min(seq) AS at_pos FROM (SELECT seq, unnest(frameworks) AS v FROM o_p) GROUP BY v),
    o_d AS (SELECT description AS v, min(seq) AS at_pos FROM o_p GROUP BY 1)
    SELECT (SELECT string_agg(v, ',' ORDER BY at_pos) FROM o_l) AS languages, (SELECT string_agg(v, ',' ORDER BY at_pos) FROM o_f) AS frameworks,
      (SELECT string_agg(v, ' | ' ORDER BY at_pos) FROM o_d) AS description, max(analyzed_at) AS analyzed_at,
      arg_max(git_commit_hash, (analyzed_at, -seq)) AS git_commit_hash, arg_max(name, seq) AS name FROM o_p""",
)
def _(get):
    r = get("region")
    key = F.col("r_regionkey")
    projects = r.select(
        F.col("r_name").alias("name"), F.array(F.lower("r_name"), F.lit("sql"), F.lit("py")).alias("languages"),
        F.array(F.concat(F.lit("fw"), (key % 2).cast("string"))).alias("frameworks"),
        F.concat(F.lit("region "), (key % 3).cast("string")).alias("description"),
        (key % 4 + 2020).cast("string").alias("analyzed_at"),
        F.concat(F.lit("h"), key.cast("string")).alias("git_commit_hash"), key.alias("seq"),
    )
    out = merge.merge_projects(projects)
    return out.withColumns({c: F.array_join(c, ",") for c in ("languages", "frameworks")})
