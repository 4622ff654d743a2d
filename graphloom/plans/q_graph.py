"""Queries: graph algorithms (GR, WN13, SR7)."""

from pyspark.sql import functions as F

from graphloom.operators import graphalg as ga
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import STORED, query

# Trade graph: customers, nations, regions and suppliers only (part edges make any two nodes near).
VIEWS["v_place_edges"] = "SELECT source, target, type, weight, seq FROM v_edges WHERE type IN ('categorized_under', 'contains_flow', 'flow_step', 'contains')"
STORED.add("v_place_edges")
O_ADJ = "o_adj AS (SELECT source AS s, target AS t FROM v_place_edges UNION SELECT target, source FROM v_place_edges)"


def _o_hops(start: str, hops: int) -> str:
    return f"""o_r AS (SELECT '{start}' AS id, 0 AS d UNION SELECT t, d + 1 FROM o_r JOIN o_adj ON s = id WHERE d < {hops}),
    o_b AS (SELECT id, min(d) AS depth FROM o_r GROUP BY 1)"""


@query("gr1_neighbours", f"WITH RECURSIVE {O_ADJ}, {_o_hops('step:s7', 2)} SELECT id, depth FROM o_b WHERE depth > 0")
def _(get):
    return ga.neighbours(get("v_place_edges"), "step:s7", 2)


@query(
    "gr2_shortest_path",
    f"""WITH RECURSIVE {O_ADJ}, {_o_hops('step:s7', 5)},
    o_p AS (SELECT 'file:shared/m1/p10.ts' AS id, (SELECT depth FROM o_b WHERE id = 'file:shared/m1/p10.ts') AS pos
      UNION ALL SELECT (SELECT min(s) FROM o_adj JOIN o_b ON o_b.id = s WHERE t = o_p.id AND depth = o_p.pos - 1), pos - 1 FROM o_p WHERE pos > 0)
    SELECT pos, id FROM o_p""",
)
def _(get):
    return ga.shortest_path(get("v_place_edges"), "step:s7", "file:shared/m1/p10.ts")


@query(
    "gr3_bfs_depths",
    """WITH RECURSIVE o_r AS (SELECT 'file:shared/m1/p10.ts' AS id, 0 AS d UNION SELECT 'file:' || tgt_path, d + 1 FROM o_r JOIN v_imports ON 'file:' || src_path = id WHERE d < 8)
    SELECT id, min(d) AS depth FROM o_r GROUP BY 1""",
)
def _(get):
    return ga.bfs_depths(get("v_edges"), "file:shared/m1/p10.ts")


VIEWS["v_wcc_nodes"] = """SELECT 'd' || CAST(doc_id AS STRING) AS id, doc_id AS seq FROM documents"""
# Documents sharing a text form chains: each copy points to the next copy.
VIEWS["v_wcc_edges"] = """SELECT 'd' || CAST(doc_id AS STRING) AS source, 'd' || CAST(nxt AS STRING) AS target, 'imports' AS type FROM
  (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, n_chars % 7, lang ORDER BY doc_id) AS nxt FROM documents) t WHERE nxt IS NOT NULL"""


@query(
    "gr4_components",
    """SELECT 'd' || doc_id AS id, min('d' || doc_id) OVER (PARTITION BY source, n_chars % 7, lang) AS component FROM documents""",
)
def _(get):
    return ga.components(get("v_wcc_nodes"), get("v_wcc_edges"))


@query(
    "gr4_component_report",
    """SELECT min('d' || doc_id) AS component, count(*) AS n FROM documents GROUP BY source, n_chars % 7, lang HAVING count(*) >= 2 ORDER BY n DESC, component LIMIT 12""",
)
def _(get):
    return ga.component_report(ga.components(get("v_wcc_nodes"), get("v_wcc_edges")))


VIEWS["v_flow_edges"] = """SELECT source, target, type, seq FROM v_edges WHERE type NOT IN ('contains_flow', 'serves', 'flow_step')"""


@query(
    "gr5_topological_levels",
    """WITH o_in AS (SELECT DISTINCT 'file:' || tgt_path AS id FROM v_imports)
    SELECT id, CASE WHEN type IN ('document','step') THEN 0 WHEN type = 'file' THEN -1 ELSE 1 END::INT AS level FROM v_nodes
    WHERE type IN ('document','step','file') OR (type = 'entity' AND id IN (SELECT target FROM v_edges WHERE type = 'depends_on'))""",
)
def _(get):
    nodes, edges = get("v_nodes"), get("v_flow_edges")
    levels = ga.topological_levels(nodes, edges)
    called = edges.filter("type = 'depends_on'").select(F.col("target").alias("id")).distinct()
    kinds = nodes.select("id", "type")
    shown = kinds.filter("type IN ('document', 'step', 'file')").union(
        kinds.filter("type = 'entity'").join(called, "id", "left_semi")
    )
    return levels.join(shown.select("id"), "id", "left_semi").select("id", F.coalesce("level", F.lit(-1)).alias("level"))


VIEWS["v_import_edges"] = "SELECT 'file:' || src_path AS source, 'file:' || tgt_path AS target, 'imports' AS type FROM v_imports"


@query("gr6_communities")
def _(get):
    return ga.communities(get("v_wcc_nodes"), get("v_wcc_edges"))


@query(
    "gr7_modularity",
    """WITH o_u AS (SELECT DISTINCT least(src_path, tgt_path) AS a, greatest(src_path, tgt_path) AS b FROM v_imports),
     o_e AS (SELECT split_part(a,'/',1) AS ca, split_part(b,'/',1) AS cb FROM o_u UNION ALL SELECT split_part(b,'/',1), split_part(a,'/',1) FROM o_u),
     o_c AS (SELECT ca, count(*) FILTER (ca = cb) AS i, count(*) AS t FROM o_e GROUP BY 1)
    SELECT round(sum(i)::DOUBLE / sum(t) - sum(t::DOUBLE * t) / (sum(t)::DOUBLE * sum(t)), 6) AS modularity FROM o_c""",
)
def _(get):
    member = get("v_files").select(
        F.concat(F.lit("file:"), "path").alias("id"), F.split_part("path", F.lit("/"), F.lit(1)).alias("community")
    )
    return ga.modularity(get("v_import_edges"), member).select(F.round("modularity", 6).alias("modularity"))


@query(
    "gr8_containers",
    """WITH o_g AS (SELECT 'file:' || path AS id, split_part(path, '/', 1) AS c FROM v_files)
    SELECT id, CASE WHEN count(*) OVER (PARTITION BY c) > 1 THEN c END AS container, 'folder' AS strategy FROM o_g""",
)
def _(get):
    return ga.containers(get("v_nodes").filter("type = 'file'"), get("v_import_edges"))


VIEWS["v_code_files"] = "SELECT path, regexp_replace(path, '/[^/]*$', '') AS community FROM v_files WHERE file_category = 'code'"
VIEWS["v_other_files"] = """SELECT path FROM v_files WHERE file_category <> 'code' UNION ALL SELECT DISTINCT path FROM v_infra_files WHERE path LIKE '%Dockerfile%' OR path LIKE '%migrations%'
 UNION ALL SELECT '.github/workflows/' || lower(r_name) || '.yml' FROM region UNION ALL SELECT '.circleci/' || lower(r_name) FROM region
 UNION ALL SELECT 'img/' || CASE r_regionkey WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'docker-compose.yml' ELSE lower(r_name) END FROM region"""


@query(
    "gr9_semantic_batches",
    """WITH o_cr AS (SELECT path, community, row_number() OVER (PARTITION BY community ORDER BY path) AS rn, count(*) OVER (PARTITION BY community) AS n FROM v_code_files),
     o_code AS (SELECT path, 'code:' || community || ':' || CASE WHEN n > 35 THEN floor((rn - 1) / ceil(n / ceil(n / 35)))::BIGINT ELSE 0 END AS grp, true AS m, 0 AS k FROM o_cr),
     o_d AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, split_part(path, '/', -1) AS base FROM v_other_files),
     o_g AS (SELECT *, CASE WHEN dir IN (SELECT dir FROM o_d WHERE base = 'Dockerfile') AND (base = 'Dockerfile' OR base LIKE 'docker-compose.%') THEN 'A:' || dir
       WHEN path LIKE '.github/workflows/%.yml' THEN 'B:workflows' WHEN path LIKE '.circleci/%' THEN 'C:ci' WHEN path LIKE '%.sql' AND regexp_matches(dir, '(^|/)migrations?$') THEN 'D:' || dir END AS g FROM o_d),
     o_non AS (SELECT path, g AS grp, false AS m, 1 AS k FROM o_g WHERE g IS NOT NULL
       UNION ALL SELECT path, 'E:' || dir || ':' || floor((row_number() OVER (PARTITION BY dir ORDER BY path) - 1) / 20)::BIGINT, true, 1 FROM o_g WHERE g IS NULL),
     o_rows AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, min(path) OVER (PARTITION BY grp) AS f FROM (SELECT * FROM o_code UNION ALL SELECT * FROM o_non)),
     o_pool AS (SELECT path, 'pool' AS grp, 2 AS k, floor((row_number() OVER (ORDER BY path) - 1) / 25)::BIGINT AS o1, '' AS o2 FROM o_rows WHERE m AND n < 3),
     o_fin AS (SELECT path, grp, k, CASE WHEN k = 0 THEN -n ELSE 0 END AS o1, CASE WHEN k = 0 THEN f ELSE grp END AS o2 FROM o_rows WHERE NOT (m AND n < 3) UNION ALL SELECT * FROM o_pool)
    SELECT path, dense_rank() OVER (ORDER BY k, o1, o2, grp)::BIGINT AS batch_index FROM o_fin""",
)
def _(get):
    return ga.semantic_batches(get("v_code_files"), get("v_other_files"))


@query("gr10_heuristic_tour")
def _(get):
    return ga.heuristic_tour(get("v_nodes"), get("v_edges"), get("v_layer_members"))


@query(
    "gr11_mutual_pairs",
    """SELECT DISTINCT least(a.src_path, a.tgt_path) AS a, greatest(a.src_path, a.tgt_path) AS b FROM v_imports a JOIN v_imports b ON a.src_path = b.tgt_path AND a.tgt_path = b.src_path""",
)
def _(get):
    pairs = ga.mutual_pairs(get("v_import_edges"))
    return pairs.select(F.regexp_replace("a", "^file:", "").alias("a"), F.regexp_replace("b", "^file:", "").alias("b"))


_grow = ", ".join(
    f"""o_n{r} AS (SELECT g.group_id, a.dst AS id, count(*) AS links FROM o_g{r} g JOIN o_a a ON a.src = g.id GROUP BY 1, 2),
    o_g{r + 1} AS (SELECT * FROM o_g{r} UNION ALL SELECT group_id, arg_min(id, (-links, id)) FROM o_n{r}
      WHERE links >= 2 AND (group_id, id) NOT IN (SELECT group_id, id FROM o_g{r}) GROUP BY 1)"""
    for r in range(3)
)


@query("gr11_coupled_groups", f"""WITH o_a AS MATERIALIZED (
    SELECT source AS src, target AS dst FROM v_import_edges WHERE source <> target
    UNION SELECT target, source FROM v_import_edges WHERE source <> target
  ), o_s AS (
    SELECT DISTINCT least(a.source, a.target) AS a, greatest(a.source, a.target) AS b
    FROM v_import_edges a JOIN v_import_edges b ON a.source = b.target AND a.target = b.source AND a.type = b.type
    WHERE a.source <> a.target
  ), o_g0 AS (SELECT a || '|' || b AS group_id, unnest([a, b]) AS id FROM o_s), {_grow},
  o_l AS (SELECT x.group_id, count(*) // 2 AS links FROM o_g3 x JOIN o_a ON o_a.src = x.id
          JOIN o_g3 y ON y.group_id = x.group_id AND y.id = o_a.dst GROUP BY 1),
  o_m AS (SELECT group_id, list(id ORDER BY id) AS ids FROM o_g3 GROUP BY 1),
  o_t AS (SELECT ids, links, min(group_id) AS group_id FROM o_m JOIN o_l USING (group_id) GROUP BY 1, 2
          ORDER BY links DESC, group_id LIMIT 10)
  SELECT group_id, unnest(ids) AS id FROM o_t""")
def _(get):
    return ga.coupled_groups(get("v_import_edges"))


@query(
    "gr12_feature_clusters",
    """WITH o_f AS (SELECT layer_id AS key, count(DISTINCT node_id) AS n, min(layer_pos) AS pos FROM v_layer_members WHERE node_id IN (SELECT id FROM v_nodes WHERE type = 'file') GROUP BY 1)
    SELECT 'layer-cluster' AS strategy, key, n, 0.55::DOUBLE AS confidence FROM o_f WHERE n >= 2 ORDER BY pos, key LIMIT 12""",
)
def _(get):
    return ga.feature_clusters(get("v_nodes"), get("v_edges"), get("v_layer_members"))


@query(
    "gr13_remove_nodes",
    """SELECT source, target, seq FROM v_edges WHERE source NOT IN (SELECT id FROM v_nodes WHERE type = 'step') AND target NOT IN (SELECT id FROM v_nodes WHERE type = 'step')""",
)
def _(get):
    gone = get("v_nodes").filter("type = 'step'").select("id")
    return ga.remove_nodes(get("v_nodes"), get("v_edges"), gone)[1].select("source", "target", "seq")


VIEWS["v_dated_edges"] = "SELECT source, target, type, seq, TIMESTAMP '1996-02-02 00:00:00' AS created_at FROM v_place_edges"


@query(
    "wn13_trajectory",
    f"""WITH RECURSIVE {O_ADJ}, {_o_hops('step:s7', 3)}, o_n AS (SELECT id FROM o_b WHERE depth > 0)
    SELECT 'node' AS kind, id, strftime(created_at, '%Y-%m-%d') AS day FROM v_nodes WHERE id IN (SELECT id FROM o_b)
    UNION ALL SELECT 'edge', seq::VARCHAR, '1996-02-02' FROM v_place_edges WHERE source IN (SELECT id FROM o_n) OR target IN (SELECT id FROM o_n) OR source = 'step:s7'""",
)
def _(get):
    t = ga.trajectory(get("v_nodes"), get("v_dated_edges"), "step:s7", 3)
    return t.select("kind", "id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


VIEWS["v_seeds"] = "SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'flow:n' || CAST(n_nationkey AS STRING) AS id FROM nation WHERE n_regionkey = 1"


@query(
    "sr7_graph_hits",
    """WITH o_b AS (SELECT source AS s, target AS t, weight AS w FROM v_place_edges UNION ALL SELECT target, source, weight FROM v_place_edges),
     o_1 AS (SELECT query_id, t AS id, sum(w) AS score FROM v_seeds JOIN o_b ON s = v_seeds.id GROUP BY 1, 2),
     o_1x AS (SELECT * FROM o_1 WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM v_seeds)),
     o_2 AS (SELECT query_id, t AS id, sum(w) / 2 AS score FROM o_1x JOIN o_b ON s = o_1x.id GROUP BY 1, 2)
    SELECT query_id, id, round(score, 4) AS score FROM o_1x
    UNION ALL SELECT query_id, id, round(score, 4) FROM o_2 WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM v_seeds) AND (query_id, id) NOT IN (SELECT (query_id, id) FROM o_1x)""",
)
def _(get):
    return ga.graph_hits(get("v_place_edges"), get("v_seeds")).select("query_id", "id", F.round("score", 4).alias("score"))


# The same over all edge types, node types and seeds. Recursive SQL is too slow for
# these, so tests hold them against brute force.
VIEWS["v_dated_all_edges"] = "SELECT source, target, type, seq, TIMESTAMP '1996-02-02 00:00:00' AS created_at FROM v_edges"
VIEWS["v_all_seeds"] = "SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'flow:n' || CAST(n_nationkey AS STRING) AS id FROM nation"


@query("gr1_neighbours_all_edges")
def _(get):
    return ga.neighbours(get("v_edges"), "step:s7", 2)


@query("gr2_shortest_path_all_edges")
def _(get):
    return ga.shortest_path(get("v_edges"), "step:s7", "file:shared/m1/p10.ts")


@query("gr5_topological_levels_all_edges")
def _(get):
    return ga.topological_levels(get("v_nodes"), get("v_edges")).select("id", F.coalesce("level", F.lit(-1)).alias("level"))


@query("wn13_trajectory_all_edges")
def _(get):
    t = ga.trajectory(get("v_nodes"), get("v_dated_all_edges"), "step:s7", 3)
    return t.select("kind", "id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("sr7_graph_hits_all_edges")
def _(get):
    return ga.graph_hits(get("v_edges"), get("v_all_seeds")).select("query_id", "id", F.round("score", 4).alias("score"))
