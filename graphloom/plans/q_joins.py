"""Queries: join-shaped operators (JN)."""

from pyspark.sql import functions as F

from graphloom.operators import joins
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query

VIEWS["v_dangling_members"] = """SELECT layer_id, layer_pos, CASE WHEN member_pos % 9 = 0 THEN node_id || '?' ELSE node_id END AS node_id
 FROM v_layer_members"""
VIEWS["v_batches"] = "SELECT path, CAST(seq % 40 AS BIGINT) AS batch_index FROM v_files"


@query("jn3_valid_members", "SELECT layer_id, node_id FROM v_dangling_members WHERE node_id IN (SELECT id FROM v_nodes)")
def _(get):
    return joins.valid_members(get("v_dangling_members"), get("v_nodes")).select("layer_id", "node_id")


@query("jn3_dropped_members", "SELECT layer_id, node_id FROM v_dangling_members WHERE node_id NOT IN (SELECT id FROM v_nodes)")
def _(get):
    return joins.dropped_members(get("v_dangling_members"), get("v_nodes")).select("layer_id", "node_id")


@query("jn4_first_layer", "SELECT node_id, arg_min(layer_id, (layer_pos, layer_id)) AS layer_id FROM v_layer_members GROUP BY 1")
def _(get):
    return joins.first_layer(get("v_layer_members"))


@query("jn4_all_layers", "SELECT DISTINCT node_id, layer_id FROM v_layer_members")
def _(get):
    return joins.all_layers(get("v_layer_members"))


O_JN5 = """o_e AS MATERIALIZED (SELECT source, target, type, seq FROM v_edges),
 o_seed AS MATERIALIZED (SELECT DISTINCT id FROM v_nodes WHERE summary LIKE '%red ring%'),
 o_ids AS MATERIALIZED (SELECT id FROM o_seed UNION SELECT target FROM o_e JOIN o_seed ON source = id
   UNION SELECT source FROM o_e JOIN o_seed ON target = id)"""


def _ctx(get):
    seeds = get("v_nodes").filter(F.col("summary").contains("red ring")).select("id")
    return joins.query_context(get("v_nodes"), get("v_edges"), get("v_layer_members"), seeds)


@query("jn5_context_nodes", f"WITH {O_JN5} SELECT id, type FROM v_nodes WHERE id IN (SELECT id FROM o_ids)")
def _(get):
    return _ctx(get)[0].select("id", "type")


@query(
    "jn5_context_edges",
    f"WITH {O_JN5} SELECT source, target, type, seq FROM o_e JOIN o_ids s ON source = s.id JOIN o_ids t ON target = t.id",
)
def _(get):
    return _ctx(get)[1].select("source", "target", "type", "seq")


@query("jn5_context_layers", f"WITH {O_JN5} SELECT DISTINCT layer_id FROM v_layer_members WHERE node_id IN (SELECT id FROM o_ids)")
def _(get):
    return _ctx(get)[2]


VIEWS["v_changed"] = """SELECT path FROM v_files WHERE language = 'sql' AND size_lines > 450
 UNION ALL SELECT 'new/' || n_name || '.ts' FROM nation"""
O_JN6 = """o_e AS MATERIALIZED (SELECT source, target, type, seq FROM v_edges),
 o_d AS MATERIALIZED (SELECT DISTINCT id FROM v_nodes WHERE file_path IN (SELECT path FROM v_changed)),
 o_ch AS MATERIALIZED (SELECT id FROM o_d UNION SELECT target FROM o_e JOIN o_d ON source = id WHERE type = 'contains'),
 o_imp AS MATERIALIZED (SELECT o_e.*, a.id IS NOT NULL AS s, b.id IS NOT NULL AS t FROM o_e LEFT JOIN o_ch a ON source = a.id LEFT JOIN o_ch b ON target = b.id),
 o_aff AS (SELECT target AS id FROM o_imp WHERE s AND NOT t UNION SELECT source FROM o_imp WHERE t AND NOT s),
 o_un AS (SELECT path FROM v_changed WHERE path NOT IN (SELECT file_path FROM v_nodes WHERE file_path IS NOT NULL)),
 o_ly AS (SELECT DISTINCT layer_id FROM v_layer_members WHERE node_id IN (SELECT id FROM o_ch UNION ALL SELECT id FROM o_aff))"""


def _impact(get):
    return joins.ChangeImpact(get("v_nodes"), get("v_edges"), get("v_layer_members"), get("v_changed"))


@query("jn6_changed_nodes", f"WITH {O_JN6} SELECT id, name FROM v_nodes WHERE id IN (SELECT id FROM o_ch)")
def _(get):
    return _impact(get).changed.select("id", "name")


@query("jn6_affected_nodes", f"WITH {O_JN6} SELECT id, name FROM v_nodes WHERE id IN (SELECT id FROM o_aff)")
def _(get):
    return _impact(get).affected.select("id", "name")


@query("jn6_impacted_edges", f"WITH {O_JN6} SELECT source, target, type, seq FROM o_imp WHERE s OR t")
def _(get):
    return _impact(get).impacted_edges.select("source", "target", "type", "seq")


@query("jn6_affected_layers", f"WITH {O_JN6} SELECT layer_id FROM o_ly")
def _(get):
    return _impact(get).layers


@query("jn6_unmapped_files", f"WITH {O_JN6} SELECT path FROM o_un")
def _(get):
    return _impact(get).unmapped


@query(
    "ga26_change_risk",
    f"""WITH {O_JN6}, o_c AS (SELECT
      (SELECT count(*) FROM v_nodes WHERE complexity = 'complex' AND id IN (SELECT id FROM o_ch)) AS complex_changed,
      (SELECT count(*) FROM o_ly) AS layers, (SELECT count(*) FROM v_nodes WHERE id IN (SELECT id FROM o_aff)) AS affected,
      (SELECT count(*) FROM o_un) AS unmapped)
    SELECT *, layers > 1 AS cross_layer, affected > 5 AS wide,
      complex_changed = 0 AND layers <= 1 AND affected <= 5 AND unmapped = 0 AS low_risk FROM o_c""",
)
def _(get):
    return _impact(get).risk()


VIEWS["v_targets"] = """SELECT path AS target FROM v_part WHERE p_size > 30
 UNION ALL SELECT path || ':' || c_name FROM customer JOIN v_part ON c_custkey = p_partkey
 UNION ALL SELECT n_name FROM nation"""


@query(
    "jn7_explain_targets",
    """WITH o_c AS (SELECT target, CASE WHEN contains(target, ':') THEN regexp_extract(target, '^(.+):([^:]*)$', 1) END AS p,
       regexp_extract(target, '^(.+):([^:]*)$', 2) AS nm FROM v_targets),
     o_h AS (SELECT target, n.id, 0 AS r, n.seq FROM o_c JOIN v_nodes n ON n.file_path = p AND n.name = nm
       UNION ALL SELECT target, n.id, 1, n.seq FROM o_c JOIN v_nodes n ON n.file_path = target)
     SELECT target, arg_min(id, (r, seq)) AS id FROM o_h GROUP BY 1""",
)
def _(get):
    return joins.explain_target(get("v_nodes"), get("v_targets").distinct())


@query(
    "jn8_connections",
    """SELECT n.id, n.name, e.type, e.seq, e.way, e.is_child FROM (
      SELECT target AS id, type, seq, 'out' AS way, type = 'contains' AS is_child FROM v_edges WHERE source = 'file:shared/m1/p10.ts'
      UNION ALL SELECT source, type, seq, 'in', false FROM v_edges WHERE target = 'file:shared/m1/p10.ts' AND source <> target) e
    JOIN v_nodes n ON n.id = e.id""",
)
def _(get):
    return joins.connections(get("v_edges"), get("v_nodes"), "file:shared/m1/p10.ts")


VIEWS["v_dotted"] = """SELECT DISTINCT lower(replace(p_brand, '#', '-')) || '.p' || CAST(p_partkey AS STRING) AS name FROM part
 UNION ALL SELECT DISTINCT 'p' || CAST(c_custkey AS STRING) FROM customer"""


@query(
    "jn10_suffix_matches",
    """WITH o_f AS (SELECT path, regexp_replace(path, '[.][^./]*$', '') AS bare FROM v_files),
     o_s AS (SELECT path, bare AS sfx FROM o_f UNION ALL SELECT path, substr(bare, strpos(bare,'/')+1) FROM o_f
       UNION ALL SELECT path, split_part(bare,'/',-1) FROM o_f)
     SELECT DISTINCT name, path FROM v_dotted JOIN o_s ON replace(name, '.', '/') = sfx""",
)
def _(get):
    return joins.suffix_matches(get("v_dotted"), get("v_files"))


@query(
    "jn11_nearest_ancestor",
    """WITH o_dirs AS (SELECT '' AS dir UNION SELECT lower(p_type) FROM part WHERE p_size > 25 UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM v_files WHERE size_lines > 300),
     o_a AS (SELECT path, '' AS dir, 0 AS d FROM v_files UNION ALL SELECT path, split_part(path,'/',1), 1 FROM v_files
       UNION ALL SELECT path, regexp_replace(path, '/[^/]*$', ''), 2 FROM v_files)
     SELECT path, arg_max(a.dir, d) AS dir FROM o_a a JOIN o_dirs USING (dir) GROUP BY path""",
)
def _(get):
    files = get("v_files")
    dirs = (
        files.filter("size_lines > 300").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
        .union(get("part").filter("p_size > 25").select(F.lower("p_type")))
        .union(files.sparkSession.range(1).select(F.lit("")))
    )
    return joins.nearest_ancestor(files, dirs)


VIEWS["v_links"] = """SELECT seq AS link_id, path AS source,
 CASE seq % 5 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '^.*/', '') WHEN 2 THEN upper(regexp_replace(path, '^[^/]*/', ''))
   WHEN 3 THEN 'no/such' ELSE 'P' || CAST(seq - 4 AS STRING) || '.TS' END AS link FROM v_files
 UNION ALL SELECT 1000000000 + a.seq, 'index.md', b.pbrand FROM v_files a JOIN v_part b ON a.seq = b.p_partkey"""


@query(
    "jn12_resolve_links",
    """WITH o_k AS (SELECT path, lower(path) AS key FROM v_files),
     o_n AS (SELECT key, path AS target, 0 AS r FROM o_k
       UNION ALL SELECT split_part(key,'/',-1), min(path), 1 FROM o_k GROUP BY 1 HAVING count(*) = 1
       UNION ALL SELECT key, path, 2 FROM o_k UNION ALL SELECT substr(key, strpos(key,'/')+1), path, 2 FROM o_k
       UNION ALL SELECT split_part(key,'/',-1), path, 2 FROM o_k),
     o_b AS (SELECT key, arg_min(target, (r, target)) AS target FROM o_n GROUP BY 1)
     SELECT link_id, source, link, target, CASE WHEN target IS NULL THEN 'missing' WHEN target = source THEN 'self' ELSE 'resolved' END AS status
     FROM v_links LEFT JOIN o_b ON lower(link) = key""",
)
def _(get):
    return joins.resolve_links(get("v_links"), get("v_files").select("path"))


@query(
    "jn15_cross_batch_neighbours",
    """WITH o_b AS (SELECT src_path AS path, tgt_path AS nbr_path FROM v_imports UNION SELECT tgt_path, src_path FROM v_imports),
     o_d AS (SELECT path, count(*) AS degree FROM (SELECT src_path AS path FROM v_imports WHERE src_path <> tgt_path UNION ALL SELECT tgt_path FROM v_imports WHERE src_path <> tgt_path) GROUP BY 1),
     o_r AS (SELECT b.path, b.nbr_path, y.batch_index AS nbr_batch, d.degree AS nbr_degree,
       row_number() OVER (PARTITION BY b.path ORDER BY d.degree DESC, b.nbr_path) AS rn
       FROM o_b b JOIN v_batches x ON x.path = b.path JOIN v_batches y ON y.path = b.nbr_path JOIN o_d d ON d.path = b.nbr_path
       WHERE x.batch_index <> y.batch_index)
     SELECT path, nbr_path, nbr_batch, nbr_degree FROM o_r WHERE rn <= 50""",
)
def _(get):
    return joins.cross_batch_neighbours(get("v_imports"), get("v_batches"))


@query(
    "jn16_similar_sessions",
    """SELECT id FROM v_sessions WHERE id <> '7' AND list_has_any(tags, (SELECT tags FROM v_sessions WHERE id = '7'))""",
)
def _(get):
    return joins.similar_sessions(get("v_sessions"), "7")


@query(
    "jn17_cross_layer_files",
    """SELECT DISTINCT source AS id FROM v_edges WHERE source IN (SELECT node_id FROM v_layer_members WHERE layer_id = 'layer:promo')
     AND target IN (SELECT node_id FROM v_layer_members WHERE layer_id = 'layer:small') AND source IN (SELECT id FROM v_nodes WHERE type = 'file')""",
)
def _(get):
    return joins.cross_layer_files(get("v_nodes"), get("v_edges"), get("v_layer_members"), "layer:promo", "layer:small")


VIEWS["v_insights"] = """SELECT 'skill' || CAST(p_size AS STRING) AS skill, p_name AS keyword,
 CAST(p_partkey % 10 AS DOUBLE) / 10 AS weight FROM part"""
VIEWS["v_keywords"] = "SELECT DISTINCT p_name AS keyword FROM part WHERE p_name LIKE 'red%' OR p_name LIKE 'small%'"
_O18 = """o_h AS (SELECT skill, keyword, weight FROM v_insights WHERE weight >= 0.5 AND keyword IN (SELECT keyword FROM v_keywords)),
 o_r AS (SELECT skill, sum(weight) AS score FROM o_h GROUP BY 1 ORDER BY round(sum(weight), 6) DESC, skill LIMIT 10)"""


@query("jn18_route_keywords", f"WITH {_O18} SELECT skill, round(score, 4) AS score FROM o_r")
def _(get):
    weights = get("v_insights").withColumn("weight", F.col("weight").cast("decimal(18,6)"))
    ranked, _ = joins.route_keywords(weights, get("v_keywords"), 0.5)
    return ranked.select("skill", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("jn18_matched_keywords", f"WITH {_O18} SELECT DISTINCT skill, keyword FROM o_h WHERE skill IN (SELECT skill FROM o_r)")
def _(get):
    weights = get("v_insights").withColumn("weight", F.col("weight").cast("decimal(18,6)"))
    return joins.route_keywords(weights, get("v_keywords"), 0.5)[1]


@query(
    "jn19_batches_with_changes",
    "SELECT path, batch_index FROM v_batches WHERE batch_index IN (SELECT batch_index FROM v_batches WHERE path IN (SELECT path FROM v_changed))",
)
def _(get):
    return joins.batches_with_changes(get("v_batches"), get("v_changed"))
