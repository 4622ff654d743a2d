"""Queries: aggregations and top-k reports (GA, TK)."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import stats
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query


@query(
    "ga1_file_stats",
    """SELECT 'category' AS dimension, file_category AS value, count(*) AS n, sum(size_lines)::BIGINT AS lines FROM v_files GROUP BY 2
    UNION ALL SELECT 'language', language, count(*), sum(size_lines)::BIGINT FROM v_files GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*), sum(size_lines)::BIGINT FROM v_files""",
)
def _(get):
    return stats.file_stats(get("v_files"))


_CAT = """CASE WHEN type IN ('file','function','class','module','concept') THEN 'code' WHEN type = 'config' THEN 'config'
 WHEN type = 'document' THEN 'docs' WHEN type IN ('service','resource','pipeline') THEN 'infra'
 WHEN type IN ('table','endpoint','schema') THEN 'data' WHEN type IN ('domain','flow','step') THEN 'domain'
 WHEN type IN ('article','entity','topic','claim','source') THEN 'knowledge' ELSE 'code' END"""


@query(
    "ga2_graph_overview",
    f"""SELECT 'type' AS facet, type AS value, count(*) AS n FROM v_nodes GROUP BY 2
    UNION ALL SELECT 'complexity', complexity, count(*) FROM v_nodes GROUP BY 2
    UNION ALL SELECT 'category', {_CAT}, count(*) FROM v_nodes GROUP BY 2""",
)
def _(get):
    return stats.graph_overview(get("v_nodes"))


@query(
    "ga2_average_degree",
    """SELECT n AS nodes, e AS edges, round(2.0::DOUBLE * e / n, 1) AS avg_degree FROM
    (SELECT count(*) AS n FROM v_nodes), (SELECT count(*) AS e FROM v_edges)""",
)
def _(get):
    return stats.average_degree(get("v_nodes"), get("v_edges"))


O_DEG = """o_deg AS (SELECT id, coalesce(d.n, 0) AS degree, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM v_nodes
  LEFT JOIN (SELECT e AS id, count(*) AS n FROM (SELECT source AS e FROM v_edges UNION ALL SELECT target FROM v_edges) GROUP BY 1) d USING (id)
  LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS n FROM v_edges WHERE source <> target GROUP BY 1) i USING (id)
  LEFT JOIN (SELECT source AS id, count(DISTINCT target) AS n FROM v_edges WHERE source <> target GROUP BY 1) o USING (id))"""


@query("ga3_degrees", f"WITH {O_DEG} SELECT * FROM o_deg")
def _(get):
    return stats.degrees(get("v_nodes"), get("v_edges"))


for _measure, _k in (("degree", 5), ("fan_in", 20), ("fan_out", 20)):

    @query(f"tk1_top_{_measure}", f"WITH {O_DEG} SELECT id, {_measure} FROM o_deg ORDER BY {_measure} DESC, id LIMIT {_k}")
    def _(get, measure=_measure, k=_k):
        return stats.top_by(stats.degrees(get("v_nodes"), get("v_edges")), measure, k).select("id", measure)


@query(
    "ga4_layer_stats",
    """SELECT layer_id, count(complexity) AS n, CASE WHEN count(complexity) = 0 THEN 'simple'
      WHEN count(*) FILTER (complexity = 'complex') > 0.3 * count(complexity) THEN 'complex'
      WHEN count(*) FILTER (complexity = 'moderate') > 0.3 * count(complexity) THEN 'moderate' ELSE 'simple' END AS label
    FROM v_layer_members LEFT JOIN v_nodes ON id = node_id GROUP BY 1""",
)
def _(get):
    return stats.layer_stats(get("v_layer_members"), get("v_nodes"))


O_HOME = "o_home AS (SELECT node_id AS id, arg_min(layer_id, (layer_pos, layer_id)) AS c FROM v_layer_members GROUP BY 1)"
O_BETWEEN = f"""{O_HOME}, o_btw AS (SELECT s.c AS source_container, t.c AS target_container, count(*) AS n,
  string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM v_edges e JOIN o_home s ON s.id = e.source JOIN o_home t ON t.id = e.target
  WHERE s.c <> t.c GROUP BY 1, 2)"""
O_FOLDER = "o_fold AS (SELECT 'file:' || path AS id, split_part(path, '/', 1) AS c FROM v_files)"


@query(
    "ga5_container_edges_between",
    f"""WITH {O_FOLDER} SELECT s.c AS source_container, t.c AS target_container, count(*) AS n,
    string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM v_edges e JOIN o_fold s ON s.id = e.source
    JOIN o_fold t ON t.id = e.target WHERE s.c <> t.c GROUP BY 1, 2""",
)
def _(get):
    return stats.container_edges(get("v_edges"), _folders(get))[1]


def _folders(get):
    return get("v_files").select(
        F.concat(F.lit("file:"), "path").alias("id"), F.split_part("path", F.lit("/"), F.lit(1)).alias("container")
    )


@query(
    "ga5_container_edges_inside",
    f"""WITH {O_FOLDER} SELECT e.source, e.target, e.type, e.seq FROM v_edges e JOIN o_fold s ON s.id = e.source
    JOIN o_fold t ON t.id = e.target WHERE s.c = t.c""",
)
def _(get):
    return stats.container_edges(get("v_edges"), _folders(get))[0].select("source", "target", "type", "seq")


@query("ga6_layer_edges", f"WITH {O_BETWEEN} SELECT * FROM o_btw")
def _(get):
    return stats.layer_edges(get("v_edges"), get("v_layer_members"))


@query(
    "ga7_portals",
    f"""WITH {O_BETWEEN} SELECT CASE WHEN source_container = 'layer:promo' THEN target_container ELSE source_container END AS layer_id,
    sum(n)::BIGINT AS connections FROM o_btw WHERE 'layer:promo' IN (source_container, target_container) GROUP BY 1""",
)
def _(get):
    return stats.portals(get("v_edges"), get("v_layer_members"), "layer:promo")


@query(
    "ga8_hits_per_layer",
    f"WITH {O_HOME} SELECT c AS layer_id, count(*) AS hits FROM v_nodes JOIN o_home USING (id) WHERE summary LIKE '%ring%' GROUP BY 1",
)
def _(get):
    return stats.hits_per_layer(get("v_nodes").filter(F.col("summary").contains("ring")).select("id"), get("v_layer_members"))


VIEWS["v_rooted"] = "SELECT 'pkg/main/' || path AS file_path, seq FROM v_files"


@query(
    "ga9_folder_groups",
    """SELECT split_part(file_path, '/', 3) AS folder, count(*) AS n FROM v_rooted GROUP BY 1""",
)
def _(get):
    return stats.with_folder_group(get("v_rooted")).groupBy("folder").agg(F.count("*").alias("n"))


O_MAT = """o_m AS (SELECT split_part(src_path,'/',1) AS src_group, split_part(tgt_path,'/',1) AS tgt_group, count(*) AS n
  FROM v_imports GROUP BY 1, 2)"""


def _matrix(get):
    homes = stats.with_folder_group(get("v_files"), "path").select("path", "folder")
    return stats.group_imports(get("v_imports"), homes)


@query("ga10_import_matrix", f"WITH {O_MAT} SELECT * FROM o_m")
def _(get):
    return _matrix(get)


@query(
    "ga10_import_density",
    f"""WITH {O_MAT}, o_s AS (SELECT src_group AS folder, n, CASE WHEN src_group = tgt_group THEN n ELSE 0 END AS i FROM o_m
      UNION ALL SELECT tgt_group, n, 0 FROM o_m WHERE src_group <> tgt_group)
    SELECT folder, sum(i)::BIGINT AS internal, sum(n)::BIGINT AS total, round(sum(i)::DOUBLE / sum(n), 4) AS density FROM o_s GROUP BY 1""",
)
def _(get):
    return stats.group_density(_matrix(get)).withColumn("density", F.round("density", 4))


@query(
    "ga10_dominant_directions",
    f"""WITH {O_MAT} SELECT a.src_group AS dependent, a.tgt_group AS dependency, a.n FROM o_m a LEFT JOIN o_m b
    ON a.src_group = b.tgt_group AND a.tgt_group = b.src_group WHERE a.src_group <> a.tgt_group AND a.n > coalesce(b.n, 0)""",
)
def _(get):
    return stats.dominant_directions(_matrix(get))


@query(
    "ga11_category_matrix",
    """SELECT s.type AS source_type, t.type AS target_type, e.type AS edge_type, count(*) AS n FROM v_edges e
    JOIN v_nodes s ON s.id = e.source JOIN v_nodes t ON t.id = e.target GROUP BY ALL""",
)
def _(get):
    return stats.category_matrix(get("v_nodes"), get("v_edges"))


_GROUP = "regexp_replace(path, '/[^/]*$', '')"


@query("ga12_doc_coverage", f"SELECT {_GROUP} AS folder, bool_or(path LIKE '%.md') AS documented FROM v_files GROUP BY 1")
def _(get):
    return stats.doc_coverage(get("v_files").withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")))


@query(
    "ga12_coverage_ratio",
    f"""SELECT count(*) FILTER (d) AS with_docs, count(*) AS groups, round(count(*) FILTER (d)::DOUBLE / count(*), 2) AS ratio
    FROM (SELECT {_GROUP} AS folder, bool_or(path LIKE '%.md') AS d FROM v_files GROUP BY 1)""",
)
def _(get):
    return stats.coverage_ratio(
        stats.doc_coverage(get("v_files").withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")))
    )


VIEWS["v_infra_files"] = """SELECT CASE p_partkey % 9 WHEN 0 THEN 'svc' || CAST(p_partkey AS STRING) || '/Dockerfile.dev'
  WHEN 1 THEN 'ops/docker-compose' || CAST(p_size AS STRING) || '.yml' WHEN 2 THEN 'deploy/k8s/a' || CAST(p_partkey AS STRING) || '.yaml'
  WHEN 3 THEN 'db/migrations/' || CAST(p_partkey AS STRING) || '.sql' WHEN 4 THEN 'src/models/m' || CAST(p_partkey AS STRING) || '.ts'
  WHEN 5 THEN 'src/routes/r' || CAST(p_partkey AS STRING) || '.ts' ELSE path END AS path FROM v_part"""


@query(
    "ga13_inventory",
    """WITH o_k AS (SELECT path, unnest([CASE WHEN path LIKE '%/Dockerfile%' THEN 'dockerfile' END, CASE WHEN path LIKE '%docker-compose%.yml' THEN 'compose' END,
      CASE WHEN path LIKE '%/k8s/%' THEN 'k8s' END, CASE WHEN path LIKE '%.sql' THEN 'schema' END, CASE WHEN path LIKE '%/migrations/%' THEN 'migration' END,
      CASE WHEN path LIKE '%/models/%' THEN 'data_model' END, CASE WHEN path LIKE '%/routes/%' THEN 'api_handler' END]) AS kind FROM v_infra_files)
    SELECT path, kind FROM o_k WHERE kind IS NOT NULL""",
)
def _(get):
    return stats.inventory(get("v_infra_files"))


@query(
    "ga13_inventory_flags",
    """SELECT bool_or(path LIKE '%/Dockerfile%') AS has_dockerfile, bool_or(path LIKE '%docker-compose%.yml') AS has_compose,
    bool_or(path LIKE '%/k8s/%') AS has_k8s, bool_or(path LIKE '%.tf') AS has_terraform, bool_or(path LIKE '%Jenkinsfile') AS has_ci,
    bool_or(path LIKE '%.sql') AS has_schema, bool_or(path LIKE '%/migrations/%') AS has_migration,
    bool_or(path LIKE '%/models/%') AS has_data_model, bool_or(path LIKE '%/routes/%') AS has_api_handler FROM v_infra_files""",
)
def _(get):
    return stats.inventory_flags(get("v_infra_files"))


VIEWS["v_timed_edges"] = "SELECT CAST(l_shipdate AS TIMESTAMP) AS created_at FROM lineitem"


@query(
    "ga18_temporal_counts",
    """SELECT 'nodes' AS kind, count(*) FILTER (created_at < TIMESTAMP '1997-01-01') AS before,
      count(*) FILTER (created_at > TIMESTAMP '1997-01-01') AS after FROM v_nodes
    UNION ALL SELECT 'edges', count(*) FILTER (created_at < TIMESTAMP '1997-01-01'), count(*) FILTER (created_at > TIMESTAMP '1997-01-01') FROM v_timed_edges""",
)
def _(get):
    return stats.temporal_counts(get("v_nodes"), get("v_timed_edges"), dt.datetime(1997, 1, 1))


@query(
    "ga19_domain_overview",
    """SELECT id, type, (SELECT count(*) FROM v_edges e WHERE e.source = n.id AND e.type = 'contains_flow') AS n FROM v_nodes n WHERE type = 'domain'
    UNION ALL SELECT id, type, (SELECT count(*) FROM v_edges e WHERE e.source = n.id AND e.type = 'flow_step') FROM v_nodes n WHERE type = 'flow'""",
)
def _(get):
    return stats.domain_overview(get("v_nodes"), get("v_edges"))


@query(
    "ga21_folder_tree",
    """WITH o_p AS (SELECT DISTINCT file_path AS p FROM v_nodes WHERE file_path IS NOT NULL)
    SELECT folder, count(*) AS files FROM (SELECT split_part(p,'/',1) AS folder FROM o_p
      UNION ALL SELECT regexp_replace(p, '/[^/]*$', '') FROM o_p) GROUP BY 1""",
)
def _(get):
    return stats.folder_tree(get("v_nodes"))


@query(
    "ga21_file_entries",
    """SELECT file_path AS path, arg_min(id, (CASE WHEN type = 'file' THEN 0 ELSE 1 END, seq)) AS id FROM v_nodes
    WHERE file_path IS NOT NULL GROUP BY 1""",
)
def _(get):
    return stats.file_entries(get("v_nodes"))


O_TK2 = """o_f AS (SELECT path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM v_files
   LEFT JOIN (SELECT tgt_path AS path, count(*) AS n FROM v_imports GROUP BY 1) i USING (path)
   LEFT JOIN (SELECT src_path AS path, count(*) AS n FROM v_imports GROUP BY 1) o USING (path)),
 o_r AS (SELECT *, percent_rank() OVER (ORDER BY fan_out) AS a, percent_rank() OVER (ORDER BY fan_in) AS b FROM o_f)"""


def _fan(get):
    i = get("v_imports")
    fin = i.groupBy(F.col("tgt_path").alias("path")).agg(F.count("*").alias("fan_in"))
    fout = i.groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("fan_out"))
    return fin.join(fout, "path", "full")


@query(
    "tk2_entry_candidates",
    f"""WITH {O_TK2} SELECT path, CASE WHEN path LIKE '%.md' THEN 0 ELSE CASE WHEN a >= 0.9 THEN 1 ELSE 0 END
      + CASE WHEN b <= 0.25 THEN 1 ELSE 0 END END AS score FROM o_r ORDER BY score DESC, path LIMIT 5""",
)
def _(get):
    return stats.top_by(stats.entry_candidates(get("v_files"), _fan(get)), "score", 5, "path")


@query(
    "tk4_priority_files",
    """SELECT path, (path LIKE '%promo%')::INT + (path LIKE '%brand-1%')::INT + (path LIKE '%test%')::INT AS score FROM v_files
    ORDER BY score DESC, path LIMIT 40""",
)
def _(get):
    return stats.priority_files(get("v_files"), ["promo", "brand-1", "test"])


@query("ga27_onboarding_layers", "SELECT layer_id, count(*) AS members FROM v_layer_members GROUP BY 1")
def _(get):
    return stats.onboarding(get("v_nodes"), get("v_layer_members"))["layers"]


@query("ga27_onboarding_hotspots", "SELECT id, name, summary FROM v_nodes WHERE complexity = 'complex'")
def _(get):
    return stats.onboarding(get("v_nodes"), get("v_layer_members"))["hotspots"]


@query("ga27_onboarding_file_map", "SELECT file_path, summary, complexity FROM v_nodes WHERE type = 'file' AND file_path IS NOT NULL")
def _(get):
    return stats.onboarding(get("v_nodes"), get("v_layer_members"))["file_map"]


O_GA17 = """o_c AS (SELECT (SELECT count(*) FROM region) AS rules, (SELECT count(*) FROM nation) AS insights,
  (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS facts, (SELECT count(*) FROM part WHERE p_size = 50) AS skills,
  (SELECT count(*) FROM v_sessions) AS sessions, (SELECT count(*) FROM region WHERE r_regionkey > 1) AS lessons,
  (SELECT count(*) FROM v_audit) AS audit_entries)"""


def _tables(get):
    return stats.counted({
        "rules": get("region"), "insights": get("nation"), "facts": get("supplier").filter("s_acctbal < 0"),
        "skills": get("part").filter("p_size = 50"), "sessions": get("v_sessions"),
        "lessons": get("region").filter("r_regionkey > 1"), "audit_entries": get("v_audit"),
    })


@query(
    "ga17_health",
    f"""WITH {O_GA17} SELECT round(0.2 * (rules > 0)::INT + 0.1 * CASE WHEN skills = 0 THEN 0 ELSE least(1, insights / (skills * 3)) END
     + 0.25 * least(1, facts / 10) + 0.25 * least(1, skills / 5) + 0.1 * least(1, sessions / 5)
     + 0.1 * least(1, lessons / sessions), 6)::DOUBLE AS mastery FROM o_c""",
)
def _(get):
    return stats.health(_tables(get)).select(F.round("mastery", 6).alias("mastery"))


@query(
    "ga17_advice",
    f"""WITH {O_GA17} SELECT unnest(list_filter([CASE WHEN rules = 0 THEN 'define-rules' END, CASE WHEN skills > 0 AND insights < skills THEN 'add-insights' END,
     CASE WHEN facts < 5 THEN 'capture-facts' END, CASE WHEN skills < 3 THEN 'crystallize-skills' END, CASE WHEN sessions < 3 THEN 'archive-sessions' END,
     CASE WHEN lessons = 0 AND sessions >= 3 THEN 'distill-lessons' END, CASE WHEN audit_entries = 0 THEN 'enable-audit' END], lambda x: x IS NOT NULL)) AS advice FROM o_c""",
)
def _(get):
    return stats.health_advice(_tables(get))
