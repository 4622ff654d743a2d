"""Queries: filtered views (FP)."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import views
from graphloom.plans.registry import query

_TYPES = ["file", "document", "function"]
_CATS = ["structural", "dependencies"]
O_FP1 = """o_vis AS (SELECT * FROM v_nodes WHERE type IN ('file','document','function') AND complexity IN ('simple','complex')
  AND id IN (SELECT node_id FROM v_layer_members WHERE layer_id IN ('layer:promo','layer:brand-3','layer:building')))"""


def _visible(get):
    return views.filter_nodes(
        get("v_nodes"), get("v_layer_members"), _TYPES, ["simple", "complex"],
        ["layer:promo", "layer:brand-3", "layer:building"],
    )


@query("fp1_filter_nodes", f"WITH {O_FP1} SELECT id, type, complexity FROM o_vis")
def _(get):
    return _visible(get).select("id", "type", "complexity")


@query(
    "fp2_filter_edges",
    f"""WITH {O_FP1} SELECT source, target, type, seq FROM v_edges
    WHERE type IN ('imports','exports','contains','inherits','implements','depends_on','tested_by','configures')
    AND source IN (SELECT id FROM o_vis) AND target IN (SELECT id FROM o_vis)""",
)
def _(get):
    return views.filter_edges(get("v_edges"), _visible(get).select("id"), _CATS).select("source", "target", "type", "seq")


O_FP3 = """o_e AS MATERIALIZED (SELECT source, target, type, seq FROM v_edges),
 o_m AS MATERIALIZED (SELECT DISTINCT node_id AS id FROM v_layer_members WHERE layer_id = 'layer:promo'),
 o_in AS MATERIALIZED (SELECT DISTINCT target AS id FROM o_e JOIN o_m ON source = o_m.id WHERE type = 'contains'),
 o_s AS MATERIALIZED (SELECT id, type, name FROM v_nodes WHERE id IN (SELECT id FROM o_m) OR (type IN ('class','function') AND id IN (SELECT id FROM o_in)))"""


@query("fp3_layer_detail_nodes", f"WITH {O_FP3} SELECT id, type, name FROM o_s")
def _(get):
    n, _ = views.layer_detail(get("v_nodes"), get("v_edges"), get("v_layer_members"), "layer:promo")
    return n.select("id", "type", "name")


@query(
    "fp3_layer_detail_edges",
    f"""WITH {O_FP3}, o_i AS MATERIALIZED (SELECT DISTINCT id FROM o_s)
    SELECT source, target, type, seq FROM o_e JOIN o_i s ON source = s.id JOIN o_i t ON target = t.id""",
)
def _(get):
    _, e = views.layer_detail(get("v_nodes"), get("v_edges"), get("v_layer_members"), "layer:promo")
    return e.select("source", "target", "type", "seq")


@query(
    "fp4_list_memory_scope",
    "SELECT id, scope, confidence FROM v_memory WHERE scope = 'src1' AND lifecycle IN ('active','stale') AND confidence >= 0.3",
)
def _(get):
    return views.list_memory(get("v_memory"), "src1", ["en"], ["active", "stale"], 0.3).select("id", "scope", "confidence")


@query(
    "fp4_list_memory_tags",
    "SELECT id, scope FROM v_memory WHERE list_contains(tags, 'en') AND list_contains(tags, 'short') AND confidence >= 0.2",
)
def _(get):
    return views.list_memory(get("v_memory"), None, ["en", "short"], None, 0.2).select("id", "scope")


@query("fp5_audit_for_entity", "SELECT seq, op, field FROM v_audit WHERE id = '8'")
def _(get):
    return views.audit_for_entity(get("v_audit"), "8").select("seq", "op", "field")


@query("fp5_audit_for_op", "SELECT seq, id FROM v_audit WHERE op = 'create'")
def _(get):
    return views.audit_for_op(get("v_audit"), "create").select("seq", "id")


@query("fp5_audit_recent", "SELECT seq, op, id FROM v_audit ORDER BY seq DESC LIMIT 50")
def _(get):
    return views.audit_recent(get("v_audit"), 50).select("seq", "op", "id")


@query("fp6_sessions_by_tag", "SELECT id, title FROM v_sessions WHERE list_contains(tags, 'long')")
def _(get):
    return views.sessions_by_tag(get("v_sessions"), "long").select("id", "title")


@query("fp6_sessions_by_outcome", "SELECT id, outcome FROM v_sessions WHERE outcome = 'partial'")
def _(get):
    return views.sessions_by_outcome(get("v_sessions"), "partial").select("id", "outcome")


@query("fp6_skills_by_trigger", "SELECT p_partkey AS id FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def _(get):
    skills = get("part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type").alias("triggers"))
    return views.skills_by_trigger(skills, "RING").select("id")


@query(
    "fp7_nodes_in_range",
    """SELECT id, strftime(created_at, '%Y-%m-%d') AS day FROM v_nodes
    WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-06-30'""",
)
def _(get):
    r = views.in_time_range(get("v_nodes"), dt.datetime(1995, 1, 1), dt.datetime(1997, 6, 30))
    return r.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


O_FP8 = """o_v AS (SELECT id, unnest([CASE WHEN NOT coalesce(length(content) >= 50, false) THEN {p: 0, r: 'min-length', s: 'warn'} END,
   CASE WHEN NOT coalesce(confidence >= 0.1, false) THEN {p: 1, r: 'confidence', s: 'block'} END,
   CASE WHEN NOT coalesce(lifecycle <> 'evicted', false) THEN {p: 2, r: 'live', s: 'block'} END]) AS v FROM v_memory)"""


def _rules():
    return [
        ("min-length", "warn", F.length("content") >= 50),
        ("confidence", "block", F.col("confidence") >= 0.1),
        ("live", "block", F.col("lifecycle") != "evicted"),
    ]


@query("fp8_rule_violations", f"WITH {O_FP8} SELECT id, v.r AS rule_id, v.s AS severity FROM o_v WHERE v IS NOT NULL")
def _(get):
    return views.rule_violations(get("v_memory"), _rules()).select("id", "rule_id", "severity")


@query("fp8_first_blocker", f"WITH {O_FP8} SELECT id, arg_min(v.r, v.p) AS rule_id FROM o_v WHERE v.s = 'block' GROUP BY id")
def _(get):
    return views.first_blocker(views.rule_violations(get("v_memory"), _rules()))


O_FP9 = """o_i AS (SELECT 'step:s7' AS id UNION SELECT target FROM v_edges WHERE source = 'step:s7'
  UNION SELECT source FROM v_edges WHERE target = 'step:s7')"""


@query("fp9_focus_nodes", f"WITH {O_FP9} SELECT id, type FROM v_nodes WHERE id IN (SELECT id FROM o_i)")
def _(get):
    n, _ = views.focus(get("v_nodes"), get("v_edges"), "step:s7")
    return n.select("id", "type")


@query(
    "fp9_focus_edges",
    f"""WITH {O_FP9} SELECT source, target, type, seq FROM v_edges WHERE source IN (SELECT id FROM o_i) AND target IN (SELECT id FROM o_i)""",
)
def _(get):
    _, e = views.focus(get("v_nodes"), get("v_edges"), "step:s7")
    return e.select("source", "target", "type", "seq")


@query(
    "fp10_domain_steps",
    """SELECT f.target AS flow_id, s.target AS step_id, n.name AS step_name, s.weight AS step_order
    FROM v_edges f JOIN v_edges s ON s.source = f.target AND s.type = 'flow_step' JOIN v_nodes n ON n.id = s.target
    WHERE f.type = 'contains_flow' AND f.source = 'domain:r1'""",
)
def _(get):
    return views.domain_steps(get("v_nodes"), get("v_edges"), "domain:r1")


@query(
    "fp11_ignore_rules",
    """SELECT ignored, ignored_by_default, count(*) AS n FROM (SELECT
      CASE WHEN regexp_matches(path, '/p[0-9]*5[.]ts$') THEN false WHEN path LIKE 'shared/%' THEN true
           WHEN path LIKE '%.md' THEN true ELSE false END AS ignored,
      CASE WHEN path LIKE '%.md' THEN true ELSE false END AS ignored_by_default FROM v_files) GROUP BY ALL""",
)
def _(get):
    rules = [(r"\.md$", False, False), (r"^shared/", False, True), (r"/p[0-9]*5\.ts$", True, True)]
    return views.ignore_filter(get("v_files"), rules).groupBy("ignored", "ignored_by_default").agg(
        F.count("*").alias("n")
    )


@query(
    "fp11_ignore_globs",
    """WITH o_p AS (SELECT path, seq, string_split(path, '/') AS w FROM v_files),
    o_all AS (SELECT path, seq, p FROM (SELECT path, seq, unnest(list_append(list_transform(range(1, len(w)), lambda k: array_to_string(w[1:k], '/') || '/'), path)) AS p FROM o_p)),
    o_v AS (SELECT path, seq, CASE
      WHEN regexp_matches(p, '^promo/([^/]*/)*brand-1[0-4]/$') THEN true
      WHEN regexp_matches(p, '(^|/)p[0-9]*7[.]md$') THEN false
      WHEN regexp_matches(p, '[.]md$') THEN true
      WHEN regexp_matches(p, '^shared/m1[^0-9/]?/$') THEN false
      WHEN regexp_matches(p, '^shared/m[0-9]/$') OR regexp_matches(p, '^large/[^/]*/p[^/]?[.]ts$') THEN true
      ELSE false END AS hit FROM o_all)
    SELECT path, seq, bool_or(hit) AS ignored FROM o_v GROUP BY ALL""",
)
def _(get):
    rules = ["# generated", "", "/shared/m[0-9]/", "large/*/p?.ts", "!shared/m1/", "*.md  ", "!p*7.md", "promo/**/brand-1[!5-9]/"]
    return views.ignore_globs(get("v_files"), rules).select("path", "seq", "ignored")


@query(
    "fp12_export_edges",
    """WITH o_vis AS (SELECT id FROM v_nodes WHERE type IN ('file','document','step') AND complexity IN ('simple','moderate','complex'))
    SELECT source, target, type, seq FROM v_edges WHERE type IN ('imports','contains','serves','documents')
    AND source IN (SELECT id FROM o_vis) AND target IN (SELECT id FROM o_vis)""",
)
def _(get):
    _, e = views.export_view(
        get("v_nodes"), get("v_edges"), get("v_layer_members"), ["file", "document", "function", "step"],
        ["simple", "moderate", "complex"], [], ["structural", "infrastructure"], technical=False,
    )
    return e.select("source", "target", "type", "seq")


def _features(get):
    return get("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.array("p_brand", F.lower("p_type")).alias("tags"),
    )


@query("fp13_features_by_tag", "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#7' OR lower(p_type) = 'Brand#7'")
def _(get):
    return views.features_by_tag(_features(get), "Brand#7").select("id")


@query(
    "fp13_search_features",
    "SELECT p_partkey AS id FROM part WHERE lower(p_name || '|' || p_type || '|' || p_brand) LIKE '%#1%' OR lower(p_name) LIKE '%#1%'",
)
def _(get):
    return views.search_features(_features(get), "#1").select("id")
