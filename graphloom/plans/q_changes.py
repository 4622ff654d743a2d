"""Queries: change detection and knowledge-base layers (FN9, ST6, GA25, ST8, JN13)."""

from pyspark.sql import functions as F

from graphloom.operators import changes, knowledge
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query

# Old and new state of the documents; a signature is the first word of a line.
_OLD = "CASE doc_id % 10 WHEN 1 THEN text || ' tail' ELSE text END"
_NEW = "CASE doc_id % 10 WHEN 1 THEN text || ' other tail' WHEN 3 THEN text || chr(10) || 'Extra line' ELSE text END"
VIEWS["v_old_files"] = f"SELECT 'docs/' || source || '/d' || CAST(doc_id AS STRING) AS path, {_OLD} AS content FROM documents WHERE doc_id % 10 <> 2"
VIEWS["v_new_files"] = f"SELECT 'docs/' || source || '/d' || CAST(doc_id AS STRING) AS path, {_NEW} AS content FROM documents WHERE doc_id % 10 <> 0"
O_SIG = """o_os AS (SELECT DISTINCT path, regexp_extract(unnest(string_split(content, chr(10))), '^(\\S+)', 1) AS name FROM v_old_files),
 o_ns AS (SELECT DISTINCT path, regexp_extract(unnest(string_split(content, chr(10))), '^(\\S+)', 1) AS name FROM v_new_files),
 o_ch AS (SELECT path FROM v_old_files o JOIN v_new_files n USING (path) WHERE o.content <> n.content),
 o_det AS (SELECT path, 'removed function: ' || name AS detail FROM o_os WHERE path IN (SELECT path FROM o_ch) AND (path, name) NOT IN (SELECT (path, name) FROM o_ns)
   UNION SELECT path, 'new function: ' || name FROM o_ns WHERE path IN (SELECT path FROM o_ch) AND (path, name) NOT IN (SELECT (path, name) FROM o_os)),
 o_st AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.content = n.content THEN 'unchanged'
   WHEN o.path IN (SELECT path FROM o_det) THEN 'structural' ELSE 'cosmetic' END AS status FROM v_old_files o FULL JOIN v_new_files n ON o.path = n.path)"""


def _signatures(df):
    word = F.explode(F.array_distinct(F.transform(F.split("content", "\n"), lambda s: F.regexp_extract(s, r"^(\S+)", 1))))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return df.select("path", word.alias("name")).select(
        "path", F.lit("function").alias("kind"), "name", none.alias("params"), none.alias("return_type"),
        F.lit(False).alias("exported"), F.lit(1).alias("n_lines"), empty.alias("methods"), empty.alias("properties"),
        empty.alias("specifiers"),
    )


def _hashed(df):
    return df.select("path", F.sha2("content", 256).alias("content_hash"), F.lit(True).alias("has_structural"))


def _statuses(get):
    old, new = get("v_old_files"), get("v_new_files")
    return changes.classify_changes(_hashed(old), _hashed(new), _signatures(old), _signatures(new))


@query("fn9_signature_changes", f"WITH {O_SIG} SELECT path, detail FROM o_det")
def _(get):
    old, new = get("v_old_files"), get("v_new_files")
    changed = old.withColumnRenamed("content", "o").join(new, "path").filter("o <> content").select("path")
    return changes.signature_changes(
        _signatures(old).join(changed, "path", "left_semi"), _signatures(new).join(changed, "path", "left_semi")
    )


@query(
    "fn9_change_details",
    f"""WITH {O_SIG}, o_both AS (SELECT path, NOT ends_with(path, '3') AS known FROM o_ch)
    SELECT b.path, CASE WHEN known AND detail IS NULL THEN 'COSMETIC' ELSE 'STRUCTURAL' END AS level,
      coalesce(detail, CASE WHEN known THEN 'internal logic changed (no structural impact)' ELSE 'no structural analysis available — conservative classification' END) AS detail
    FROM o_both b LEFT JOIN o_det d ON d.path = b.path AND b.known""",
)
def _(get):
    old, new = get("v_old_files"), get("v_new_files")
    partly = _hashed(new).withColumn("has_structural", ~F.col("path").endswith("3"))
    return changes.change_details(_hashed(old), partly, _signatures(old), _signatures(new))


@query("st6_change_sets", f"WITH {O_SIG} SELECT path, status FROM o_st")
def _(get):
    return _statuses(get)


@query(
    "ga25_update_decision",
    f"""WITH {O_SIG}, o_n AS (SELECT count(*) FILTER (status IN ('new','deleted','structural')) AS structural FROM o_st), o_t AS (SELECT count(*) AS total FROM v_old_files)
    SELECT CASE WHEN structural = 0 THEN 'SKIP' WHEN structural > 30 OR structural > 0.5 * total THEN 'FULL_UPDATE' WHEN structural > 10 THEN 'ARCHITECTURE_UPDATE' ELSE 'PARTIAL_UPDATE' END AS action,
     structural, total, 0::BIGINT AS new_dirs FROM o_n, o_t""",
)
def _(get):
    return changes.update_decision(_statuses(get), get("v_old_files"))


# Knowledge fixture: pages of documents as articles, parts and customers as orphan rows.
VIEWS["v_wiki_nodes"] = """SELECT 'article:a/doc-' || CAST(doc_id AS STRING) AS id, 'article' AS type, 'About ' || source || '-' || CAST(doc_id AS STRING) AS name, text AS content FROM documents
 UNION ALL SELECT 'entity:doc-' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN ':x' ELSE '' END, 'entity', c_name, NULL FROM customer
 UNION ALL SELECT 'claim:zz' || CAST(n_nationkey AS STRING), 'claim', 'src' || CAST(n_nationkey AS STRING) || '-' || CAST(n_nationkey * 7 AS STRING), NULL FROM nation
 UNION ALL SELECT 'claim:pre-doc-' || CAST(s_suppkey AS STRING) || '-post', 'claim', s_name, NULL FROM supplier
 UNION ALL SELECT 'topic:' || lower(r_name), 'topic', r_name, NULL FROM region"""
VIEWS["v_wiki_edges"] = """SELECT 'article:a/doc-' || CAST(doc_id AS STRING) AS source, 'entity:doc-' || CAST(doc_id % 40 AS STRING) AS target, 'cites' AS type, doc_id AS seq FROM documents
 UNION ALL SELECT 'article:a/doc-' || CAST(doc_id AS STRING), 'topic:' || CASE doc_id % 5 WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' ELSE 'nowhere' END, 'categorized_under', 10000000 + doc_id FROM documents"""
O_JN13 = """o_a AS (SELECT id AS aid, split_part(id, '/', -1) AS bare, lower(name) AS title, lower(content) AS content FROM v_wiki_nodes WHERE type = 'article'),
 o_k AS (SELECT id, split_part(split_part(id, ':', 2), ':', 1) AS stem, lower(name) AS nm FROM v_wiki_nodes WHERE type IN ('entity','claim')),
 o_1 AS (SELECT target AS id, arg_min(source, seq) AS article_id FROM v_wiki_edges WHERE target IN (SELECT id FROM o_k) AND source IN (SELECT aid FROM o_a) GROUP BY 1),
 o_2 AS (SELECT k.id, max(aid) AS article_id FROM o_k k JOIN o_a ON stem = bare WHERE k.id NOT IN (SELECT id FROM o_1) GROUP BY 1),
 o_3 AS (SELECT k.id, min(aid) AS article_id FROM o_k k JOIN o_a ON contains(bare, stem) OR contains(stem, bare) WHERE k.id NOT IN (SELECT id FROM o_1 UNION ALL SELECT id FROM o_2) GROUP BY 1),
 o_4 AS (SELECT k.id, min(aid) AS article_id FROM o_k k JOIN o_a ON contains(title, nm) WHERE k.id NOT IN (SELECT id FROM o_1 UNION ALL SELECT id FROM o_2 UNION ALL SELECT id FROM o_3) GROUP BY 1),
 o_5 AS (SELECT k.id, min(aid) AS article_id FROM o_k k JOIN o_a ON contains(content, nm) WHERE length(nm) >= 3 AND k.id NOT IN (SELECT id FROM o_1 UNION ALL SELECT id FROM o_2 UNION ALL SELECT id FROM o_3 UNION ALL SELECT id FROM o_4) GROUP BY 1),
 o_home AS (SELECT * FROM o_1 UNION ALL SELECT * FROM o_2 UNION ALL SELECT * FROM o_3 UNION ALL SELECT * FROM o_4 UNION ALL SELECT * FROM o_5)"""


@query("jn13_attach_orphans", f"WITH {O_JN13} SELECT id, article_id FROM o_home")
def _(get):
    return knowledge.attach_orphans(get("v_wiki_nodes"), get("v_wiki_edges"))


@query(
    "st8_category_layers",
    f"""WITH {O_JN13}, o_t AS (SELECT 'layer:' || replace(lower(r_name), ' ', '-') AS layer_id, 'topic:' || replace(lower(r_name), ' ', '-') AS t, r_regionkey AS pos FROM region),
     o_m AS (SELECT layer_id, source AS node_id, pos FROM v_wiki_edges JOIN o_t ON target = t WHERE type = 'categorized_under' UNION ALL SELECT layer_id, t, pos FROM o_t WHERE t IN (SELECT id FROM v_wiki_nodes)),
     o_l AS (SELECT node_id AS aid, arg_max(layer_id, pos) AS layer_id FROM o_m GROUP BY 1),
     o_p AS (SELECT layer_id, node_id FROM o_m UNION SELECT layer_id, id FROM o_home JOIN o_l ON aid = article_id)
    SELECT * FROM o_p UNION ALL SELECT 'layer:other', id FROM v_wiki_nodes WHERE id NOT IN (SELECT node_id FROM o_p)""",
)
def _(get):
    nodes, edges = get("v_wiki_nodes"), get("v_wiki_edges")
    homes = knowledge.attach_orphans(nodes, edges)
    cats = get("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("pos"))
    return knowledge.category_layers(nodes, edges, cats, homes)
