"""Queries: ranking (SR, FN19)."""

from pyspark.sql import functions as F

from graphloom.operators import corpus, search
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query

VIEWS["v_docs"] = "SELECT doc_id AS id, text FROM documents"
VIEWS["v_vectors"] = "SELECT vec_id AS id, embedding AS vector, label, CASE label WHEN 0 THEN 'file' WHEN 1 THEN 'function' ELSE 'document' END AS type FROM embeddings"
VIEWS["v_vector_queries"] = "SELECT vec_id AS query_id, embedding AS vector, label FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)"

O_POST = """o_tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+|[一-鿿])', 1)) AS term FROM v_docs),
 o_tf AS (SELECT id, term, count(*) AS tf FROM o_tok GROUP BY 1, 2),
 o_dl AS (SELECT id, count(*) AS dl FROM o_tok GROUP BY 1),
 o_all AS (SELECT count(*) AS n, sum(coalesce(dl, 0)) / count(*) AS avg_dl FROM v_docs LEFT JOIN o_dl USING (id)),
 o_df AS (SELECT term, count(*) AS df FROM o_tf GROUP BY 1),
 o_w AS (SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl)) AS w
   FROM o_tf JOIN o_df USING (term) JOIN o_dl USING (id), o_all)"""


def _o_bm25(name: str, queries: str, k: int) -> str:
    """CTEs ``name`` = top-k BM25 hits of the query table ``queries(query_id, query)``."""
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS q FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '([a-z0-9_]+|[一-鿿])', 1)) AS term FROM {queries}) GROUP BY 1, 2),
 {name}_s AS (SELECT query_id, id, sum(w * q) AS score FROM o_w JOIN {name}_q USING (term) GROUP BY 1, 2),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM {name}_s) WHERE rn <= {k})"""


@query("sr1_bm25", f"WITH {O_POST}, {_o_bm25('o_h', 'v_queries', 10)} SELECT query_id, id, round(score, 4) AS score FROM o_h")
def _(get):
    hits = search.bm25(get("v_docs"), get("v_queries"), 10)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"))


@query(
    "fn19_cosine",
    """SELECT a.id, q.query_id, round(list_cosine_similarity(a.vector::DOUBLE[], q.vector::DOUBLE[]), 5) AS sim FROM v_vectors a JOIN v_vector_queries q USING (label)""",
)
def _(get):
    # each vector against the first vector of its label
    pairs = get("v_vectors").join(get("v_vector_queries").withColumnRenamed("vector", "qv"), "label")
    return pairs.select("id", "query_id", F.round(search.cosine(F.col("vector"), F.col("qv")), 5).alias("sim"))


O_SIM = "o_s AS (SELECT q.query_id, a.id, a.type, list_cosine_similarity(a.vector::DOUBLE[], q.vector::DOUBLE[]) AS sim FROM v_vectors a, v_vector_queries q)"


@query(
    "sr2_vector_top_k",
    f"""WITH {O_SIM} SELECT query_id, id, round(sim, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rn FROM o_s WHERE sim > 0) WHERE rn <= 10""",
)
def _(get):
    hits = search.vector_top_k(get("v_vectors"), get("v_vector_queries"), 10)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"))


@query(
    "sr3_semantic_search",
    f"""WITH {O_SIM} SELECT query_id, id, round(1 - sim, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rn FROM o_s
      WHERE sim >= 0.1 AND type IN ('file','function')) WHERE rn <= 20""",
)
def _(get):
    hits = search.semantic_search(get("v_vectors"), get("v_vector_queries"), ["file", "function"], 0.1, 20)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"))


O_CHAR = """o_dc AS (SELECT id, unicode(ch) % 64 AS code, count(*) AS n FROM (SELECT id, unnest(string_split(lower(text), '')) AS ch FROM v_docs) WHERE ch <> '' GROUP BY 1, 2),
 o_qc AS (SELECT query_id, unicode(ch) % 64 AS code, count(*) AS n FROM (SELECT query_id, unnest(string_split(lower(query), '')) AS ch FROM v_queries) WHERE ch <> '' GROUP BY 1, 2),
 o_dn AS (SELECT id, sqrt(sum(n * n)) AS nn FROM o_dc GROUP BY 1), o_qn AS (SELECT query_id, sqrt(sum(n * n)) AS nn FROM o_qc GROUP BY 1),
 o_vs AS (SELECT query_id, id, sum(d.n * q.n) / (any_value(a.nn) * any_value(b.nn)) AS score FROM o_dc d JOIN o_qc q USING (code) JOIN o_dn a USING (id) JOIN o_qn b USING (query_id) GROUP BY 1, 2),
 o_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM o_vs) WHERE rn <= 20)"""


def _char_hits(get, k):
    docs = corpus.character_vector(get("v_docs"), "id", "text")
    queries = corpus.character_vector(get("v_queries"), "query_id", "query")
    return search.vector_top_k(docs, queries, k)


@query(
    "sr4_hybrid",
    f"""WITH {O_POST}, {_o_bm25('o_h', 'v_queries', 20)}, {O_CHAR},
     o_u AS (SELECT query_id, id, score * 0.4 AS s, 'bm25' AS src FROM o_h UNION ALL SELECT query_id, id, score * 0.4, 'vector' FROM o_v),
     o_m AS (SELECT query_id, id, sum(s) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM o_u GROUP BY 1, 2)
    SELECT query_id, id, round(score, 4) AS score, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM o_m) WHERE rn <= 10""",
)
def _(get):
    hits = search.hybrid({"bm25": search.bm25(get("v_docs"), get("v_queries"), 20), "vector": _char_hits(get, 20)}, k=10)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"), "sources")


@query(
    "sr5_smart_search",
    f"""WITH o_t AS (SELECT query_id, query, string_split(query, ' ') AS parts, unnest(string_split(query, ' ')) AS tok, generate_subscripts(string_split(query, ' '), 1) AS i FROM v_queries),
     o_st AS (SELECT *, CASE WHEN length(tok) > 3 AND tok LIKE '%s' AND tok NOT LIKE '%ss' THEN left(tok, -1) ELSE tok END AS stem FROM o_t),
     o_var AS (SELECT query_id AS qid, query AS variant FROM v_queries
       UNION SELECT query_id, array_to_string(list_transform(parts, lambda p, j: CASE WHEN j = i THEN b.word ELSE p END), ' ')
       FROM o_st JOIN v_ring a ON a.word = tok OR a.word = stem JOIN v_ring b ON b.group_id = a.group_id AND b.word <> tok),
     o_vq AS (SELECT qid || '|' || variant AS query_id, qid, variant AS query FROM o_var),
     {O_POST}, {_o_bm25('o_h', 'o_vq', 10)},
     o_m AS (SELECT qid AS query_id, id, sum(score * 0.4) AS score, count(*) AS n_variants FROM o_h JOIN o_vq USING (query_id) GROUP BY 1, 2)
    SELECT query_id, id, round(score, 3) AS score, n_variants FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM o_m) WHERE rn <= 10""",
)
def _(get):
    docs = get("v_docs")
    variants = corpus.expanded_queries(get("v_queries"), get("v_ring"))

    def one(queries, k):
        return search.hybrid({"bm25": search.bm25(docs, queries, 2 * k)}, k=k)

    hits = search.smart(variants, one, 10)
    return hits.select("query_id", "id", F.round("score", 3).alias("score"), "n_variants")


VIEWS["v_fuzzy_docs"] = """SELECT p_partkey AS id, p_type AS type, p_name AS name, ARR(lower(p_brand)) AS tags, p_type AS summary, CAST(NULL AS STRING) AS notes FROM part"""
VIEWS["v_fuzzy_queries"] = "SELECT r_regionkey AS query_id, CASE r_regionkey WHEN 0 THEN 'rng' WHEN 1 THEN 'widgt promo' WHEN 2 THEN 'brnd' WHEN 3 THEN 'econ' ELSE lower(r_name) END AS query FROM region"


@query(
    "sr6_fuzzy_search",
    """WITH o_f AS (SELECT id, f.field, f.w, unnest(list_distinct(regexp_extract_all(lower(f.v), '([a-z0-9_]+|[一-鿿])', 1))) AS token FROM
       (SELECT id, unnest([{field: 'name', w: 0.4, v: name}, {field: 'tags', w: 0.3, v: array_to_string(tags, ' ')}, {field: 'summary', w: 0.2, v: summary}]) AS f FROM v_fuzzy_docs WHERE type <> 'LARGE')),
     o_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '([a-z0-9_]+|[一-鿿])', 1)) AS q FROM v_fuzzy_queries),
     o_p AS (SELECT q, token, least(levenshtein(q, token) / greatest(length(q), length(token)), CASE WHEN length(q) >= 3 AND contains(token, q) THEN 0 ELSE 1 END) AS d
       FROM (SELECT DISTINCT q FROM o_q), (SELECT DISTINCT token FROM o_f)),
     o_h AS (SELECT query_id, id, field, any_value(w) AS w, min(d) AS d FROM o_p JOIN o_f USING (token) JOIN o_q USING (q) WHERE d <= 0.4 GROUP BY 1, 2, 3),
     o_s AS (SELECT query_id, id, 1 - sum((1 - d) * w) AS score FROM o_h GROUP BY 1, 2)
    SELECT query_id, id, round(score, 4)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rn FROM o_s) WHERE rn <= 50""",
)
def _(get):
    hits = search.fuzzy(get("v_fuzzy_docs"), get("v_fuzzy_queries"), ["STANDARD", "MEDIUM", "PROMO", "SMALL", "ECONOMY"])
    return hits.select("query_id", "id", F.round("score", 4).alias("score"))


@query(
    "tk3_ranked_limit",
    "SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def _(get):
    from graphloom.operators import stats

    return stats.top_by(get("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), "score", 25)
