"""Queries: path functions and corpus jobs (FN4-FN27, TX, WN10, WN11, GA22)."""

from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions import hashing, paths, text
from graphloom.operators import corpus, stats
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query, values_cte

# File names of every kind, spread over the parts.
VIEWS["v_paths"] = """SELECT p_partkey AS seq, CASE p_partkey % 20 WHEN 0 THEN 'Dockerfile.dev' WHEN 1 THEN 'a/' || p_name || '.TSX'
 WHEN 2 THEN '.env.local' WHEN 3 THEN 'LICENSE' WHEN 4 THEN 'k8s/x.yaml' WHEN 5 THEN '.github/workflows/ci.yml' WHEN 6 THEN 'm/Makefile'
 WHEN 7 THEN 'docker-compose.prod.yml' WHEN 8 THEN 'x/noext' WHEN 9 THEN 'b.k8s.YML' WHEN 10 THEN 'q/a.unknownext' WHEN 11 THEN 'src/test_a.py'
 WHEN 12 THEN 'src/a_test.go' WHEN 13 THEN 'src/FooTest.java' WHEN 14 THEN 'ui/x.spec.jsx' WHEN 15 THEN 'services/api/h.rs'
 WHEN 16 THEN '/abs//models/u.kt' WHEN 17 THEN './rel/utils/z.css' WHEN 18 THEN 'up/../x.c' ELSE path END AS path FROM v_part"""

O_EXT = "o_x AS (" + values_cte(["e", "l"], list(dims.LANGUAGE_EXTS.items())) + ")"
O_CEXT = "o_c AS (" + values_cte(["e", "c"], list(dims.CATEGORY_EXTS.items())) + ")"
O_BASE = """o_b AS (SELECT seq, path, split_part(path, '/', -1) AS base, lower(regexp_extract(split_part(path, '/', -1), '^.+([.][^.]*)$', 1)) AS ext,
  lower(regexp_extract(split_part(path, '/', -1), '^([.][A-Za-z0-9]+)', 1)) AS dot FROM v_paths)"""


@query(
    "fn4_language",
    f"""WITH {O_EXT}, {O_BASE} SELECT seq, CASE WHEN base = 'Dockerfile' OR base LIKE 'Dockerfile.%' THEN 'dockerfile' ELSE
      coalesce(d.l, x.l, nullif(substr(ext, 2), ''), CASE base WHEN 'Makefile' THEN 'makefile' END, 'unknown') END AS language
    FROM o_b LEFT JOIN o_x d ON d.e = dot LEFT JOIN o_x x ON x.e = ext""",
)
def _(get):
    return get("v_paths").select("seq", paths.language(F.col("path")).alias("language"))


@query(
    "fn5_category",
    f"""WITH {O_CEXT}, {O_BASE} SELECT seq, CASE WHEN base = 'LICENSE' THEN 'code'
      WHEN base LIKE 'Dockerfile%' OR base = 'Makefile' OR base LIKE 'docker-compose.%' OR path LIKE '.github/workflows/%' OR path LIKE 'k8s/%'
        OR lower(base) LIKE '%.k8s.yml' THEN 'infra' ELSE coalesce(x.c, d.c, 'code') END AS category
    FROM o_b LEFT JOIN o_c x ON x.e = ext LEFT JOIN o_c d ON d.e = dot""",
)
def _(get):
    return get("v_paths").select("seq", paths.category(F.col("path")).alias("category"))


@query(
    "fn6_corpus_size",
    """SELECT file_category, count(*) AS n, CASE WHEN count(*) <= 30 THEN 'small' WHEN count(*) <= 150 THEN 'moderate'
      WHEN count(*) <= 500 THEN 'large' ELSE 'very-large' END AS size FROM v_files GROUP BY 1""",
)
def _(get):
    n = get("v_files").groupBy("file_category").agg(F.count("*").alias("n"))
    return n.withColumn("size", paths.corpus_size(F.col("n")))


@query("fn7_line_count", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents")
def _(get):
    return get("documents").select("doc_id", paths.newline_count(F.col("text")).alias("lines"))


@query("fn8_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(get):
    return get("documents").select("doc_id", hashing.content_key(F.col("text")).alias("hash"))


@query(
    "fn8_legacy_hashes",
    """WITH o_u AS (SELECT doc_id, flatten(list_transform(CASE WHEN text = '' THEN [] ELSE string_split(text, '') END, lambda c: CASE WHEN unicode(c) > 65535
        THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END)) AS u FROM documents)
    SELECT doc_id, lpad(lower(hex(CAST(list_reduce(list_prepend(CAST('14695981039346656037' AS UHUGEINT), CAST(u AS UHUGEINT[])),
        lambda h, x: (xor(h, x) * CAST('1099511628211' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) AS UBIGINT))), 16, '0') AS fnv,
      lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(5381 AS BIGINT), CAST(u AS BIGINT[])), lambda h, x: (h * 33 + x) % 4294967296) AS UBIGINT))), 8, '0') AS djb2
    FROM o_u""",
)
def _(get):
    return get("documents").select("doc_id", hashing.fnv1a64("text").alias("fnv"), hashing.djb2("text").alias("djb2"))


@query(
    "fn10_is_test",
    """SELECT seq, regexp_matches(path, '[.](test|spec)[.](ts|tsx|js|jsx|mjs|cjs|vue)$') OR regexp_matches(path, '(^|/)test_[^/]*[.]py$')
      OR regexp_matches(path, '_test[.](py|go)$') OR regexp_matches(path, 'Tests?[.]java$') AS is_test FROM v_paths""",
)
def _(get):
    return get("v_paths").select("seq", paths.is_test(F.col("path")).alias("is_test"))


VIEWS["v_path_nodes"] = "SELECT 'file:' || path AS id, 'file' AS type, path AS file_path, seq FROM v_paths"
_LAYERS = [
    (rank, layer, form) for rank, (layer, names) in enumerate(dims.LAYER_DIRECTORIES.items())
    for name in names for form in (name, name + "s")
]
O_LAY = "o_l AS (" + values_cte(["r", "layer", "dir"], _LAYERS) + ")"


@query(
    "fn11_detect_layers",
    f"""WITH {O_LAY}, o_s AS (SELECT seq, id, unnest(string_split(lower(file_path), '/')) AS dir FROM v_path_nodes),
    o_m AS (SELECT seq, arg_min(layer, r) AS layer FROM o_s JOIN o_l USING (dir) GROUP BY 1)
    SELECT id, coalesce(layer, 'Core') AS layer_name, 'layer:' || replace(lower(coalesce(layer, 'Core')), ' ', '-') AS layer_id
    FROM v_path_nodes LEFT JOIN o_m USING (seq)""",
)
def _(get):
    return corpus.detect_layers(get("v_path_nodes"))


@query(
    "fn12_apply_layers",
    """SELECT 'file:' || path AS id, CASE WHEN starts_with(path, 'shared/') OR contains(path, '/shared/') THEN 'Shared'
      WHEN starts_with(path, 'promo') OR contains(path, '/promo') OR starts_with(path, 'brand-1') OR contains(path, '/brand-1') THEN 'Sales' ELSE 'Other' END AS layer_name FROM v_files""",
)
def _(get):
    return corpus.apply_layers(
        get("v_nodes"), [("Shared", ["shared/"]), ("Sales", ["promo", "brand-1"])]
    )


@query(
    "fn13_path_labels",
    """SELECT seq, CASE WHEN contains(path, '.spec.') OR contains(path, '.test.') OR path LIKE 'src/test_%.py' OR path LIKE '%_test.go' OR path LIKE '%Test.java' THEN 'test'
      WHEN path LIKE '%Dockerfile' OR path LIKE 'docker-compose.%' OR path LIKE '%/Makefile' THEN 'infrastructure' WHEN path LIKE '.github/workflows/%' THEN 'ci-cd'
      WHEN path LIKE '%.sql' THEN 'data' WHEN path LIKE '%.md' THEN 'documentation' WHEN path LIKE 'services/api/%' THEN 'api'
      WHEN path LIKE 'k8s/%' THEN 'infrastructure' WHEN path LIKE '/abs//models/%' THEN 'data' WHEN path LIKE './rel/utils/%' OR path LIKE 'shared/%' THEN 'utility'
      WHEN path LIKE 'ui/%' THEN 'ui' END AS label FROM v_paths""",
)
def _(get):
    p = get("v_paths")
    labels = corpus.path_labels(p.select("path").distinct())
    return p.join(labels, "path").select("seq", "label")


@query(
    "fn14_concepts",
    "WITH o_k AS (" + values_cte(["concept", "word"], [(c, w.lower()) for c, ws in dims.CONCEPT_KEYWORDS.items() for w in ws]) + """)
    SELECT DISTINCT id, concept FROM v_nodes JOIN o_k ON contains(lower(array_to_string(tags, ' ') || ' ' || summary), word)""",
)
def _(get):
    return corpus.concepts(get("v_nodes"))


_FW = [("ringfw", "requirements.txt", "ring"), ("widgetfw", "package.json", "Widget"), ("never", "go.mod", "zzz")]
VIEWS["v_manifests"] = """SELECT 'svc' || CAST(p_partkey AS STRING) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'requirements.txt'
 WHEN 1 THEN 'package.json' ELSE 'go.mod' END AS path, p_name AS content FROM part"""


@query(
    "fn15_frameworks",
    """SELECT DISTINCT f AS framework FROM v_manifests, (VALUES ('ringfw','requirements.txt','ring'),('widgetfw','package.json','widget'),('never','go.mod','zzz')) AS r(f, n, k)
    WHERE path LIKE '%/' || n AND contains(lower(content), k)""",
)
def _(get):
    return corpus.frameworks(get("v_manifests"), _FW)


_KEYS = [(f, name, word) for f, (names, words) in dims.FRAMEWORKS.items() for name in names for word in words]
VIEWS["v_known_manifests"] = """SELECT 'svc' || CAST(p_partkey AS STRING) || '/' || CASE p_partkey % 6 WHEN 0 THEN 'requirements.txt'
 WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'Gemfile' WHEN 4 THEN 'pom.xml' ELSE 'Pipfile' END AS path,
 p_name || chr(10) || CASE p_partkey % 18 WHEN 0 THEN 'Flask==2.0' WHEN 6 THEN 'uvicorn[standard]' WHEN 1 THEN '"Express": "^4"'
 WHEN 7 THEN '"nuxt": 3' WHEN 13 THEN '"next" : 14' WHEN 2 THEN 'require github.com/gin-gonic/gin v1' WHEN 9 THEN 'gem "railsx"'
 WHEN 10 THEN 'org_springframework' WHEN 5 THEN 'react' ELSE 'none' END AS content FROM part"""


@query(
    "fn15_known_frameworks",
    f"""SELECT DISTINCT f AS framework FROM v_known_manifests, (VALUES {", ".join(f"('{f}', '{n}', '{w}')" for f, n, w in _KEYS)}) AS r(f, n, k)
    WHERE path LIKE '%/' || n AND contains(lower(content), k)""",
)
def _(get):
    return corpus.frameworks(get("v_known_manifests"))


@query(
    "fn20_character_vector",
    """WITH o_ch AS (SELECT id, unnest(string_split(lower(content), '')) AS ch FROM v_memory),
     o_n AS (SELECT id, unicode(ch) % 64 AS code, count(*) AS n FROM o_ch WHERE ch <> '' GROUP BY 1, 2),
     o_t AS (SELECT id, sqrt(sum(n * n)) AS norm FROM o_n GROUP BY 1)
    SELECT id, code::BIGINT AS code, round(n / norm, 6) AS value FROM o_n JOIN o_t USING (id)""",
)
def _(get):
    v = corpus.character_vector(get("v_memory"))
    return v.select("id", F.posexplode("vector").alias("code", "value")).filter("value > 0").select(
        "id", F.col("code").cast("long").alias("code"), F.round("value", 6).alias("value")
    )


@query(
    "fn21_tokens",
    """SELECT doc_id, t AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+|[一-鿿])', 1)) AS t FROM documents) GROUP BY ALL""",
)
def _(get):
    return get("documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy(
        "doc_id", "token"
    ).agg(F.count("*").alias("n"))


VIEWS["v_queries"] = "SELECT item_id AS query_id, replace(lower(text), chr(10), ' ') AS query FROM benchmark"
VIEWS["v_ring"] = """SELECT 'g1' AS group_id, 'the' AS word FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'g1', 'that' FROM region WHERE r_regionkey = 0
 UNION ALL SELECT 'g1', 'this' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'g2', 'on' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'g2', 'of' FROM region WHERE r_regionkey = 0
 UNION ALL SELECT 'g3', lower(r_name) FROM region"""


@query(
    "fn22_expanded_queries",
    """WITH o_t AS (SELECT query_id, query, string_split(query, ' ') AS parts, unnest(string_split(query, ' ')) AS tok, generate_subscripts(string_split(query, ' '), 1) AS i FROM v_queries),
     o_s AS (SELECT *, CASE WHEN length(tok) > 3 AND tok LIKE '%s' AND tok NOT LIKE '%ss' THEN left(tok, -1) ELSE tok END AS stem FROM o_t)
    SELECT query_id, query AS variant FROM v_queries
    UNION SELECT query_id, array_to_string(list_transform(parts, lambda p, j: CASE WHEN j = i THEN b.word ELSE p END), ' ')
     FROM o_s JOIN v_ring a ON a.word = tok OR a.word = stem JOIN v_ring b ON b.group_id = a.group_id AND b.word <> tok""",
)
def _(get):
    return corpus.expanded_queries(get("v_queries"), get("v_ring"))


@query(
    "fn23_normalised_names",
    """SELECT c_custkey, replace(lower(c_name), ' ', '-') AS kebab, trim(regexp_replace(lower('  ' || c_name || '   X '), '\\s+', ' ', 'g')) AS collapsed FROM customer""",
)
def _(get):
    return get("customer").select(
        "c_custkey", paths.kebab(F.col("c_name")).alias("kebab"),
        paths.collapsed(F.concat(F.lit("  "), "c_name", F.lit("   X "))).alias("collapsed"),
    )


@query(
    "fn24_safe_paths",
    """SELECT seq, CASE WHEN list_contains(string_split(path, '/'), '..') THEN NULL
      ELSE regexp_replace(regexp_replace(path, '^/+', ''), '^[.]/', '') END AS path FROM v_paths""",
)
def _(get):
    return get("v_paths").select("seq", paths.safe_relative(F.col("path")).alias("path"))


@query(
    "fn25_complexity_bands",
    """SELECT doc_id, CASE WHEN n < 50 THEN 'simple' WHEN n <= 200 THEN 'moderate' ELSE 'complex' END AS band FROM
      (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents)""",
)
def _(get):
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return get("documents").select("doc_id", corpus.complexity_band(n).alias("band"))


@query(
    "fn25_significant",
    """SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3' OR (p_partkey % 2 = 0 AND p_size >= 10) OR (p_partkey % 2 = 1 AND (p_partkey % 5 >= 2 OR p_size >= 20))""",
)
def _(get):
    k = F.col("p_partkey")
    defs = get("part").select(
        k.alias("id"), F.when(k % 2 == 0, "function").otherwise("class").alias("kind"), F.col("p_size").alias("n_lines"),
        (k % 5).alias("n_methods"), (F.col("p_brand") == "Brand#3").alias("exported"),
    )
    return corpus.significant(defs).select("id")


@query(
    "fn27_default_weights",
    """SELECT seq, CASE WHEN seq % 3 = 0 THEN CASE type WHEN 'contains' THEN 1.0 WHEN 'imports' THEN 0.7 WHEN 'depends_on' THEN 0.6 WHEN 'serves' THEN 0.7 ELSE 0.5 END ELSE weight END::DOUBLE AS weight
    FROM v_edges""",
)
def _(get):
    e = get("v_edges").withColumn("weight", F.when(F.col("seq") % 3 != 0, F.col("weight")))
    return corpus.default_weights(e).select("seq", "weight")


# Documents dressed as source files: each line starts with a definition of the file's language.
VIEWS["v_corpus"] = """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'db/t' WHEN 1 THEN 'proto/m' WHEN 2 THEN 'gql/q' WHEN 3 THEN 'tf/v' WHEN 4 THEN 'env/e'
   WHEN 5 THEN 'mk/Makefile' WHEN 6 THEN 'sh/f' WHEN 7 THEN 'img/Dockerfile' WHEN 8 THEN 'src/h' ELSE 'docs/d' END || CAST(doc_id AS STRING)
   || CASE doc_id % 10 WHEN 0 THEN '.sql' WHEN 1 THEN '.proto' WHEN 2 THEN '.graphql' WHEN 3 THEN '.tf' WHEN 4 THEN '.env' WHEN 6 THEN '.sh' WHEN 8 THEN '.ts' WHEN 9 THEN '.md' ELSE '' END AS path,
  CASE doc_id % 10 WHEN 0 THEN 'sql' WHEN 1 THEN 'protobuf' WHEN 2 THEN 'graphql' WHEN 3 THEN 'terraform' WHEN 4 THEN 'env' WHEN 5 THEN 'makefile'
   WHEN 6 THEN 'shell' WHEN 7 THEN 'dockerfile' WHEN 8 THEN 'typescript' ELSE 'markdown' END AS language,
  CASE doc_id % 10 WHEN 0 THEN 'CREATE TABLE t' WHEN 1 THEN 'message M {' WHEN 2 THEN 'type T' WHEN 3 THEN 'variable "v" {' WHEN 4 THEN 'KEY_A=' WHEN 5 THEN 'build: '
   WHEN 6 THEN 'run() { ' WHEN 7 THEN 'FROM img' WHEN 8 THEN 'export async function handleIt(' ELSE '## ' END
  || replace(text, chr(10), chr(10) || CASE doc_id % 10 WHEN 0 THEN 'CREATE TABLE t' WHEN 1 THEN 'message M {' WHEN 2 THEN 'type T' WHEN 3 THEN 'variable "v" {' WHEN 4 THEN 'KEY_A='
   WHEN 5 THEN 'build: ' WHEN 6 THEN 'run() { ' WHEN 7 THEN 'FROM img' WHEN 8 THEN 'export async function handleIt(' ELSE '## ' END) AS content FROM documents"""

O_LINES = """o_ln AS (SELECT path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS line_no FROM v_corpus)"""


@query(
    "tx4_definitions",
    f"""WITH {O_LINES}, o_d AS (
     SELECT path, 'table' AS kind, unnest(list_distinct(regexp_extract_all(line, '(?i)CREATE\\s+TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?["`]?(\\w+)', 1))) AS name, line_no FROM o_ln WHERE language = 'sql'
     UNION ALL SELECT path, 'message', 'M', line_no FROM o_ln WHERE language = 'protobuf'
     UNION ALL SELECT path, 'type', regexp_extract(line, '^type (\\w+)', 1), line_no FROM o_ln WHERE language = 'graphql'
     UNION ALL SELECT path, 'variable', 'v', line_no FROM o_ln WHERE language = 'terraform'
     UNION ALL SELECT path, 'variable', 'KEY_A', line_no FROM o_ln WHERE language = 'env'
     UNION ALL SELECT path, 'target', regexp_extract(line, '^([a-zA-Z_.][a-zA-Z0-9_.-]*)(?:\\s+.*)?:', 1), line_no FROM o_ln WHERE language = 'makefile' AND NOT regexp_matches(line, ':=|\\?=')
     UNION ALL SELECT path, 'function', 'run', line_no FROM o_ln WHERE language = 'shell'
     UNION ALL SELECT path, 'stage', coalesce(nullif(regexp_extract(line, '(?i)^FROM\\s+(\\S+)(?:\\s+AS\\s+(\\S+))?', 2), ''),
       string_split(string_split(regexp_extract(line, '^FROM\\s+(\\S+)', 1), ':')[1], '/')[-1]), line_no FROM o_ln WHERE language = 'dockerfile')
    SELECT path, kind, name, line_no FROM o_d""",
)
def _(get):
    return corpus.definitions(get("v_corpus")).withColumn("line_no", F.col("line_no").cast("long"))


VIEWS["v_schemas"] = """SELECT 'gql/s' || CAST(doc_id AS STRING) || '.graphql' AS path, 'graphql' AS language,
  'type ' || CASE doc_id % 4 WHEN 0 THEN 'Query' WHEN 1 THEN 'Mutation' WHEN 2 THEN 'Subscription' ELSE 'Thing' END || ' {' || chr(10)
  || translate(text, '{}', '()') || chr(10) || '  deep(a: In = { b: 1 }): Int' || chr(10) || '}' || chr(10) || 'loose line' AS content FROM documents"""


@query(
    "tx4_graphql_endpoints",
    """WITH o_l AS (SELECT path, substr(string_split(content, ' ')[2], 1) AS method, unnest(string_split(content, chr(10))) AS line,
       generate_subscripts(string_split(content, chr(10)), 1) AS line_no, len(string_split(content, chr(10))) AS n FROM v_schemas)
    SELECT path, method, regexp_extract(line, '^\\s*(\\w+)', 1) AS name, line_no::BIGINT AS line_no FROM o_l
    WHERE method IN ('Query', 'Mutation', 'Subscription') AND line_no > 1 AND line_no < n - 1 AND regexp_matches(line, '^\\s*\\w')""",
)
def _(get):
    return corpus.graphql_endpoints(get("v_schemas")).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "tx5_entry_points",
    f"""WITH {O_LINES} SELECT path, line_no, 'manual' AS kind, 'export async function handleIt' AS match FROM o_ln WHERE language = 'typescript'""",
)
def _(get):
    e = corpus.entry_points(get("v_corpus"))
    return e.select("path", F.col("line_no").cast("long").alias("line_no"), "kind", "match")


VIEWS["v_wiki"] = """SELECT doc_id, 'wiki/doc' || CAST(doc_id AS STRING) || '.md' AS path,
 '---' || chr(10) || 'tags: ' || lang || chr(10) || '---' || chr(10) || '# Doc ' || CAST(doc_id AS STRING) || chr(10) || text || chr(10) || chr(10)
 || '## Links ' || lang || chr(10) || '[[doc' || CAST(doc_id + 1 AS STRING) || ']] and [[ DOC' || CAST(doc_id * 7 % 500 AS STRING) || ' |See]] [[doc'
 || CAST(doc_id AS STRING) || ']] ![pic](img/p' || CAST(doc_id AS STRING) || '.png) [x](../doc' || CAST(doc_id % 50 AS STRING) || '.md) [e](http://x.y/z)'
 || chr(10) || '```sql' || chr(10) || '## not a heading' || chr(10) || '```' || chr(10) || '## [2024-01-' || CASE WHEN doc_id % 20 < 9 THEN '0' ELSE '' END || CAST(doc_id % 20 + 1 AS STRING)
 || '] ingest | Doc ' || CAST(doc_id AS STRING) || chr(10) || 'end' AS content FROM documents"""


@query(
    "tx1_articles",
    """SELECT 'article:wiki/doc' || doc_id AS id, 'Doc ' || doc_id AS name, lang AS tags, 'simple' AS complexity, 3 AS n_links,
      len(regexp_extract_all(content, '(?m)^(#{1,6})\\s+(.+)$', 1))::INT AS n_headings, 'sql' AS fences,
      length(content) - length(replace(content, chr(10), '')) + 1 AS lines, len(regexp_extract_all(content, '[^\\s\\x0b]+'))::BIGINT AS words
    FROM v_wiki JOIN documents USING (doc_id)""",
)
def _(get):
    return corpus.articles(get("v_wiki")).drop("path", "summary")


@query("tx1_summaries")
def _(get):
    return corpus.articles(get("v_wiki")).select("id", "summary")


@query(
    "tx1_article_links",
    """SELECT path, pos::INT AS pos, link FROM (SELECT path, 0 AS pos, 'doc' || (doc_id + 1) AS link FROM v_wiki UNION ALL SELECT path, 1, 'DOC' || (doc_id * 7 % 500) FROM v_wiki
      UNION ALL SELECT path, 2, 'doc' || doc_id FROM v_wiki)""",
)
def _(get):
    return corpus.article_links(get("v_wiki"))


def _resolved(get):
    from graphloom.operators import joins

    wiki = get("v_wiki")
    stems = wiki.select(F.regexp_replace("path", r"\.md$", "").alias("path"))
    links = corpus.article_links(wiki).select(
        F.concat_ws("#", "path", F.col("pos").cast("string")).alias("link_id"),
        F.regexp_replace("path", r"\.md$", "").alias("source"), "link",
    )
    return joins.resolve_links(links, stems)


@query(
    "tx2_backlinks",
    """WITH o_l AS (SELECT doc_id AS s, doc_id + 1 AS t FROM documents UNION SELECT doc_id, doc_id * 7 % 500 FROM documents)
    SELECT 'wiki/doc' || t AS target, count(*) AS n_backlinks FROM o_l WHERE s <> t AND t IN (SELECT doc_id FROM documents) GROUP BY 1""",
)
def _(get):
    return corpus.backlinks(_resolved(get))[1]


@query(
    "tx2_link_edges",
    """SELECT DISTINCT 'wiki/doc' || s AS source, 'wiki/doc' || t AS target FROM (SELECT doc_id AS s, doc_id + 1 AS t FROM documents UNION ALL SELECT doc_id, doc_id * 7 % 500 FROM documents)
    WHERE s <> t AND t IN (SELECT doc_id FROM documents)""",
)
def _(get):
    return corpus.backlinks(_resolved(get))[0]


@query(
    "tx3_index_categories",
    """SELECT path, category, article FROM (SELECT path, 'Links ' || lang AS category, unnest(['doc' || (doc_id + 1), 'DOC' || (doc_id * 7 % 500), 'doc' || doc_id]) AS article
      FROM v_wiki JOIN documents USING (doc_id))""",
)
def _(get):
    return corpus.index_categories(get("v_wiki")).select("path", "category", "article")


@query(
    "tx3_log_entries",
    """SELECT path, '2024-01-' || lpad((doc_id % 20 + 1)::VARCHAR, 2, '0') AS date, 'ingest' AS operation, 'Doc ' || doc_id AS title FROM v_wiki""",
)
def _(get):
    return corpus.log_entries(get("v_wiki")).select("path", "date", "operation", "title")


@query(
    "wn10_sections",
    """WITH o_s AS (SELECT doc_id, path, content, len(string_split(content, chr(10))) AS n FROM v_wiki),
     o_ln AS (SELECT path, n, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM o_s),
     o_f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') OR starts_with(line, '~~~') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS k FROM o_ln),
     o_h AS (SELECT path, n, i, regexp_extract(line, '^(#{1,6})\\s+(.+)', 1) AS marks, trim(regexp_extract(line, '^(#{1,6})\\s+(.+)', 2)) AS name FROM o_f
       WHERE k % 2 = 0 AND regexp_matches(line, '^#{1,6}\\s+\\S') AND NOT starts_with(line, '```'))
    SELECT path, name, length(marks)::INT AS level, i::INT AS line_start, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n)::INT AS line_end FROM o_h""",
)
def _(get):
    return corpus.sections(get("v_wiki"))


@query(
    "wn11_fence_lines",
    """WITH o_ln AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM v_wiki) SELECT path, count(*) FILTER (line = '## not a heading') AS fenced FROM o_ln GROUP BY 1""",
)
def _(get):
    # headings found without regard to fences, minus those found outside them
    rows = corpus.lines_of(get("v_wiki"), "path").filter(F.col("line").rlike(r"^#{1,6}\s+\S")).groupBy("path").agg(F.count("*").alias("a"))
    inside = corpus.sections(get("v_wiki")).groupBy("path").agg(F.count("*").alias("b"))
    return rows.join(inside, "path").select("path", (F.col("a") - F.col("b")).alias("fenced"))


@query(
    "tx6_local_references",
    """WITH o_ln AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM v_wiki), o_m AS (SELECT path, unnest(regexp_extract_all(line, '(!?\\[[^\\]]*\\]\\([^)]+\\))', 1)) AS m FROM o_ln)
    SELECT path, regexp_extract(m, '\\]\\(([^)]+)\\)', 1) AS target, CASE WHEN starts_with(m, '!') THEN 'image' ELSE 'file' END AS kind FROM o_m
    WHERE NOT starts_with(regexp_extract(m, '\\]\\(([^)]+)\\)', 1), 'http')""",
)
def _(get):
    return corpus.local_references(get("v_wiki")).select("path", "target", "kind")


_PII_SQL = {k: rx.replace("'", "''") for k, rx in dims.PII_PATTERNS.items()}


@query(
    "tx7_pii_counts",
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{rx}'))::BIGINT AS {k}" for k, rx in _PII_SQL.items()) + " FROM documents",
)
def _(get):
    return get("documents").select("doc_id", *text.pii_counts(F.col("text")))


def _any(*kinds):
    return " OR ".join(f"regexp_matches(text, '{_PII_SQL[k]}')" for k in kinds)


@query(
    "tx8_sensitivity",
    f"""SELECT doc_id, CASE WHEN {_any('creditcard','ssn','apikey')} THEN 'restricted' WHEN {_any('email','phone')} THEN 'confidential'
      WHEN {_any('ipv4','url')} THEN 'internal' ELSE 'public' END AS level FROM documents""",
)
def _(get):
    return get("documents").select("doc_id", text.sensitivity(F.col("text")).alias("level"))


@query(
    "ud2_custom_sensitivity",
    f"""SELECT doc_id, CASE WHEN {_any('creditcard','ssn','apikey')} THEN 'restricted'
      WHEN {_any('email','phone')} OR regexp_matches(text, '\\b(?:the|and) [a-m]') THEN 'confidential'
      WHEN {_any('ipv4','url')} OR regexp_matches(text, '[.] [A-F]') THEN 'internal' ELSE 'public' END AS level FROM documents""",
)
def _(get):
    custom = [("phone", r"\b(?:the|and) [a-m]"), ("url", "[.] [A-F]")]
    return get("documents").select("doc_id", text.sensitivity(F.col("text"), custom).alias("level"))


_red = " UNION ALL ".join(
    f"""SELECT doc_id, {n} AS place, '[REDACTED_{k.upper()}]' AS shown, p + 1 AS i,
        string_split_regex(text, '{rx}')[p + 1] AS gap, regexp_extract_all(text, '{rx}')[p + 1] AS hit
        FROM (SELECT *, unnest(range(len(regexp_extract_all(text, '{rx}')))) AS p FROM documents)"""
    for n, (k, rx) in enumerate(_PII_SQL.items())
)


@query("tx9_redacted", f"""WITH o_m AS MATERIALIZED ({_red}), o_s AS (
    SELECT doc_id, place, shown, sum(len(gap) + len(hit)) OVER w AS stop, sum(len(gap) + len(hit)) OVER w - len(hit) AS start
    FROM o_m WINDOW w AS (PARTITION BY doc_id, place ORDER BY i)
  ), o_c AS (
    SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
    FROM o_s
  ), o_p AS (
    SELECT o_c.doc_id, start, substr(text, CAST(seen AS BIGINT) + 1, CAST(start - seen AS BIGINT)) || shown AS part
    FROM o_c JOIN documents USING (doc_id) WHERE start >= seen
  ), o_j AS (SELECT doc_id, string_agg(part, '' ORDER BY start) AS body FROM o_p GROUP BY 1),
  o_e AS (SELECT doc_id, max(stop) AS stop FROM o_s GROUP BY 1)
  SELECT doc_id, sha256(coalesce(body, '') || substr(text, CAST(coalesce(stop, 0) AS BIGINT) + 1)) AS redacted
  FROM documents LEFT JOIN o_j USING (doc_id) LEFT JOIN o_e USING (doc_id)""")
def _(get):
    return get("documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted"))


@query(
    "tx10_built_nodes",
    """WITH o_d AS (SELECT DISTINCT p_brand AS nm, path FROM part JOIN v_part USING (p_partkey))
    SELECT 'file:' || path AS id, 'file' AS type FROM v_files UNION SELECT 'table:' || path || ':' || nm, 'table' FROM o_d""",
)
def _(get):
    return _built(get)[0].select("id", "type")


def _built(get):
    part = get("part").join(get("v_part").select("p_partkey", "path"), "p_partkey")
    defs = part.select("path", F.lit("view").alias("kind"), F.col("p_brand").alias("name"))
    calls = get("v_imports").select(
        F.concat(F.lit("function:"), "src_path").alias("caller"), F.concat(F.lit("function:"), "tgt_path").alias("callee")
    )
    return corpus.build_graph(get("v_files"), defs, get("v_imports"), calls)


@query(
    "tx10_built_edges",
    """WITH o_d AS (SELECT DISTINCT p_brand AS nm, path FROM part JOIN v_part USING (p_partkey))
    SELECT 'file:' || path AS source, 'table:' || path || ':' || nm AS target, 'contains' AS type, 1.0::DOUBLE AS weight FROM o_d
    UNION ALL SELECT DISTINCT 'file:' || src_path, 'file:' || tgt_path, 'imports', 0.7 FROM v_imports
    UNION ALL SELECT DISTINCT 'function:' || src_path, 'function:' || tgt_path, 'calls', 0.8 FROM v_imports""",
)
def _(get):
    return _built(get)[1]


@query(
    "tx11_light_signatures",
    f"""SELECT path, CASE WHEN language = 'typescript' THEN array_to_string(list_transform(range(least(20, least(80, len(string_split(content, chr(10)))))), lambda x: 'handleIt'), ',') ELSE
       array_to_string(regexp_extract_all(array_to_string(string_split(content, chr(10))[1:80], chr(10)), '(?m)^(?:def|class)\\s+(\\w+)', 1)[1:20], ',') END AS exports,
      len(string_split(content, chr(10)))::INT AS lines FROM v_corpus""",
)
def _(get):
    return corpus.light_signatures(get("v_corpus")).select("path", F.array_join("exports", ",").alias("exports"), "lines")


@query(
    "fn26_rule_tags",
    """WITH o_k AS (SELECT path, unnest(CASE language WHEN 'sql' THEN ['database','migration'] WHEN 'protobuf' THEN ['schema-definition','data-pipeline']
       WHEN 'graphql' THEN ['api-schema','schema-definition'] WHEN 'terraform' THEN ['infrastructure','deployment'] WHEN 'dockerfile' THEN ['containerization','infrastructure'] ELSE []::VARCHAR[] END) AS tag FROM v_corpus)
    SELECT path, tag FROM o_k""",
)
def _(get):
    return corpus.rule_tags(get("v_corpus"))


@query(
    "ga22_file_metrics",
    """SELECT path, size_lines, coalesce(n_function, 0) AS n_function, coalesce(n_class, 0) AS n_class FROM v_files LEFT JOIN
     (SELECT file_path AS path, count(*) FILTER (type = 'function') AS n_function, count(*) FILTER (type = 'class') AS n_class FROM v_nodes WHERE type <> 'file' GROUP BY 1) USING (path)""",
)
def _(get):
    defs = get("v_nodes").filter("type <> 'file'").select(F.col("file_path").alias("path"), F.col("type").alias("kind"))
    return stats.file_metrics(defs, get("v_files")).select("path", "size_lines", "n_function", "n_class")
