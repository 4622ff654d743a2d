"""Graph, corpus and memory views over the driver tables, as shared SQL."""

_PART_KEY_SEQ = "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey)"

VIEWS: dict[str, str] = {
    # A part is a file; each tenth part and its successor share a folder and
    # stem so that name-based test pairing has real matches.
    "v_part": """
SELECT p_partkey, p_name, p_size, p_retailprice, lower(p_type) AS ptype,
       lower(replace(p_brand, '#', '-')) AS pbrand,
       CASE WHEN p_partkey % 10 < 2
            THEN 'shared/m' || CAST(CAST((p_partkey - p_partkey % 10) / 10 AS BIGINT) % 50 AS STRING)
            ELSE lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) END
       || '/p' || CAST(CASE WHEN p_partkey % 5 = 1 THEN p_partkey - 1 ELSE p_partkey END AS STRING)
       || CASE p_partkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.py'
                             WHEN 3 THEN '.sql' ELSE '.md' END AS path
FROM part""",
    "v_nodes": """
SELECT 'domain:r' || CAST(r_regionkey AS STRING) AS id, 'domain' AS type, r_name AS name,
       CAST(NULL AS STRING) AS file_path, 'region ' || r_name AS summary, ARR('region') AS tags,
       'simple' AS complexity, TIMESTAMP '1995-01-01 00:00:00' AS created_at,
       CAST(r_regionkey AS BIGINT) AS seq FROM region
UNION ALL
SELECT 'flow:n' || CAST(n_nationkey AS STRING), 'flow', n_name, NULL, 'nation of region', ARR('nation'),
       'moderate', TIMESTAMP '1995-01-01 00:00:00', 100 + n_nationkey FROM nation
UNION ALL
SELECT 'step:s' || CAST(s_suppkey AS STRING), 'step', s_name, NULL, 'supplier', ARR('supplier', 'event'),
       CASE WHEN s_acctbal < 0 THEN 'complex' ELSE 'simple' END, TIMESTAMP '1996-01-01 00:00:00',
       100000000 + s_suppkey FROM supplier
UNION ALL
SELECT CASE c_custkey % 3 WHEN 0 THEN 'function:' WHEN 1 THEN 'class:' ELSE 'entity:' END
       || 'c' || CAST(c_custkey AS STRING),
       CASE c_custkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'entity' END, c_name,
       path, 'customer in ' || lower(c_mktsegment), ARR('customer', lower(c_mktsegment)),
       CASE WHEN c_acctbal < 0 THEN 'complex' WHEN c_acctbal < 3000 THEN 'moderate' ELSE 'simple' END,
       TIMESTAMP '1996-06-01 00:00:00', 200000000 + c_custkey
FROM customer LEFT JOIN v_part ON c_custkey = p_partkey
UNION ALL
SELECT 'file:' || path, 'file', 'p' || CAST(p_partkey AS STRING), path, p_name, ARR(ptype, pbrand),
       CASE WHEN p_size <= 16 THEN 'simple' WHEN p_size <= 33 THEN 'moderate' ELSE 'complex' END,
       TIMESTAMP '1994-01-01 00:00:00', 1000000000 + p_partkey FROM v_part
UNION ALL
SELECT 'document:o' || CAST(o_orderkey AS STRING), 'document', 'order ' || CAST(o_orderkey AS STRING), NULL,
       lower(o_orderpriority), ARR('order', lower(o_orderstatus)),
       CASE o_orderstatus WHEN 'F' THEN 'simple' WHEN 'O' THEN 'moderate' ELSE 'complex' END,
       CAST(o_orderdate AS TIMESTAMP), 2000000000 + o_orderkey FROM orders""",
    # Consecutive parts of one order form the file-to-file import edges.
    "v_import_rows": f"""
SELECT src, tgt, weight, seq FROM (
  SELECT l_partkey AS src,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS tgt,
         l_discount AS weight, {_PART_KEY_SEQ} AS seq
  FROM lineitem) t WHERE tgt IS NOT NULL""",
    "v_edges": f"""
SELECT 'flow:n' || CAST(n_nationkey AS STRING) AS source, 'domain:r' || CAST(n_regionkey AS STRING) AS target,
       'categorized_under' AS type, 'forward' AS direction, CAST(0.6 AS DOUBLE) AS weight,
       CAST(NULL AS STRING) AS description, CAST(n_nationkey AS BIGINT) AS seq FROM nation
UNION ALL
SELECT 'domain:r' || CAST(n_regionkey AS STRING), 'flow:n' || CAST(n_nationkey AS STRING), 'contains_flow',
       'forward', CAST(n_nationkey AS DOUBLE) / 100, NULL, 100 + n_nationkey FROM nation
UNION ALL
SELECT 'flow:n' || CAST(s_nationkey AS STRING), 'step:s' || CAST(s_suppkey AS STRING), 'flow_step',
       'forward', CAST(s_suppkey % 10 AS DOUBLE) / 10, NULL, 10000000 + s_suppkey FROM supplier
UNION ALL
SELECT CASE c_custkey % 3 WHEN 0 THEN 'function:' WHEN 1 THEN 'class:' ELSE 'entity:' END
       || 'c' || CAST(c_custkey AS STRING), 'flow:n' || CAST(c_nationkey AS STRING), 'categorized_under',
       'forward', CAST(0.6 AS DOUBLE), NULL, 200000000 + c_custkey FROM customer
UNION ALL
SELECT 'file:' || path, CASE c_custkey % 3 WHEN 0 THEN 'function:' ELSE 'class:' END
       || 'c' || CAST(c_custkey AS STRING), 'contains', 'forward', CAST(1 AS DOUBLE), NULL,
       300000000 + c_custkey FROM customer JOIN v_part ON c_custkey = p_partkey WHERE c_custkey % 3 < 2
UNION ALL
SELECT 'document:o' || CAST(o_orderkey AS STRING),
       CASE o_custkey % 3 WHEN 0 THEN 'function:' WHEN 1 THEN 'class:' ELSE 'entity:' END
       || 'c' || CAST(o_custkey AS STRING), 'depends_on', 'forward', CAST(0.5 AS DOUBLE),
       lower(o_orderpriority), 4000000000 + o_orderkey FROM orders
UNION ALL
SELECT 'document:o' || CAST(l_orderkey AS STRING), 'file:' || path, 'documents', 'forward', l_discount, NULL,
       {_PART_KEY_SEQ} * 4 FROM lineitem JOIN v_part ON l_partkey = p_partkey
UNION ALL
SELECT 'step:s' || CAST(l_suppkey AS STRING), 'file:' || path, 'serves',
       CASE WHEN l_returnflag = 'R' THEN 'bidirectional' ELSE 'forward' END, l_tax, NULL,
       {_PART_KEY_SEQ} * 4 + 1 FROM lineitem JOIN v_part ON l_partkey = p_partkey
UNION ALL
SELECT 'file:' || a.path, 'file:' || b.path, 'imports', 'forward', i.weight, NULL, i.seq * 4 + 2
FROM v_import_rows i JOIN v_part a ON i.src = a.p_partkey JOIN v_part b ON i.tgt = b.p_partkey""",
    "v_imports": """
SELECT DISTINCT a.path AS src_path, b.path AS tgt_path
FROM v_import_rows i JOIN v_part a ON i.src = a.p_partkey JOIN v_part b ON i.tgt = b.p_partkey
WHERE i.src <> i.tgt""",
    "v_layer_members": """
SELECT 'layer:' || ptype AS layer_id,
       CASE ptype WHEN 'economy' THEN 1 WHEN 'large' THEN 2 WHEN 'medium' THEN 3 WHEN 'promo' THEN 4
                  WHEN 'small' THEN 5 ELSE 6 END AS layer_pos, ptype AS layer_name,
       'file:' || path AS node_id, CAST(p_partkey AS BIGINT) AS member_pos FROM v_part
UNION ALL
SELECT 'layer:' || pbrand, 100 + length(pbrand), pbrand, 'file:' || path, CAST(p_partkey AS BIGINT)
FROM v_part WHERE p_size > 25
UNION ALL
SELECT 'layer:' || lower(c_mktsegment), 50, lower(c_mktsegment),
       CASE c_custkey % 3 WHEN 0 THEN 'function:' WHEN 1 THEN 'class:' ELSE 'entity:' END
       || 'c' || CAST(c_custkey AS STRING), CAST(c_custkey AS BIGINT) FROM customer""",
    "v_tour_members": """
SELECT layer_pos AS step_order, layer_name AS title, node_id, CAST(rn AS BIGINT) AS pos FROM (
  SELECT layer_pos, layer_name, node_id,
         row_number() OVER (PARTITION BY layer_name ORDER BY member_pos) AS rn FROM v_layer_members) t
WHERE rn <= 3""",
    "v_files": """
SELECT path, CAST(p_size * 10 AS BIGINT) AS size_lines,
       CASE p_partkey % 5 WHEN 3 THEN 'sql' WHEN 4 THEN 'markdown' WHEN 2 THEN 'python' ELSE 'typescript' END AS language,
       CASE p_partkey % 5 WHEN 3 THEN 'data' WHEN 4 THEN 'docs' ELSE 'code' END AS file_category,
       CAST(p_partkey AS BIGINT) AS seq FROM v_part""",
    # Two batches of raw nodes with injected defects.
    "v_dirty_nodes": """
SELECT CASE WHEN p_partkey % 13 = 0 THEN NULL
            WHEN p_partkey % 7 = 0 THEN 'file:file:' || path
            WHEN p_partkey % 11 = 0 THEN 'proj:file:' || path
            WHEN p_partkey % 17 = 0 THEN path ELSE 'file:' || path END AS id,
       CASE WHEN p_partkey % 19 = 0 THEN 'FILE' WHEN p_partkey % 23 = 0 THEN 'script'
            WHEN p_partkey % 29 = 0 THEN NULL ELSE 'file' END AS type,
       CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_name END AS name, path AS file_path,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'first' END AS summary,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE ARR(ptype, pbrand) END AS tags,
       CASE p_partkey % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'COMPLEX' WHEN 2 THEN CAST(p_size AS STRING)
                          WHEN 3 THEN NULL WHEN 4 THEN 'weird' ELSE 'moderate' END AS complexity,
       CAST(p_partkey AS BIGINT) AS seq FROM v_part
UNION ALL
SELECT 'file:' || path, 'file', p_name, path, 'second', ARR(ptype), 'complex',
       1000000000 + p_partkey FROM v_part WHERE p_size > 40
UNION ALL
SELECT CASE c_custkey % 4 WHEN 0 THEN 'func:' || path || ':' || c_name WHEN 1 THEN c_name
                          ELSE 'function:' || path || ':' || c_name END,
       CASE c_custkey % 5 WHEN 0 THEN 'func' WHEN 1 THEN 'method' ELSE 'function' END,
       c_name, path, lower(c_mktsegment), ARR('customer'), CAST(c_nationkey AS STRING),
       2000000000 + c_custkey FROM customer JOIN v_part ON c_custkey = p_partkey""",
    "v_dirty_edges": """
SELECT CASE WHEN i.src % 7 = 0 THEN 'file:file:' || a.path WHEN i.src % 11 = 0 THEN 'proj:file:' || a.path
            WHEN i.src % 17 = 0 THEN a.path ELSE 'file:' || a.path END AS source,
       CASE WHEN i.tgt % 17 = 5 THEN 'file:missing/' || b.path ELSE 'file:' || b.path END AS target,
       CASE WHEN i.seq % 23 = 0 THEN 'import' WHEN i.seq % 29 = 0 THEN NULL
            WHEN i.seq % 31 = 0 THEN 'bogus' ELSE 'IMPORTS' END AS type,
       CASE i.seq % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'FORWARD' WHEN 2 THEN NULL WHEN 3 THEN 'sideways'
                      ELSE 'inbound' END AS direction,
       CASE WHEN i.seq % 37 = 0 THEN 'heavy' WHEN i.seq % 41 = 0 THEN NULL WHEN i.seq % 43 = 0 THEN '1.5'
            ELSE CAST(i.weight AS STRING) END AS weight,
       CAST(NULL AS STRING) AS description, i.seq * 4 AS seq
FROM v_import_rows i JOIN v_part a ON i.src = a.p_partkey JOIN v_part b ON i.tgt = b.p_partkey
UNION ALL
SELECT 'file:' || a.path, 'file:' || b.path, 'tested_by', 'forward', CAST(l_tax AS STRING),
       CASE WHEN l_linenumber % 2 = 0 THEN 'seen' ELSE NULL END,
       (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 4 + 1
FROM lineitem JOIN v_part a ON l_partkey = a.p_partkey JOIN v_part b ON l_partkey + l_linenumber = b.p_partkey
WHERE l_returnflag = 'R'""",
    "v_memory": """
SELECT CAST(doc_id AS STRING) AS id, text AS content, source AS scope,
       ARR(lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END) AS tags,
       CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence,
       CASE doc_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'consolidated' WHEN 2 THEN 'stale'
                       WHEN 3 THEN 'evicted' ELSE 'active' END AS lifecycle,
       TSUS(1704067200000000 + doc_id * 3600000000) AS created_at,
       TSUS(1704067200000000 + doc_id * 3600000000 + (doc_id % 100) * 86400000000) AS last_accessed_at,
       doc_id % 17 AS access_count, doc_id AS seq FROM documents""",
    "v_audit": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'read' WHEN 'click' THEN 'update'
                       WHEN 'purchase' THEN 'update' ELSE 'delete' END AS op,
       CASE WHEN event_id % 10 = 9 THEN 'edge' ELSE 'memory' END AS entity, CAST(user_id AS STRING) AS id,
       CASE event_type WHEN 'click' THEN 'lifecycle' WHEN 'purchase' THEN 'confidence' ELSE NULL END AS field,
       CASE WHEN event_type = 'signup' AND event_id % 9 <> 0 THEN props
            WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'archived' ELSE 'active' END
            WHEN event_type = 'purchase' THEN CAST(value AS STRING) ELSE NULL END AS new,
       'user' AS actor FROM events""",
    "v_slots": """
SELECT event_type AS scope, CAST(user_id AS STRING) AS key, props AS value,
       CAST(value * 3600000 AS BIGINT) AS ttl_ms, CAST(ts AS TIMESTAMP) AS last_updated_at, event_id AS seq
FROM events""",
    "v_sessions": """
SELECT CAST(conv_id AS STRING) AS id, 'chat ' || CAST(conv_id AS STRING) AS title,
       conv_id * 3600000 AS start_ms,
       conv_id * 3600000 + CASE WHEN conv_id % 11 = 0 THEN -1000 ELSE count(*) * 60000 END AS end_ms,
       CASE WHEN count(*) > 4 THEN 'success' WHEN count(*) > 2 THEN 'partial' ELSE 'failure' END AS outcome,
       ARR('user', CASE WHEN sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) > 0 THEN 'system' ELSE 'plain' END,
           CASE WHEN sum(length(text)) > 2000 THEN 'long' ELSE 'brief' END) AS tags,
       conv_id AS seq FROM conversations GROUP BY conv_id""",
}

# The same rows as Spark derives them at size: line items meet the paths of their part once, before
# the window that pairs consecutive lines, and each line then gives its document, supplier and import
# edges. The joins shuffle at any size of part.
_SMALL_EDGES = "\nUNION ALL\n".join(VIEWS["v_edges"].split("\nUNION ALL\n")[:-3])
SPARK_VIEWS: dict[str, str] = {
    "v_part_paths": """
SELECT p_partkey, transform(collect_list(struct(path)), p -> p.path) AS paths FROM v_part GROUP BY p_partkey""",
    "v_line_paths": f"""
SELECT l_orderkey, l_suppkey, returned, l_discount, l_tax, {_PART_KEY_SEQ} AS seq, coalesce(paths, array()) AS paths,
       coalesce(lead(paths) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), array()) AS onward
FROM (SELECT /*+ SHUFFLE_HASH(v_part_paths) */ l_orderkey, l_linenumber, l_partkey, l_suppkey, returned, l_discount,
             l_tax, paths
      FROM (SELECT *, l_returnflag = 'R' AS returned FROM lineitem) l LEFT JOIN v_part_paths ON l_partkey = p_partkey) t""",
    "v_edges": f"""{_SMALL_EDGES}
UNION ALL
SELECT CASE k WHEN 0 THEN 'document:o' || CAST(l_orderkey AS STRING) WHEN 1 THEN 'step:s' || CAST(l_suppkey AS STRING)
              ELSE 'file:' || p END,
       'file:' || CASE WHEN k < 2 THEN p ELSE q END, CASE k WHEN 0 THEN 'documents' WHEN 1 THEN 'serves' ELSE 'imports' END,
       CASE WHEN k = 1 AND returned THEN 'bidirectional' ELSE 'forward' END,
       CASE WHEN k = 1 THEN l_tax ELSE l_discount END, NULL, seq * 4 + least(k, 2)
FROM v_line_paths LATERAL VIEW explode(paths) a AS p
     LATERAL VIEW posexplode(concat(array(CAST(NULL AS STRING), CAST(NULL AS STRING)), onward)) b AS k, q""",
}
