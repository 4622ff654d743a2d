"""Queries: sources and sinks (IO)."""

from pyspark.sql import functions as F

from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query
from graphloom.session import shared_dir
from graphloom.sources import graph_json, stores


def _folder(df, name):
    import uuid

    return f"{shared_dir(df.sparkSession)}/io-{name}-{uuid.uuid4().hex}"


@query(
    "io2_stored_paths",
    """SELECT seq, CASE seq % 3 WHEN 0 THEN path WHEN 1 THEN split_part(path, '/', -1) ELSE path END AS file_path FROM v_files""",
)
def _(get):
    k = F.col("seq") % 3
    raw = F.when(k == 0, F.concat(F.lit("/srv/app/"), "path")).when(k == 1, F.concat(F.lit("/etc/"), "path")).otherwise(F.col("path"))
    return get("v_files").select("seq", graph_json.stored_path(raw, "/srv/app").alias("file_path"))


VIEWS["v_parts"] = "SELECT CAST(l_orderkey AS INT) AS batch, l_linenumber AS part FROM lineitem"


@query(
    "io4_missing_parts",
    """SELECT batch, part::INT AS part FROM (SELECT batch, unnest(range(1, max(part) + 1)) AS part FROM v_parts GROUP BY batch) w
    WHERE NOT EXISTS (SELECT 1 FROM v_parts p WHERE p.batch = w.batch AND p.part = w.part)""",
)
def _(get):
    return graph_json.missing_parts(get("v_parts"))


@query("io5_audit_roundtrip", "SELECT seq, op, id, new FROM v_audit")
def _(get):
    audit = get("v_audit")
    path = _folder(audit, "audit")
    stores.write_audit(audit, path)
    return stores.read_audit(audit.sparkSession, path).select("seq", "op", "id", "new")


@query(
    "io6_import",
    """WITH o_k AS (SELECT scope, content, arg_min(seq, seq) AS seq FROM v_memory WHERE scope <> 'src2' GROUP BY 1, 2)
    SELECT seq, scope FROM o_k WHERE (scope, content) NOT IN (SELECT (scope, content) FROM v_memory WHERE confidence < 0.3)""",
)
def _(get):
    m = get("v_memory")
    exported = stores.export_rows(m).withColumn(
        "version", F.when(F.col("scope") == "src2", "0.1.0").otherwise(F.col("version"))
    )
    return stores.import_rows(m.filter("confidence < 0.3"), exported)[0].select("seq", "scope")


@query("io7_migrate", "SELECT id, '0.9.0' AS version, CASE WHEN seq % 2 = 0 THEN 'migrated' ELSE 'kept' END AS note FROM v_memory")
def _(get):
    rows = get("v_memory").select(
        "id", F.when(F.col("seq") % 2 == 0, "0.8.0").otherwise("0.9.0").alias("version"), F.lit("kept").alias("note")
    )
    return stores.migrate(rows, {"0.8.0": ("0.9.0", lambda df: df.withColumn("note", F.lit("migrated")))})


@query("io8_restore", "SELECT id, scope, 'active' AS lifecycle, 0::BIGINT AS access_count FROM v_memory")
def _(get):
    m = get("v_memory")
    path = _folder(m, "snap")
    stores.capture(m, path, "snap_1", "2024-06-01")
    rows = m.sparkSession.read.parquet(path).filter("snapshot_id = 'snap_1'")
    return stores.restore(rows).select("id", "scope", "lifecycle", "access_count")


@query("io1_graph_json", "SELECT id, type, name, file_path FROM v_nodes")
def _(get):
    nodes = get("v_nodes")
    path = _folder(nodes, "graph")
    # as many documents as keep each at about 256 nodes
    parts = nodes.count() // 256 + 1
    node = F.struct("id", "type", "name", F.col("file_path").alias("filePath"), "summary", "tags", "complexity")
    docs = nodes.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("doc")).agg(F.collect_list(node).alias("nodes"))
    docs.select("nodes", F.array().cast("array<struct<source:string>>").alias("edges")).write.json(path)
    back = (
        nodes.sparkSession.read.schema(graph_json.GRAPH).json(path).withColumn("file", F.col("_metadata.file_name"))
    )
    return graph_json.graph_tables(back)["nodes"].select("id", "type", "name", "file_path")


@query(
    "io3_batch_edges",
    """SELECT (seq % (SELECT count(*) // 512 + 1 FROM v_edges))::INT AS batch, (seq // 7 % 2 + 1)::INT AS part, source, target, type, direction FROM v_edges""",
)
def _(get):
    edges = get("v_edges")
    path = _folder(edges, "batches")
    # as many batches of two parts as keep each part at about 256 edges
    batches = edges.count() // 512 + 1
    part = F.floor(F.col("seq") / 7) % 2 + 1
    edge = F.struct("source", "target", "type", "direction", "weight")
    none = F.array().cast("array<struct<id:string>>")
    parts = edges.groupBy(F.concat(F.lit("batch-"), F.col("seq") % batches, F.lit("-part-"), part, F.lit(".json")).alias("name")).agg(
        F.to_json(F.struct(none.alias("nodes"), F.collect_list(edge).alias("edges"))).alias("value"))
    # a malformed file beside every batch, and files of other names, must not count
    broken = parts.select(F.regexp_replace("name", "part-.*", "part-77.json").alias("name"), F.lit("{broken").alias("value")).distinct()
    other = F.struct(F.concat(F.lit("other-"), "name").alias("name"), "value")
    both = parts.select(F.inline(F.array(F.struct("name", "value"), other)))
    graph_json.write_documents(both.unionByName(broken), path)
    docs = graph_json.read_batches(edges.sparkSession, path, nested=True)
    found = graph_json.graph_tables(docs)["edges"]
    # the file name says batch and part, so the edges need not meet the documents again
    return found.withColumns(graph_json.batch_numbers(F.col("file"))).select("batch", "part", "source", "target", "type", "direction")
