"""Queries: streams run to completion over the available input (SS1-SS4)."""

import uuid

from pyspark.sql import functions as F

from graphloom.operators import memory as mem
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.q_memory import O_LAST_BIRTH
from graphloom.plans.registry import ORACLES, query
from graphloom.session import shared_dir
from graphloom.streaming import tables


def _as_stream(df, order, slices=3, rows_per_file=1_000_000):
    """The table as a stream of micro-batches in ``order``, each read by as many
    tasks as its rows need."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = -(-df.count() // (slices * rows_per_file)) or 1
    cuts = df.stat.approxQuantile(order, [k / slices for k in range(1, slices)], 0.01)
    for k in range(slices):
        part = df
        if k:
            part = part.filter(F.col(order) > cuts[k - 1])
        if k + 1 < slices:
            part = part.filter(F.col(order) <= cuts[k])
        part.repartition(files).write.mode("append").parquet(f"{root}/in")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    return rows, root


def _table(stream, root, keys):
    q = tables.append_to(stream, f"{root}/state")
    q.awaitTermination()
    return tables.latest(stream.sparkSession, f"{root}/state", keys)


@query("ss1_stream_slots", ORACLES["ss1_live_slots"])
def _(get):
    slots = get("v_slots")
    rows, root = _as_stream(slots, "seq")
    state = _table(tables.slot_changes(rows, "1 hour"), root, ("scope", "key"))
    now = slots.agg(F.max("last_updated_at")).first()[0]
    return mem.live_slots(state, now).select("scope", "key", "value", "seq")


@query(
    "ss1_expired_slots",
    """WITH o_w AS (SELECT *, CAST(floor(epoch_us(last_updated_at) / 1000) AS BIGINT) + ttl_ms + 1 AS ends,
      lead(last_updated_at) OVER (PARTITION BY scope, key ORDER BY last_updated_at, seq) AS next_at FROM v_slots)
    SELECT count(*) AS n FROM o_w WHERE next_at IS NULL AND ends <= (SELECT CAST(floor(epoch_us(max(last_updated_at)) / 1000) AS BIGINT) - 3600000 FROM v_slots)""",
)
def _(get):
    """Slots that have left the state at the end of the stream."""
    rows, root = _as_stream(get("v_slots"), "seq")
    q = tables.append_to(tables.slot_changes(rows, "1 hour"), f"{root}/state")
    q.awaitTermination()
    said = rows.sparkSession.read.parquet(f"{root}/state/rows")
    last = said.groupBy("scope", "key").agg(F.max_by("gone", F.struct("last_updated_at", "seq", "gone")).alias("gone"))
    return last.agg(F.count_if("gone").alias("n"))


@query("ss2_stream_dedup", "SELECT DISTINCT scope, sha256(content) AS fingerprint FROM v_memory")
def _(get):
    rows, root = _as_stream(get("v_memory").select("id", "scope", "content", "created_at", "seq"), "seq")
    out = tables.stream_dedup(rows, "3650 days", "created_at").select("scope", "fingerprint")
    tables.append_to(out, root).awaitTermination()
    return rows.sparkSession.read.parquet(f"{root}/rows")


@query("ss3_stream_replay", f"WITH {O_LAST_BIRTH} SELECT id, content, lifecycle, born FROM o_s")
def _(get):
    rows, root = _as_stream(get("v_audit").filter("entity = 'memory'"), "seq")
    return tables.audit_state(_table(tables.audit_changes(rows), root, ("id",))).select("id", "content", "lifecycle", "born")


VIEWS["v_file_events"] = """SELECT 'd' || CAST(doc_id AS STRING) AS path, text AS content, doc_id AS seq FROM documents
 UNION ALL SELECT 'd' || CAST(doc_id AS STRING), CASE WHEN lang = 'en' THEN text || ' tail' WHEN lang = 'fr' THEN 'Changed ' || text WHEN lang = 'de' THEN NULL ELSE text END, 1000000000 + doc_id FROM documents"""


@query(
    "ss4_stream_file_patch",
    """WITH o_f AS (SELECT *, sha256(content) AS h, split_part(content, ' ', 1) AS sig FROM v_file_events),
    o_old AS (SELECT * FROM o_f WHERE seq < 1000000000), o_new AS (SELECT * FROM o_f WHERE seq >= 1000000000)
    SELECT n.path, n.h AS content_hash, CASE WHEN n.h IS NULL THEN 'deleted' WHEN o.h IS NULL THEN 'new' WHEN n.h = o.h THEN 'unchanged'
      WHEN n.sig = o.sig THEN 'cosmetic' ELSE 'structural' END AS status FROM o_new n JOIN o_old o USING (path)""",
)
def _(get):
    events = get("v_file_events").select(
        "path", F.sha2("content", 256).alias("content_hash"), F.split_part("content", F.lit(" "), F.lit(1)).alias("signature"), "seq"
    )
    rows, root = _as_stream(events, "seq", 2)  # first the files, then their changes
    return _table(tables.file_changes(rows), root, ("path",)).select("path", "content_hash", "status")
