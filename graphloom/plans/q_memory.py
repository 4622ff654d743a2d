"""Queries: memory tables (FN16-FN18, MM, GA14-GA16, WN5-WN12, ST5, ST7, SS1, SS5)."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.functions import memory as fm
from graphloom.operators import memory as mem
from graphloom.operators import ranking
from graphloom.plans.fixtures import VIEWS
from graphloom.plans.registry import query

NOW = dt.datetime(2024, 6, 1)
T = "TIMESTAMP '2024-06-01'"
_IDLE = f"(epoch_us({T}) - epoch_us(last_accessed_at)) / 8.64e10"


@query(
    "fn16_confidence",
    f"""SELECT id, round(CASE WHEN {_IDLE} <= 0 THEN confidence ELSE confidence * pow(0.5, {_IDLE} / 60) END, 6) AS decayed,
      round(least(1, confidence + 0.05 * ln(1 + access_count)), 6)::DOUBLE AS boosted,
      round(least(1, CASE WHEN {_IDLE} <= 0 THEN confidence ELSE confidence * pow(0.5, {_IDLE} / 60) END + 0.05 * ln(1 + access_count)), 6)::DOUBLE AS projected FROM v_memory""",
)
def _(get):
    m = get("v_memory")
    idle = (F.unix_micros(F.lit(NOW)) - F.unix_micros("last_accessed_at")) / 8.64e10
    c, n = F.col("confidence"), F.col("access_count")
    return m.select(
        "id", F.round(fm.decay(c, idle), 6).alias("decayed"), F.round(fm.boost(c, n), 6).alias("boosted"),
        F.round(fm.projected(c, idle, n), 6).alias("projected"),
    )


@query(
    "fn17_effective_score",
    f"""SELECT id, round(CASE WHEN lifecycle IN ('evicted','archived') THEN 0 ELSE confidence / (1 + greatest(0, {_IDLE}) / 30) END, 6)::DOUBLE AS score FROM v_memory""",
)
def _(get):
    s = fm.effective_score(F.col("confidence"), F.col("lifecycle"), F.col("last_accessed_at"), F.lit(NOW))
    return get("v_memory").select("id", F.round(s, 6).alias("score"))


O_SWEEP = f"""o_sw AS (SELECT id, lifecycle AS old, CASE WHEN lifecycle = 'stale' AND {_IDLE} >= 90 THEN 'evicted'
  WHEN lifecycle = 'active' AND {_IDLE} >= 30 THEN 'stale' ELSE lifecycle END AS new FROM v_memory)"""


@query("fn18_suggested_lifecycle", f"WITH {O_SWEEP} SELECT id, new AS lifecycle FROM o_sw")
def _(get):
    s = fm.suggested_lifecycle(F.col("lifecycle"), F.col("last_accessed_at"), F.lit(NOW))
    return get("v_memory").select("id", s.alias("lifecycle"))


@query("mm4_lifecycle_sweep", f"WITH {O_SWEEP} SELECT * FROM o_sw WHERE old <> new")
def _(get):
    return mem.lifecycle_sweep(get("v_memory"), NOW)


VIEWS["v_transitions"] = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'consolidated' WHEN 2 THEN 'stale' WHEN 3 THEN 'evicted' ELSE 'archived' END AS old,
 CASE user_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'consolidated' WHEN 2 THEN 'stale' WHEN 3 THEN 'evicted' ELSE 'archived' END AS new FROM events"""


@query(
    "fn18_illegal_transitions",
    """SELECT id, old, new FROM v_transitions WHERE NOT ((old = 'active' AND new <> 'active') OR (old = 'consolidated' AND new <> 'consolidated')
      OR (old = 'stale' AND new IN ('active','evicted','archived')) OR (old = 'evicted' AND new = 'archived') OR (old = 'archived' AND new = 'evicted'))""",
)
def _(get):
    return mem.illegal_transitions(get("v_transitions"))


VIEWS["v_memory_copy"] = """SELECT 'n' || id AS id, CASE WHEN seq % 3 = 0 THEN content || '!' ELSE content END AS content,
  CASE WHEN seq % 7 = 0 THEN 'src1' ELSE scope END AS scope, seq FROM v_memory"""
O_MM1 = """o_k AS (SELECT scope, content, arg_min(id, seq) AS first_id FROM v_memory_copy GROUP BY 1, 2),
 o_h AS (SELECT scope, content, arg_min(id, seq) AS held FROM v_memory WHERE confidence < 0.5 GROUP BY 1, 2),
 o_w AS (SELECT k.scope, k.content, coalesce(held, first_id) AS kept_id, held IS NULL AS is_new FROM o_k k LEFT JOIN o_h h ON h.scope = k.scope AND h.content = k.content)"""


def _mm1(get):
    return mem.insert_if_new(get("v_memory").filter("confidence < 0.5"), get("v_memory_copy"))


@query("mm1_inserted", f"WITH {O_MM1} SELECT m.id, m.scope FROM v_memory_copy m JOIN o_w w ON w.kept_id = m.id WHERE is_new")
def _(get):
    return _mm1(get)[0].select("id", "scope")


@query(
    "mm1_report",
    f"WITH {O_MM1} SELECT m.id, is_new AND m.id = kept_id AS inserted, kept_id FROM v_memory_copy m JOIN o_w w ON w.scope = m.scope AND w.content = m.content",
)
def _(get):
    return _mm1(get)[1]


@query(
    "mm2_touch",
    """WITH o_a AS (SELECT user_id::VARCHAR AS id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1)
    SELECT m.id, access_count + coalesce(n, 0) AS access_count, strftime(greatest(last_accessed_at, coalesce(last, last_accessed_at)), '%Y-%m-%d %H:%M:%S') AS last
    FROM v_memory m LEFT JOIN o_a USING (id)""",
)
def _(get):
    accesses = get("events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return mem.touch(get("v_memory"), accesses).select(
        "id", "access_count", F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last")
    )


_POLICIES = [
    {"scope": "src1", "max_age_days": 140, "archive_after_days": 120, "max_entries": 20},
    {"scope": "src2", "max_age_days": 0, "archive_after_days": 130, "max_entries": 15},
    {"scope": "src3"},
    {"scope": None, "max_age_days": 145, "max_entries": 25},
]
O_MM3 = f"""o_p AS (SELECT id, scope, lifecycle, created_at, seq, (epoch_us({T}) - epoch_us(created_at)) / 8.64e10 AS age,
   CASE scope WHEN 'src1' THEN 140 WHEN 'src2' THEN NULL WHEN 'src3' THEN NULL ELSE 145 END AS max_age,
   CASE scope WHEN 'src1' THEN 120 WHEN 'src2' THEN 130 ELSE NULL END AS arch,
   CASE scope WHEN 'src1' THEN 20 WHEN 'src2' THEN 15 WHEN 'src3' THEN NULL ELSE 25 END AS cap FROM v_memory),
 o_a AS (SELECT *, coalesce(age >= arch AND lifecycle <> 'archived', false) AS archived, coalesce(age >= max_age, false) AS aged FROM o_p),
 o_o AS (SELECT id FROM (SELECT id, cap, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, seq DESC) AS rn FROM o_a
   WHERE NOT archived AND NOT aged AND lifecycle NOT IN ('evicted','archived') AND cap IS NOT NULL) WHERE rn > cap),
 o_r AS (SELECT id, scope, archived, aged OR id IN (SELECT id FROM o_o) AS evicted FROM o_a)"""


@query("mm3_retention", f"WITH {O_MM3} SELECT * FROM o_r")
def _(get):
    return mem.retention(get("v_memory"), _POLICIES, NOW)


@query("mm3_retention_counts", f"WITH {O_MM3} SELECT count(*) FILTER (evicted) AS evicted, count(*) FILTER (archived) AS archived, count(*) AS total FROM o_r")
def _(get):
    return mem.retention_counts(mem.retention(get("v_memory"), _POLICIES, NOW))


@query(
    "wn5_newest_cap",
    """SELECT id, scope FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, seq DESC) AS rn FROM v_memory) WHERE rn > 30""",
)
def _(get):
    return mem.newest_cap(get("v_memory"), F.lit(30)).select("id", "scope")


@query("wn6_last_audit", "SELECT id, max(seq) AS seq, arg_max(op, seq) AS op FROM v_audit GROUP BY 1")
def _(get):
    return mem.last_audit(get("v_audit")).select("id", "seq", "op")


O_LAST_BIRTH = """o_c AS (SELECT *, CASE WHEN entity <> 'memory' THEN 'skipped' WHEN op = 'create' AND new IS NULL THEN 'error'
   WHEN op IN ('create','delete','update') THEN 'applied' ELSE 'error' END AS outcome FROM v_audit),
 o_b AS (SELECT id, max(seq) AS born, arg_max(op, seq) AS op, arg_max({n: new}, seq).n AS content FROM o_c WHERE outcome = 'applied' AND op IN ('create','delete') GROUP BY 1),
 o_l AS (SELECT b.id, b.born, b.content, coalesce((SELECT arg_max(new, seq) FROM o_c c WHERE c.id = b.id AND c.outcome = 'applied' AND c.field = 'lifecycle' AND c.op = 'update' AND c.seq > b.born), 'active') AS lifecycle
   FROM o_b b WHERE op = 'create'),
 o_s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY born, id) AS rn FROM o_l) WHERE rn = 1)"""


#: The log run op by op, with the live entries and the last holder of each content.
O_MM5 = """WITH RECURSIVE o_ops AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS k, id, op, new AS content, seq FROM v_audit
   WHERE entity = 'memory' AND (op = 'delete' OR (op = 'create' AND new IS NOT NULL))),
 o_run AS (SELECT CAST(0 AS BIGINT) AS k, CAST(MAP {} AS MAP(VARCHAR, STRUCT(content VARCHAR, born BIGINT))) AS ents, CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) AS holds
   UNION ALL
   SELECT k, CASE WHEN op = 'delete' THEN map_from_entries(list_filter(map_entries(ents), lambda e: e.key <> id))
                  WHEN refused THEN ents ELSE map_concat(ents, MAP {id: {content: content, born: seq}}) END,
          CASE WHEN op = 'delete' THEN CASE WHEN ents[id] IS NULL THEN holds ELSE map_from_entries(list_filter(map_entries(holds), lambda e: e.key <> ents[id].content)) END
               WHEN refused THEN holds ELSE map_concat(holds, MAP {content: id}) END
   FROM (SELECT o.*, ents, holds, op = 'create' AND holds[o.content] IS NOT NULL AND holds[o.content] <> id AND ents[holds[o.content]] IS NOT NULL AS refused
         FROM o_run r JOIN o_ops o ON o.k = r.k + 1)),
 o_live AS (SELECT e.key AS id, e.value.content AS content, e.value.born AS born FROM (SELECT unnest(map_entries(ents)) AS e FROM o_run WHERE k = (SELECT max(k) FROM o_run)))"""


@query(
    "mm5_replay_state",
    f"""{O_MM5} SELECT l.id, l.content, coalesce(arg_max(a.new, a.seq), 'active') AS lifecycle, l.born FROM o_live l
    LEFT JOIN v_audit a ON a.id = l.id AND a.seq > l.born AND a.entity = 'memory' AND a.op = 'update' AND a.field = 'lifecycle' AND a.new IS NOT NULL
    GROUP BY ALL""",
)
def _(get):
    return mem.replay(get("v_audit"), ["memory"]).select("id", "content", "lifecycle", "born")


@query("mm5_replay_counts", f"WITH {O_LAST_BIRTH} SELECT outcome, count(*) AS n FROM o_c GROUP BY 1")
def _(get):
    return mem.classify_audit(get("v_audit"), ["memory"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("mm6_session_archive", "SELECT id, greatest(0, end_ms - start_ms)::BIGINT AS duration_ms, outcome FROM v_sessions")
def _(get):
    return mem.archive_sessions(get("v_sessions")).select("id", "duration_ms", "outcome")


O_GA14 = """o_g AS (SELECT scope, count(*) AS n, round(avg(confidence), 6) AS confidence, arg_max(id, (access_count, -seq)) AS top_id FROM v_memory GROUP BY 1),
 o_t AS (SELECT scope, tag, count(*) AS n_tag, min(seq * 10 + i) AS f FROM (SELECT scope, seq, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM v_memory) GROUP BY 1, 2),
 o_cm AS (SELECT t.scope, t.tag, t.n_tag, f FROM o_t t JOIN o_g g ON g.scope = t.scope WHERE n_tag >= ceil(n / 2))"""


@query(
    "ga14_lessons",
    f"""WITH {O_GA14} SELECT g.scope, g.n, g.confidence, g.top_id, coalesce((SELECT arg_min(tag, f) FROM o_cm c WHERE c.scope = g.scope) || ' insight', left(m.content, 60)) AS title
    FROM o_g g JOIN v_memory m ON m.id = g.top_id""",
)
def _(get):
    lessons, _, _ = mem.crystallise(get("v_memory"), "scope")
    return lessons.select("scope", "n", F.round("confidence", 6).alias("confidence"), "top_id", "title")


@query(
    "ud1_lesson_contents",
    f"""WITH {O_GA14}, o_tags AS (SELECT scope, string_agg(tag, ', ' ORDER BY f, tag) AS tags FROM o_cm GROUP BY 1)
    SELECT v.scope, count(*) || ' entries, first ' || arg_min(id, seq) || ', on ' || coalesce(any_value(t.tags), 'nothing') AS content
    FROM v_memory v LEFT JOIN o_tags t ON t.scope = v.scope GROUP BY 1""",
)
def _(get):
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("nothing")
    return mem.lesson_contents(
        get("v_memory"), "scope", {"n": F.count("*"), "first": F.min_by("id", "seq")},
        F.concat("n", F.lit(" entries, first "), "first", F.lit(", on "), tags),
    )


@query("ga14_common_tags", f"WITH {O_GA14} SELECT scope, tag, n_tag FROM o_cm")
def _(get):
    return mem.crystallise(get("v_memory"), "scope")[1]


@query(
    "ga14_examples",
    """SELECT scope, rn::INT AS rank, id AS memory_id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS rn FROM v_memory) WHERE rn <= 5""",
)
def _(get):
    return mem.crystallise(get("v_memory"), "scope")[2].select("scope", "rank", "memory_id")


@query(
    "ga15_consolidated",
    """WITH o_old AS (SELECT scope AS lesson_id, id AS memory_id, row_number() OVER (PARTITION BY scope ORDER BY seq) - 1 AS pos FROM v_memory WHERE lifecycle = 'active'),
     o_n AS (SELECT lesson_id, count(*) AS n FROM o_old GROUP BY 1)
    SELECT lesson_id, pos, memory_id FROM o_old UNION ALL SELECT scope, coalesce(n, 0) + row_number() OVER (PARTITION BY scope ORDER BY seq) - 1, id FROM v_memory LEFT JOIN o_n ON lesson_id = scope WHERE lifecycle = 'stale'""",
)
def _(get):
    return _consolidated(get)[1]


@query(
    "ga15_consolidated_examples",
    """WITH o_r AS (SELECT scope AS lesson_id, id AS memory_id, left(content, 80) AS excerpt, lifecycle,
       row_number() OVER (PARTITION BY scope, lifecycle ORDER BY seq) AS i FROM v_memory WHERE lifecycle IN ('active', 'stale')),
     o_old AS (SELECT lesson_id, i - 1 AS pos, memory_id, excerpt FROM o_r WHERE lifecycle = 'active' AND i <= 5),
     o_n AS (SELECT lesson_id, count(*) AS n FROM o_old GROUP BY 1)
    SELECT lesson_id, pos, memory_id, excerpt FROM o_old
    UNION ALL SELECT lesson_id, coalesce(n, 0) + i - 1, memory_id, excerpt FROM o_r LEFT JOIN o_n USING (lesson_id) WHERE lifecycle = 'stale' AND i <= 5""",
)
def _(get):
    return _consolidated(get)[2]


def _consolidated(get):
    m = get("v_memory").select(F.col("scope").alias("lesson_id"), F.col("id").alias("memory_id"), "seq", "content", "lifecycle")
    old = ranking.row_numbers(m.filter("lifecycle = 'active'"), ["lesson_id"], ["seq"], "pos").withColumn("pos", F.col("pos") - 1)
    lessons = old.select("lesson_id").distinct().withColumn("version", F.lit(1))
    examples = old.filter("pos < 5").withColumn("excerpt", F.substring("content", 1, 80))
    return mem.consolidate(lessons, old, examples, m.filter("lifecycle = 'stale'").drop("lifecycle"))


O_GA16 = """o_c AS (SELECT tag, count(*) AS n, avg(confidence) AS c FROM (SELECT confidence, unnest(tags) AS tag FROM v_memory WHERE lifecycle = 'active') GROUP BY 1)"""


@query("ga16_tag_clusters", f"WITH {O_GA16} SELECT tag, n, round(c, 6) AS avg_confidence, n >= 3 AND c >= 0.45 AS should_crystallise FROM o_c")
def _(get):
    r = mem.tag_clusters(get("v_memory"), 3, 0.45)
    return r.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "ga16_cluster_lessons",
    f"""WITH {O_GA16} SELECT tag AS cluster, n, (SELECT arg_max(id, (access_count, -seq)) FROM v_memory WHERE lifecycle = 'active' AND list_contains(tags, tag)) AS top_id FROM o_c WHERE n >= 3 AND c >= 0.45""",
)
def _(get):
    return mem.crystallise_clusters(get("v_memory"), threshold=3, min_confidence=0.45).select("cluster", "n", "top_id")


VIEWS["v_facts"] = """SELECT CAST(user_id AS STRING) AS key, props AS value, CASE WHEN event_id % 4 = 0 THEN event_type ELSE NULL END AS category,
  CASE WHEN event_id % 7 = 0 THEN 's' || CAST(event_id AS STRING) ELSE NULL END AS source, CASE WHEN event_id % 5 = 0 THEN value ELSE NULL END AS confidence, event_id AS seq FROM events"""


@query(
    "wn12_versioned_facts",
    """SELECT key, arg_max(value, seq) AS value, coalesce(arg_max(category, seq), 'config') AS category, arg_max(source, seq) AS source,
     coalesce(arg_max(confidence, seq), 1.0) AS confidence, count(*) AS version FROM v_facts GROUP BY 1""",
)
def _(get):
    return mem.versioned_facts(get("v_facts"))


@query(
    "wn12_fact_versions",
    """SELECT key, seq, row_number() OVER w AS version, last_value(category IGNORE NULLS) OVER w AS category, last_value(source IGNORE NULLS) OVER w AS source
    FROM v_facts WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(get):
    return mem.fact_versions(get("v_facts")).select("key", "seq", "version", "category", "source")


def _cascade(get):
    m = get("v_memory")
    ids = m.filter("lifecycle = 'evicted'").select("id")
    edges = m.select(F.col("id").alias("source"), (F.col("seq") + 1).cast("string").alias("target"), "seq")
    return mem.cascade_delete(ids, {
        "memory": m, "edges": edges,
        "lesson_members": m.select((F.col("seq") % 300).alias("lesson_id"), F.col("id").alias("memory_id")),
        "insights": m.select(F.col("id").alias("skill")), "audit": get("v_audit"),
        "session_members": get("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("string").alias("memory_id")),
    })


@query(
    "st5_cascade_counts",
    """WITH o_g AS (SELECT id FROM v_memory WHERE lifecycle = 'evicted')
    SELECT 'entries' AS target, count(*) AS n FROM o_g
    UNION ALL SELECT 'edges', count(*) FROM v_memory WHERE id IN (SELECT id FROM o_g) OR (seq + 1)::VARCHAR IN (SELECT id FROM o_g)
    UNION ALL SELECT 'lessons', count(DISTINCT seq % 300) FROM v_memory WHERE id IN (SELECT id FROM o_g)
    UNION ALL SELECT 'insights', count(*) FROM o_g UNION ALL SELECT 'audits', count(*) FROM v_audit WHERE id IN (SELECT id FROM o_g)
    UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations WHERE turn::VARCHAR IN (SELECT id FROM o_g)""",
)
def _(get):
    return _cascade(get)[1]


@query(
    "st5_cascade_edges",
    """WITH o_g AS (SELECT id FROM v_memory WHERE lifecycle = 'evicted') SELECT id AS source, seq FROM v_memory WHERE id NOT IN (SELECT id FROM o_g) AND (seq + 1)::VARCHAR NOT IN (SELECT id FROM o_g)""",
)
def _(get):
    return _cascade(get)[0]["edges"].select("source", "seq")


@query(
    "st7_shared_rows",
    """SELECT a || '_' || id AS id, a AS agent, array_to_string(list_append(tags, 'from:x'), ',') AS tags FROM v_memory, (VALUES ('y'), ('z')) AS t(a)""",
)
def _(get):
    s = mem.share(get("v_memory"), ["x", "y", "z"], "x")
    return s.select("id", "agent", F.array_join("tags", ",").alias("tags"))


@query("ss5_inbox_since", "SELECT event_id FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-10 12:00:00'")
def _(get):
    msgs = get("events").select("event_id", F.col("event_type").alias("agent"), F.col("ts").cast("timestamp").alias("ts"))
    return mem.inbox_since(msgs, "view", dt.datetime(2024, 1, 10, 12)).select("event_id")


@query(
    "ss1_live_slots",
    """WITH o_l AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY last_updated_at DESC, seq DESC) AS rn FROM v_slots)
    SELECT scope, key, value, seq FROM o_l WHERE rn = 1 AND (epoch_us((SELECT max(last_updated_at) FROM v_slots)) - epoch_us(last_updated_at)) / 1000 <= ttl_ms""",
)
def _(get):
    slots = get("v_slots")
    now = slots.agg(F.max("last_updated_at")).first()[0]
    return mem.live_slots(slots, now).select("scope", "key", "value", "seq")


@query(
    "wn7_chunks",
    """SELECT path, floor((row_number() OVER (PARTITION BY file_category ORDER BY path) - 1) / 12)::BIGINT AS chunk FROM v_files""",
)
def _(get):
    from graphloom.operators import batching

    return batching.chunk_groups(get("v_files"), ["file_category"], ["path"], 12).select("path", "chunk")


@query(
    "wn8_even_split",
    """WITH o_r AS (SELECT path, file_category, row_number() OVER (PARTITION BY file_category ORDER BY path) AS rn, count(*) OVER (PARTITION BY file_category) AS n FROM v_files)
    SELECT path, CASE WHEN n > 35 THEN floor((rn - 1) / ceil(n / ceil(n / 35)))::BIGINT ELSE 0 END AS part FROM o_r""",
)
def _(get):
    from graphloom.operators import batching

    return batching.even_split(get("v_files"), "file_category", ["path"], 35).select("path", "part")


@query("wn9_renumbered", "SELECT folder, dense_rank() OVER (ORDER BY folder)::BIGINT AS number FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM v_files)")
def _(get):
    from graphloom.operators import batching

    return batching.renumber(get("v_files").withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")), "folder", "number").select("folder", "number").distinct()
