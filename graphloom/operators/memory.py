"""Jobs over the memory tables (MM, GA14-GA16, WN5, WN6, WN12, ST5, ST7, SS1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import memory as fm
from graphloom.functions.columns import days_between
from graphloom.functions.hashing import content_key
from graphloom.operators.dedup import pick_one
from graphloom.operators.graphalg import components
from graphloom.operators.ranking import row_numbers, top_k
from graphloom.session import checkpointed


def insert_if_new(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row per (scope, content) enters (MM1). Returns the inserted rows
    and a report ``(id, inserted, kept_id)`` over all incoming rows."""
    key = ["scope", "fingerprint"]
    keyed = incoming.withColumn("fingerprint", content_key(F.col("content")))
    held = (
        existing.withColumn("fingerprint", content_key(F.col("content")))
        .groupBy(*key).agg(F.min_by("id", "seq").alias("held_id"))
    )
    # winners: one row per content, whatever the number of copies
    winners = keyed.groupBy(*key).agg(F.min_by("id", "seq").alias("first_id")).join(held, key, "left")
    kept = winners.select(*key, F.coalesce("held_id", "first_id").alias("kept_id"), F.col("held_id").isNull().alias("is_new"))
    report = keyed.select("id", *key).join(kept, key).select(
        "id", (F.col("is_new") & (F.col("id") == F.col("kept_id"))).alias("inserted"), "kept_id"
    )
    inserted = keyed.join(kept.filter("is_new").select(F.col("kept_id").alias("id")), "id", "left_semi")
    return inserted.select(*incoming.columns, "fingerprint"), report


def touch(memory: DataFrame, accesses: DataFrame) -> DataFrame:
    """Count and last time of access events ``accesses(id, ts)`` (MM2)."""
    seen = accesses.groupBy("id").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    joined = memory.join(seen, "id", "left").withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)),
            "last_accessed_at": F.greatest("last_accessed_at", "_last"),
        }
    )
    return joined.select(*memory.columns)


def newest_cap(rows: DataFrame, cap: Column, order: str = "created_at") -> DataFrame:
    """Rows beyond the newest ``cap`` of their scope (WN5). A scope may hold a
    third of the table, so ranks come from range partitions."""
    keyed = rows.withColumn("_ts", -F.unix_micros(order)).withColumn("_seq", -F.col("seq")).withColumn("_cap", cap)
    ranked = row_numbers(keyed.filter("_cap > 0"), ["scope"], ["_ts", "_seq"], "_rank")
    return ranked.filter("_rank > _cap").select(*rows.columns)


def retention(memory: DataFrame, policies: list[dict], now) -> DataFrame:
    """Fate of each row under scope policies (MM3).

    ``policies`` are dicts with scope (None for the default), max_age_days,
    archive_after_days and max_entries. An aged row counts as archived and as
    evicted; the cap then drops the oldest of what is left.
    """

    def setting(name: str) -> Column:
        default = next((p.get(name) for p in policies if p["scope"] is None), None)
        out = F.when(F.lit(False), F.lit(None))
        for p in policies:
            if p["scope"] is not None:
                out = out.when(F.col("scope") == p["scope"], F.lit(p.get(name)))
        # a zero limit means no limit
        return F.nullif(out.otherwise(F.lit(default)).cast("double"), F.lit(0.0))

    age = days_between(F.lit(now), F.col("created_at"))
    aged = memory.select("id", "scope", "lifecycle", "created_at", "seq").withColumns(
        {
            "archived": F.coalesce((age >= setting("archive_after_days")) & (F.col("lifecycle") != "archived"), F.lit(False)),
            "aged_out": F.coalesce(age >= setting("max_age_days"), F.lit(False)),
            "cap": setting("max_entries"),
        }
    )
    live = aged.filter("NOT archived AND NOT aged_out AND lifecycle NOT IN ('evicted', 'archived') AND cap IS NOT NULL")
    over = newest_cap(live, F.col("cap")).select("id", F.lit(True).alias("_over"))
    return aged.join(over, "id", "left").select(
        "id", "scope", "archived", (F.col("aged_out") | F.coalesce("_over", F.lit(False))).alias("evicted")
    )


def retention_counts(fates: DataFrame) -> DataFrame:
    return fates.agg(
        F.count_if("evicted").alias("evicted"), F.count_if("archived").alias("archived"), F.count("*").alias("total")
    )


def lifecycle_sweep(memory: DataFrame, now) -> DataFrame:
    """Transition log of the rows whose suggested lifecycle differs (MM4)."""
    new = fm.suggested_lifecycle(F.col("lifecycle"), F.col("last_accessed_at"), F.lit(now))
    return memory.select("id", F.col("lifecycle").alias("old"), new.alias("new")).filter("old <> new")


def illegal_transitions(log: DataFrame) -> DataFrame:
    return log.filter(~fm.legal_transition(F.col("old"), F.col("new")))


def last_audit(audit: DataFrame) -> DataFrame:
    """Last audit row per id (WN6)."""
    return pick_one(audit, ["id"], [F.col("seq")])


def classify_audit(audit: DataFrame, entities: list[str] | None = None, ops: list[str] | None = None) -> DataFrame:
    """Outcome of each log row on replay: applied, skipped or error (MM5)."""
    c = F.col
    filtered = F.lit(False)
    if entities:
        filtered = filtered | ~c("entity").isin(entities)
    if ops:
        filtered = filtered | ~c("op").isin(ops)
    outcome = (
        F.when(filtered, "skipped")
        .when((c("op") == "create") & c("new").isNull(), "error")
        .when(c("op").isin("create", "delete", "update"), "applied")
        .otherwise("error")
    )
    return audit.withColumn("outcome", outcome)


def _accepted(batches):
    """Creates that stay at the end of each group, its rows in log order.

    A create is refused while another live id of its scope is the last to have
    stored the same content; a delete frees the content its id holds at that
    time. Memory holds the live ids and contents of one group.
    """
    group, live, owner = None, {}, {}

    def ended():
        return pd.DataFrame({"id": list(live), "born": [v[2] for v in live.values()]})

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.group != group:
                if live:
                    yield ended()
                group, live, owner = row.group, {}, {}
            if row.op == "delete":
                gone = live.pop(row.id, None)
                if gone is not None:
                    owner.pop(gone[0], None)
                continue
            held = owner.get(row.key)
            if held is not None and held != row.id and held in live and live[held][1] == row.scope:
                continue
            live[row.id] = (row.key, row.scope, row.seq)
            owner[row.key] = row.id
    if live:
        yield ended()


def replay(audit: DataFrame, entities: list[str] | None = None, ops: list[str] | None = None) -> DataFrame:
    """State after replaying the log (MM5): the live ids, each with its last
    accepted create and the last lifecycle update after it.

    Only ids that once stored a content which other ids stored too can have a
    create refused. They are split into groups that share contents, and each
    group is folded in log order as a sorted stream of ids and content hashes;
    all other ids need no more than their last create or delete.
    """
    rows = classify_audit(audit, entities, ops).filter("outcome = 'applied'")
    scope = F.col("scope") if "scope" in audit.columns else F.lit("default")
    births = checkpointed(rows.filter("op IN ('create', 'delete')").select(
        "id", "seq", "op", F.coalesce(scope, F.lit("default")).alias("scope"),
        F.when(F.col("op") == "create", content_key(F.col("new"))).alias("key")))
    stored = births.filter("op = 'create'").groupBy("key").agg(F.min("id").alias("target"), F.max("id").alias("_last"))
    shared = births.filter("op = 'create'").select("key", F.col("id").alias("source")).distinct().join(
        stored.filter("target <> _last"), "key").select("source", "target")
    links = checkpointed(shared.distinct())
    groups = components(links.select(F.col("source").alias("id")).distinct(), links).toDF("id", "group")
    folded = (
        births.join(groups, "id").select("group", "seq", "id", "op", "scope", "key")
        .repartition("group").sortWithinPartitions("group", "seq").mapInPandas(_accepted, "id string, born long")
    )
    alone = births.join(groups, "id", "left_anti").groupBy("id").agg(
        F.max("seq").alias("born"), F.max_by("op", "seq").alias("op")).filter("op = 'create'").select("id", "born")
    live = checkpointed(folded.unionByName(alone))
    created = rows.filter("op = 'create'").select(
        "id", F.col("seq").alias("born"), F.coalesce(scope, F.lit("default")).alias("scope"), F.col("new").alias("content"))
    cycles = rows.filter("op = 'update' AND field = 'lifecycle' AND new IS NOT NULL").select("id", "seq", "new")
    after = cycles.join(live, "id").filter("seq > born").groupBy("id").agg(F.max_by("new", "seq").alias("lifecycle"))
    return created.join(live, ["id", "born"]).join(after, "id", "left").select(
        "id", "scope", "content", F.coalesce("lifecycle", F.lit("active")).alias("lifecycle"), "born")


def archive_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("duration_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))


def _tag_counts(members: DataFrame, group: str) -> DataFrame:
    tags = members.select(group, "id", "seq", F.posexplode("tags").alias("_pos", "tag"))
    return tags.groupBy(group, "tag").agg(
        F.count("*").alias("n_tag"), F.min(F.struct("seq", "_pos")).alias("first_at")
    )


def crystallise(members: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lessons from groups of memory rows (GA14).

    Returns one row per group, its common tags (carried by at least half of the
    rows) and its first five examples. Members stay in long form: the group key
    is the link from lesson to memory.
    """
    sizes = members.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("confidence"),
        F.max_by(
            F.struct("id", F.substring("content", 1, 120).alias("summary")), F.struct(F.col("access_count"), -F.col("seq"))
        ).alias("top"),
    )
    common = _common_tags(members, group, sizes)
    title = common.groupBy(group).agg(F.min_by("tag", "first_at").alias("first_tag"))
    lessons = sizes.join(title, group, "left").select(
        group, "n", "confidence", F.col("top.id").alias("top_id"), F.col("top.summary").alias("summary"),
        F.when(F.col("first_tag").isNotNull(), F.concat("first_tag", F.lit(" insight")))
        .otherwise(F.substring("top.summary", 1, 60)).alias("title"),
    )
    examples = top_k(members, [group], [F.col("seq")], 5).select(
        group, "rank", F.col("id").alias("memory_id"), F.substring("content", 1, 80).alias("excerpt")
    )
    return lessons, common.select(group, "tag", "n_tag"), examples


def _common_tags(members: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    return (
        _tag_counts(members, group).join(sizes.select(group, "n"), group)
        .filter(F.col("n_tag") >= F.ceil(F.col("n") / 2)).select(group, "tag", "n_tag", "first_at")
    )


def lesson_contents(members: DataFrame, group: str, parts: dict[str, Column], template: Column) -> DataFrame:
    """Contents of lessons by a template of the caller's (UD1).

    ``parts`` are named aggregates over the rows of a group, which combine before
    the shuffle; ``template`` is a Column over these names, the group and
    ``tags``, the common tags in order of first sight (half of the rows carry
    each, so they are few).
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n"))
    tags = _common_tags(members, group, sizes).groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first_at", "tag"))), lambda t: t["tag"]).alias("tags"))
    told = members.groupBy(group).agg(*[part.alias(name) for name, part in parts.items()])
    return (
        told.join(tags, group, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        .select(group, template.alias("content"))
    )


def consolidate(
    lessons: DataFrame, based_on: DataFrame, examples: DataFrame, more: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add rows to lessons (GA15): version + 1, ids and the examples of the first
    five new rows appended, confidence unchanged. ``based_on(lesson_id, pos,
    memory_id)``, ``examples(lesson_id, pos, memory_id, excerpt)``,
    ``more(lesson_id, memory_id, seq, content)``."""
    grown = more.select("lesson_id").distinct().withColumn("_g", F.lit(1))
    versions = lessons.join(grown, "lesson_id", "left").withColumn(
        "version", F.col("version") + F.coalesce("_g", F.lit(0))
    )

    def after(held: DataFrame, new: DataFrame, rank: str) -> DataFrame:
        sizes = held.groupBy("lesson_id").agg((F.max("pos") + 1).alias("_n"))
        placed = new.join(sizes, "lesson_id", "left").withColumn("pos", F.coalesce("_n", F.lit(0)) + F.col(rank) - 1)
        return held.unionByName(placed.select(*held.columns))

    ids = row_numbers(more, ["lesson_id"], ["seq"], "_i")
    shown = top_k(more, ["lesson_id"], [F.col("seq")], 5).withColumn("excerpt", F.substring("content", 1, 80))
    return (
        versions.select(*lessons.columns),
        after(based_on.select("lesson_id", "pos", "memory_id"), ids, "_i"),
        after(examples.select("lesson_id", "pos", "memory_id", "excerpt"), shown, "rank"),
    )


def tag_clusters(memory: DataFrame, threshold: int = 3, min_confidence: float = 0.5, watch: list[str] | None = None) -> DataFrame:
    """Cluster report per tag over active rows (GA16)."""
    tags = memory.filter("lifecycle = 'active'").select("id", "confidence", F.explode("tags").alias("tag"))
    if watch:
        tags = tags.filter(F.col("tag").isin(watch))
    return tags.groupBy("tag").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence")
    ).withColumn("should_crystallise", (F.col("n") >= threshold) & (F.col("avg_confidence") >= min_confidence))


def crystallise_clusters(memory: DataFrame, **limits) -> DataFrame:
    """Lessons of the flagged clusters (GA16 into GA14)."""
    flagged = tag_clusters(memory, **limits).filter("should_crystallise").select(F.col("tag").alias("cluster"))
    members = memory.filter("lifecycle = 'active'").select("*", F.explode("tags").alias("cluster")).join(
        flagged, "cluster", "left_semi"
    )
    return crystallise(members, "cluster")[0]


def versioned_facts(updates: DataFrame) -> DataFrame:
    """Latest version per key with absent fields carried forward (WN12).

    ``updates(key, value, category, source, confidence, seq)``. The last
    non-null field is a max_by over non-null rows, so no key is ever sorted.
    """

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    return updates.groupBy("key").agg(
        F.max_by("value", "seq").alias("value"), last("category"), last("source"), last("confidence"),
        F.count("*").alias("version"),
    ).withColumns(
        {"category": F.coalesce("category", F.lit("config")), "confidence": F.coalesce("confidence", F.lit(1.0))}
    )


def fact_versions(updates: DataFrame) -> DataFrame:
    """Every version of every key, fields carried forward (WN12 history)."""
    return row_numbers(updates, ["key"], ["seq"], "version", carry=("category", "source", "confidence"))


def cascade_delete(ids: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete ids everywhere (ST5): ``tables`` may hold memory, nodes, edges,
    lesson_members(lesson_id, memory_id), insights(skill), audit(id),
    session_members(session_id, memory_id). Audit and sessions are only counted."""
    gone = ids.select("id").distinct()
    as_ = lambda name: gone.withColumnRenamed("id", name)
    kept: dict[str, DataFrame] = {}
    counts: list[DataFrame] = []

    def count(df: DataFrame, name: str) -> None:
        counts.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n"))

    if "memory" in tables:
        kept["memory"] = tables["memory"].join(gone, "id", "left_anti")
        count(tables["memory"].join(gone, "id", "left_semi"), "entries")
    if "nodes" in tables:
        kept["nodes"] = tables["nodes"].join(gone, "id", "left_anti")
    if "edges" in tables:
        left = tables["edges"].join(as_("source"), "source", "left_anti").join(as_("target"), "target", "left_anti")
        kept["edges"] = left.select(*tables["edges"].columns)
        hit = lambda side: tables["edges"].join(as_(side), side, "left_semi").select(*tables["edges"].columns)
        both = hit("source").unionByName(hit("target").join(as_("source"), "source", "left_anti").select(*tables["edges"].columns))
        count(both, "edges")
    if "lesson_members" in tables:
        lost = tables["lesson_members"].join(as_("memory_id"), "memory_id", "left_semi").select("lesson_id").distinct()
        kept["lesson_members"] = tables["lesson_members"].join(lost, "lesson_id", "left_anti")
        count(lost, "lessons")
    if "insights" in tables:
        kept["insights"] = tables["insights"].join(as_("skill"), "skill", "left_anti")
        count(tables["insights"].join(as_("skill"), "skill", "left_semi"), "insights")
    if "audit" in tables:
        count(tables["audit"].join(gone, "id", "left_semi"), "audits")
    if "session_members" in tables:
        hit_sessions = tables["session_members"].join(as_("memory_id"), "memory_id", "left_semi")
        count(hit_sessions.select("session_id").distinct(), "sessions")
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return kept, report


def share(memory: DataFrame, agents: list[str], sender: str) -> DataFrame:
    """Copies of rows for every agent but the sender (ST7); ``agents`` is the
    short list of registered names, so each row is exploded, not joined."""
    others = [a for a in agents if a != sender]
    return memory.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in others]))).withColumns(
        {
            "id": F.concat_ws("_", "agent", "id"),
            "tags": F.array_append("tags", F.lit(f"from:{sender}")),
            "source": F.lit(f"mesh:{sender}"),
        }
    )


def inbox_since(messages: DataFrame, agent: str, since=None) -> DataFrame:
    """Messages of an agent strictly after a time (SS5)."""
    mine = messages.filter(F.col("agent") == agent)
    return mine if since is None else mine.filter(F.col("ts") > F.lit(since))


def live_slots(writes: DataFrame, now) -> DataFrame:
    """Latest value per (scope, key) that has not outlived its TTL (SS1, batch)."""
    latest = pick_one(writes, ["scope", "key"], [F.col("last_updated_at"), F.col("seq")])
    age_ms = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_updated_at")) / 1000
    return latest.filter(F.col("ttl_ms").isNull() | (age_ms <= F.col("ttl_ms")))
