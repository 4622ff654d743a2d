"""Streams that keep the latest row of each key in the engine's state store (SS1-SS4).

Each stream is a ``StatefulProcessor`` with one value per key. It appends a row
to its sink only when a key has changed; ``latest`` reads the table back as the
last row of every key. Nothing is rewritten per micro-batch; offsets, state and
sink commits are the engine's, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphloom.functions.hashing import content_key
from graphloom.operators.dedup import pick_one

# Keyed state needs the engine's RocksDB store; its commits send changes, not whole snapshots.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

SLOT = "value string, ttl_ms long, at long, seq long"
AUDIT = "born long, birth_op string, content string, life_seq long, lifecycle string"
FILE = ("content_hash string, signature string, seq long, old_hash string, old_signature string, old_seq long, "
        "status string")


class _Keyed(StatefulProcessor):
    """One value per key; ``fold`` gives the new value, or None for no change.

    Rows are folded one by one, so a hot key is never held whole. ``version``
    counts the changes of a key.
    """

    keys: tuple[str, ...]
    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("row", f"{self.fields}, version long")
        self.names = [f.strip().split(" ")[0] for f in self.fields.split(",")]

    def fold(self, old: dict | None, row: Row) -> dict | None:
        raise NotImplementedError

    def changed(self, old: dict | None, new: dict) -> None:
        """Called after ``new`` has taken the place of ``old``."""

    def current(self) -> dict | None:
        found = self.state.get()
        return None if found is None else dict(zip([*self.names, "version"], found))

    def said(self, key: Any, value: dict, gone: bool = False) -> Row:
        return Row(*self.keys, *self.names, "version", "gone")(*key, *(value[c] for c in self.names), value["version"], gone)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = value = self.current()
        for row in rows:
            new = self.fold(value, row)
            value = value if new is None else new
        if value is not before:
            value = {c: value[c] for c in self.names} | {"version": ((before or {}).get("version") or 0) + 1}
            self.state.update(tuple(value.values()))
            self.changed(before, value)
            yield self.said(key, value)

    def close(self) -> None:
        pass


class Slots(_Keyed):
    """Latest write per (scope, key) until its time to live is over (SS1).

    A timer on event time drops a slot from the state as soon as the watermark
    has passed ``last_updated_at + ttl_ms``, and says so in a row marked gone. A
    write older than the stored one changes nothing.
    """

    keys, fields = ("scope", "key"), SLOT

    def fold(self, old, row):
        newer = old is None or (row["at"], row["seq"]) > (old["at"], old["seq"])
        return {c: row[c] for c in self.names} if newer else None

    @staticmethod
    def ends(value: dict) -> int | None:
        """The first whole millisecond at which the slot has outlived its time."""
        return None if value["ttl_ms"] is None else value["at"] // 1000 + value["ttl_ms"] + 1

    def changed(self, old, new):
        if old is not None and self.ends(old) is not None:
            self.handle.deleteTimer(self.ends(old))
        if self.ends(new) is not None:
            self.handle.registerTimer(self.ends(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        value = self.current()
        if value is not None and self.ends(value) is not None and self.ends(value) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self.said(key, value, gone=True)


class Audit(_Keyed):
    """Last birth or death and last lifecycle per id (SS3)."""

    keys, fields = ("id",), AUDIT

    def fold(self, old, row):
        value = dict(old) if old else dict.fromkeys(self.names)
        if row["op"] == "delete" or (row["op"] == "create" and row["new"] is not None):
            if value["born"] is None or row["seq"] > value["born"]:
                return value | {"born": row["seq"], "birth_op": row["op"], "content": row["new"]}
        elif row["op"] == "update" and row["field"] == "lifecycle" and row["new"] is not None:
            if value["life_seq"] is None or row["seq"] > value["life_seq"]:
                return value | {"life_seq": row["seq"], "lifecycle": row["new"]}
        return None


class Files(_Keyed):
    """State of each path after its newest event (SS4); a null hash deletes.

    The newest event and the one before it are kept, a deletion like any other,
    so events may come out of order; ``status`` tells what the newest one did.
    """

    keys, fields = ("path",), FILE
    event = ("content_hash", "signature", "seq")

    def fold(self, old, row):
        value = dict(old) if old else dict.fromkeys(self.names)
        if value["seq"] is None or row["seq"] > value["seq"]:
            value |= {"old_hash": value["content_hash"], "old_signature": value["signature"], "old_seq": value["seq"]}
            value |= {c: row[c] for c in self.event}
        elif row["seq"] < value["seq"] and (value["old_seq"] is None or row["seq"] > value["old_seq"]):
            value |= {"old_hash": row["content_hash"], "old_signature": row["signature"], "old_seq": row["seq"]}
        else:
            return None
        if value["content_hash"] is None:
            value["status"] = "deleted"
        elif value["old_hash"] is None:
            value["status"] = "new"
        elif value["content_hash"] == value["old_hash"]:
            value["status"] = "unchanged"
        else:
            value["status"] = "cosmetic" if value["signature"] == value["old_signature"] else "structural"
        return value


def changes(rows: DataFrame, processor: _Keyed, key_types: str, time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """The stream of changed rows: keys, fields, ``version``, ``gone``. With
    ``time``, timers follow the watermark of that column."""
    for key, value in _STORE.items():
        rows.sparkSession.conf.set(key, value)
    timed = rows.withWatermark(time, delay) if time else rows
    return timed.groupBy(*processor.keys).transformWithState(
        statefulProcessor=processor, outputStructType=f"{key_types}, {processor.fields}, version long, gone boolean",
        outputMode="Append", timeMode="EventTime" if time else "None")


def slot_changes(writes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """SS1 over ``writes(scope, key, value, ttl_ms, last_updated_at, seq)``."""
    timed = writes.withColumn("at", F.unix_micros("last_updated_at"))
    return changes(timed, Slots(), "scope string, key string", "last_updated_at", delay).withColumn(
        "last_updated_at", F.timestamp_micros("at")).drop("at")


def audit_changes(log: DataFrame) -> DataFrame:
    """SS3 over ``log(id, seq, op, field, new)``."""
    return changes(log.select("id", "seq", "op", "field", "new"), Audit(), "id string")


def file_changes(events: DataFrame) -> DataFrame:
    """SS4 over ``events(path, content_hash, signature, seq)``."""
    return changes(events.select("path", "content_hash", "signature", "seq"), Files(), "path string")


def append_to(stream: DataFrame, path: str) -> StreamingQuery:
    """Append the stream's rows to ``path/rows`` until the present input is read;
    called again with the same path it goes on."""
    return (
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: tuple[str, ...], schema: str | None = None) -> DataFrame:
    """The table behind a sink: the last row of every key that is not gone."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{path}/rows")
    # a slot that was gone begins anew at version 1, so time decides where there is one
    timed = "last_updated_at" in rows.columns
    by = [F.col(c) for c in (["last_updated_at", "seq", "gone"] if timed else ["version"])]
    return pick_one(rows, list(keys), by).filter("NOT gone").drop("version", "gone")


def audit_state(state: DataFrame) -> DataFrame:
    """Live entries of a folded audit state."""
    live = state.filter("birth_op = 'create'").select(
        "id", "content", "born",
        F.when(F.col("life_seq") > F.col("born"), F.col("lifecycle")).otherwise("active").alias("lifecycle"),
    )
    return pick_one(live, ["content"], [F.col("born"), F.col("id")], keep="min")


def stream_dedup(rows: DataFrame, delay: str, time: str = "ts") -> DataFrame:
    """First row per (scope, content) within the watermark (SS2). The watermark
    bounds the state: a copy arriving later than ``delay`` counts as new."""
    return (
        rows.withColumn("fingerprint", content_key(F.col("content"))).withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(["scope", "fingerprint"])
    )
