"""Keyed streams: expiry, late rows, any order, restarts."""

import datetime as dt
import random

import pytest

from graphloom.streaming import tables

T0 = dt.datetime(2024, 1, 1)
WRITES = "scope string, key string, value string, ttl_ms long, last_updated_at timestamp, seq long"
LOG = "id string, seq long, op string, field string, new string"
EVENTS = "path string, content_hash string, signature string, seq long"


@pytest.fixture
def stream(spark, tmp_path):
    """Functions that feed files one by one and read the table after each run."""

    class Stream:
        def __init__(self, schema, make, keys):
            self.schema, self.make, self.keys = schema, make, keys

        def run(self, rows=None):
            if rows is not None:
                spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            tables.append_to(self.make(source), f"{tmp_path}/out").awaitTermination()  # each call is a restart
            return self.table()

        def table(self):
            return {tuple(r[k] for k in self.keys): r for r in tables.latest(spark, f"{tmp_path}/out", self.keys).collect()}

        def rows(self):
            return spark.read.parquet(f"{tmp_path}/out/rows").collect()

    return Stream


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_slots_expire_and_restart(stream):
    s = stream(WRITES, tables.slot_changes, ("scope", "key"))
    got = s.run([("a", "k", "1", 10_000, at(0), 1), ("a", "j", "2", None, at(0), 2), ("a", "k", "0", 10_000, at(-5), 0)])
    assert {k: r.value for k, r in got.items()} == {("a", "k"): "1", ("a", "j"): "2"}
    assert s.run() == got  # a restart without data changes nothing
    # a write refreshes; an older one changes nothing
    got = s.run([("a", "k", "3", 10_000, at(8), 3), ("b", "k", "x", 1_000, at(8), 4), ("a", "j", "old", None, at(-1), 9)])
    assert {k: r.value for k, r in got.items()} == {("a", "k"): "3", ("a", "j"): "2", ("b", "k"): "x"}
    got = s.run([("c", "t", "tick", None, at(30), 5)])
    got = s.run([("c", "t", "tock", None, at(31), 6)])  # the watermark is past every end now
    assert {k: r.value for k, r in got.items()} == {("a", "j"): "2", ("c", "t"): "tock"}
    assert {(r.scope, r.key) for r in s.rows() if r.gone} == {("a", "k"), ("b", "k")}
    got = s.run([("a", "k", "again", 10_000, at(40), 7)])
    assert got[("a", "k")].value == "again"
    assert s.run([("a", "k", "too late", 10_000, at(1), 8)])[("a", "k")].value == "again"


def test_slot_end_is_strict():
    value = {"ttl_ms": 999, "at": 1_000_999, "seq": 1}
    assert tables.Slots.ends(value) == 2000 and tables.Slots.ends(value | {"ttl_ms": None}) is None


def test_files_in_any_order(stream):
    pick = random.Random(4)
    events = [(f"p{pick.randint(0, 9)}", pick.choice([None, "h1", "h2", "h3"]), pick.choice(["s", "t"]), n) for n in range(120)]
    mixed = events[:]
    pick.shuffle(mixed)
    s = stream(EVENTS, tables.file_changes, ("path",))
    for k in range(0, 120, 40):
        got = s.run(mixed[k:k + 40])
    assert len(s.rows()) < 3 * len(got) + 1  # a row a key and micro-batch at most
    for path in {e[0] for e in events}:
        *_, old, new = [(path, None, None, -1), *(e for e in events if e[0] == path)]
        status = ("deleted" if new[1] is None else "new" if old[1] is None else "unchanged" if new[1] == old[1]
                  else "cosmetic" if new[2] == old[2] else "structural")
        assert (got[(path,)].content_hash, got[(path,)].status) == (new[1], status)
    before = len(s.rows())
    s.run([events[0]])  # a row that was there
    assert len(s.rows()) == before


def test_audit_in_any_order(spark, stream):
    pick = random.Random(6)
    log = []
    for n in range(150):
        op = pick.choice(["create", "create", "delete", "update", "read"])
        new = None if op == "delete" or pick.random() < 0.1 else pick.choice("ab") if op == "create" else pick.choice(["stale", "active"])
        log.append((f"i{pick.randint(0, 11)}", n, op, pick.choice(["lifecycle", "confidence"]) if op == "update" else None, new))
    s = stream(LOG, tables.audit_changes, ("id",))
    mixed = log[:]
    pick.shuffle(mixed)
    for k in range(0, 150, 50):
        got = s.run(mixed[k:k + 50])
    for key in {r[0] for r in log}:
        births = [r for r in log if r[0] == key and (r[2] == "delete" or r[2] == "create" and r[4] is not None)]
        lives = [r for r in log if r[0] == key and r[2] == "update" and r[3] == "lifecycle" and r[4] is not None]
        r = got.get((key,))
        if births:
            assert (r.born, r.birth_op, r.content) == (births[-1][1], births[-1][2], births[-1][4])
        if lives:
            assert (r.life_seq, r.lifecycle) == (lives[-1][1], lives[-1][4])
