"""Topological levels and fuzzy candidates against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graphalg, search


def plain_levels(names, pairs):
    """Levels by removing the nodes without predecessors again and again."""
    pairs = {(a, b) for a, b in pairs if a in names and b in names}
    levels, level = {}, 0
    while True:
        ready = [n for n in names if n not in levels and not any(b == n for _, b in pairs)]
        if not ready:
            return {n: levels.get(n) for n in names}
        levels |= dict.fromkeys(ready, level)
        pairs = {(a, b) for a, b in pairs if a not in levels}
        level += 1


def spark_levels(spark, names, pairs):
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    edges = spark.createDataFrame(list(pairs), "source string, target string")
    return [(r.id, r.level) for r in graphalg.topological_levels(nodes, edges).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_levels_match_plain_removal(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{k:02d}" for k in range(60)]
    forward = [tuple(sorted(rnd.sample(names[:45], 2))) for _ in range(50)]
    chain = list(zip(names[:20], names[1:20]))
    loops = [(names[50], names[51]), (names[51], names[50]), (names[52], names[52]), (names[51], names[55]),
             (names[55], names[56]), (names[3], names[56]), (names[57], "absent"), ("absent", names[58])]
    pairs = forward + chain + loops + loops[:2]
    got = spark_levels(spark, names, pairs)
    assert len(got) == len(names) and dict(got) == plain_levels(names, pairs)


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    n, stored = 100_000, []
    keep = graphalg.checkpointed
    monkeypatch.setattr(graphalg, "checkpointed", lambda df: stored.append(1) or keep(df))
    nodes = spark.range(n + 3).select(F.col("id").cast("string"))
    chain = spark.range(n - 1).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    ring = spark.createDataFrame([(str(n + k), str(n + (k + 1) % 3)) for k in range(3)], "source string, target string")
    got = graphalg.topological_levels(nodes, chain.union(ring))
    assert len(stored) < 40  # at most three tables a round
    right = F.when(F.col("id").cast("long") < n, F.col("level") == F.col("id").cast("int")).otherwise(F.col("level").isNull())
    assert got.count() == n + 3 and got.filter(~F.coalesce(right, F.lit(False))).isEmpty()


def test_levels_without_nodes_or_edges(spark):
    assert spark_levels(spark, ["a", "b"], []) in ([("a", 0), ("b", 0)], [("b", 0), ("a", 0)])
    none = spark.createDataFrame([], "id string")
    assert graphalg.topological_levels(none, spark.createDataFrame([], "source string, target string")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.6])
def test_fuzzy_pieces_lose_no_token(spark, threshold):
    rnd = random.Random(7)
    stored = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(250)})
    asked = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(40)})
    docs = spark.createDataFrame(
        [(t, "x", t, [], None, None) for t in stored], "id string, type string, name string, tags array<string>, summary string, notes string")
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, query string")
    got = {(r.query_id, r.id): r.score for r in search.fuzzy(docs, queries, threshold=threshold, k=10_000).collect()}
    want = {}
    for q in asked:
        for t in stored:
            d = 0.0 if len(q) >= 3 and q in t else distance(q, t) / max(len(q), len(t))
            if d <= threshold:
                want[(q, t)] = 1 - (1 - d) * search.FIELD_WEIGHTS["name"]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_fuzzy_on_nothing(spark):
    shape = "id string, type string, name string, tags array<string>, summary string, notes string"
    queries = spark.createDataFrame([("q", ""), ("n", None), ("w", "word")], "query_id string, query string")
    assert search.fuzzy(spark.createDataFrame([], shape), queries).count() == 0
    blank = spark.createDataFrame([("a", "x", None, None, "", None), ("b", "x", "word", [], None, None)], shape)
    assert [(r.query_id, r.id) for r in search.fuzzy(blank, queries).collect()] == [("w", "b")]


def test_components_of_long_ordered_chains_take_few_rounds(spark, monkeypatch):
    n, stored = 4_000, []
    keep = graphalg.checkpointed
    monkeypatch.setattr(graphalg, "checkpointed", lambda df: stored.append(1) or keep(df))
    name = lambda c: F.concat(F.lit("c"), (c % 3).cast("string"), F.lpad(c.cast("string"), 6, "0"))
    nodes = spark.range(n).select(name(F.col("id")).alias("id"))
    edges = spark.range(n - 3).select(name(F.col("id")).alias("source"), name(F.col("id") + 3).alias("target"))
    got = graphalg.components(nodes, edges)
    assert len(stored) < 20
    right = F.col("component") == F.concat(F.substring("id", 1, 2), F.lpad(F.substring("id", 2, 1), 6, "0"))
    assert got.count() == n and got.filter(~right).isEmpty()
