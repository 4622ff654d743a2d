"""Graph, ranking, text, memory and streaming cases with brute-force checks."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import hashing, text
from graphloom.operators import corpus, graphalg, joins, knowledge, memory, ranking, search, stats

E = "source string, target string, type string"


def edge_frame(spark, pairs, kind="imports"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], E)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_row_numbers_and_carry_match_brute_force(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i, rnd.choice([None, str(i)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, seq long, v string").repartition(5)
    got = {(r.g, r.seq): (r.n, r.v) for r in ranking.row_numbers(df, ["g"], ["seq"], "n", carry=("v",)).collect()}
    count, last = Counter(), {}
    for g, seq, v in rows:
        count[g] += 1
        last[g] = v if v is not None else last.get(g)
        assert got[(g, seq)] == (count[g], last[g])


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    names = [f"n{i:03d}" for i in range(150)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(90)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    names += [f"c{i:02d}" for i in range(41)]
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in graphalg.components(ids(spark, names), edge_frame(spark, pairs)).collect()}
    assert got == {n: find(n) for n in names}


def test_paths_and_levels(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("y", "z"), ("z", "y")])
    assert [r.id for r in graphalg.shortest_path(e, "d", "a").orderBy("pos").collect()] == ["d", "c", "b", "a"]
    assert graphalg.shortest_path(e, "a", "a").count() == 0
    assert graphalg.shortest_path(e, "a", "y").count() == 0
    assert {(r.id, r.depth) for r in graphalg.neighbours(e, "b", 2).collect()} == {("a", 1), ("c", 1), ("d", 2), ("x", 2)}
    levels = {r.id: r.level for r in graphalg.topological_levels(ids(spark, "abcdxyz"), e).collect()}
    assert levels == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 3, "y": None, "z": None}


def test_three_cliques_give_three_communities(spark):
    groups = [[f"{g}{i}" for i in range(4)] for g in "pqr"]
    pairs = [(a, b) for grp in groups for i, a in enumerate(grp) for b in grp[i + 1:]] + [("p0", "q0"), ("q1", "r1")]
    names = [n for grp in groups for n in grp] + ["lonely"]
    e = edge_frame(spark, pairs)
    member = graphalg.communities(ids(spark, names), e)
    got = defaultdict(set)
    for r in member.collect():
        got[r.community].add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [*groups, ["lonely"]]))
    trivial = ids(spark, names).withColumn("community", F.col("id"))
    assert graphalg.modularity(e, member).first()[0] > graphalg.modularity(e, trivial).first()[0]


def test_coupled_groups_are_small_and_seeded(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("c", "b"), ("d", "c")])
    got = {r.id for r in graphalg.coupled_groups(e).collect()}
    assert got == {"a", "b", "c"}


def test_coupled_groups_grow_before_the_cut(spark):
    """Twelve plain pairs with many outside links do not hide a dense group."""
    plain = [(f"p{k}", f"q{k}") for k in range(12)]
    outside = [(f"p{k}", f"o{k}_{j}") for k in range(12) for j in range(9)]
    dense = [(a, b) for a in ("ta", "tb", "tc", "td") for b in ("ta", "tb", "tc", "td") if a != b]
    e = edge_frame(spark, plain + [(b, a) for a, b in plain] + outside + dense)
    rows = graphalg.coupled_groups(e).collect()
    groups = {g: {r.id for r in rows if r.group_id == g} for g in {r.group_id for r in rows}}
    assert len(groups) == 10 and {"ta", "tb", "tc", "td"} in groups.values()
    assert sum(v == {"ta", "tb", "tc", "td"} for v in groups.values()) == 1


def test_definition_names(spark):
    files = [
        ("a.tf", "terraform", 'resource "aws_s3_bucket" "main" {\ndata "aws_ami" "ubuntu" {\nmodule "m" {\nvariable "v" {'),
        ("Makefile", "makefile", ".PHONY: all\nX := a:b\nY ?= c:d\nall: build\n\tgo:"),
        ("q.graphql", "graphql", "type Query {\ntype User {\ninput NewUser {"),
        ("Dockerfile", "dockerfile", "FROM node:20 AS build\nFROM reg/x/nginx:1\nfrom alpine"),
        ("s.proto", "protobuf", "service A {\n  rpc Get (X)\n}\nservice B {\n  rpc Put (Y)\n}"),
        ("s.sql", "sql", "create table a (x int); CREATE TABLE b (y int);"),
    ]
    df = spark.createDataFrame(files, "path string, language string, content string")
    got = defaultdict(list)
    for r in corpus.definitions(df).orderBy("line_no", "name").collect():
        got[r.path].append(r.name)
    assert dict(got) == {
        "a.tf": ["aws_s3_bucket.main", "data.aws_ami.ubuntu", "module.m", "v"], "Makefile": ["all"],
        "q.graphql": ["User", "NewUser"], "Dockerfile": ["build", "nginx", "alpine"],
        "s.proto": ["A", "A.Get", "B", "B.Put"], "s.sql": ["a", "b"],
    }


def test_redaction_covers_every_find(spark):
    rows = ["card 4111 1111 1111 1111 end", "a@b.io, http://x.y/z 10.0.0.1", "", "nothing", "123-45-6789", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string")
    got = [r[0] for r in df.select(text.redact(F.col("t"))).collect()]
    assert "1111" not in got[0] and got[0].startswith("card [REDACTED_") and got[0].endswith("end")
    assert got[1] == "[REDACTED_EMAIL], [REDACTED_URL] [REDACTED_IPV4]"
    assert got[2:4] == ["", "nothing"] and "6789" not in got[4] and got[5] == rows[5] and got[6] is None


def test_routing_leaves_out_light_insights(spark):
    insights = spark.createDataFrame(
        [("s", "k", 0.4), ("s", "k", 0.4), ("t", "k", 0.6), ("u", "K", 0.9)], "skill string, keyword string, weight double")
    ranked, _ = joins.route_keywords(insights, spark.createDataFrame([("k",)], "keyword string"), 0.5)
    assert [(r.skill, r.score) for r in ranked.collect()] == [("t", 0.6)]


def test_vector_search_skips_nulls(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0])], "id long, vector array<double>")
    q = d.select(F.col("id").alias("query_id"), "vector")
    assert [(r.query_id, r.id) for r in search.vector_top_k(d, q).collect()] == [(1, 1)]


def test_vector_search_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100, [1.0, 2.0])]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(7)]
    d = spark.createDataFrame(docs, "id long, vector array<double>")
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    want = set()
    for qi, qv in queries:
        sims = [(round(float(np.dot(qv, v) / np.linalg.norm(qv) / np.linalg.norm(v)), 9), i) for i, v in docs if len(v) == 8]
        for s, i in sorted((s for s in sims if s[0] > 0), key=lambda t: (-t[0], t[1]))[:5]:
            want.add((qi, i))
    assert {(r.query_id, r.id) for r in search.vector_top_k(d, q, 5).collect()} == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "DOC_BLOCK", 16)
    assert {(r.query_id, r.id) for r in search.vector_top_k(d, q, 5).collect()} == want


def test_bm25_prefers_the_rare_term(spark):
    d = spark.createDataFrame([(1, "cat dog"), (2, "dog dog dog"), (3, "dog bird")], "id long, text string")
    q = spark.createDataFrame([(0, "cat dog"), (1, "none")], "query_id long, query string")
    got = search.bm25(d, q).collect()
    assert {r.query_id for r in got} == {0} and min(got, key=lambda r: r.rank).id == 1


def test_hybrid_sums_raw_scores(spark):
    s = "query_id long, id string, score double"
    a = spark.createDataFrame([(0, "x", 2.0), (0, "y", 1.0)], s)
    b = spark.createDataFrame([(0, "y", 3.0)], s)
    got = {r.id: (round(r.score, 3), r.sources) for r in search.hybrid({"bm25": a, "vector": b}).collect()}
    assert got == {"y": (1.6, "bm25,vector"), "x": (0.8, "bm25")}


def test_containment_pairs_match_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abc. ") for _ in range(n))
    needles = [(f"n{k}", make(rng.randint(0, 7))) for k in range(60)]
    texts = [(f"h{k}", make(rng.randint(0, 40))) for k in range(40)] + [("h99", None)]
    n = spark.createDataFrame(needles, "n_id string, needle string")
    h = spark.createDataFrame(texts, "h_id string, text string")
    want = {(i, j) for i, x in needles for j, t in texts if x and t and x in t}
    assert {(r.n_id, r.h_id) for r in knowledge.containment_pairs(n, h).collect()} == want


def test_containment_matches_brute_force(spark):
    n = spark.createDataFrame([("n1", "ab"), ("n2", "b"), ("n3", "zz"), ("n4", "ab"), ("n5", "")], "n_id string, needle string")
    h = spark.createDataFrame([("h2", "xabx"), ("h1", "b"), ("h3", "ab")], "h_id string, text string")
    got = {(r.n_id, r.h_id) for r in knowledge.containment(n, h).collect()}
    assert got == {("n1", "h2"), ("n4", "h2"), ("n2", "h1")}


def test_first_paragraph_and_sections(spark):
    md = "---\ntags: x\n---\n# T\n\n> q\n***\nhello\nworld\n## next\nbody\n~~~\n# no\n```\n~~~\n### last\n"
    row = spark.createDataFrame([("a.md", md)], "path string, content string")
    assert row.select(text.first_paragraph(F.col("content"))).first()[0] == "hello world"
    plain = spark.createDataFrame([("only this",)], "c string")
    assert plain.select(text.first_paragraph(F.col("c"))).first()[0] == "only this"
    got = [(r.name, r.level, r.line_start, r.line_end) for r in corpus.sections(row).collect()]
    assert got == [("T", 1, 4, 9), ("next", 2, 10, 15), ("last", 3, 16, 17)]


def test_legacy_hashes(spark):
    r = spark.createDataFrame([("a",), ("",)], "t string").select(hashing.fnv1a64("t").alias("f"), hashing.djb2("t").alias("d")).collect()
    # published FNV-1a test vectors; 5381 * 33 + 97
    assert (r[0].f, r[1].f) == ("af63dc4c8601ec8c", "cbf29ce484222325")
    assert r[0].d == f"{5381 * 33 + 97:08x}"


def test_layer_stats_threshold_is_strict(spark):
    m = spark.createDataFrame([("l", f"n{i}") for i in range(10)] + [("empty", "gone")], "layer_id string, node_id string")
    n = spark.createDataFrame([(f"n{i}", "complex" if i < 3 else "moderate" if i < 7 else "simple") for i in range(10)], "id string, complexity string")
    got = {r.layer_id: (r.n, r.label) for r in stats.layer_stats(m, n).collect()}
    assert got == {"l": (10, "moderate"), "empty": (0, "simple")}


def test_folder_groups_strip_shared_directories(spark):
    p = spark.createDataFrame([("src/a/x.ts",), ("src/b/y.ts",), (None,)], "file_path string")
    got = {r.file_path: r.folder for r in stats.with_folder_group(p).collect()}
    assert got == {"src/a/x.ts": "a", "src/b/y.ts": "b", None: "~"}
    same = spark.createDataFrame([("auth/x",), ("auth/y",)], "file_path string")
    assert {r.folder for r in stats.with_folder_group(same).collect()} == {"auth"}


def test_slot_expiry_is_strict(spark):
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("a", "k", "1", 1000, t, 1), ("a", "j", "2", 999, t, 2), ("a", "i", "3", None, t, 3)],
                              "scope string, key string, value string, ttl_ms long, last_updated_at timestamp, seq long")
    assert {r.key for r in memory.live_slots(s, t + dt.timedelta(seconds=1)).collect()} == {"k", "i"}


def test_graph_queries_read_all_edges(spark):
    from __spark_entry__ import queries
    from graphloom.plans.registry import view

    at = "/root/testdata/sf0.001"
    run = lambda name: queries()[f"{name}_all_edges"](spark, at).collect()
    edges = view(spark, at, "v_edges").select("source", "target", "type", "weight", "seq").collect()
    nodes = {r.id for r in view(spark, at, "v_nodes").select("id").collect()}
    assert {"imports", "serves", "documents", "depends_on", "contains_flow"} <= {e.type for e in edges}
    near = defaultdict(list)
    for e in edges:
        near[e.source].append((e.target, e.weight))
        near[e.target].append((e.source, e.weight))

    def depths(start):
        found, front = {start: 0}, [start]
        while front:
            new = {t for s in front for t, _ in near[s]} - found.keys()
            found |= dict.fromkeys(new, found[front[0]] + 1)
            front = list(new)
        return found

    depth = depths("step:s7")
    assert {(r.id, r.depth) for r in run("gr1_neighbours")} == {(k, d) for k, d in depth.items() if 0 < d <= 2}
    path = [r.id for r in sorted(run("gr2_shortest_path"), key=lambda r: r.pos)]
    assert (path[0], path[-1]) == ("step:s7", "file:shared/m1/p10.ts") and [depth[k] for k in path] == list(range(len(path)))
    assert all(b in {t for t, _ in near[a]} for a, b in zip(path, path[1:]))
    reach = {k for k, d in depth.items() if 0 < d <= 3}
    want = {("node", k) for k in (reach | {"step:s7"}) & nodes}
    want |= {("edge", str(e.seq)) for e in edges if e.source in reach | {"step:s7"} or e.target in reach}
    assert {(r.kind, r.id) for r in run("wn13_trajectory")} == want

    into, out = defaultdict(set), defaultdict(set)
    for e in edges:
        if e.source in nodes and e.target in nodes:
            into[e.target].add(e.source)
            out[e.source].add(e.target)
    level, front, n = {}, {k for k in nodes if not into[k]}, 0
    while front:
        level |= dict.fromkeys(front, n)
        n += 1
        front = {t for k in front for t in out[k] if t not in level and into[t] <= level.keys()}
    got = run("gr5_topological_levels")
    assert len(got) == len(nodes) and {r.id: r.level for r in got} == {k: level.get(k, -1) for k in nodes}

    want = {}
    for q in range(25):
        seen, front = {f"flow:n{q}"}, {f"flow:n{q}"}
        for hop in (1, 2):
            score = Counter()
            for k in front:
                for t, w in near[k]:
                    score[t] += w
            front = score.keys() - seen
            want |= {(q, k): score[k] / hop for k in front}
            seen |= front
    got = {(r.query_id, r.id): r.score for r in run("sr7_graph_hits")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_entry_points_over_line_ends(spark):
    content = "// routes\napp.get(\n  '/x',\n  f)\n\nbus.on('a')\nx\ncli.command(\n'go')\nrouter\n  .post('/y')\nservice Q {\n"
    rows = [("a.ts", content), ("b.test.ts", content), ("c.ts", "none"), ("d.ts", None)]
    got = corpus.entry_points(spark.createDataFrame(rows, "path string, content string")).collect()
    assert sorted((r.path, r.line_no, r.kind, r.match) for r in got) == [
        ("a.ts", 2, "http", "app.get(\n  '/x'"), ("a.ts", 6, "event", ".on('a'"), ("a.ts", 8, "cli", ".command(\n'go'"),
        ("a.ts", 10, "http", "router\n  .post('/y'"), ("a.ts", 12, "http", "service Q {")]


def test_consolidate_appends_examples(spark):
    lessons = spark.createDataFrame([("L", 1), ("M", 1), ("N", 4)], "lesson_id string, version int")
    based_on = spark.createDataFrame([("L", 0, "a"), ("L", 1, "b"), ("N", 0, "c")], "lesson_id string, pos long, memory_id string")
    examples = spark.createDataFrame([("L", 0, "a", "text a")], "lesson_id string, pos long, memory_id string, excerpt string")
    more = spark.createDataFrame(
        [("L", f"n{k}", k, f"{k}" * 100) for k in range(7)] + [("M", "m", 0, "short")],
        "lesson_id string, memory_id string, seq long, content string")
    versions, ids, shown = (sorted(map(tuple, df.collect())) for df in memory.consolidate(lessons, based_on, examples, more))
    assert versions == [("L", 2), ("M", 2), ("N", 4)]
    assert ids == [("L", 0, "a"), ("L", 1, "b"), *[("L", k + 2, f"n{k}") for k in range(7)], ("M", 0, "m"), ("N", 0, "c")]
    assert shown == [("L", 0, "a", "text a"), *[("L", k + 1, f"n{k}", f"{k}" * 80) for k in range(5)], ("M", 0, "m", "short")]


def plain_replay(log):
    """The log run row by row."""
    live, holder = {}, {}
    for n, (i, op, field, new, scope) in enumerate(log):
        scope = scope or "default"
        if op == "create" and new is not None:
            other = holder.get(new)
            if other is not None and other != i and other in live and live[other][0] == scope:
                continue
            live[i] = [scope, new, "active", n]
            holder[new] = i
        elif op == "delete" and i in live:
            holder.pop(live.pop(i)[1], None)
        elif op == "update" and field == "lifecycle" and new is not None and i in live:
            live[i][2] = new
    return {(i, *v) for i, v in live.items()}


@pytest.mark.parametrize(("n", "ids", "contents"), [(10_000, 300, 200), (10_000, 4_000, 9_000), (500, 3, 2), (0, 1, 1)])
def test_replay_equals_the_log_run_row_by_row(spark, n, ids, contents):
    pick = random.Random(n + ids)
    ops = ["create", "create", "create", "delete", "update", "update", "read"]
    log = []
    for _ in range(n):
        op, i = pick.choice(ops), f"i{pick.randrange(ids)}"
        new = f"c{pick.randrange(contents)}" if op == "create" and pick.random() < 0.95 else pick.choice(["stale", "archived", None]) if op == "update" else None
        log.append((i, op, pick.choice(["lifecycle", "confidence"]) if op == "update" else None, new, pick.choice([None, "a", "a", "b"])))
    rows = [(k, "memory", *r) for k, r in enumerate(log)]
    pick.shuffle(rows)
    audit = spark.createDataFrame(rows, "seq long, entity string, id string, op string, field string, new string, scope string")
    got = {(r.id, r.scope, r.content, r.lifecycle, r.born) for r in memory.replay(audit).collect()}
    assert got == plain_replay(log)


def test_legacy_hashes_of_a_batch():
    import pandas as pd

    pick = random.Random(1)
    texts = ["", "a", "\U0001F600é", "x" * 5000, *("".join(chr(pick.randrange(1, 0xD000)) for _ in range(pick.randrange(40))) for _ in range(60))]

    def units(t):
        raw = t.encode("utf-16-le")
        return [raw[k] | raw[k + 1] << 8 for k in range(0, len(raw), 2)]

    for t, f, d in zip(texts, hashing.fnv1a64_of(pd.Series(texts)).tolist(), hashing.djb2_of(pd.Series(texts)).tolist()):
        h, g = 0xCBF29CE484222325, 5381
        for u in units(t):
            h, g = (h ^ u) * 0x100000001B3 % 2**64, (g * 33 + u) % 2**32
        assert (f, d) == (h, g)
    assert hashing.fnv1a64_of(pd.Series([], dtype=object)).tolist() == [] == hashing.djb2_of(pd.Series([], dtype=object)).tolist()


def test_layers_and_tour_steps_are_checked(spark):
    from graphloom.operators import clean

    nodes = ids(spark, ["a", "b", "b"])
    layers = spark.createDataFrame(
        [(0, "l0", "n", "d", ["b", "x", "a", "b"]), (1, "l1", None, "d", ["a"]), (2, "l2", "n", "d", None), (3, "l3", "n", "d", ["a", None]),
         (4, "l4", "n", "d", []), (5, None, None, "d", None)], "seq long, id string, name string, description string, node_ids array<string>")
    got = clean.validate_layers(layers, nodes)
    assert {r.id for r in got.rows.collect()} == {"l0", "l4"}
    assert sorted(map(tuple, got.members.collect())) == [(0, 0, "b"), (0, 2, "a"), (0, 3, "b")]
    said = sorted((r.path, r.message) for r in clean.described(got.issues).collect())
    assert said == [("layers[1]", "layers[1]: name is missing or invalid — removed"), ("layers[2]", "layers[2]: nodeIds is missing or invalid — removed"),
                    ("layers[3]", "layers[3]: nodeIds is missing or invalid — removed"), ("layers[5]", "layers[5]: id is missing or invalid — removed")]
    tour = spark.createDataFrame([(0, None, "t", "d", ["a"]), (1, 1, "t", "d", ["gone"])], "seq long, step_order int, title string, description string, node_ids array<string>")
    got = clean.validate_tour(tour, nodes)
    assert [r.seq for r in got.rows.collect()] == [1] and got.members.collect() == []
    assert [(r.category, r.field) for r in got.issues.collect()] == [("invalid-tour-step", "step_order")]


def test_small_components_move_in_their_task(spark, monkeypatch):
    """A long chain takes the tables of its components, not one per round of moves."""
    stored, keep = [], graphalg.checkpointed
    monkeypatch.setattr(graphalg, "checkpointed", lambda df: stored.append(1) or keep(df))
    names = [f"n{k:03d}" for k in range(120)] + ["lonely", None]
    e = edge_frame(spark, [(names[k], names[k + 1]) for k in range(119) if k != 59] + [("n000", "n000"), ("n001", "n000")])
    member = graphalg.communities(ids(spark, names), e)
    rows = member.collect()
    assert len(stored) < 25 and len(rows) == 122
    got = {r.id: r.community for r in rows}
    assert got["lonely"] == "lonely" and got[None] is None
    assert not {got[n] for n in names[:60]} & {got[n] for n in names[60:120]}
    assert graphalg.modularity(e, member.filter("id IS NOT NULL")).first()[0] > 0.8


def test_large_components_move_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(graphalg, "_TASK_LINKS", 6)
    four = ["p0", "p1", "p2", "p3"]
    e = edge_frame(spark, [(a, b) for i, a in enumerate(four) for b in four[i + 1:]] + [("x", "y"), ("y", "z"), ("z", "x")])
    got = defaultdict(set)
    for r in graphalg.communities(ids(spark, [*four, "x", "y", "z"]), e).collect():
        got[r.community].add(r.id)
    assert sorted(map(sorted, got.values())) == [four, ["x", "y", "z"]]


def test_component_links_are_stored_once_a_pair(spark, monkeypatch):
    stored, keep = [], graphalg.checkpointed
    monkeypatch.setattr(graphalg, "checkpointed", lambda df: stored.append(keep(df)) or stored[-1])
    e = edge_frame(spark, [("b", "a"), ("a", "b"), ("c", "b"), ("d", "d"), ("e", None), (None, "f")])
    got = {r.id: r.component for r in graphalg.components(ids(spark, "abcdef"), e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    assert sorted(tuple(r) for r in stored[0].collect()) == [("a", "b"), ("b", "c")]


def test_trajectory_looks_at_targets_of_edges_not_found_by_source_only(spark):
    rows = [("s", "a", 1), ("a", "b", 2), ("x", "b", 3), ("y", "z", 4), (None, "a", 5), ("s", None, 6), ("q", "x", 7)]
    e = spark.createDataFrame([(a, b, n, "d") for a, b, n in rows], "source string, target string, seq long, created_at string")
    nodes = ids(spark, ["s", "a", "b", "x", "q"]).withColumn("created_at", F.lit("c"))
    t = graphalg.trajectory(nodes, e, "s", 2)
    got = [(r.kind, r.id) for r in t.collect()]
    assert got == [("node", "a"), ("node", "b"), ("node", "s"), *[("edge", n) for n in "12356"]]
    assert "LeftSemi, (target" in t._jdf.queryExecution().optimizedPlan().toString()
