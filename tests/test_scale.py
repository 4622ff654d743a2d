"""Plans and derived tables that must stay the same, or small, at any size."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clean, dedup, endpoints, graphalg, joins, merge, search, views
from graphloom.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """Small tables with shared and missing paths, repeated keys, nulls and orders of several lines."""
    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", "r_regionkey int, r_name string", [(0, "ASIA")])
    put("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "JAPAN", 0), (1, "CHINA", 0)])
    put("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "s1", 0, 1.0), (2, "s2", None, 2.0)])
    put("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(k, f"c{k}", k % 2, 1.0, "AUTO") for k in range(6)])
    put("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        [(k, f"p{k}", "Brand#1", "PROMO" if k and k % 4 else None, 5, 1.0) for k in [0, 1, 2, 3, 3, 4, 5, 6, 8, None]])
    put("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
        [(1, 1, "F", None, "HIGH"), (2, None, "O", None, "LOW")])
    put("documents", "doc_id long", [(1,)])  # the name stands in the view's text, as an edge type
    put("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string",
        [(o, p, s, n, 0.01 * (n or 9), 0.02 * (n or 9), f) for o, p, s, n, f in [
            (1, 3, 1, 1, "R"), (1, 3, 2, 2, "N"), (1, 99, 1, 3, "R"), (1, 5, 1, 4, None), (1, 6, None, 5, "A"),
            (2, 8, 1, 1, "R"), (2, None, 1, 2, "R"), (2, 0, 1, 3, "N"), (2, 1, 1, 4, "N"), (2, 1, 1, 4, "N"), (None, 2, 1, 1, "N"),
            (None, 4, 1, 2, "N"), (3, 4, 2, None, "N"), (3, 3, 2, 7, "N")]])
    return str(tmp_path)


def test_derived_edges_are_those_of_the_view(spark, tables, monkeypatch):
    got = registry.view(spark, tables, "v_edges")
    parts = got.inputFiles()
    monkeypatch.delitem(registry.SPARK_VIEWS, "v_edges")
    want = registry._derive(spark, tables, "v_edges")
    assert got.columns == want.columns and got.count() == want.count() > 40
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert any("type=imports" in f for f in parts)  # readers of one type open its files only


def test_edge_derivation_reads_lines_once(spark, tables):
    plan = registry._derive(spark, tables, "v_edges")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<l_orderkey") == 1 and "ShuffledHashJoin" in plan


def test_bm25_sums_scores_where_the_document_lies(spark, monkeypatch):
    """Only the postings asked for and each task's best move, not a row per query and document."""
    ranked, keep = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda df, *a: ranked.append(df) or keep(df, *a))
    docs = spark.createDataFrame([(1, "red ring box"), (2, "blue ring")], "id long, text string")
    queries = spark.createDataFrame([(0, "ring"), (1, "red"), (2, "red ring ring")], "query_id long, query string")
    got = {(r.query_id, r.id) for r in search.bm25(docs, queries).collect()}
    assert got == {(0, 1), (0, 2), (1, 1), (2, 1), (2, 2)}
    plan = ranked[0]._jdf.queryExecution().sparkPlan().toString()
    planned = ranked[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(query_id" not in planned


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edge_rows(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, type string, weight double, seq long")


def test_lines_move_without_numbers_that_keys_give(spark, tables):
    """The number of an edge is made after the window, the flag travels as a boolean."""
    moved = [r for r in planned(registry._derive(spark, tables, "v_edges")).splitlines() if "Exchange hashpartitioning(l_" in r]
    assert moved and not any("100000" in r for r in moved)
    text = registry.SPARK_VIEWS["v_line_paths"]
    assert "AS seq" in text[:text.index("FROM")] and "AS seq" not in text[text.index("FROM"):]


def test_context_of_few_hits_moves_no_edges(spark, monkeypatch):
    stored, keep = [], joins.checkpointed
    monkeypatch.setattr(joins, "checkpointed", lambda df: stored.append(1) or keep(df))
    e = edge_rows(spark, [("a", "b", "t", 1.0, 1), ("c", "a", "t", 1.0, 2), ("x", "y", "t", 1.0, 3), (None, "a", "t", 1.0, 4)])
    seeds = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    got = joins.expand_one_hop(e, seeds)
    assert stored == [1] and sorted(r.id or "" for r in got.collect()) == ["", "a", "b", "c", "z"]


def test_patch_joins_only_ends_of_kinds_that_went(spark, monkeypatch):
    rows = [("file:a", "file:b", 1), ("doc:1", "file:a", 2), ("doc:1", "doc:2", 3), ("file:b", "doc:1", 4), (None, "file:b", 5),
            ("doc:1", None, 6), ("file:a", None, 7), ("plain", "file:b", 8), ("plain", "plain", 9), (None, None, 10)]
    e = edge_rows(spark, [(a, b, "t", 1.0, n) for a, b, n in rows])
    gone = spark.createDataFrame([("file:a",), ("plain",), (None,)], "id string")
    want = [(a, b, n) for a, b, n in rows if not {a, b} & {"file:a", "plain"}]
    for kinds in (64, 1):
        monkeypatch.setattr(endpoints, "_KINDS", kinds)
        got = endpoints.without(e, gone)
        assert got.columns == e.columns
        assert sorted(((r.source, r.target, r.seq) for r in got.collect()), key=lambda r: r[2]) == want
        assert ("Union" in planned(got)) == (kinds == 64)


def test_merged_edges_move_once(spark):
    """One row a key and the order's fields once; no semi join of all edges with the nodes."""
    nodes = spark.createDataFrame([(i, n) for n, i in enumerate("abc")], "id string, seq long")
    e = edge_rows(spark, [("a", "b", "t", 1.0, 1), ("a", "b", "t", 1.0, 2), ("b", "c", "t", None, 3), ("b", "c", "t", 0.0, 4),
                          ("a", "gone", "t", 1.0, 5), (None, "a", "t", 1.0, 6), ("c", None, "t", 1.0, 7), ("c", "a", "t", -1.0, 8)])
    f = e.filter("seq IN (1, 2, 8)").withColumn("weight", -F.col("weight"))
    _, edges = merge.merge_subgraphs([nodes, nodes], [e, f])
    assert edges.columns == e.columns
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "t", 1.0, 1), ("b", "c", "t", None, 3), ("c", "a", "t", 1.0, 8)]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join LeftAnti") == 2


def test_levels_store_links_once_a_round(spark, monkeypatch):
    stored, keep = [], graphalg.checkpointed
    monkeypatch.setattr(graphalg, "checkpointed", lambda df: stored.append(keep(df)) or stored[-1])
    nodes = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    e = edge_rows(spark, [("a", "b", "t", 1.0, 1), ("a", "b", "u", 1.0, 2), ("b", "c", "t", 1.0, 3), ("a", "c", "t", 1.0, 4),
                          ("x", "d", "t", 1.0, 5), ("a", None, "t", 1.0, 6)])
    assert {r.id: r.level for r in graphalg.topological_levels(nodes, e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert sorted(tuple(r) for r in stored[1].collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert stored[2].columns == ["id"] and "v_flow_edges" not in registry.STORED


def test_only_whole_edges_meet_the_ids(spark):
    """Kept edges are filtered before their joins, and meet targets once their source is known."""
    nodes = spark.createDataFrame([(i, "file", i, None, "s", ["t"], "simple", n) for n, i in enumerate(["a", "b", "b", None])],
                                  "id string, type string, name string, file_path string, summary string, tags array<string>, complexity string, seq long")
    edges = spark.createDataFrame([("a", "b", "imports", "forward", "1", 1), ("a", "b", "bogus", "forward", "1", 2), ("a", "b", "imports", "sideways", "1", 3),
                                   ("gone", "b", "imports", "forward", "1", 4), ("a", "gone", "imports", None, None, 5), (None, "b", "imports", None, "1", 6),
                                   ("b", "a", "", "both", "9", 7), ("b", "a", "", "both", "9", 7)],
                                  "source string, target string, type string, direction string, weight string, seq long")
    v = clean.validate_graph(nodes, edges)
    assert v.edges.columns == edges.columns
    assert sorted(map(tuple, v.edges.collect())) == [("a", "b", "imports", "forward", 1.0, 1)] + [("b", "a", "depends_on", "bidirectional", 1.0, 7)] * 2
    plan = v.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "LeftOuter" not in plan


def test_expected_edges_are_counted_where_ids_lie(spark):
    """Ends of types that some node expects only, one row an id, and no second move of them."""
    def node(i, kind, n):
        return (i, kind, i, None, "s", ["t"], n)

    nodes = spark.createDataFrame([node("document:1", "document", 1), node("document:2", "document", 2), node("service:1", "service", 3),
                                   node("service:2", "service", 4), node("x", "document", 5), node("x", "service", 6), node("y", "step", 7)],
                                  "id string, type string, name string, file_path string, summary string, tags array<string>, seq long")
    e = edge_rows(spark, [("document:1", "y", "documents", 1.0, 1), ("document:2", "y", "imports", 1.0, 2), ("y", "service:1", "deploys", 1.0, 3),
                          ("service:2", None, None, 1.0, 4), ("x", "y", "documents", 1.0, 5), ("x", "y", "documents", 1.0, 6)])
    members = spark.createDataFrame([], "node_id string, layer_id string")
    tour = spark.createDataFrame([], "step_order int, node_id string")
    checks = clean.review_graph(nodes, e, members, tour)
    assert sorted(r.key for r in checks.filter("`check` = 'expected-edge'").collect()) == ["document:2", "service:2"]
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan and "array_contains" not in plan and "type#" in plan
    assert "max((type" in plan


def test_edges_with_a_key_of_their_own_do_not_move(spark, tmp_path, monkeypatch):
    """Only hashes of the keys are shuffled at first; rows and ties are those of the plain way."""
    rows = [(f"s{i % 7}", f"t{i % 5}", None if i % 3 else "calls", "forward", w, None, i)
            for i, w in enumerate([0.5, None, 0.9, 0.0] * 10)]
    rows += [(f"x{i}", None, "calls", None, 0.1, "d", 100 + i) for i in range(40)]
    schema = "source string, target string, type string, direction string, weight double, description string, seq long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    moved, plain = [], dedup.pick_one
    monkeypatch.setattr(dedup, "pick_one", lambda df, *a, **k: moved.append(df.count()) or plain(df, *a, **k))
    for key in (dedup.EDGE_KEY3, dedup.EDGE_KEY4):
        for keep in ("heaviest", "first"):
            want = dedup.dedup_edges(edges, key, keep)
            got = dedup.dedup_edges(edges, key, keep, stored=True)
            assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
            assert moved[-2:] == [80, 2]  # one key is held by two rows
    monkeypatch.setattr(dedup, "SENT_HASHES", 0)
    assert dedup.dedup_edges(edges, stored=True).count() == 79 and moved[-1] == 80


def test_an_export_joins_only_ends_that_it_hides(spark):
    nodes = spark.createDataFrame(
        [("file:a", "file", "simple"), ("file:b", "file", "odd"), ("function:f", "function", "simple"), ("step:s", "step", None),
         ("step:s", "step", "simple"), (None, "file", "simple")], "id string, type string, complexity string")
    edges = spark.createDataFrame(
        [("file:a", "file:a", "imports", 1), ("file:a", "file:b", "imports", 2), ("file:a", "function:f", "contains", 3),
         ("step:s", "file:a", "serves", 4), ("step:s", "file:gone", "serves", 5), (None, "file:a", "imports", 6),
         ("file:a", None, "imports", 7), ("step:s", "file:a", "calls", 8), ("step:s", "file:a", "unknown", 9), ("step:s", "file:a", None, 10),
         ("step:s", "file:a", "serves", 4)], "source string, target string, type string, seq long")
    args = (["file", "function", "step"], ["simple"], [], ["structural", "infrastructure"])
    for technical, more in ((False, []), (True, [3])):
        shown, got = views.export_view(nodes, edges, nodes.limit(0), *args, technical=technical)
        want = views.filter_edges(edges, shown.select("id"), args[-1])
        assert got.columns == edges.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert sorted(r.seq for r in got.collect()) == sorted([1, 4, 4, 9, 10, *more])
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_levels_fold_no_links(spark, monkeypatch):
    """Links move by one end only; repeated links and a null id settle once, cycles and what is behind them never."""
    stored, keep = [], graphalg.checkpointed
    monkeypatch.setattr(graphalg, "checkpointed", lambda df: stored.append(df) or keep(df))
    nodes = spark.createDataFrame([(i,) for i in [*"abcdefgh", "a", None]], "id string")
    pairs = ["ab", "ab", "bc", "ac", "cd", "cd", "de", "fg", "gf", "gh", "ah", "ah"]
    e = spark.createDataFrame([(p[0], p[1]) for p in pairs], "source string, target string")
    got = sorted(map(tuple, graphalg.topological_levels(nodes, e).collect()), key=str)
    assert got == sorted(zip([*"abcdefgh", None], [0, 1, 2, 3, 4, None, None, None, 0]), key=str)
    assert all("Aggregate [src" not in df._jdf.queryExecution().optimizedPlan().toString() for df in stored)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bm25_blocks_score_as_the_join_does(spark, monkeypatch, kind):
    """Repeated and null ids and texts, ties over blocks, repeated words and queries without an id."""
    words = ["red", "blue", "ring", "box", "lid"]
    texts = [" ".join(words[(i * j) % 5] for j in range(1, 2 + i % 7)) for i in range(60)]
    rows = [(None if i % 20 == 9 else i // 2 * 3, None if i % 17 == 5 else t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").select(F.col("id").cast(kind).alias("id"), "text")
    queries = spark.createDataFrame(
        [(0, "red ring ring"), (1, "box"), (1, "lid box"), (None, "blue"), (2**60 + 1, "red red lid"), (4, "none"), (5, None)],
        "query_id long, query string").select(F.col("query_id").cast(kind).alias("query_id"), "query")

    def found():
        return sorted((str(r.query_id), str(r.id), r["rank"], round(r.score, 8)) for r in search.bm25(docs, queries, 4).collect())

    monkeypatch.setattr(search, "ASKED_TERMS", -1)
    want = found()
    joined, keep = [], search._best_texts
    monkeypatch.setattr(search, "_best_texts", lambda *a: joined.append(1) or keep(*a))
    monkeypatch.setattr(search, "ASKED_TERMS", 100)
    monkeypatch.setattr(search, "TASK_SCORES", 12)
    monkeypatch.setattr(search, "TASK_POSTINGS", 30)
    assert found() == want and len(want) == 16 and joined
