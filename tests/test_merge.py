"""Merge, linking and validation on small literal frames."""

from pyspark.sql import functions as F

from graphloom.functions import ids, paths
from graphloom.operators import clean, dedup, linking, merge

N = "id string, type string, name string, file_path string, summary string, tags array<string>, complexity string, seq long"
E = "source string, target string, type string, direction string, weight string, description string, seq long"


def node(i, seq=0, type_="file", name="n", path=None, tags=None, complexity="simple"):
    return (i, type_, name, path, "s", tags, complexity, seq)


def test_canonical_ids(spark):
    rows = [
        ("file:file:a.ts", "file", "n", None), ("proj:file:a.ts", "file", "n", None), ("func:a.ts:f", "function", "f", "a.ts"),
        ("a.ts", "file", "n", None), ("f", "function", "f$1", "a.ts"), ("f", "class", None, None), ("x", "weird", "n", None),
        ("file:a.ts", "file", "n", None), ("step:flow:x", "step", "n", None),
    ]
    df = spark.createDataFrame(rows, "id string, type string, name string, p string")
    out = [r[0] for r in df.select(ids.canonical_id(F.col("id"), F.col("type"), F.col("name"), F.col("p"))).collect()]
    assert out == [
        "file:a.ts", "file:a.ts", "function:a.ts:f", "file:a.ts", "function:a.ts:f$1", "class:__nofilepath__:f", "file:x",
        "file:a.ts", "step:flow:x",
    ]


def test_production_candidates(spark):
    cases = {
        "src/a.test.ts": "src/a.ts", "src/__tests__/a.spec.tsx": "src/a.tsx", "tests/x/a.test.js": "src/x/a.js",
        "pkg/tests/test_b.py": "pkg/b.py", "tests/test_b.py": "b.py", "pkg/b_test.go": "pkg/b.go",
        "src/test/java/x/FooTest.java": "src/main/java/x/Foo.java", "svc/tests/BarTests.cs": "svc/Bar.cs",
        "My.App.Tests/X/BarTests.cs": "My.App/X/Bar.cs", "lib/test_c.cpp": "lib/c.cpp",
    }
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r["path"]: r["candidates"] for r in paths.with_production_candidates(df, "path").collect()}
    for test, production in cases.items():
        assert production in got[test], test
    assert len(set(got["src/a.test.ts"])) == len(got["src/a.test.ts"])
    svc = spark.createDataFrame([("src/svc/tests/X/BarTests.cs",), ("src/helpers.ts",)], "path string")
    rows = {r["path"]: r["candidates"] for r in paths.with_production_candidates(svc, "path").collect()}
    assert "src/svc/src/X/Bar.cs" in rows["src/svc/tests/X/BarTests.cs"]
    assert rows["src/helpers.ts"] == []


def test_linker_flips_drops_and_is_idempotent(spark):
    nodes = spark.createDataFrame(
        [node("file:a.ts", 1, path="a.ts"), node("file:a.test.ts", 2, path="a.test.ts"), node("file:b.ts", 3, path="b.ts", tags=["x"]),
         node("file:b.test.ts", 4, path="b.test.ts"), node("file:c.test.ts", 5, path="c.test.ts")], N)
    edges = spark.createDataFrame(
        [("file:a.test.ts", "file:a.ts", "tested_by", "forward", "0.3", None, 1),
         ("file:a.ts", "file:a.test.ts", "tested_by", "forward", "0.9", "kept", 2),
         ("file:a.test.ts", "file:c.test.ts", "tested_by", "forward", "0.9", None, 3),
         ("file:a.ts", "file:gone.test.ts", "tested_by", "forward", "0.9", None, 4)], E)
    n1, e1, _ = linking.link_tests(nodes, edges)
    got = {(r.source, r.target, r.weight, r.description) for r in e1.collect()}
    assert got == {
        ("file:a.ts", "file:a.test.ts", "0.9", "kept"),
        ("file:b.ts", "file:b.test.ts", "0.5", "Path-based pairing (deterministic)"),
    }
    tags = {r.id: r.tags for r in n1.collect()}
    assert tags["file:a.ts"] == ["tested"] and tags["file:b.ts"] == ["x", "tested"] and tags["file:c.test.ts"] is None
    n2, e2, _ = linking.link_tests(n1, e1)
    assert {(r.source, r.target, r.weight, r.description) for r in e2.collect()} == got
    assert {r.id: r.tags for r in n2.collect()} == tags


def test_merge_batches(spark):
    nodes = spark.createDataFrame(
        [node("file:file:a.ts", 1, name="old"), node("file:a.ts", 2, name="new"), node("b.ts", 3, complexity="7"), node(None, 4)], N)
    edges = spark.createDataFrame(
        [("file:file:a.ts", "b.ts", "imports", "both", "0.2", None, 1), ("file:a.ts", "file:b.ts", "imports", "mutual", "0.8", None, 2),
         ("file:a.ts", "file:b.ts", "imports", None, "bad", None, 3), ("file:a.ts", "file:zz", "imports", None, "1", None, 4)], E)
    g = merge.merge_batches(nodes, edges)
    assert {(r.id, r.name, r.complexity) for r in g.nodes.collect()} == {("file:a.ts", "new", "simple"), ("file:b.ts", "n", "complex")}
    assert {(r.source, r.target, r.direction, r.weight) for r in g.edges.collect()} == {
        ("file:a.ts", "file:b.ts", "bidirectional", 0.8), ("file:a.ts", "file:b.ts", "forward", None)}


def test_dedup_ties_keep_first(spark):
    e = spark.createDataFrame([("a", "b", "t", "forward", 0.5, "one", 1), ("a", "b", "t", "forward", 0.5, "two", 2)],
                              E.replace("weight string", "weight double"))
    assert dedup.dedup_edges(e).first().description == "one"


def test_validation_tiers(spark):
    nodes = spark.createDataFrame([node("a", 1, type_="METHOD"), node("b", 2, type_="bogus"), node("c", 3, complexity="")], N)
    edges = spark.createDataFrame(
        [("a", "c", "uses", "TO", "1.7", None, 1), ("a", "b", "calls", None, "0.5", None, 2), ("a", "c", "nope", None, None, None, 3)], E)
    v = clean.validate_graph(nodes, edges)
    assert {(r.id, r.type, r.complexity) for r in v.nodes.collect()} == {("a", "function", "simple"), ("c", "file", "moderate")}
    assert [(r.type, r.direction, r.weight) for r in v.edges.collect()] == [("depends_on", "forward", 1.0)]
    dropped = {(r.collection, r.category, r.seq) for r in v.issues.filter("level = 'dropped'").collect()}
    assert dropped == {("nodes", "invalid-node", 2), ("edges", "invalid-reference", 2), ("edges", "invalid-edge", 3)}
    empty = clean.validate_graph(nodes.filter("id = 'b'"), edges)
    assert empty.issues.filter("level = 'fatal'").count() == 1
