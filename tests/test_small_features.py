"""GraphQL endpoints, change details, custom patterns and lesson templates on small cases."""

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import changes, corpus, memory

SIGNATURE = ("path string, kind string, name string, params string, return_type string, exported boolean, n_lines int, "
             "methods array<string>, properties array<string>, specifiers array<string>")


def test_graphql_endpoints(spark):
    schema = """type Thing {
  no: Int
}
type Query {
  one(a: In = { b: 1 }): Int
  # a remark
  two: [Thing]
    arg: Int
}
outside: Int
type Mutation { set(x: Int): Int }
type Subscription{
  open: Int"""
    rows = [("a", "graphql", schema), ("b", "graphql", ""), ("c", "graphql", None), ("d", "sql", schema)]
    got = corpus.graphql_endpoints(spark.createDataFrame(rows, "path string, language string, content string")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[3]) == [
        ("a", "Query", "one", 5), ("a", "Query", "two", 7), ("a", "Query", "arg", 8), ("a", "Mutation", "set", 11),
        ("a", "Subscription", "open", 13)]


def test_change_details(spark):
    def files(rows):
        return spark.createDataFrame(rows, "path string, content_hash string, has_structural boolean")

    def signatures(*rows):
        return spark.createDataFrame(
            [(p, "function", n, None, None, False, lines, [], [], []) for p, n, lines in rows], SIGNATURE)

    old = files([("same", "1", True), ("grown", "1", True), ("inner", "1", True), ("bare", "1", False), ("gone", "1", True)])
    new = files([("same", "1", True), ("grown", "2", True), ("inner", "2", True), ("bare", "2", True), ("born", "1", True)])
    got = changes.change_details(
        old, new, signatures(("grown", "f", 10), ("grown", "g", 10), ("inner", "f", 10), ("bare", "f", 1), ("gone", "f", 1)),
        signatures(("grown", "f", 16), ("grown", "h", 4), ("inner", "f", 15), ("bare", "g", 1), ("born", "f", 1)))
    assert sorted(map(tuple, got.collect())) == [
        ("bare", "STRUCTURAL", changes.UNKNOWN), ("grown", "STRUCTURAL", "new function: h"),
        ("grown", "STRUCTURAL", "removed function: g"),
        ("grown", "STRUCTURAL", "significant size change: f (10 → 16 lines)"), ("inner", "COSMETIC", changes.INTERNAL)]


def test_custom_patterns(spark):
    df = spark.createDataFrame([("badge EMP-123456",), ("plain",), (None,)], "t string")
    custom = [("ssn", r"\bEMP-\d{6}\b")]
    assert [r[0] for r in df.select(text.sensitivity(F.col("t"), custom)).collect()] == ["restricted", "public", "public"]
    assert [r[0] for r in df.select(text.sensitivity(F.col("t"))).collect()] == ["public"] * 3


def test_lesson_contents(spark):
    rows = [("a", 1, "m1", ["x", "y"]), ("a", 2, "m2", ["y"]), ("b", 3, "m3", None), ("b", 4, "m4", [])]
    df = spark.createDataFrame(rows, "scope string, seq long, id string, tags array<string>")
    told = memory.lesson_contents(
        df, "scope", {"n": F.count("*"), "last": F.max_by("id", "seq")}, F.concat_ws("|", "scope", "n", "last", F.array_join("tags", "+")))
    assert sorted(r.content for r in told.collect()) == ["a|2|m2|x+y", "b|2|m4|"]
