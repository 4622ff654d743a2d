"""Ignore globs against cases of the format and a plain reading of them."""

import pytest

from graphloom.operators import views

CASES = [
    (["*.log"], "a/b.log", True), (["*.log"], "a.logs", False), (["*.LOG"], "x.log", True),
    (["/root.txt"], "root.txt", True), (["/root.txt"], "a/root.txt", False),
    (["a/b"], "a/b/c.txt", True), (["a/b"], "x/a/b", False), (["lib/"], "x/lib/y.ts", True), (["lib/"], "lib", False),
    (["lib"], "x/lib", True), (["**/lib"], "lib/x", True), (["**/lib"], "a/b/lib", True), (["a/**"], "a", False),
    (["a/**"], "a/x/y", True), (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True), (["a/**/z"], "b/a/z", False),
    (["?.ts"], "a.ts", True), (["?.ts"], "ab.ts", False), (["a*c"], "a/c", False), (["[ab].md"], "b.md", True),
    (["[!ab].md"], "b.md", False), (["[!ab].md"], "c.md", True), (["[a-c]x"], "bx", True), (["x.y"], "xzy", False),
    (["*.md", "!keep.md"], "d/keep.md", False), (["!keep.md", "*.md"], "keep.md", True),
    (["docs/", "!docs/keep.md"], "docs/keep.md", True), (["docs/*", "!docs/keep.md"], "docs/keep.md", False),
    (["#x", "\\#y", "\\!z", "end\\ "], "#y", True), (["\\!z"], "!z", True), (["end\\ "], "end ", True), (["end "], "end", True),
    ([""], "a", False), (["/"], "a", False), ([], "node_modules/x/y.js", True), (["!node_modules/"], "node_modules/x.js", False),
    ([], "src/app.min.js", True), ([], "src/layout.ts", False), ([], "a/.eslintrc.json", True), (["é*"], "dir/école", True),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    def run(rules, paths):
        files = spark.createDataFrame([(p,) for p in paths], "path string")
        return {r.path: (r.ignored, r.ignored_by_default) for r in views.ignore_globs(files, rules).collect()}

    return run


def test_globs(verdicts):
    for rules in {tuple(r) for r, _, _ in CASES}:
        cases = [(p, want) for r, p, want in CASES if tuple(r) == rules]
        got = verdicts(list(rules), [p for p, _ in cases])
        assert {p: got[p][0] for p, _ in cases} == dict(cases), rules


def test_rows_dropped_by_own_rules_alone(verdicts):
    got = verdicts(["*.md", "!*.png"], ["a.md", "b.png", "c.lock", "d.ts", None])
    assert got == {"a.md": (True, False), "b.png": (False, True), "c.lock": (True, True), "d.ts": (False, False), None: (False, False)}
