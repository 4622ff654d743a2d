"""JSON readers and the corpus scan on files in a temporary folder."""

import json

from pyspark.sql import functions as F

from graphloom.operators import clean
from graphloom.sources import graph_json


def test_batches_and_malformed_files(spark, tmp_path):
    good = {"nodes": [{"id": "file:a", "type": "file", "name": "a", "tags": ["x"], "complexity": 3}], "edges": []}
    (tmp_path / "batch-1-part-1.json").write_text(json.dumps(good))
    (tmp_path / "batch-1-part-3.json").write_text(json.dumps(good))
    (tmp_path / "batch-2.json").write_text(json.dumps(good))
    (tmp_path / "batch-3.json").write_text("{broken")
    (tmp_path / "batch-4.json").write_text(json.dumps({"nodes": []}))
    (tmp_path / "other.json").write_text(json.dumps(good))
    docs = graph_json.read_batches(spark, str(tmp_path)).cache()
    assert {(r.batch, r.part) for r in docs.select("batch", "part").collect()} == {(1, 1), (1, 3), (2, None)}
    assert {(r.batch, r.part) for r in graph_json.missing_parts(docs.select("batch", "part")).collect()} == {(1, 2)}
    nodes = graph_json.graph_tables(docs)["nodes"].collect()
    assert len(nodes) == 3 and {n.complexity for n in nodes} == {"3"}


def test_weights_keep_their_type(spark, tmp_path):
    edges = [{"source": "a", "target": "b", "type": "calls", "direction": "forward", "weight": w} for w in (0.7, "0.7", 2, None)]
    (tmp_path / "batch-1.json").write_text(json.dumps({"nodes": [], "edges": edges}))
    tables = graph_json.graph_tables(graph_json.read_batches(spark, str(tmp_path)))
    fixed = clean.fix_edges(tables["edges"]).orderBy("seq").collect()
    assert [r.weight for r in fixed] == [0.7, 0.7, 1.0, 0.5]
    assert [[i["category"] for i in r.issues] for r in fixed] == [[], ["type-coercion"], ["out-of-range"], ["missing-field"]]


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x\ny\n")
    (tmp_path / "Dockerfile").write_text("FROM x")
    got = {(r.path, r.language, r.size_lines, r.file_category) for r in graph_json.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {("src/a.py", "python", 2, "code"), ("Dockerfile", "dockerfile", 0, "infra")}


def test_a_document_costs_one_file(spark, tmp_path):
    """No folder, checksum or marker beside a written document, and no second pass over the edges."""
    value = json.dumps({"nodes": [], "edges": [{"source": "a", "target": "b", "type": "calls"}]})
    rows = [(f"batch-{i}-part-{i % 2 + 1}.json", value) for i in range(600)]
    rows += [("batch-7-part-77.json", "{broken"), ("other-batch-1-part-1.json", value), (None, value)]
    graph_json.write_documents(spark.createDataFrame(rows, "name string, value string"), str(tmp_path / "docs"))
    files = [f for f in (tmp_path / "docs").rglob("*") if f.is_file()]
    assert sorted(f.name for f in files) == sorted(n for n, _ in rows if n)
    assert len({f.parent for f in files}) <= 256
    docs = graph_json.read_batches(spark, str(tmp_path / "docs"), nested=True)
    edges = graph_json.graph_tables(docs)["edges"].withColumns(graph_json.batch_numbers(F.col("file")))
    assert {(r.batch, r.part, r.target) for r in edges.collect()} == {(i, i % 2 + 1, "b") for i in range(600)}
