"""Graph documents and batch files as JSON (IO1-IO4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "struct<id:string,type:string,name:string,filePath:string,lineRange:array<int>,summary:string,"
    "tags:array<string>,complexity:string>"
)
EDGE = "struct<source:string,target:string,type:string,direction:string,weight:variant,description:string>"
GRAPH = (
    f"version string, project struct<name:string,languages:array<string>,frameworks:array<string>,description:string,"
    f"analyzedAt:string,gitCommitHash:string>, nodes array<{NODE}>, edges array<{EDGE}>, "
    "layers array<struct<id:string,name:string,description:string,nodeIds:array<string>>>, "
    "tour array<struct<`order`:int,title:string,description:string,nodeIds:array<string>>>, _corrupt_record string"
)
# Folders over which written documents are spread.
_FOLDERS = 256
BATCH_NAME = r"batch-(\d+)(?:-part-(\d+))?\.json$"


def read_documents(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """One row per readable document with its file name; malformed files and
    documents without node and edge arrays are left out. With ``nested`` the
    folders below are read too, and a document in a folder named as a file
    (``batch-1.json/``, ``name=batch-1.json/``), as Spark writes it, has its name."""
    folder = F.regexp_extract("_metadata.file_path", r"([^/=]+\.json)/[^/]+$", 1)
    name = F.coalesce(F.nullif(folder, F.lit("")), "_metadata.file_name") if nested else F.col("_metadata.file_name")
    raw = (
        spark.read.schema(GRAPH).option("mode", "PERMISSIVE").option("multiLine", True)
        .option("recursiveFileLookup", nested).json(path).withColumn("file", name)
    )
    return raw.filter("_corrupt_record IS NULL AND nodes IS NOT NULL AND edges IS NOT NULL").drop("_corrupt_record")


def write_documents(documents: DataFrame, folder: str) -> None:
    """Write each row of ``documents(name, value)`` to a file of that name, in
    folders by a hash of the names (IO3). Tasks open the files themselves: a small
    file of Spark's writer costs a folder, a checksum file and a rename as well.
    Names must be unique, rows without one are left out; a repeated task writes the
    same files again."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        made = set()
        for pdf in batches:
            for place, name, value in zip(pdf["place"], pdf["name"], pdf["value"]):
                if place not in made:
                    store.create_dir(f"{base}/{place}", recursive=True)
                    made.add(place)
                with store.open_output_stream(f"{base}/{place}/{name}") as out:
                    out.write(value.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    place = F.pmod(F.xxhash64("name"), F.lit(_FOLDERS))
    named = documents.filter("name IS NOT NULL").select(place.alias("place"), "name", "value")
    named.mapInPandas(write, "n long").agg(F.sum("n")).first()


def graph_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges, layer members and tour members of documents (IO1)."""
    key = F.col("file")
    nodes = documents.select(key, F.posexplode("nodes").alias("seq", "n")).select(
        "file", F.col("seq").cast("long").alias("seq"), "n.id", "n.type", "n.name", F.col("n.filePath").alias("file_path"),
        "n.summary", "n.tags", "n.complexity",
    )
    edges = documents.select(key, F.posexplode("edges").alias("seq", "e")).select(
        "file", F.col("seq").cast("long").alias("seq"), "e.source", "e.target", "e.type", "e.direction",
        F.col("e.weight").cast("string").alias("weight"), "e.description",
        # a weight given as text is repaired and reported, a number is not
        F.coalesce(F.schema_of_variant("e.weight") == "STRING", F.lit(False)).alias("weight_is_text"),
    )
    layers = documents.select(key, F.posexplode("layers").alias("layer_pos", "l")).select(
        "file", "layer_pos", F.col("l.id").alias("layer_id"), F.col("l.name").alias("layer_name"),
        F.posexplode("l.nodeIds").alias("member_pos", "node_id"),
    )
    tour = documents.select(key, F.explode("tour").alias("t")).select(
        "file", F.col("t.order").alias("step_order"), F.col("t.title").alias("title"),
        F.posexplode("t.nodeIds").alias("pos", "node_id"),
    )
    return {"nodes": nodes, "edges": edges, "layer_members": layers, "tour_members": tour}


def read_batches(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """Batch documents with batch and part numbers; other file names are ignored (IO3)."""
    docs = read_documents(spark, folder, nested).filter(F.col("file").rlike("^" + BATCH_NAME))
    return docs.withColumns(batch_numbers(F.col("file")))


def batch_numbers(file: Column) -> dict[str, Column]:
    """Batch and part number that a file name holds."""
    part = F.nullif(F.regexp_extract(file, BATCH_NAME, 2), F.lit(""))
    return {"batch": F.regexp_extract(file, BATCH_NAME, 1).cast("int"), "part": part.try_cast("int")}


def missing_parts(parts: DataFrame) -> DataFrame:
    """``(batch, part)`` absent from 1..max of a batch (IO4): ``parts(batch, part)``."""
    top = parts.filter("part IS NOT NULL").groupBy("batch").agg(F.max("part").alias("n"))
    wanted = top.select("batch", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("part"))
    return wanted.join(parts.select("batch", F.col("part").cast("int").alias("part")), ["batch", "part"], "left_anti")


def stored_path(path: Column, root: str) -> Column:
    """Absolute paths become relative inside ``root`` and bare names outside it (IO2)."""
    inside = root.rstrip("/") + "/"
    return (
        F.when(path.startswith(inside), F.substring(path, len(inside) + 1, 1 << 30))
        .when(path.rlike(r"^(/|[A-Za-z]:[\\/])"), F.regexp_extract(path, r"([^/\\]*)$", 1))
        .otherwise(path)
    )


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, target: str) -> None:
    """Write the graph tables as JSON with stored paths (IO2)."""
    nodes.withColumn("file_path", stored_path(F.col("file_path"), root)).write.mode("overwrite").json(f"{target}/nodes")
    edges.write.mode("overwrite").json(f"{target}/edges")


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """File inventory of a folder tree (IO9): path, language, lines, category.

    Lines are counted in the file's own row; nothing is collected.
    """
    from graphloom.functions import paths

    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    path = F.regexp_replace(full, "^" + folder.rstrip("/") + "/", "")
    return raw.select(path.alias("path"), F.col("value").alias("content")).select(
        "path", paths.language(F.col("path")).alias("language"), paths.newline_count(F.col("content")).alias("size_lines"),
        paths.category(F.col("path")).alias("file_category"), "content",
    )
