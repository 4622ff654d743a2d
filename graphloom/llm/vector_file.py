"""Exact top-k inner-product search with a vector-approximation file (operator 6).

The file holds one byte per component, the number of its cell on a grid over
that component's range, in chunks of vectors stored apart from the exact ones.
A block of queries meets every chunk. The centre of a cell, and half its width
times the query's components, bound the score of a vector; the kth largest
lower bound over all chunks is a floor below which nothing can win. Vectors
whose upper bound reaches the floor are candidates; exact vectors are read for
the best 2k bounds first, and then for those bounds that still reach the kth
exact score, which makes the result certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ranking import top_k
from graphloom.session import checkpointed

CELLS = 256
CHUNK = 4096
QUERY_BLOCK = 1024


def integers(vector: str, scale: int = 1024) -> Column:
    """Components as whole numbers ``floor(scale * x)``, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, v``: rows with an id and a vector free of nulls and non-finite values."""
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", finite), F.lit(False)))


def grid(vectors: DataFrame) -> DataFrame:
    """``dim, low, step``: the grid of each vector length, from all vectors."""
    ranges = vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    steps = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) / F.lit(float(CELLS)))
    by_place = ranges.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "lo", steps.alias("step")))).alias("g"))
    return by_place.select("dim", F.col("g.lo").alias("low"), F.col("g.step").alias("step"))


def approximated(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The file: ``dim, low, step, ids, cells``, one row per chunk."""
    cell = F.zip_with(F.arrays_zip("v", "low"), "step", lambda x, s: F.floor((x["v"] - x["low"]) / s))
    hexed = F.array_join(F.transform(cell, lambda c: F.lpad(F.hex(F.least(F.lit(CELLS - 1), c)), 2, "0")), "")
    coded = vectors.withColumn("dim", F.size("v")).join(grid(vectors), "dim").select(
        "dim", "low", "step", "id", F.unhex(hexed).alias("cells"))

    def pack(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                for at in range(0, len(part), chunk):
                    some = part.iloc[at:at + chunk]
                    yield pd.DataFrame({
                        "dim": [dim], "low": [some["low"].iloc[0]], "step": [some["step"].iloc[0]],
                        "ids": [some["id"].to_numpy(np.int64).tobytes()], "cells": [b"".join(some["cells"])]})

    return coded.mapInPandas(pack, "dim int, low array<long>, step array<double>, ids binary, cells binary")


def query_blocks(queries: DataFrame, floors: DataFrame | None = None, size: int = QUERY_BLOCK) -> DataFrame:
    """``dim, block, qids, q, floors``: queries packed in blocks of bounded size."""
    if floors is None:
        queries = queries.withColumn("floor", F.lit(float("-inf")))
    else:
        queries = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def pack(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len), sort=False):
                for at in range(0, len(part), size):
                    some = part.iloc[at:at + size]
                    yield pd.DataFrame({
                        "dim": [dim], "qids": [some["id"].to_numpy(np.int64).tobytes()],
                        "q": [np.stack(some["v"].to_numpy()).astype(np.int64).tobytes()],
                        "floors": [some["floor"].to_numpy(np.float64).tobytes()]})

    return queries.select("id", "v", "floor").mapInPandas(pack, "dim int, qids binary, q binary, floors binary")


def _bounds(row) -> tuple[np.ndarray, ...]:
    """Vector ids, query ids, mid scores and the slack of each query."""
    dim = row.dim
    ids, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
    cells = np.frombuffer(row.cells, np.uint8).reshape(len(ids), dim)
    q = np.frombuffer(row.q, np.int64).reshape(len(qids), dim).astype(np.float64)
    step = np.asarray(row.step, np.float64)
    centres = np.asarray(row.low, np.float64) + (cells + 0.5) * step
    slack = np.abs(q) @ (step / 2 + 0.5)
    slack += 1 + 1e-9 * (np.abs(q) @ np.abs(centres).max(0))  # rounding of the doubles
    return ids, qids, q @ centres.T, slack


def _floors(k: int):
    """Of each chunk and query, the k largest lower bounds."""
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, qids, mid, slack = _bounds(row)
                mid[qids[:, None] == ids[None, :]] = -np.inf
                n = min(k, len(ids))
                best = -np.partition(-mid, n - 1, axis=1)[:, :n] - slack[:, None]
                yield pd.DataFrame({"id": np.repeat(qids, n), "floor": best.ravel()})

    return run


def _candidates(batches):
    """Vectors whose upper bound reaches the query's floor."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            ids, qids, mid, slack = _bounds(row)
            mid += slack[:, None]
            a, b = np.nonzero((mid >= np.frombuffer(row.floors)[:, None]) & (qids[:, None] != ids[None, :]))
            yield pd.DataFrame({"query_id": qids[a], "vec_id": ids[b], "bound": mid[a, b]})


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``vectors`` (``id, v``)
    for each of ``queries`` (``id, v``), by integer inner product, ties to the
    smaller id, never the query's own id; fewer where there are fewer.

    Vectors of another length than the query's are no candidates. Of equal
    vectors the k + 1 smallest ids represent all: no others can be among the k
    best, so a vector with many copies costs no more. Repeated ids count once.
    """
    order = top_k(vectors.dropDuplicates(["id"]), ["v"], ["id"], k + 1)
    stored = checkpointed(order.select("id", "v"))
    queries = checkpointed(queries.dropDuplicates(["id"]))
    file = checkpointed(approximated(stored))

    def paired(blocks: DataFrame) -> DataFrame:
        # a stated query set against all rows, block by block
        return file.join(blocks, "dim")

    lower = paired(query_blocks(queries)).mapInPandas(_floors(k), "id long, floor double").filter("floor > double('-infinity')")
    ranked = top_k(lower, ["id"], [F.col("floor").desc()], k)
    floors = ranked.groupBy("id").agg(F.min("floor").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k).select("id", "floor")
    found = checkpointed(paired(query_blocks(queries, checkpointed(floors))).mapInPandas(
        _candidates, "query_id long, vec_id long, bound double"))

    def scored(some: DataFrame) -> DataFrame:
        return (
            some.join(stored.toDF("vec_id", "_v"), "vec_id").join(queries.toDF("query_id", "_q"), "query_id")
            .select("query_id", "vec_id", dot("_q", "_v").alias("score"))
        )

    by_bound = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "vec_id")
    ordered = checkpointed(found.withColumn("place", F.row_number().over(by_bound)))
    first = checkpointed(scored(ordered.filter(F.col("place") <= 2 * k)))
    certain = top_k(first, ["query_id"], [F.col("score").desc(), "vec_id"], k).groupBy("query_id").agg(F.min("score").alias("kth"))
    rest = ordered.filter(F.col("place") > 2 * k).join(certain, "query_id").filter(F.col("bound") >= F.col("kth"))
    every = first.unionByName(scored(rest.select("query_id", "vec_id")))
    best = top_k(every, ["query_id"], [F.col("score").desc(), "vec_id"], k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 10
"""
