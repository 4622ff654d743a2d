"""Registry of queries and the fixture views they read.

A view is SQL text valid in both engines apart from two tokens, ``ARR(`` (array
literal) and ``TSUS(`` (timestamp from microseconds). ``view`` gives it as a
DataFrame; ``oracle`` puts the views a statement names in front of it as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.fixtures import SPARK_VIEWS, VIEWS
from graphloom.session import configure, shared_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\bv_\w+|\b(?:" + "|".join(TABLES) + r")\b")


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in order:
                continue
            if name in VIEWS:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


# Graph views are derived once per session and stored, as the graph tables of a
# deployment would be; memory and corpus views stay plain projections.
STORED = {
    "v_part", "v_nodes", "v_edges", "v_import_rows", "v_imports", "v_layer_members", "v_tour_members", "v_files",
    "v_dirty_nodes", "v_dirty_edges",
}
# Stored by one column, so that a reader of some values opens their files only.
SPLIT = {"v_edges": "type"}
_STORED_PATHS: dict[tuple[str, str, str], tuple[str, list[str]]] = {}


def _source(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, list[str]]:
    """Path and columns of a stored view, writing it on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED_PATHS:
        path = f"{shared_dir(spark)}/views-{key[0]}/{sf_dir.strip('/').replace('/', '-')}/{name}"
        rows = _derive(spark, sf_dir, name)
        by = [SPLIT[name]] if name in SPLIT else []
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        _STORED_PATHS[key] = path, rows.columns
    return _STORED_PATHS[key]


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ctes: dict[str, str] = {}

    def visit(text: str) -> None:
        for dep in dict.fromkeys(_NAME.findall(text)):
            if dep in ctes:
                continue
            if dep in STORED and dep != name:
                path, columns = _source(spark, sf_dir, dep)
                ctes[dep] = f"SELECT {', '.join(columns)} FROM parquet.`{path}`"
            elif dep in SPARK_VIEWS or dep in VIEWS:
                body = SPARK_VIEWS.get(dep, VIEWS.get(dep))
                visit(body)
                ctes[dep] = body.replace("ARR(", "array(").replace("TSUS(", "timestamp_micros(")
            else:
                ctes[dep] = f"SELECT * FROM parquet.`{sf_dir}/{dep}.parquet`"

    visit(name)
    heads = ", ".join(f"{dep} AS ({body})" for dep, body in ctes.items())
    return spark.sql(f"WITH {heads} SELECT * FROM {name}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a driver table, as a DataFrame."""
    configure(spark)
    if name in STORED:
        path, columns = _source(spark, sf_dir, name)
        return spark.read.parquet(path).select(*columns)
    return _derive(spark, sf_dir, name)


def oracle(sql: str) -> str:
    """Complete DuckDB statement for ``sql``."""
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    own = ""
    if body.upper().startswith("WITH"):
        own = body[len("WITH RECURSIVE") if recursive else len("WITH"):].strip()
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _needed(body)]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if own:
        text = head + ", ".join([*ctes, own])
    else:
        text = (head + ", ".join(ctes) + " " + body) if ctes else body
    return text.replace("ARR(", "list_value(").replace("TSUS(", "make_timestamp(")


def query(name: str, sql: str | None = None):
    """Register ``fn(get) -> DataFrame``; ``get(view_name)`` gives an input."""

    def wrap(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda v: view(spark, sf_dir, v))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def values_cte(columns: list[str], rows: list[tuple]) -> str:
    """``SELECT ... FROM (VALUES ...)`` text for a small fixed table."""

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"
