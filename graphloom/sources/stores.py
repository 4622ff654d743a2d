"""Audit logs, versioned exports and snapshots (IO5-IO8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.memory import insert_if_new

AUDIT = "seq long, ts timestamp, op string, entity string, id string, field string, new string, actor string"
# Export versions.
EXPORT_VERSION = "0.9.0"
SUPPORTED_VERSIONS = ["0.9.0"]


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines back to audit rows; blank lines carry nothing (IO5)."""
    return spark.read.schema(AUDIT).json(path).filter("seq IS NOT NULL")


def export_rows(memory: DataFrame, scope: str | None = None) -> DataFrame:
    """Rows of one scope, or all, stamped with the export version (IO6)."""
    rows = memory if scope is None else memory.filter(F.col("scope") == scope)
    return rows.withColumn("version", F.lit(EXPORT_VERSION))


def import_rows(existing: DataFrame, exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supported rows enter under new ids through the content check (IO6);
    returns the inserted rows and the rejected version rows."""
    ok = F.col("version").isin(SUPPORTED_VERSIONS)
    fresh = exported.filter(ok).drop("version").withColumn(
        "id", F.concat(F.lit("mem_"), F.sha2(F.concat_ws("\u0001", "scope", F.col("id")), 256))
    )
    inserted, _ = insert_if_new(existing, fresh)
    return inserted, exported.filter(~ok)


def migrate(exported: DataFrame, steps: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Apply version steps until the current version (IO7, UD6): ``steps`` maps
    a version to (next version, DataFrame function)."""
    out = exported.filter(F.col("version").isin(SUPPORTED_VERSIONS))
    for start in steps:
        rows, version, hops = exported.filter(F.col("version") == start), start, 0
        while version != EXPORT_VERSION:
            if version not in steps or hops > len(steps):
                raise ValueError(f"no migration path from {start}")
            version, fn = steps[version]
            rows, hops = fn(rows).withColumn("version", F.lit(version)), hops + 1
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def capture(memory: DataFrame, path: str, snapshot_id: str, created_at: str) -> None:
    """Append a snapshot partition (IO8)."""
    memory.withColumns({"snapshot_id": F.lit(snapshot_id), "captured_at": F.lit(created_at)}).write.mode("append").partitionBy(
        "snapshot_id"
    ).parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("snapshot_id", "captured_at").agg(F.count("*").alias("n"))


def restore(snapshot_rows: DataFrame) -> DataFrame:
    """Rows of a snapshot as fresh entries: access statistics and lifecycle
    start over (IO8)."""
    return snapshot_rows.withColumns({"lifecycle": F.lit("active"), "access_count": F.lit(0).cast("long")})
