"""Change detection between two states of a corpus (FN9, ST6, GA25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import blank


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, detail)`` of signature-level differences (FN9).

    Signatures are long tables ``(path, kind, name, params, return_type,
    exported, n_lines, methods, properties, specifiers)`` with kind function,
    class, import or export; only files present on both sides should be passed.
    """
    key = ["path", "kind", "name"]
    cols = ["params", "return_type", "exported", "n_lines", "methods", "properties", "specifiers"]

    def side(df: DataFrame, p: str) -> DataFrame:
        # of rows of one name the last by ``seq`` counts, else the smallest row, so that reruns agree
        row = F.struct(*cols)
        one = F.max_by(row, "seq") if "seq" in df.columns else F.min(row)
        return df.groupBy(*key).agg(one.alias("_r")).select(
            *key, *[F.col(f"_r.{c}").alias(f"{p}_{c}") for c in cols], F.lit(True).alias(f"{p}_here"))

    both = side(old, "o").join(side(new, "n"), key, "full")
    c = F.col
    added, removed = c("o_here").isNull(), c("n_here").isNull()
    shared = ~added & ~removed
    fn, cls = c("kind") == "function", c("kind") == "class"

    def differs(name: str):
        return ~c(f"o_{name}").eqNullSafe(c(f"n_{name}"))

    ordered = lambda name: ~F.sort_array(f"o_{name}").eqNullSafe(F.sort_array(f"n_{name}"))
    ratio = F.try_divide(c("n_n_lines"), c("o_n_lines"))
    details = F.array(
        F.when(fn & added, F.concat(F.lit("new function: "), "name")),
        F.when(fn & removed, F.concat(F.lit("removed function: "), "name")),
        F.when(fn & shared & differs("params"), F.concat(F.lit("params changed: "), "name")),
        F.when(fn & shared & differs("return_type"), F.concat(F.lit("return type changed: "), "name")),
        F.when((fn | cls) & shared & differs("exported"), F.concat(F.lit("export status changed: "), "name")),
        F.when(fn & shared & (c("o_n_lines") > 0) & ((ratio > 1.5) | (ratio < 0.5)), F.concat(
            F.lit("significant size change: "), "name", F.lit(" ("), "o_n_lines", F.lit(" → "), "n_n_lines", F.lit(" lines)"))),
        F.when(cls & added, F.concat(F.lit("new class: "), "name")),
        F.when(cls & removed, F.concat(F.lit("removed class: "), "name")),
        F.when(cls & shared & ordered("methods"), F.concat(F.lit("methods changed: "), "name")),
        F.when(cls & shared & ordered("properties"), F.concat(F.lit("properties changed: "), "name")),
        F.when((c("kind") == "import") & (~shared | ordered("specifiers")), F.lit("imports changed")),
        F.when((c("kind") == "export") & ~shared, F.lit("exports changed")),
    )
    return both.select("path", F.explode(F.filter(details, lambda d: d.isNotNull())).alias("detail")).distinct()


def classify_changes(
    old_files: DataFrame, new_files: DataFrame, old_signatures: DataFrame, new_signatures: DataFrame
) -> DataFrame:
    """``(path, status)``: new, deleted, structural, cosmetic or unchanged (ST6).

    ``files(path, content_hash, has_structural)``. Equal hashes are settled by
    the file join; signatures are compared for the other files only.
    """
    pairs = (
        old_files.select("path", F.col("content_hash").alias("_oh"), F.col("has_structural").alias("_os"))
        .join(new_files.select("path", F.col("content_hash").alias("_nh"), F.col("has_structural").alias("_ns")), "path", "full")
    )
    changed = pairs.filter("_oh <> _nh").select("path")
    details = signature_changes(
        old_signatures.join(changed, "path", "left_semi"), new_signatures.join(changed, "path", "left_semi")
    )
    marked = pairs.join(details.select("path").distinct().withColumn("_d", F.lit(True)), "path", "left")
    status = (
        F.when(F.col("_oh").isNull(), "new").when(F.col("_nh").isNull(), "deleted")
        .when(F.col("_oh") == F.col("_nh"), "unchanged")
        .when(~F.col("_os") | ~F.col("_ns") | F.col("_d"), "structural").otherwise("cosmetic")
    )
    return marked.select("path", status.alias("status"))


# Details of changed files without signature-level differences.
UNKNOWN = "no structural analysis available — conservative classification"
INTERNAL = "internal logic changed (no structural impact)"


def change_details(
    old_files: DataFrame, new_files: DataFrame, old_signatures: DataFrame, new_signatures: DataFrame
) -> DataFrame:
    """``(path, level, detail)`` of the files on both sides whose contents differ
    (FN9): STRUCTURAL with one row per difference, also for a file that either
    side could not analyse, else COSMETIC."""
    pairs = (
        old_files.select("path", F.col("content_hash").alias("_oh"), F.col("has_structural").alias("_os"))
        .join(new_files.select("path", F.col("content_hash").alias("_nh"), F.col("has_structural").alias("_ns")), "path")
        .filter("_oh <> _nh").select("path", F.coalesce(F.col("_os") & F.col("_ns"), F.lit(False)).alias("known"))
    )
    known = pairs.filter("known").select("path")
    details = signature_changes(
        old_signatures.join(known, "path", "left_semi"), new_signatures.join(known, "path", "left_semi"))
    other = F.when(F.col("known"), INTERNAL).otherwise(UNKNOWN)
    return pairs.join(details, "path", "left").select(
        "path", F.when(F.col("known") & F.col("detail").isNull(), "COSMETIC").otherwise("STRUCTURAL").alias("level"),
        F.coalesce("detail", other).alias("detail"))


def update_decision(changes: DataFrame, known_files: DataFrame) -> DataFrame:
    """One row ``(action, structural, total)`` (GA25); ``known_files(path)``
    are the files of the stored graph."""
    top = lambda c: F.when(F.col(c).contains("/"), F.split_part(c, F.lit("/"), F.lit(1)))
    known_dirs = known_files.select(top("path").alias("dir")).filter("dir IS NOT NULL").distinct()
    moved = changes.filter("status IN ('new', 'deleted')").select(top("path").alias("dir")).filter(~blank(F.col("dir")))
    new_dirs = moved.distinct().join(known_dirs, "dir", "left_anti").agg(F.count("*").alias("new_dirs")).withColumn("_k", F.lit(1))
    structural = changes.agg(F.count_if(F.col("status").isin("new", "deleted", "structural")).alias("structural")).withColumn("_k", F.lit(1))
    total = known_files.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    n, t = F.col("structural"), F.col("total")
    action = (
        F.when(n == 0, "SKIP").when((n > 30) | ((t > 0) & (n / t > 0.5)), "FULL_UPDATE")
        .when((F.col("new_dirs") > 0) | (n > 10), "ARCHITECTURE_UPDATE").otherwise("PARTIAL_UPDATE")
    )
    return structural.join(total, "_k").join(new_dirs, "_k").select(action.alias("action"), "structural", "total", "new_dirs")
