"""Path expressions: language, category, test pairing, safe paths, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions.columns import blank, last_segment, lookup


def extension(base: Column) -> Column:
    """Extension with its dot; a leading dot does not start one."""
    return F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)


def stem(base: Column) -> Column:
    return F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def dirname(path: Column) -> Column:
    """Directory part without the trailing slash; empty at the root."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def _dot_key(base: Column) -> Column:
    return F.lower(F.regexp_extract(base, r"^(\.[A-Za-z0-9]+)", 1))


def language(path: Column) -> Column:
    base = last_segment(path)
    ext = F.lower(extension(base))
    by_ext = dims.LANGUAGE_EXTS
    return F.coalesce(
        F.when((base == "Dockerfile") | base.startswith("Dockerfile."), "dockerfile"),
        lookup(by_ext, _dot_key(base)),
        lookup(by_ext, ext),
        F.nullif(F.regexp_replace(ext, r"^\.", ""), F.lit("")),
        lookup(dims.LANGUAGE_FILENAMES, base),
        F.lit("unknown"),
    )


def category(path: Column) -> Column:
    base = last_segment(path)
    by_ext = dims.CATEGORY_EXTS
    infra = (
        base.isin(dims.INFRA_FILENAMES)
        | base.startswith("Dockerfile.")
        | base.startswith("docker-compose.")
        | path.startswith(".github/workflows/")
        | path.startswith(".circleci/")
        | path.rlike(r"(^|/)(k8s|kubernetes)/")
        | base.rlike(r"(?i)\.k8s\.ya?ml$")
    )
    return (
        F.when(base == "LICENSE", "code")
        .when(infra, "infra")
        .otherwise(
            F.coalesce(
                lookup(by_ext, F.lower(extension(base))), lookup(by_ext, _dot_key(base)), F.lit("code")
            )
        )
    )


def corpus_size(n_files: Column) -> Column:
    return F.when(n_files <= 30, "small").when(n_files <= 150, "moderate").when(n_files <= 500, "large").otherwise(
        "very-large"
    )


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def _test_name_regex() -> str:
    names = [rf"[^/]*\.(?:test|spec)(?:{'|'.join(e.replace('.', chr(92) + '.') for e in dims.SCRIPT_EXTS)})"]
    for ext, (prefixes, suffixes) in dims.TEST_NAME_RULES.items():
        dotted = ext.replace(".", r"\.")
        names += [rf"{p}[^/]*{dotted}" for p in prefixes]
        names += [rf"[^/]*{x}{dotted}" for x in suffixes]
    return rf"(?:^|/)(?:{'|'.join(names)})$"


def is_test(path: Column) -> Column:
    return path.rlike(_test_name_regex())


def _under(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat_ws("/", directory, name))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def _if(cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.array().cast("array<string>"))


def with_production_candidates(df: DataFrame, path: str, out: str = "candidates") -> DataFrame:
    """Add the ordered distinct paths a test file may be testing.

    A family gives places (directories in priority order) and extensions; each
    place is tried with each extension. The parts are laid down column by
    column so that the generated code stays small.
    """
    col = F.col
    parts = df.withColumn("_segs", segments(col(path))).withColumn("_base", last_segment(col(path)))
    parts = parts.withColumns(
        {
            "_ext": extension(col("_base")),
            "_name": stem(col("_base")),
            "_dirs": F.slice("_segs", 1, F.greatest(F.size("_segs") - 1, F.lit(0))),
        }
    )
    n = F.size("_dirs")
    parts = parts.withColumns(
        {
            "_here": F.array_join("_dirs", "/"),
            "_head": F.coalesce(F.get("_dirs", F.lit(0)), F.lit("")),
            "_tail": F.coalesce(F.get("_dirs", n - 1), F.lit("")),
            "_parent": F.array_join(F.slice("_dirs", 1, F.greatest(n - 1, F.lit(0))), "/"),
            "_rest": F.array_join(F.slice("_dirs", 2, F.greatest(n, F.lit(1))), "/"),
            # position of the innermost tests directory, 0 when there is none
            "_tests": F.array_max(
                F.transform("_dirs", lambda d, i: F.when(F.lower(d).isin("tests", "test"), i + 1).otherwise(0))
            ),
            "_family": F.when(col("_ext").isin(dims.SCRIPT_EXTS), "script")
            .when(col("_ext").isin(".java", ".kt"), "jvm")
            .otherwise(col("_ext")),
            "_suffix": F.when(col("_ext") == ".java", "(Tests|Test|IT)$")
            .when(col("_ext").isin(".kt", ".cs"), "(Tests|Test)$")
            .when(col("_ext").isin(dims.SCRIPT_EXTS), "[.](test|spec)$")
            .when(col("_name").startswith("test_"), "^test_")
            .otherwise("_test$"),
        }
    )
    mirrors = F.array(*[_joined(F.lit(root), col("_rest")) for root in dims.MIRROR_ROOTS])
    script = F.concat(
        F.array("_here"),
        _if(col("_tail").isin("__tests__", "test", "spec", "tests"), F.array("_parent")),
        _if(col("_head").isin("tests", "test", "__tests__"), mirrors),
    )
    python = F.concat(
        F.array("_here"),
        _if(col("_tail").isin("tests", "test"), F.array("_parent")),
        _if(col("_head").isin("tests", "test"), mirrors),
    )
    tree = F.when(col("_ext") == ".java", "^src/test/java(/|$)").otherwise("^src/test/kotlin(/|$)")
    jvm = F.concat(
        _if(F.regexp_like("_here", tree), F.array(F.regexp_replace("_here", "^src/test/", "src/main/"))),
        F.array("_here"),
    )
    above = F.slice("_dirs", 1, F.greatest(col("_tests") - 1, F.lit(0)))
    below = F.slice("_dirs", col("_tests") + 1, n + 1)
    csharp = F.concat(
        F.array("_here"),
        _if(
            col("_tests") > 0,
            F.array(
                F.array_join(above, "/"), F.array_join(F.concat(above, F.array(F.lit("src")), below), "/")
            ),
        ),
        _if(
            col("_head").rlike(r".[.]Tests?$"),
            F.array(_joined(F.regexp_replace("_head", r"[.]Tests?$", ""), col("_rest"))),
        ),
    )
    parts = parts.withColumns(
        {
            "_places": F.when(~is_test(col(path)), F.array().cast("array<string>"))
            .when(col("_family") == "script", script)
            .when(col("_family") == ".py", python)
            .when(col("_family") == "jvm", jvm)
            .when(col("_family") == ".cs", csharp)
            .otherwise(F.array("_here")),
            "_exts": F.when(
                col("_family") == "script", F.array("_ext", *[F.lit(e) for e in dims.SCRIPT_EXTS])
            ).otherwise(F.array("_ext")),
            "_bare": F.regexp_replace("_name", col("_suffix"), F.lit("")),
        }
    )
    tried = F.transform(
        "_places", lambda d: F.transform("_exts", lambda e: _under(d, F.concat(F.col("_bare"), e)))
    )
    return parts.withColumn(out, F.array_distinct(F.flatten(tried))).select(*df.columns, out)


def safe_relative(path: Column) -> Column:
    """Relative form of a path, null for escapes above the root."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^/+", ""), r"^\./", "")
    bad = blank(clean) | (clean == ".") | F.array_contains(F.split(clean, "/"), "..")
    return F.when(bad, F.lit(None).cast("string")).otherwise(clean)


def kebab(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "-")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def title_case(text: Column) -> Column:
    return F.initcap(F.regexp_replace(text, r"[-_]+", " "))


def suffixes(path: Column) -> Column:
    """Every trailing sub-path of a path, longest first."""
    parts = segments(path)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")
    )


def ancestors(path: Column) -> Column:
    """Proper ancestor directories of a path from the root ('') down."""
    parts = segments(path)
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, 1, i), "/")),
    )
