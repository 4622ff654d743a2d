"""Canonical ids, complexity and direction (FN1-FN3, EP1 helper)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions.columns import blank, lookup

_PREFIX = "|".join(dims.ID_PREFIXES)


def _quoted(replacement: Column) -> Column:
    """Escape a value used as the replacement of a regular expression."""
    return F.regexp_replace(replacement, r"([\\$])", r"\\$1")


def canonical_id(node_id: Column, node_type: Column, name: Column, file_path: Column) -> Column:
    """``type:path`` form of a raw id.

    A chain of replacements that mentions the id once, so that predicates
    pushed below the projection do not multiply the expression.
    """
    single = F.regexp_replace(node_id, rf"^({_PREFIX}):\1:", "$1:")
    unprojected = F.regexp_replace(single, rf"^(?!(?:{_PREFIX}):)[^:]+:((?:{_PREFIX}):.+)$", "$1")
    modern = F.regexp_replace(unprojected, "^func:", "function:")
    kind = F.coalesce(node_type, F.lit("file"))
    prefix = F.when(kind == "func", "function").when(kind.isin(dims.NODE_TYPES), kind).otherwise("file")
    owner = F.when(blank(file_path), "__nofilepath__").otherwise(file_path)
    member = F.when(
        kind.isin("function", "class"),
        F.concat_ws(":", prefix, _quoted(owner), F.coalesce(_quoted(name), F.lit("$0"))),
    ).otherwise("$0")
    rebuilt = F.regexp_replace(modern, F.lit(rf"(?s)^(?!(?:{_PREFIX}):).+$"), member)
    return F.regexp_replace(rebuilt, F.lit(rf"^(?!(?:{_PREFIX}):)"), F.concat(prefix, F.lit(":")))


def id_fix_pattern(original: Column, corrected: Column) -> Column:
    """Label of the correction an id went through; null when unchanged."""
    first = F.split_part(original, F.lit(":"), F.lit(1))
    second = F.split_part(original, F.lit(":"), F.lit(2))
    doubled = original.rlike(rf"^({_PREFIX}):\1:")
    project = (F.size(F.split(original, ":")) >= 3) & ~first.isin(dims.ID_PREFIXES) & second.isin(dims.ID_PREFIXES)
    return (
        F.when(original == corrected, F.lit(None).cast("string"))
        .when(doubled, F.concat(first, F.lit(":"), first, F.lit(": -> "), first, F.lit(": (double prefix)")))
        .when(project, F.concat(F.lit("<project>:"), second, F.lit(": -> "), second, F.lit(": (project-name prefix)")))
        .when(
            original.startswith("func:") & corrected.startswith("function:"),
            F.lit("func: -> function: (prefix canonicalization)"),
        )
        .when(
            ~original.rlike(rf"^({_PREFIX}):"),
            F.concat(F.lit("bare path -> "), F.split_part(corrected, F.lit(":"), F.lit(1)), F.lit(": (missing prefix)")),
        )
        .otherwise(F.concat(original, F.lit(" -> "), corrected))
    )


def complexity(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    whole = word.try_cast("double").try_cast("long")
    return F.coalesce(
        F.when(word.isin(dims.COMPLEXITIES), word),
        lookup(dims.COMPLEXITY_ALIASES, word),
        F.when(whole <= 3, "simple").when(whole > 6, "complex"),
        F.lit("moderate"),
    )


def complexity_status(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    known = lookup(dims.COMPLEXITY_ALIASES, word).isNotNull() | word.try_cast("double").isNotNull()
    return F.when(word.isin(dims.COMPLEXITIES), "valid").when(known, "mapped").otherwise("unknown")


def direction(raw: Column) -> Column:
    """Merge-job direction: anything unknown becomes forward."""
    word = F.lower(raw)
    aliased = F.coalesce(lookup(dims.MERGE_DIRECTION_ALIASES, word), word)
    return F.when(aliased.isin(dims.DIRECTIONS), aliased).otherwise("forward")


def numeric_weight(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))
