"""Text expressions: tokens, personal data, hashes, Markdown pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import dims

TOKEN = r"([a-z0-9_]+|[\x{4e00}-\x{9fff}])"


def tokens(text: Column) -> Column:
    """Lower-cased word runs; each CJK character alone (FN21)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def plural_stem(token: Column) -> Column:
    """Drop a plural s from longer tokens (FN22)."""
    return F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.regexp_replace(token, "s$", "")).otherwise(token)


def pii_counts(text: Column, patterns: dict[str, str] | None = None) -> list[Column]:
    """One count column per personal-data kind (TX7, UD2)."""
    found = patterns or dims.PII_PATTERNS
    return [F.size(F.regexp_extract_all(text, F.lit(rx), F.lit(0))).cast("long").alias(kind) for kind, rx in found.items()]


def sensitivity(text: Column, custom: list[tuple[str, str]] | None = None) -> Column:
    """restricted > confidential > internal > public (TX8); ``custom`` patterns
    are further finds of a known kind, as (kind, regex) (UD2)."""

    def any_of(*kinds: str) -> Column:
        out = F.lit(False)
        for k, rx in [*dims.PII_PATTERNS.items(), *(custom or [])]:
            if k in kinds:
                out = out | text.rlike(rx)
        return out

    return (
        F.when(any_of("creditcard", "ssn", "apikey"), "restricted")
        .when(any_of("email", "phone"), "confidential")
        .when(any_of("ipv4", "url"), "internal")
        .otherwise("public")
    )


def _spans(text: Column, place: int, rx: str) -> Column:
    """``(begin, place, end)`` of every match in the original text: what lies
    between the matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    pairs = F.arrays_zip(F.split(text, rx).alias("gap"), hits.alias("hit"))
    none = F.array().cast("array<struct<begin:int,place:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        span = F.struct(begin.alias("begin"), F.lit(place).alias("place"), (begin + F.length(p["hit"])).alias("end"))
        return F.when(p["hit"].isNull(), acc).otherwise(
            F.struct(span["end"].alias("at"), F.array_append(acc["out"], span).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(rx), F.aggregate(pairs, start, step)["out"]).otherwise(none)


def redact(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Replace personal data by typed placeholders (TX9).

    All kinds are found in the original text. Overlapping finds are one span,
    which takes the placeholder of the first of them, so no part of any find
    stays in clear.
    """
    found = patterns or dims.PII_PATTERNS
    spans = F.array_sort(F.concat(*[_spans(text, k, rx) for k, rx in enumerate(found.values())]))
    names = F.array(*[F.lit(f"[REDACTED_{kind.upper()}]") for kind in found])

    def step(acc: Column, s: Column) -> Column:
        shown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["begin"] - acc["at"]), F.get(names, s["place"]))
        return F.when(
            s["begin"] >= acc["at"], F.struct(s["end"].alias("at"), shown.alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\s*\n"


def without_front_matter(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, FRONT_MATTER, ""))


def first_heading(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1))


def front_matter_value(text: Column, key: str) -> Column:
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:(.*)$", 1)), F.lit(""))


def wiki_links(text: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|display]]``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1)), lambda t: F.trim(t))


def first_paragraph(text: Column) -> Column:
    """First paragraph after the H1 (else from the start), at most 200 characters."""
    lines = F.transform(F.split(without_front_matter(text), "\n"), lambda s: F.trim(s))

    def paragraph(rows: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            started = F.size(acc["para"]) > 0
            ends = started & ((s == "") | s.startswith("#"))
            skip = (s == "") | s.startswith(">") | s.startswith("#") | s.rlike(r"^[-*_]{3,}\s*$")
            return (
                F.when(acc["done"] | ends, F.struct(acc["para"].alias("para"), F.lit(True).alias("done")))
                .when(skip, acc)
                .otherwise(F.struct(F.array_append(acc["para"], s).alias("para"), F.lit(False).alias("done")))
            )

        start = F.struct(F.array().cast("array<string>").alias("para"), F.lit(False).alias("done"))
        return F.array_join(F.aggregate(rows, start, step)["para"], " ")

    at = F.array_position(F.transform(lines, lambda s: s.startswith("# ")), True)
    after = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    chosen = F.coalesce(F.nullif(paragraph(after), F.lit("")), paragraph(lines))
    return F.when(F.length(chosen) > 200, F.concat(F.substring(chosen, 1, 197), F.lit("..."))).otherwise(chosen)
