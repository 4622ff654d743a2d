"""Benchmark passages in documents by Wu-Manber search over words (operator 12).

Patterns are the windows of ``window`` consecutive words of the benchmark items.
Patterns of one length share a shift table over blocks of two words: how far the
search may jump when it stands at that block. Most blocks of a text are in no
pattern and are jumped over by nearly a window. Where the shift is zero, the
block names a bucket of patterns, their first word a part of it, and direct
comparison confirms an occurrence.

The items are searched for in blocks of bounded size, one pass over the texts a
block, so the tables in memory do not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM, ALNUM_BYTES, ascii_lower, whole
from graphloom.session import checkpointed

WINDOW = 10
#: Words of an item that stay together, and words whose patterns are searched for in one pass.
PIECE = 5_000
BLOCK_WORDS = 200_000
#: Bytes of a text that are held as words at a time.
PART = 1 << 20


class Patterns:
    """Shift table and buckets of patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.wide = length, min(2, length)
        self.far = length - self.wide + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for words, items in patterns.items():
            for end in range(self.wide, length + 1):
                block = words[end - self.wide:end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(words[-self.wide:], {}).setdefault(words[0], []).append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """First word and items of each occurrence, from left to right."""
        shift, far, last, n = self.shift.get, self.far, self.length - 1, len(words)
        at = last
        while at < n:
            block = (words[at - 1], words[at]) if self.wide == 2 else (words[at],)
            jump = shift(block, far)
            if jump:
                at += jump
                continue
            start = at - last
            for pattern, items in self.buckets[block].get(words[start], ()):
                if words[start:at + 1] == pattern:
                    yield start, items
            at += 1


def compiled(pieces: Iterable[tuple[str, list[str]]], window: int = WINDOW) -> list[Patterns]:
    """Tables for the windows of items, given as ``(item, words)``."""
    found: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, words in pieces:
        raw = tuple(w.encode() for w in words)
        size = min(window, len(raw))
        for k in range(len(raw) - size + 1 if size else 0):
            items = found.setdefault(size, {}).setdefault(raw[k:k + size], [])
            if not items or items[-1] != item:
                items.append(item)
    return [Patterns(size, patterns) for size, patterns in sorted(found.items())]


def parts(text: str, size: int = PART) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data = text.encode().translate(ALNUM_BYTES)
    lo = 0
    while lo < len(data):
        hi = len(data) if len(data) - lo <= size else data.rfind(b" ", lo, lo + size)
        if hi <= lo:  # one word fills the part
            hi = data.find(b" ", lo + size)
            hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def occurrences(text: str, tables: list[Patterns], size: int = PART) -> tuple[int, list[list[int]], list[str]]:
    """Number of words, merged spans ``[first, end)`` of hit words, items found."""
    carry: list[bytes] = []
    n, spans, items = 0, [], set()
    keep = max((t.length for t in tables), default=1) - 1
    for part in parts(text, size):
        words, base = carry + part, n - len(carry)
        for table in tables:
            for start, of in table.search(words):
                spans.append([base + start, base + start + table.length])
                items.update(of)
        n += len(part)
        carry = words[len(words) - keep:] if keep and keep < len(words) else words if keep else []
    return n, merged(spans), sorted(items)


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


FOUND = "n_words long, first array<long>, end array<long>, items array<string>"


def _searched(texts: DataFrame, tables, size: int) -> DataFrame:
    def run(column: pd.Series) -> pd.DataFrame:
        out = [occurrences(t, tables.value, size) for t in column]
        return pd.DataFrame({
            "n_words": [n for n, _, _ in out], "first": [[a for a, _ in s] for _, s, _ in out],
            "end": [[b for _, b in s] for _, s, _ in out], "items": [i for _, _, i in out]})

    return texts.withColumn("_f", F.pandas_udf(run, FOUND)("text"))


def item_pieces(items: DataFrame, window: int, piece: int) -> DataFrame:
    """``item, words``: the words of every item, long ones in pieces that share
    ``window - 1`` words; items without words are left out."""
    words = F.regexp_extract_all(ascii_lower(whole("text")), F.lit(ALNUM), F.lit(0))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(piece - window + 1))
    return rows.withColumn("at", F.explode(starts)).select("item", F.slice("w", F.col("at") + 1, F.lit(piece)).alias("words"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, piece: int = PIECE,
                 block_words: int = BLOCK_WORDS, part: int = PART) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row of ``docs``: spans are the
    word ranges ``[first, end)`` inside occurrences, items the sorted ids found.

    An item of fewer than ``window`` words is one window; without words, or with
    a null text, it is found nowhere. Null ids of items read as the empty string,
    repeated ids as one item. A null or empty document has no words. Repeated
    rows give repeated results. An empty benchmark hits nothing; of empty
    documents the result is empty. Other columns are not looked at.
    """
    if piece < 2 * window:
        raise ValueError("a piece holds at least two windows")
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole("text").alias("text"))
    stored = checkpointed(item_pieces(items, window, piece))
    total = stored.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    # by hash, so a block holds its share of the pieces and no more than a few pieces above it
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    passes = []
    for k in range(blocks):
        some = stored.filter(block == k).select("item", "words").collect()  # about block_words words
        tables = spark.sparkContext.broadcast(compiled(((r["item"], r["words"]) for r in some), window))
        found = _searched(texts, tables, part)
        if blocks == 1:
            return found.select("doc_id", "_f.n_words", F.arrays_zip("_f.first", "_f.end").alias("spans"), "_f.items")
        hits = found.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("_key"), "_f.*")
        # every row once, hits of each block
        passes.append(checkpointed(hits.filter((F.size("items") > 0) | F.lit(k == 0)).withColumn("_rows", F.lit(int(k == 0)))))
        tables.unpersist()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    union = F.pandas_udf(lambda a, b: pd.Series(
        [[x for s in merged([list(map(int, p)) for p in zip(f, e)]) for x in s] for f, e in zip(a, b)]), "array<long>")
    # rows of one id and text have the same hits
    both = every.groupBy("doc_id", "_key").agg(
        F.first("n_words").alias("n_words"), F.sum("_rows").cast("int").alias("_rows"),
        F.collect_set(F.struct("first", "end", "items")).alias("_s"),
    ).select("doc_id", "n_words", "_rows", F.flatten("_s.first").alias("_a"), F.flatten("_s.end").alias("_b"),
             F.flatten("_s.items").alias("items"))
    flat = both.withColumn("_u", union("_a", "_b"))
    spans = F.transform(F.sequence(F.lit(1), F.size("_u"), F.lit(2)), lambda k: F.struct(
        F.get("_u", k - 1).alias("first"), F.get("_u", k).alias("end")))
    none = F.array().cast("array<struct<first:long,end:long>>")
    return flat.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(
        "doc_id", "n_words", F.when(F.size("_u") > 0, spans).otherwise(none).alias("spans"),
        F.array_sort(F.array_distinct("items")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items of ``contaminated`` rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w
  FROM documents
), b AS MATERIALIZED (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w
  FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item, least(10, len(w)) AS m, list_slice(w, i, i + least(10, len(w)) - 1) AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT id, m, i, list_slice(w, i, i + m - 1) AS words
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows))
), hits AS MATERIALIZED (SELECT id, item, m, i FROM runs JOIN windows USING (m, words)),
words_hit AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY id),
items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words_hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (id) LEFT JOIN items USING (id)
"""
