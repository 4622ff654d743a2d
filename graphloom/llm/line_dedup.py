"""Line dedup over levelled sorted runs of line hashes (operator 5).

Documents come in batches, the largest ids first. A run is a table sorted by
line hash, one row per key of its batch: the document that keeps the key (the
largest id, known when the key is first seen) and the number of documents that
hold it. A batch is split by a merge join against the runs: keys found in none
(anti join) enter the new run with their keeper, the others only add to the
count. When a level has ``FAN`` runs they are compacted into one of the next
level. Keys are 128-bit hashes, so equal hashes are taken as equal lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, bind, whole
from graphloom.session import checkpointed

BATCHES = 4
FAN = 2
MIN_CHARS = 40
MIN_DOCS = 5
KEY = ["h1", "h2"]
#: White space stripped at the ends of a line.
ENDS = " \t\n\x0b\x0c\r"


def lines(text: str | Column) -> Column:
    return F.split(whole(text), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ENDS)))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: ``doc_id, pos, h1, h2``."""
    long = docs.select("doc_id", F.posexplode(F.transform(lines("text"), line_key)).alias("pos", "key"))
    return long.filter(F.length("key") >= min_chars).select("doc_id", "pos", *hashes(F.col("key")))


def sorted_run(df: DataFrame) -> DataFrame:
    """Store ``df`` sorted by key, so that later merges read it in order."""
    return checkpointed(df.repartition(*KEY).sortWithinPartitions(*KEY))


def compact(runs: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, runs)
    return sorted_run(every.groupBy(*KEY).agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n")))


class Runs:
    """The levels: lists of runs, younger levels first."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Take in ``h1, h2, keeper, n`` rows, one per key of the batch, whose
        documents all have smaller ids than those of earlier batches."""
        seen = self.all()
        if seen:
            known = reduce(DataFrame.unionByName, [r.select(*KEY) for r in seen])
            batch = checkpointed(batch)
            fresh = batch.join(known, KEY, "left_anti")
            again = batch.join(known, KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            batch = fresh.unionByName(again)
        run, at = sorted_run(batch), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(run)
            if len(self.levels[at]) < self.fan:
                return
            run, self.levels[at] = compact(self.levels[at]), []
            at += 1


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """``doc_id, drops``: the positions of the lines that each document loses."""
    cuts = docs.select(F.expr(f"percentile_approx(doc_id, array({', '.join(str(k / batches) for k in range(1, batches))}))")
                       ).first()[0] or []
    batch = reduce(lambda c, cut: c + (F.col("doc_id") > cut).cast("int"), sorted(set(cuts)), F.lit(0))
    rows = checkpointed(keyed_lines(docs.filter("doc_id IS NOT NULL"), min_chars).withColumn("batch", batch))
    runs = Runs()
    for b in range(len(set(cuts)), -1, -1):
        keys = (
            rows.filter(F.col("batch") == b).select(*KEY, "doc_id").distinct()
            .groupBy(*KEY).agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n"))
        )
        runs.add(keys)
    dropped = compact(runs.all()).filter(F.col("n") >= min_docs).select(*KEY, "keeper")
    return (
        rows.join(dropped, KEY).filter(F.col("doc_id") < F.col("keeper"))
        .groupBy("doc_id").agg(F.collect_set("pos").alias("drops"))
    )


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and ``n_lines`` and
    ``n_dropped``.

    A line is known by its key: ASCII white space stripped, A-Z lower-cased. A
    key of at least ``min_chars`` code points held by at least ``min_docs``
    documents stays in the largest ``doc_id`` alone, there with all its lines.
    A null or empty text is one empty line. Rows that repeat a ``doc_id`` are
    one document; a null id keeps its lines and counts for no key.
    """
    drops = repeated_lines(docs, min_chars, min_docs, batches).withColumnsRenamed({"doc_id": "_id", "drops": "_drops"})
    places = F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1)
    kept = bind(lines("text"), lambda split: F.transform(F.array_except(places, "_drops"), lambda i: F.get(split, i)))
    return (
        docs.join(drops, F.col("doc_id") == F.col("_id"), "left")
        .withColumn("n_lines", F.size(lines("text")).cast("long"))
        .withColumn("n_dropped", F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long"))
        .withColumn("text", F.when(F.col("_drops").isNull(), whole("text")).otherwise(F.array_join(kept, "\n")))
        .drop("_id", "_drops")
    )


ORACLE = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < h.keeper, false) AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
