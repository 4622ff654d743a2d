"""Importance resampling towards a target distribution (operator 11).

A text becomes its lower-case words, each run of separators one space. One
overlapped regex scan finds, at every word, the runs of 1 to ``order`` words
that begin there; their CRC-32, carried on from the shorter run to the longer,
names a bucket. Bucket numbers are stored once, two bytes a feature; counts over
all texts and the weights of the documents come from that table. Documents are
drawn without replacement by the Gumbel trick, so drawing is one exact ranking.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM, ALNUM_BYTES, whole
from graphloom.operators.ranking import row_numbers
from graphloom.session import checkpointed

BUCKETS = 10_000
ORDER = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25


def scanner(order: int) -> regex.Pattern:
    """At a space: the word behind it, then up to ``order - 1`` more, each run
    ending before a space. Matches overlap, so every word begins one."""
    return regex.compile(rb" ([^ ]+)" + rb"( [^ ]+)?" * (order - 1) + rb"(?= )")


def features(text: str, scan: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of words."""
    line = b" %b " % b" ".join(text.encode().translate(ALNUM_BYTES).split())
    found, crc = array("I"), zlib.crc32
    add, words = found.append, 0
    for match in scan.finditer(line, overlapped=True):
        words += 1
        value = 0
        for part in match.groups():
            if part is None:  # the text ends inside the run
                break
            value = crc(part, value)
            add(value)
    return words, (np.frombuffer(found, np.uint32) % buckets if words else np.empty(0)).astype(_width(buckets))


def _width(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucketed(rows: DataFrame, order: int = ORDER, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``rows`` with ``_words`` (number of words) and ``_buckets`` (packed bucket numbers)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        scan = scanner(order)
        out = [features(t, scan, buckets) for t in texts]
        return pd.DataFrame({"words": [n for n, _ in out], "buckets": [b.tobytes() for _, b in out]})

    made = F.pandas_udf(run, "words long, buckets binary")(whole(text))
    return rows.withColumn("_f", made).select(
        *[F.col(c) for c in rows.columns if c != text], F.col("_f.words").alias("_words"), F.col("_f.buckets").alias("_buckets"))


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all rows; a task sends each bucket once."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for b in pdf["_buckets"]:
                total += np.bincount(np.frombuffer(b, _width(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    parts = packed.select("_buckets").mapInPandas(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket: thousandths of the log ratio of its
    smoothed shares in the target and in the source, floored."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    sums = source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(  # one row each
        target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(sums)
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * (F.col("all_s") + F.lit(float(buckets))) / ((s + 1) * (F.col("all_t") + F.lit(float(buckets))))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(packed: DataFrame, gains: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """``packed`` with ``n_features`` and ``weight``, the floored mean gain."""
    shared = packed.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(some: pd.Series) -> pd.Series:
        out = np.zeros(len(some), np.int64)
        for k, b in enumerate(some):
            at = np.frombuffer(b, _width(buckets))
            if len(at):
                out[k] = int(shared.value[at].sum()) // len(at)
        return pd.Series(out)

    size = np.dtype(_width(buckets)).itemsize
    return packed.withColumn("n_features", (F.octet_length("_buckets") / size).cast("long")).withColumn(
        "weight", F.pandas_udf(run, "long")("_buckets"))


def gumbel(doc_id: str, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel value from the hash of seed and id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, order: int = ORDER,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Drawn are the ``percent`` % highest scores of the documents with at least
    ``least`` words, ties to the smaller id; others have a null rank. A null or
    empty text has no features and weight 0. A null id is hashed as the empty
    text and comes before other ids. Repeated rows are rows of their own, drawn
    one after the other. An empty target pulls to the uniform distribution; of
    empty documents the result is empty. Other columns are not looked at.
    """
    packed = checkpointed(bucketed(docs.select("doc_id", "text"), order, buckets))
    wanted = bucket_counts(bucketed(target.select("text"), order, buckets), buckets)
    table = checkpointed(bucket_gains(checkpointed(bucket_counts(packed, buckets)), checkpointed(wanted), buckets))
    gains = np.zeros(buckets, np.int64)
    for row in table.collect():  # one row a bucket
        gains[row["bucket"]] = row["gain"]
    scored = checkpointed(weights(packed, gains, buckets).select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel("doc_id", seed)).alias("score"), "_words"))
    able = scored.filter(F.col("_words") >= least)
    drawn = able.count() * percent // 100
    ranked = row_numbers(
        able.withColumn("_down", -F.col("score")), [], ["_down", "doc_id", "weight", "n_features"], "rank"
    ).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.filter(F.col("_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out))


#: CRC-32 in SQL: the table of bytes by its rule, then one step a byte.
ORACLE = f"""
WITH crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(b))
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w
  FROM documents
), b AS MATERIALIZED (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w
  FROM benchmark
), found AS MATERIALIZED (
  SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d
), wanted AS MATERIALIZED (
  SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b
), kinds AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM found UNION SELECT f FROM wanted)
), bytes AS (
  SELECT f, list_transform(range(len(h) // 2), lambda i:
    (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS y FROM kinds
), coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, y), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table
), s AS (SELECT bucket, count(*) AS n FROM found JOIN coded USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN coded USING (f) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT r.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM found) + 10000)
           / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (
  SELECT id, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS g
  FROM found JOIN coded USING (f) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
         coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         coalesce((g - ((g % n) + n) % n) // n, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score,
         len(w) >= 20 AS able
  FROM d LEFT JOIN sums USING (id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) FILTER (able) OVER () AS total
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * total // 100 THEN place END AS rank FROM ranked
"""
