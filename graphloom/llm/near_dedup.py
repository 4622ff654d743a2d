"""Near-duplicate documents by HyperMinHash (operator 8).

A document's shingles fall into 2^P buckets by their hash. A bucket keeps, of
the shingle with the most leading zeros, that number and R bits behind it: one
16-bit register. Empty registers take a full one by a fixed probe order, so that
short documents compare like long ones. Bands of registers give candidates; the
registers give a first Jaccard estimate, corrected for chance collisions; full
shingle sets decide.

Documents of equal shingle sets are one class, named by the digest of the set.
First every class is compared with one pivot, the best of its bands, which
joins most of a group; then classes of different components are compared
inside tasks, so no link that joins two components is lost. Only links become
rows, and of those only as many as join something.
"""

from __future__ import annotations

import functools
import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, whole
from graphloom.operators.graphalg import components
from graphloom.session import checkpointed

P = 9
R = 10
#: Registers of a band; 42 bands of 6 miss a pair at 0.8 with chance 3e-6.
ROWS, BANDS = 6, 42
#: Estimates are dropped if so many deviations below the threshold.
DEVIATIONS = 5
#: Members of one band that are compared in one task at a time.
BLOCK = 512
#: Rounds of comparing each class with one pivot.
ROUNDS = 1
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHE = 500_000


def mixed64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word, remembered up to ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, A-Z lower-cased;
    of the whole sequence where it is shorter, none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    at = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    key = np.full(n, width, np.uint64)
    for k in range(width):
        key = mixed64(key * _M1 + at[k:n + k])
    return np.unique(key)


def _lenders(bucket: np.ndarray, turn: int, p: int) -> np.ndarray:
    """The bucket that an empty one borrows from at a turn."""
    return (mixed64((bucket.astype(np.uint64) << np.uint64(32)) + np.uint64(turn)) >> np.uint64(64 - p)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def _lender_table(p: int) -> list[np.ndarray]:
    """The lenders of all buckets at the first turns (4 MB for 512 buckets)."""
    return [_lenders(np.arange(1 << p), turn, p).astype(np.uint16) for turn in range(1, 4097)]


def registers(values: np.ndarray, p: int = P, r: int = R) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes: leading zeros above ``r``
    bits of mantissa, the largest zero count and then the smallest mantissa."""
    bucket = (values >> np.uint64(64 - p)).astype(np.int64)
    rest = values << np.uint64(p)
    # within a bucket the smallest remainder has the most leading zeros and the smallest bits behind them
    first = np.r_[True, bucket[1:] != bucket[:-1]]  # values are sorted, so it comes first
    bucket, rest = bucket[first], rest[first]
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(np.float64))), 62).astype(np.int64)
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - r)).astype(np.int64)
    out = np.full(1 << p, -1, np.int64)
    out[bucket] = zeros << r | mantissa
    empty = np.flatnonzero(out < 0)
    full, turn, table = out.copy(), 0, _lender_table(p)
    while len(empty):  # borrow from buckets met in a fixed pseudo-random order
        turn += 1
        value = full[table[turn - 1][empty] if turn <= len(table) else _lenders(empty, turn, p)]
        out[empty] = value
        empty = empty[value < 0]
    return out.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, r: int = R) -> np.ndarray:
    """Jaccard estimates of register rows, less the share that agrees by chance:
    two different minima have equal zero counts with chance 1/3 and then equal
    mantissas with chance 2^-r."""
    chance = 2.0 ** -r / 3
    return (np.count_nonzero(a == b, axis=1) / b.shape[1] - chance) / (1 - chance)


SKETCH = "n_shingles long, class binary, sketch binary"


def sketched(docs: DataFrame, width: int, p: int = P, r: int = R) -> DataFrame:
    """``doc_id`` and the fields of ``SKETCH``; nulls where there is no shingle."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            values = shingles(text, width)
            if len(values):
                out.append((len(values), xxhash.xxh3_128_digest(values.tobytes()), registers(values, p, r).tobytes()))
            else:
                out.append((0, None, None))
        return pd.DataFrame(out, columns=["n_shingles", "class", "sketch"])

    return docs.select("doc_id", F.pandas_udf(run, SKETCH)(whole("text")).alias("s")).select("doc_id", "s.*")


def bands(sketch: str, rows: int = ROWS, n: int = BANDS) -> Column:
    """Hashes of the bands of a packed sketch."""
    size = 2 * rows
    return F.array(*[F.xxhash64(F.lit(k), F.substring(sketch, k * size + 1, size)) for k in range(n)])


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``class, shingles``: sorted hashes of each text, packed, and their digest."""

    def run(texts: pd.Series) -> pd.DataFrame:
        packed = [shingles(t, width).tobytes() for t in texts]
        return pd.DataFrame({"class": [xxhash.xxh3_128_digest(b) for b in packed], "shingles": packed})

    return docs.select(F.pandas_udf(run, "class binary, shingles binary")(whole("text")).alias("s")).select("s.*")


def least_estimate(size: np.ndarray, registers: int, threshold: float) -> np.ndarray:
    """Estimates below this are no links; short texts have fewer registers of their own."""
    return threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.minimum(size, registers))


def _close(threshold: float, r: int):
    def run(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(c), np.uint16).reshape(len(c), -1) for c in (a, b))
        return pd.Series(estimate(x, y, r) >= least_estimate(n.to_numpy(), x.shape[1], threshold))

    return run


def linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the threshold."""
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= percent * (len(u) + len(v) - both)


def _linked(percent: int):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)], dtype=bool)

    return run


def comparable(percent: int) -> Column:
    """Whether two different sets of ``_na`` and ``_nb`` shingles can reach the
    threshold: they share all of the smaller one at most, one less if equally large."""
    most = F.least("_na", "_nb") - (F.col("_na") == F.col("_nb")).cast("int")
    return most * 100 >= (F.col("_na") + F.col("_nb") - most) * percent


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of class representatives that are linked."""
    close = F.pandas_udf(_close(percent / 100, R), "boolean")
    near = checkpointed(
        pairs.join(reps.toDF("a", "_na", "_x"), "a").join(reps.toDF("b", "_nb", "_y"), "b").filter(comparable(percent))
        .filter(close("_x", "_y", F.least("_na", "_nb"))).select("a", "b")
    )
    return checkpointed(
        near.join(sets.toDF("a", "_x"), "a").join(sets.toDF("b", "_y"), "b")
        .filter(F.pandas_udf(_linked(percent), "boolean")("_x", "_y")).select("a", "b")
    )


def _pivot_pairs(banded: DataFrame, percent: int) -> DataFrame:
    """One pair ``a, b`` for each member of a mixed band: ``b`` with the pivot
    that meets most others, over its bands. Pivots of a band are taken from
    outside its main component, if there is one; ``banded`` has ``band, rep,
    n_shingles, met, component, main``."""
    entry = F.struct("met", F.col("rep").alias("a"), F.col("n_shingles").alias("_na"), F.col("component").alias("_ca"))
    outside = F.col("main").isNull() | (F.col("component") != F.col("main"))
    pivots = banded.filter(outside).groupBy("band").agg(F.max(entry).alias("pivot"))
    met = banded.filter(outside).join(pivots, "band").select(
        F.col("rep").alias("b"), F.col("n_shingles").alias("_nb"), "component", "pivot.*").filter(
        (F.col("component") != F.col("_ca")) & comparable(percent))
    best = met.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best"))
    return best.select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b")).distinct()


def _mixed(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of bands with several components, with ``component``, the
    band's largest one as ``main`` (null while all are single), and the sizes
    inside (``n_main``) and outside of it (``n_rest``)."""
    member = banded.join(labels, "rep")
    each = member.groupBy("band", "component").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "component"))
    sizes = each.groupBy("band").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), top.alias("top")).filter("kinds > 1")
    return member.join(sizes.select(
        "band", F.when(F.col("top.n") > 1, F.col("top.component")).alias("main"),
        F.when(F.col("top.n") > 1, F.col("top.n")).otherwise(0).alias("n_main"), F.col("all")), "band"
    ).withColumn("n_rest", F.col("all") - F.col("n_main")).drop("all")


class _Block:
    """Members of one block pair of a band; side 0 meets side 1, or itself."""

    def __init__(self, group: pd.DataFrame, percent: int, r: int):
        group = group.drop_duplicates("rep")
        left, self.band = group["side"].to_numpy() == 0, group["at"].iloc[0]
        self.sides = [group, group] if left.all() else [group[left], group[~left]]
        self.same, self.threshold, self.r = left.all(), percent / 100, r

    def near(self):
        """For each member of side 0, the members of side 1 it may be linked
        with, most alike first. Pairs that share an earlier band are left to it."""
        first, second = self.sides
        if not len(first) or not len(second):
            return
        regs = [np.frombuffer(b"".join(g["sketch"]), np.uint16).reshape(len(g), -1) for g in self.sides]
        cut = [x[:, :BANDS * ROWS].reshape(len(x), BANDS, ROWS) for x in regs]
        size, part = ([g[c].to_numpy() for g in self.sides] for c in ("n_shingles", "component"))
        for k in range(len(first)):
            small, large = np.minimum(size[0][k], size[1]), np.maximum(size[0][k], size[1])
            go = np.flatnonzero((part[0][k] != part[1]) & (small >= self.threshold * large))
            if self.same:
                go = go[go > k]
            if not len(go):
                continue
            close = estimate(regs[0][k:k + 1], regs[1][go], self.r)
            fit = close >= least_estimate(small[go], regs[1].shape[1], self.threshold)
            go, close = go[fit], close[fit]
            here = (cut[0][k] == cut[1][go]).all(2).argmax(1) == self.band
            if here.any():
                yield k, go[here][np.argsort(-close[here], kind="stable")]


MEMBER = "band long, at int, x int, y int, side int, rep binary, component binary"


def _near_members(group: pd.DataFrame, percent: int, r: int) -> pd.DataFrame:
    """The members of a block pair that may be linked with another."""
    block = _Block(group, percent, r)
    found: tuple[set, set] = (set(), set())
    for k, go in block.near():
        found[0].add(k)
        found[1].update(go.tolist())
    sides = [g.iloc[sorted(at)] for g, at in zip(block.sides, found)]
    return pd.concat(sides)[[c.split()[0] for c in MEMBER.split(", ")]]


def _block_links(group: pd.DataFrame, percent: int, r: int) -> pd.DataFrame:
    """Links of a block pair that join something, decided by full sets, unless
    links found here have joined the two already."""
    block = _Block(group, percent, r)
    part, rep, sets = ([g[c].tolist() for g in block.sides] for c in ("component", "rep", "shingles"))
    parent: dict[bytes, bytes] = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for k, go in block.near():
        for at in go:
            x, y = root(part[0][k]), root(part[1][at])
            if x != y and linked(np.frombuffer(sets[0][k], np.uint64), np.frombuffer(sets[1][at], np.uint64), percent):
                parent[x] = y
                out.append((rep[0][k], rep[1][at]))
    return pd.DataFrame(out, columns=["a", "b"])


def _each_block(step, percent: int, r: int):
    """``step`` of every block pair; rows come sorted by it."""

    def run(batches):
        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf])
            keys = pdf[["band", "x", "y"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip(np.r_[0, cuts[:-1]], cuts):
                yield step(pdf.iloc[lo:hi], percent, r)
            kept = pdf.iloc[cuts[-1] if len(cuts) else 0:]  # the last group may go on
        if kept is not None and len(kept):
            yield step(kept, percent, r)

    return run


def _across(mixed: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between members of one band in different components.

    Members outside the band's main component, in blocks by hash, meet all
    others block by block inside tasks; blocks are bounded, so a band of any
    size is spread over its block pairs. ``y`` counts main blocks from 0 and
    other blocks down from -1; ``side`` 0 is block ``x``. Sketches find the
    members that may be linked; full sets travel for these alone.
    """

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def each(n: str) -> Column:
        return F.when(blocks(n) > 0, F.sequence(F.lit(0), blocks(n) - 1)).otherwise(F.array().cast("array<int>"))

    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.greatest(F.lit(1), F.when(
        F.coalesce(F.col("component") == F.col("main"), F.lit(False)), blocks("n_main")).otherwise(blocks("n_rest")))).cast("int")
    placed = mixed.withColumn("own", own)
    inside = F.coalesce(F.col("component") == F.col("main"), F.lit(False))

    def at(x: Column, y: Column, side: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), side.alias("side"))

    rest = F.concat(
        F.transform(each("n_main"), lambda j: at(F.col("own"), j, F.lit(0))),
        F.transform(each("n_rest"), lambda j: at(
            F.least(F.col("own"), j), -1 - F.greatest(F.col("own"), j), (F.col("own") > j).cast("int"))))
    main = F.transform(each("n_rest"), lambda i: at(i, F.col("own"), F.lit(1)))
    spread = checkpointed(placed.select("band", "at", "rep", "component", F.inline(F.when(inside, main).otherwise(rest))))
    def blocked(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions(mixed.sparkSession), "band", "x", "y")
        return dealt.sortWithinPartitions("band", "x", "y")

    near = checkpointed(blocked(spread.join(reps, "rep")).mapInPandas(_each_block(_near_members, percent, R), MEMBER))
    full = near.join(reps, "rep").join(sets.withColumnRenamed("class", "rep"), "rep")
    return blocked(full).mapInPandas(_each_block(_block_links, percent, R), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents are linked where the shared shingles are at least ``percent`` of
    all; a component takes its smallest ``doc_id``, which is kept. A text
    without words (null included) has no shingles and is linked with nothing.
    Equal rows give equal rows; an id with several texts may stand in several
    components. A row without id is compared like any other; its component is
    null if none of its rows has an id, and it is never kept. Other columns are
    not looked at; of an empty table the result is empty.
    """
    known = checkpointed(sketched(docs, width))
    classes = checkpointed(
        known.filter("n_shingles > 0").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    banded = classes.select(F.col("class").alias("rep"), "n_shingles", F.posexplode(bands("sketch")).alias("at", "band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    banded = checkpointed(banded.join(crowded, "band"))
    met = banded.groupBy("rep").agg(F.sum("n").alias("met"))
    banded = checkpointed(banded.drop("n").join(met, "rep"))
    inside = checkpointed(banded.select(F.col("rep").alias("id")).distinct())
    reps = classes.select(F.col("class").alias("rep"), "n_shingles", "sketch").join(inside.toDF("rep"), "rep", "left_semi")
    # a text of every class; other texts of the same id come along and go again
    ids = checkpointed(
        classes.join(inside.toDF("class"), "class", "left_semi").select(F.col("doc_id").alias("_id")).distinct())
    texts = checkpointed(  # stored, so that no other text is cut into shingles again
        docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text"))
    sets = checkpointed(
        shingle_sets(texts, width).join(inside.toDF("class"), "class", "left_semi").dropDuplicates(["class"]))
    labels, links = inside.select(F.col("id").alias("rep"), F.col("id").alias("component")), None
    for _ in range(ROUNDS):
        pairs = checkpointed(_pivot_pairs(_mixed(banded, labels), percent))
        if pairs.isEmpty():
            break
        found = _verified(pairs, reps, sets, percent)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = components(inside, links.toDF("source", "target")).toDF("rep", "component")
    more = checkpointed(_across(_mixed(banded, labels).drop("n_shingles", "met"), reps, sets, percent))
    if not more.isEmpty():
        links = more if links is None else links.unionByName(more)
        labels = components(inside, links.toDF("source", "target")).toDF("rep", "component")
    named = classes.select("class", "doc_id").join(labels.withColumnRenamed("rep", "class"), "class", "left").select(
        "class", "doc_id", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(named.drop("doc_id").join(least, "component"), "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
