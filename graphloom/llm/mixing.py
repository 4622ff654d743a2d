"""Mixing sources to target weights by a splitting tree (operator 4).

Every source is cut into blocks, hash buckets of its documents. The quota of a
source is the number of block copies the mix takes from it: all blocks in each
full pass, and in the last pass blocks in a permuted order until the target is
reached; of the block at the target those whole documents that fit, so that no
text is ever cut. A tree
halves the output shards again and again and draws, from the multivariate
hypergeometric distribution, how many block copies of each source go left. A
leaf is a shard with exact quotas; it takes the next block copies of each
source's permutation, so that no two shards share one, and orders its documents
by a hash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, bind, whole
from graphloom.session import checkpointed

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: The mix is split into shards of about so many words.
SHARD_WORDS = 1 << 25
BLOCK_WORDS = 1 << 16
#: A source has at most so many blocks; they grow beyond that.
MAX_BLOCKS = 1 << 16
SEED = 20


def n_words(text: str | Column) -> Column:
    return F.size(F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))).cast("long")


def shuffled(*parts: Column | int | str) -> Column:
    """Reproducible random 64 bits for the given values."""
    return F.xxhash64(F.lit(SEED), *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sid, source, source_size, target`` from ``source, size`` rows.

    Sources by code point, null last, take the weights in turn. The mix is as
    large as all sources; no target exceeds ``repeats`` times its source, and
    the excess goes to the others by weight. With sources in order of the share
    at which they fill up, the level of the open ones is the largest of the
    levels left after each prefix. One row a source: a small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "sid")
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.get(F.lit(list(weights)), (F.col("sid") - 1) % len(weights)).cast("double")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name)).withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * repeats).withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
                    / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(everything))
        .select("sid", "source", "source_size",
                F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def hypergeometric(good: Column, all_: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` from ``all_`` are among the ``good``: the inverse
    distribution at ``u``, summed over ten deviations around the mean."""
    g, a, n = good.cast("double"), all_.cast("double"), drawn.cast("double")
    mean = F.when(a > 0, n * g / a).otherwise(0.0)
    dev = F.when(a > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (1 - g / a) * (a - n) / (a - 1)))).otherwise(0.0)
    low = F.greatest(F.lit(0.0), n + g - a, F.floor(mean - 10 * dev - 10).cast("double"))
    high = F.least(g, n, F.ceil(mean + 10 * dev + 10).cast("double"))
    ks = F.sequence(low.cast("long"), high.cast("long"))

    def onward(k: Column) -> Column:
        k = k.cast("double")
        return (g - k) * (n - k) / ((k + 1) * (a - g - n + k + 1))

    total = F.aggregate(
        ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
        lambda acc, k: F.struct((acc["w"] * onward(k)).alias("w"), (acc["s"] + acc["w"]).alias("s")), lambda acc: acc["s"],
    )

    def pick(level: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("k"))
        return F.aggregate(ks, start, lambda acc, k: F.struct(
            (acc["w"] * onward(k)).alias("w"), (acc["s"] + acc["w"]).alias("s"),
            F.coalesce(acc["k"], F.when(acc["s"] + acc["w"] >= level, k)).alias("k"),
        ), lambda acc: F.coalesce(acc["k"], high.cast("long")))

    return bind(u * total, pick)


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``shard, sid, n``: the quotas ``sid, n`` divided among the shards.

    A node is one row with the quotas of every source. Its left half of shards
    gets its share of all block copies; source after source, the number of that
    source among them is drawn from what is left.
    """
    entry = F.sort_array(F.collect_list(F.struct("sid", "n")))
    nodes = quotas.agg(entry.alias("q")).select(F.lit(0).alias("first"), F.lit(shards).alias("last"), "q")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        wide = F.col("last") - F.col("first") > 1
        mid = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        everything = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        portion = F.round(everything * (mid - F.col("first")) / (F.col("last") - F.col("first"))).cast("long")
        start = F.struct(portion.alias("n"), everything.alias("all"),
                         F.array().cast("array<struct<sid:int,n:bigint>>").alias("left"))

        def draw(acc: Column, x: Column) -> Column:
            u = F.pmod(shuffled("split", F.col("first"), F.col("last"), x["sid"]), F.lit(1 << 52)) / float(1 << 52)
            return bind(hypergeometric(x["n"], acc["all"], acc["n"], u), lambda k: F.struct(
                (acc["n"] - k).alias("n"), (acc["all"] - x["n"]).alias("all"),
                F.concat(acc["left"], F.array(F.struct(x["sid"].alias("sid"), k.alias("n")))).alias("left")))

        left = F.aggregate("q", start, draw, lambda acc: acc["left"])
        right = F.zip_with("q", "left", lambda x, l: F.struct(x["sid"].alias("sid"), (x["n"] - l["n"]).alias("n")))
        halves = F.array(
            F.struct(F.col("first"), mid.alias("last"), F.col("left").alias("q")),
            F.struct(mid.alias("first"), F.col("last"), right.alias("q")),
        )
        done = F.array(F.struct("first", "last", "q"))
        nodes = nodes.withColumn("left", left).select(F.inline(F.when(wide, halves).otherwise(done)))
    return nodes.select(F.col("first").alias("shard"), F.inline("q"))


def draws(sizes: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, weights=WEIGHTS,
          repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """The rows with their source's figures, and what the mix takes of them:
    ``row, shard, pass, block, words, position``, one row per copy.

    ``sizes`` holds ``row`` (unique), ``doc_id``, ``mark`` (a hash of the text),
    ``source``, ``size``. Documents without words are taken with no words;
    sources without words have target 0. Only rows alike in all of these may
    change places between runs.
    """
    plan = checkpointed(targets(sizes, weights, repeats))
    whole_passes = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    plan = (
        plan.withColumn("take", F.round("target").cast("long")).withColumn("passes", whole_passes.cast("int"))
        .withColumn("rest", F.col("take") - F.col("passes") * F.col("source_size"))
        .withColumn("n_blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))))
    )
    if shards is None:
        everything = plan.agg(F.sum("take")).first()[0] or 0
        shards = max(1, math.ceil(everything / SHARD_WORDS))
    block = F.pmod(shuffled("block", F.col("doc_id")), F.col("n_blocks")).cast("int")
    rows = checkpointed(
        sizes.withColumnRenamed("source", "_source")
        .join(plan, F.col("_source").eqNullSafe(F.col("source")))
        .select("row", "doc_id", "mark", "size", "sid", "source_size", "target", block.alias("block"))
    )
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words")).join(
        plan.select("sid", "passes", "rest"), "sid")
    order = shuffled("order", F.col("sid"), F.col("block"))
    so_far = F.sum("words").over(Window.partitionBy("sid").orderBy(order, "block"))
    full = blocks.select("sid", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"), "passes").filter(
        "pass < passes").select("sid", "block", "pass", F.lit(None).cast("long").alias("limit"))
    last = (
        blocks.withColumn("so_far", so_far).filter(F.col("so_far") - F.col("words") < F.col("rest"))
        .select("sid", "block", F.col("passes").alias("pass"),
                F.when(F.col("so_far") > F.col("rest"), F.col("rest") - F.col("so_far") + F.col("words")).alias("limit"))
    )
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(
        shuffled("copy", F.col("sid"), F.col("block"), F.col("pass")), "block", "pass"))
    copies = checkpointed(full.unionByName(last).withColumn("rank", rank))
    quotas = copies.groupBy("sid").agg(F.count("*").alias("n"))
    # a leaf takes the next copies of each source's order: one row per place
    end = F.sum("n").over(Window.partitionBy("sid").orderBy("shard"))
    places = split_quotas(quotas, shards).withColumn("end", end).filter("n > 0").select(
        "sid", "shard", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("rank"))
    placed = copies.join(places, ["sid", "rank"]).select("sid", "block", "pass", "limit", "shard")
    taken = rows.select("row", "doc_id", "mark", "size", "sid", "block").join(placed, ["sid", "block"])
    parts = [taken.filter(F.col("limit").isNull()), _fitting(taken.filter("limit IS NOT NULL AND size > 0"))]
    out = reduce(DataFrame.unionByName, parts).select(
        "row", "shard", "pass", "block", F.col("size").alias("words"),
        shuffled("position", F.col("shard"), F.col("pass"), F.col("doc_id"), F.col("mark")).alias("position"))
    return rows, out


def _fitting(cut: DataFrame, rounds: int = 3) -> DataFrame:
    """The whole documents of each source's block at the target (``limit`` words
    of it are wanted) that are taken.

    In an order by hash, each round takes documents while they fit into what is
    missing, leaving out those that are larger by themselves. At the end the
    smallest document left comes too, if that brings the source nearer.
    """
    order = [shuffled("cut", F.col("doc_id")), F.col("doc_id"), F.col("mark"), F.col("row")]
    source, onward = Window.partitionBy("sid"), Window.partitionBy("sid").orderBy(*order)
    cut = cut.withColumn("in", F.lit(False))

    def missing() -> Column:
        return F.col("limit") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).over(source)

    for _ in range(rounds):
        cut = cut.withColumn("missing", missing())
        fits = ~F.col("in") & (F.col("size") <= F.col("missing"))
        so_far = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(onward)
        cut = cut.withColumn("in", F.col("in") | (fits & (so_far <= F.col("missing"))))
    least = F.min(F.when(~F.col("in"), F.struct("size", *[o.alias(f"k{i}") for i, o in enumerate(order)]))).over(source)
    return (
        cut.withColumn("missing", missing()).withColumn("least", least)
        .filter(F.col("in") | ((F.col("row") == F.col("least.k3")) & (2 * F.col("missing") > F.col("size"))))
        .drop("in", "missing", "least")
    )


def _marked(docs: DataFrame, row: str | Column) -> DataFrame:
    return docs.select(row, "doc_id", F.xxhash64("text").alias("mark"), "source", n_words("text").alias("size"))


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, mark, source, size`` of every row, stored, so that ``row`` holds."""
    return checkpointed(_marked(docs, F.monotonically_increasing_id().alias("row")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row.

    ``copies`` are the places of the row in the mix, an array of ``shard,
    position, words`` with at most ``repeats`` entries, and ``taken`` is their
    sum. Repeated rows are documents of their own, equal ones with one position
    in a shard; a null text has size 0; a
    null source is one.
    """
    rows, out = draws(sized(docs), **options)
    copies = out.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("shard", "position", "words"))).alias("copies"))
    none = F.array().cast("array<struct<shard:int,position:bigint,words:bigint>>")
    return (
        rows.join(copies, "row", "left").withColumn("copies", F.coalesce("copies", none))
        .select("doc_id", "size", "source_size", "target",
                F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), "copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row of ``docs``, with its whole text, per copy taken,
    and its ``mix_shard`` and ``mix_position``."""
    stored = checkpointed(docs.withColumn("mix_row", F.monotonically_increasing_id()))
    _, out = draws(checkpointed(_marked(stored, F.col("mix_row").alias("row"))), **options)
    places = out.select(F.col("row").alias("mix_row"), F.col("shard").alias("mix_shard"), F.col("position").alias("mix_position"))
    return stored.join(places, "mix_row").drop("mix_row")
