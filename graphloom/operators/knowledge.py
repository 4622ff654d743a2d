"""Layers of a knowledge base (ST8) and homes for orphan rows (JN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.dedup import pick_one
from graphloom.session import checkpointed

# Characters of a seed; shorter needles are seeds themselves.
GRAM = 4


def _grams(value: Column, length: int) -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def containment_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """``(n_id, h_id)`` for each ``needles(n_id, needle)`` inside a
    ``haystacks(h_id, text)``; empty needles and null texts match nothing.

    Of a needle's character runs the rarest in the texts is its seed. Seeds meet
    the distinct runs of the texts in an equi-join, and only those pairs are
    compared, so the texts are read the same few times for any number of needles.
    """
    words = checkpointed(needles.select("needle").filter("needle <> ''").distinct())
    size = F.least(F.length("needle"), F.lit(GRAM))
    lengths = [r[0] for r in words.select(size).distinct().collect()]  # four small numbers at most
    if not lengths:
        return needles.select("n_id", F.lit("").alias("h_id")).limit(0)
    own = F.lit(None)
    for n in lengths:
        own = F.when(size == n, _grams(F.col("needle"), n)).otherwise(own)
    runs = words.select("needle", F.explode(F.array_distinct(own)).alias("gram"))
    texts = haystacks.select("h_id", "text").filter("text IS NOT NULL")
    posted = texts.select("h_id", F.explode(F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in lengths]))).alias("gram"))
    posted = checkpointed(posted.join(runs.select("gram").distinct(), "gram", "left_semi"))
    found = posted.groupBy("gram").agg(F.count("*").alias("n"))
    seeds = (
        runs.join(found, "gram", "left").groupBy("needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    near = posted.join(seeds, "gram").select("h_id", "needle")
    hits = near.join(texts, "h_id").filter(F.contains("text", "needle")).select("needle", "h_id").distinct()
    return hits.join(needles, "needle").select("n_id", "h_id")


def containment(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """The smallest ``h_id`` per needle (see :func:`containment_pairs`)."""
    return containment_pairs(needles, haystacks).groupBy("n_id").agg(F.min("h_id").alias("h_id"))


def attach_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, article_id)`` for entities and claims (JN13), by priority: an
    edge to an article, equal id stem, a stem inside an article name or the
    reverse, the name inside a title, the name inside the content. Among equals
    the smallest article id wins."""
    kids = nodes.filter("type IN ('entity', 'claim')").select("id", "name")
    articles = nodes.filter("type = 'article'").select("id", "name", "content")
    a_ids, k_ids = articles.select("id"), kids.select("id")
    down = edges.select(F.col("source").alias("article_id"), F.col("target").alias("id"), "seq")
    up = edges.select(F.col("target").alias("article_id"), F.col("source").alias("id"), "seq")
    linked = (
        down.union(up.select("article_id", "id", "seq"))
        .join(k_ids, "id", "left_semi").join(a_ids.withColumnRenamed("id", "article_id"), "article_id", "left_semi")
    )
    direct = pick_one(linked.select("id", "article_id", "seq"), ["id"], [F.col("seq")], keep="min").select("id", "article_id")

    bare = articles.select(
        F.col("id").alias("article_id"),
        F.element_at(F.split(F.regexp_replace("id", "^article:", ""), "/"), -1).alias("bare"), F.lower("name").alias("title"),
        F.lower("content").alias("content"),
    )
    direct = checkpointed(direct)
    rest = kids.join(direct.select("id"), "id", "left_anti").select(
        "id", F.split_part(F.regexp_replace("id", "^[^:]*:", ""), F.lit(":"), F.lit(1)).alias("stem"), F.lower("name").alias("name")
    )
    stems = bare.groupBy("bare").agg(F.max("article_id").alias("article_id"))
    by_stem = rest.join(stems.withColumnRenamed("bare", "stem"), "stem").select("id", "article_id")
    rest = checkpointed(rest.join(by_stem.select("id"), "id", "left_anti"))
    inside = containment(
        rest.select(F.col("id").alias("n_id"), F.col("stem").alias("needle")),
        bare.select(F.col("article_id").alias("h_id"), F.col("bare").alias("text")),
    ).toDF("id", "article_id")
    # the other way round: article names inside the stem
    around = containment_pairs(
        bare.select(F.col("article_id").alias("n_id"), F.col("bare").alias("needle")),
        rest.select(F.col("id").alias("h_id"), F.col("stem").alias("text")),
    ).groupBy("h_id").agg(F.min("n_id").alias("article_id")).select(F.col("h_id").alias("id"), "article_id")
    by_part = inside.union(around).groupBy("id").agg(F.min("article_id").alias("article_id"))
    by_part = checkpointed(by_part)
    rest = rest.join(by_part.select("id"), "id", "left_anti").filter("name <> ''")
    by_title = containment(
        rest.select(F.col("id").alias("n_id"), F.col("name").alias("needle")),
        bare.select(F.col("article_id").alias("h_id"), F.col("title").alias("text")),
    ).toDF("id", "article_id")
    rest = rest.join(by_title.select("id"), "id", "left_anti").filter(F.length("name") >= 3)
    by_content = containment(
        rest.select(F.col("id").alias("n_id"), F.col("name").alias("needle")),
        bare.filter("content IS NOT NULL").select(F.col("article_id").alias("h_id"), F.col("content").alias("text")),
    ).toDF("id", "article_id")
    return direct.unionByName(by_stem).unionByName(by_part).unionByName(by_title).unionByName(by_content)


def category_layers(nodes: DataFrame, edges: DataFrame, categories: DataFrame, homes: DataFrame) -> DataFrame:
    """``(layer_id, node_id)`` (ST8): members by ``categorized_under``, the topic
    itself, attached children ``homes(id, article_id)``, leftovers in Other.
    ``categories(name, pos)``; a child follows the last layer of its article."""
    slug = F.replace(F.lower("name"), F.lit(" "), F.lit("-"))
    topics = categories.select(F.concat(F.lit("layer:"), slug).alias("layer_id"), F.concat(F.lit("topic:"), slug).alias("target"), "pos")
    filed = edges.filter("type = 'categorized_under'").join(topics, "target").select("layer_id", F.col("source").alias("node_id"), "pos")
    own = topics.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(
        "layer_id", F.col("target").alias("node_id"), "pos"
    )
    members = filed.unionByName(own)
    last = members.groupBy(F.col("node_id").alias("article_id")).agg(F.max_by("layer_id", "pos").alias("layer_id"))
    kids = homes.join(last, "article_id").select("layer_id", F.col("id").alias("node_id"))
    placed = members.select("layer_id", "node_id").union(kids).distinct()
    other = nodes.select(F.col("id").alias("node_id")).join(placed, "node_id", "left_anti").select(
        F.lit("layer:other").alias("layer_id"), "node_id"
    )
    return placed.unionByName(other)
