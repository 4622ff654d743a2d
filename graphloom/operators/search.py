"""Ranking over text and vectors (SR1-SR7, FN19)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom import dims
from graphloom.functions import text
from graphloom.operators.ranking import top_k
from graphloom.session import checkpointed

# BM25 parameters.
K1, B = 1.5, 0.75
# Query vectors held by one task at a time.
QUERY_BLOCK = 1024
# Rows of (query, term, document) that one task of a text search sums up.
SCORED_ROWS = 1_000_000
# Query terms that are sent to every task of a text search.
ASKED_TERMS = 1 << 19
# Postings that such a task reads, and scores that it holds at a time.
TASK_POSTINGS, TASK_SCORES = 100_000, 1 << 22
# Document rows that meet a query block in one task when both sides are large.
DOC_BLOCK = 65536


def postings(docs: DataFrame) -> DataFrame:
    """``(term, id, tf, dl)`` (SR1): the index of a corpus, bucketed by term when stored."""
    toks = docs.select("id", text.tokens(F.col("text")).alias("t"))
    terms = toks.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k documents per query: ``docs(id, text)``, ``queries(query_id,
    query)``. Repeated query tokens count repeatedly; ties go to the lower id.

    The query terms cut the postings before the idf join, so the common terms
    of the corpus never move unless they are asked for. What is left of a document
    meets the queries in one task, so its scores are summed without a shuffle and
    only each task's best rows move. Queries that fit are sent to the tasks, which
    multiply blocks of documents with them; more are joined row by row.
    """
    asked = checkpointed(
        queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("q"))
    )
    # one tokenisation, stored; only the terms asked for are counted per document
    toks = checkpointed(docs.select("id", text.tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), "t"))
    corpus = toks.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))
    terms = toks.select("id", "dl", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    index = checkpointed(terms.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    norm = 1 - B + B * (F.col("dl") / F.when(F.col("avg_dl") > 0, F.col("avg_dl")).otherwise(1.0))
    few = asked.count() <= ASKED_TERMS
    weighted = (
        index.join(F.broadcast(df) if few else df, "term")
        .join(F.broadcast(corpus))  # one row
        .select(
            "term", "id",
            (F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("w"),
        )
    )
    order = [F.round("score", 9).desc(), F.col("id")]
    if few:
        parts = min(1 + index.count() // TASK_POSTINGS, 10_000)
        return top_k(_best_texts(weighted.repartition(parts, "id").sortWithinPartitions("id"), asked, k), ["query_id"], order, k)
    met = df.join(asked, "term").agg(F.sum("df")).first()[0] or 0
    scores = (
        weighted.repartition(min(1 + met // SCORED_ROWS, 10_000), "id")
        .join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
        .filter("score > 0")
    )
    return top_k(scores, ["query_id"], order, k)


def _best_texts(weighted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``, per block of documents the k best rows of each query:
    ``weighted(term, id, w)`` with the rows of an id side by side, the lower id first."""
    rows = asked.collect()
    ids = list({r["query_id"]: None for r in rows})
    place = {q: i for i, q in enumerate(ids)}
    wanted: dict[str, tuple[list, list]] = {}
    for r in rows:
        at, q = wanted.setdefault(r["term"], ([], []))
        at.append(place[r["query_id"]])
        q.append(float(r["q"]))
    types = dict(weighted.dtypes) | dict(asked.dtypes)
    query_type = to_arrow_type(asked.schema["query_id"].dataType)

    def best(doc: np.ndarray, term: np.ndarray, w: np.ndarray, terms: list[str]) -> tuple[np.ndarray, ...]:
        """Document, query and score of the best rows of one block, documents numbered from 0."""
        scores = np.zeros((int(doc[-1]) + 1, len(ids)))
        pair, back = np.unique(term * len(scores) + doc, return_inverse=True)  # an id may repeat
        w, doc, term = np.bincount(back, w), pair % len(scores), pair // len(scores)
        cuts = np.flatnonzero(np.diff(term)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(term)]):
            at, q = wanted[terms[term[a]]]
            scores[doc[a:b, None], at] += w[a:b, None] * np.asarray(q)
        top = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k].T
        query = np.repeat(np.arange(len(ids)), top.shape[1])
        found = scores[top.ravel(), query]
        return top.ravel()[found > 0], query[found > 0], found[found > 0]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        query_ids = pa.array(ids, query_type)
        doc_ids = table["id"].combine_chunks().dictionary_encode("encode")
        terms = table["term"].combine_chunks().dictionary_encode()
        doc, term = doc_ids.indices.to_numpy(), terms.indices.to_numpy().astype(np.int64)
        names, w = terms.dictionary.to_pylist(), table["w"].to_numpy()
        step = max(1, TASK_SCORES // len(ids))
        for low in range(0, int(doc[-1]) + 1, step):
            a, b = np.searchsorted(doc, [low, low + step])
            at, query, score = best(doc[a:b] - low, term[a:b], w[a:b], names)
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(query)), doc_ids.dictionary.take(pa.array(at + low)), pa.array(score)], ["query_id", "id", "score"])

    return weighted.mapInArrow(local, f"query_id {types['query_id']}, id {types['id']}, score double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero norm or a length mismatch (FN19)."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))


def _best(ids: np.ndarray, scores: np.ndarray, q_ids: list, k: int, floor: float, strict: bool) -> pd.DataFrame:
    """Per query the k best rows of a block, ties to the lower id."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], np.round(scores[:, order], 9)
    out = []
    for qi, q in enumerate(q_ids):
        row = scores[qi]
        ok = np.flatnonzero(row > floor if strict else row >= floor)
        best = ok[np.argsort(-row[ok], kind="stable")[:k]]
        out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": row[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})


def _unit(vectors: list) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def vector_top_k(
    docs: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, strict: bool = True
) -> DataFrame:
    """Exact cosine top-k per query (SR2): ``docs(id, vector)``,
    ``queries(query_id, vector)``; vectors of another length never match.

    A task multiplies a batch of documents with a block of queries and emits
    only its own top-k, so no pair leaves it. A query set of one block, found by
    counting at most ``QUERY_BLOCK`` + 1 rows, is sent to every task; a larger
    one is split into blocks that meet blocks of documents by a grouped join.
    """
    def whole(df: DataFrame) -> DataFrame:  # a null vector, or one with nulls, matches nothing
        return df.filter(F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))

    docs, queries = whole(docs), whole(queries)
    types = {c: t for c, t in docs.dtypes}
    q_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {q_type}, id {types['id']}, score double"
    head = queries.limit(QUERY_BLOCK + 1).toPandas()
    if len(head) <= QUERY_BLOCK:
        groups = [(n, g["query_id"].tolist(), _unit(g["vector"].tolist())) for n, g in head.groupby(head["vector"].map(len))]

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                lengths = pdf["vector"].map(len)
                for n, q_ids, q in groups:
                    part = pdf[lengths == n]
                    if len(part):
                        yield _best(part["id"].to_numpy(), q @ _unit(part["vector"].tolist()).T, q_ids, k, threshold, strict)

        hits = docs.select("id", "vector").mapInPandas(local, schema)
    else:
        n_q = -(-queries.count() // QUERY_BLOCK)
        n_d = -(-docs.count() // DOC_BLOCK)
        q_side = queries.select(
            "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"),
            F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("db"),
        )
        d_side = docs.select(
            "id", "vector", F.pmod(F.xxhash64("id"), F.lit(n_d)).alias("db"),
            F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"),
        )

        def block(q_pdf: pd.DataFrame, d_pdf: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
            lengths = d_pdf["vector"].map(len)
            for n, g in q_pdf.groupby(q_pdf["vector"].map(len)):
                part = d_pdf[lengths == n]
                if len(part):
                    scores = _unit(g["vector"].tolist()) @ _unit(part["vector"].tolist()).T
                    out.append(_best(part["id"].to_numpy(), scores, g["query_id"].tolist(), k, threshold, strict))
            return pd.concat(out)

        hits = (
            q_side.withColumn("qb", F.col("qb").cast("int")).withColumn("db", F.col("db").cast("int")).groupBy("qb", "db")
            .cogroup(d_side.withColumn("qb", F.col("qb").cast("int")).withColumn("db", F.col("db").cast("int")).groupBy("qb", "db"))
            .applyInPandas(block, schema)
        )
    return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def semantic_search(
    docs: DataFrame, queries: DataFrame, types: list[str] | None = None, threshold: float = 0.0, k: int = 10
) -> DataFrame:
    """Type filter, similarity >= threshold, score = 1 - similarity ascending (SR3)."""
    pool = docs.filter(F.col("type").isin(types)) if types else docs
    hits = vector_top_k(pool.select("id", "vector"), queries, k, threshold, strict=False)
    return hits.select("query_id", "id", "rank", (1 - F.col("score")).alias("score"))


def hybrid(sources: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 10) -> DataFrame:
    """Weighted sum of raw scores over each source's top 2k (SR4, UD3): every
    source is ``(query_id, id, score)``; a dict rules out duplicate names."""
    weights = weights or dims.HYBRID_WEIGHTS
    stacked = None
    for pos, (name, df) in enumerate(sources.items()):
        best = top_k(df.select("query_id", "id", "score"), ["query_id"], [F.round("score", 9).desc(), F.col("id")], 2 * k)
        rows = best.select(
            "query_id", "id", (F.col("score") * weights[name]).alias("score"),
            F.struct(F.lit(pos).alias("p"), F.lit(name).alias("name")).alias("src"),
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    names = F.transform(F.array_sort(F.collect_set("src")), lambda s: s["name"])
    merged = stacked.groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.array_join(names, ",").alias("sources"))
    return top_k(merged, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


def smart(variants: DataFrame, search, k: int = 10) -> DataFrame:
    """Search each query variant, sum by id (SR5): ``variants(query_id,
    variant)``; ``search(queries, k)`` gives ``(query_id, id, score)``."""
    keyed = variants.select(
        "query_id", "variant", F.concat_ws("\u0001", F.col("query_id").cast("string"), "variant").alias("variant_id")
    )
    asked = keyed.select(F.col("variant_id").alias("query_id"), F.col("variant").alias("query"))
    hits = search(asked, k).select(F.col("query_id").alias("variant_id"), "id", "score")
    merged = (
        hits.join(keyed, "variant_id").groupBy("query_id", "id")
        .agg(F.sum("score").alias("score"), F.count("*").alias("n_variants"))
    )
    return top_k(merged, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


# Fuzzy search fields and their weights.
FIELD_WEIGHTS = {"name": 0.4, "tags": 0.3, "summary": 0.2, "notes": 0.1}


def fuzzy(
    docs: DataFrame, queries: DataFrame, types: list[str] | None = None, threshold: float = 0.4, k: int = 50
) -> DataFrame:
    """Token-level fuzzy match over weighted fields (SR6): ``docs(id, type,
    name, tags, summary, notes)``.

    Per query token and field the distance is edit distance over length, or 0
    for containment. Distinct field tokens are compared once, however many rows
    carry them, and only tokens that share a piece with the query token
    (:func:`_pieces`), through an equi-join.
    """
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("field"), (F.array_join("tags", " ") if n == "tags" else F.col(n)).alias("value"))
            for n in FIELD_WEIGHTS
        ]
    )
    doc_tokens = docs.select("id", F.inline(fields)).select(
        "id", "field", F.explode(F.array_distinct(text.tokens(F.col("value")))).alias("token")
    )
    vocabulary = doc_tokens.select("token").distinct()
    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("q")).distinct()
    words = asked.select("q").distinct().withColumn("m", F.length("q"))
    pieces = vocabulary.select("token", F.explode(_pieces(F.col("token"), threshold)).alias("piece"))
    close = (
        words.select("q", F.explode(_sought(F.col("q"), threshold)).alias("piece")).join(pieces, "piece")
        .select("q", "token").distinct()
        .select("q", "token", (F.levenshtein("q", "token") / F.greatest(F.length("q"), F.length("token"))).alias("d"))
        .filter(F.col("d") <= threshold)
    )
    # the distinct lengths of query words: a handful of small numbers
    lengths = sorted(r["m"] for r in words.filter("m >= 3").select("m").distinct().toLocalIterator())
    if lengths:
        inside = vocabulary.select("token", F.explode(_substrings(F.col("token"), lengths)).alias("q"))
        close = close.unionByName(inside.join(words.select("q"), "q").select("q", "token", F.lit(0.0).alias("d")))
    pairs = close.groupBy("q", "token").agg(F.min("d").alias("d"))
    weight = F.lit(0.0)
    for name, w in FIELD_WEIGHTS.items():
        weight = F.when(F.col("field") == name, F.lit(w)).otherwise(weight)
    hits = (
        pairs.join(doc_tokens, "token").join(asked, "q")
        .groupBy("query_id", "id", "field").agg(F.min("d").alias("d"))
        .withColumn("w", weight)
        .groupBy("query_id", "id").agg((1 - F.sum((1 - F.col("d")) * F.col("w"))).alias("score"))
    )
    if types:
        hits = hits.join(docs.filter(F.col("type").isin(types)).select("id"), "id", "left_semi")
    return top_k(hits, ["query_id"], [F.round("score", 9), F.col("id")], k)


def _edits(length: Column, threshold: float) -> Column:
    """Edits that two tokens may be apart whose longer one has this length."""
    return F.floor(length * threshold + 1e-9).cast("int")


def _cut(n: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and end of piece ``i`` of a token of length ``n``, cut into
    one piece more than there may be edits."""
    at = lambda j: F.floor(j * n / (edits + 1)).cast("int")
    return at(i), at(i + 1)


def _pieces(token: Column, threshold: float) -> Column:
    """Keys of a stored token: its length, the number of edits, the number of a
    piece and the piece.

    A token cut into ``k + 1`` pieces keeps at least one of them through ``k``
    edits. ``k`` follows from the longer token, so each number of edits that a
    query token within the threshold may ask for has its own cut.
    """
    n = F.length(token)
    most = _edits(F.floor(n / (1 - threshold) + 1e-9), threshold)

    def cut(k: Column) -> Column:
        def key(i: Column) -> Column:
            start, end = _cut(n, k, i)
            return F.struct(n.alias("n"), k.alias("k"), i.alias("i"), F.substring(token, start + 1, end - start).alias("s"))

        return F.transform(F.sequence(F.lit(0), k), key)

    keys = F.flatten(F.transform(F.sequence(_edits(n, threshold), most), cut))
    return F.when(n > 0, keys).otherwise(F.array().cast(_KEYS))


_KEYS = "array<struct<n:int,k:int,i:int,s:string>>"


def _sought(word: Column, threshold: float) -> Column:
    """Keys under which a query token finds every stored token within the
    threshold: a kept piece has moved by ``d`` places, which takes ``abs(d)``
    edits before it and as many after it as the lengths then still differ."""
    m = F.length(word)
    lengths = F.sequence(F.ceil(m * (1 - threshold) - 1e-9).cast("int"), F.floor(m / (1 - threshold) + 1e-9).cast("int"))

    def of_length(n: Column) -> Column:
        k = _edits(F.greatest(m, n), threshold)

        def of_piece(i: Column) -> Column:
            start, end = _cut(n, k, i)
            first = F.greatest(F.lit(0), start - F.floor((k - m + n) / 2).cast("int"))
            last = F.least(m - end + start, start + F.floor((k + m - n) / 2).cast("int"))
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(
                n.alias("n"), k.alias("k"), i.alias("i"), F.substring(word, at + 1, end - start).alias("s")))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), of_piece))

    keys = F.array_distinct(F.flatten(F.transform(lengths, of_length)))
    return F.when(m > 0, keys).otherwise(F.array().cast(_KEYS))


def _substrings(token: Column, lengths: list[int]) -> Column:
    """Distinct substrings of a token with one of the given lengths."""

    def of(length: int) -> Column:
        last = F.length(token) - length + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(token, i, F.lit(length)))

    return F.array_distinct(F.concat(*[of(n) for n in lengths]))
