"""Byte-level BPE encoding and decoding with higher-order functions (operator 9).

A symbol is one character of the basic plane: its code point is the token id (a
private-use character stands for id 0, which ``translate`` cannot produce). A
word is then a string, a merge is ``replace(word, pair, merged)``, and the
lowest merged character among the adjacent pairs is the lowest rank. The rank
map is a literal: an array of buckets, found by the hash of a pair, whose strings
hold ``mark left right merged left right`` entries, so a look-up costs the same whatever
the vocabulary.

Frequent distinct words are folded once and become a second literal map of
bounded size; the other distinct words are folded where they stand. No document
is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bind, whole
from graphloom.session import checkpointed

ZERO, MARK, END = "\ue000", "\ue001", "\ue002"
PAIR_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 16
#: Most words of the literal word map, and words folded together in a text.
FREQUENT = 100_000
CHUNK = 2048
#: From this many symbols on, pairs are cut by one pattern pass and not one by one.
LONG = 64


def read_ranks(path: str) -> list[bytes]:
    """Pieces in order of rank from a file of ``base64 rank`` lines, which must
    number fewer than 55,296 (the code points below the surrogates)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
    pieces = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in pieces] != list(range(len(pieces))) or len(pieces) >= 0xD800:
        raise ValueError(f"{path}: ranks must run from 0 without gaps and stay below 55296")
    return pieces


def symbol(rank: int) -> str:
    return chr(rank) if rank else ZERO


def bucketed(entries: Iterable[tuple[str, str]], size: int) -> Column:
    """Literal array of bucket strings for (key, value) entries."""
    buckets = [MARK] * size
    for key, value in entries:
        at = xxhash.xxh64_intdigest(key, 42) ^ (1 << 63)  # xxhash64 of Spark, plus 2^63
        buckets[(at - (1 << 63)) % size] += key + value + MARK
    return F.split(F.lit("\n".join(buckets)), "\n")  # folded into one literal by the optimiser


def bucket(buckets: Column, key: Column, size: int) -> Column:
    return F.get(buckets, F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))


class Codec:
    """Encoding and decoding Columns for one rank file."""

    def __init__(self, path: str, pattern: str):
        self.pieces = read_ranks(path)
        rank = {p: k for k, p in enumerate(self.pieces)}
        self.pattern = "(?U)" + pattern
        self.bytes_from = "".join(map(chr, range(256)))
        self.bytes_to = "".join(symbol(rank[bytes([b])]) for b in range(256))
        self.ranks = bucketed((
            (left := symbol(rank[p[:k]]) + symbol(rank[p[k:]]), symbol(r) + left)
            for p, r in rank.items() for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank
        ), PAIR_BUCKETS)
        self.piece_table = F.split(F.lit(MARK.join(p.decode("latin-1") for p in self.pieces)), MARK)
        self.whole_words: list[tuple[str, str]] = []
        for p, r in rank.items():  # a word that is a piece is that piece
            try:
                self.whole_words.append((p.decode(), symbol(r)))
            except UnicodeDecodeError:
                pass

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def _lowest(self, word: Column, ranks: Column) -> Column:
        """``merged left right`` of the lowest-rank pair; from ``MARK`` on there is none,
        since every bucket begins with it."""

        def merged(pair: Column) -> Column:
            key = F.concat(F.lit(MARK), pair)
            found = F.call_function("substring_index", bucket(ranks, pair, PAIR_BUCKETS), key, F.lit(-1))
            return F.left(found, F.lit(3))

        places = F.sequence(F.lit(1), F.length(word) - 1)
        short = F.transform(places, lambda k: merged(F.substring(word, k, 2)))
        long = F.transform(F.regexp_extract_all(word, F.lit("(?s)(?=(..))"), F.lit(1)), merged)
        return F.array_min(F.when(F.length(word) < 2, F.lit(None)).when(F.length(word) < LONG, short).otherwise(long))

    def fold(self, word: Column, ranks: Column) -> Column:
        """Symbols of a word: its bytes, with the lowest-rank pair merged again and again."""
        start = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), self.bytes_from, self.bytes_to)

        def state(symbols: Column) -> Column:
            return F.struct(symbols.alias("s"), self._lowest(symbols, ranks).alias("m"))

        def step(acc: Column, _: Column) -> Column:
            once = bind(F.replace(acc["s"], F.substring(acc["m"], 2, 2), F.left(acc["m"], F.lit(1))), state)
            return F.when(acc["m"] < MARK, once).otherwise(acc)

        def run(symbols: Column) -> Column:
            steps = F.when(F.length(symbols) > 1, F.sequence(F.lit(2), F.length(symbols))).otherwise(
                F.array().cast("array<int>"))
            return F.aggregate(steps, state(symbols), step, lambda acc: acc["s"])

        return bind(start, run)

    def frequent(self, docs: DataFrame, limit: int = FREQUENT) -> Column:
        """Literal map of the words that most documents hold, at most ``limit`` of
        them, and of the words that are pieces. Words are counted over all texts."""
        plain = ~F.col("word").contains(MARK) & ~F.col("word").contains(END) & (F.length("word") < 64)
        counts = checkpointed(
            docs.select(F.explode(F.array_distinct(self.words(whole("text")))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > 1).filter(plain)
        )
        # the lowest count whose words still fit: the histogram of counts, highest first, is cut at the limit
        top = F.sum("words").over(Window.orderBy(F.col("n").desc()))
        cut = (
            counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("so_far", top)
            .filter(F.col("so_far") <= limit).agg(F.min("n")).first()[0]
        )
        known = dict(self.whole_words)
        if cut is not None:
            chosen = counts.filter(F.col("n") >= cut)
            folded = bind(self.ranks, lambda ranks: self.fold(F.col("word"), ranks)).alias("s")
            found = {}
            for batch in chosen.select("word", folded).toArrow().to_batches():  # at most ``limit`` rows, packed
                found.update(zip(batch["word"].to_pylist(), batch["s"].to_pylist()))
            known = found | known
        return bucketed(((w + END, s) for w, s in known.items()), WORD_BUCKETS)

    def encode(self, text: str | Column, known: Column) -> Column:
        """Symbols of a text column as one string."""

        def all_chunks(words: Column, known: Column, ranks: Column) -> Column:
            ends = F.sequence(F.lit(0), (F.size(words) / CHUNK).cast("int"))
            parts = F.transform(ends, lambda k: bind(
                F.slice(words, k * CHUNK + 1, F.lit(CHUNK)), lambda some: self._chunk(some, known, ranks)))
            return F.array_join(parts, "")

        # each literal stands in the plan once, as the value of a lambda variable
        return bind(known, lambda k: bind(self.ranks, lambda r: bind(
            self.words(whole(text)), lambda words: all_chunks(words, k, r))))

    def _chunk(self, words: Column, known: Column, ranks: Column) -> Column:
        """Symbols of some words: known ones looked up, the other distinct ones folded."""

        def look(word: Column) -> Column:
            key = F.concat(F.lit(MARK), word, F.lit(END))
            at = bucket(known, F.concat(word, F.lit(END)), WORD_BUCKETS)
            found = F.substring_index(F.call_function("substring_index", at, key, F.lit(-1)), MARK, 1)
            return F.when(F.contains(word, F.lit(MARK)), F.lit("")).otherwise(found)

        def filled(seen: Column) -> Column:
            rest = F.array_distinct(F.filter(words, lambda w, i: F.get(seen, i) == ""))

            def joined(new: Column) -> Column:
                folded = F.map_from_arrays(new, F.transform(new, lambda w: self.fold(w, ranks)))
                return bind(folded, lambda m: F.array_join(F.transform(
                    seen, lambda s, i: F.when(s == "", F.try_element_at(m, F.get(words, i))).otherwise(s)), ""))

            return bind(rest, joined)

        return bind(F.transform(words, look), filled)

    def decode(self, ids: Column) -> Column:
        """Bytes of a column of id arrays: the pieces, one after the other."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.piece_table, i)), ""), "ISO-8859-1")


def ids(symbols: Column) -> Column:
    """Token ids of a symbol string."""
    plain = F.replace(symbols, F.lit(ZERO), F.lit("\0"))
    return F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), F.ascii)


def little_endian(symbols: Column) -> Column:
    """Ids of a symbol string as unsigned 32-bit integers, low byte first: each
    id is one two-byte unit, followed by two zero bytes."""
    plain = F.replace(symbols, F.lit(ZERO), F.lit("\0"))
    return F.encode(F.regexp_replace(plain, "(?s).", "$0\0"), "UTF-16LE")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``symbols``, the token string, of every whole text (null:
    empty). Repeated rows are encoded alike; empty texts have no tokens."""
    codec = Codec(path, pattern)
    return docs.withColumn("symbols", codec.encode("text", codec.frequent(docs)))


def round_trip(docs: DataFrame, path: str, pattern: str, tokens: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, and
    ``tokens``, the ids as packed integers, if asked for."""
    codec = Codec(path, pattern)
    texts = docs.select("doc_id", "text")
    symbols = texts.select("doc_id", codec.encode("text", codec.frequent(texts)).alias("symbols"))
    return symbols.select(
        "doc_id", F.length("symbols").cast("long").alias("n_tokens"),
        F.sha2(little_endian(F.col("symbols")), 256).alias("ids_sha256"),
        F.sha2(codec.decode(ids(F.col("symbols"))), 256).alias("decoded_sha256"),
        *([little_endian(F.col("symbols")).alias("tokens")] if tokens else []),
    )
