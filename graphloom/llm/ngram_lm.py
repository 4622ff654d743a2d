"""Language-model scores from an Elias-Fano n-gram trie (operator 7).

Level 1 holds the hashes of the training words in order, and their counts as
differences of a monotone sequence. A deeper level holds, for every context that
has any, its successors: context numbers, pointers to where a context's
successors begin, and the successors themselves, numbered relative to their
context so that the whole level is one monotone sequence. All are Elias-Fano
coded. Discounted probabilities and the mass left to the shorter context are
quantised to a byte. Levels are cut into shards of bounded size that tasks write
below the shared folder and scoring tasks map into memory, so that no process
holds a level.

Every n-gram of the training texts is kept, from one occurrence on. A level looks
its contexts up in the one before. The discount of a level comes from how many
of its n-grams occur once and twice.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, ascii_lower, whole
from graphloom.llm.elias_fano import EliasFano
from graphloom.session import checkpointed, shared_dir

ORDER = 3
SHARD = 1_000_000
#: The end of a text, counted as a word; no word can hold white space.
END = b"\n"
CACHE = 300_000
#: Distinct n-grams a task gathers before it passes them on.
GATHER = 4_000_000


def discount(once: int, twice: int) -> float:
    """The share of a count that is left for what was not seen, from how many were seen once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def lowest(d: float, total: int) -> float:
    """A byte stands for a log10 probability between this and 0: no n-gram and no mass left is below."""
    return float(np.log10(min(d, 1 - d) / total))


def quantised(p: np.ndarray, low: float) -> np.ndarray:
    return np.clip(np.rint(np.log10(p) / low * 255), 0, 255).astype(np.uint8)


def restored(low: float) -> np.ndarray:
    """The probability of each byte."""
    return 10.0 ** (low * np.arange(256) / 255)


def words(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def word_hash(word: bytes) -> int:
    """As ``xxhash64`` of Spark, moved to the unsigned order of the signed values."""
    return xxhash.xxh64_intdigest(word, 42) ^ (1 << 63)


class Words:
    """Level 1: word numbers and counts."""

    def __init__(self, shards: list[dict]):
        shards = sorted(shards, key=lambda s: s["low"])
        self.lows = np.array([s["low"] for s in shards], np.int64)
        self.starts = np.r_[0, np.cumsum([s["n"] for s in shards])].astype(np.int64)
        self.hashes = [EliasFano.load(f"{s['path']}/hashes") for s in shards]
        self.sums = [EliasFano.load(f"{s['path']}/sums") for s in shards]
        self.known: dict[bytes, int] = {}

    def number(self, tokens: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it was never seen in training."""
        known = self.known
        new = [w for w in set(tokens) if w not in known]
        if new:
            if len(known) > CACHE:
                known.clear()
                new = list(set(tokens))
            h = np.fromiter(map(word_hash, new), np.uint64, len(new))
            signed = (h ^ np.uint64(1 << 63)).astype(np.int64)
            shard = np.searchsorted(self.lows, signed, side="right") - 1
            out = np.full(len(new), -1, np.int64)
            for s in np.unique(shard[shard >= 0]):
                mine = np.flatnonzero(shard == s)
                at = self.hashes[s].find(h[mine])
                out[mine] = np.where(at >= 0, at + self.starts[s], -1)
            known.update(zip(new, out.tolist()))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Training count of known words, 0 for -1."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        shard = np.searchsorted(self.starts, distinct, side="right") - 1
        for s in np.unique(shard[distinct >= 0]):
            mine = np.flatnonzero((shard == s) & (distinct >= 0))
            at = distinct[mine] - self.starts[s]
            sums = self.sums[s]
            out[mine] = (sums.access(at + 1) - sums.access(at)).astype(np.int64)
        return out[back]


class Level:
    """Successors of the contexts of the level before."""

    def __init__(self, shards: list[dict], vocabulary: int, low: float):
        self.vocabulary = vocabulary
        self.restored = restored(low)
        shards = sorted(shards, key=lambda s: s["low"])
        self.lows = np.array([s["low"] for s in shards], np.int64)
        self.starts = np.r_[0, np.cumsum([s["n"] for s in shards])].astype(np.int64)
        part = lambda s, name: EliasFano.load(f"{s['path']}/{name}")
        self.contexts = [part(s, "contexts") for s in shards]
        self.pointers = [part(s, "pointers") for s in shards]
        self.successors = [part(s, "successors") for s in shards]
        self.sums = [part(s, "sums") for s in shards]
        self.p = [np.load(f"{s['path']}/p.npy", mmap_mode="r") for s in shards]
        self.left = [np.load(f"{s['path']}/left.npy", mmap_mode="r") for s in shards]

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each n-gram (-1: never seen), its discounted probability (0)
        and the mass its context leaves to the shorter one (1)."""
        number, p, left = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        shard = np.where(context >= 0, np.searchsorted(self.lows, context, side="right") - 1, -1)
        for s in np.unique(shard[shard >= 0]):
            mine = np.flatnonzero(shard == s)
            heads, back = np.unique(context[mine], return_inverse=True)
            row = self.contexts[s].find(heads)[back]
            mine, row = mine[row >= 0], row[row >= 0]
            left[mine] = self.restored[self.left[s][row]]
            mine, row = mine[word[mine] >= 0], row[word[mine] >= 0]
            at = self.successors[s].find(row * self.vocabulary + word[mine])
            hit = at >= 0
            mine, at = mine[hit], at[hit]
            number[mine] = at + self.starts[s]
            p[mine] = self.restored[self.p[s][at]]
        return number, p, left

    def count(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.starts, numbers, side="right") - 1
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            at = numbers[mine] - self.starts[s]
            out[mine] = (self.sums[s].access(at + 1) - self.sums[s].access(at)).astype(np.int64)
        return out


class Trie:
    def __init__(self, spec: dict):
        self.spec = spec
        self.words = Words(spec["words"])
        self.levels = [Level(x, spec["vocabulary"], low) for x, low in zip(spec["levels"], spec["lowest"])]

    def walk(self, ids: np.ndarray, start: np.ndarray):
        """For each level the contexts before the words and what the level says
        of them. The end of a text is also what stands before its first word;
        the n-gram that ends at a word is the next word's longer context."""
        context = np.r_[-1, ids[:-1]]
        context[start] = self.spec["end"]
        for level in self.levels:
            number, p, left = level.look(context, ids)
            yield context, number, p, left
            context = np.r_[-1, number[:-1]]
            context[start] = -1
        yield context, None, None, None

    def probability(self, ids: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total, kinds = self.spec["total"], self.spec["vocabulary"]
        d = self.spec["discount"]
        out = np.where(counts > 0, (counts - d) / max(total, 1), max(d * kinds / total, 0.1 / total) if total else 1.0)
        for _, number, p, left in self.walk(ids, start):
            if number is not None:
                out = p + left * out
        return out


@lru_cache(maxsize=4)
def opened(spec: str) -> Trie:
    return Trie(json.loads(spec))


def local_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a path that tasks can map files from."""
    base = shared_dir(spark)
    for scheme in ("file://", "file:"):
        base = base.removeprefix(scheme)
    if ":" in base.split("/")[0]:
        raise ValueError("the trie's levels are memory-mapped: spark.checkpoint.dir must be a mounted folder")
    return f"{base}/trie-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


META = "low long, n long, path string"


def _store(folder: str, **parts) -> str:
    """Write the parts of a shard to a folder of its own; a repeated task writes anew."""
    path = f"{folder}/{uuid.uuid4().hex}"
    os.makedirs(path)
    for name, part in parts.items():
        part.save(f"{path}/{name}") if isinstance(part, EliasFano) else np.save(f"{path}/{name}.npy", part)
    return path


def _sharded(df: DataFrame, key: str, rows: int, build, schema: str = META) -> list[dict]:
    parts = max(1, -(-rows // SHARD))
    shards = checkpointed(df.repartitionByRange(parts, key).sortWithinPartitions(*df.columns).mapInPandas(build, schema))
    return [r.asDict() for r in shards.collect()]  # one row a shard


def build_words(counts: DataFrame, folder: str, n: int) -> list[dict]:
    def build(batches):
        pdf = pd.concat([*batches, pd.DataFrame({"h": np.empty(0, np.int64), "c": np.empty(0, np.int64)})])
        if len(pdf):
            h = pdf["h"].to_numpy(np.int64)
            unsigned = h.view(np.uint64) ^ np.uint64(1 << 63)
            sums = np.r_[0, np.cumsum(pdf["c"].to_numpy(np.int64))]
            path = _store(folder, hashes=EliasFano.build(unsigned, 1 << 64), sums=EliasFano.build(sums, int(sums[-1]) + 1))
            yield pd.DataFrame({"low": [int(h[0])], "n": [len(h)], "path": [path]})

    return _sharded(counts, "h", n, build)


def build_level(grams: DataFrame, folder: str, n: int, spec: str, depth: int, d: float, low: float) -> list[dict]:
    """``grams``: context, word, c; ``d``, ``low``: discount and lowest log10 probability of the level."""
    def build(batches):
        pdf = pd.concat([*batches, pd.DataFrame({k: np.empty(0, np.int64) for k in ("context", "word", "c")})])
        if not len(pdf):
            return
        trie = opened(spec)
        context, word, c = (pdf[k].to_numpy(np.int64) for k in ("context", "word", "c"))
        heads, first, size = np.unique(context, return_index=True, return_counts=True)
        row = np.repeat(np.arange(len(heads)), size)
        seen = trie.words.count(heads) if depth == 1 else trie.levels[depth - 2].count(heads)
        p = (c - d) / seen[row]
        left = d * size / seen  # each context is counted as often as its successors together
        v = trie.spec["vocabulary"]
        sums = np.r_[0, np.cumsum(c)]
        path = _store(
            folder, contexts=EliasFano.build(heads, int(heads[-1]) + 1),
            pointers=EliasFano.build(np.r_[first, len(c)], len(c) + 1),
            successors=EliasFano.build(row * v + word, len(heads) * v),
            sums=EliasFano.build(sums, int(sums[-1]) + 1), p=quantised(p, low), left=quantised(left, low))
        yield pd.DataFrame({"low": [int(heads[0])], "n": [len(c)], "path": [path]})

    return _sharded(grams, "context", n, build)


def _batched(texts: pd.Series, trie: Trie, step: int = 256):
    """Tokens of some texts in a row: numbers, starts and sizes."""
    for at in range(0, len(texts), step):
        some = [words(t) for t in texts.iloc[at:at + step]]
        sizes = np.array([len(x) for x in some], np.int64)
        start = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        yield trie.words.number([w for x in some for w in x]), start, sizes


def count_grams(texts: DataFrame, spec: str) -> DataFrame:
    """``context, word, c`` of all n-grams one word longer than the last level."""
    def run(batches):
        trie = opened(spec)
        v = trie.spec["vocabulary"]
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def summed():
            key = np.concatenate([k for k, _ in pending])
            c = np.concatenate([c for _, c in pending])
            keys, back = np.unique(key, return_inverse=True)
            return keys, np.bincount(back, c, len(keys)).astype(np.int64)

        def rows(keys, c):
            return pd.DataFrame({"context": keys // v, "word": keys % v, "c": c})

        for pdf in batches:
            for ids, start, _ in _batched(pdf["text"], trie):
                *_, (context, _, _, _) = trie.walk(ids, start)
                keep = context >= 0  # none before the first word of a text
                keys, c = np.unique(context[keep] * v + ids[keep], return_counts=True)
                pending.append((keys, c))
                held += len(keys)
            if held > GATHER:
                merged = summed()
                if len(merged[0]) > GATHER // 2:
                    yield rows(*merged)
                    pending, held = [], 0
                else:
                    pending, held = [merged], len(merged[0])
        if pending:
            yield rows(*summed())

    grams = texts.mapInPandas(run, "context long, word long, c long")
    return grams.groupBy("context", "word").agg(F.sum("c").alias("c"))


def _totals(counts: DataFrame) -> tuple[int, ...]:
    """Rows, their occurrences, and how many occur once and twice."""
    c = F.col("c")
    row = counts.agg(F.count("*"), F.sum(c), F.count(F.when(c == 1, 1)), F.count(F.when(c == 2, 1))).first()
    return tuple(int(x or 0) for x in row)


def train(docs: DataFrame, order: int = ORDER) -> str:
    """The trie of all texts of ``docs``: its description as JSON."""
    spark = docs.sparkSession
    folder = local_folder(spark)
    texts = docs.select(whole("text").alias("text"))
    tokens = F.concat(F.array_remove(F.split(ascii_lower(F.col("text")), SPACE + "+"), ""), F.array(F.lit(END.decode())))
    counts = checkpointed(
        texts.select(F.explode(tokens).alias("w")).groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("c")))
    kinds, total, once, twice = _totals(counts)
    spec = {"vocabulary": kinds, "total": total, "discount": discount(once, twice),
            "words": build_words(counts, folder, kinds), "levels": [], "lowest": [], "end": -1}
    spec["end"] = int(Words(spec["words"]).number([END])[0])
    for depth in range(1, order):
        text = json.dumps(spec)
        grams = checkpointed(count_grams(texts, text))
        n, _, once, twice = _totals(grams)
        if not n:
            break
        d = discount(once, twice)
        low = lowest(d, total)
        spec["levels"].append(build_level(grams, folder, n, text, depth, d, low))
        spec["lowest"].append(low)
    return json.dumps(spec)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, spec: str) -> DataFrame:
    """Scores of every row of ``doc_id, held_out, text``."""
    def run(batches):
        trie = opened(spec)
        total, kinds = trie.spec["total"], trie.spec["vocabulary"]
        for pdf in batches:
            at = 0
            for ids, start, sizes in _batched(pdf["text"], trie):
                counts = trie.words.count(ids)
                base = np.log10((counts + 1) / (total + kinds + 1))
                model = np.log10(trie.probability(ids, start, counts))
                some = pdf.iloc[at:at + len(sizes)]
                at += len(sizes)
                yield pd.DataFrame({
                    "doc_id": some["doc_id"].to_numpy(), "held_out": some["held_out"].to_numpy(), "n_tokens": sizes,
                    "n_known": np.add.reduceat((counts > 0).astype(np.int64), start), "train_tokens": total,
                    "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(model, start)})

    return docs.mapInPandas(run, SCORES)


def held_out(every: int = 7, which: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == which, F.lit(False))


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``SCORES`` of every document, from a model of those not held out.

    A null or empty text is its end alone. Words never seen in training share
    the mass that discounting leaves. Rows without an id are trained on and
    scored; repeated rows count as often as they stand there. Without training
    rows every word is unknown.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole("text").alias("text"))
    return scored(rows, train(rows.filter("NOT held_out"), order))
