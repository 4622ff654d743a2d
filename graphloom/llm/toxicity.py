"""Toxicity by multiple-instance learning (operator 3).

Only documents carry labels. A sentence has a logistic score over the words it
holds, seen as whole words and as their beginnings, and a document is toxic if any of its sentences is: the scores combine by
noisy-or, 1 - prod(1 - p). Training descends the loss of the document labels
through that product, so blame settles on the sentences that explain them, and
the same scores locate the offending sentences afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import whole

#: Most labelled documents that the classifier is fitted on, chosen by a hash of
#: their ids, and the most features it weighs.
SAMPLE = 6000
FEATURES = 60_000
MIN_DOCS = 5
THRESHOLD = 0.3
ROUNDS = 250

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans between full stops, exclamation and question marks and line ends;
    a text without any is one empty sentence."""
    return [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """The word between marks, and its beginnings of up to seven characters."""
    marked = f"<{word}>"
    return [marked, *(marked[:n] for n in range(4, 9) if n < len(marked))]


class _Scores(dict):
    """Score of each word, remembered up to a number of words."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        get = self.weights.get
        value = self[word] = sum(get(f, 0.0) for f in features(word))
        return value


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """Function from a text to its sentence spans and their probabilities."""
        known = _Scores(self.weights)

        def score(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
            spans = sentences(text)
            z = [self.bias + sum(map(known.__getitem__, words(text[a:b]))) for a, b in spans]
            return spans, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(texts: list[str], toxic: np.ndarray, min_docs: int = MIN_DOCS, most: int = FEATURES,
        rounds: int = ROUNDS, l1: float = 1e-4) -> Model:
    """Weights from texts and their labels, by Adam on the mean log loss."""
    vocabulary: dict[str, int] = {}
    names: dict[str, int] = {}
    parts: list[np.ndarray] = []  # features of each word
    flat: list[np.ndarray] = []  # words of each sentence, as numbers: strings are kept once
    sizes, df = [], np.zeros(0, np.int64)
    for text in texts:
        spans = sentences(text)
        sizes.append(len(spans))
        for a, b in spans:
            row = sorted(words(text[a:b]))
            for w in row:
                if w not in vocabulary:
                    vocabulary[w] = len(vocabulary)
                    parts.append(np.array([names.setdefault(f, len(names)) for f in features(w)], np.int32))
            flat.append(np.array([vocabulary[w] for w in row], np.int32))
        held = np.unique(np.concatenate(flat[-len(spans):])) if spans else []
        if len(held):
            hit = np.unique(np.concatenate([parts[w] for w in held]))
            df = np.r_[df, np.zeros(max(0, len(names) - len(df)), np.int64)] if len(names) > len(df) else df
            df[hit] += 1
    order = np.lexsort((np.arange(len(df)), -df))  # frequent features first, then those met first
    order = order[df[order] >= min_docs][:most]
    ids = np.full(len(names), -1)
    ids[order] = np.arange(len(order))
    of_word = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    feature = ids[np.concatenate(parts)] if parts else np.empty(0, np.int64)
    of_word, feature = of_word[feature >= 0], feature[feature >= 0]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sent = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    word = np.concatenate(flat) if flat else np.empty(0, np.int64)
    y = toxic.astype(bool)
    base = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    theta = np.zeros(len(order) + 1)  # the last is the bias
    theta[-1] = np.log(base) - np.log(max(1.0, len(flat) / max(1, len(sizes))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1 if len(y) and y.any() and not y.all() else 1):
        by_word = np.bincount(of_word, theta[feature], len(parts))
        z = np.bincount(sent, by_word[word], len(flat)) + theta[-1]
        p = np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-9)
        whole_p = np.clip(-np.expm1(np.bincount(doc, np.log1p(-p), len(sizes))), 1e-9, 1)
        g = np.where(y[doc], -(1 - whole_p[doc]) / whole_p[doc] * p, p) / len(sizes)
        g_word = np.bincount(word, g[sent], len(parts))
        grad = np.r_[np.bincount(feature, g_word[of_word], len(order)), g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - 0.05 * l1 / (
            np.sqrt(v[:-1] / (1 - 0.99 ** t)) + 1e-6), 0)  # keeps few weights
    return Model({f: float(theta[ids[k]]) for f, k in names.items() if ids[k] >= 0 and theta[ids[k]]}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents for which ``usable`` (over ``doc_id``)
    holds; at most ``sample`` of them. Null labels teach nothing; of repeated
    labels or documents one counts; no labels at all give a constant score."""
    ids = (
        labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(usable)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", whole("text").alias("text")).join(ids, "doc_id").dropDuplicates(["doc_id"])
    pdf = rows.select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return fit(pdf["text"].tolist(), pdf["toxic"].to_numpy())


RESULT = "score double, offending array<struct<begin:int,end:int,p:double>>"


def scored(model: Model, text: str | Column = "text") -> Column:
    """Struct of ``RESULT``: the document's score and the spans (in code points)
    of sentences that reach ``THRESHOLD`` alone. A null or empty text is one
    empty sentence. The model is bounded by its number of features."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out, score = [], model.scorer()
        for text in texts:
            spans, p = score(text)
            out.append((noisy_or(p), [(*spans[k], float(p[k])) for k in np.flatnonzero(p >= THRESHOLD)]))
        return pd.DataFrame(out, columns=["score", "offending"])

    return F.pandas_udf(run, RESULT)(whole(text))


def held_out(every: int = 4, which: int = 2) -> Column:
    """Documents kept from training: by the CRC of the id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == which, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` of every document."""
    model = train(docs, labels, ~held_out())
    return docs.select("doc_id", held_out().alias("held_out"), scored(model).alias("s")).select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.offending")
