"""Token counts of texts under a byte-level BPE file (operator 1)."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import whole
from graphloom.llm.merges import Merges

#: Distinct chunks a Python worker remembers before it starts anew.
CACHE = 400_000
LIMIT = 1024


def byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter50k:
    """Counts tokens of texts as the tokenizer file describes them."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in pairs], np.int64).reshape(-1, 3)
        chars = byte_chars()
        self.merges = Merges(ids, np.array([vocab[c] for c in sorted(chars, key=chars.get)]))
        self.words = regex.compile(pattern).findall
        self.odd_space = regex.compile(r" (?:\s|\Z)").search
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Counts of chunks not seen before: their pre-tokens are merged in one batch."""
        words = [self.words(x) for x in chunks]
        place: dict[str, int] = {}
        flat = [place.setdefault(w, len(place)) for ws in words for w in ws]
        sizes = self.merges.encode([w.encode() for w in place])[1]
        ends = np.cumsum([len(ws) for ws in words])
        total = np.r_[0, np.cumsum(sizes[np.array(flat, np.int64)])]
        self.known.update(zip(chunks, np.diff(total[np.r_[0, ends]]).tolist()))

    def _chunks(self, text: str) -> list[str]:
        """Parts at whose ends a pre-token always ends: a single space before a
        word belongs to that word, whatever stands around."""
        if self.odd_space(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def counts(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text; an added token counts as one and splits the text."""
        if len(self.known) > CACHE:
            self.known.clear()
        found, bases = [], []
        for text in texts:
            parts = self.added.split(text) if self.added else [text]
            bases.append(len(parts) - 1)
            chunks: Counter[str] = Counter()
            for part in parts:
                chunks.update(self._chunks(part))
            found.append(chunks)
        known = self.known
        self._learn([x for x in set().union(*found) if x not in known])
        return [base + sum(known[x] * n for x, n in chunks.items()) for base, chunks in zip(bases, found)]


_LOADED: dict[tuple[str, str], Counter50k] = {}


def counter(path: str, pattern: str) -> Counter50k:
    """One counter a Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Counter50k(path, pattern)
    return _LOADED[path, pattern]


def token_count(path: str, pattern: str, text: str | Column = "text") -> Column:
    """Tokens of a text column, as long. The file at ``path`` must be on every
    node, as installed vocabularies are. A null text counts as the empty one: 0."""

    def run(texts: pd.Series) -> pd.Series:
        tool, step = counter(path, pattern), 64
        out: list[int] = []
        for at in range(0, len(texts), step):
            out += tool.counts(texts.iloc[at:at + step])
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(run, "long")(whole(text))


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per input row; other
    columns are left behind, so their names cannot clash."""
    return (
        docs.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"),
                    token_count(path, pattern).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
