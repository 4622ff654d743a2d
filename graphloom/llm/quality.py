"""Quality rules by compression bands (operator 10).

A document is judged by how far zstandard shrinks it: natural prose of a given
length lands in a band, repeated text falls below it and noise above it. The
whole text is compared with limits for its length, and so is every fixed chunk,
so that a long document cannot hide a repetitive or random half.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import whole

SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK = 4096
#: (bytes from, lowest ratio, highest ratio) for whole texts; short texts carry
#: the frame's fixed cost, so their band is wider.
TEXT_BANDS = (
    (0, 0.0, 10.0), (128, 0.40, 1.10), (256, 0.36, 0.95), (512, 0.34, 0.90), (1024, 0.32, 0.82),
    (2048, 0.29, 0.74), (4096, 0.26, 0.70), (8192, 0.24, 0.68), (16384, 0.22, 0.66), (65536, 0.18, 0.66),
)
#: The same for chunks; the last one of a text may be short.
CHUNK_BANDS = TEXT_BANDS[:7]
#: Highest share of a text's bytes in chunks outside their band.
CHUNK_SHARE = 0.3

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, bad_chunk_share double, kept boolean"
)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = at[:n]
    for k in range(1, width):  # windows are renumbered at each step, so keys cannot overflow
        key = key * len(ids) + at[k:n + k]
        if k < width - 1 and len(ids) > 1_000_000:
            key = np.unique(key, return_inverse=True)[1]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    start = count[where] > 1
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[k:n + k] |= start
    return int(hit.sum())


def outside(size: int, ratio: float, bands) -> bool:
    low, high = next((lo, hi) for start, lo, hi in reversed(bands) if size >= start)
    return not low <= ratio <= high


def measure(text: str, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple:
    """The fields of ``SCHEMA`` for one text."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space alone
    n_words, word_bytes = len(words), sum(map(len, words))
    word_chars = len(text) - (len(raw) - word_bytes)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_repeat = repeated_words(words)
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    ratio = len(compressor.compress(raw)) / len(raw) if raw else 1.0
    bad = 0
    for at in range(0, len(raw), chunk):
        part = raw[at:at + chunk]
        if outside(len(part), len(compressor.compress(part)) / len(part), CHUNK_BANDS):
            bad += len(part)
    share = bad / len(raw) if raw else 0.0
    kept = not failed and not outside(len(raw), ratio, TEXT_BANDS) and share <= CHUNK_SHARE
    return (n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, ratio, share, kept)


def _measures(texts: pd.Series) -> pd.DataFrame:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pd.DataFrame([measure(t, compressor) for t in texts], columns=names)


def verdict(text: str | Column = "text") -> Column:
    """Struct of ``SCHEMA`` for a text column.

    Null and empty texts have no words and fail the base rules; repeated rows
    are judged alike, since a verdict depends on the text alone.
    """
    return F.pandas_udf(_measures, SCHEMA)(whole(text))


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every document, one row per input row."""
    return docs.select("doc_id", verdict().alias("m")).select("doc_id", "m.*")
