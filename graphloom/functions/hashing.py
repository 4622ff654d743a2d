"""Content keys (FN8). ``content_key`` is the default and stays in the JVM; the
two legacy hashes work on UTF-16 code units, which Spark has no operator for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def _units(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-16 code units of all texts in one array, and where each text begins and ends."""
    coded = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(c) // 2 for c in coded], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(coded), "<u2"), ends - sizes, ends


def fnv1a64_of(texts: pd.Series) -> np.ndarray:
    """All texts of a batch advance together, one code unit a step; the longest
    come first, so those still running are a prefix."""
    # 64-bit FNV-1a offset basis and prime.
    basis, prime = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
    units, starts, ends = _units(texts)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    first, running = starts[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    h = np.full(len(texts), basis)
    for step, n in enumerate(running):  # texts longer than ``step``
        h[:n] = (h[:n] ^ units[first[:n] + step]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def djb2_of(texts: pd.Series) -> np.ndarray:
    """A hash that is linear in the code units: one sum of units times powers of 33."""
    units, starts, ends = _units(texts)
    sizes = ends - starts
    powers = np.cumprod(np.r_[1, np.full(int(sizes.max(initial=0)), 33)].astype(np.uint32), dtype=np.uint32)
    left = np.repeat(ends, sizes) - np.arange(len(units)) - 1  # units that follow in the same text
    sums = np.r_[np.zeros(1, np.uint32), np.cumsum(units.astype(np.uint32) * powers[left], dtype=np.uint32)]
    return np.uint32(5381) * powers[sizes] + sums[ends] - sums[starts]


def _hex(of, digits: int):
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        known = texts.notna().to_numpy()
        out[known] = [f"{h:0{digits}x}" for h in of(texts[known]).tolist()]
        return out

    return F.pandas_udf(run, StringType())


fnv1a64 = _hex(fnv1a64_of, 16)
djb2 = _hex(djb2_of, 8)
