"""Embedding whitening by principal components (operator 13).

Sums and centred products are added up inside tasks; the driver receives one
matrix, whose size is set by the vector length alone. There it is brought to
tridiagonal form by Householder reflections; bisection on Sturm counts gives the
leading eigenvalues, inverse iteration their vectors, made orthogonal again
inside clusters of close values. The projection is sent to the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpointed

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues closer than this, as a share of the matrix norm, form a cluster.
CLOSE = 1e-3
_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors of a symmetric matrix."""
    a = np.array(a, float)
    n, vectors = len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        if norm > 0:
            v[0] += np.copysign(norm, v[0])
            v /= np.linalg.norm(v)
            block = a[k + 1:, k + 1:]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, a[k + 1, k])
            a[k + 2:, k] = a[k, k + 2:] = 0
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Of each value in ``x``, the number of eigenvalues below it."""
    q = d[0] - x
    below = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < least, np.where(q < 0, -least, least), q)
        q = d[k] - x - e[k - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected until its
    interval cannot be halved."""
    n = len(d)
    reach = np.r_[0, np.abs(e)] + np.r_[np.abs(e), 0]
    low, high = (d - reach).min(), (d + reach).max()
    room = _EPS * max(abs(low), abs(high), np.finfo(float).tiny) * n
    least = max(np.finfo(float).tiny, _EPS ** 2 * max(abs(low), abs(high)))
    lo, hi = np.full(count, low - room), np.full(count, high + room)
    rank = n - 1 - np.arange(count)  # so many eigenvalues are smaller
    while True:
        mid = (lo + hi) / 2
        if not ((mid > lo) & (mid < hi)).any():
            return mid
        over = count_below(d, e, mid, least) > rank
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)


def _eliminated(d: np.ndarray, e: np.ndarray, x: float, tiny: float):
    """Rows of T - x after elimination with row exchanges, as steps and bands."""
    n = len(d)
    u0, u1, u2 = np.zeros(n), np.zeros(n), np.zeros(n)
    swap, factor = np.zeros(n, bool), np.zeros(n)
    a, b = d[0] - x, e[0] if n > 1 else 0.0
    for k in range(n - 1):
        below, diag, right = e[k], d[k + 1] - x, e[k + 1] if k + 2 < n else 0.0
        if abs(below) > abs(a):
            swap[k], factor[k] = True, a / below
            u0[k], u1[k], u2[k] = below, diag, right
            a, b = b - factor[k] * diag, -factor[k] * right
        else:
            pivot = a if abs(a) > tiny else tiny
            factor[k] = below / pivot
            u0[k], u1[k] = pivot, b
            a, b = diag - factor[k] * b, right
    u0[n - 1] = a if abs(a) > tiny else tiny
    return u0, u1, u2, swap, factor


def _solved(bands, y: np.ndarray) -> np.ndarray:
    u0, u1, u2, swap, factor = bands
    y, n = y.copy(), len(y)
    for k in range(n - 1):
        if swap[k]:
            y[k], y[k + 1] = y[k + 1], y[k]
        y[k + 1] -= factor[k] * y[k]
    for k in range(n - 1, -1, -1):
        if k + 1 < n:
            y[k] -= u1[k] * y[k + 1]
        if k + 2 < n:
            y[k] -= u2[k] * y[k + 2]
        y[k] /= u0[k]
        top = abs(y[k])
        if top > 1e150:  # only the direction counts
            y /= top
    return y


def vectors_of(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one row a value."""
    norm = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    pick, out, first = np.random.default_rng(1), np.zeros((len(values), len(d))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * norm:
            first = k
        # equal values of one cluster are set apart a little, so that each solve differs
        bands = _eliminated(d, e, value - 4 * _EPS * norm * (k - first), _EPS * norm)
        y = pick.standard_normal(len(d))
        for _ in range(4):
            y /= np.linalg.norm(y)
            y = _solved(bands, y)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[first:k].T @ (out[first:k] @ y)
        out[k] = y / np.linalg.norm(y)
    return out


def leading(matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as rows."""
    if not matrix.any():  # nothing to scale by; every direction will do
        return np.zeros(min(count, len(matrix))), np.eye(len(matrix))[:count]
    d, e, reflections = tridiagonal(matrix)
    values = leading_values(d, e, min(count, len(d)))
    rows = vectors_of(d, e, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        rows[:, k + 1:] -= 2 * np.outer(rows[:, k + 1:] @ v, v)
    return values, rows


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: whole-number vectors of rows free of nulls and non-finite entries."""

    def finite(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    fit = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return vectors.filter(F.coalesce(fit, F.lit(False))).select("vec_id", whole.alias("x"))


def _rows(pdf: pd.DataFrame, kind: type) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(kind, copy=False)


def totals(vectors: DataFrame, kind: type, sql: str) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each place of ``x``."""

    def run(batches):
        n, total = 0, 0
        for pdf in batches:
            if len(pdf):
                n, total = n + len(pdf), total + _rows(pdf, kind).sum(0)
        if n:
            yield pd.DataFrame({"at": np.arange(-1, len(total)), "v": np.r_[np.array([n], kind), total]})

    got = vectors.select("x").mapInPandas(run, f"at int, v {sql}").groupBy("at").agg(F.sum("v").alias("v"))
    found = dict(got.collect())  # one row a place
    return int(found.pop(-1, 0)), np.array([found[k] for k in sorted(found)])


def covariance(vectors: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance of ``x`` with divisor ``n``; every vector is centred first."""
    at, size = np.triu_indices(len(mean)), len(mean)

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                y = _rows(pdf, float) - mean
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pd.DataFrame({"a": at[0], "b": at[1], "v": total[at]})

    got = vectors.select("x").mapInPandas(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for a, b, v in got.collect():  # one row a pair of places
        out[a, b] = out[b, a] = v / n
    return out


def _projected(vectors: DataFrame, n: int, sums: np.ndarray, values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``vec_id, deviation, x``: the exact deviation and the whitened vector."""
    sent = vectors.sparkSession.sparkContext.broadcast((sums, sums / n, axes.T / np.sqrt(values)))  # set by the vector length

    def run(column: pd.Series) -> pd.DataFrame:
        total, mean, project = sent.value
        if not len(column):
            return pd.DataFrame({"deviation": [], "x": []})
        x = np.stack(column.to_numpy()).astype(np.int64, copy=False)
        apart = n * x - total
        rough = (apart.astype(float) ** 2).sum(1)
        squares = (apart * apart).sum(1).astype(object)
        for k in np.flatnonzero(rough > 9e18):  # beyond 64 bits
            squares[k] = sum(int(v) ** 2 for v in apart[k])
        return pd.DataFrame({"deviation": [str(s) for s in squares], "x": list((x - mean) @ project)})

    made = vectors.select("vec_id", F.pandas_udf(run, "deviation string, x array<double>")("x").alias("_f"))
    return made.select("vec_id", F.col("_f.deviation").cast("decimal(38,0)").alias("deviation"), F.col("_f.x"))


def whitened(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``
    of every usable row and component.

    Components whose eigenvalue is lost in rounding (at most the vector length
    times the machine precision of the largest) are left out, so vectors that
    are all equal, or none at all, give no rows. Vectors of different lengths are
    whitened apart, each length with its own fit. Null ids stay, repeated rows
    count as often as they stand there. ``deviation`` is a decimal, since it may
    exceed 64 bits. Columns other than ``vec_id`` and ``embedding`` are not
    looked at.
    """
    stored = checkpointed(usable(vectors.select("vec_id", "embedding")))
    out = None
    for (size,) in sorted(stored.select(F.size("x")).distinct().collect()):
        part = _whitened(stored.filter(F.size("x") == size), count)
        out = part if out is None else out.unionByName(part)
    return _result(stored.limit(0).withColumns({"deviation": F.lit(None).cast("decimal(38,0)"), "x": F.array().cast("array<double>")}),
                   0, np.zeros(0), 0.0) if out is None else out


def _whitened(stored: DataFrame, count: int) -> DataFrame:
    n, sums = totals(stored, np.int64, "long")
    matrix = covariance(stored, n, sums / n)
    values, axes = leading(matrix, count)
    kept = values > len(matrix) * _EPS * max(values[0], 0)
    values, axes = values[kept], axes[kept]
    made = checkpointed(_projected(stored, n, sums, values, axes))
    error = 0.0
    if len(values):
        _, middle = totals(made, float, "double")
        error = float(np.abs(covariance(made, n, middle / n) - np.eye(len(values))).max())
    return _result(made, n, values / np.trace(matrix) if len(values) else values, error)


def _result(made: DataFrame, n: int, explained: np.ndarray, error: float) -> DataFrame:
    share = F.array(*[F.lit(float(v)) for v in explained]).cast("array<double>")
    return made.select("vec_id", "deviation", F.posexplode("x").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
