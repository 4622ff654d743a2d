"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontaminate, importance, whitening

from .conftest import rows

WORDS = [f"w{k}" for k in range(60)] + ["Ärger", "ÉTÉ", "x9", "naïve"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(pick, n):
    return "".join(pick.choice(WORDS) + pick.choice([" ", " ", ", ", "\n", "--", "\x00", "_"]) for _ in range(n))


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS n", "2 AS bucket", "'x' AS words")


# --- operator 11


def grams(text):
    w = words_of(text)
    return [" ".join(w[k:k + n]) for n in (1, 2) for k in range(len(w) - n + 1)]


def plain_resampled(docs, target):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % 10000 for t in texts for g in grams(t))

    s, t = counts(x for _, x in docs), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for k, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
                 for b in (zlib.crc32(g.encode()) % 10000 for g in grams(text))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(gains), weight, score, None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(able[:25 * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_resampled(docs, items):
    pick = random.Random(3)
    table = [(k, prose(pick, pick.randint(0, 60))) for k in range(60)]
    table += [(100, None), (101, ""), (102, " ,, "), (103, "one"), (None, prose(pick, 30)), (104, prose(pick, 30000))]
    table += [table[5], table[5], (table[6][0], prose(pick, 40))]  # repeated rows, a repeated id
    target = [prose(pick, 30) for _ in range(10)] + [None, ""]
    got = importance.resampled(docs(table), items(list(enumerate(target))))
    assert Counter(map(tuple, got.collect())) == plain_resampled(table, target)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5


def test_resampled_empty(docs, items):
    assert importance.resampled(docs([]), items([(1, "a b")])).collect() == []
    table = [(k, "w " * 25) for k in range(8)]  # all weights equal, no target
    got = importance.resampled(docs(table), items([]))
    assert Counter(map(tuple, got.collect())) == plain_resampled(table, [])


def test_features_of_longer_runs():
    n, found = importance.features("A b--c", importance.scanner(3), 1 << 20)
    wanted = ["a", "a b", "a b c", "b", "b c", "c"]
    assert n == 3 and found.dtype == np.uint32
    assert Counter(found.tolist()) == Counter(zlib.crc32(g.encode()) % (1 << 20) for g in wanted)


# --- operator 12


def plain_contaminated(text, benchmark):
    w = words_of(text)
    hit, found = set(), set()
    for item, item_text in benchmark:
        v = words_of(item_text)
        m = min(10, len(v))
        windows = {tuple(v[k:k + m]) for k in range(len(v) - m + 1)} if m else set()
        for k in range(len(w) - m + 1):
            if tuple(w[k:k + m]) in windows:
                hit.update(range(k, k + m))
                found.add("" if item is None else str(item))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def contaminated_case():
    pick = random.Random(5)
    bench = [(k, prose(pick, pick.randint(10, 60))) for k in range(12)]
    bench += [(20, "w1 W2-w3"), (21, "naïve"), (22, None), (23, " ."), (None, prose(pick, 14)), (3, prose(pick, 12)),
              (24, bench[0][1]), (25, "w7 " * 30), (26, prose(pick, 400))]
    table = []
    for k in range(60):
        parts = [prose(pick, pick.randint(0, 30))]
        for _ in range(pick.randint(0, 3)):
            _, text = pick.choice(bench)
            w = words_of(text)
            at = pick.randint(0, len(w))
            parts += [" ".join(w[at:at + pick.randint(1, 25)]).upper(), prose(pick, pick.randint(0, 20))]
        table.append((k, " ".join(parts)))
    table += [(100, None), (101, ""), (102, "w7 " * 9), (103, "w7 " * 10), (None, bench[1][1]), (7, bench[2][1]), table[4], table[4]]
    table.append((104, prose(pick, 20000) + bench[3][1] + prose(pick, 5000)))
    return table, bench


@pytest.mark.parametrize("limits", [{}, {"piece": 25, "block_words": 150, "part": 64}])
def test_contaminated(docs, items, limits):
    table, bench = contaminated_case()
    got = decontaminate.digest(decontaminate.contaminated(docs(table), items(bench), **limits))
    assert Counter(map(tuple, got.collect())) == Counter((k, *plain_contaminated(t, bench)) for k, t in table)


def test_contaminated_empty(docs, items):
    got = decontaminate.digest(decontaminate.contaminated(docs([(1, "a b"), (2, None)]), items([])))
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0, 0, none, False), (2, 0, 0, 0, none, False)]
    assert decontaminate.contaminated(docs([]), items([(1, "a")])).collect() == []


def test_spans_and_shifts(docs, items):
    bench = [(1, " ".join(f"k{j}" for j in range(15)))]
    text = "x " * 7 + bench[0][1] + " y y " + " ".join(f"k{j}" for j in range(3, 13))
    row = decontaminate.contaminated(docs([(1, text)]), items(bench)).first()
    assert [tuple(s) for s in row.spans] == [(7, 22), (24, 34)] and row["items"] == ["1"]
    (table,) = decontaminate.compiled([("1", words_of(bench[0][1]))])
    assert table.shift[(b"k0", b"k1")] == 8 and table.shift[(b"k8", b"k9")] == 0 and (b"x", b"x") not in table.shift


# --- operator 13


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS x", "2 AS n", "3 AS component", "4 AS deviation")


def whole(v):
    return np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


def check_whitened(got, table, count=32):
    """The rows of one vector length against numpy's own eigenvectors."""
    x = np.stack([whole(v) for _, v in table])
    n, mean = len(x), x.sum(0) / len(x)
    cov = (x - mean).T @ (x - mean) / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:count], axes[:, ::-1][:, :count]
    keep = e > len(cov) * np.finfo(float).eps * e[0]
    e, axes = e[keep], axes[:, keep]
    wanted = (x - mean) @ axes / np.sqrt(e)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    assert len(got) == n * len(e)
    made = np.zeros_like(wanted)
    for k, (i, _) in enumerate(table):
        deviation = sum(int(n * a - s) ** 2 for a, s in zip(x[k], x.sum(0)))
        found = by_id[(i, deviation)]
        assert sorted(found) == list(range(1, len(e) + 1))
        for c, rs in found.items():
            made[k, c - 1] = rs[0].whitened
            assert rs[0].n == n and rs[0].identity_error <= 1e-4
            assert rs[0].explained == pytest.approx(e[c - 1] / np.trace(cov), rel=1e-9)
    return made, wanted, e


def test_whitened(vectors):
    rng = np.random.default_rng(2)
    mix = rng.standard_normal((40, 40))
    data = rng.standard_normal((300, 40)) @ mix / 8
    table = [(k, v.tolist()) for k, v in enumerate(data)] + [(None, data[3].tolist()), (5, data[6].tolist()), (7, data[7].tolist())]
    bad = [(900, None), (901, [float("nan")] + [0.0] * 39), (902, [None] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, [])]
    got = whitening.whitened(vectors([(i, v, 0) for i, v in table + bad])).collect()
    made, wanted, _ = check_whitened(got, table)
    for c in range(wanted.shape[1]):
        sign = np.sign(made[:, c] @ wanted[:, c])
        assert np.abs(made[:, c] - sign * wanted[:, c]).max() < 1e-8


def test_whitened_equal_and_small(vectors):
    assert whitening.whitened(vectors([])).collect() == []
    assert whitening.whitened(vectors([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])).collect() == []
    table = [(1, [0.0]), (2, [1.0]), (3, [5.0])]
    made, wanted, _ = check_whitened(whitening.whitened(vectors([(i, v, 0) for i, v in table])).collect(), table)
    assert np.allclose(np.abs(made), np.abs(wanted))
    # fewer directions than components; two lengths, each whitened apart
    flat = [(k, [k % 5 + 0.25, 2.0 * (k % 5), float(k % 3), 1.0]) for k in range(30)]
    got = whitening.whitened(vectors([(i, v, 0) for i, v in flat + [(100 + i, v) for i, v in table]])).collect()
    check_whitened([r for r in got if r.vec_id < 100], flat)
    assert {r.n for r in got if r.vec_id >= 100} == {3}


def test_deviation_beyond_64_bits(vectors):
    table = [(k, [-1e6, 2e6] if k % 2 else [3e6, float(k)]) for k in range(40)]
    check_whitened(whitening.whitened(vectors([(i, v, 0) for i, v in table])).collect(), table)


@pytest.mark.parametrize("case", ["random", "clusters", "diagonal", "repeated", "graded", "one", "two"])
def test_leading_eigenvectors(case):
    rng = np.random.default_rng(8)
    n = {"one": 1, "two": 2}.get(case, 50)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "random": rng.random(n), "clusters": np.r_[np.full(10, 3.0), 3 - 1e-9 * np.arange(15), rng.random(25)][:n],
        "repeated": np.repeat([4.0, 2.0, 1.0, 0.5, 0.0], 10)[:n], "graded": 10.0 ** -np.arange(n) if n < 12 else 2.0 ** -np.arange(n),
    }.get(case, rng.random(n) + 1)
    a = np.diag(values) if case == "diagonal" else (q * values) @ q.T
    a = (a + a.T) / 2
    e, rows_ = whitening.leading(a, 32)
    assert np.allclose(e, np.sort(values)[::-1][:32], atol=1e-13 * 50)
    assert np.abs(rows_ @ rows_.T - np.eye(len(e))).max() < 1e-12
    assert np.abs(rows_ @ a - e[:, None] * rows_).max() < 1e-12
