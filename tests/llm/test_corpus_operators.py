"""Mixing, near-duplicates, search, toxicity, LM scores and the pipeline against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing, near_dedup, ngram_lm, toxicity, vector_file
from graphloom.llm.elias_fano import EliasFano

from .conftest import DOCS, rows


def prose(pick, n, stem=""):
    return " ".join(stem + "".join(pick.choice(["ta", "ren", "mo", "li", "es", "or", "un"]) for _ in range(pick.randint(1, 4)))
                    for _ in range(n))


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, rest, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not full:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
        rest -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(docs):
    pick = random.Random(1)
    table = [(k, prose(pick, pick.randint(0, 60)), pick.choice(["b", "a", "c", "Z", None])) for k in range(200)]
    table += [(500, "x y z", "tiny"), (501, None, "empty"), (502, "w " * 4000, "big"), (0, table[0][1], table[0][2])]
    df = docs(table)
    first, again = (sorted(map(tuple, mixing.mix(df, block_words=300, shards=5).collect())) for _ in range(2))
    assert first == again and len(first) == len(table)
    sizes = Counter()
    for _, text, source in table:
        sizes[source] += len((text or "").split())
    want = plain_targets(dict(sizes))
    got = mixing.mix(df, block_words=300, shards=5).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    # texts stay whole, so a source misses its target by half of its longest at most
    left = {s: [len(t.split()) for _, t, x in table if x == s and t] for s in want}
    assert all(abs(taken[s] - want[s]) <= max(left[s], default=0) / 2 + 1 for s in want)
    assert all(abs(taken[s] - want[s]) <= 30 for s in want if s != "big")
    assert mixing.mix(docs([])).count() == 0
    _every_copy_has_its_place(got, 5)
    copies = mixing.mixed(df, block_words=300, shards=5)
    whole_texts = {(k, t) for k, t, _ in table}
    assert all((r.doc_id, r.text) in whole_texts for r in copies.collect())
    words = copies.groupBy("source").agg(F.sum(mixing.n_words("text")).alias("n")).collect()
    assert {r.source: r.n for r in words if r.n} == {s: n for s, n in taken.items() if n}


def _every_copy_has_its_place(got, shards):
    """Copies sum to what is taken, are whole, and only equal rows share a place."""
    places = {(c.shard, c.position, r.doc_id) for r in got for c in r.copies}
    assert len(places) == len({p[:2] for p in places}) and {p[0] for p in places} == set(range(shards))
    assert all(sum(c.words for c in r.copies) == r.taken and {c.words for c in r.copies} <= {r.size} for r in got)


def test_mix_holds_the_quotas_of_the_tree(docs, spark, monkeypatch):
    pick = random.Random(4)
    df = docs([(k, prose(pick, pick.randint(1, 9)), "ab"[k % 3 > 0]) for k in range(400)])
    quotas = []
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n: quotas.append(split(q, n)) or quotas[-1])
    rows, out = mixing.draws(mixing.sized(df), shards=6, block_words=100)
    placed = out.join(rows.select("row", "sid"), "row").collect()
    blocks = {}
    for r in placed:  # a block copy lies in one shard
        assert blocks.setdefault((r.sid, r.block, r["pass"]), r.shard) == r.shard
    held = Counter((shard, sid) for (sid, _, _), shard in blocks.items())
    wanted = {(r.shard, r.sid): r.n for r in quotas[0].collect() if r.n}
    # the block at a target may hold no document that fits
    assert sum(wanted.values()) - sum(held.values()) <= 2 and all(held[k] <= n for k, n in wanted.items())
    assert all(n - held[k] <= 1 for k, n in wanted.items())
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n: q.select(F.lit(0).alias("shard"), "sid", "n"))
    alone = mixing.mix(df, shards=6, block_words=100).collect()
    assert {c.shard for r in alone for c in r.copies} == {0}  # the result depends on the tree


def test_splitting_tree(spark):
    quotas = {1: 1000, 2: 10, 3: 0, 4: 333}
    df = spark.createDataFrame(list(quotas.items()), "sid int, n bigint")
    got = mixing.split_quotas(df, 6).collect()
    assert {r.shard for r in got} == set(range(6)) and all(r.n >= 0 for r in got)
    for s, n in quotas.items():
        assert sum(r.n for r in got if r.sid == s) == n
    per = Counter()
    for r in got:
        per[r.shard] += r.n
    assert max(per.values()) - min(per.values()) <= 2
    assert 120 < [r.n for r in got if r.sid == 1][0] < 215  # 167 expected


def test_hypergeometric(spark):
    """The inverse distribution agrees with exact probabilities."""
    good, every, drawn = 7, 20, 6
    p = [math.comb(good, k) * math.comb(every - good, drawn - k) / math.comb(every, drawn) for k in range(drawn + 1)]
    df = spark.range(200).select(((F.col("id") + 0.5) / 200).alias("u"))
    got = df.select("u", mixing.hypergeometric(F.lit(good), F.lit(every), F.lit(drawn), F.col("u")).alias("k")).collect()
    assert all(r.k == int(np.searchsorted(np.cumsum(p), r.u)) for r in got)


def plain_components(texts, width, percent=80):
    sets = {}
    for i, t in texts.items():
        w = [x for x in (t or "").encode().lower().split()]
        n = min(width, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    pick = random.Random(4)
    texts, base = {}, [prose(pick, n).split() for n in (4, 9, 30, 120, 400, 1500)]
    for k in range(150):
        words = list(pick.choice(base))
        for _ in range(pick.choice([0, 0, 1, 2, 5, 20])):
            words[pick.randrange(len(words))] = prose(pick, 1)
        texts[1000 - k] = " ".join(words).upper() if k % 7 == 0 else "\t".join(words)
    texts |= {1: None, 2: "", 3: " \n", 4: "one", 5: "One", 6: "two", 7: "a b", 8: "b a", 9: " ".join(["a"] * 300)}
    want = plain_components(texts, width)
    got = rows(near_dedup.near_duplicates(docs(list(texts.items())), width=width))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == want
    assert near_dedup.near_duplicates(docs([]), width=width).count() == 0


def test_bands_larger_than_a_block(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    pick = random.Random(6)
    base = prose(pick, 60).split()
    texts = {}
    for k in range(40):  # a chain: each differs a little from the one before
        base = list(base)
        base[(7 * k) % 60] = prose(pick, 1, "q")
        texts[k] = " ".join(base)
    got = rows(near_dedup.near_duplicates(docs(list(texts.items())), width=2))
    assert {i: r.component_id for i, r in got.items()} == {i: v[1] for i, v in plain_components(texts, 2).items()}


def test_groups_beside_each_other_and_odd_ids(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    pick = random.Random(7)
    texts, base = {}, [prose(pick, 50).split() for _ in range(3)]
    for k in range(90):  # groups that differ by less and by more than the threshold
        words = list(base[k % 3][:40] + base[(k // 3) % 3][40:])
        for _ in range(pick.choice([0, 1, 1, 2, 4])):
            words[pick.randrange(50)] = prose(pick, 1)
        texts[k] = " ".join(words)
    want = plain_components(texts, 2)
    long = prose(pick, 9000)
    table = [*texts.items(), texts_of := (0, texts[1]), (0, texts[0]), (None, long), (None, long), (None, texts[5]), (None, None)]
    got = near_dedup.near_duplicates(docs(table), width=2).collect()
    assert len(got) == len(table)
    for k in range(2, 90):
        assert {(r.component_id, r.kept) for r in got if r.doc_id == k} == {(min(want[k][1], 0 if want[k][1] == want[1][1] else k), want[k][2] and want[k][1] != want[1][1])}
    assert texts_of[0] in {r.doc_id for r in got if r.kept}
    null = [(r.component_id, r.kept) for r in got if r.doc_id is None]
    assert sorted(null, key=str) == sorted([(None, False)] * 3 + [(0 if want[5][1] == want[1][1] else want[5][1], False)], key=str)


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        every = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        a, b = np.sort(every[:2000]), np.sort(np.r_[every[:n], every[2000:4000 - n]])
        x, y = (near_dedup.registers(v)[None, :] for v in (a, b))
        assert abs(near_dedup.estimate(x, y)[0] - share) < 0.1


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    table = [(k, rng.normal(size=6).round(3).tolist()) for k in range(300)]
    table += [(k, table[0][1]) for k in range(300, 340)] + [(k, [0.0] * 6) for k in range(400, 405)]
    table += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (601, [float("nan")] * 6), (700, [1.0, 2.0]), (701, [])]
    df = spark.createDataFrame(table, "vec_id long, v array<double>").selectExpr("vec_id", "v AS embedding", "1 AS id")
    good = vector_file.usable(df, "vec_id", "embedding").select("id", vector_file.integers("v").alias("v"))
    got = vector_file.exact_top_k(good, good.filter("id % 100 = 0"), k=10).collect()
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in table
            if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ints if i % 100 == 0):
        score = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items()
                       if i != q and len(v) == len(ints[q]))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(score[:10])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vector_file.exact_top_k(good.limit(0), good.limit(0)).count() == 0


def test_toxicity(docs, spark):
    pick = random.Random(8)
    bad = ["idiot", "scum", "moron"]
    table, marks = [], []
    for k in range(600):
        parts = [prose(pick, 12) for _ in range(6)]
        toxic = k % 5 == 0
        if toxic:
            parts[pick.randrange(6)] += f" you {pick.choice(bad)}"
        table.append((k, ". ".join(parts) + "."))
        marks.append((k, int(toxic)))
    table += [(900, None), (901, "moron " * 30_000), (900, "")]
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(table), labels).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = {k for k, _ in table if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {r.doc_id for r in got if r.held_out} == held
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id < 600]
    assert np.mean(right) > 0.95
    texts = dict(table)
    for r in got:
        if r.doc_id < 600 and r.doc_id % 5 == 0 and r.predicted:
            assert any(any(b in texts[r.doc_id][s.begin:s.end] for b in bad) for s in r.offending)
    assert toxicity.toxicity(docs([]), labels.limit(0)).count() == 0
    assert toxicity.toxicity(docs(table[:3]), labels.limit(0)).count() == 3


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 1), (5, 6), (3000, 3001), (3000, 1 << 20), (3000, 1 << 62), (2000, 1 << 64)):
        values = np.sort(rng.integers(0, universe - 1 if universe > 1 else 1, n, dtype=np.uint64, endpoint=universe == 1))
        ef = EliasFano.build(values, universe)
        assert (ef.access(np.arange(n)) == values).all()
        distinct = np.unique(values)
        ef = EliasFano.build(distinct, universe)
        at = ef.find(np.r_[distinct, distinct[:-1] + np.uint64(1)] if n > 1 else distinct)
        assert (at[:len(distinct)] == np.arange(len(distinct))).all()
        for v, k in zip((distinct[:-1] + np.uint64(1)).tolist(), at[len(distinct):]):
            assert (k >= 0) == (v in set(distinct.tolist())) if n < 10 else True


def test_lm_scores(docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD", 40)  # several shards a level
    pick = random.Random(9)
    pool = [prose(pick, 1) for _ in range(40)]
    table = [(k, " ".join(pick.choice(pool) for _ in range(pick.randint(1, 40)))) for k in range(80)]
    table += [(200, None), (201, ""), (202, table[0][1] + " Unseen words"), (203, (table[1][1] + " ") * 300)]
    held = {k for k, _ in table if zlib.crc32(str(k).encode()) % 7 == 2}
    train = [t for k, t in table if k not in held]
    got = rows(ngram_lm.lm_scores(docs(table)))
    uni = Counter(w for t in train for w in [*(t or "").encode().lower().split(), b"\n"])
    total, kinds = sum(uni.values()), len(uni)
    for k, t in table:
        w = [*(t or "").encode().lower().split(), b"\n"]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in held, len(w), sum(x in uni for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (total + kinds + 1)) for x in w))
    for k, t in table[:12] + table[80:83]:
        assert got[k].score == pytest.approx(plain_full_lm(train, t), rel=0.02, abs=0.1)  # a byte a probability
    assert ngram_lm.lm_scores(docs([])).count() == 0


def plain_full_lm(train, text, order=3):
    """Interpolated absolute discounting over all n-grams, each level with its own discount."""
    def toks(t):
        return [b"\n", *(t or "").encode().lower().split(), b"\n"]

    grams = {1: Counter(w for t in train for w in zip(toks(t)[1:]))}
    for n in range(2, order + 1):
        grams[n] = Counter(g for t in train for g in zip(*[toks(t)[k:] for k in range(n)]))
    total, kinds, d = sum(grams[1].values()), len(grams[1]), {}
    for n, found in grams.items():
        n1, n2 = (sum(c == k for c in found.values()) for k in (1, 2))
        d[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(w, context):
        if not context:
            return (grams[1][w,] - d[1]) / total if (w,) in grams[1] else max(d[1] * kinds / total, 0.1 / total)
        n, lower = len(context) + 1, p(w, context[1:])
        inside = {g: c for g, c in grams[n].items() if g[:-1] == context}
        if not inside:
            return lower
        seen, c = sum(inside.values()), inside.get((*context, w), 0)
        return (c - d[n] if c else 0) / seen + d[n] * len(inside) / seen * lower

    w = toks(text)
    return sum(math.log10(p(w[k], tuple(w[max(0, k - order + 1):k]))) for k in range(1, len(w)))


def test_lm_scores_keep_what_occurs_once(docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD", 40)
    pick = random.Random(10)
    table = [(k, prose(pick, 30)) for k in range(40)] + [(50, None), (51, prose(pick, 20) + " Unseen words")]
    held = {k for k, _ in table if zlib.crc32(str(k).encode()) % 7 == 2}
    train = [t for k, t in table if k not in held]
    pairs = Counter(g for t in train for g in itertools.pairwise((t or "").lower().split()))
    assert sum(c == 1 for c in pairs.values()) > len(pairs) / 4  # most evidence lies in what occurs once
    got = rows(ngram_lm.lm_scores(docs(table)))
    for k, t in table:
        assert got[k].score == pytest.approx(plain_full_lm(train, t), rel=0.02, abs=0.1)  # a byte a probability


def test_lm_bytes_reach_the_rarest():
    total = 10**12
    low = ngram_lm.lowest(0.6, total)
    p = np.array([0.4 / total, 1e-9, 1.0])
    assert ngram_lm.restored(low)[ngram_lm.quantised(p, low)] == pytest.approx(p, rel=0.06)


def test_pipeline(spark, tmp_path):
    pick = random.Random(11)
    line = "A line that very many of the documents in this table share."
    texts = {k: prose(pick, 90) + "\n" + (line if k < 8 else prose(pick, 9)) for k in range(40)}
    texts |= {50: texts[3], 51: texts[3] + " more", 52: "spam " * 400, 53: None, 54: ""}
    table = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(table, DOCS).withColumn("kept", F.lit(True)).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(df)
        if name != "encode":
            assert df.columns == corpus_pipeline.COLUMNS
    ids = [{r.doc_id for r in df.collect()} for df in seen]
    assert ids[0] == set(range(40)) | {50, 51} and ids[1] == ids[0]
    assert [r.doc_id for r in seen[1].filter(F.contains("text", F.lit(line))).collect()] == [51] or line in texts[51]
    assert ids[2] == set(range(40)) and seen[2].count() == 40
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    n = seen[2].agg(F.sum(mixing.n_words("text"))).first()[0]
    assert seen[3].agg(F.sum(mixing.n_words("text"))).first()[0] == n  # one source: its own size
    assert seen[3].filter(F.col("n_chars") != F.length("text")).count() == 0
    assert seen[4].count() == seen[3].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
