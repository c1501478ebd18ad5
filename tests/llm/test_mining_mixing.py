"""Hard negatives, importance resampling and source mixing against brute force, with the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import hard_negatives, mixture, ranges, resampling


def _mined(rows, positives=5, negatives=10):
    """All pairs by Python integers. rows: {vec_id: (label, vector)}."""
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in rows.items()}
    out = set()
    for a, (label, q) in whole.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in whole.items() if i != a}
        first = lambda some, k: sorted(some, key=lambda i: (-score[i], i))[:k]
        for p in first([i for i in score if whole[i][0] == label], positives):
            fit = [i for i in score if whole[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(first(fit, negatives))}
    return out


def _rows(x, labels):
    return {i: (int(label), [float(e) for e in v]) for i, (label, v) in enumerate(zip(labels, x))}


@pytest.mark.parametrize("shape", ["clusters", "sphere", "same", "coarse", "huge"])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, shape):
    g = np.random.default_rng(3)
    n = 700
    labels = g.integers(0, 4, n)
    x = g.standard_normal((n, 8))
    if shape == "clusters":
        x = g.standard_normal((6, 8))[g.integers(0, 6, n)] * 2 + 0.3 * x
    elif shape == "same":  # a vector and a label that more than a third of all rows have
        x[::2], labels[::3] = x[0], 1
    elif shape == "coarse":  # ties everywhere
        x = np.round(x * 2) / 256
    elif shape == "huge":
        x = x * 1e5
    x = np.float32(x)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 200)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    rows = _rows(x, labels)
    df = spark.createDataFrame([(i, v, label) for i, (label, v) in rows.items()], "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == _mined(rows) and got


def test_hard_negatives_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.25], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [0.5], 2), (8, [], 2), (9, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (100, [1.0, 1.0], None), (200, [1.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("score", F.lit("x")).withColumn("anchor", F.lit("x"))
    got = {tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()}
    used = {0: (1, [1.0, 0.5]), 1: (1, [1.0, 0.25]), 2: (2, [0.5, 0.25]), 7: (2, [0.5, 0.0]), 8: (2, [0.0, 0.0]), 9: (1, [0.0, 0.0]), 200: (7, [1.0, 1.0])}
    assert got == _mined(used) and any(r[1] == 1 for r in got)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_ball_tree_prunes():
    g = np.random.default_rng(1)
    x = np.floor((g.standard_normal((50, 16)) * 4)[g.integers(0, 50, 8000)] * 256 + g.standard_normal((8000, 16)) * 20)
    forest = hard_negatives.Forest(np.arange(8000), np.zeros(8000, int), x)
    low, high = forest.bounds(x[:1])
    best = forest.best(x[0], low[0], high[0], 0, True, 10, (-math.inf, math.inf), -1)
    s = x @ x[0]
    assert best == [(s[i], i) for i in np.lexsort((np.arange(8000), -s))[:10]]
    assert forest.visited < 0.3 * len(forest.leaves)


TEXTS = ["the cat sat on the mat " * 3, "", None, "Ärger über Öl, straße 42! " * 8, "  \n", "x" * 5000, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "solve the task: the answer is 42 " * 5]


def _docs():
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(200)] + ["größe", "42", "don't"]
    texts = TEXTS + [" ".join(r.choice(vocabulary) for _ in range(r.choice((5, 19, 20, 80)))) for _ in range(60)]
    texts.append(" ".join(r.choice(vocabulary) for _ in range(30_000)))  # a very long one
    return list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, texts[6])]


def _resampled(docs, target, n, percent=10):
    least, most = n
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    runs = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(least, most + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, runs(x)))
    for x in target:
        t.update(map(bucket, runs(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for i, x in docs:
        f = runs(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = percent * len(enough) // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(enough)]
    return sorted(out + [(*r[:4], None) for r in rows if r[4] < 20], key=str)


@pytest.mark.parametrize("n", [(1, 1), (1, 2), (3, 3)])
def test_resampling_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    docs, target = _docs(), ["solve the task: what is 6 times 7?", None, "", "The Answer"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("rank", F.lit("x")).withColumn("uid", F.lit(1)).withColumn("score", F.lit(1))
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, n=n, chunk_bytes=300).collect()
    assert sorted(map(tuple, got), key=str) == _resampled(docs, target, n, 30)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    assert sorted(tuple(r) for r in resampling.resample(some, none).select("doc_id", "n_features", "rank").collect()) == [(1, 30, None), (2, 0, None)]


def test_chunks_keep_every_run_once():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["ab", "ä", " ", "\n", "zz9", ", "]) for _ in range(r.randrange(1, 120))).encode()
        for n in (1, 2, 4):
            parts = list(resampling.chunks(text, n, r.randrange(1, 30)))
            got = [g for own, body in parts for g in resampling.grams(own, body, 1, n)]
            assert Counter(got) == Counter(resampling.grams(len(text), text, 1, n))
            assert b"".join(body[:own] for own, body in parts) == text


def _mixed(docs, weights=(1, 2, 3), epochs=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, source, text in docs:
        total[source] += size(text)
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        rest = sum(total.values()) - sum(epochs * total[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: Fraction(epochs * total[s]) for s in stopped} | {s: Fraction(rest * w[s], sum(w[x] for x in free)) for s in free}
        if not (above := {s for s in free if target[s] > epochs * total[s]}):
            return total, target
        stopped |= above


def test_mixing_reaches_every_budget(spark, monkeypatch):
    r = random.Random(6)
    names = ["b", "a", "é", "Z", None, "𝄞", "tiny", "empty", "c"]
    docs = [(i, r.choice([*names[:6], "c", "c", "c", "c"]), "wort " * r.randrange(0, 60)) for i in range(400)] + [(1000, "tiny", "just three words"), (1001, "empty", None), (1002, "empty", ""), (7, "c", "twice twice"), (7, "c", "twice twice"), (None, "a", "no number"), (1003, "b", "word " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("before", F.lit("x")).withColumn("start", F.lit(1)).withColumn("range", F.lit(1)).withColumn("target", F.lit(1))
    monkeypatch.setattr(mixture, "RANGE_ROWS", 20)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 4)
    got = mixture.mix(df).collect()
    again = mixture.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    total, target = _mixed(docs)
    by = {i: s for i, s, _ in docs}
    taken, size = Counter(), Counter()
    for x in got:
        s = by[x.doc_id]
        taken[s] += x.taken
        size[s] += x.size
        assert x.source_size == total[s] and x.target == pytest.approx(float(target[s]), rel=1e-12)
        assert 0 <= x.taken <= 3 * x.size
    assert len(got) == len(docs) and size == total
    assert all(taken[s] == math.floor(target[s]) for s in total)
    # Within a source the numbers of times that documents are taken differ by one at most.
    for s in total:
        times = [x.taken / x.size for x in got if by[x.doc_id] == s and x.size]
        assert not times or max(times) - min(times) <= 1


def test_mixing_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixture.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "a", " ")], "doc_id long, source string, text string")
    assert sorted(tuple(r) for r in mixture.mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
