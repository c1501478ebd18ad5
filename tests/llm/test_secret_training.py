"""The network of op8 learns from the findings of all documents, in shards, as a plain reading of all of them would."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import secret_scan
from ledgermill.llm.secret_scan import BODY, CHECK, CONTEXT, FIT, LAST, WIDTH

SHARD, ROUNDS, STEPS = 400, 2, 60


@pytest.fixture(scope="module")
def texts():
    """More documents than the sample of before held, each with a finding of its own; one has a run of a hundred windows."""
    r = random.Random(4)
    out = []
    for i in range(2600):
        key = "".join(r.choice("0123456789abcdef") for _ in range(32)) if i % 2 else "".join(r.choice("ghijklmnop") for _ in range(20))
        out.append(f"this is what {key} says")
    return [*out, "see " + "/".join("".join(r.choice("ghijklmnop") for _ in range(9)) for _ in range(241)), None, ""]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50]])], "doc_id long, text string").repartition(7)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.sparkSession.createDataFrame(secret_scan.labelled(docs).withColumn("hash", F.xxhash64("codes")).toPandas())


def test_every_window_of_every_document_is_labelled(texts, rows):
    letters = {i: c for c, i in secret_scan.ALPHABET.items()}
    got = {("".join(letters[c] for c in x.codes[CONTEXT : CONTEXT + BODY] if c), x.secret) for x in rows.collect()}
    want = {(t.split()[3], bool(i % 2)) for i, t in enumerate(texts[:2600])}
    run = texts[2600].split()[1]
    assert len(run) == 2409
    want |= {(run[s : s + BODY], False) for s in [*range(0, len(run) - BODY, BODY // 2), len(run) - BODY]}
    assert got == want and rows.count() == len(want)
    assert {x.part for x in rows.where("secret").collect()} == {FIT, CHECK, LAST} and {x.part for x in rows.where("not secret").collect()} == {FIT, CHECK}


def test_shards_come_to_the_mean_over_all_findings(docs, rows):
    net = secret_scan.train(docs, SHARD, ROUNDS, STEPS)
    all_ = [tuple(x) for x in rows.select("part", "finding", "secret", "codes", "hash").collect()]
    cases = list(secret_scan.made_up(secret_scan.GENERATED))
    array = lambda codes: np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDTH)

    def made(*parts):
        chosen = [c for i, c in enumerate(cases) if i % 5 in parts]
        y = np.array([k for c in chosen for k in c[2]])
        return array(c[1] for c in chosen)[y >= 0], y[y >= 0]

    fit = [(bytes(c), s, h) for part, _, s, c, h in all_ if part == FIT]
    shards = -(-len(fit) // SHARD)
    assert shards > 3
    want = secret_scan.Network.new()
    for turn in range(ROUNDS):
        parts = [[x for x in fit if x[2] % shards == k] for k in range(shards)]
        assert sum(map(len, parts)) == len(fit)
        flat = [secret_scan.learned(want, [x[0] for x in p], [x[1] for x in p], made(0, 1, 2), 1, STEPS // ROUNDS, (turn, k)).flat() for k, p in enumerate(parts)]
        want = secret_scan.Network(want.w).put(np.mean(flat, axis=0))
    assert np.allclose(net.flat(), want.flat(), atol=1e-4)

    x, y = made(3)
    check = [(bytes(c), s) for part, _, s, c, _ in all_ if part == CHECK]
    net_, labels = secret_scan.Network(net.w), np.concatenate([[int(s) for _, s in check], y])
    net_.calibrate(np.concatenate([array(c for c, _ in check), x]), labels)
    assert np.allclose([net.scale, net.shift], [net_.scale, net_.shift], rtol=1e-3)
    best = {}
    for part, finding, _, codes, _ in all_:
        if part == LAST:
            best[finding] = max(best.get(finding, 0), net.probability(array([bytes(codes)]))[0])
    own = [net.probability(array([c[1]])).max() for i, c in enumerate(cases) if i % 5 == 4 and c[0]]
    both = [secret_scan.recall_threshold(np.array(p)) for p in ([*best.values(), *own], own)]
    assert len(best) > 200 and net.threshold == pytest.approx(min(both), rel=1e-4)


def test_a_pass_takes_every_window():
    codes = np.arange(1000, dtype=np.uint8).reshape(-1, 1) % 250
    made = np.full((4, 1), 255, np.uint8), np.array([0, 1, 0, 1])
    marks = np.arange(1000)
    seen = [t for _, t in secret_scan.dealt(codes, marks, made, 1, 5, np.random.default_rng(1))]
    assert len(seen) == 32 and set(marks) <= set(np.concatenate([t[:-32] for t in seen]))
    few = list(secret_scan.dealt(codes[:3], marks[:3], made, 2, 5, np.random.default_rng(1)))
    assert len(few) == 10 and len(list(secret_scan.dealt(codes[:0], marks[:0], made, 2, 5, np.random.default_rng(1)))) == 10
