"""The operators on small tables with nulls, empties, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import ann, bpe, components, html_extract, langid, ngram_join, packing, quality_rules, secret_scan, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, shard string, uid string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _rows():
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    a, passage = say(80), say(15)
    texts = [a, a, a + " more", None, "", " \n", "x", say(60) + passage, passage + say(50), say(30) + passage + say(20), say(4000), "é" * 40 + "漢" * 40, "token=abcdef123456 " + say(30), a]
    rows = [(i, t, "en" if i % 3 else None, "s", 0, "r", "h", "u") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[4], (None, "no id " + passage, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}


def test_quality_counts(spark, docs, labels, empty):
    got = quality_rules.score_documents(docs, labels).orderBy("doc_id").collect()
    assert len(got) == len(_rows())
    by = {x.doc_id: x for x in got}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[0].kept and by[0].n_words == 80
    assert quality_rules.score_documents(empty, labels).count() == 0
    assert quality_rules.filter_documents(docs, labels).columns == docs.columns
    kept = quality_rules.filter_documents(docs, labels.limit(0)).select("doc_id").collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(x.doc_id for x in got if x.kept and x.doc_id is not None)


def test_repeated_words(spark):
    texts = ["a b c d e f g h a b c d e f g h", "x " * 30, " ".join(map(str, range(50))), "a b c d e f g h i " * 2 + "z", None]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "text string").select(quality_rules.counts(F.col("text"))["n_repeat_words"]).collect()]

    def plain(t):
        w = (t or "").split()
        g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        return len({i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(8)})

    assert got == [plain(t) for t in texts]


def test_thresholds_are_certified(spark):
    """Good texts rarely have symbols, bad ones do: the cutoff lies between, and holds the binomial bound; a small stratum has none."""
    r = random.Random(1)
    rows = []
    for i in range(3000):
        bad, few = i % 10 == 0, i % 100 == 1
        rows.append((i, " ".join(r.choice(WORDS) + ("###" if bad and r.random() < 0.9 else "") for _ in range(40)), "xx" if few else "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3000)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality_rules.score_documents(docs, labels).collect()}
    assert not any(got[i] for i in range(0, 3000, 10)) and all(got[i] for i in range(3000) if i % 10)
    k, n = F.lit(3).cast("long"), F.lit(500).cast("long")
    tail = spark.range(1).select(quality_rules.binomial_tail(k, n, 0.02)).first()[0]
    from math import comb

    assert tail == pytest.approx(sum(comb(500, j) * 0.02**j * 0.98 ** (500 - j) for j in range(4)))


def test_sharding(spark, docs, empty):
    got = sharding.shard_documents(docs, shards=5).collect()
    assert len(got) == len(_rows()) and {x.law for x in got} == {"bytes"}
    for s in range(5):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    for x in got:
        text = next(t for i, t, *_ in _rows() if i == x.doc_id) or ""
        assert (x.size, x.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
    assert sharding.shard_documents(empty, shards=5).count() == 0
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(100)).alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"))
    sizes = [x["s"] for x in sharding.shard_documents(even, shards=7).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 0.01 * max(sizes)


def _plain_tree(rows, shards, target, spread):
    """Shards by plain recursion over the same points: exact weighted medians along the widest dimension."""
    widths = [max(p[k] for _, p in rows) - min(p[k] for _, p in rows) or 1.0 for k in range(4)]

    def cut(part, n):
        if n == 1 or not part:
            return [part] + [[]] * (n - 1)
        k = max(range(4), key=lambda k: (max(p[k] for _, p in part) - min(p[k] for _, p in part)) / widths[k])
        part, goal, under, at = sorted(part, key=lambda r: r[1][k]), sum(s for s, _ in part) * (n // 2) / n, 0, 0
        while at < len(part) and under + part[at][0] < goal:
            under, at = under + part[at][0], at + 1
        return cut(part[:at], n // 2) + cut(part[at:], n - n // 2)

    return cut(rows, shards)


def test_shards_against_plain_recursion(spark):
    """Bytes of the shards are as near as those of exact medians, copies lie together, a group over the limit is spread."""
    r = random.Random(5)
    texts = ["x" * r.randrange(50, 150) + str(i) for i in range(3000)]
    rows = [(i, texts[i - i % 2] if i < 600 else "hot" * 20 if i % 3 == 0 else texts[i], r.choice("abc"), r.choice("de")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("clash"))
    got = sharding.shard_documents(docs, shards=8).collect()
    bytes_ = {s: sum(x.size for x in got if x.shard == s) for s in range(8)}
    known = sharding.facts(docs)
    total = sum(bytes_.values())
    points = sharding.coordinates(sharding._at_one_point(known, total, 8)).collect()
    plain = [sum(s for s, _ in p) for p in _plain_tree([(x.size, (x.d_lang, x.d_source, x.d_size, x.d_id)) for x in points], 8, None, None)]
    assert max(bytes_.values()) - min(bytes_.values()) <= max(plain) - min(plain) + 0.02 * total / 8
    by = {}
    for x in got:
        by.setdefault(rows[x.doc_id][1], set()).add(x.shard)
    assert all(len(s) == 1 for t, s in by.items() if t != "hot" * 20) and len(by["hot" * 20]) > 1


def test_packing(spark, docs, empty):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs, path, 256).collect()
    bins = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == bins.get(x.sequence_id, 0)
        bins[x.sequence_id] = x.offset + x.length
    assert max(bins.values()) <= 256
    w = packing.words(path)
    total = sum(len(w.whole(t or "")) // 4 + 1 for _, t, *_ in _rows())
    assert sum(x.length for x in got) == total and len(bins) <= -(-total // 256) + 1
    assert packing.pack(empty, path).count() == 0


def test_bpe_round_trip(spark, docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    text = {i: t or "" for i, t, *_ in _rows()}
    for x in bpe.round_trip(docs, path, P.PATTERN).collect():
        assert x.decoded_sha256 == hashlib.sha256(text[x.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(x.text == text[x.doc_id] for x in back) and len(back) == len(_rows())
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_near_duplicates(spark, docs, empty, monkeypatch):
    def plain():
        rows = [(i, t or "") for i, t, *_ in _rows() if i is not None]
        sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set() for _, t in rows]
        links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
        root = [i for i, _ in rows]
        for _ in rows:
            root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
        return sorted((rows[i][0], root[i], len(links[i])) for i in range(len(rows)))

    for block in (800, 2):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
        assert sorted(map(tuple, got)) == plain()
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(x.doc_id for x in one.where("doc_id is not null").collect()) == sorted({c for _, c, _ in plain()})
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    """Whatever the number of tries that match: the chance to miss a pair at the threshold stays under the target, and a trie fewer at the last level would not do; the smallest nodes are shortened."""
    rows = [(m, 100 * m + t, 7, 2 + (t * 5) % 11) for m in (1, 3, 11, 20, 32) for t in range(m)]
    got = ngram_join.levels(spark.createDataFrame(rows, "rep long, node long, rest int, size long"), 0.8, ngram_join.RECALL).collect()
    size = {(r, n): s for r, n, _, s in rows}
    for m in (1, 3, 11, 20, 32):
        mine = sorted((x.level, size[m, x.node]) for x in got if x.rep == m)
        free = (1 - 0.8**ngram_join.FLOOR) ** (ngram_join.TREES - m)
        missed = free * np.prod([1 - 0.8**level for level, _ in mine])
        assert len(mine) == m and missed <= (1 - ngram_join.RECALL) * (1 + 1e-9)
        low = [k for k, x in enumerate(mine) if x[0] < ngram_join.DEPTH]
        if low:
            level = mine[0][0]
            longer = [level + 1 if k == 0 else x[0] for k, x in enumerate(mine)]
            assert free * np.prod([1 - 0.8**x for x in longer]) > (1 - ngram_join.RECALL) * (1 - 1e-9)
        levels = sorted({x[0] for x in mine})
        assert len(levels) == 1 or len(levels) == 2 and max(s for x, s in mine if x == levels[0]) <= min(s for x, s in mine if x == levels[1])
    assert len({x.level for x in got}) > 2


def _plain_dedup(rows):
    by = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                by[b[k : k + 50]] = min(i, by.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and by[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, docs, empty, monkeypatch):
    want = _plain_dedup([(i, t) for i, t, *_ in _rows()])
    for batch in (4000, 2):
        monkeypatch.setattr(suffix_dedup, "BATCH_DOCS", batch)
        got = suffix_dedup.deduplicate(docs).fillna(-1, ["doc_id"]).collect()
        assert sorted(map(tuple, got)) == want
    short = suffix_dedup.without_repeats(docs)
    assert short.columns == docs.columns
    left = {x.doc_id: x.text for x in short.collect()}
    by = {x.doc_id: x.n_bytes - x.n_removed for x in suffix_dedup.deduplicate(docs).where("doc_id is not null").collect()}
    assert all(len(left[i].encode()) == n for i, n in by.items() if n and i in left and left[i]) and 1 not in left
    assert suffix_dedup.deduplicate(empty).count() == 0 and suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_dedup_of_periodic_and_overlapping_texts(spark):
    r = random.Random(9)
    pieces = ["ab" * 40, "a" * 120, "".join(r.choice("abc") for _ in range(300)), "".join(r.choice("abcdefgh ") for _ in range(400))]
    rows = [(i, "".join(r.choice(pieces)[r.randrange(60) :][: r.randrange(200)] for _ in range(4))) for i in range(60)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == _plain_dedup(rows)


def test_secret_scan(spark, docs, empty):
    got = {x.doc_id: x for x in secret_scan.find_secrets(docs).collect()}
    assert got[12].n_assign == 1 and got[12].spans.startswith("assign:0:18") and got[3].spans == ""
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {x.doc_id: x.text for x in secret_scan.redact(docs).collect()}
    assert red[12].startswith("[secret] ") and red[3] is None and red[0] == _rows()[0][1]
    assert secret_scan.find_secrets(empty).count() == 0


def test_language(spark, empty):
    en, de = "the and of to in that is was for with", "der die und das nicht mit für ist von ein"
    r = random.Random(7)
    rows = [(i, " ".join(r.choice((en if i % 2 else de).split()) for _ in range(r.randrange(8, 60))), "en" if i % 2 else "de") for i in range(400)] + [(500, None, "en"), (501, "12 34", None), (None, en, "en"), (502, "²²² ½½ Ⅷ", "en"), (503, "the and of " * 200_000, "en")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))).collect()
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert len(held) > 40 and np.mean([x.lang_pred == ("en" if x.doc_id % 2 else "de") for x in held]) > 0.98
    assert {x.lang_pred for x in got if x.doc_id in (500, 501, 502)} == {"und"}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert langid.identify(empty).count() == 0


def test_html(spark):
    body = "<html><body><nav>menu</nav><div class='c1'><p>{0}</p></div><div class='side'><p>" + "noise, " * 40 + "</p></div></body></html>"
    rows = [(i, "http://h.example/x", body.format("words of it, " * 20)) for i in range(5)] + [(9, "http://h.example/y", body.format("short")), (10, None, None), (10, None, None), (11, "odd", "<p>x")]
    got = {x.page_id: x for x in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))).collect()}
    assert got[9].text == "short" and got[10].text == "" and got[10].n_chars == 0 and got[11].text == "x"


def test_ann(spark, monkeypatch):
    g = np.random.default_rng(1)
    x = g.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (9005, [None] * 16), (100, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))
    monkeypatch.setattr(ann, "HOT_ROWS", 200)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
        hits += len({m[1] for m in mine} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits >= 0.9 * 300
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3]


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.drop("rep", "shard", "uid").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} <= {i for i, *_ in _rows()} and 0 in {x.doc_id for x in out}
    assert not {1, 2, 13, 3, 4, 5} & {x.doc_id for x in out}


def test_what_an_explode_makes_is_not_broadcast(spark, monkeypatch):
    """32 rows for each document, which Spark takes for one: on 0.5 GB the driver ran out of memory."""
    classes = spark.range(4).select(F.col("id").alias("rep"), F.sequence(F.lit(0), F.lit(31)).cast("array<long>").alias("paths"), F.lit(bytes(32)).alias("sketch"))  # of known size
    monkeypatch.setattr(ngram_join, "bounded", lambda df, rows: df.hint("merge"))
    plan = ngram_join.candidates(classes, 0.8, 0.999)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
