"""The whole job is done: cases that a shortened one would miss."""

from __future__ import annotations

import hashlib
import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import ann, html_extract, secret_scan, suffix_dedup


@pytest.fixture(scope="module")
def net():
    cases = list(secret_scan.generated(3000, 3))
    x = np.frombuffer(b"".join(c for _, c in cases), np.uint8).reshape(-1, secret_scan.WIDTH)
    y = np.array([int(k) for k, _ in cases])
    return secret_scan.Network.new().fit(x, y, steps=secret_scan.STEPS).calibrate(x, y)


def test_secret_at_the_end_of_a_long_run(net):
    r = random.Random(5)
    hits = alarms = 0
    for _ in range(40):
        key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(23)) + "7"
        text = f"post to https://www.example.com/help/articles/for/the/people/of/this/site/{key} then"
        hits += key not in secret_scan.redacted_text(text, secret_scan.scan(text, net))
        plain = "see https://www.example.com/help/articles/3/using/the/search/of/this/site/well/today then"
        alarms += bool(secret_scan.scan(plain, net))
    assert hits >= 38 and not alarms
    assert [e for _, e in secret_scan.windows(0, 100)][-1] == 100 and secret_scan.windows(3, 51) == [(3, 51)]


def test_planted_secrets_that_no_pattern_finds(spark):
    """Over documents with planted keys of three shapes: nearly all are learned spans, clean documents have none, base columns are what the patterns give."""
    r = random.Random(8)
    words = "the report of this year says that many people in town have read it with some care".split()
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    shapes = [lambda: some(alnum, 32), lambda: "ghp_" + some(alnum, 36), lambda: some(alnum + "+/", 43) + "="]
    plain = ["Donaudampfschifffahrtsgesellschaft", "4845168114407329", "state-of-the-art-technology", "www.example.com/help/articles/42", "2026-01-05T10.00.00", "internationalisation"]
    rows, planted = [], {}
    for i in range(600):
        text = " ".join(r.choice(words) for _ in range(40))
        extra = r.choice(plain)
        if i % 3 == 0:
            extra = planted[i] = shapes[i // 3 % 3]()
        elif i % 3 == 1:
            extra += ' token = "' + some("0123456789abcdef", 40) + '"'
        rows.append((i, f"{text} {extra} {text}"))
    rows += [(600, None), (601, "x" * 300_000), (602, "")]
    got = {x.doc_id: x for x in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(any(k == "learned" and key in rows[i][1][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x)) for i, key in planted.items())
    assert hit >= 0.95 * len(planted)
    alarms = sum(got[i].n_learned for i in range(600) if i % 3)
    assert alarms <= 0.02 * 400
    for i, text in rows:
        base = secret_scan.base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(secret_scan.written(base).encode()).hexdigest() and got[i].n_assign == sum(k == 0 for _, k, _ in base)


def test_base_spans_by_plain_search():
    """The patterns against a character-by-character reading."""

    def plain(text):
        key, out = set(string.ascii_letters + string.digits + "+/_.=-"), []
        i, n = 0, len(text)
        while i < n:  # assignments
            name = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(w)].lower() == w and text[i : i + len(w)].isascii()), None)
            j = i + len(name or "")
            if name:
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                    k = j
                    while k < n and text[k] in key:
                        k += 1
                    if k > j:
                        if k - j >= 6:
                            out.append((i, 0, k))
                        i = k
                        continue
            i += 1
        for kind, chars, head, least in ((1, string.ascii_uppercase + string.digits, "AKIA", 20), (2, "0123456789abcdef", "", 24)):
            i = 0
            while i < n:
                if text.startswith(head, i) and i + len(head) < n and text[i + len(head)] in chars:
                    k = i + len(head)
                    while k < n and text[k] in chars:
                        k += 1
                    if k - i >= least:
                        out.append((i, kind, k))
                    i = k
                else:
                    i += 1
        return sorted(out)

    r = random.Random(12)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789", "0af3", "0123456789abcdef0123456789", "é", "x", "-", "\n", "\t", "abcdef"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert secret_scan.base_spans(text) == plain(text), text


def test_windows_cover_a_run():
    for n in range(1, 200):
        assert set().union(*(range(s, e) for s, e in secret_scan.windows(7, 7 + n))) == set(range(7, 7 + n))


@pytest.mark.parametrize("tried", [5, 0])
def test_neighbours_where_few_buckets_may_be_visited(spark, monkeypatch, tried):
    """Whether m is lowered or not, no query is left short of its mass."""
    monkeypatch.setattr(ann, "MAX_PROBES", 2)
    monkeypatch.setattr(ann, "TRIED", tried)
    x = np.random.default_rng(2).standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.97 * 300


def test_ties_at_the_tenth_place_and_clustered_vectors(spark):
    """Of many vectors equally far the smallest vec_ids are taken; in clusters a query reads a small part of the table."""
    axis = np.eye(16)
    rows = [(0, [0.5] * 16)] + [(i + 1, (np.array([0.5] * 16) + (1 if i % 2 else -1) * axis[i // 2 % 16]).tolist()) for i in range(96)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(x.rank, x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(k, k, 1.0) for k in range(1, 11)]
    g = np.random.default_rng(3)
    x = g.standard_normal((100, 32))[g.integers(0, 100, 20_000)] + 0.2 * g.standard_normal((20_000, 32))
    hashes = ann.fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>"), len(x), 10)
    seen = 0
    for t in range(hashes.tables):
        keys = hashes.keys(x, t)
        size = {k: keys.count(k) for k in set(keys)}
        seen += np.mean([sum(size.get(k, 0) for k in hashes.visits(v, t, ann.mass_of(hashes.tables))) for v in x[:20]])
    assert seen < 0.25 * len(x)


def test_visits_never_stop_short_of_their_mass(monkeypatch):
    monkeypatch.setattr(ann, "MAX_PROBES", 2)
    short = ann.Hashes(16, 8, 2, 2.5, 1.2)
    assert short.visits(np.ones(16), 0, 0.859) == [] and 1 <= len(short.visits(np.ones(16), 0, 1e-6)) <= 2


SIDE = '<div class="sidebar">Popular things.</div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content-sidebar-wrap"><main><p>The text, in full.</p></main>{SIDE}</div>',
        f'<div class="container has-sidebar"><article><p>The text, in full.</p></article>{SIDE}</div>',
        f'<div class="page with-banner"><div><p>The text, in full.</p></div>{SIDE}</div>',
        f'<div class="ad">{"Buy this now. " * 20}</div><article><p>The text, in full.</p></article>',
        f'<main><article><p>The text, in full.</p><section id="comments"><article>Nice.</article></section></article></main>{SIDE}',
    ],
)
def test_wrappers_named_like_noise_keep_the_article(page):
    assert html_extract.extract(html_extract.blocks(f"<html><body>{page}</body></html>"), None) == "The text, in full."


def test_hidden_is_an_attribute_not_a_word():
    page = '<article><p title="The hidden valley">See <a href="/hidden-lake">the lake</a> and <a href=/hidden>more</a>.</p><p hidden>no</p><p aria-hidden="true">no</p></article>'
    assert html_extract.extract(html_extract.blocks(page), None) == "See the lake and more."


LEAD, TEXT = "A lead that says in short what follows below. " * 4, "The text goes on, and says it all at length. " * 40


@pytest.mark.parametrize(
    "page",
    [
        '<div class="post"><div class="lead">{0}</div><div class="text">{1}</div></div><div class="x"><a href="/a">More of it</a></div>',
        '<article><p>{0}</p><div class="entry-content">{1}</div></article><div>All rights reserved</div>',
        '<div id="page"><div class="post"><h1>{0}</h1><div class="text">{1}</div></div><div><a href="/a">One</a> <a href="/b">Two</a></div></div>',
    ],
)
def test_the_article_is_more_than_its_biggest_part(page):
    found = html_extract.blocks(f"<html><body>{page.format(LEAD, TEXT)}</body></html>")
    assert html_extract.extract(found, html_extract.best_path(found)) == f"{LEAD.strip()}\n{TEXT.strip()}"


def test_every_run_is_a_candidate(net):
    r = random.Random(6)
    key = "".join(r.choice(string.ascii_letters) for _ in range(24))
    text = f"v1.{'0a' * 20}.{key} and {key}"
    base = secret_scan.base_spans(text)
    assert [text[s:e] for s, e in secret_scan.candidates(text, base)] == ["." + key, key]
    assert key not in secret_scan.redacted_text(text, secret_scan.scan(text, net))
    assert not secret_scan.scan("Donaudampfschifffahrtsgesellschaft and state-of-the-art-technology ---------------------", net)


def test_long_runs_of_one_byte(spark):
    """Two documents of 200,000 equal bytes, and one that holds the run between other text, take seconds and few segments."""
    run = "a" * 200_000
    head, tail = "".join(chr(97 + i % 7) + str(i) for i in range(40)), "".join(chr(110 + i % 5) + str(i) for i in range(40))
    rows = [(1, run), (2, run + "a"), (3, head + run + tail), (4, "b" * 60), (5, "ab" * 100_000), (6, "ba" * 100_000)]
    assert len(suffix_dedup.anchors(np.frombuffer(run.encode(), np.uint8))[0]) == 1
    began = time.time()
    got = {x.doc_id: x for x in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert [got[i].n_removed for i in range(1, 7)] == [0, 200_001, 200_000, 0, 0, 200_000]
    assert got[3].kept_sha256 == hashlib.sha256((head + tail).encode()).hexdigest()


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content with-sidebar"><p>One.</p><p>Two.</p></div><div class="sidebar">x</div>',
        '<div class="page no-sidebar"><article><p>One.</p><p>Two.</p></article></div>',
        '<article><div class="post-header"><h1>One.</h1></div><p>Two.</p></article>',
        '<article><div class="side-by-side">One.</div><p>Two.</p></article>',
        "<article><label>One.</label><p><object>Two.</object></p></article>",
        '<article><p>One.</p><math>Two.</math><div class="share-buttons">x</div></article>',
        '<article><p>One.</p><p>Two.</p></article><div class="comments-area">Nice.</div><div class="left-sidebar">x</div>',
    ],
)
def test_classes_that_only_speak_of_noise(page):
    assert html_extract.extract(html_extract.blocks(f"<html><body>{page}</body></html>"), None).replace("\n", " ") == "One. Two."


def _site(r, host, n):
    """Pages of one template without <article> or <main>, and the text of each: on some the advert or the comments are longer than the article, on some an introduction of telling name holds nearly all."""
    say = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(k)).capitalize() + "."
    out = []
    for i in range(n):
        small = i % 5 == 4
        parts = [say(8 if small else 60) for _ in range(2 if small else 4)]
        lead = say(1200 if i % 5 < 3 else 30)
        page = f'<body><div class="top-{i}"><a href="/">Home</a></div><div class="wrap"><div class="post-{i}"><div class="promo">{lead}</div>' + "".join(f"<p>{p}</p>" for p in parts)
        page += f'</div><div class="ad">{say(80)}</div><div class="comments">{say(50)}</div></div></body>'
        out.append((f"http://{host}/{i}", page, "\n".join([lead, *parts])))
    return out


def test_hosts_settle_what_a_page_alone_gets_wrong(spark):
    """Against the planted texts: by the votes of the host every page is right, which single pages are not."""
    r = random.Random(3)
    site = _site(r, "a.example", 40) + _site(r, "b.example", 40)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(site)]
    got = {x.page_id: x for x in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kept", F.lit(1))).collect()}
    assert all(got[i].text == text and got[i].n_chars == len(text) for i, (_, _, text) in enumerate(site))
    alone = [html_extract.extract(html_extract.blocks(h), None) for _, h, _ in site]
    assert sum(a != text for a, (_, _, text) in zip(alone, site)) >= 16


def test_pages_of_the_tables_against_a_plain_reading(spark):
    """Every page of sf0.01 equals what regular expressions cut out of its <article>."""
    import html
    import re

    path = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(path)
    got = {x.page_id: x.text for x in html_extract.extract_pages(pages).collect()}
    for x in pages.collect():
        body = re.search(r"<article>(.*)</article>", x.html or "", re.S)
        plain = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", p)).split()) for p in re.split(r"</?(?:h1|p|article|ul|li|div|table|tr|td)\b[^>]*>", body[1])] if body else []
        plain = [" ".join(re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", p).split()) for p in plain]
        assert got[x.page_id] == "\n".join(p for p in plain if p), x.page_id
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "u", "<article>" + "<p>word &amp; mor</p>" * 50_000)], "page_id long, url string, html string")
    assert html_extract.extract_pages(long).first().n_chars == 50_000 * 11 - 1
