"""Main text of web pages by the consensus of their host.

First every page scores its containers by the text that lies in them (less what
is link text, more for telling tags and classes) and names the best one by its
path of tags and classes, with digits made general: from the best container to
the outermost one around it that adds text without noise (all of an <article>;
else prose, and headings before it). It also votes for or against every element
whose class or id sounds like noise: against, unless it holds a <main>, the
page's largest <article> or, on a page with neither, most of the text (comments
excepted). Spark counts the votes per
host and path. Then every page is extracted from the containers on its host's
winning path, without the elements that most of the host's pages with such a path
vote against; a page that has no container on the winning path, or no text
there, falls back to its own best one. So neither a word in a class nor one
page's odd proportions decide alone.

What HTML itself says is no main text is left out wherever it stands: <nav>,
<aside>, <footer>, forms and their parts, <dialog>, <menu>, a <header> outside of
an article, the same as roles, hidden elements, scripts, styles and comments of
the markup. Blocks are what block-level tags separate.

Defined cases: null html counts as empty and gives empty text; a page without
any text too; a null or odd url counts as the host ""; broken markup (missing
or crossed end tags, a page cut short) is read as far as it goes; repeated rows
vote and are extracted row by row.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, fresh, stored

TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?])[^>]*(?:>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
ATTRS = {"class", "id", "role", "hidden", "aria-hidden", "style"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never part of the main text.
OUT = {"nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "menu", "dialog", "head", "datalist"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
CONTAINERS = set("article main section div td body blockquote center".split())
#: A start tag of a kind ends open ones of these tags, inside the given scopes.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words that a class or id names noise by: its last word, or its first before a word for a part.
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion promos banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars side aside widget widgets footer footnav masthead topbar toolbar header share sharing social related recommended recommendations "
    "comment comments commentlist respond replies disqus login search pagination pager tags tagcloud skip copyright disclaimer".split()
)
PART_WORDS = set("area bar bars block box button buttons container content footer form group header holder inner item items left link links list main outer panel right row section slot title top unit widget wrap wrapper".split())
#: The share of a page's text that speaks for an element whatever it is called.
MOST = 2 / 3
#: Before such a word, the class speaks of what the element goes with.
WITHOUT = {"with", "no", "has", "without", "not", "is", "by"}
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment-list|respond|replies|disqus)(?:$|[\s_\d-])", re.I)
GOOD = re.compile(r"article|content|main|post|entry|story|body|text", re.I)
SENTENCE = re.compile(r"[.!?\u2026][\"'\u201d\u2019\u00bb)]*\Z")
SEPARATOR = "\n"


class _Element:
    __slots__ = ("tag", "path", "chain", "out", "link", "named", "articles")

    def __init__(self, tag: str, path: str, chain: tuple, out: bool, link: bool, named: tuple = (), articles: tuple = ()):
        self.tag, self.path, self.chain, self.out, self.link = tag, path, chain, out, link
        self.named, self.articles = named, articles  # numbers of the elements around it that are noise by name, and of the articles


def sounds_like_noise(names: str) -> bool:
    """Whether one of the classes (or the id) is a word for noise, ends in one (left-sidebar), or begins with one before a word for a part (comments-area, ad-3)."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words or WITHOUT.intersection(words[:-1]):
            continue
        if words[-1] in NOISE_WORDS or words[0] in NOISE_WORDS and all(w in PART_WORDS for w in words[1:]):
            return True
    return False


class Page:
    """A page's blocks outside what HTML marks as no main text: text, paths of the containers around it, characters of link text; and, for each, the elements around it that sound like noise."""

    def __init__(self, found: list, around: dict[int, tuple], named: dict[int, tuple[str, str]], mains: list[tuple]):
        self.all = [block for block, _, _ in found]
        self.inside = [inside for _, inside, _ in found]
        self.named = named  # by number: path, class and id
        size, article = dict.fromkeys(named, 0), dict.fromkeys(around, 0)
        for (text, _, _), inside, articles in found:
            for k in inside:
                size[k] += len(text)
            for k in articles:
                article[k] += len(text)
        self.spared = {k for main in mains for k in main}
        if article:
            self.spared.update(around[max(article, key=lambda k: (article[k], -k))])
        most = sum(len(x[0]) for x in self.all) * MOST
        self.large = {k for k, (_, names) in named.items() if size[k] > most and not COMMENTS.search(names)} if not article and not mains else set()

    def votes(self) -> dict[str, int]:
        """By path of an element that sounds like noise: 1 if the page is against it, -1 if for it."""
        out: dict[str, int] = {}
        for k, (path, _) in self.named.items():
            out[path] = -1 if k in self.spared or k in self.large else out.get(path, 1)
        return out

    def blocks(self, kept: set[str] | None = None) -> list[tuple[str, tuple[str, ...], int]]:
        """The blocks outside noise: elements of the paths that the host's pages are for are kept (None: those that this page is for), and what holds the page's <main> or largest <article>."""
        if kept is None:
            kept = {path for path, n in self.votes().items() if n < 0}
        out = {k for k, (path, _) in self.named.items() if k not in self.spared and path not in kept}
        return [block for block, inside in zip(self.all, self.inside, strict=True) if not out.intersection(inside)]


def _name(tag: str, classes: str) -> str:
    kinds = sorted({re.sub(r"\d+", "#", c) for c in classes.lower().split()})
    return ".".join([tag, *kinds])


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """The blocks of a page outside its noise, by the page alone: text, paths of the containers around it (outermost first), characters of link text."""
    return read(page).blocks()


def read(page: str) -> Page:
    root = _Element("", "", (), False, False)
    stack, found, buffer, linked = [root], [], [], 0
    around: dict[int, tuple] = {}  # by article: the elements around it that are noise by name
    named: dict[int, tuple[str, str]] = {}
    mains: list[tuple] = []  # the same by <main>
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                found.append(((text, stack[-1].chain, linked), stack[-1].named, stack[-1].articles))
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if not top.out and text:
            buffer.append(text)
            if top.link:
                linked += len(text.strip())

    def close(k: int) -> None:
        """Ends the open elements from place k on."""
        if any(x.tag not in INLINE for x in stack[k:]):
            flush()
        del stack[k:]

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        m = TOKEN.match(page, at)
        if not m:  # a bare <
            add("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray end of an inline tag ends no block
            if tag == "p":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            if not m["attrs"].rstrip().endswith("/"):
                pos = end.end() if end else n
            if tag not in {"svg", "math"}:
                flush()
            continue
        if tag == "br" or tag in VOID and tag in INLINE:
            add(" ")
            continue
        if tag in VOID:
            flush()
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                if stack[k - 1].tag not in INLINE and stack[k - 1].tag != "p":
                    break
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in scope:
                        break
                    if stack[k].tag in ends:
                        del stack[k:]
                        break
        top = stack[-1]
        attrs = defaultdict(str)
        for name, *values in ATTR.findall(m["attrs"]) if m["attrs"] else ():
            if name.lower() in ATTRS:
                attrs[name.lower()] += "".join(values) or "yes"
        path, chain, noise, articles = top.path, top.chain, top.named, top.articles
        out = top.out or tag in OUT or attrs["role"].lower() in OUT_ROLES
        if tag not in INLINE:
            inside = any(x.tag in {"article", "main"} for x in stack)
            out = out or tag == "header" and not inside
            if tag not in {"html", "p"}:
                path = f"{path}>{_name(tag, attrs['class'])}"
                if tag in CONTAINERS:
                    chain = (*chain, path)
            if tag not in {"html", "body", "article", "main"}:
                names = f"{attrs['class']} {attrs['id']}"
                # Inside an article, a header is the article's own.
                if names != " " and sounds_like_noise(names if not inside else re.sub(r"(?i)header|title", "", names)) and not (tag == "header" or inside and tag in {"h1", "h2", "h3"}):
                    named[len(named)] = (path, names)
                    noise = (*noise, len(named) - 1)
        out = out or "hidden" in attrs or attrs["aria-hidden"] == "true" or "display:none" in attrs["style"].replace(" ", "").lower()
        if tag == "main" and not out:
            mains.append(noise)
        if tag == "article" and not out:
            articles = (*articles, len(around))
            around[len(around)] = noise
        stack.append(_Element(tag, path, chain, out, top.link or tag == "a", noise, articles))
    flush()
    return Page(found, around, named, mains)


def best_path(found: list[tuple[str, tuple[str, ...], int]]) -> str | None:
    """The path of the container that scores best, the outer one of equals."""
    score: dict[str, float] = defaultdict(float)
    for text, chain, linked in found:
        own = len(text) * max(0.0, 1 - linked / len(text)) + 20 * text.count(",")
        for depth, path in enumerate(reversed(chain[-3:])):  # the nearest container has all of it, those around it less
            score[path] += own * (1.0, 0.7, 0.4)[depth]
    for path in score:
        tag, _, classes = path.rpartition(">")[2].partition(".")
        score[path] *= (1.6 if tag in {"article", "main"} else 0.6 if tag == "body" else 1.0) * (1.2 if GOOD.search(classes) else 1.0)
    best = max(score, key=lambda p: (score[p], -len(p), p), default=None)
    return best and _climbed(found, best)


def _prose(text: str, linked: int) -> bool:
    return 3 * linked <= len(text) and len(text) >= 40 and bool(SENTENCE.search(text))


def _climbed(found: list[tuple[str, tuple[str, ...], int]], path: str) -> str:
    """The outermost container around path up to which only the article's own text is added."""
    chain = next(c for _, c, _ in found if path in c)
    around, result = chain[: chain.index(path)], path
    whole = [k for k, p in enumerate(around) if p.rpartition(">")[2].partition(".")[0] == "article"]
    if whole:  # noise inside an article is out already
        result, around = around[whole[0]], around[: whole[0]]
    for outer in reversed(around):
        tag = outer.rpartition(">")[2].partition(".")[0]
        first = next(k for k, b in enumerate(found) if result in b[1])
        added = [(k, b) for k, b in enumerate(found) if outer in b[1] and result not in b[1]]
        if not all(_prose(t, n) or k < first and tag != "body" and 3 * n <= len(t) for k, (t, _, n) in added):
            break
        if added:
            result = outer
    return result


def extract(found: list[tuple[str, tuple[str, ...], int]], winner: str | None) -> str:
    """The blocks inside the containers on the winning path, else on the page's own best path."""
    for path in (winner, best_path(found)):
        inside = [text for text, chain, _ in found if path is not None and path in chain]
        if inside:
            return SEPARATOR.join(inside)
    return SEPARATOR.join(text for text, _, _ in found)


def host_of(url: Column) -> Column:
    """The url's host in lower case, without user and port; "" if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def consensus(pages: DataFrame) -> DataFrame:
    """host, path and kept: the path that most of a host's pages vote for (ties: the first by name), and those paths that sound like noise but most pages are for (ties: against)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, votes = [], [], []
            for host, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                page = read(html.as_py() or "")
                best = best_path(page.blocks())
                for path, n in [*([] if best is None else [(best, 0)]), *page.votes().items()]:
                    hosts.append(host)
                    paths.append(path)
                    votes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], names=["host", "path", "vote"])

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(vote, "host string, path string, vote long")
    main = F.col("vote") == 0
    counted = votes.groupBy("host", "path", main.alias("main")).agg(F.count("*").alias("n"), F.sum("vote").alias("against"))
    winner = F.min_by(F.when(F.col("main"), F.col("path")), F.when(F.col("main"), F.struct(-F.col("n"), F.col("path"))))
    return counted.groupBy("host").agg(winner.alias("path"), F.collect_set(F.when(~F.col("main") & (F.col("against") < 0), F.col("path"))).alias("kept"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    winners = bounded(stored(consensus(pages)), BROADCAST_ROWS)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    host, path, kept = fresh(rows, "host", "path", "kept")
    rows = rows.withColumn(host, host_of(F.col("url"))).join(winners.toDF(host, path, kept), host, "left").select("page_id", "url", "html", path, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(read(h.as_py() or "").blocks(set(k.as_py() or ())), w.as_py()) for h, w, k in zip(b.column("html"), b.column(path), b.column(kept), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
