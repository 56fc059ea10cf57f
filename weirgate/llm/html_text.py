"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A forgiving parser builds the nodes of a page: block elements, elements with a class, id or role, and runs of bare text
between them. Each node gets features of its subtree (text and link density, paragraphs), its attributes' tokens, depth,
place among its siblings, and what its ancestors and descendants are. Boosted trees, trained on pages that a generator
lays out in many ways, give each node the log-odds that its subtree holds main text. Decoding maximises the sum over
kept nodes, where a node can be kept only with its parent: a dropped ancestor has no kept descendant.

Defined results: null, empty and text-free html give an empty text. Scripts, styles, templates, comments and the head are
never text. Unclosed and stray tags are closed as browsers do in the common cases; html cut off in a tag or a character
reference gives the text up to there. `<br>` is white space inside its block. A `<header>` counts as a header wherever it stands,
so a title and byline in an article's own `<header>` are not main text. Repeated rows give repeated results; other
columns are ignored. Pages are read whole, and no part of the work recurses on depth.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import map_column, spread

# Element names by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea".split())
#: What may stand in a head; any other start tag, or text, ends it.
IN_HEAD = frozenset("head html title meta link base basefont bgsound script style noscript noframes template".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "legend", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What a start tag closes, and what stops the search for it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
EDGE_TAGS = frozenset("nav header footer aside menu form dialog fieldset select search button".split())
MAIN_TAGS = frozenset(("article", "main"))
EDGE_TOKENS = frozenset("ad ads adv advert adverts advertisement advertising alert author-bio banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination paywall popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar warning widget widgets".split())
MAIN_TOKENS = frozenset("article articlebody body content entry main post prose story text".split())

_TOKEN = re.compile(r"[a-z0-9]+")
_STOP = re.compile(r"[.!?…。]")


class Page:
    """Nodes in page order. A node is (parent, tag); texts hang on nodes, cut into blocks by number."""

    def __init__(self) -> None:
        self.parent, self.tag, self.tokens = [-1], ["#page"], [frozenset()]
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self.links: list[int] = [0]  # characters inside links


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int]] = []  # tag, its node
        self.places: dict[str, list[int]] = {}  # places of each tag among the open elements, so that no search walks over them
        self.blocks_open: list[int] = []  # places of open block elements
        self.block = self.skip = self.anchors = self.heads = 0
        self.bare = -1  # node of the present run of bare text

    @property
    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _new(self, parent: int, tag: str, tokens: frozenset) -> int:
        p = self.page
        p.parent.append(parent)
        p.tag.append(tag)
        p.tokens.append(tokens)
        p.links.append(0)
        return len(p.tag) - 1

    def _close(self, k: int) -> None:
        """Ends the elements from k on."""
        for tag, _ in self.open[k:]:
            if tag in SKIPPED:
                self.skip -= 1
                self.heads -= tag == "head"
            elif tag == "a":
                self.anchors -= 1
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks_open.pop()
                self.block += 1
                self.bare = -1
        before = self.node
        del self.open[k:]
        if self.node != before:
            self.bare = -1

    def _last(self, tags) -> int:
        """Place of the innermost open element with one of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _close_to(self, tags: set[str], stops: set[str]) -> None:
        k = self._last(tags)
        if k > self._last(stops):
            self._close(k)

    def _end_head(self) -> None:
        """Ends a head without an end tag, if nothing else is skipped inside it."""
        if self.heads and self.skip == self.heads:
            self._close(self.places["head"][0])

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if self.skip and tag not in SKIPPED:
            return
        if tag in CLOSES_P:
            self._close_to({"p"}, {"article", "aside", "blockquote", "body", "div", "li", "section", "td", "th", "main", "button"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        if tag == "hr":
            self.block += 1
        if tag == "br":
            self._put(" ")
        if tag in VOID:
            return
        words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label")).lower()
        node = self.node
        if tag in BLOCKS or words:
            node = self._new(node, tag, frozenset(_TOKEN.findall(words)) | frozenset(words.split()))
            self.bare = -1
        if tag in BLOCKS:
            self.block += 1
        if tag in SKIPPED:
            self.skip += 1
            self.heads += tag == "head"
        elif tag == "a":
            self.anchors += 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks_open.append(len(self.open))
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        k = self._last((tag,))
        inline = tag not in BLOCKS and tag not in SKIPPED
        if inline and self.blocks_open and self.blocks_open[-1] > k:
            return
        if k >= 0:
            self._close(k)
            return
        if tag == "p":
            self.block += 1

    def handle_data(self, data: str) -> None:
        if self.skip and data.strip():
            self._end_head()
        if not self.skip:
            self._put(data)

    def _put(self, data: str) -> None:
        if self.bare < 0:
            if not data.strip():
                if self.page.texts:
                    self.page.texts.append((-1, self.block, " "))
                return
            self.bare = self._new(self.node, "#text", frozenset())
        self.page.texts.append((self.bare, self.block, data))
        if self.anchors:
            self.page.links[self.bare] += len(data)


def parse(html: str | None) -> Page:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.page


FEATURES = ("depth", "edge_tag", "main_tag", "edge_tokens", "main_tokens", "edge_above", "main_above", "main_below", "chars", "share", "link_share", "density", "paragraphs", "items", "stops", "siblings", "place", "heading", "is_text", "is_item", "is_form", "edge_beside")
_NAMES = {n: i for i, n in enumerate(FEATURES)}


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent = page.parent
    chars, stops, own_links = [0] * n, [0] * n, list(page.links)
    for node, _, text in page.texts:
        if node >= 0:
            chars[node] += len(text)
            stops[node] += len(_STOP.findall(text))
    tags, paragraphs, items, mains, kids, order = [1] * n, [int(t == "p") for t in page.tag], [int(t == "li") for t in page.tag], [0] * n, [0] * n, [0] * n
    edge_tokens = [len(t & EDGE_TOKENS) for t in page.tokens]
    edge = [int(t in EDGE_TAGS or e > 0) for t, e in zip(page.tag, edge_tokens)]
    main_tokens = [len(t & MAIN_TOKENS) for t in page.tokens]
    main = [int(t in MAIN_TAGS or "main" in k) for t, k in zip(page.tag, page.tokens)]
    edge_kids = [0] * n
    for i in range(1, n):
        order[i] = kids[parent[i]]
        kids[parent[i]] += 1
        edge_kids[parent[i]] += edge[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, stops, own_links, tags, paragraphs, items):
            a[p] += a[i]
        mains[p] += mains[i] + main[i]
    depth, edge_above, main_above = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i], edge_above[i], main_above[i] = depth[p] + 1, edge_above[p] + edge[p], main_above[p] + main[p]
    total = max(1, chars[0])
    out = np.empty((n, len(FEATURES)))
    for i in range(n):
        c, p = max(1, chars[i]), max(parent[i], 0)
        tag = page.tag[i]
        out[i] = (
            min(depth[i], 20), tag in EDGE_TAGS, main[i], edge_tokens[i], main_tokens[i], edge_above[i], main_above[i], mains[i] > 0,
            min(chars[i], 5000), chars[i] / total, own_links[i] / c, chars[i] / tags[i], paragraphs[i], items[i], 100 * stops[i] / c,
            min(kids[p], 50), order[i] / max(1, kids[p]), tag[0] == "h" and tag[1:].isdigit(), tag == "#text", tag == "li", tag in ("form", "fieldset", "select", "button"), edge_kids[p] / max(1, kids[p]),
        )
    return out


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The best set of kept nodes in which every kept node's parent is kept; a subtree is worth nothing if dropped.

    A node's own log-odds count once; text-free nodes count little, so that wrappers follow what they hold.
    """
    n = len(page.tag)
    weight = [0.02] * n
    for node, _, text in page.texts:
        if node >= 0:
            weight[node] = 1.0
    best = [0.0] * n
    for i in range(n - 1, 0, -1):
        best[i] += max(-8.0, min(8.0, margin[i])) * (weight[i] if margin[i] > 0 else 1.0)
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and best[i] > 0
    return keep


def render(page: Page, keep: list[bool]) -> str:
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if node < 0:
            if block in blocks:
                blocks[block].append(text)
        elif keep[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


# ---- training pages


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page laid out at random, and the marks (first words) of its main texts. Every text starts with a mark of its own."""
    main: set[str] = set()
    count = iter(range(10**6))

    def words(lo: int, hi: int, keep: bool, stop: bool = True) -> str:
        mark = f"m{next(count)}x"
        if keep:
            main.add(mark)
        out = [mark] + ["".join(rng.choice("aeioulrnstdmpc") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))]
        return " ".join(w + ("." if stop and rng.random() < 0.1 else "") for w in out) + ("." if stop else "")

    def attr(tokens: list[str]) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(tokens, 1))}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(0, 2, False, False)}</a></li>' for _ in range(n)) + "</ul>"

    edge_names = sorted(EDGE_TOKENS)

    def edge() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return f"<nav>{links(rng.randint(2, 9))}</nav>"
        if kind == 1:
            return f"<header>{words(1, 8, False, False)}{links(rng.randint(0, 4))}</header>"
        if kind == 2:
            return f"<footer>{'<p>' * rng.randint(0, 1)}&copy; {words(2, 25, False)}</footer>"
        if kind == 3:
            return f"<aside>{'<h3>' + words(1, 3, False, False) + '</h3>' if rng.random() < 0.5 else ''}<p>{words(3, 60, False)}</p></aside>"
        if kind == 4:
            return f"<form><label>{words(1, 4, False, False)}</label><input><p>{words(1, 20, False)}</p><button>{words(0, 1, False, False)}</button></form>"
        tag = rng.choice(["div", "div", "section", "p", "ul", "span"])
        inner = words(2, 60, False)
        if tag == "ul":
            inner = "".join(f"<li>{words(1, 20, False)}</li>" for _ in range(rng.randint(1, 5)))
        elif tag != "p" and tag != "span" and rng.random() < 0.5:
            inner = "".join(f"<p>{words(2, 50, False)}</p>" for _ in range(rng.randint(1, 5)))
        return f"<{tag}{attr(edge_names)}>{inner}</{tag}>"

    def block() -> str:
        kind = rng.randrange(14)
        if kind == 0:
            return f"<h2>{words(1, 8, True, False)}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{words(1, 20, True)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{words(3, 40, True)}</p></blockquote>"
        if kind == 3:
            return f"<p>{words(3, 30, True)} <a href='#'>word word</a> more.</p>"
        if kind == 4:
            return f"<table><tr><td>{words(0, 3, True, False)}</td><td>{words(0, 3, True, False)}</td></tr></table>"
        if kind == 5:
            return f"<p><b>{words(3, 50, True)}<br>"
        if kind == 6:
            return f"<p>{words(0, 1, True, False)}</p>"
        if kind == 7:
            return f"<pre>{words(3, 30, True, False)}</pre>"
        if kind == 8:
            return f"<div>{words(5, 50, True)}</div>"
        return f"<p>{words(2, 90, True)}</p>"

    body = [block() for _ in range(rng.choice([1, 2, 3, 5, 8, 15]))]
    if rng.random() < 0.4:
        body.insert(rng.randrange(len(body) + 1), edge())
    title = f"<h1>{words(1, 9, True, False)}</h1>" if rng.random() < 0.8 else ""
    inside = title + "".join(body)
    kind = rng.randrange(6)
    if kind <= 2:
        inside = f"<article>{inside}</article>"
    elif kind == 3:
        inside = f"<main>{'<article>' if rng.random() < 0.5 else '<div>'}{inside}</main>"
    elif kind == 4:
        inside = f'<div{attr(sorted(MAIN_TOKENS))}>{inside}</div>'
    else:
        inside = f"<div><div>{inside}</div></div>"
    before, after = [edge() for _ in range(rng.randint(0, 4))], [edge() for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.3:
        after.append("<section class='comments'><h3>" + words(0, 2, False, False) + "</h3>" + "".join(f"<div class='comment'><p>{words(3, 60, False)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>")
    page = "".join(before) + inside + "".join(after)
    if rng.random() < 0.5:
        page = f'<div{attr(["wrapper", "container", "page", "site", "layout"])}>{page}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{page}</body></html>", main


#: Pages that the trees are trained on.
TRAINING_PAGES = 500


@lru_cache(2)
def model(pages: int = TRAINING_PAGES, seed: int = 11) -> boosting.Trees:
    """A node is to be kept if its subtree holds main text."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        html, main = training_page(rng)
        page = parse(html)
        label = [0] * len(page.tag)
        for node, _, text in page.texts:
            if node >= 0 and any(w in main for w in text.split()[:2]):
                label[node] = 1
        for i in range(len(label) - 1, 0, -1):
            label[page.parent[i]] |= label[i]
        x.append(features(page)[1:])
        y += label[1:]
    return boosting.train(np.concatenate(x), np.array(y), rounds=60, depth=4)


def extract(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    parsed = [parse(x) for x in pages]
    if not parsed:
        return []
    tables = [features(p) for p in parsed]
    margin = trees.margin(np.concatenate(tables))
    out, at = [], 0
    for page, table in zip(parsed, tables):
        out.append(render(page, decode(page, margin[at : at + len(table)])))
        at += len(table)
    return out


def extract_text(df: DataFrame, id_col="page_id", html_col="html", keep=(), trees: boosting.Trees | None = None) -> DataFrame:
    """page_id, the columns in keep, and the main text of each page."""
    shared = df.sparkSession.sparkContext.broadcast(trees or model())  # as large as its trees

    def make():
        return lambda pages: {"text": extract(pages, shared.value)}

    return map_column(df, [F.col(id_col).cast("bigint").alias("page_id"), *keep], F.col(html_col).cast("string"), make, pa.schema([("text", pa.string())]))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return extract_text(pages, keep=[F.col("url")]).withColumn("n_chars", F.length("text").cast("bigint"))
