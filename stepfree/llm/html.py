"""Main text of web pages: flat text blocks judged by a decision tree.

A page becomes a flat list of blocks, cut at block-level tags. A block is described by its
word count and link density, those of the block before and after, those of all blocks that
stand in the same container, and by what it stands in: elements that name page furniture
(navigation, forms, adverts, notices, comments) or an article. A decision tree, trained on
the small labelled table of LABELLED_PAGES, keeps or drops it; kept blocks are joined in page
order. The tree prefers words and links: a split by a name counts NAME_WEIGHT of its gain, so
names decide what counts can't (a comment is prose, too). Names of DOUBTFUL_NAMES inside an
article are no furniture by themselves; there the tree looks at the links.

Defined cases: null html counts as empty; a page without kept blocks has empty text;
scripts, styles, comments and the head are never text (the head ends where a tag stands that may
not be in one); elements of HIDDEN_ELEMENTS are no text up to their end tag, and hide nothing
where they have none; ``<br>`` is white space; unclosed elements end where an enclosing element ends; white space is what Python's ``str.split``
takes for it; pages of any length are taken whole; equal rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
LETTERS = re.compile(r"[a-z]+")

#: Elements whose content is no text.
HIDDEN_ELEMENTS = frozenset("noscript template svg iframe object select title".split())
#: Tags that may stand in a head; any other one ends it.
HEAD_TAGS = frozenset("head title meta link base basefont bgsound noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that cut the text into blocks.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold page furniture, whatever they are called.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset label option".split())
#: Words in a class, id or role that name page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login register search sidebar widget widgets menu nav navbar navigation breadcrumb "
    "breadcrumbs topbar toolbar masthead footer copyright contentinfo complementary comment comments commentlist disqus reply replies respond "
    "discussion share sharing social related recommended pagination pager dialog form toc skip".split()
)
#: Of these, names that inside an article may as well be part of it.
DOUBTFUL_NAMES = frozenset("alert search register related recommended social discussion toc".split())
#: Elements whose blocks are counted together.
CONTAINERS = frozenset("article aside blockquote div fieldset footer form header main nav section td".split())
#: Names of page layout: beside a name of ARTICLE_NAMES they say nothing.
LAYOUT_NAMES = frozenset("sidebar nav navbar menu footer banner widget".split())
ARTICLE_NAMES = frozenset("article post entry content story main body text".split())
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "words_beside", "links_beside", "heading",
    "furniture", "article", "doubtful", "article_on_page",
)
#: The first of the features that come from names.
FIRST_NAME = FEATURES.index("furniture")
#: What a split by a name counts beside one by words and links.
NAME_WEIGHT = 0.5
#: Rows that a split by words or links leaves on either side at least.
LEAST_ROWS = 12


@dataclass
class Block:
    text: str
    links: float
    furniture: bool
    article: bool
    heading: bool
    doubtful: bool = False
    container: int = 0
    keep: str | None = None


@lru_cache(maxsize=20_000)
def element_kind(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool]:
    """(page furniture, article, doubtful) of an element by its name and attributes."""
    if HIDDEN.search(attrs):
        return True, False, False
    names = {w for m in NAMED.finditer(attrs) for w in LETTERS.findall((m[2] or m[3] or m[4] or "").lower())}
    article = tag in ("article", "main") or bool(names & ARTICLE_NAMES)
    if tag in ("html", "body"):
        return False, False, False
    if tag in ("article", "main"):
        return False, True, False
    found = names & FURNITURE_NAMES
    if article and found <= LAYOUT_NAMES:
        found = frozenset()
    header = not in_article and (tag == "header" or ("header" in names and not article))
    doubtful = in_article and bool(found) and found <= DOUBTFUL_NAMES
    furniture = tag in FURNITURE or header or (bool(found) and not doubtful)
    return furniture, article and not furniture, doubtful and not furniture


def hidden_ends(tokens: list[re.Match]) -> dict[int, int]:
    """Start tag of a hidden element or head -> the last token that belongs to it; start tags without an end are left out."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag in HIDDEN_ELEMENTS:
            if m["end"]:
                if open_.get(tag):
                    ends[open_[tag].pop()] = k
            elif not m["attrs"].rstrip().endswith("/"):
                open_.setdefault(tag, []).append(k)
    k = 0
    while k < len(tokens):
        if (tokens[k]["tag"] or "").lower() == "head" and not tokens[k]["end"]:
            last = at = k
            while at + 1 < len(tokens):
                m = tokens[at + 1]
                tag = (m["tag"] or "").lower()
                if tag and tag not in HEAD_TAGS:
                    break
                at = ends.get(at + 1, at + 1)
                last = at
                if tag == "head" and m["end"]:
                    break
            ends[k] = last
            k = last
        k += 1
    return ends


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    # open elements: tag, furniture so far, article so far, doubtful so far, container, label of the training table
    stack: list[tuple[str, bool, bool, bool, int, str | None]] = []
    parts: list[str] = []
    linked, in_link, heading, containers = 0, 0, False, 0
    page = ("", False, False, False, 0, None)

    def close() -> None:
        nonlocal linked, heading
        text = " ".join(unescape("".join(parts)).split())
        if text:
            _, furniture, article, doubtful, container, keep = stack[-1] if stack else page
            out.append(Block(text, min(1.0, linked / len(text)), furniture, article, heading, doubtful, container, keep))
        parts.clear()
        linked = 0

    tokens = list(MARKUP.finditer(html))
    ends = hidden_ends(tokens)
    at, last = 0, -1
    for k_token, m in enumerate(tokens):
        if k_token <= last:
            continue
        if m.start() > at:
            raw = html[at : m.start()]
            parts.append(raw)
            if in_link:
                linked += len(" ".join(raw.split()))
        at = m.end()
        if k_token in ends:
            last = ends[k_token]
            at = tokens[last].end()
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag in BLOCK:
                close()
            else:
                parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            if tag in BLOCK:
                heading = any(x[0] in HEADINGS for x in stack[-3:])
                in_link = sum(x[0] == "a" for x in stack)
            elif tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag in ("p", "li", "td", "tr", "dd", "dt", "option") or tag in HEADINGS:
            closes = ("li", "p") if tag == "li" else ("td", "th", "p") if tag == "td" else (tag, "p")
            while stack and (stack[-1][0] in closes or stack[-1][0] not in BLOCK):
                stack.pop()
            in_link = 0
        if m["attrs"].rstrip().endswith("/"):
            continue
        _, furniture, article, doubtful, container, keep = stack[-1] if stack else page
        own_furniture, own_article, own_doubtful = element_kind(tag, m["attrs"], article)
        if tag in CONTAINERS:
            containers += 1
            container = containers
        if 'data-keep="' in m["attrs"]:
            keep = m["attrs"].split('data-keep="')[1][0]
        stack.append((tag, furniture or own_furniture, article or own_article, doubtful or own_doubtful, container, keep))
        heading = tag in HEADINGS or (heading and tag not in BLOCK)
        in_link += tag == "a"
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; beyond the page's ends there are no words and no links."""
    words = np.array([0, *[b.text.count(" ") + 1 for b in blocks], 0], float)
    links = np.array([0, *[b.links for b in blocks], 0], float)
    _, at = np.unique([b.container for b in blocks], return_inverse=True)
    beside = np.bincount(at, words[1:-1])
    linked = np.bincount(at, words[1:-1] * links[1:-1]) / np.maximum(beside, 1)
    flags = np.array([[b.heading, b.furniture, b.article, b.doubtful] for b in blocks], float).reshape(-1, 4)
    on_page = np.full(len(blocks), float(any(b.article and not b.furniture for b in blocks)))
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], beside[at], linked[at], flags, on_page])


class DecisionTree:
    """Binary splits that lower the Gini impurity most (splits by names count less); a leaf keeps when most of its training rows do."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8) -> None:
        self.feature, self.cut, self.low, self.high, self.value = -1, 0.0, None, None, bool(y.mean() > 0.5)
        if depth == 0 or y.min() == y.max():
            return
        before = 2 * y.mean() * (1 - y.mean())
        best = (1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            seen = np.unique(x[:, f])
            for cut in (seen[1:] + seen[:-1]) / 2:
                side = x[:, f] <= cut
                if f < FIRST_NAME and min(side.sum(), (~side).sum()) < LEAST_ROWS:
                    continue
                share = side.mean()
                a, b = y[side].mean(), y[~side].mean()
                impurity = share * 2 * a * (1 - a) + (1 - share) * 2 * b * (1 - b)
                gain = (before - impurity) * (NAME_WEIGHT if f >= FIRST_NAME else 1.0)
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(cut))
        if best[1] >= 0:
            self.feature, self.cut = best[1], best[2]
            side = x[:, self.feature] <= self.cut
            self.low, self.high = DecisionTree(x[side], y[side], depth - 1), DecisionTree(x[~side], y[~side], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        side = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[side], out[~side] = self.low.predict(x[side]), self.high.predict(x[~side])
        return out


_LONG = "The bridge was closed for nine days while masons replaced the worn steps, and walkers were sent along the river path instead of over the hill."
_MID = "Nobody had expected the work to end before the first frost came."


def _cut(n: int) -> str:
    return " ".join(_LONG.split()[:n])


#: The labelled table: small pages in which data-keep marks what is main text (1) and what isn't (0).
LABELLED_PAGES = (
    f'<nav data-keep="0"><a href="/">Home</a><ul><li><a href="/a">News</a><li><a href="/b">Maps</a></ul></nav><article data-keep="1"><h1>Bridge closed</h1><p>{_LONG}<p>So.</p><p>{_MID}</p><ul><li>Steps</li><li>Rails</li></ul></article><footer data-keep="0">All rights reserved 2020</footer>',
    f'<header data-keep="0"><h1>The Daily Path</h1><p>{_MID}</p></header><article data-keep="1"><p>Yes.</p><p>{_LONG} {_LONG}</p><div class="ad" data-keep="0">{_MID} {_LONG}</div><p>Later.</p></article><aside data-keep="0"><p>{_LONG}</p><p>More</p></aside>',
    f'<main data-keep="1"><h2>Ways</h2><p>{_MID}</p><p><a href="/x">All ways</a></p><p>{_LONG}</p><section class="comments" data-keep="0"><p>{_LONG}</p><p>First!</p><p>{_MID}</p></section></main>',
    f'<div class="cookie-notice" data-keep="0"><p>{_LONG}</p><button>Accept</button></div><div class="entry-content" data-keep="1"><p>{_LONG}</p><p>End</p></div><form data-keep="0"><label>Name</label><p>{_MID}</p></form>',
    f'<ul data-keep="0"><li><a href="/1">Start</a></li><li><a href="/2">About us</a></li><li><a href="/3">Contact</a></li></ul><p data-keep="1">{_LONG}</p><p data-keep="1">{_LONG} {_MID}</p><p data-keep="1">Quiet.</p><p data-keep="1">All well.</p><p data-keep="1">So it was.</p><p data-keep="1">{_LONG}</p><p data-keep="0"><a href="/4">Imprint</a></p><p data-keep="0"><a href="/5">Privacy and terms of use</a></p>',
    f'<h1 data-keep="1">A walk in May</h1><p data-keep="1">{_LONG}</p><p data-keep="1">{_MID}</p><p data-keep="1">{_LONG} {_LONG}</p><div data-keep="0"><a href="/p">Previous page</a> | <a href="/n">Next page</a></div>',
    f'<div data-keep="0"><a href="/i">Index of all the stations on this line and their lifts</a></div><div data-keep="0"><a href="/j">Another long list entry about lifts and ramps in town</a></div><p data-keep="1">{_MID}</p><p data-keep="1">{_LONG}</p>',
    f'<article data-keep="1"><p>{_MID}</p><form data-keep="0"><p>{_LONG}</p></form><p><a href="/s">The station the line and the ramp are described elsewhere on these pages</a></p></article><div id="sidebar" data-keep="0"><p>{_LONG}</p><p>Now</p></div>',
    f'<p data-keep="1">{_MID}</p>',
    f'<div data-keep="0"><a href="/u">Everything about the lifts and the ramps of this town</a></div><div data-keep="0">Page two</div><div data-keep="0"><a href="/v">Next</a></div><p data-keep="1">{_LONG}</p><p data-keep="1">{_MID}</p>',
    f'<div data-keep="0">Paths and people</div><div data-keep="0">{_LONG}</div><article data-keep="1"><p>{_MID}</p><p>{_LONG}</p><p>Oh.</p></article><div data-keep="0">Set in type by the town</div>',
    f'<div data-keep="0"><p>{_LONG}</p></div><div class="post-body" data-keep="1"><p>{_LONG}</p><p><a href="/t">Timetable</a></p><p>{_MID}</p></div><div data-keep="0"><p>{_MID}</p></div>',
    f'<p data-keep="1">{_LONG}</p><p data-keep="1">{_MID} {_LONG}</p>',
    f'<div class="ad" data-keep="0">{_MID}</div><article data-keep="1"><p>{_MID}</p></article><footer data-keep="0">{_MID} {_MID}</footer>',
    f'<article data-keep="1"><h1>Closed</h1><p class="alert">{_LONG}</p><div class="related-work"><p>{_MID}</p><p>{_LONG}</p></div><section id="search"><p>So it was.</p><p>{_MID}</p></section><p>{_LONG}</p></article>',
    f'<article data-keep="1"><p>{_LONG}</p><div class="related" data-keep="0"><ul><li><a href="/1">Ways along the river in spring</a></li><li><a href="/2">The lift is back</a></li></ul></div><div class="toc" data-keep="0"><a href="#a">One</a> <a href="#b">Two</a></div><p>No.</p></article>',
    f'<nav data-keep="0"><ul><li><a href="/a">{_MID}</a></li><li><a href="/b">Maps</a></li></ul></nav><article data-keep="1"><h1>Steps</h1>{"".join(f"<p>{t}</p>" for t in (_LONG, "Ah.", _MID, _LONG, "And so on.", _LONG + " " + _MID, _LONG))}</article><footer data-keep="0">{_MID} <a href="/t">Terms</a></footer>',
    f'<main data-keep="1"><p>Yes.</p></main><footer data-keep="0"><p>{_MID}</p></footer>',
    f'<article data-keep="1"><p>{_LONG} {_LONG}</p></article><div id="comments" data-keep="0">{"".join(f"<p>{t}</p>" for t in (_LONG, _MID, "Me too.", _LONG + " " + _LONG, _LONG))}</div>',
    f'<article data-keep="1"><h2>{_MID}</h2><p>{_LONG}</p><ol><li><a href="/m">Map</a></li><li><a href="/n">Another map of the same way</a></li></ol><p>{_MID}</p></article><div class="share" data-keep="0"><p>Tell others</p><p>{_MID}</p></div>',
    f'<nav data-keep="0"><a href="/a">Home</a></nav>{"".join(f"<div data-keep=\"1\">{t}</div>" for t in (_MID, _LONG, _MID, _LONG + " " + _MID, "Only then.", _MID))}<div data-keep="0"><a href="/t">Terms of use and privacy</a></div>',
    f'<div data-keep="1"><p>{_MID}</p><p>Ah.</p></div><div data-keep="1"><p>{_LONG}</p></div><div data-keep="1"><p>Once more.</p><p>{_MID}</p></div>',
    f'<article data-keep="1"><p>{_LONG} {_LONG}</p><p><a href="/w">All the ways</a></p><p>{_LONG} {_MID}</p><ul><li><a href="/l">Lifts and where they stand in this town</a></li><li><a href="/r">Ramps</a></li></ul><p>{_LONG}</p></article>',
    f'<div data-keep="0">{"".join(f"<p><a href='/{k}'>{_MID}</a></p>" for k in range(9))}</div><article data-keep="1"><p>{_LONG}</p><p>{_LONG} {_LONG} {_LONG}</p><p><a href="/s">Source</a></p></article>',
    f'<article data-keep="1"><p>{_LONG} {_LONG} {_LONG}</p><div class="related" data-keep="0">{"".join(f"<p><a href='/{k}'>{_MID}</a></p>" for k in range(9))}</div></article>',
    # prose outside the article
    *(
        f'<div data-keep="0"><p>{_LONG} {a}</p><p>{_LONG}</p></div><article data-keep="1"><h1>{b}</h1><p>{_LONG}</p><p>{b} {_MID}</p></article><div data-keep="0"><p>{a}</p><p>{_LONG} {_LONG}</p><p>{b}</p></div>'
        for a, b in ((_MID, "Open again"), ("Hm.", _MID), (_LONG, "Gate"))
    ),
    # articles of a few words between furniture of as many
    *(
        f'<nav data-keep="0"><ul><li><a href="/a">{_cut(2)}</a></li><li><a href="/b">Maps</a></li></ul></nav><div class="ad" data-keep="0">{_cut(20 - n)}</div>'
        f'<article data-keep="1"><h1>{_cut(n)}</h1><p>{_cut(m)}</p></article><footer data-keep="0">{_cut(n + 9)}</footer>'
        for n, m in ((1, 1), (2, 5), (3, 3), (5, 14), (8, 2), (11, 22), (4, 7))
    ),
    *(f'<main data-keep="1"><p>{_cut(n)}</p></main><div data-keep="0"><p>{_cut(m)}</p></div>' for n, m in ((2, 9), (6, 3), (9, 14), (14, 6))),
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED_PAGES."""
    x, y = [], []
    for page in LABELLED_PAGES:
        blocks = blocks_of(page)
        x.append(block_features(blocks))
        y.append(np.array([b.keep == "1" for b in blocks], float))
    return np.concatenate(x), np.concatenate(y)


def main_text(html: str | None, tree: DecisionTree) -> str:
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, tree.predict(block_features(blocks)), strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(DecisionTree(*labelled_table()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, held.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"{kinds}, text string, n_chars long")


def op4_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
