"""Main text of web pages: boosted trees judge DOM nodes, and a tree programme makes the judgements agree."""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geolattice.llm import text as tx
from geolattice.llm.boosting import Boosted, fit_boosted

#: Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: What may stand in a head; any other tag, or text of its own, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset blockquote pre figure figcaption address details summary dialog menu hr hgroup search center select button".split())
#: What an opening tag closes by itself, and where looking for it stops.
ENDS_P = BLOCK - {"html", "body", "select", "button", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div section article main nav aside header footer form body blockquote details figure".split())
#: Words in class, id and role values, by what they tell.
WORDS = [frozenset(w.split()) for w in (
    "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager toc submenu",
    "header masthead topbar banner branding logo hero",
    "footer foot bottom copyright colophon legal",
    "sidebar side aside rail widget widgets complementary secondary column",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner adsense doubleclick",
    "cookie cookies consent notice notices gdpr alert warning popup modal overlay newsletter subscribe signup paywall announcement disclaimer message",
    "comment comments reply replies discussion disqus respond reader readers thread feedback reviews",
    "form login search signin register contact input field poll survey",
    "share sharing social related recommended more popular trending tags tag meta author byline",
    "article post entry story content main body text page blog news single prose")]
TAGS = "article section main div p h1 h2 h3 ul ol li table td nav header footer aside form blockquote pre figure figcaption span a button dl".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|data-testid|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Features of a node, in groups: tag, words on it, words above it, numbers.
N_FEATURES = len(TAGS) + 2 * len(WORDS) + 16


@dataclass
class Page:
    """Nodes in page order (parents first) and the text pieces: (block run, node, text)."""
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    words: list[tuple[bool, ...] | None] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)      # characters of linked text per node
    inline: list[int] = field(default_factory=list)     # tags that are no nodes


def _told(attributes: str) -> tuple[bool, ...] | None:
    found = _ATTR.findall(attributes)
    if not found:
        return None
    words = {w for a in found for w in _SPLIT.split(_CAMEL.sub(" ", unescape("".join(a))).lower()) if w}
    return tuple(not words.isdisjoint(group) for group in WORDS)


def parse(html: str) -> Page:
    """Block elements, and any element with a class, id or role, become nodes. Missing end tags are implied; comments and what is never shown are left out."""
    page = Page()
    stack: list[tuple[str, int]] = []     # open elements and the node they are or lie in
    run, hidden = 0, 0

    def node(tag: str, parent: int, attributes: str) -> int:
        page.tag.append(tag)
        page.parent.append(parent)
        page.depth.append(0 if parent < 0 else page.depth[parent] + 1)
        page.words.append(_told(attributes) if attributes else None)
        page.marks.append(attributes)
        page.links.append(0)
        page.inline.append(0)
        return len(page.tag) - 1

    def say(raw: str) -> None:
        nonlocal hidden
        if hidden and stack[-1][0] == "head" and raw.strip():
            stack.pop()
            hidden -= 1
        if raw and not hidden:
            text = unescape(raw) if "&" in raw else raw
            at = stack[-1][1]
            page.pieces.append((run, at, text))
            if linked:
                page.links[at] += len(text)

    stack.append(("", node("body", -1, "")))
    at, linked, n = 0, 0, len(html)
    while at < n:
        m = _MARK.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, close, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    for name, _ in stack[k:]:
                        linked -= name == "a"
                        hidden -= name == "head"
                        run += name in BLOCK
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            say(" ")
            page.inline[stack[-1][1]] += 1
            continue
        closes = SAME.get(tag, ())
        if tag in ENDS_P:
            closes = (*closes, "p")
        if hidden and tag not in HEAD:
            closes = (*closes, "head")
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    for name, _ in stack[k:]:
                        linked -= name == "a"
                        hidden -= name == "head"
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in BLOCK:
            run += 1
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            stack.append((tag, stack[-1][1]))
        elif tag in BLOCK or (attributes and _ATTR.search(attributes)):
            stack.append((tag, node(tag, stack[-1][1], attributes)))
        else:
            page.inline[stack[-1][1]] += 1
            stack.append((tag, stack[-1][1]))
        linked += tag == "a"
        hidden += tag == "head"
    return page


def node_features(page: Page) -> np.ndarray:
    """A row per node: tag, attribute tokens on it and above it, depth, sibling statistics and densities of its subtree."""
    n = len(page.tag)
    own, count, stops, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for _, at, text in page.pieces:
        own[at] += len(text)
        count[at] += 1
        stops[at] += text.count(".") + text.count(",")
        words[at] += text.count(" ")
    total = np.stack([own, np.array(page.links, float), stops, words, np.array(page.inline, float), np.ones(n)], 1)
    parent = page.parent
    rows = total.tolist()
    blocks = [0] * n
    for i in range(n - 1, 0, -1):
        a, b = rows[parent[i]], rows[i]
        for j in range(6):
            a[j] += b[j]
        blocks[parent[i]] += 1
    total = np.array(rows)
    x = np.zeros((n, N_FEATURES))
    base = len(TAGS)
    above: list[tuple[bool, ...]] = [(False,) * len(WORDS)] * n
    order: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    place, alike = [0] * n, [0] * n
    for i in range(n):
        k = _TAG_AT.get(page.tag[i])
        if k is not None:
            x[i, k] = 1
        up = parent[i]
        told = page.words[i]
        if told:
            x[i, base:base + len(WORDS)] = told
        if i:
            above[i] = tuple(a or b for a, b in zip(above[up], page.words[up])) if page.words[up] else above[up]
            if True in above[i]:
                x[i, base + len(WORDS):base + 2 * len(WORDS)] = above[i]
            place[i] = order[up] = order.get(up, -1) + 1
            key = (up, page.tag[i])
            same[key] = same.get(key, 0) + 1
    for i in range(1, n):
        alike[i] = same[(parent[i], page.tag[i])]
    up = np.array([max(p, 0) for p in parent])
    size, whole = total[:, 0], max(total[0, 0], 1.0)
    siblings = np.array(blocks, float)[up]
    numbers = [np.array(page.depth, float), np.log1p(size), size / whole, total[:, 1] / np.maximum(size, 1), total[:, 2] / np.maximum(size, 1) * 100, size / total[:, 5],
               np.log1p(total[:, 5]), np.log1p(own), own / np.maximum(size, 1), size / np.maximum(size[up], 1), siblings, np.array(place, float), np.array(place) / np.maximum(siblings, 1),
               np.array(alike, float), np.log1p(total[:, 3]), np.array(blocks, float)]
    x[:, base + 2 * len(WORDS):] = np.stack(numbers, 1)
    return x


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes in which every kept node's parent is kept."""
    n = len(parent)
    keep = (-np.logaddexp(0, -odds)).tolist()
    drop = (-np.logaddexp(0, odds)).tolist()
    best = [0.0] * n     # of children when their parent is kept
    for i in range(n - 1, 0, -1):
        keep[i] += best[i]
        best[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] >= drop[i]
    return kept


def block_text(page: Page, kept: np.ndarray) -> str:
    blocks, now, held = [], None, []
    for run, at, text in [*page.pieces, (-1, 0, "")]:
        if run != now:
            line = " ".join("".join(held).split())
            if line:
                blocks.append(line)
            now, held = run, []
        if run >= 0 and kept[at]:
            held.append(text)
    return "\n\n".join(blocks)


def extract(htmls: list[str], model: Boosted) -> list[str]:
    pages = [parse(h) for h in htmls]
    sizes = np.cumsum([0, *(len(p.tag) for p in pages)])
    odds = model.log_odds(np.concatenate([node_features(p) for p in pages])) if pages else np.zeros(0)
    return [block_text(p, decode(p.parent, odds[a:b])) for p, a, b in zip(pages, sizes, sizes[1:])]


# Training pages -------------------------------------------------------------------------------------------

_SIDE = "nav", "header", "footer", "aside", "form"


def weak_labels(page: Page) -> np.ndarray:
    """Marks by what a page says about itself: a node is main text unless it or a node above is named otherwise (by its tag or its words)."""
    good = np.ones(len(page.tag), bool)
    for i in range(1, len(page.tag)):
        told = page.words[i]
        named = page.tag[i] in _SIDE or bool(told and any(told[:9]) and not told[9]) or "data-side" in page.marks[i]
        good[i] = good[page.parent[i]] and not named
    return good


def _drawn(rng: random.Random, lines: list[str], other: list[str]) -> str:
    """A page around the given lines with marked side matter; names, wrappers and order vary. Side matter carries the attribute data-side, which features never see."""
    pick = rng.choice
    some = lambda k: [pick(other) for _ in range(k)]
    short = lambda: " ".join(pick(other).split()[:rng.randint(1, 4)])
    mark = lambda tag, names: f'<{tag} data-side {pick(("class", "id"))}="{pick(names)}">' if rng.random() < 0.9 or tag in ("div", "section", "ul", "p") else f"<{tag} data-side>"

    def box(tags: tuple[str, ...], names: tuple[str, ...], body: str) -> str:
        tag = pick(tags)
        return f"{mark(tag, names)}{body}</{tag}>"

    menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{escape(short())}</a></li>' for i in range(rng.randint(2, 9))) + "</ul>"
    said = lambda k: "".join(f"<p>{escape(x)}</p>" for x in some(k))
    top = [box(("nav", "div", "ul"), ("menu", "navbar", "main-nav", "breadcrumbs"), menu()), box(("header", "div"), ("header", "site-header", "masthead", "top-banner"), f"<h2>{escape(short())}</h2>" + pick(("", menu())))]
    notes = [box(("div", "aside", "section"), ("cookie-notice", "notice", "alert", "newsletter", "consent-banner"), pick((said(1), escape(pick(other))))),
             box(("div", "aside", "ins", "section"), ("ad", "ads", "advert", "sponsored", "promo"), pick((said(1), escape(pick(other)))))]
    side = [box(("aside", "div"), ("sidebar", "widget", "right-rail", "related"), f"<h3>{escape(short())}</h3>" + pick((menu(), said(2))))]
    low = [box(("div", "section", "ol"), ("comments", "comment-list", "replies", "reader-comments"), "".join(f'<div class="comment"><b>{escape(short())}</b>{said(1)}</div>' for _ in range(rng.randint(1, 5)))),
           box(("form", "div"), ("search-form", "login", "contact-form", "subscribe"), f"<label>{escape(short())}</label><input><button>{escape(short())}</button>"),
           box(("footer", "div"), ("footer", "site-footer", "copyright"), pick(("&copy; ", "")) + escape(pick(other)))]
    body = [f"<h1>{escape(lines[0][:60])}</h1>"] if rng.random() < 0.8 else []
    for x in lines:
        y = escape(x)
        body.append(pick((f"<p>{y}</p>", f"<p>{y}</p>", f"<p>{y}", f"<p><b>{y}<br>", f"<blockquote>{y}</blockquote>", f"<h2>{y[:50]}</h2>", f"<ul><li>{y}</li><li>{y[:30]}</li></ul>", f"<div>{y}</div>", f'<p class="lead">{y}</p>', f"<p>{y[:40]}<a href='/x'>{y[40:60]}</a>{y[60:]}</p>")))
        if rng.random() < 0.08:
            body.append(pick((notes[1], box(("div", "ul"), ("share", "social-links", "tags"), menu()))))
    inner = "".join(body)
    whole = pick((f"<article>{inner}</article>", f'<article class="post">{inner}</article>', f"<main>{inner}</main>", f'<div class="{pick(("content", "entry-content", "post-body", "story", "article"))}">{inner}</div>', f'<div id="main"><div class="text">{inner}</div></div>', f"<div>{inner}</div>", f"<section>{inner}</section>", f"<main><article>{inner}</article></main>"))
    parts = [x for x in (*top, *notes) if rng.random() < 0.6] + [whole] + [x for x in (*side, *low) if rng.random() < 0.6]
    text = "".join(parts) if rng.random() < 0.5 else "<div>" + "".join(parts[:-1]) + "</div>" + parts[-1]
    return f"<html><head><title>{escape(short())}</title></head><body>{text}</body></html>"


def train(htmls: list[str], seed: int = 3, drawn: int = 4, rounds: int = 80) -> Boosted:
    """Trees fitted on the pages as they mark themselves, and on `drawn` pages each, set anew from their lines with side matter of many names. Equal input gives equal trees."""
    rng = random.Random(seed)
    pages = [parse(h) for h in htmls]
    texts = [t for t in (block_text(p, weak_labels(p)).split("\n\n") for p in pages) if t != [""]]
    other = [x for t in texts for x in t] or ["Some words of a page, as good as any."]
    made = [parse(_drawn(rng, t if k % 2 else t[:rng.randint(1, 3)], other)) for t in texts or [other] for k in range(drawn)]   # every other one short
    rows = [*pages, *made]
    return fit_boosted(np.concatenate([node_features(p) for p in rows]), np.concatenate([weak_labels(p) for p in rows]).astype(float), rounds)


def main_text(pages: DataFrame, sample: int = 256, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text.

    Boosted trees give every DOM node the odds of belonging to the article; a tree programme then takes the likeliest choice in which no node is
    kept below a dropped one. Blocks are joined in page order by an empty line, references decoded, white space inside a block made one space.

    The trees are fitted on the driver from at most `sample` pages, those with the least hash of their html; nothing else is sampled.

    Defined cases: null or empty html gives an empty text; text outside any element is main text; unclosed elements end where HTML ends them;
    repeated rows give equal texts; an empty table trains on nothing and gives an empty table; other columns are ignored. One pass, no shuffle.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hashed = rows.where("html <> ''").select("html", F.xxhash64("html").alias("h"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]   # the bound of the fit: numbers only, of different pages
    drawn = sorted(hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html")).collect(), key=lambda r: r.h) if least else []   # one page each
    shared = pages.sparkSession.sparkContext.broadcast(train([r.html for r in drawn]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "html"):
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(extract(tx.column(b, "html"), shared.value), pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
