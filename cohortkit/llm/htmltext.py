"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into its block nodes (inline markup only counts towards features). A
node's features are its tag, hashed tokens of its class, id and role, what those tokens
and its ancestors' say about its purpose, text, link and markup density of its subtree,
depth, and its place among its siblings. Boosted trees give each node the probability
that it holds main text. Hierarchical decoding picks the labels of the whole tree with the
highest likelihood under the rule that a node without main text has no descendant with
it, so an ancestor and its descendants never contradict each other.

There are no labelled pages, so the trees learn from weak labels and from made layouts. Weak
labels: blocks inside an ``article`` or ``main`` element, outside elements whose tag or tokens
name another purpose. The sample is bounded (``sample_pages`` pages, lowest id hashes first):
pages of at most ``sample_chars`` characters if all those drawn have a weak label, else pages
with one of any length, of longer ones ``SAMPLE_NODES`` nodes. A sampled page also appears
rewritten (semantic tags become plain ones with typical class tokens, and side bars, notices,
forms and reader comments made of other pages' text are put in), and once more with the tags
and tokens of its marked elements hidden behind neutral ones or behind tokens of layouts. Made
layouts put the pages' own words into bodies with and without wrappers, tables, lists and
sections of random names, between menus, side bars, comments and footers; as they need no
weak label, the same trees are fitted whatever the table marks. So density, depth and
siblings must carry what names do not. Everything else reads all pages, whole, in one map.

Edge cases: a null or empty page, or one without main text, gives an empty text; missing
end tags are implied; markup that is cut off ends with the page; repeated rows and extra
columns pass through; an empty table is empty. Head, script, style and similar elements
hold no rendered text and are never read. Where the two labels of a node are equally likely
it is left out.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PAGES = 200
SAMPLE_CHARS = 100_000
SAMPLE_NODES = 500             # nodes of a longer page that are sampled
QUOTED_PAGES = 20              # pages without a label whose words are used in made layouts
MADE_PAGES = 600
TREES, DEPTH, RATE, BINS = 40, 5, 0.3, 32
ATTR_BUCKETS = 16

# Elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNRENDERED = frozenset("head script style noscript template iframe svg math canvas object textarea select option "
                       "button title audio video".split())
BLOCKS = ("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
          "blockquote pre figure figcaption nav header footer aside form fieldset address details summary hr center "
          "caption").split()
BLOCK_ID = {t: i for i, t in enumerate(BLOCKS)}
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article main body nav aside form".split())

# What class, id and role tokens (and tags) say about an element's purpose.
PURPOSES = {
    "content": "article content post entry story main text body prose blog maincontent articlebody",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs toc topbar sitemap",
    "frame": "header footer masthead banner site-header site-footer copyright colophon legal",
    "side": "aside sidebar side rail widget related recommended more trending popular tags",
    "notice": "notice cookie consent gdpr alert popup modal overlay newsletter subscribe signup paywall message",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion",
    "form": "form search login contact input",
    "comment": "comment comments reply replies disqus discussion respond reader feedback",
    "social": "share sharing social follow like likes",
}
PURPOSE_OF = {w: i for i, words in enumerate(PURPOSES.values()) for w in words.split()}
N_PURPOSES = len(PURPOSES)
CONTENT, COMMENT = 0, list(PURPOSES).index("comment")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                   r"|<([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)/?(?:>|\Z|(?=<))", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    children: list[int] = field(default_factory=list)
    own: int = 0               # characters of text directly inside
    links: int = 0             # of them inside links
    marks: int = 0             # inline tags inside
    stops: int = 0             # sentence marks inside


def attr_tokens(attrs: str) -> list[str]:
    return [w for m in NAMES.finditer(attrs) for w in WORD.findall(next(g for g in m.groups() if g is not None).lower())]


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes (parents before children) and the text blocks (node, text) in page order."""
    nodes = [Node("html", -1, 0, [])]
    blocks: list[tuple[int, str]] = []
    stack, run, link = [0], [], 0
    endless: set[str] = set()              # tags whose end was looked for in vain

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.stops += sum(map(text.count, ".!?"))
                blocks.append((stack[-1], text))

    def close(names: set[str] | frozenset, within: frozenset = SCOPE) -> None:
        """End the innermost open element of these names, if no scope lies between."""
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                del stack[i:]
                return
            if tag in within:
                return

    def text(part: str) -> None:
        if part:
            run.append(part)
            if link:
                nodes[stack[-1]].links += len(part)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if start:
            tag = start.lower()
            if tag in UNRENDERED:
                if not m.group().endswith("/>"):
                    stop = None if tag in endless else re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, at)
                    if stop is None:
                        endless.add(tag)
                    at = stop.end() if stop else (size if tag in ("script", "style", "textarea", "title") else at)
            elif tag in BLOCK_ID:
                flush()
                close({"p"})
                if tag in ENDS_ITSELF:
                    close(ENDS_ITSELF[tag], frozenset(("ul", "ol", "dl", "table")))
                link = 0
                if tag in ("html", "body"):
                    nodes[0].tokens += attr_tokens(m.group(3))
                elif tag != "hr":
                    nodes.append(Node(tag, stack[-1], len(stack), attr_tokens(m.group(3)) if m.group(3) else []))
                    nodes[stack[-1]].children.append(len(nodes) - 1)
                    stack.append(len(nodes) - 1)
            else:
                nodes[stack[-1]].marks += 1
                if tag == "br":
                    text(" ")
                elif tag == "a":
                    link = 1
        elif end:
            tag = end.lower()
            if tag in BLOCK_ID:
                flush()
                link = 0
                if tag not in ("html", "body"):
                    close({tag}, frozenset() if tag in ("article", "main", "body") else frozenset(("article", "main")))
            elif tag == "a":
                link = 0
    flush()
    return nodes, blocks


# ---------------------------------------------------------------- features
N_FEATURES = len(BLOCKS) + ATTR_BUCKETS + 2 * N_PURPOSES + 15


def purposes(node: Node) -> set[int]:
    return {PURPOSE_OF[w] for w in (node.tag, *node.tokens) if w in PURPOSE_OF}


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    own, links, marks, stops, texts, size = (np.zeros(n) for _ in range(6))
    for i, node in enumerate(nodes):
        own[i], links[i], marks[i], stops[i] = node.own, node.links, node.marks, node.stops
    for i, _ in blocks:
        texts[i] += 1
    size += 1
    for total in (own, links, marks, stops, texts, size):
        for i in range(n - 1, 0, -1):
            total[nodes[i].parent] += total[i]
    above = [set() for _ in range(n)]
    tags: list[Counter] = []           # of a node's children
    a, b = len(BLOCKS), len(BLOCKS) + ATTR_BUCKETS
    c, d = b + N_PURPOSES, b + 2 * N_PURPOSES
    for i, node in enumerate(nodes):
        x[i, BLOCK_ID.get(node.tag, 0)] = 1
        for w in node.tokens:
            x[i, a + zlib.crc32(w.encode()) % ATTR_BUCKETS] = 1
        mine = purposes(node)
        if node.parent >= 0:
            above[i] = above[node.parent] | purposes(nodes[node.parent])
        for p in mine:
            x[i, b + p] = 1
        for p in above[i]:
            x[i, c + p] = 1
        kin = nodes[node.parent].children if node.parent >= 0 else [i]
        alike = tags[node.parent][node.tag] if node.parent >= 0 else 1
        tags.append(Counter(nodes[k].tag for k in node.children))
        x[i, d:d + 6] = (node.depth, len(kin), alike / len(kin), i - kin[0], len(node.children), len(node.tokens))
    page = max(own[0], 1)
    x[:, d + 6] = np.log1p(own)
    x[:, d + 7] = own / page
    x[:, d + 8] = links / np.maximum(own, 1)
    x[:, d + 9] = marks / np.maximum(own, 1) * 100
    x[:, d + 10] = own / np.maximum(texts, 1)
    x[:, d + 11] = stops / np.maximum(own, 1) * 100
    x[:, d + 12] = own / size
    x[:, d + 13] = np.log1p(size)
    x[:, d + 14] = np.arange(n) / n
    return x


def weak_labels(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray | None:
    """1 for nodes that hold main text (themselves or below), by tags and tokens; None
    where no element marks the main text."""
    inside, barred = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if node.parent >= 0:
            inside[i], barred[i] = inside[node.parent], barred[node.parent]
        said = purposes(node)
        marked = node.tag in ("article", "main") and COMMENT not in said
        inside[i] |= marked or said == {CONTENT}
        barred[i] = (barred[i] or bool(said - {CONTENT})) and not marked
    good = np.zeros(len(nodes), bool)
    for i, _ in blocks:
        good[i] |= inside[i] and not barred[i]
    if not good.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] |= good[i]
    return good.astype(float)


# ---------------------------------------------------------------- boosted trees
@dataclass
class Trees:
    cuts: np.ndarray           # (features, BINS - 1) bin borders
    feature: np.ndarray        # (trees, inner nodes) -1: no split
    bin: np.ndarray
    value: np.ndarray          # (trees, leaves)
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = to_bins(x, self.cuts)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.bin, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                right = (f[at] >= 0) & (binned[rows, np.maximum(f[at], 0)] > b[at])
                at = 2 * at + 1 + right
            out += v[at - (2 ** DEPTH - 1)]
        return out


def to_bins(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic loss, second-order leaves, histogram splits, all trees of one depth."""
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    binned = to_bins(x, cuts)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(cuts, np.full((trees, 2 ** DEPTH - 1), -1), np.zeros((trees, 2 ** DEPTH - 1), np.int64),
                np.zeros((trees, 2 ** DEPTH)), float(np.log(share / (1 - share))))
    score = np.full(len(y), out.base)
    rows = np.arange(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-3)
            for j in range(x.shape[1]):
                cell = (at - first) * BINS + binned[:, j]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gain = gs ** 2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) \
                    - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                pick = gain[:, :-1].argmax(axis=1)
                better = gain[np.arange(width), pick] > best
                best[better] = gain[np.arange(width), pick][better]
                out.feature[t, first:first + width][better] = j
                out.bin[t, first:first + width][better] = pick[better]
            f, b = out.feature[t][at], out.bin[t][at]
            at = 2 * at + 1 + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > b))
        leaf = at - (2 ** DEPTH - 1)
        out.value[t] = RATE * np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1)
        score += out.value[t][leaf]
    return out


# ---------------------------------------------------------------- training pages
def rewritten(page: str, others: list[str], rng: np.random.Generator) -> str:
    """The page with plain tags for semantic ones and with typical other elements."""
    some = lambda purpose: str(rng.choice(list(PURPOSES.values())[list(PURPOSES).index(purpose)].split()))
    quote = lambda k: " ".join(others[int(rng.integers(len(others)))].split()[:k])                          # noqa: E731
    if rng.random() < 0.6:
        page = re.sub(r"<article[^>]*>", f'<div class="{some("content")} col">', page).replace("</article>", "</div>")
    if rng.random() < 0.5:
        page = page.replace("<nav>", f'<div id="{some("menu")}">').replace("</nav>", "</div>")
    if rng.random() < 0.5:
        page = page.replace("<footer>", f'<div class="{some("frame")}">').replace("</footer>", "</div>")
    extra = []
    for purpose, tag in (("side", "aside"), ("notice", "div"), ("form", "form"), ("comment", "section"),
                         ("advert", "div"), ("social", "div"), ("frame", "header")):
        if rng.random() < 0.5:
            k = int(rng.integers(1, 4))
            inner = "".join(f"<p>{html.escape(quote(int(rng.integers(4, 60))))}</p>" for _ in range(k))
            if purpose in ("side", "social"):
                inner = "<ul>" + "".join(f'<li><a href="#">{html.escape(quote(4))}</a></li>' for _ in range(k + 2)) + "</ul>"
            if purpose == "form":
                inner = f"<label>{html.escape(quote(3))}</label><input name=q>" + inner[:200]
            used = tag if rng.random() < 0.5 else "div"
            extra.append((purpose, f'<{used} class="{some(purpose)}">{inner}</{used}>'))
    for purpose, part in extra:
        before = purpose in ("notice", "frame", "side")
        spot = page.find("</nav>") + 6 if before and "</nav>" in page else -1
        tail = page.rfind("<footer")
        spot = spot if spot > 5 else tail if tail > 0 else len(page)
        page = page[:spot] + part + page[spot:]
    return page


PLAIN = ("div", "section", "td", "div", "blockquote", "center")
NEUTRAL = "wrap inner outer box col row left right top page container block grid cell unit area pane part zone span".split()
# Layout names that hold a page's main text as often as not.
LAYOUT = ("sidebar left", "has sidebar", "popular", "with nav", "header spacer", "search result", "tags list", "right rail",
          "featured more", "form page", "no comments", "top banner")


def neutral_tokens(rng: np.random.Generator) -> list[str]:
    roll = rng.random()
    if roll < 0.35:
        return []
    if roll < 0.55:
        return str(rng.choice(LAYOUT)).split()
    if roll < 0.8:
        return [str(w) for w in rng.choice(NEUTRAL, int(rng.integers(1, 3)))]
    return ["".join(rng.choice(list("abcdefghiklmnoprstuvwxyz"), int(rng.integers(2, 8))))]


def hidden(nodes: list[Node], good: np.ndarray, rng: np.random.Generator) -> list[Node]:
    """The nodes with the names of marked elements and of those around them taken away."""
    out = []
    for i, node in enumerate(nodes):
        tag, tokens = node.tag, node.tokens
        if good[i] and (tag in ("article", "main") or purposes(node)):
            tag = str(rng.choice(PLAIN)) if tag in ("article", "main") else tag
            tokens = neutral_tokens(rng)
        out.append(Node(tag, node.parent, node.depth, tokens, node.children, node.own, node.links, node.marks, node.stops))
    return out


def made_page(others: list[str], rng: np.random.Generator) -> str:
    """A page of the given texts' words in a random layout; elements of the main text have
    the class token MADE."""
    def quote(least, most):
        words = others[int(rng.integers(len(others)))].split() or ["text"]
        k = int(rng.integers(least, most + 1))
        at = int(rng.integers(max(1, len(words) - k)))
        return html.escape(" ".join(words[at:at + k]))

    def named(tag, inner, tokens):
        return f'<{tag} class="{" ".join(tokens)}">{inner}</{tag}>' if tokens else f"<{tag}>{inner}</{tag}>"

    def purpose(name):
        words = list(PURPOSES.values())[list(PURPOSES).index(name)].split()
        return [str(rng.choice(words))] + (neutral_tokens(rng)[:1] if rng.random() < 0.3 else [])

    def links(name, tag):
        k = int(rng.integers(2, 9))
        items = [f'<a href="#">{quote(1, 5)}</a>' for _ in range(k)]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else " | ".join(items)
        return named(tag if rng.random() < 0.5 else "div", inner, purpose(name) if tag == "div" or rng.random() < 0.7 else [])

    def words(least, most):
        """A paragraph's words: one in four is short, some carry inline marks."""
        text = quote(2, 12) if rng.random() < 0.25 else quote(least, most)
        roll = rng.random()
        return f"<b>{text}" if roll < 0.1 else f"{text} <i>{quote(1, 3)}</i>." if roll < 0.25 else text

    bare, par = rng.random() < 0.25, "div" if rng.random() < 0.15 else "p"
    mark = ["MADE"] if bare else []
    pieces = [named("h1" if par == "p" else par, quote(2, 9), mark)] if rng.random() < 0.85 else []
    for _ in range(int(rng.integers(1, 9))):
        roll = rng.random()
        if roll < 0.7:
            pieces.append(named(par, words(12, 110), mark))
        elif roll < 0.78:
            pieces.append(named("h2", quote(2, 7), mark) + named(par, words(12, 80), mark))
        elif roll < 0.86:
            pieces.append(named("ul", "".join(f"<li>{quote(3, 20)}</li>" for _ in range(int(rng.integers(2, 6)))), mark))
        elif roll < 0.93:
            pieces.append(named("div", quote(20, 120), mark))
        else:
            pieces.append(named("blockquote", named("p", quote(10, 50), []), mark))
    body = "".join(pieces)
    if not bare:
        for step in range(int(rng.integers(1, 4))):
            tokens = purpose("content") if step == 0 and rng.random() < 0.4 else neutral_tokens(rng)
            tag = str(rng.choice(PLAIN))
            body = named(tag, body, tokens + (["MADE"] if step == 0 else []))
            body = f"<table><tr>{body}</tr></table>" if tag == "td" else body
    before, after = [], []
    for name, tag, place in (("menu", "nav", before), ("frame", "header", before), ("notice", "div", before), ("side", "aside", before),
                             ("side", "aside", after), ("comment", "section", after), ("advert", "div", after), ("advert", "div", before),
                             ("form", "form", after), ("social", "div", after), ("frame", "footer", after)):
        if rng.random() < 0.4:
            if name in ("menu", "side", "social") and rng.random() < 0.8:
                place.append(links(name, tag))
            else:
                inner = "".join(named("p" if rng.random() < 0.7 else "div", quote(3, 50 if name == "comment" else 25), [])
                                for _ in range(int(rng.integers(1, 5 if name == "comment" else 3))))
                keep = tag != "div" and name != "comment" and rng.random() < 0.5
                place.append(named(tag if keep or rng.random() < 0.5 else "div", inner, [] if keep else purpose(name)))
    page = "".join(before) + body + "".join(after)
    return f"<html><body>{named('div', page, neutral_tokens(rng)) if rng.random() < 0.4 else page}</body></html>"


def made_rows(others: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of a made page."""
    nodes, blocks = parse(made_page(others, rng))
    inside, good = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        inside[i] = "made" in node.tokens or (node.parent >= 0 and inside[node.parent])
        node.tokens = [w for w in node.tokens if w != "made"]
    for i, _ in blocks:
        good[i] |= inside[i]
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] |= good[i]
    return features(nodes, blocks), good.astype(float)


def training_rows(page: str, nodes: list[Node], blocks: list[tuple[int, str]], others: list[str],
                  rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and weak labels of the page's nodes: as it is, rewritten, and both with
    the names of what is marked hidden."""
    for n, b in ((nodes, blocks), parse(rewritten(page, others, rng))):
        y = weak_labels(n, b)
        if y is not None:
            yield features(n, b), y
            yield features(hidden(n, y > 0, rng), b), y


def some_rows(page: str, nodes: list[Node], blocks: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """At most ``SAMPLE_NODES`` training rows of a page."""
    rng = np.random.default_rng(zlib.crc32(page.encode("utf-8", "replace")))
    rows = list(training_rows(page, nodes, blocks, [" ".join(t for _, t in blocks)], rng))
    x, y = (np.concatenate(part) for part in zip(*rows))
    at = rng.permutation(len(y))[:SAMPLE_NODES]
    return x[at], y[at]


def fit_pages(pages: list[str], seed: int = 7, more: list[tuple[np.ndarray, np.ndarray]] = ()) -> Trees:
    """``more``: features and labels of nodes of further pages."""
    rng = np.random.default_rng(seed)
    parsed = [parse(p) for p in pages]
    others = [" ".join(t for _, t in b) for _, b in parsed if b] or ["Some text."]
    rows = list(more)
    for page, (nodes, blocks) in zip(pages, parsed):
        rows += training_rows(page, nodes, blocks, others, rng)
    rows += [made_rows(others, rng) for _ in range(MADE_PAGES)]
    return fit_trees(*(np.concatenate(part) for part in zip(*rows)))


# ---------------------------------------------------------------- decoding
def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The most likely labels of all nodes, none with main text below one without."""
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    keep, drop = yes.copy(), no.copy()          # best value of a subtree whose root is kept / dropped
    for i in range(len(nodes) - 1, 0, -1):
        parent = nodes[i].parent
        keep[parent] += max(keep[i], drop[i])
        drop[parent] += drop[i]
    chosen = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        chosen[i] = (node.parent < 0 or chosen[node.parent]) and keep[i] > drop[i]
    return chosen


def main_texts(trees: Trees, pages: list[str]) -> list[str]:
    if not pages:
        return []
    parsed = [parse(p) for p in pages]
    xs = [features(n, b) for n, b in parsed]
    odds = trees.log_odds(np.concatenate(xs))
    out, at = [], 0
    for (nodes, blocks), x in zip(parsed, xs):
        chosen = decode(nodes, odds[at:at + len(x)])
        at += len(x)
        out.append("\n".join(t for i, t in blocks if chosen[i]))
    return out


def _groups(pages: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    part, held = [], 0
    for p in pages:
        if part and held + len(p) > most:
            yield part
            part, held = [], 0
        part.append(p)
        held += len(p)
    if part:
        yield part


def labelled_pages(pages: DataFrame, html_col: str, sample_chars: int) -> DataFrame:
    """The pages with a weak label: the html, or features and labels of some nodes of pages
    of more than ``sample_chars`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(2).to_pylist()):
                nodes, blocks = parse(page)
                if weak_labels(nodes, blocks) is not None:
                    row = (page, None, None)
                    if len(page) > sample_chars:
                        x, y = some_rows(page, nodes, blocks)
                        row = (None, x.tobytes(), y.tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(i, 1).columns[:2], *(pa.array([v], t) for v, t in zip(
                            row, (pa.string(), pa.binary(), pa.binary())))], ["a", "b", "html", "x", "y"])

    return (pages.where(F.col(html_col).isNotNull()).select("a", "b", html_col)
            .mapInArrow(run, "a long, b long, html string, x binary, y binary"))


def fit_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Trees:
    """Trees fitted on a bounded sample of the pages (see the module text)."""
    keyed = pages.select(html_col, F.xxhash64(id_col).alias("a"), F.xxhash64(html_col).alias("b"))
    some = keyed.where(F.length(html_col) <= sample_chars).orderBy("a", "b").limit(sample_pages)
    texts, more = [r[0] for r in some.select(html_col).collect()], []
    if len(texts) < sample_pages or any(weak_labels(*parse(t)) is None for t in texts):
        rows = labelled_pages(keyed, html_col, sample_chars).orderBy("a", "b").limit(sample_pages).collect()
        texts = [r["html"] for r in rows if r["html"] is not None]
        more = [(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["y"], float))
                for r in rows if r["html"] is None]
        # pages without a label still lend their words to the made layouts
        words = keyed.select(F.substring(html_col, 1, sample_chars).alias("h"), "a", "b").orderBy("a", "b").limit(QUOTED_PAGES)
        texts += [r["h"] for r in words.collect() if r["h"] and weak_labels(*parse(r["h"])) is None]
    return fit_pages(texts, more=more)


def extract(pages: DataFrame, trees: Trees, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    keep = [f for f in pages.schema.fields if f.name not in (html_col, out)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _groups([p or "" for p in batch.column(len(names)).to_pylist()]):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(part)).columns[:-1], pa.array(main_texts(shared.value, part), pa.string())],
                    [*names, out])
                at += len(part)

    schema = T.StructType([*keep, T.StructField(out, T.StringType())])
    return pages.select(*names, html_col).mapInArrow(run, schema)
