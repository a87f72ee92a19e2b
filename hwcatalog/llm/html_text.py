"""Main text of web pages by a tree-structured graphical model over their elements.

Every element that is not mere text markup is a node, and every block of text a leaf below its element; a node is
content or not. A node's own potential is a weighted sum of features (tag, words of its class, id and role, the share of links in
the text below it; for a leaf its element's tag, its length, its share of the page, its links, how it ends, telling words of
its own and of the headings above it, and whether the page marks its article at all); a parent and a child have a
potential for each pair of labels, by the child's tag. Sum-product messages go up and down the tree, so the
marginals are exact. The weights are fitted by gradient ascent on the likelihood of labelled pages,
which ``labelled_pages`` makes: many layouts with menus, notices, adverts, sidebars, forms and comments.
"""

from __future__ import annotations

import functools
import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content of their own (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, or never shown; their text is never page text.
RAW = ("script", "style", "template", "iframe", "textarea", "title", "select", "noembed", "noframes")
#: Elements that only mark up text within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark meter nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
#: Words of headings that name a part of a page, and of short blocks that are seldom an article's.
HEADS = frozenset("comment comments response responses reply replies discussion related popular recommended trending newsletter subscribe share categories archives sponsored".split())
SAYS = frozenset("copyright rights reserved cookie cookies privacy imprint terms subscribe newsletter login menu advertisement sponsored".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Words of class, id and role that mark an article, as its tag does.
ARTICLE = frozenset("content article post entry story".split())
#: Elements that are nested deeper than this hang from the element at this depth, as in browsers.
DEEPEST = 512
#: A start tag on the left ends an open element on the right (fixed by HTML, in the cases that matter for text).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
KNOWN = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption nav header footer aside form button fieldset address details summary dialog center button label svg noscript object canvas video audio hr pre section #text".split()
TAGS = {t: i for i, t in enumerate(KNOWN)}
OTHER = len(KNOWN)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s>/])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+|\u00a9")


class Page:
    """Nodes of a page in page order, and its blocks of text, which are nodes too."""

    __slots__ = ("parent", "depth", "tag", "names", "within", "blocks")

    def __init__(self):
        self.parent, self.depth, self.tag, self.names, self.within = [-1], [0], ["html"], [()], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links

    def add(self, parent: int, tag: str, names: tuple[str, ...] = ()) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.within.append(self.within[parent] or tag == "article" or not ARTICLE.isdisjoint(names))  # a marked article or a part of one
        return len(self.tag) - 1


def _names(attrs: str) -> tuple[str, ...]:
    """Words of an element's class, id, role and label, and whether it is hidden."""
    found = []
    for a in ATTR.finditer(attrs):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.append("hidden")
        elif key != "style":
            found += [n.lower() for n in NAME.findall(value)]
    return tuple(dict.fromkeys(found))


def parse(source: str | None) -> Page:
    """Read a page, however broken: unknown end tags are passed over, open elements end with their parents, a cut tag is dropped."""
    page, stack, text, linked, anchors, at = Page(), [(0, "html")], [], 0, 0, 0
    opened: dict[str, int] = {}
    heads: list[tuple[int, int, set[str]]] = []  # headings above: place in the stack, rank, telling words
    source = source or ""

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = _html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if anchors:
                linked += len(plain)

    def close() -> None:
        nonlocal linked
        if text:
            block = SPACE.sub(" ", "".join(text)).strip()
            if block:
                told: list[str] = []
                said = set(WORD.findall(block.lower())) if len(block) <= 120 else set()
                if rank := HEADINGS.get(stack[-1][1]):
                    where = "in" if page.within[stack[-1][0]] else "under"
                    heads[:] = [h for h in heads if h[1] < rank] + [(len(stack) - 1, rank, {f"{where}:{x}" for x in said & HEADS} if len(block) <= 40 else set())]
                told += under()
                told += [f"says:{x}" for x in sorted(said & SAYS)] + ["says:copyright"] * ("\u00a9" in said and "copyright" not in said)
                page.blocks.append((page.add(stack[-1][0], "#text", tuple(told)), block, linked))
            text.clear()
        linked = 0

    def under() -> list[str]:
        """Telling words of the headings above, apart for those of a marked article."""
        return sorted(set().union(*(h[2] for h in heads))) if heads else []

    def pop(to: int) -> None:
        for _, tag in stack[to:]:
            opened[tag] -= 1
        del stack[to:]
        heads[:] = [h for h in heads if h[0] <= to]

    for m in TOKEN.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if (m["end"] or m["end2"]) else 1
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "head":  # its text elements are raw; the rest has no text
            continue
        close()
        if m["end"] or m["end2"]:
            if opened.get(tag):
                anchors = 0
                k = len(stack) - 1
                while stack[k][1] != tag:
                    k -= 1
                pop(k)
            continue
        if tag in VOID or attrs.endswith("/") and (tag == "svg" or tag not in TAGS):
            continue
        if stack[-1][1] == "p":
            pop(len(stack) - 1)
        for ended in ENDS.get(tag, ()):
            if stack[-1][1] == ended:
                pop(len(stack) - 1)
                if ended in ("td", "th") and tag in ("tr", "tbody") and stack[-1][1] == "tr":
                    pop(len(stack) - 1)
                break
        if tag == "html" or tag == "body" and opened.get("body"):
            continue
        node = page.add(stack[min(len(stack), DEEPEST) - 1][0], tag, (*(_names(attrs) if attrs else ()), *under()))
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((node, tag))
    say(source[at:])
    close()
    _place(page)
    return page


def _place(page: Page) -> None:
    """Give each leaf its share of the page's text and, where nothing marks the article, its tag and length in such a page.

    Words that are seldom an article's tell nothing within an element that is marked as one.
    """
    total = sum(len(t) for _, t, _ in page.blocks)
    bare = not any(page.within) and not any(t == "main" or "main" in n for t, n in zip(page.tag, page.names, strict=True))
    for node, text, linked in page.blocks:
        told = tuple(x for x in page.names[node] if not (page.within[node] and x.startswith("says:")))
        told += (f"part:{sum(10 * len(text) >= x * total for x in (1, 3, 6, 9))}",)
        if bare:
            size = sum(len(text) >= x for x in (12, 40, 120))
            told += ("bare:linked" if linked * 2 > len(text) else f"bare:{size}", f"bare:{page.tag[page.parent[node]]}")
        page.names[node] = told


class Forest:
    """Nodes of many pages as arrays: parents, levels, and a list of (node, feature)."""

    def __init__(self, pages: list[Page], words: dict[str, int]):
        start = np.concatenate([[0], np.cumsum([len(p.tag) for p in pages])]).astype(np.int64)
        self.start, total = start, int(start[-1])
        self.parent = np.concatenate([np.array(p.parent, np.int64) + s for p, s in zip(pages, start, strict=False)]) if total else np.zeros(0, np.int64)
        self.parent[start[:-1]] = -1
        self.tag = np.array([TAGS.get(t, OTHER) for p in pages for t in p.tag], np.int64)
        depth = np.array([d for p in pages for d in p.depth], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if total else []
        self.above = [self.parent[x] for x in self.levels]
        own, linked = np.zeros(total), np.zeros(total)
        leaf, size, end = [], [], []
        for p, s in zip(pages, start, strict=False):
            for node, text, links in p.blocks:
                own[s + node], linked[s + node] = len(text), links
                leaf.append(s + node)
                size.append(len(text))
                end.append(text[-1] in ".!?…:;\"'”»)。")
        leaf = np.array(leaf, np.int64)
        for level in self.levels[:0:-1]:
            np.add.at(own, self.parent[level], own[level])
            np.add.at(linked, self.parent[level], linked[level])
        # of the elements that hold an article their tag tells more than their links
        frame = np.isin(self.tag, [TAGS[t] for t in ("html", "body", "main", "article")])
        share = np.where((own > 0) & ~frame, np.digitize(linked / np.maximum(own, 1), [0.1, 0.5, 0.9]), 4)
        tags = OTHER + 1
        text = TAGS["#text"]
        is_leaf = self.tag == text
        # an element's tag, or that of a leaf's element; links apart for elements and leaves
        column = [np.where(is_leaf, tags + self.tag[self.parent], self.tag), 2 * tags + share + 5 * is_leaf]
        node, feature = np.repeat(np.arange(total), 2), np.stack(column, 1).reshape(-1) if total else np.zeros(0, np.int64)
        base = 2 * tags + 10
        length = base + np.digitize(np.array(size, np.int64), [12, 40, 120, 400]) + 5 * np.array(end, np.int64)
        node, feature = np.concatenate([node, leaf]), np.concatenate([feature, length.astype(np.int64)])
        base += 10
        more = [(s + k, base + words[x]) for p, s in zip(pages, start, strict=False) for k, names in enumerate(p.names) for x in names if x in words]
        extra = np.array(more, np.int64).reshape(-1, 2)
        self.node, self.feature = np.concatenate([node, extra[:, 0]]), np.concatenate([feature, extra[:, 1]])
        self.features = base + len(words)

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(label) per node, P(parent's, own label) per node) by sum-product, from log potentials (n, 2) and (tags, 2, 2)."""
        n = len(unary)
        up0, up1 = unary[:, 0].copy(), unary[:, 1].copy()
        m0, m1, down0, down1 = (np.zeros(n) for _ in range(4))
        joint = np.zeros((n, 2, 2))
        for level, parent, (a, b, c, d) in zip(self.levels[:0:-1], self.above[:0:-1], (pair[self.tag[x]].reshape(-1, 4).T for x in self.levels[:0:-1]), strict=True):  # children before parents
            x, y = up0[level], up1[level]
            m0[level], m1[level] = np.logaddexp(a + x, b + y), np.logaddexp(c + x, d + y)
            np.add.at(up0, parent, m0[level])
            np.add.at(up1, parent, m1[level])
        for level, parent in zip(self.levels[1:], self.above[1:], strict=True):  # parents before children
            a, b, c, d = pair[self.tag[level]].reshape(-1, 4).T
            r0, r1 = up0[parent] + down0[parent] - m0[level], up1[parent] + down1[parent] - m1[level]
            both = np.stack([r0 + a, r0 + b, r1 + c, r1 + d], 1)
            x, y = np.logaddexp(both[:, 0], both[:, 2]), np.logaddexp(both[:, 1], both[:, 3])
            top = np.maximum(x, y)
            down0[level], down1[level] = x - top, y - top
            both += np.stack([up0[level], up1[level]] * 2, 1)
            both = np.exp(both - both.max(axis=1, keepdims=True))
            joint[level] = (both / both.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
        belief = np.stack([up0 + down0, up1 + down1], 1)
        return np.exp(belief - np.logaddexp(belief[:, 0], belief[:, 1])[:, None]), joint


class Model:
    """Feature weights and pair potentials."""

    def __init__(self, words: dict[str, int], weight: np.ndarray, pair: np.ndarray):
        self.words, self.weight, self.pair = words, weight, pair

    def marginals(self, pages: list[Page]) -> tuple[Forest, np.ndarray]:
        forest = Forest(pages, self.words)
        unary = np.zeros((len(forest.tag), 2))
        unary[:, 1] = np.bincount(forest.node, self.weight[forest.feature], minlength=len(forest.tag))
        return forest, forest.marginals(unary, self.pair)[0][:, 1]

    def texts(self, sources: list[str | None]) -> list[str]:
        """Main text of each page: its blocks in page order that are content with a marginal of at least a half."""
        pages = [parse(x) for x in sources]
        forest, p = self.marginals(pages)
        return ["\n".join(text for node, text, _ in page.blocks if p[s + node] >= 0.5) for page, s in zip(pages, forest.start, strict=False)]


def fit(labelled: list[tuple[str, set[str]]], rounds: int = 200, ridge: float = 0.001) -> Model:
    """Fit a model to labelled pages: (html, the texts of its content blocks). Ascent with adaptive steps on the exact gradient.

    A leaf is content if its text is; an element takes the label that most of the text below it has. Words of class, id
    and role are those that at least three pages use.
    """
    pages = [parse(h) for h, _ in labelled]
    used: dict[str, int] = {}
    for p in pages:
        for x in {x for names in p.names for x in names}:
            used[x] = used.get(x, 0) + 1
    words = {x: i for i, x in enumerate(sorted(x for x, n in used.items() if n >= 3))}
    forest = Forest(pages, words)
    own = np.zeros(len(forest.tag))
    for page, s, (_, good) in zip(pages, forest.start, labelled, strict=False):
        for node, text, _ in page.blocks:
            own[s + node] = (1 if text in good else -1) * len(text)
    score = own.copy()
    for level in forest.levels[:0:-1]:
        np.add.at(score, forest.parent[level], score[level])
    label = np.where(own != 0, own > 0, score > 0).astype(np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    weight, pair = np.zeros(forest.features), np.zeros((OTHER + 1, 2, 2))
    m1, m2 = [np.zeros_like(weight), np.zeros_like(pair)], [np.zeros_like(weight), np.zeros_like(pair)]
    seen = np.zeros_like(pair)
    np.add.at(seen, (forest.tag[child], label[forest.parent[child]], label[child]), 1)
    truth = np.bincount(forest.feature, label[forest.node].astype(float), minlength=forest.features)
    for t in range(1, rounds + 1):
        unary = np.zeros((len(forest.tag), 2))
        unary[:, 1] = np.bincount(forest.node, weight[forest.feature], minlength=len(forest.tag))
        p, joint = forest.marginals(unary, pair)
        guess = np.zeros_like(pair)
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            guess[:, i, j] = np.bincount(forest.tag[child], joint[child, i, j], minlength=len(guess))
        for k, (x, g) in enumerate(((weight, truth - np.bincount(forest.feature, p[forest.node, 1], minlength=forest.features)), (pair, seen - guess))):
            g = g / len(pages) - ridge * x / 10
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            x += 0.15 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
    return Model(words, weight, pair)


@functools.cache
def trained(pages: int = 1000, seed: int = 1) -> Model:
    """The model fitted to ``pages`` pages of ``labelled_pages``: a fixed number, whatever the input."""
    from .html_training import labelled_pages

    return fit(labelled_pages(pages, seed))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars (its code points) per row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text. Rows are independent; repeated rows give equal results. Other columns are ignored.
    """
    model = model or trained()

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                out = model.texts(column.slice(i, 200).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
