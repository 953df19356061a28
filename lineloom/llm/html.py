"""Main text of web pages by a decision tree over flat text blocks.

The markup is read once, without a tree of elements: text between block-level tags
is a block, with its words and the share of them in links.  A block is judged by a
decision tree from its word count and link density, those of the blocks before and
after it, its words against those of the page's longest block of prose, and hints of
the markup: heading, list item, and whether the container says that it is an article
or outside of one.  Many pages name no container; there the counts decide, and inside
of articles they tell lists of links from text.

The tree is grown on the driver from a small labelled table: pages of many layouts
made by rule, whose blocks are labelled by construction.  Held-out pages, and what is
lost without link density or neighbours, are in the tests.

Defined results
* null or empty html, or a page without article text: the empty string;
* truncated pages, tags without end, comments without end: read as far as they go;
* invalid UTF-8 becomes U+FFFD; character references are decoded as HTML 5 does;
* repeated rows and null ids: each row gets its own result;
* pages of any length are read whole.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, column

RESULT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())]
)

# Elements of HTML by the way they break text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style title textarea noscript template iframe xmp noembed noframes svg math object select button".split())
CONTAINERS = set("article aside body center details dialog div dl fieldset figure footer form head header main menu nav ol section table tbody td tfoot th thead tr ul".split())
ITEMS = set("li dt dd option".split())
# What containers are, by element, and by words of their class, id or role.
OUTSIDE_TAGS = set("aside dialog footer form head menu nav".split())
ARTICLE_TAGS = set("article main".split())
OUTSIDE_WORDS = set(
    "ad ads adbox advert advertisement adverts aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies "
    "copyright dialog discussion disqus feedback foot footer form gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond responses search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription tags toolbar trending warning widget widgets".split()
)
ARTICLE_WORDS = set("article articlebody articlecontent articletext entry entrycontent post postbody postcontent story storybody".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

OUTSIDE, UNKNOWN, ARTICLE = -1, 0, 1
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "relative", "container", "has_article", "heading", "item")
#: Blocks of a greater share of linked words are no prose.
LINKED = 0.5


def hint(tag: str, attributes: str, above: int) -> int:
    """What a container is: part of the article, outside of it, or as the one above."""
    if attributes:
        if _HIDDEN.search(attributes):
            return OUTSIDE
        if tag != "body":
            # Parts of names: "post-body sideBar" has post, body, side, bar, and whole words.
            names = [n.strip("\"'") for n in _NAMES.findall(attributes)]
            words = {w.lower() for n in names for w in re.split(r"[\s_-]+", n)} | {w.lower() for n in names for w in _PART.findall(n)}
            if words & OUTSIDE_WORDS or ("header" in words and above != ARTICLE and not words & ARTICLE_WORDS):
                return OUTSIDE
            if words & ARTICLE_WORDS and above != OUTSIDE:
                return ARTICLE
    if tag in ARTICLE_TAGS and above != OUTSIDE:
        return ARTICLE
    if tag in OUTSIDE_TAGS or (tag == "header" and above != ARTICLE):
        return OUTSIDE
    return above


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, share of words in links, container, heading, list item) of each block, in order."""
    out: list[tuple[str, int, float, int, int, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    linked = heading = in_link = item = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                n = len(words)
                out.append((" ".join(words), n, min(1.0, linked / n), stack[-1][1] if stack else UNKNOWN, int(heading > 0), item))
            pieces.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text = page[at:lt]
            pieces.append(text)
            if in_link:
                linked += len(text.split())
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt)
        if not tag:
            if lt + 1 < size and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                end = page.find(">", lt)  # an end tag without name, or a tag cut off
                at = size if end < 0 else end + 1
            else:
                pieces.append("<")
                at = lt + 1
            continue
        at = tag.end()
        ending = tag[1] or tag[4]
        name = (tag[2] or tag[5]).lower()
        attributes = tag[3] or tag[6] or ""
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            close() if name not in ("button", "select") else pieces.append(" ")
        elif name == "a":
            in_link = 0 if ending else 1
        elif name in INLINE:
            pass
        else:
            close()
            if name[0] == "h" and name[1:].isdigit():
                heading = 0 if ending else 1
            elif name in ITEMS:
                heading, item = 0, 0 if ending else 1
            elif name in CONTAINERS:
                heading = in_link = item = 0
                if ending:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            break
                else:
                    if name == "body":
                        stack.clear()
                    stack.append((name, hint(name, attributes, stack[-1][1] if stack else UNKNOWN)))
    close()
    return out


def features(found: list[tuple[str, int, float, int, int, int]]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the ends there are empty blocks."""
    table = np.array([b[1:] for b in found], dtype=float).reshape(-1, 5)
    own, container, marks = table[:, :2], table[:, 2:3], table[:, 3:]
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:]
    prose = np.where((own[:, 1] <= LINKED) & (container[:, 0] != OUTSIDE), own[:, 0], 0.0)
    relative = (own[:, :1] / max(1.0, prose.max(initial=0.0))).clip(0, 1)
    article = np.full((len(table), 1), float((container == ARTICLE).any()))
    return np.concatenate([own, before, after, relative, container, article, marks], axis=1)


# --- the labelled table --------------------------------------------------------------


class _Page:
    """A page that is made piece by piece, with the label of each block."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def text(self, least: int, most: int) -> str:
        return " ".join(f"w{self.rng.randrange(97)}" for _ in range(self.rng.randint(least, most)))

    def raw(self, markup: str) -> _Page:
        self.html.append(markup)
        return self

    def block(self, label: int, text: str, tag: str = "p") -> _Page:
        self.labels.append(label)
        return self.raw(f"<{tag}>{text}</{tag}>")

    def link(self, least: int, most: int) -> str:
        return f"<a href='/{self.rng.randrange(9)}'>{self.text(least, most)}</a>"

    def links(self, least: int = 1, most: int = 4, tag: str = "li") -> _Page:
        """A list that is wholly linked: a menu, or teasers."""
        if tag == "li":
            self.raw("<ul>")
        for _ in range(self.rng.randint(2, 7)):
            self.block(0, self.link(least, most), tag)
        return self.raw("</ul>" if tag == "li" else "")

    def prose(self, label: int, least: int, most: int) -> _Page:
        """A paragraph; some hold links."""
        n = self.rng.randint(least, most)
        if n >= 12 and self.rng.random() < 0.25:
            k = self.rng.randint(1, n // 3)
            return self.block(label, f"{self.text(n - k, n - k)} {self.link(k, k)} {self.text(2, 4)}")
        return self.block(label, self.text(n, n))

    def outside(self) -> _Page:
        """Something beside the article, whose container says so."""
        rng, name = self.rng, self.rng.choice
        opening = name(("nav", "aside", "footer", "form", "div class='ad'", "div id='cookie-notice'", "section class='comments'", "div class='related posts'", "div role='complementary'", "div class='newsletter'"))
        self.raw(f"<{opening}>")
        if rng.random() < 0.5:
            self.block(0, self.text(1, 12), name(("h2", "h3", "h4")))
        match rng.randrange(4):
            case 0:
                self.links(1, name((3, 30)))
            case 1:
                self.prose(0, 2, 20)
            case 2:
                self.prose(0, 15, 120).prose(0, 2, 60)
            case _:
                self.block(0, self.text(1, 9), "div")
        return self.raw(f"</{opening.split()[0]}>")

    def named(self) -> _Page:
        """An article whose container says so: paragraphs of any length, and, at times, a list of links."""
        rng = self.rng
        opening = rng.choice(("article", "article", "main", "div class='post-body'", "div class='entry-content'", "section id='story'"))
        self.raw(f"<{opening}>")
        if rng.random() < 0.9:
            self.block(1, self.text(1, 16), "h1")
        for _ in range(rng.randint(1, 6)):
            match rng.randrange(8):
                case 0:
                    self.block(1, self.text(1, 9), "h2")
                case 1:
                    self.raw("<ul>")
                    for _ in range(rng.randint(2, 5)):
                        self.prose(1, 1, 30) if rng.random() < 0.3 else self.block(1, self.text(1, 18), "li")
                    self.raw("</ul>")
                case 2:
                    self.links(1, rng.choice((4, 30)), rng.choice(("li", "p", "div")))
                    self.prose(1, 1, 60)
                case 3:
                    self.outside()
                    self.prose(1, 1, 60)
                case 4:
                    self.prose(1, 12, 60).block(1, self.link(1, 12)).prose(1, 12, 60)
                case _:
                    self.prose(1, 1, rng.choice((8, 30, 150)))
        return self.raw(f"</{opening.split()[0]}>")

    def unnamed(self) -> _Page:
        """Containers that say nothing: a menu, text, teasers and a last line."""
        rng = self.rng
        cell = rng.choice((("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<section class='x1'>", "</section>")))
        self.raw(cell[0])
        if rng.random() < 0.8:
            self.links(1, rng.choice((3, 3, 34)), rng.choice(("li", "li", "p", "div")))
        self.raw(cell[1] + cell[0])
        if rng.random() < 0.8:
            self.block(1, self.text(3, 14), "h1")
        for _ in range(rng.randint(1, 4)):
            self.prose(1, 22, rng.choice((40, 90, 150)))
            match rng.randrange(4):
                case 0:
                    self.prose(1, 4, 20).prose(1, 22, 90)
                case 1:
                    self.block(1, self.text(2, 9), "h2").prose(1, 22, 90)
        self.raw(cell[1] + cell[0])
        if rng.random() < 0.5:
            if rng.random() < 0.5:
                self.block(0, self.text(1, 3), "h3")
            self.links(1, rng.choice((4, 34)), rng.choice(("li", "p")))
        if rng.random() < 0.8:
            self.block(0, self.text(2, 12), "div")
        return self.raw(cell[1])

    def short(self) -> _Page:
        """No article, but one sentence or two of prose outside of all that has a name."""
        self.outside() if self.rng.random() < 0.7 else self.links()
        self.raw("<div>").prose(1, 8, 24)
        if self.rng.random() < 0.4:
            self.prose(1, 8, 24)
        return self.raw("</div>")


def labelled_pages(number: int = 400, seed: int = 1) -> list[tuple[str, list[int]]]:
    """(html, label of each block), by rule: 1 is the article's, 0 is not."""
    pages, rng = [], random.Random(seed)
    for k in range(number):
        page = _Page(rng)
        for _ in range(rng.randint(0, 2)):
            page.outside()
        kind = k % 8
        if kind < 4:
            if rng.random() < 0.3:  # beside an article, what has no name is none
                page.raw("<div>").prose(0, 2, 60).raw("</div>")
            if rng.random() < 0.2:
                page.links(1, 30, "p")
            page.named()
            if rng.random() < 0.2:
                page.raw("<div>").block(0, page.text(1, 8), "h3").links(2, 20, "p").raw("</div>")
        elif kind < 6:
            page.unnamed()
        elif kind == 6:
            page.short()
        else:  # nothing but scraps
            page.raw("<div>").block(0, page.text(1, 4), rng.choice(("p", "h2", "div"))).raw("</div>")
        for _ in range(rng.randint(0, 2)):
            page.outside()
        pages.append(("<body>" + "".join(page.html) + "</body>", page.labels))
    return pages


def training_table(pages: list[tuple[str, list[int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and label of every block of the labelled pages."""
    rows, labels = [], []
    for page, label in labelled_pages() if pages is None else pages:
        found = blocks(page)
        if len(found) != len(label):
            raise ValueError(f"{len(found)} blocks, {len(label)} labels: {page[:200]}")
        rows.append(features(found))
        labels += label
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2):
    """A tree of (feature, threshold, left, right) and leaves 0 or 1, by Gini impurity."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left = ones[:-1]
        right = ones[-1] - left
        impurity = left * (n - left) / n + right * (len(y) - n - right) / (len(y) - n)
        impurity[(values[1:] == values[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(impurity.argmin())
        if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0] - 1e-12):
            best = (impurity[k], f, (values[k] + values[k + 1]) / 2)
    if best is None:
        return int(share >= 0.5)
    _, f, threshold = best
    low = x[:, f] <= threshold
    return f, float(threshold), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@functools.cache
def trained():
    return grow(*training_table())


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree


def main_text(page: bytes | None, tree) -> tuple[str, int, int, int]:
    """The values of RESULT for one page."""
    found = blocks((page or b"").decode("utf-8", "replace"))
    if not found:
        return "", 0, 0, 0
    kept = [b[0] for b, row in zip(found, features(found).tolist(), strict=True) if decide(tree, row)]
    text = " ".join(kept)
    return text, len(text), len(found), len(kept)


class _Extract:
    def __init__(self, tree):
        self.tree = tree

    def __call__(self):
        def work(pages):
            got = [main_text(p, self.tree) for p in pages]
            return {name: [g[i] for g in got] for i, name in enumerate(RESULT.names)}

        return work


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree=None) -> DataFrame:
    """For every row ``id_col``, ``url_col`` and the fields of RESULT; ``tree`` replaces the one grown here."""
    rows = pages.select(column(pages, id_col).alias("id"), column(pages, url_col).alias("address"), column(pages, html_col).alias("body"))
    found = append_columns(rows, "body", RESULT, _Extract(trained() if tree is None else tree))
    return found.select(found["id"].alias(id_col), found["address"].alias(url_col), *RESULT.names)
