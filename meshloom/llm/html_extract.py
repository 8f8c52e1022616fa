"""Main text of web pages from flat text blocks.

A page is read in one pass into text blocks (what stands between block-level tags).  A block's
features are its words and link density, those of its neighbours, whether it lies in an article
container or in one of the page's furniture (navigation, adverts, comments, by tag, role or class
words), and whether it is a heading, list item or paragraph.  A decision tree, trained on the small
labelled table of `html_training`, says which blocks are main text.

Furniture by a class word is inherited until an <article> or <main> inside (a layout wrapper says "sidebar"
too); furniture by tag, role or a comment word is inherited throughout.  Words that a class negates or only mentions
(has-, with-, no-, without-) are no mark.

Defined results: null or blank html has no text; markup cut short (an open comment, script or tag at
the end) takes the rest of the page with it; a link that isn't closed ends with the block element it
stands in; unknown entities stay as written; ids may be null or repeat; pages without a container are
judged on words and links alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|canvas|math|title)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
# HTML's block-level and void elements.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog head fieldset search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist "
    "disqus respond reply replies share sharing social related recommended recommendations popular trending popup modal overlay search pagination pager copyright widget widgets legal toc skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
MENTIONS = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "without_")
ARTICLE_WORDS = frozenset("article content post entry story articlebody maincontent main body-text".split())
CLASS = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "article", "furniture", "heading", "item", "paragraph")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    tag: str


def _zone(tag: str, attributes: str, article: bool) -> tuple[bool, int]:
    """Whether an element opens an article container, and whether it is furniture: 0 not, 1 by a class
    word, 2 by its tag, role or as comments."""
    if tag in FURNITURE_TAGS or (tag == "header" and not article):
        return False, 2
    found = tag in ("article", "main")
    if "=" in attributes:
        for m in CLASS.finditer(attributes):
            value = m[1] or m[2] or m[3] or ""
            parts = {p.lower() for name in value.split() if not name.lower().startswith(MENTIONS) for p in PIECE.findall(name)}
            if tag not in ("body", "html", "article", "main") and (parts & FURNITURE_WORDS or value.lower() in FURNITURE_ROLES):
                return False, 2 if parts & COMMENT_WORDS or value.lower() in FURNITURE_ROLES else 1
            found = found or bool(parts & ARTICLE_WORDS)
    return found, 0


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    article, furniture = False, 0
    pieces: list[str] = []
    plain: list[str] = []
    link, tag_now, at = 0, "", 0  # link: 1 + open block elements where the link began

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(words, len("".join(plain).split())), article, furniture > 0, tag_now))
            pieces.clear()
            plain.clear()

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link:
                plain.append(text)

    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, ends = name.lower(), bool(m[2])
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            link = 0 if ends else 1 + len(stack)
            if link:
                plain.append(" ")
        if name not in BLOCKS:
            continue
        close()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    if link > 1 + k:  # opened inside
                        link = 0
                    break
        else:
            if name in ("p", "li") or name in HEADINGS:  # these end an open paragraph
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
            if name not in VOID:
                inside = stack[-1] if stack else ("", False, 0)
                opens, bad = _zone(name, m[4] or "", inside[1])
                kept = 0 if inside[2] == 1 and name in ("article", "main") else inside[2]
                stack.append((name, inside[1] or opens, max(kept, bad)))
        top = stack[-1] if stack else ("", False, 0)
        tag_now, article, furniture = top
    say(page[at:])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    x[:, 0] = [b.words for b in found]
    x[:, 1] = [b.linked / b.words for b in found]
    x[1:, 2:4] = x[:-1, :2]
    x[:-1, 4:6] = x[1:, :2]
    x[:, 6] = [b.article for b in found]
    x[:, 7] = [b.furniture for b in found]
    x[:, 8] = [b.tag in HEADINGS for b in found]
    x[:, 9] = [b.tag in ("li", "dd", "dt") for b in found]
    x[:, 10] = [b.tag == "p" for b in found]
    return x


class Tree:
    """A binary decision tree by Gini impurity; ties go to the earlier feature and lower cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.share = float(y.mean())
        self.feature = None
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = (2 * self.share * (1 - self.share) - 1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                right = x[:, f] > cut
                n = int(right.sum())
                if min(n, len(y) - n) < least:
                    continue
                p, q = y[right].mean(), y[~right].mean()
                gini = (n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q)) / len(y)
                if gini < best[0] - 1e-12:
                    best = (gini, f, float(cut))
        if best[1] is None:
            return
        _, self.feature, self.cut = best
        right = x[:, self.feature] > self.cut
        self.low, self.high = Tree(x[~right], y[~right], depth - 1, least), Tree(x[right], y[right], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share >= 0.5)
        out = np.zeros(len(x), bool)
        right = x[:, self.feature] > self.cut
        out[~right], out[right] = self.low.predict(x[~right]), self.high.predict(x[right])
        return out


_tree: list[Tree] = []


def trained() -> Tree:
    """The tree, trained once a process on the labelled table."""
    if not _tree:
        from .html_training import labelled

        _tree.append(Tree(*labelled()))
    return _tree[0]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    keep = trained().predict(features(found)) if found else []
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, url_col, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            found = [blocks(p) if p else [] for p in batch.column(2).to_pylist()]
            keep = iter(tree.predict(np.concatenate([*map(features, found), np.zeros((0, len(FEATURES)))])).tolist())
            text = ["\n\n".join(b.text for b in page if next(keep)) for page in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
