"""HTML extraction: flat text blocks, classified by a decision tree over word counts, link density and neighbours.

A page is cut into blocks at block-level tags. A block's features are its words, its share of words in links,
the same of the blocks before and after it, and its zone: inside an article, inside something that is known
not to be one (by tag or by class name), inside something that may hold one (a form in an article, a layout's class name), or neither. The tree is trained on the labelled table below, each time
the module is used; it holds a few hundred rows.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import col

# Element names, and words in class names and ids.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header li main menu nav ol section table td ul".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("aside dialog footer header menu nav".split())
#: Elements that are no text of an article around them, but may stand around a whole page.
FORM_TAGS = frozenset("fieldset form".split())
#: Elements whose text is not page text. Without an end tag the first lot runs to the end of the page, as in browsers, and the
#: second only to the next block-level tag.
RAW = "script|style|textarea"
UNREAD = frozenset("noscript template svg iframe select button object canvas audio video".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar warning widget widgets".split()
)
#: Of these, what holds texts of others or notices: an article inside is none of the page's own.
FOREIGN_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts comment comments consent cookie cookies copyright disclaimer disqus gdpr promo promoted "
    "promotion related replies reply respond sponsor sponsored".split()
)
#: Words beside which a name keeps its meaning: "site-header", but not "with-sidebar" or "comments-open".
NEUTRAL_NAMES = frozenset(
    "area bar block body bottom box buttons container content inner item items left links list main page post posts primary right secondary section "
    "site text top wrap wrapper".split()
)
MAIN_NAMES = frozenset("article articlebody content entry main post story text".split())

#: Blocks of pages that name no zone: zone 0, words, link share, words and link share before and after, main text or not.
UNNAMED = (
    # pages that name nothing: text by length and neighbours
    (0, 90, 0.0, 70, 0.0, 60, 0.0, 1), (0, 45, 0.05, 10, 0.0, 80, 0.0, 1), (0, 200, 0.1, 4, 1.0, 50, 0.0, 1), (0, 30, 0.0, 90, 0.0, 40, 0.0, 1),
    (0, 25, 0.0, 0, 0.0, 0, 0.0, 1), (0, 18, 0.0, 40, 0.0, 35, 0.0, 1), (0, 12, 0.0, 60, 0.0, 80, 0.0, 1), (0, 8, 0.0, 50, 0.0, 45, 0.0, 1),
    (0, 7, 0.0, 3, 1.0, 90, 0.0, 1), (0, 5, 0.0, 2, 1.0, 60, 0.0, 1), (0, 22, 0.1, 5, 0.0, 30, 0.0, 1), (0, 16, 0.0, 14, 0.0, 55, 0.0, 1),
    (0, 4, 1.0, 5, 1.0, 3, 1.0, 0), (0, 2, 1.0, 0, 0.0, 2, 1.0, 0), (0, 10, 0.8, 6, 1.0, 8, 0.9, 0), (0, 35, 0.9, 12, 0.8, 20, 1.0, 0),
    (0, 3, 0.0, 2, 1.0, 4, 1.0, 0), (0, 6, 0.0, 5, 0.6, 3, 1.0, 0), (0, 9, 0.4, 4, 0.5, 2, 1.0, 0), (0, 4, 0.0, 3, 0.0, 2, 0.0, 0),
    (0, 8, 0.0, 5, 0.0, 6, 0.0, 0), (0, 2, 0.0, 4, 0.0, 3, 1.0, 0), (0, 15, 0.6, 10, 0.5, 12, 0.7, 0), (0, 60, 0.7, 20, 0.8, 30, 0.6, 0),
)
_NEIGHBOURS = ((0, 0.0), (4, 1.0), (7, 0.3), (60, 0.0))
#: The labelled table. Blocks inside an article are its text unless they are link lists; blocks inside what a class name
#: or a form sets apart (zone -1) are text if they are long and hold few links; blocks inside anything else (zone -2) are not,
#: whatever is beside them; the rest is as labelled above.
LABELLED = UNNAMED + tuple(
    (zone, words, links, *before, *after, int(zone == 1 and links < 0.8 or zone == -1 and words >= 100 and links < 0.4))
    for zone, shares in ((1, (0.0, 0.5, 0.9, 1.0)), (-1, (0.0, 0.3, 0.5, 1.0)), (-2, (0.0, 1.0)))
    for words, links, before, after in itertools.product((2, 30, 300) if zone != -1 else (2, 30, 100, 300), shares, _NEIGHBOURS, _NEIGHBOURS)
)
FEATURES = ("zone", "words", "links", "words_before", "links_before", "words_after", "links_after")
DEPTH = 6


@dataclass
class Node:
    """A test ``feature <= cut``, or a leaf with its share of main text."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = field(default=None, repr=False)
    high: Node | None = field(default=None, repr=False)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node:
    """A classification tree: each split lowers the Gini impurity most; ties go to the first feature and cut."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (len(y) * node.share * (1 - node.share) - 1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if impurity < best[0] - 1e-9:
                best = (impurity, (f, float(cut)))
    if best[1]:
        node.feature, node.cut = best[1]
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@cache
def tree() -> Node:
    rows = np.array(LABELLED, float)
    return grow(rows[:, :-1], rows[:, -1])


_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|<[a-zA-Z/][^>]*+\Z",
    re.S | re.I,
)
_UNREAD = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<(/?)({'|'.join(sorted(UNREAD))})\b(?![:-])([^>]*+)>", re.S | re.I
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def names_other(names: str) -> set[str]:
    """Words of ``OTHER_NAMES`` that class names and ids are made of, but for neutral words."""
    out: set[str] = set()
    for name in names.lower().split():
        parts = {w for w in re.split(r"[^a-z]+", name) if w}
        if parts <= OTHER_NAMES | NEUTRAL_NAMES:
            out |= parts & OTHER_NAMES
    return out


def zone_of(tag: str, attributes: str, outer: int) -> int:
    """Zone inside an element; what names neither side keeps the zone around it.

    Zone -2 cannot be left. Zone -1, by a form in an article or a class name alone, ends at an article inside.
    """
    if tag == "body" or tag == "html":
        return 0
    if outer == -2:
        return outer
    names = " ".join(m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes)) if attributes else ""
    other = names_other(names)
    if other & FOREIGN_NAMES or (attributes and _HIDDEN.search(attributes)):
        return -2
    if other:
        return -1
    if tag == "header" and outer > 0:
        return outer
    if tag in OTHER_TAGS:
        return -2
    if tag in FORM_TAGS and outer > 0:
        return -1
    if tag in MAIN_TAGS or (outer == 0 and names and MAIN_NAMES.intersection(re.split(r"[^a-z]+", names.lower()))):
        return 1
    return outer


def unread(page: str) -> dict[int, int]:
    """Where unread elements that have an end tag start and end; of the same name the inner ones are closed first."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _UNREAD.finditer(page):
        if m[3]:
            same = opened.setdefault(m[3].lower(), [])
            if m[2]:
                if same:
                    out[same.pop()] = m.end()
            elif not m[4].endswith("/"):
                same.append(m.start())
    return out


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """Text, zone, words and words in links of each block with text, in page order."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    zone = at = links = 0
    skipped, skipping = unread(page), False

    def add(raw: str) -> None:
        if raw and not skipping:
            parts.append((html.unescape(raw), links > 0))

    def close() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                out.append((text, zone, len(text.split()), sum(len(t.split()) for t, linked in parts if linked)))
            parts.clear()

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        ends, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "head":
            skipping = not ends
        elif tag in UNREAD:
            if m.start() in skipped:
                at = skipped[m.start()]
            elif not ends and not attributes.endswith("/"):
                skipping = True
        elif tag == "a":
            links = 0 if ends else 1
        elif tag == "br":
            parts.append((" ", False))
        elif tag in BLOCK_TAGS:
            close()
            links, skipping = 0, False
            if tag in CONTAINERS:
                if ends:
                    while opened[tag]:  # a stray end tag closes nothing
                        inner, _ = stack.pop()
                        opened[inner] -= 1
                        if inner == tag:
                            break
                elif not attributes.endswith("/"):
                    stack.append((tag, zone_of(tag, attributes, stack[-1][1] if stack else 0)))
                    opened[tag] += 1
                zone = stack[-1][1] if stack else 0
    add(page[at:])
    close()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    words = np.array([w for _, _, w, _ in found], float)
    share = np.minimum(1, np.array([n for *_, n in found], float) / words)
    before, after = (lambda v: np.concatenate([[0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0]]))
    x = np.column_stack([[z for _, z, _, _ in found], words, share, before(words), before(share), after(words), after(share)])
    keep = tree().predict(x) >= 0.5
    return " ".join(text for (text, *_), k in zip(found, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch["html"]]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For every row of ``pages``: page_id, url, text (main text, "" if there is none), n_chars (code points).

    Null and empty pages have no text. Unclosed and stray tags are read as browsers would as far as containers
    go; a head, and an unread element without an end tag, ends at the next block-level tag; text outside all tags is a block. Repeated rows are read each on its own. Nothing is shuffled.
    """
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
        F.coalesce(col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
