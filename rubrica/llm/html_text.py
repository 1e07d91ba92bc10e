"""Main text of web pages by text-to-tag ratios.

The standard library's parser is fed the page once; its events build lines,
one for each block element, and count the tags met. A line's ratio is the
number of its characters outside links for each tag, times the weight of the
element that it lies in: 1, or 0 in elements that hold no article text (menus,
footers, asides, forms), or NAMED where a class, id or role names such a part.
Ratios are smoothed with a Gaussian over runs of lines of the same weight and
article. Two clusters of the smoothed levels set the threshold: lines that
reach it are seeds, and regions of the page are chosen by their seeds alone,
whatever they are called.

A region takes in the other lines of weight 1 of its container, such as
headings and short paragraphs. The container is the page's article or main
element, if these hold at least half of the seeds; else the element
around all seeds and around the other text beside them that isn't mostly links.

Names only weigh: they never say anything of an article, a main element or a
heading, and a name around more than WHOLE of an article's text, or of the
page's where no article stands beside it, is passed over. Boilerplate elements
inside a line lose their text, the line stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import bound_batches

#: Elements whose boundaries end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown, or not as text.
HIDDEN = frozenset("script style head noscript template svg math object iframe canvas audio video map title".split())
#: Elements that hold no article text: weight 0.
BOILERPLATE = frozenset("nav footer aside form button select textarea menu dialog fieldset label".split())
#: Of these, the ones that some pages put around everything.
WRAPPERS = frozenset(("form", "fieldset", "dialog"))
#: Words in class, id and role attributes that name such parts.
MARKED = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?<!without[_-])"
    r"(?:ads?|adverts?|advertisements?|advertising|ad(?:box|slot|unit|sense)|adsbygoogle|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|cookie(?:bar|banner|consent|notice)|gdpr|consent|notices?|alerts?|alertdialog|dialog|popup|modal|overlay|toast|paywall"
    r"|comments?(?![_-](?:open|closed|off|on)\b)|comment(?:list|section|area)|respond|replies|disqus|nav|(?:top|sub|side|main|left|right|site)nav|nav(?:bar|links)|navigation|navi|menu|menubar|breadcrumbs?|sidebar|rail|widgets?|(?:site|page)?footer|masthead|topbar|toolbar"
    r"|related|recommend(?:ed|ations)?|trending|outbrain|taboola|share|sharing|social|subscribe|newsletter|signup|login|search|form|pagination|pager|contentinfo|complementary|skip|copyright)(?:$|[\s_-])"
)
#: The same outside of an article, whose own header bears its title.
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:site|page)?header(?:$|[\s_-])")
_HUMP = re.compile(r"([a-z0-9])([A-Z])")
#: The weight of lines in an element that a name marks.
NAMED = 0.02
#: A name around more than this share of the text around it marks nothing.
WHOLE = 0.75
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that can hold a whole article; the empty name is the page.
CONTAINERS = frozenset(("", "html", "body", "main", "article", "section", "div", "center", "td"))
#: Containers that are the whole page.
PAGE = frozenset(("", "html", "body"))
#: Elements whose text belongs to the article even directly in the page, where bare text of a box is often a site's name or imprint.
PROSE = HEADINGS | {"p", "blockquote", "pre", "li", "dt", "dd"}
#: Containers of which one on the page names the article.
MAIN = frozenset(("article", "main"))
#: Elements of which names say nothing.
NAMELESS = HEADINGS | MAIN | PAGE
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag ends where their own end tag may be left out.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What marks an element: nothing, its kind, a name, or a name that counts outside of articles.
PLAIN, KIND, NAME, HEADER = range(4)


class Line:
    __slots__ = ("at", "tags", "parts")

    def __init__(self, at: int, tags: int = 0):
        self.at, self.tags = at, tags  # the number of the innermost block, and tags met
        self.parts: list[tuple[str, int, bool]] = []  # text, innermost element, whether in a link


class Page(HTMLParser):
    """Builds lines and a tree of elements from parser events. Children have larger numbers than their parents; 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.mark = [""], [0], [PLAIN]
        self.open: list[tuple[str, int, bool]] = []  # element, its number, hidden
        self.links = 0  # open a elements
        self.lines: list[Line] = []
        self.line = Line(0)

    def end_line(self) -> None:
        at = self.open[-1][1] if self.open else 0
        if any(not p[0].isspace() for p in self.line.parts):
            self.lines.append(self.line)
            self.line = Line(at)
        else:  # its tags count for the next line
            self.line = Line(at, self.line.tags)

    def leave(self, i: int) -> None:
        """Closes the elements of the stack from the i-th on."""
        self.links -= sum(x[0] == "a" for x in self.open[i:])
        del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES:
            self.close_implied(_CLOSES[tag])
        elif tag in BLOCKS:
            self.close_implied(("p",))
        if tag in VOID:
            self.line.tags += 1
            if tag == "br":
                self.line.parts.append((" ", self.open[-1][1] if self.open else 0, False))
            elif tag == "hr":
                self.end_line()
            return
        hidden, at = (self.open[-1][2], self.open[-1][1]) if self.open else (False, 0)
        mark, hidden = KIND if tag in BOILERPLATE else HEADER if tag == "header" else PLAIN, hidden or tag in HIDDEN
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                hidden = hidden or tag not in PAGE
            elif v and mark != KIND and tag not in NAMELESS and k in ("class", "id", "role"):
                words = _HUMP.sub(r"\1-\2", v).lower()
                mark = NAME if MARKED.search(words) else HEADER if OUTSIDE.search(words) else mark
        self.links += tag == "a"
        self.tags.append(tag)
        self.parent.append(at)
        self.mark.append(mark)
        self.open.append((tag, len(self.tags) - 1, hidden))
        if tag in BLOCKS:
            self.end_line()
        self.line.tags += 1

    def close_implied(self, tags: tuple[str, ...]) -> None:
        """Ends the nearest of ``tags`` that is open inside the current block."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.leave(i)
                self.end_line()
                return
            if self.open[i][0] in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                block = any(x[0] in BLOCKS for x in self.open[i:])
                self.leave(i)
                if block:
                    self.end_line()
                return

    def handle_data(self, data: str) -> None:
        at, hidden = self.open[-1][1:] if self.open else (0, False)
        if not hidden:
            self.line.parts.append((data, at, self.links > 0))

    def finish(self) -> None:
        self.close()
        self.end_line()

    def weights(self) -> tuple[list[float], list[int]]:
        """(weight, article or main element around it, or 0) of each element."""
        n = len(self.tags)
        own, size, mains = [0] * n, [0] * n, [t in MAIN for t in self.tags]
        for line in self.lines:
            for text, at, linked in line.parts:
                if not linked:
                    own[at] += len(text.strip())
        out = [False] * n  # in an element that never holds an article
        for k in range(1, n):
            out[k] = out[self.parent[k]] or self.mark[k] == KIND and self.tags[k] not in WRAPPERS
            size[k] = 0 if out[k] else own[k]
        size[0] = own[0]
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            mains[self.parent[k]] += mains[k]
        weight, box = [1.0] * n, [0] * n
        for k in range(1, n):
            tag, mark, w, b = self.tags[k], self.mark[k], weight[self.parent[k]], box[self.parent[k]]
            if tag == "main" and not out[k]:
                w = 1.0  # what is said around it is about its neighbours
            if mark == KIND or mark == NAME or mark == HEADER and not b:
                around = size[k] > WHOLE * size[b] and (b > 0 or mains[k] == mains[0])
                if not (around and (mark != KIND or tag in WRAPPERS) and tag != "header"):
                    w = min(w, NAMED if mark == NAME else 0.0)
            if tag in MAIN and w == 1.0 and not b:
                b = k
            weight[k], box[k] = w, b
        return weight, box


def smooth(ratios: np.ndarray, sigma: float, runs: list[int]) -> np.ndarray:
    """Gaussian smoothing of each run of the given lengths; the ends of a run repeat."""
    r = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    cuts = np.cumsum(runs)[:-1]
    return np.concatenate([np.convolve(np.pad(x, r, mode="edge"), kernel, "valid") for x in np.split(ratios, cuts)])


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters, by Lloyd's steps from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all() or not upper.any():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def container(tags: list[str], parent: list[int], seeds: set[int], plain: set[int]) -> tuple[int, set[int]]:
    """(number, its descendants and itself): the smallest container of all seeds, or a larger one up to the page if it holds more plain text.

    ``seeds`` and ``plain`` are the elements of seeds and of lines of weight 1 that aren't mostly links.
    """
    n_seeds, n_plain = [0] * len(tags), [0] * len(tags)
    for at in seeds:
        n_seeds[at] += 1
    for at in plain:
        n_plain[at] += 1
    for n in range(len(tags) - 1, 0, -1):
        n_seeds[parent[n]] += n_seeds[n]
        n_plain[parent[n]] += n_plain[n]
    found = max((n for n in range(len(tags)) if tags[n] in CONTAINERS and n_seeds[n] == n_seeds[0]), default=0)
    up = found
    while tags[up] not in PAGE:
        if tags[up] in CONTAINERS and n_plain[up] > n_plain[found]:
            found = up
        up = parent[up]
    inside = {found}
    for n in range(found + 1, len(tags)):
        if parent[n] in inside:
            inside.add(n)
    return found, inside


def measured(page: Page) -> tuple[list[str], list[int], list[float], list[int], list[float], list[bool]]:
    """Of each line with text: the text, its block, weight, article, ratio, and whether it is mostly links."""
    weight, box = page.weights()
    texts, ats, weights, boxes, ratios, linked = [], [], [], [], [], []
    for line in page.lines:
        w = weight[line.at]
        # boilerplate inside the line goes where it arrives
        parts = [p for p in line.parts if weight[p[1]] >= w] if w else line.parts
        text = _SPACE.sub(" ", "".join(p[0] for p in parts)).strip()
        if not text:
            continue
        in_links = min(len(text), sum(len(p[0].strip()) for p in parts if p[2]))
        texts.append(text)
        ats.append(line.at)
        weights.append(w)
        boxes.append(box[line.at])
        ratios.append(w * (len(text) - in_links) / max(1, line.tags))
        linked.append(2 * in_links > len(text))
    return texts, ats, weights, boxes, ratios, linked


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks, joined by newlines; empty if there are none."""
    page = Page()
    page.feed(html or "")
    page.finish()
    texts, ats, weights, boxes, ratios, linked = measured(page)
    full = np.array(weights) == 1.0
    ratio = np.array(ratios)
    if not ratio.any() or not full.any() and not MAIN.isdisjoint(page.tags):
        return ""
    level = smooth(ratio, sigma, [len(list(g)) for _, g in groupby(zip(weights, boxes, strict=True))])
    seeds = level >= threshold(level)
    held = np.array([b > 0 for b in boxes])
    if 2 * (seeds & held).sum() >= seeds.sum():
        chosen = {b for b, s in zip(boxes, seeds, strict=True) if s and b}
        kept = (full | seeds) & np.array([b in chosen for b in boxes])
    else:
        plain = full & ~np.array(linked)
        found, inside = container(page.tags, page.parent, {at for at, s in zip(ats, seeds, strict=True) if s}, {at for at, c in zip(ats, plain, strict=True) if c})
        whole = page.tags[found] not in PAGE
        where = np.flatnonzero(seeds)
        first, last = where[0], where[-1]
        while first and page.tags[ats[first - 1]] in HEADINGS:
            first -= 1
        # beside the seeds, lines of the same container belong to it, and so does prose directly in the page, unless they are mostly links
        between = np.arange(len(texts))
        beside = np.array([whole and at in inside or page.tags[at] in PROSE for at in ats])
        kept = seeds | full & ((first <= between) & (between <= last) | plain & beside)
    return "\n".join(t for t, k in zip(texts, kept, strict=True) if k)


def extract_text(pages: DataFrame, sigma: float = 1.0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row, from its whole page.

    A null or empty page has an empty text. Ids and urls may be null or
    repeat; each row stands for itself. n_chars counts code points. Other
    columns are ignored; an empty table gives an empty one. One narrow stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text((h.as_py() or b"").decode("utf-8", "replace"), sigma) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    slim = bound_batches(pages).select(F.col(id_col), F.col("url"), F.col(html_col).cast("binary").alias("_html"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
