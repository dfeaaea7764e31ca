"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block-level tag ends a line. A line's weight is its text length
without what is in links, and nothing where links make up most of it. Lines that follow one
another in one container are a run, and weights are summed over windows that slide along each
run: a surge, where the sum rises over a threshold, opens a stretch, together with the lines
right before it; a dive to zero closes it. Stretches are then held against the heaviest: those
of half its weight, or of ``ENOUGH``, are the main text, and with them what stands between two
of them. Short menus, notices and footers in containers of their own neither surge nor weigh
enough, whatever their tags and classes say.

Tags and class words are hints. A line in an article or main element weighs twice as much, which
is less than a surge for a short one. Elements that are something else by their tag (menus,
forms, scripts and the like) have no lines; those that are by a word of their class, id or role
have none either, unless they hold the article or most of the page's text.

A page is read in one pass, in time proportional to its length whatever its markup. Everything
happens in a page's row: map side only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedloom.sources.html import _CLOSES_P, _P_SCOPE, _SAME_LEVEL

WINDOW = 3
SURGE = 60  # characters in a window
ENOUGH = 4 * SURGE  # of a stretch, however heavy the heaviest is
SHARE = 0.5  # of the heaviest stretch
TAGGED = 2  # how much more a letter weighs in an article or main element
LINKED = 0.5  # share of a line's text in links from which it counts as navigation

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split())
SKIPPED = frozenset(
    "script style noscript template head nav header footer aside form button select textarea iframe object svg canvas "
    "dialog menu".split())
CONTAINERS = frozenset("article aside div footer form header main nav section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
# Words of class, id and role that mark a part as something other than the article, where a whole
# token of the list is made of them and of words for place and shape: cookie-notice, left-sidebar,
# not has-sidebar or search-page.
PARTS = frozenset(
    "breadcrumb breadcrumbs contentinfo footer menu modal nav "
    "navbar navigation newsletter notice popup promo promoted related search share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget complementary alert".split())
# What readers add and what sellers and consent tools do; it is the main text only of a page with
# nothing else.
TALK = frozenset(
    "ad ads advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus reply replies "
    "respond".split())
# Only outside an article; inside, they hold its title.
HEADINGS = frozenset("banner header masthead".split())
SHAPES = frozenset(
    "area bar bottom box button buttons container form inner item items left link links list main post posts primary right secondary "
    "section site slot top wrap wrapper".split())
CLOSES_P = _CLOSES_P | {"center", "dialog", "hgroup", "summary"}
# An opening tag up to its end. Values in quotes may hold anything; nothing is tried twice.
_OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_SPACE = re.compile(r"\s+")


@lru_cache(4096)
def _part(marks: str, article: bool) -> str:
    """What the words say an element is: a "part", "talk", or nothing."""
    for token in marks.lower().split():
        words = {w for w in re.split(r"[_-]+", token) if w}
        for kind, named in (("talk", TALK), ("part", PARTS if article else PARTS | HEADINGS)):
            if words & named and words <= named | TALK | PARTS | SHAPES:
                return kind
    return ""


class Page:
    """Text segments of a page, read in one pass.

    Open elements lie on a stack, with the places of each name's open ones beside it, so that
    an end tag finds its element at once. A link that ends before what was opened in it loses
    its effect where it lies.
    """

    def __init__(self, html: str) -> None:
        # (text, linked, article, container, part); a segment of None ends a line.
        self.segments: list[tuple[str | None, bool, int, int, int]] = []
        self.parts: list[list] = []  # kind, unlinked letters, whether an article is in it, the part around it
        self.stack: list[list] = []  # tag, hides, article, link, part, container
        self.open: dict[str, list[int]] = defaultdict(list)
        self.hidden = self.article = self.linked = self.articles = self.letters = self.containers = 0
        self.container = [0]
        self.part = [-1]
        self.read(html)
        while self.stack:
            self.pop()

    def add(self, data: str) -> None:
        if data and not self.hidden:
            self.segments.append((data, self.linked > 0, self.articles if self.article else 0, self.container[-1], self.part[-1]))
            if not self.linked:
                self.letters += len(data.strip())

    def end_line(self) -> None:
        if self.segments and self.segments[-1][0] is not None:
            self.segments.append((None, False, 0, 0, 0))

    def pop(self) -> None:
        tag, hides, article, link, part, container = self.stack.pop()
        if link is not None:  # not ended before
            self.open[tag].pop()
        self.hidden -= hides
        self.article -= article
        self.linked -= bool(link)
        if container:
            self.container.pop()
        if part >= 0:
            self.part.pop()
            kind, size, before, around = self.parts[part]
            self.parts[part] = [kind, self.letters - size, self.articles > before, around]

    def close(self, tags, scope=()) -> None:
        """The nearest open one of the tags, unless one of the scope is nearer; a link alone."""
        at = max((self.open[t][-1] for t in tags if self.open[t]), default=-1)
        if at < 0 or any(self.open[t] and self.open[t][-1] > at for t in scope):
            return
        if self.stack[at][0] == "a":
            self.linked -= self.stack[at][3]
            self.stack[at][3] = None
            self.open["a"].pop()
            return
        while len(self.stack) > at:
            self.pop()

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                return self.add(html[at:])
            self.add(html[at:lt])
            mark = html[lt + 1:lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif mark in ("!", "?") and mark:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif mark == "/" and html[lt + 2:lt + 3].isascii() and html[lt + 2:lt + 3].isalpha():
                m = _CLOSE.match(html, lt)
                if not m:  # as below
                    return
                at = m.end()
                tag = m.group(1).lower()
                if tag in BLOCKS:
                    self.end_line()
                self.close({tag}, _P_SCOPE if tag in ("p", "a") else ())
            elif mark.isascii() and mark.isalpha():
                m = _OPEN.match(html, lt)
                if not m:  # a tag without end takes the rest
                    return
                at = self.opened(html, m.group(1).lower(), m.group(2), m.end())
            else:
                self.add("<")
                at = lt + 1

    def opened(self, html: str, tag: str, attrs: str, at: int) -> int:
        """An element begins; gives the place to go on at."""
        if tag in BLOCKS:
            self.end_line()
        if tag in CLOSES_P:
            self.close({"p"}, _P_SCOPE)
        if tag in _SAME_LEVEL:
            self.close(*_SAME_LEVEL[tag])
        if tag == "a":
            self.close({"a"}, _P_SCOPE)
        if tag in VOID:
            return at
        article = tag in ("article", "main")
        hides = tag in SKIPPED and not (tag == "header" and self.article) or bool(_HIDDEN.search(attrs))
        if tag in RAW:  # up to its own end tag, whatever stands between
            end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, at)
            if not hides and tag != "title":
                self.add(html[at:end.start() if end else len(html)])
            return end.end() if end else len(html)
        if attrs.rstrip().endswith("/"):
            return at
        marks = " ".join(a or b or c for a, b, c in _MARK.findall(attrs))
        kind = "" if hides or article or tag in ("html", "body") else _part(marks, self.article > 0)
        part = -1
        if kind:
            part = len(self.parts)
            self.parts.append([kind, self.letters, self.articles, self.part[-1]])
            self.part.append(part)
        container = tag in CONTAINERS and not (tag == "header" and self.article)
        if container:
            self.containers += 1
            self.container.append(self.containers)
        link = tag == "a" and bool(_HREF.search(attrs))
        self.open[tag].append(len(self.stack))
        self.stack.append([tag, hides, article, link, part, container])
        self.hidden += hides
        self.articles += article and not self.article
        self.article += article
        self.linked += link
        return at

    def shown(self) -> list[bool]:
        """Which parts are not hidden, by their own words or by those of a part around them: a
        word does not hide an element that holds the article or main tag, or most of the page's
        unlinked text."""
        out = []
        tagged = any(s[0] is not None and s[2] for s in self.segments)
        for kind, size, holds, around in self.parts:
            most = 2 * size > self.letters if kind == "part" else not tagged and self.letters - size < SURGE
            out.append((bool(holds) or size >= SURGE and most) and (around < 0 or out[around]))
        return out


def lines_of(html: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Text lines; the length of each outside links; whether it lies in an article or main
    element; and the number of its container."""
    page = Page(html)
    shown = page.shown()
    lines, unlinked, inside, container = [], [], [], []
    text, plain, first = [], [], None
    for data, linked, article, box, part in [*page.segments, (None, False, 0, 0, 0)]:
        if data is None:
            line = _SPACE.sub(" ", unescape("".join(text))).strip()
            if line:
                lines.append(line)
                unlinked.append(len(_SPACE.sub(" ", unescape("".join(plain))).strip()))
                inside.append(first[0])
                container.append(first[1])
            text, plain, first = [], [], None
        elif part < 0 or shown[part]:
            text.append(data)
            if not linked:
                plain.append(data)
            if first is None and data.strip():
                first = (article > 0, box)
    return lines, np.array(unlinked, np.int64), np.array(inside, bool), np.array(container, np.int64)


def stretches(weight: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and the dive that follows it.

    ``sums[i]`` is the weight of the lines from i to i + window - 1. A stretch opens at a line
    with weight whose sum reaches the threshold, and closes before the first line of a window
    without any.
    """
    n = len(weight)
    total = np.append(0, np.cumsum(weight))
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    kept, on = np.zeros(n, bool), False
    for i in range(n):
        on = on and sums[i] > 0 or sums[i] >= surge and weight[i] > 0
        kept[i] = on
    return kept


def chosen(weight: np.ndarray, container: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines are main text, by their weights and containers."""
    n = len(weight)
    kept = np.zeros(n, bool)
    found: list[tuple[int, int, float]] = []  # stretches: first line, line after the last, weight
    starts = np.flatnonzero(np.append(True, container[1:] != container[:-1])) if n else []
    for a, b in zip(starts, [*starts[1:], n]):
        on = stretches(weight[a:b], window, surge)
        i = a
        while i < b:
            if not on[i - a]:
                i += 1
                continue
            j = i
            while j < b and on[j - a]:
                j += 1
            first = i
            while first > a and weight[first - 1] > 0 and not (found and first <= found[-1][1]):  # the rise to the surge
                first -= 1
            found.append((first, j, float(weight[first:j].sum())))
            i = j
    least = min(SHARE * max((w for _, _, w in found), default=0), ENOUGH)
    good = [(a, b) for a, b, w in found if w >= least]
    if good:
        kept[good[0][0]:good[-1][1]] = True
    else:  # a page of a few words
        kept = weight > 0
    return kept & (weight > 0)


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Kept lines, joined by an empty line. Empty without any."""
    lines, unlinked, inside, container = lines_of(html)
    if not lines:
        return ""
    length = np.array([len(x) for x in lines])
    weight = np.where(unlinked < LINKED * length, 0, unlinked) * np.where(inside, TAGGED, 1)
    return "\n\n".join(x for x, k in zip(lines, chosen(weight, container, window, surge)) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW,
            surge: int = SURGE) -> DataFrame:
    """One row a page: id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text. Repeated rows and null ids are kept, other
    columns are not read. Pages are read whole.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h or "", window, surge) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return pages.select(id_col, url_col, F.col(html_col).cast("string")).mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
