"""HTML extraction by line-block distribution.

Markup is stripped to one line of text per block, without scripts, styles, menus,
headers, footers, asides and forms (elements that say what they are). A line weighs as
many letters and digits as it has outside links. The weights are summed over sliding
windows of lines; text begins at a surge point, where the window sum rises from zero,
and ends at a dive point, where it falls to zero again: so a menu or a list of links
parts two regions, while a paragraph that is one link, between others, parts nothing.
A region is main text if its sum comes above the page's threshold: zero where the page
has an article or main element, in which all weight then lies, else a tenth of the
mean window that has any weight.

Class, id and role are judged by the distribution too. The lines of an element with a
furniture name (sidebar, ad, comments) are left out as long as the rest of the page has
a window above a fifth of the median of all windows. If it has none, the element that
holds most of the text is a wrapper, whatever its name, and its lines come back.

Time is linear in the page: a quote that is never closed, or a raw element that is
never closed, is looked for once.

Defined results: null html gives an empty text; a page without any block gives an
empty text; an unclosed comment, script or style runs to the end of the page; where
quotes do not close before the end, tags end at the next ">"; repeated rows each give
their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from lithos.llm.common import bounded, project, spread

#: Lines in a window of the distribution.
WINDOW = 3
#: Share of the mean window that a region must come above on a page without article and main.
SURGE = 0.1
#: Share of the median window that the page must come above without the lines of furniture names.
LEFT_OVER = 0.2
#: Least weight of an element with a furniture name that can turn out a wrapper.
WRAPPER = 40
#: Elements that hold this share of what the largest of them holds turn out wrappers together.
MOST = 0.9

# Element names of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg canvas select title".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset label".split())
# Words of class, id and role that mark page furniture, wherever they stand in a name.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner sidebar menu nav "
    "navbar navigation navigational breadcrumb breadcrumbs footer comment comments commentlist commentform disqus cookie cookies consent "
    "newsletter popup modal overlay pagination pager toolbar copyright complementary contentinfo".split()
)
# Words that mark it only as the first or last word of a name.
FURNITURE_EDGE = frozenset(
    "header masthead topbar side reply replies respond notice notices alert alerts subscribe subscription signup login share sharing social "
    "related recommended widget widgets search form dialog".split()
)
#: Words that do not mark furniture inside an article: its title can stand there.
HEADS = frozenset("header masthead topbar".split())

# Words of names that mark the comments of readers.
COMMENTS = frozenset("comments commentlist commentform disqus respond replies".split())

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*+)")
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MUTE = re.compile(r"[\W_]+")

NAMED, READERS, DEAD = 1, 2, 3


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """The markup of a page: start, end, element (empty for comments and declarations), whether it closes, attributes."""
    pos, last = 0, page.rfind(">")
    quotes = True  # until one is found that never closes
    unclosed: set[str] = set()
    lower = None
    while (m := _OPEN.search(page, pos)) and m.start() < len(page):
        start, pos = m.start(), m.end()
        if not m[2]:
            mark = "-->" if page.startswith("<!--", start) else ">"
            at = page.find(mark, pos)
            pos = len(page) if at < 0 else at + len(mark)
            yield start, pos, "", False, ""
            continue
        if pos > last:  # no markup ends any more
            return
        tail = _QUOTED.match(page, pos) if quotes else None
        if tail:
            attrs, pos = tail[1], tail.end()
        else:
            quotes = False
            at = page.find(">", pos)
            attrs, pos = page[pos:at], at + 1
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing and not attrs.endswith("/"):
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            at = -1 if tag in unclosed else lower.find(f"</{tag}", pos)
            if at >= 0:
                gt = page.find(">", at)
                pos = len(page) if gt < 0 else gt + 1
            elif tag in ("script", "style"):
                pos = len(page)
            else:
                unclosed.add(tag)
            yield start, pos, "", False, ""
            continue
        yield start, pos, tag, closing, attrs


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    """What an element's attributes say: 0, or NAMED as furniture, as READERS' comments, or hidden (DEAD)."""
    if tag in ("html", "body", "main") or not attrs:
        return 0
    if _HIDDEN.search(attrs):
        return DEAD
    for value in _MARK.findall(attrs):
        for name in value.strip("\"'").split():
            words = _WORD.findall(_CAMEL.sub("-", name).lower())
            if not words or words[0] in ("no", "has", "with"):
                continue
            if not COMMENTS.isdisjoint(words):
                return READERS
            edge = {words[0], words[-1]} - (HEADS if in_article else frozenset())
            if not FURNITURE.isdisjoint(words) or not FURNITURE_EDGE.isdisjoint(edge):
                return NAMED
    return 0


class _Line(NamedTuple):
    text: str
    weight: int
    scoped: bool
    heading: bool
    #: The innermost element with a furniture name that the line stands in, or -1.
    name: int


class _Page:
    """The lines of a page, and the elements with furniture names."""

    def __init__(self, page: str) -> None:
        self.lines: list[_Line] = []
        self.kinds: list[int] = []
        self.parents: list[int] = []  # the next outer element with a furniture name, or -1
        self._parts: list[str] = []
        self._plain: list[str] = []
        self._name = -1
        scope: list[str] = []  # open article and main elements
        furniture: list[list] = []  # open furniture: [element, depth, number or None where nothing counts]
        link, heading, pos = 0, False, 0

        def add(text: str) -> None:
            if text and not (furniture and furniture[-1][2] is None):
                name = furniture[-1][2] if furniture else -1
                if name != self._name:
                    self._end(bool(scope), heading)
                    self._name = name
                raw = _html.unescape(text)
                self._parts.append(raw)
                if not link:
                    self._plain.append(raw)

        for start, end, tag, closing, attrs in _tags(page):
            add(page[pos:start])
            pos = end
            if not tag:
                continue
            if tag in BLOCK:
                self._end(bool(scope), heading)
                heading = not closing and tag in _HEADINGS
            elif tag == "br":
                add("\n")
            kind = 0 if closing else self._furniture(tag, attrs, bool(scope))
            if furniture:
                top = furniture[-1]
                if not closing and tag in ("article", "main") and not scope and not kind:
                    # what was never closed ends where the article begins; names are judged by what they hold
                    furniture = [f for f in furniture if f[2] is not None]
                elif closing and tag in ("article", "main", "body", "html") and tag in (*scope, "body", "html"):
                    furniture.clear()
                elif tag == top[0]:
                    top[1] += -1 if closing else (tag not in VOID)
                    if top[1] <= 0:
                        furniture.pop()
                    if closing or top[2] is None:
                        continue
                elif top[2] is None:
                    continue
            if closing:
                if tag in ("article", "main") and tag in scope:
                    del scope[len(scope) - 1 - scope[::-1].index(tag) :]
                elif tag == "a":
                    link = max(0, link - 1)
            elif kind and tag not in VOID and not attrs.endswith("/"):
                number = None
                if kind != DEAD:
                    number = len(self.kinds)
                    self.kinds.append(kind)
                    self.parents.append(next((f[2] for f in reversed(furniture) if f[2] is not None), -1))
                if furniture and tag == furniture[-1][0]:
                    furniture[-1][1] -= 1  # counted by the inner element from here on
                furniture.append([tag, 1, number])
            elif tag in ("article", "main"):
                scope.append(tag)
            elif tag == "a":
                link += 1
        add(page[pos:])
        self._end(bool(scope), heading)

    @staticmethod
    def _furniture(tag: str, attrs: str, in_article: bool) -> int:
        if tag in BOILER and not (tag == "header" and in_article):
            return NAMED if tag == "form" else DEAD  # whole pages stand in a form
        return _kind(tag, attrs, in_article)

    def _end(self, scoped: bool, heading: bool) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                weight = len(_MUTE.sub("", "".join(self._plain)))
                self.lines.append(_Line(text, weight, scoped, heading, self._name))
        self._parts, self._plain = [], []


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def window_sums(weights: list[int]) -> list[int]:
    """The weight of each line and of the WINDOW - 1 lines before it."""
    sums, run = [], 0
    for i, weight in enumerate(weights):
        run += weight - (weights[i - WINDOW] if i >= WINDOW else 0)
        sums.append(run)
    return sums


def _active(page: _Page) -> list[_Line]:
    """The lines outside furniture; an element with such a name is none if the page has no text to speak of without it."""
    lines, parents = page.lines, page.parents
    whole = [s for s in window_sums([x.weight for x in lines]) if s]
    enough = LEFT_OVER * median(whole) if whole else 0
    mass = [0] * len(parents)
    for x in lines:
        if x.name >= 0:
            mass[x.name] += x.weight
    for n in range(len(parents) - 1, -1, -1):  # an inner element has a greater number
        if parents[n] >= 0:
            mass[parents[n]] += mass[n]
    back = [False] * len(parents)
    while True:
        text = []  # whether an element's own lines count
        for n, parent in enumerate(parents):
            text.append(back[n] and (parent < 0 or text[parent]))
        rest = [x for x in lines if x.name < 0 or text[x.name]]
        if max(window_sums([x.weight for x in rest]), default=0) > enough:
            return rest
        story = any(x.scoped and x.weight and not x.heading for x in rest)
        open_ = [n for n in range(len(parents)) if not back[n] and not (story and page.kinds[n] == READERS)]
        most = max((mass[n] for n in open_), default=0)
        if most < WRAPPER:
            return rest
        for n in open_:
            if mass[n] >= MOST * most:
                back[n] = True


def main_text(page: str | None) -> str:
    """The main text of one page; blocks joined by a newline, empty if there is none."""
    lines = _active(_Page(page)) if page else []
    scoped = any(x.scoped and x.weight for x in lines)
    weights = [x.weight if x.scoped or not scoped else 0 for x in lines]
    sums = window_sums(weights)
    mean = sum(sums) / max(1, sum(s > 0 for s in sums))
    least = 0.0 if scoped else SURGE * mean
    kept: list[str] = []
    first: int | None = None
    for i, total in enumerate([*sums, 0]):
        if first is None and total > 0:  # surge
            first = i
        elif first is not None and (total == 0 or i == len(sums)):  # dive: the last weight is WINDOW lines back at most
            if max(sums[first:i]) > least:
                past = max(k for k in range(first, i) if weights[k])
                kept.extend(x.text for x in lines[first : past + 1] if x.scoped or not scoped)
            first = None
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text)."""
    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = spread(project(pages, page_id="long", url="string", html="string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
