"""Main text of web pages (operator 7).

Method. Events of the standard library's streaming parser cut a page into lines at block borders. A line's
ratio is its text length over its tags; ratios are smoothed by a Gaussian over neighbouring lines, and lines
above a threshold taken from the page's own spread, smoothed and by themselves (or a headline), cluster as
content. These clusters select the regions: the
deepest container that holds all content lines, and every article and main element that holds some, are
returned whole, so that a short paragraph between long ones is kept, less the parts that are boilerplate by
element, role or class: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments.
Unmarked link lists, bars and teaser cards beside the clusters are thus left out by their ratio alone, and a
block of less than ``STRAY`` characters beside articles by its place; what
lies between content and bears no mark is kept. A class or id counts if all its words are known ones (a word of
adverts or consent counts beside any others), ids of headings and paragraphs do not,
and neither does a mark on an element that holds most of the page's content (see ``_marked``): so a form round
the whole page, as generated sites have it, is a container like any other, and a form in the page is left out.

Each page is handled alone: no exchange, and memory is one Arrow batch. Line breaks count as white space.

Cases: null or empty html gives an empty text; text without any tag is content; a page without content lines
gives whatever is not boilerplate; unclosed and stray tags, comments and unknown declarations are tolerated;
repeated rows, null ids and empty tables need nothing; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
SIGMA = 1.5
REACH = 4
THRESHOLD = 0.5
BODY = 400
STRAY = 160

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "head title script style noscript template nav header footer aside button select textarea input iframe object "
    "embed svg canvas menu dialog datalist audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: A class or id marks boilerplate if all its words are among these two sets, one of CLASS_WORDS first or last.
CLASS_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav "
    "navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social recommended "
    "comment comments commentlist reply replies respond disqus toolbar pagination pager skip".split()
)
LAYOUT_WORDS = frozenset(
    "area bar bottom box button buttons block column container footer global group holder inner item items left line link links list "
    "main outer overlay page panel primary right secondary section site slot top unit wrap wrapper".split()
)
#: One of these anywhere in a class or id marks an advert, a notice of consent or links elsewhere, unless the element holds much.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr onetrust newsletter".split())
#: So do these two together: "related" alone names a part of an article as often.
ELSEWHERE = (frozenset(["related", "recommended"]), frozenset("posts articles stories news links items products videos".split()))
ADVERT_STARTS = ("advert", "adsby", "adslot")
MUCH = 0.2
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
BODIES = frozenset("html body main article".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
BARRIERS = frozenset("table ul ol dl div article section main body aside nav header footer form blockquote".split())
CONTAINERS = frozenset("body main article section div td blockquote".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is boilerplate by its tag or role, whatever it holds."""
    if tag in BOILERPLATE:
        return True
    return tag not in BODIES and any(name == "role" and value and value.strip().lower() in ROLES for name, value in attrs)


def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """Kind of an element that is marked as boilerplate: "form", "advert", "comments", "other" or None."""
    if tag in BODIES:
        return None
    if tag == "form":
        return "form"
    for name, value in attrs:
        if value and (name == "class" or name == "id" and tag not in TEXT_TAGS):
            for one in value.split():
                words = [w.lower() for w in _TOKENS.findall(one)]
                if any(w in ADVERT_WORDS or w.startswith(ADVERT_STARTS) for w in words) or all(x & set(words) for x in ELSEWHERE):
                    return "advert"
                if not words or not (words[0] in CLASS_WORDS or words[-1] in CLASS_WORDS):
                    continue
                if words[:2] == ["skip", "to"] or all(w in CLASS_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in words):
                    return "comments" if COMMENT_WORDS & set(words) else "other"
    return None


class Lines(HTMLParser):
    """Page to lines: (text, tags, innermost container, boilerplate, innermost mark, headline).

    Containers and marks (elements with the class or id of boilerplate) are numbered, parents first.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.kinds: list[str] = [""]
        self.parents: list[int] = [0]  # container 0 is the page
        self.marks: list[tuple[str, int]] = [("", 0)]  # kind and parent; mark 0 is none
        self.stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]
        self.open: Counter[str] = Counter()
        self.buffer: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                _, skip, inside, mark = self.stack[-1]
                self.lines.append((text, self.tags, inside, skip, mark, self.open["h1"] > 0))
                self.tags = 0

    def _cut(self, k: int) -> None:
        """Close the elements from place k of the stack on."""
        for name, *_ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def _close(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``tag``, unless an element of ``stop`` lies above it."""
        if self.open[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._cut(k)
                return
            if self.stack[k][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        elif tag in INLINE:
            if tag not in VOID:
                self._push(tag, attrs)
        else:
            self._flush()
            for other in CLOSES.get(tag, ("p",)):
                self._close(other, BARRIERS)
            if tag not in VOID:
                self._push(tag, attrs)

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, skip, inside, mark = self.stack[-1]
        now = skip or is_boilerplate(tag, attrs)
        kind = None if now else mark_of(tag, attrs)
        if now != skip or kind:
            self._flush()
        if kind:
            self.marks.append((kind, mark))
            mark = len(self.marks) - 1
        if tag in CONTAINERS:
            self.parents.append(inside)
            inside = len(self.kinds)
            self.kinds.append("main" if ("role", "main") in attrs else tag)
        self.stack.append((tag, now, inside, mark))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
        elif tag not in INLINE:
            self._flush()
            self._close(tag)
        elif self.open[tag] > 0:
            for k in range(len(self.stack) - 1, 0, -1):
                name, skip, _, mark = self.stack[k]
                if name == tag:
                    if (skip, mark) != (self.stack[k - 1][1], self.stack[k - 1][3]):
                        self._flush()
                    self._cut(k)
                    return
                if name not in INLINE:
                    return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown marked section counts as a comment
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)


def smoothed(values: list[float]) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(values)):
        span = [(kernel[k + REACH], values[i + k]) for k in range(-REACH, REACH + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in span) / sum(w for w, _ in span))
    return out


def extract(html: str | None) -> str:
    """The page's main text, blocks joined by one line feed."""
    if not html:
        return ""
    parser = Lines()
    # behind the last ">" no tag can end; the parser would try each "<" there anew, in quadratic time
    cut = html.rfind(">") + 1
    parser.feed(html[:cut])
    parser.close()
    if parser.cdata_elem is None:
        parser.handle_data(unescape(html[cut:].partition("<!--")[0]))
    parser._flush()
    lines = parser.lines
    own = [len(text) / max(1, tags) for text, tags, *_ in lines]
    ratios = smoothed(own)
    mean = sum(ratios) / max(1, len(ratios))
    limit = THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in ratios) / max(1, len(ratios)))
    # smoothing lifts a menu beside a long paragraph over the threshold, but its own ratio stays below
    content = [line for line, ratio, plain in zip(lines, ratios, own, strict=True) if not line[3] and ratio >= limit and (plain >= limit or line[5])]
    out = _marked(lines, content, parser.marks, parser.kinds, parser.parents)
    inside = _regions([line for line in content if not out[line[4]]], parser.kinds, parser.parents)
    return "\n".join(text for text, _, container, skip, mark, _ in lines if not skip and not out[mark] and inside[container])


def _marked(lines: list, content: list, marks: list[tuple[str, int]], kinds: list[str], parents: list[int]) -> list[bool]:
    """For each mark, whether its lines are boilerplate.

    A mark does not count on an element that holds most of the page's content, unless an article or main element
    outside has text: then the element must have ``BODY`` characters of content and twice those of the article.
    A form must moreover hold an article's text or ``BODY`` characters. A mark of adverts does not count either
    where the element holds all that the page's articles have, or, on a page without any, a share of ``MUCH``.
    Marks of comments do not count where there is no other content.
    """
    body = [False] * len(kinds)
    for c in range(1, len(kinds)):
        body[c] = kinds[c] in ("article", "main") or body[parents[c]]
    held, bodies = [0] * len(marks), [0] * len(marks)
    for text, _, _, _, mark, _ in content:
        held[mark] += len(text)
    for text, _, container, skip, mark, _ in lines:
        bodies[mark] += len(text) * (body[container] and not skip)
    for m in range(len(marks) - 1, 0, -1):
        held[marks[m][1]] += held[m]
        bodies[marks[m][1]] += bodies[m]
    out, commented = [False] * len(marks), [False] * len(marks)
    for m in range(1, len(marks)):
        kind, parent = marks[m]
        outside = bodies[0] - bodies[m]
        most = held[m] * 2 > held[0] and (outside == 0 or (held[m] >= BODY and outside * 2 < held[m]))
        if kind == "form":
            most = most and (bodies[m] > 0 or held[m] >= BODY)
        elif kind == "advert":
            most = most or (bodies[m] == bodies[0] > 0) or (bodies[0] == 0 and held[m] > MUCH * held[0] and held[m] >= BODY)
        out[m] = out[parent] or (kind != "comments" and not most)
        commented[m] = commented[parent] or kind == "comments"
    if content and all(out[line[4]] or commented[line[4]] for line in content):
        return out
    return [a or b for a, b in zip(out, commented, strict=True)]


def _regions(content: list, kinds: list[str], parents: list[int]) -> list[bool]:
    """For each container, whether it lies in a region that is returned whole."""
    held = [0] * len(kinds)
    for text, _, container, *_ in content:
        held[container] += len(text)
    for c in range(len(kinds) - 1, 0, -1):
        held[parents[c]] += held[c]
    chosen = {c for c in range(len(kinds)) if kinds[c] in ("article", "main") and (held[c] or not held[0])}
    within = [False] * len(kinds)
    for c in range(1, len(kinds)):
        within[c] = c in chosen or within[parents[c]]
    own = [0] * len(kinds)
    for text, _, container, *_ in content:
        own[container] += len(text) * within[container]
    for c in range(len(kinds) - 1, 0, -1):
        own[parents[c]] += own[c]
    if own[0] and held[0] - own[0] < STRAY:
        held = own  # what lies beside the articles is too little to belong to them
    chosen.add(max(c for c in range(len(kinds)) if held[c] == held[0]) if held[0] else 0)
    inside = [False] * len(kinds)
    for c in range(len(kinds)):
        inside[c] = c in chosen or (c > 0 and inside[parents[c]])
    return inside


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).cast("long"), F.col(url_column).cast("string"), F.col(html_column).cast("string"))
    return rows.mapInArrow(run, SCHEMA)
