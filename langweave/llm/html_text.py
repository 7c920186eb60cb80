"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element; what markup itself names as beside the point (menus, page headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) leaves an empty line. Over the lines' text lengths,
lines of links counting nothing, slide windows of a few lines: where a sum surges past a threshold text begins, where it
dives to nothing text ends. Only lines of such spans stay. The spans also tell where the article is: in the innermost
``article`` or ``main`` elements around their lines, and within these each run of lines between two dives stays that has a
surge; or else in the innermost container that holds the prose of all spans. Work is local to the row and linear in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from langweave.llm.batches import text_rows
from langweave.llm.columns import whole

WINDOW_LINES = 3
SURGE_CHARS = 86

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
DROPPED_TAGS = frozenset(
    "head script style noscript template svg math iframe object canvas audio video map nav footer aside button "
    "select textarea dialog menu".split()
)
# Blocks that hold a passage, never an article.
PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd tr td th blockquote pre figure figcaption".split())
RAW_TEXT = frozenset(("script", "style"))
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
# Words of class or id tokens that name what is beside the article,
BESIDE = re.compile(
    r"ad|ads|adv|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|"
    r"sidebar|aside|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|masthead|topbar|footer|copyright|"
    r"comments?|commentlist|replies|reply|respond|disqus|widgets?|toolbar|login|search|skip|hidden|header|legal|"
    r"disclaimer|teasers?"
)
# and words that say no more than where or what kind of block that is. A token names furniture if it has a word of the
# first kind and none beyond these two.
PLAIN = re.compile(
    r"site|page|global|main|primary|secondary|top|bottom|left|right|side|inner|outer|box|bar|block|area|section|wrap|"
    r"wrapper|container|list|item|items|links?|buttons?|icons?|form|col|column|row|panel|group|slot|unit|space|holder|"
    r"post|posts|article|articles|entry|story|stories|thread|desktop|mobile|sticky|fixed|js|is|the|\d+|[a-z]"
)
# Words that name the article's own parts where they come with one of these, as in "article-header".
PARTS = re.compile(r"header|side|legal|disclaimer|teasers?")
OWN = re.compile(r"article|post|entry|story|content|main|body|text")
# Of the words above, those that name a block of its own even on an article, and class tokens that tell of a page or an
# article what it has, lacks or is filed under.
APART = re.compile(r"related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|sponsor\w*|promo\w*")
ABOUT = re.compile(
    r"(has|have|no|not|with|without|is|category|cat|tag|type|format|status)[-_].*|.*[-_](with|without|has|no)[-_].*|"
    r".*[-_](open|opened|closed|enabled|disabled|on|off)",
    re.IGNORECASE,
)
# What ends a sentence or parts it: prose has such marks, a list of sections has none.
PROSE = re.compile(r"[.!?;:\u2026\u3002\uff01\uff1f\u061f\u0964]")
PARTED = re.compile(r"[|\u2022\u00b7\u00bb\u203a\u00a9]")
HEAD_TAGS = frozenset("title meta link base script style noscript template".split())
# An open element of the left kind ends where one of the right kind starts.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
LISTS = frozenset(("ul", "ol", "dl", "table", "select", "menu"))


@dataclass
class Element:
    tag: str
    number: int
    dropped: bool
    heading_only: bool = False


@dataclass(eq=False)
class Line:
    at: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def length(self) -> int:
        """The text's length; a line that is mostly links belongs to a list of links and has none of its own."""
        return 0 if 2 * self.linked > len(self.text) else len(self.text)


def is_beside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Does the markup itself say that the element is no part of an article?"""
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    return attributes.get("role", "") in DROPPED_ROLES


def furniture(tag: str, attributes: dict[str, str]) -> str:
    """``apart`` or ``beside`` where a whole class or id token names furniture (or for a form), else nothing."""
    if tag in ("html", "body", "main"):
        return ""
    found = "beside" if tag == "form" else ""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        if ABOUT.fullmatch(name):
            continue
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)]
        named = [w for w in words if BESIDE.fullmatch(w)]
        if not named or not all(BESIDE.fullmatch(w) or PLAIN.fullmatch(w) for w in words):
            continue
        if all(PARTS.fullmatch(w) for w in named) and any(OWN.fullmatch(w) for w in words):
            continue
        if any(APART.fullmatch(w) for w in named):
            return "apart"
        found = "beside"
    return "" if tag == "article" else found


class LineReader(HTMLParser):
    """Turns a page into lines. Elements get numbers in page order; a line has that of its block, an element its parent's."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = [Element("", 0, False)]
        self.is_open: Counter[str] = Counter()
        self.parents, self.tags = [0], [""]
        # Block elements that class words or a form's tag name as furniture, and how.
        self.kinds: dict[int, str] = {}
        self.lines: list[Line] = []
        self.current: Line | None = None

    def _break(self) -> None:
        if self.current is not None:
            self.current.text = " ".join("".join(self.current.parts).split())
            self.current.parts = []
            self.lines.append(self.current)
        self.current = None

    def _close_to(self, at: int) -> None:
        if any(e.tag not in INLINE for e in self.open[at:]):
            self._break()
        for element in self.open[at:]:
            self.is_open[element.tag] -= 1
        del self.open[at:]

    def _close(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._close_to(at)
                return

    def _imply_ends(self, tag: str) -> None:
        # The end tag of head may be left out: it ends where something starts that a head can't hold.
        if self.is_open["head"] and tag not in HEAD_TAGS and not self.is_open["template"] and not self.is_open["noscript"]:
            self._close("head")
        if tag in INLINE:
            return
        for at in range(len(self.open) - 1, 0, -1):
            own = self.open[at].tag
            if own == "p" or tag in ENDED_BY.get(own, ()):
                self._close_to(at)
                return
            if own not in INLINE and (own in LISTS or own not in ENDED_BY):
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        self._imply_ends(tag)
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        above = self.open[-1]
        in_article = any(self.is_open[t] for t in ARTICLE_TAGS)
        attributes = {name: value or "" for name, value in attrs}
        number = len(self.tags)
        dropped = above.dropped or is_beside(tag, attributes, in_article)
        self.parents.append(above.number)
        self.tags.append(tag)
        if not dropped and (kind := furniture(tag, attributes)):
            # Within a line, a word or two of an advert or a button; blocks are judged when the page is read.
            if tag in INLINE:
                dropped = True
            else:
                self.kinds[number] = kind
        own_header = tag == "header" and in_article
        heading_only = (above.heading_only or own_header) and tag not in HEADINGS
        self.open.append(Element(tag, number, dropped, heading_only))
        self.is_open[tag] += 1
        if dropped and not above.dropped and tag not in INLINE:
            self.lines.append(Line(above.number))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in RAW_TEXT:
            return
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.is_open[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._close_to(at)
                return
            # An end tag of an inline element doesn't reach out of its block.
            if tag in INLINE and self.open[at].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        # Text in a head without an end tag starts the body.
        if self.open[-1].tag == "head" and data.strip():
            self._close("head")
        above = self.open[-1]
        if above.dropped or above.heading_only:
            return
        if self.current is None:
            if not data.strip():
                return
            self.current = Line(next(e.number for e in reversed(self.open) if e.tag not in INLINE))
        self.current.parts.append(data)
        if self.is_open["a"]:
            self.current.linked += len(data.strip())

    def read(self, html: str) -> list[Line]:
        self.feed(html)
        self.close()
        self._break()
        return self.lines


def windows(lengths: list[int]) -> list[int]:
    """The sum of the lengths in the window that starts at each line."""
    return [sum(lengths[i : i + WINDOW_LINES]) for i in range(len(lengths))]


def spans_of_text(lengths: list[int]) -> list[tuple[int, int]]:
    """Line-block distribution: the line ranges (end exclusive) between a surge and the next dive."""
    sums = windows(lengths)
    spans, start = [], None
    for i, total in enumerate(sums):
        if start is None and total > SURGE_CHARS:
            start = i
        if start is not None and total == 0:
            spans.append((start, i))
            start = None
    if start is not None:
        spans.append((start, len(lengths)))
    if not spans and any(lengths):
        # A page of short lines only: the fullest window is its text.
        at = max(range(len(sums)), key=lambda i: (sums[i], -i))
        spans.append((at, min(at + WINDOW_LINES, len(lengths))))
    return spans


def runs_with_surge(lengths: list[int]) -> list[tuple[int, int]]:
    """The line ranges between two dives in which there is a surge; all lines if there is none."""
    sums, runs, start = windows(lengths), [], 0
    for i, total in enumerate([*sums, 0]):
        if total == 0:
            if start < i and max(sums[start:i]) > SURGE_CHARS:
                runs.append((start, i))
            start = i + 1
    return runs or [(0, len(lengths))]


def _sums(reader: LineReader, of_lines: list[tuple[int, int]]) -> list[int]:
    """For each element the sum of (element, amount) over itself and what it holds."""
    total = [0] * len(reader.tags)
    for at, amount in of_lines:
        total[at] += amount
    for number in range(len(total) - 1, 0, -1):
        total[reader.parents[number]] += total[number]
    return total


def without_furniture(reader: LineReader, lines: list[Line]) -> list[Line]:
    """The lines, those of elements that class words or a form's tag name as furniture one empty line for each element.

    Such a word drops nothing that the lines themselves tell to be the page's text: where no long line and no text of an
    article remains, the named elements that each hold more than half of the long lines (of all text, if there are none)
    wrap the page and are read. Blocks that are apart from any article, as comments are, are never read.
    """
    inside = _inside(reader, ARTICLE_TAGS)
    # For each element the outermost dropped one around it, with and without those that wrap the page.
    apart = _outermost(reader, {n for n, kind in reader.kinds.items() if kind == "apart"})
    dropped = _outermost(reader, set(reader.kinds))
    remains = [line for line in lines if line.text and not dropped[line.at]]
    if reader.kinds and not any(line.length > SURGE_CHARS or inside[line.at] for line in remains):
        own = [line for line in lines if not apart[line.at]]
        long = [(line.at, line.length) for line in own if line.length > SURGE_CHARS]
        held = _sums(reader, long or [(line.at, line.length) for line in own])
        dropped = _outermost(
            reader, {n for n, kind in reader.kinds.items() if kind == "apart" or 2 * held[n] <= held[0]}
        )
    out: list[Line] = []
    last = 0
    for line in lines:
        by = dropped[line.at]
        if by and by == last:
            continue
        last = by
        out.append(Line(reader.parents[by]) if by else line)
    return out


def _outermost(reader: LineReader, chosen: set[int]) -> list[int]:
    """For each element the outermost of ``chosen`` around it, or itself; 0 without one."""
    found = [0] * len(reader.tags)
    for number in range(1, len(found)):
        found[number] = found[reader.parents[number]] or (number if number in chosen else 0)
    return found


def _inside(reader: LineReader, tags: frozenset[str]) -> list[int]:
    """For each element the innermost one around it, or itself, with one of ``tags``; 0 without one."""
    found = [0] * len(reader.tags)
    for number in range(1, len(found)):
        found[number] = number if reader.tags[number] in tags else found[reader.parents[number]]
    return found


def _of_articles(reader: LineReader, lines: list[Line], holders: set[int]) -> list[Line]:
    """The lines of ``holders`` in runs of text: what a dive parts from all of it goes."""
    outer = _outermost(reader, holders)
    kept: set[int] = set()
    places: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        if outer[line.at]:
            places.setdefault(outer[line.at], []).append(i)
    for own in places.values():
        for start, end in runs_with_surge([lines[i].length for i in own]):
            kept.update(own[start:end])
    return [line for i, line in enumerate(lines) if i in kept]


def _of_container(reader: LineReader, lines: list[Line], spans: list[tuple[int, int]]) -> list[Line]:
    """Lines in the innermost container around all prose of the spans, in the runs of it that have a surge.

    Where that is the page itself, furniture may stand beside the prose: before its first and after its last line only
    headings and blocks like those of the prose (of the same tag and parent) stay. The line before a container stays if
    it is short and of the container's kind, as a title may be.
    """
    inside = [line for start, end in spans for line in lines[start:end] if line.length]
    long = [line for line in inside if line.length > SURGE_CHARS]
    marked = [line for line in inside if PROSE.search(line.text)]
    prose = [line for line in marked if line.length > SURGE_CHARS] or marked or long or inside
    # A container holds other elements with lines; one that holds a passage only is none, whatever its tag.
    containers = set()
    for line in lines:
        at = reader.parents[line.at] if line.text else line.at
        while at and at not in containers:
            containers.add(at)
            at = reader.parents[at]
    held = _sums(reader, [(line.at, 1) for line in prose])
    holder = max(
        (n for n in range(len(held)) if held[n] == len(prose) and reader.tags[n] not in PASSAGES and n in containers),
        default=0,
    )
    within = _outermost(reader, {holder}) if holder else [1] * len(reader.tags)
    own = [line for line in lines if within[line.at]]
    kept = [line for start, end in runs_with_surge([line.length for line in own]) for line in own[start:end] if line.length]
    if reader.tags[holder] in ("", "html", "body") and prose is not inside:
        alike = {(reader.tags[line.at], reader.parents[line.at]) for line in prose}
        marks = {id(line) for line in prose}
        places = [i for i, line in enumerate(kept) if id(line) in marks]
        return [
            line
            for i, line in enumerate(kept)
            if places[0] <= i <= places[-1]
            or reader.tags[line.at] in HEADINGS
            or (reader.tags[line.at], reader.parents[line.at]) in alike
        ]
    # A container that begins with a heading has its title inside; a line of parted words is a list of sections.
    entered = next(i for i, line in enumerate(inside) if within[line.at])
    before = inside[entered - 1 : entered]
    if before and kept and reader.tags[kept[0].at] not in HEADINGS:
        title = before[0]
        alike = (reader.tags[title.at], reader.parents[title.at]) == (reader.tags[holder], reader.parents[holder])
        if alike and title.length <= SURGE_CHARS and not PARTED.search(title.text):
            return [title, *kept]
    return kept


def main_text(html: str) -> str:
    """The article of a page: blocks in page order, white space runs inside one as a space, two line feeds between."""
    reader = LineReader()
    lines = without_furniture(reader, reader.read(html))
    spans = spans_of_text([line.length for line in lines])
    if not spans:
        return ""
    inside = [line for start, end in spans for line in lines[start:end] if line.length]
    articles = _inside(reader, ARTICLE_TAGS)
    if articles[max(inside, key=lambda line: len(line.text)).at]:
        kept = _of_articles(reader, lines, {articles[line.at] for line in inside} - {0})
    else:
        kept = _of_container(reader, lines, spans)
    return "\n\n".join(line.text for line in kept if line.text)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its main text and that text's code points.

    A null or empty page has an empty text, as has a page without an article. A page that is cut off ends where it
    ends. Null ids and urls are passed through, repeated rows extracted each; other columns are not read. Empty tables
    give an empty result.
    """
    columns = pages.select("page_id", "url", whole("html").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kept = [pages.schema["page_id"], pages.schema["url"]]
    added = [StructField("text", StringType()), StructField("n_chars", LongType())]
    return text_rows(columns).mapInArrow(read, StructType(kept + added))
