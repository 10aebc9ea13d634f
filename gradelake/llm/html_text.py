"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by the role they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s "
    "samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video "
    "button select textarea option datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog header".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words of class, id and role names that mark what is not the article ...
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "sidebar side rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination "
    "pager header masthead topbar toolbar footer bottombar comment comments commentlist disqus reply "
    "replies respond discussion notice notices alert cookie cookies consent gdpr disclaimer popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations more teaser tags tagcloud search complementary contentinfo "
    "skip hidden".split())
# ... and of those that mark the article.
CONTENT_NAMES = frozenset(
    "article post entry story main content articlebody postbody storybody entrycontent".split())
# Names that an article's own sections have as well ...
COMMON_NAMES = frozenset("discussion side more skip".split())
# ... those of reader comments ...
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
# ... and words that say nothing beside a name of either kind.
NEUTRAL = frozenset(
    "area article articles bar blog block body box btn button card cards col column container content count entry "
    "form global group holder icon inner item items left link links list main module outer page panel post posts "
    "primary region right row secondary section site slot text thread title top bottom unit wp wrap wrapper zone".split())
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


HARD, STRONG, WEAK = 3, 2, 1


def _tokens(attrs: dict[str, str | None]) -> list[set[str]]:
    """The words of every class, id and role name."""
    joined = " ".join(attrs.get(k) or "" for k in ("class", "id", "role"))
    return [set(_NAME.findall(_CAMEL.sub(" ", token).lower())) for token in joined.split()]


def _suspicion(tokens: list[set[str]]) -> int:
    """Whether names mark what is not the article: by themselves, or in a compound with other words."""
    level = 0
    for words in tokens:
        if words & BOILERPLATE_NAMES:
            plain = words - COMMON_NAMES <= BOILERPLATE_NAMES | NEUTRAL and bool(words & BOILERPLATE_NAMES - COMMON_NAMES)
            level = max(level, STRONG if plain else WEAK)
    return level


class Line:
    """A block's text, the tags met while reading it, and the elements it stands in."""

    __slots__ = ("parts", "tags", "path", "heading")

    def __init__(self, path: tuple[int, ...], heading: bool) -> None:
        self.parts: list[str] = []
        self.tags, self.path, self.heading = 0, path, heading

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class LineReader(HTMLParser):
    """Turns parser events into lines: one per block, in page order.

    Elements are numbered. ``suspects`` has those that may stand outside the article, with
    how strongly their tag or name says so; ``content`` those that are marked as article.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, number, silent, heading of an article
        self.lines: list[Line] = []
        self.content: set[int] = set()
        self.suspects: dict[int, int] = {}
        self.comments: set[int] = set()
        self.headers: set[int] = set()
        self.line: Line | None = None
        self.tags, self.count = 0, 0

    def _flag(self, at: int) -> bool:
        return bool(self.stack) and self.stack[-1][at]

    def _break(self) -> None:
        if self.line is not None:
            self.lines.append(self.line)
        self.line = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._break()
        self.tags += 1
        if self.line is not None:
            self.line.tags += 1
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        if tag not in INLINE:
            self._close_paragraph(tag)
        named = dict(attrs)
        tokens = _tokens(named)
        names = set().union(*tokens)
        inside = any(number in self.content for _, number, _, _ in self.stack)
        self.count += 1
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (
            named.get("style") or "").replace(" ", "").lower()
        level = 0 if tag in ("html", "body") else _suspicion(tokens)
        if hidden:
            self.suspects[self.count] = HARD
        elif tag in BOILERPLATE:
            self.suspects[self.count] = STRONG
        elif level and tag not in CONTENT:
            self.suspects[self.count] = level
        if names & COMMENT_NAMES:
            self.comments.add(self.count)
        if tag == "header":
            self.headers.add(self.count)
        clean = not names & BOILERPLATE_NAMES
        if tag in CONTENT or (names & CONTENT_NAMES and clean and self.count not in self.suspects):
            self.content.add(self.count)
        heading = tag in HEADINGS and inside and clean
        self.stack.append((tag, self.count, self._flag(2) or tag in SILENT, self._flag(3) or heading))

    def _close_paragraph(self, tag: str) -> None:
        """A block ends an open paragraph; list items and table cells end their like."""
        ends = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"),
                "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
        wanted = ends.get(tag, ("p",))
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in wanted:
                del self.stack[i:]
                return
            if name not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in INLINE and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        self.tags += 1
        if self.line is not None:
            self.line.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return  # an inline end does not close blocks

    def handle_data(self, data: str) -> None:
        if self._flag(2):
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(tuple(number for _, number, _, _ in self.stack), self._flag(3))
            self.line.tags, self.tags = self.tags, 0
        self.line.parts.append(data)


def read_lines(html: str) -> tuple[list[tuple[str, float, Line]], LineReader]:
    """(text, text-to-tag ratio, line) per line with text, and what the reader knows of the elements."""
    reader = LineReader()
    reader.feed(html)
    reader.close()
    reader._break()
    lines = [(x.text(), x) for x in reader.lines]
    return [(t, len(t) / max(1, x.tags), x) for t, x in lines if t], reader


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights are renormalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        w = weights[low - i + reach:high - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[low:high])) / sum(w))
    return out


def split_level(values: list[float]) -> float:
    """The level between two clusters of values: means are refined until they stay."""
    low, high = min(values), max(values)
    while True:
        level = (low + high) / 2
        below, above = [v for v in values if v < level], [v for v in values if v >= level]
        if not below or not above:
            return level
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            return level
        low, high = new


def _outside(lines: list[tuple[str, float, Line]], upper: set[int], reader: LineReader) -> set[int]:
    """The suspect elements that do stand outside the article.

    A name in a compound with other words counts only where the element's own text-to-tag
    ratio is below half of the upper cluster's. An element that holds most of the upper cluster is no suspect if
    the article lies in it, or if no article is marked elsewhere and it is not one of comments.
    """
    suspects, content = reader.suspects, reader.content
    if not suspects:
        return set()
    chars: dict[int, int] = {}
    tags: dict[int, int] = {}
    high: dict[int, int] = {}
    usual = sum(lines[i][1] for i in upper) / max(1, len(upper))
    holds: set[int] = set()
    total, elsewhere = 0, False
    for i, (text, _, line) in enumerate(lines):
        seen = [n for n in line.path if n in suspects]
        # an article within two suspects speaks for both, a comment in an article for none
        last = max((n for n in line.path if n in content and n not in reader.comments), default=0)
        first = min((n for n in line.path if n in content), default=0)
        elsewhere = elsewhere or (first and not any(n < first for n in seen))
        for n in seen:
            chars[n] = chars.get(n, 0) + len(text)
            tags[n] = tags.get(n, 0) + line.tags
            if n < last:
                holds.add(n)
        if i in upper and not any(suspects[n] == HARD for n in seen):
            total += len(text)
            for n in seen:
                high[n] = high.get(n, 0) + len(text)
    out = set()
    for n, level in suspects.items():
        if level != HARD and 2 * high.get(n, 0) > total and (n in holds or not (elsewhere or n in reader.comments)):
            continue
        if level == WEAK and 2 * chars.get(n, 0) >= usual * max(1, tags.get(n, 0)):
            continue
        out.add(n)
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """Blocks of the article, joined by two line feeds.

    Lines are clustered by their smoothed text-to-tag ratio. Every marked content element
    (article, main, or named so) that holds a line of the upper cluster, or a quarter as much
    text as the largest, is a region; each line of the regions counts that stands in no boilerplate element. Tags and names say
    what is boilerplate, but never against the ratio of what holds most of the text. A page without a
    marked element keeps the lines from the first to the last of the cluster.
    """
    lines, reader = read_lines(html or "")
    if not lines:
        return ""
    ratios = smooth([r for _, r, _ in lines], sigma)
    level = split_level(ratios)
    high = {i for i, ratio in enumerate(ratios) if ratio >= level}
    out = _outside(lines, high, reader)

    def stands_in(line: Line) -> bool:
        return not any(n in out and not (line.heading and n in reader.headers) for n in line.path)

    inside = [i for i, (_, _, line) in enumerate(lines) if stands_in(line)]
    upper = [i for i in inside if i in high] or inside
    outermost = {
        i: next((n for n in lines[i][2].path if n in reader.content), 0) for i in inside}
    mass: dict[int, int] = {}
    for i in inside:
        mass[outermost[i]] = mass.get(outermost[i], 0) + len(lines[i][0])
    mass.pop(0, None)
    held = {outermost[i] for i in upper}
    regions = {n for n, size in mass.items() if n in held or 4 * size >= max(mass.values())}
    if regions:
        chosen = [i for i in inside if outermost[i] in regions]
    else:
        chosen = [i for i in inside if upper[0] <= i <= upper[-1]]
    return "\n\n".join(lines[i][0] for i in chosen)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["text"] = [main_text(h) for h in batch.pop("html")]
        yield batch


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle.

    Null and empty pages give an empty text; a very long one is read as a whole by the task that
    has its row. Broken markup never fails: unclosed elements
    end with the page, stray end tags are ignored. Repeated rows give repeated results;
    columns other than the id, url and html are not read.
    """
    wanted = pages.select(F.col(id_col).cast("bigint").alias("page_id"), "url", F.col(html_col).alias("html"))
    texts = wanted.mapInPandas(_extract, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
