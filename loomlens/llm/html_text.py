"""Main text of web pages: streaming standard-library parser events become lines
with text and tag counts; the text-to-tag ratio of the lines, smoothed with a
Gaussian and clustered by a threshold, selects content regions.

A line is the text between two block boundaries; a region is all lines whose
nearest sectioning ancestor is the same element. Elements that are boilerplate by
tag, role or class (the word lists below) give no lines. A class of several words
only raises a suspicion (`has-sidebar` may stand on the whole page): a suspect block
goes unless it holds far more prose than all that is above suspicion. Lines whose
smoothed ratio reaches the threshold are the dense cluster; ratios within an article
or main element weigh more. The cluster's text in articles is weighed against that
outside of them: where articles win, they are content with all their lines, short
ones too, from the first to the last dense line's; else the regions of the dense
lines are.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are
closed as browsers do for blocks; marked sections that the parser does not know are
skipped up to `>`, a comment that is not closed runs to the end; an article or main
element ends boilerplate that is never closed, and is a part of boilerplate that is; an
article whose class names a reader's comment or an advert is none; time is in
proportion to the page's length; repeated rows are each extracted; an empty table gives an empty
result; null ids are kept; other columns are not read.

Plan: one narrow pass, no exchange; a worker holds one slice of pages, bounded by
bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Element names and class words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SECTION = set("article main section div body td blockquote".split())
DROPPED = set("head title script style noscript template nav header footer aside form button select textarea menu dialog iframe object svg canvas audio video".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
DROPPED_WORDS = set(
    "ad ads adsense nav navbar navigation menu menus header headers masthead footer footers aside notice notices alert announcement disclaimer consent gdpr respond reply replies modal overlay signup login share sharing social related recommended widget toolbar pagination pager copyright".split()
)
#: Beginnings of class words.
DROPPED_STARTS = tuple("advert banner breadcrumb comment cookie disqus newsletter popup promo sidebar sponsor subscri".split())
#: First words of class names about something else than the element,
#: words that make a header one of the content, and beginnings that leave no doubt.
NOT_ITSELF = set("has have with without no not".split())
TITLES = set("header headers".split())
CONTENT = set("article story post entry content".split())
NEVER_CONTENT = tuple("advert breadcrumb comment cookie disqus newsletter popup promo sponsor subscri".split())
P_ENDS = BLOCK - {"br", "body", "html", "head", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_STOPS = set("ul ol menu dl table".split())
MAIN = {"main": 1, "article": 2}
#: Words behind the first one in class names of single comments and adverts.
PIECES = set("body box card content entry item list post reply text thread".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def boilerplate(tag: str, attrs: dict[str, str | None]) -> int:
    """1: boilerplate; 2: suspect by a class of several words; 0: neither."""
    if tag in DROPPED or (attrs.get("role") or "").lower() in DROPPED_ROLES or "hidden" in attrs:
        return 1
    if tag == "article":  # often with classes about its page (`comments-open`)
        return int(any(_names_piece([w.lower() for w in _WORD.findall(t)]) for t in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()))
    if tag in MAIN or tag in ("body", "html"):
        return 0
    suspect = 0
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in _WORD.findall(token)]
        bad = [w for w in words if w in DROPPED_WORDS or w.startswith(DROPPED_STARTS)]
        if not bad or words[0] in NOT_ITSELF or (TITLES.issuperset(bad) and not CONTENT.isdisjoint(words)):
            continue
        if len(words) == 1 or tag not in BLOCK or any(w.startswith(NEVER_CONTENT) for w in bad):
            return 1
        suspect = 2
    return suspect


def _names_piece(words: list[str]) -> bool:
    """Whether a class name is that of one comment, advert and the like."""
    if not words or words[0] in NOT_ITSELF:
        return False
    behind = all(w in PIECES or w.isdigit() for w in words[1:])
    return words[-1].startswith(NEVER_CONTENT) or (words[0].startswith(NEVER_CONTENT) and behind)


class Line(NamedTuple):
    text: str
    tags: int
    region: int
    level: int  # 1 within the main element, 2 within an article
    linked: float  # share of its text in links
    suspect: int = 0  # number of the innermost suspect block it lies in


class Open(NamedTuple):
    """An element on the stack, with what its content inherits."""

    tag: str = ""
    dropped: int = -1  # position of the outermost boilerplate element around it
    region: int = 0
    main: int = 0  # within main (1) or an article (2)
    link: bool = False
    suspect: int = 0
    paragraph: int = -1  # position of the paragraph that the next block would end


TOP = Open()
_COMMENT_END = re.compile(r"--!?>")


class Comments(HTMLParser):
    """A comment runs to its end, or to that of the page; it is read once."""

    def parse_comment(self, i, report=True):
        raw = self.rawdata
        if raw.startswith(("<!-->", "<!--->"), i):
            return raw.index(">", i) + 1
        end = _COMMENT_END.search(raw, i + 4)
        return end.end() if end else len(raw)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind is a bogus comment up to `>`
            return self.parse_bogus_comment(i)


class Ends(Comments):
    """How many start and end tags of each name a page has."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.starts, self.ends = Counter(), Counter()

    def handle_starttag(self, tag, attrs):
        self.starts[tag] += 1

    def handle_endtag(self, tag):
        self.ends[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.starts[tag] += 1


class Lines(Comments):
    """Events to lines: texts, tags, region of each line, and where it lies. Only
    elements that matter to their content are put on the stack; each step looks at
    elements that it takes off, or at one, so that the time is linear."""

    def __init__(self, ends: Ends | None = None):
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.count: Counter = Counter()  # of open elements by name
        self.starts, self.ends = (ends.starts, ends.ends) if ends else (Counter(), Counter())  # still to come
        self.suspects = [0]  # of each suspect block, the one around it
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags, self.regions, self.linked = 0, 0, 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1] if self.stack else TOP
                self.lines.append(Line(text, self.tags, top.region, top.main, min(1.0, self.linked / len(text)), top.suspect))
                self.tags = 0
            self.parts, self.linked = [], 0

    def pop_to(self, i: int) -> None:
        for x in self.stack[i:]:
            self.count[x.tag] -= 1
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self.starts[tag] -= 1
        block = tag in BLOCK
        if block:
            self.end_line()
        if tag in VOID:
            return
        top = self.stack[-1] if self.stack else TOP
        if tag in MAIN and top.dropped >= 0:
            name = self.stack[top.dropped].tag
            # left open: the end tags to come are not enough for this element
            if name not in ("script", "style", "template", "noscript") and self.ends[name] - max(0, self.starts[name]) < 1:
                self.pop_to(top.dropped)
        if tag in P_ENDS and self.stack and self.stack[-1].paragraph >= 0:
            self.pop_to(self.stack[-1].paragraph)
        if tag in SAME_ENDS and any(self.count[n] for n in SAME_ENDS[tag]):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in SAME_ENDS[tag]:
                    self.pop_to(i)
                    break
                if self.stack[i].tag in LIST_STOPS:
                    break
        kind = boilerplate(tag, dict(attrs))
        if not (block or kind or tag == "a"):
            return
        top = self.stack[-1] if self.stack else TOP
        region, suspect, at = top.region, top.suspect, len(self.stack)
        if tag in SECTION:
            self.regions += 1
            region = self.regions
        if kind == 2:
            self.suspects.append(suspect)
            suspect = len(self.suspects) - 1
        dropped = top.dropped if top.dropped >= 0 else at if kind == 1 else -1
        paragraph = at if tag == "p" else -1 if tag in SECTION or tag in LIST_STOPS else top.paragraph
        self.stack.append(Open(tag, dropped, region, max(top.main, MAIN.get(tag, 0)), top.link or tag == "a", suspect, paragraph))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)  # a slash does not close a block in HTML
        else:
            self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1
        self.ends[tag] -= 1
        if tag in BLOCK:
            self.end_line()
        if not self.count[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.pop_to(i)
                break
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                break  # an inline end tag does not reach out of its block

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else TOP
        if top.dropped < 0:
            self.parts.append(data)
            self.linked += len(data.strip()) if top.link else 0

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        return self.lines


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "full")[radius : radius + len(x)]
    return np.convolve(x, kernel, "full")[radius : radius + len(x)] / weight


def above_suspicion(lines: list[Line], suspects: list[int], links: float, factor: float = 2.0, near: float = 0.5) -> list[Line]:
    """The lines in no suspect block, and those of suspect blocks (outer ones are
    judged first) that are cleared: within articles by a mean line of at least `near` times
    the clear ones' there, outside links; elsewhere, by prose of over `factor` times all that is clear so far."""
    if len(suspects) == 1:
        return lines
    owner, size = np.array([x.suspect for x in lines], int), np.array([len(x.text) for x in lines], float)
    linked, level = np.array([x.linked for x in lines]), np.array([x.level for x in lines], int)
    prose = np.bincount(owner, size * (linked < links), len(suspects))
    plain, count = np.bincount(owner, size * (1 - linked), len(suspects)), np.bincount(owner, minlength=len(suspects))
    inside = np.bincount(owner, level == 2, len(suspects)) > 0
    article = (owner == 0) & (level == 2)
    usual = (size * (1 - linked))[article].sum() / max(1, article.sum())
    clear, total = [True] + [False] * (len(suspects) - 1), prose[0]
    for i, outer in enumerate(suspects):
        if i and clear[outer]:
            dense = inside[i] and usual > 0 and plain[i] / max(1, count[i]) >= near * usual
            clear[i] = bool(not count[i] or dense or prose[i] > factor * total)  # without lines of its own its inner blocks are judged
            total += prose[i] * clear[i]
    return [x for x in lines if clear[x.suspect]]


def runs(keep: np.ndarray, seeds: np.ndarray, gap: int) -> np.ndarray:
    """The runs of `keep` (bridging at most `gap` others) that hold a seed, without the bridges."""
    at = np.flatnonzero(keep)
    out = np.zeros(len(keep), bool)
    for run in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1):
        if len(run) and seeds[run].any():
            out[run] = True
    return out


def content_lines(lines: list[Line], sigma: float, factor: float, prior: float, gap: int, links: float, low: float = 0.02) -> np.ndarray:
    """Which lines lie in a content region."""
    level = np.array([x.level for x in lines])
    size = np.array([len(x.text) for x in lines])
    article = level == max(1, int(level.max()))  # the articles, or else the main element
    region = np.array([x.region for x in lines])
    linked = np.array([x.linked for x in lines])
    prose = linked < links
    ratio = size / np.array([max(1, x.tags) for x in lines])
    smoothed = smooth(ratio * (1 - linked) * np.where(article, prior, np.where(prose, 1.0, 0.0)), sigma)
    dense = smoothed >= factor * smoothed.mean()
    inside, outside = (size[dense & part].sum() for part in (article, ~article & prose))
    if inside and prior * inside >= outside:
        return runs(article & (smoothed >= low * smoothed.mean()), dense, len(lines))
    if inside:  # what is around the articles outweighs them: they count like any other region
        smoothed = smooth(ratio * prose, sigma)
        dense = smoothed >= factor * smoothed.mean()
    keep = np.isin(region, np.unique(region[dense & (prose | ~prose.any())])) & (prose | ~prose.any())
    at = np.flatnonzero(keep)
    for i, j in zip(at, at[1:], strict=False):
        if j - i - 1 <= gap:
            keep[i:j] = True
    return keep


_UNFINISHED = re.compile(r"<[A-Za-z/!?]")


def extract(html: str | None, sigma: float = 1.0, factor: float = 0.5, prior: float = 4.0, gap: int = 2, links: float = 0.8) -> str:
    """factor: the threshold as a multiple of the smoothed ratios' mean; prior:
    weight of ratios within an article or main element; gap: lines between two
    content lines that are content too; links: outside of articles, lines with that
    share of their text in links are no content (unless all are)."""
    if not html:
        return ""
    cut = _UNFINISHED.search(html, html.rfind(">") + 1)
    html = html[: cut.start()] if cut else html  # a tag that the page's end cuts off is no text
    ends = Ends()
    ends.feed(html)
    ends.close()
    parser = Lines(ends)
    parser.feed(html)
    lines = above_suspicion(parser.finish(), parser.suspects, links)
    if not lines:
        return ""
    keep = content_lines(lines, sigma, factor, prior, gap, links)
    return " ".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
