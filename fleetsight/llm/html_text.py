"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: a line ends at every block tag,
with its characters, its tags and the blocks it stands in.  A line's ratio is its characters
per tag; the ratios along the page are smoothed with a Gaussian and split into two clusters by
the threshold between their means.  Lines of the upper cluster are content; the content region
reaches from its first line to its last and over lines in the containers of content, so that short
paragraphs of an article stay; an article element around content is the region itself.  Blocks that hold no article text by
their meaning (menus, scripts, asides) are never content.  Forms and blocks whose class, id or role
names them so (comments, adverts) are none either, unless they hold an article, a main element,
an h1 or most of the page's characters.

Defined cases: null and empty pages, and pages without content, give an empty text; a page
that is one bare text is its own content; null ids and addresses are kept; rows that repeat are
judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm import packed as P
from fleetsight.llm.frames import batch, query, read, scan

# Element names of the HTML standard by their use here.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("""head script style noscript template iframe object svg math canvas audio video button select
    textarea datalist nav footer aside menu dialog search""".split())
RAW = frozenset(("script", "style"))
#: An opening tag of these closes an open paragraph.
CLOSES_P = BLOCKS - frozenset("br body html head title caption tbody td tfoot th thead tr option optgroup legend summary".split())
#: An open element on the left ends where one on the right begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Class, id or role, or the last part of one, that mark blocks beside the article.
BESIDE = frozenset("""ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb
    breadcrumbs sidebar aside footer comment comments disqus reply replies respond cookie cookies consent notice gdpr
    popup modal newsletter subscribe signup login search share sharing social related recommended toolbar pagination pager
    complementary contentinfo dialog alert masthead topbar skip""".split())
#: Those of them that mark what readers write; an article element in such a block is a comment.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
CONTAINERS = frozenset("article main section div body".split())


@dataclass
class Line:
    home: int                      # number of the container the line stands in
    article: bool
    silent: bool
    heading: bool
    text: list[str] = field(default_factory=list)
    tags: int = 0
    beside: int = -1               # number of the innermost block around it that looks to be beside the article


@dataclass
class Beside:
    """A block whose name says that it stands beside the article."""
    around: int                    # number of the next such block around it, always a smaller one; -1 without
    comments: bool                 # it or one around it holds comments
    holds: bool = False            # it holds what only the article's surroundings hold


class Lines(HTMLParser):
    """Lines of a page, as the parser's events come."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int, int]] = []    # name, silent, in article, container, block beside
        self.opened: Counter = Counter()                     # open elements by name
        self.named: list[Beside] = []
        self.lines: list[Line] = []
        self.homes = 0
        self._next()

    def _next(self) -> None:
        name, silent, article, home, around = self.open[-1] if self.open else ("", False, False, 0, -1)
        self.line = Line(home, article, silent, any(o[0] in ("h1", "h2", "h3") for o in self.open[-3:]), beside=around)
        self.lines.append(self.line)

    def _leave(self, at: int) -> None:
        block = any(o[0] in BLOCKS or o[1] or o[4] >= 0 for o in self.open[at:])
        self.opened.subtract(o[0] for o in self.open[at:])
        del self.open[at:]
        if block:
            self._next()

    def _last(self, names, within=CONTAINERS) -> int:
        if not any(self.opened[n] for n in names):
            return -1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                return i
            if self.open[i][0] in within:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("body", "html") and self.opened[tag]:
            return
        if tag == "body":
            self._leave(next((i for i, o in enumerate(self.open) if o[0] == "head"), len(self.open)))
        if tag in CLOSES_P and (at := self._last(("p",))) >= 0:
            self._leave(at)
        for name, by in ENDS.items():
            if tag in by and (at := self._last((name,), ("ul", "ol", "dl", "table", "select"))) >= 0:
                self._leave(at)
        _, silent, article, home, around = self.open[-1] if self.open else ("", False, False, 0, -1)
        comments = around >= 0 and self.named[around].comments
        article = article or tag == "main" or ("role", "main") in attrs or (tag == "article" and not comments)
        beside = tag in SILENT or (tag == "header" and not article) or _hidden(attrs)
        if around >= 0 and not (silent or beside) and (tag in ("main", "h1") or ("role", "main") in attrs or (
                tag == "article" and not comments)):
            self.named[around].holds = True
        words = set() if tag in ("html", "body", "article", "main", "h1", "h2") else _beside(attrs)
        named = tag == "form" or bool(words)
        if tag in CONTAINERS:
            self.homes += 1
            home = self.homes
        if tag in VOID:
            if tag in BLOCKS:
                self._next()
            self.line.tags += 1
            return
        if named:
            self.named.append(Beside(around, comments or not COMMENTS.isdisjoint(words)))
            around = len(self.named) - 1
        self.opened[tag] += 1
        self.open.append((tag, silent or beside, article, home, around))
        if tag in BLOCKS or beside or named:
            self._next()
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "a", "b", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag == "br":
            self._next()
        if not self.opened[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._leave(i)
                return
            if tag not in BLOCKS and self.open[i][0] in CONTAINERS:
                return

    def handle_data(self, data: str) -> None:
        if not self.line.silent and self.lasttag_raw():
            return
        self.line.text.append(data)

    def close(self) -> None:
        if self.rawdata.startswith("<!"):      # a comment that the page never closes
            self.rawdata = ""
        super().close()

    def lasttag_raw(self) -> bool:
        return bool(self.open) and self.open[-1][0] in RAW


def _beside(attrs: list) -> set[str]:
    """Words of class, id and role that mark a block beside the article."""
    found = set()
    for name, value in attrs:
        for token in value.lower().split() if name in ("class", "id", "role") and value else ():
            found |= {token, re.split(r"[^a-z]+", token.rstrip("0123456789-_"))[-1]} & BESIDE
    return found


def _silence(lines: list[Line], texts: list[str], named: list[Beside]) -> None:
    """Silence the lines of blocks beside the article.  A block stays if it holds an article, main or h1 or
    most of the characters; one of comments only if it holds main or h1."""
    inside = [0] * len(named)
    most = 0
    for line, text in zip(lines, texts):
        if not line.silent:
            most += len(text)
            if line.beside >= 0:
                inside[line.beside] += len(text)
    for i in range(len(named) - 1, -1, -1):
        up = named[i].around
        if up >= 0:
            inside[up] += inside[i]
            named[up].holds |= named[i].holds
    silent = [False] * len(named)
    for i, b in enumerate(named):
        silent[i] = (not b.holds and (b.comments or 2 * inside[i] <= most)) or (b.around >= 0 and silent[b.around])
    for line in lines:
        line.silent = line.silent or (line.beside >= 0 and silent[line.beside])


def _hidden(attrs: list) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") or
               (name == "style" and value and re.search(r"display\s*:\s*none", value.lower())) for name, value in attrs)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the ends repeat."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, "edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """Middle between the means of the two clusters of the values' logarithms."""
    v = np.log1p(values)
    cut = (v.min() + v.max()) / 2
    for _ in range(rounds):
        low, high = v[v <= cut], v[v > cut]
        if not len(high):
            return -1.0
        new = (low.mean() + high.mean()) / 2
        if new == cut:
            break
        cut = new
    return float(np.expm1(cut))


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article of a page, its blocks in order joined by a space."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = []
    for line in parser.lines:
        text = " ".join("".join(line.text).split())
        if text:
            lines.append((line, text))
    if not lines:
        return ""
    _silence([line for line, _ in lines], [text for _, text in lines], parser.named)
    ratio = np.array([0.0 if line.silent else len(text) / max(1, line.tags) for line, text in lines])
    flat = smoothed(ratio, sigma)
    loud = np.array([not line.silent for line, _ in lines])
    if not loud.any():
        return ""
    cut = threshold(flat)
    content = loud & (flat > cut)
    if not content.any():
        content = loud
    if any(line.article for (line, _), c in zip(lines, content) if c):
        # An article element around content is the region.
        keep = [line.article and not line.silent for line, _ in lines]
    else:
        # Smoothing carries a long line's ratio to its neighbours; the region begins and ends at lines of its own ratio.
        core = content & ((ratio > cut) | np.array([line.heading for line, _ in lines]))
        core = core if core.any() else content
        homes = {line.home for (line, _), c in zip(lines, core) if c}
        first, last = np.flatnonzero(core)[[0, -1]]
        keep = [not line.silent and (first <= i <= last or line.home in homes) for i, (line, _) in enumerate(lines)]
    return " ".join(text for (_, text), k in zip(lines, keep) if k)


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in P.grouped(batches, 4 << 20):
            found = [main_text(h or "", sigma) for h in b.column("text").to_pylist()]
            yield batch(page_id=b.column("page_id"), url=b.column("url"), text=pa.array(found, pa.string()),
                        n_chars=pa.array([len(f) for f in found], pa.int64()))

    return scan(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                             F.col("html").cast("string").alias("text")),
                work, "page_id long, url string, text string, n_chars long")


@query("op6_html_extraction")
def op6(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
