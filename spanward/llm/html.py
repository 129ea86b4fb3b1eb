"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page into lines: what stands between two borders of block elements. A line's
ratio is its characters per tag, links counting against it; ratios are smoothed along the page by a Gaussian, and lines
above a threshold of their spread are clustered into content. The smallest element that holds all lines of the
clusters is the content region, or the outermost <article> or <main> that does, and every line of it that is not
boilerplate by its element is kept, however short: ratios choose the region, they drop nothing inside.

An element that is boilerplate by its class or id only, or a form, is not if it holds most of the page's other text: then
it is a wrapper. One about comments must for that hold all of it, and where an <article> or <main> has text of its own,
only elements inside it can be wrappers.

Defined cases: null or empty html, and pages without text, give empty text; broken nesting, missing end tags and pages
that break off are read as far as they go; repeated rows are pages of their own; null ids and urls are kept; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrow import row_slices

#: Width of the smoothing, in lines, and share of the spread of ratios that a content line needs.
SIGMA = 1.0
THRESHOLD = 0.5
#: Share of a page's text that makes a marked element a wrapper.
WRAPPER = 0.5

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset(
    "aside button canvas dialog fieldset footer form head header iframe input label map menu nav noscript object option script search select style svg template textarea title".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer form gdpr header login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related reply replies "
    "respond search share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Lines(HTMLParser):
    """Lines of a page with their tags, link characters and the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # name, number, boilerplate from here on
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool]] = []
        self.names: dict[int, str] = {}
        self.blamed: dict[int, bool] = {}  # boilerplate by themselves; true: unless they are wrappers
        self.text: list[str] = []
        self.tags = self.links = self.made = 0

    def _border(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            around = tuple(n for _, n, _ in self.stack)
            self.lines.append((words, self.tags, self.links, around, bool(self.stack) and self.stack[-1][2]))
            self.tags = self.links = 0
        self.text = []

    def _pop_to(self, place: int) -> None:
        if any(name in BLOCK for name, _, _ in self.stack[place:]):
            self._border()
        del self.stack[place:]

    def _last(self, names) -> int | None:
        """Place of the nearest open element of these, not looking out of its list or table."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                return i
            if self.stack[i][0] in ("ul", "ol", "dl", "table", "article", "section", "div", "body"):
                return None
        return None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self._border()
            self.text.append(" ")
            return
        if tag in BLOCK:
            self._border()
            place = self._last({"p"})
            if place is not None:
                self._pop_to(place)
            if tag in CLOSES and (place := self._last(set(CLOSES[tag].split()))) is not None:
                self._pop_to(place)
            if tag in ("body", "main", "article"):  # a head, menu or advert that was never closed ends here
                for i, (name, _, bad) in enumerate(self.stack):
                    if bad and not (tag == "article" and name in ("section", "aside", "ol", "ul", "div") and self._comments(i)):
                        self._pop_to(i)
                        break
        self.made += 1
        plain = tag not in ("html", "body", "main")
        if plain and _hidden(attrs) or tag in BOILERPLATE and tag != "form":
            self.blamed[self.made] = False
        elif tag == "form" or plain and _marked(attrs):
            self.blamed[self.made] = True
        bad = bool(self.stack) and self.stack[-1][2] or self.made in self.blamed
        self.names[self.made] = tag
        if _about_comments(attrs):
            self.names[self.made] = "comments"
        self.stack.append((tag, self.made, bad))

    def _comments(self, i: int) -> bool:
        return self.names[self.stack[i][1]] == "comments"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return
        if tag in BLOCK:
            self._border()

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if any(name == "a" for name, _, _ in self.stack[-4:]):
            self.links += len(data)

    def whole(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._border()


def _words(attrs) -> list[str]:
    out = []
    for name, value in attrs:
        if name in ("class", "id") and value:
            out += [w.lower() for w in _PARTS.findall(value)]
    return out


def _hidden(attrs) -> bool:
    """Boilerplate by role or being hidden."""
    given = {n: v for n, v in attrs}
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "")
    return hidden or (given.get("role") or "").lower() in ROLES


def _marked(attrs) -> bool:
    """Boilerplate by class or id."""
    return any(w in MARKS for w in _words(attrs))


def _about_comments(attrs) -> bool:
    return any(w in ("comment", "comments", "commentlist", "disqus", "replies", "respond") for w in _words(attrs))


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _fair(page: _Lines) -> np.ndarray:
    """Lines that stand in no boilerplate; a marked element that holds most of the text is a wrapper."""
    around = [[e for e in line[3] if e in page.blamed] if line[4] else [] for line in page.lines]
    open_ = [i for i, blamed in enumerate(around) if all(page.blamed[e] for e in blamed)]
    held: dict[int, int] = {}
    for i in open_:
        for e in around[i]:
            held[e] = held.get(e, 0) + len(page.lines[i][0])
    total = sum(len(page.lines[i][0]) for i in open_)
    wrappers = {e for e, n in held.items() if (n == total if page.names[e] == "comments" else n > WRAPPER * total)}
    said = {e for e, name in page.names.items() if name in ("article", "main")}
    if any(not blamed and said.intersection(line[3]) for blamed, line in zip(around, page.lines)):  # what stands outside it is no wrapper
        inside = {e for line, blamed in zip(page.lines, around) for e in blamed if said.intersection(line[3][: line[3].index(e)])}
        wrappers &= inside
    return np.array([all(e in wrappers for e in blamed) for blamed in around], bool)


def main_text(html: str | None) -> str:
    """The lines of the content region, joined by an empty line."""
    if not html:
        return ""
    page = _Lines()
    page.whole(html)
    lines = page.lines
    fair = _fair(page)
    if not fair.any():
        return ""
    size = np.array([len(text) - min(links, len(text)) for text, _, links, *_ in lines], float)
    ratio = np.where(fair, size / np.maximum([tags for _, tags, *_ in lines], 1), 0)
    smooth = _smooth(ratio, SIGMA)
    content = fair & (smooth >= THRESHOLD * smooth.std()) & (size > 0)
    if not content.any():
        content = fair
    shared: tuple[int, ...] | None = None  # elements that hold all lines of the clusters, outermost first
    for i in np.flatnonzero(content):
        own = lines[i][3]
        shared = own if shared is None else tuple(e for e, other in zip(shared, own) if e == other)
    # paragraphs of one text are siblings: the region is not a paragraph but what holds it
    inner = {"p", "li", "td", "tr", "tbody", "table", "ul", "ol", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dd", "dl", "dt", "figure", "figcaption"}
    held = [e for e in shared if page.names[e] in BLOCK - inner | {"comments"}]
    said = [e for e in held if page.names[e] in ("article", "main")]  # it says it is the content: not narrowed further
    region = said[0] if said else held[-1] if held else None
    return "\n\n".join(text for i, (text, _, _, around, _) in enumerate(lines) if fair[i] and (region is None or region in around))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "html"):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
