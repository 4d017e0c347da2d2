"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's streaming parser yields start, end and text events. They are folded into lines:
one line for each block (paragraph, heading, list item, ...), with the characters of its text, the
number of tags, the share of its text inside links, and the region it lies in: the article or main element around
it, else the nearest container. Lines in menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles are boilerplate by their markup and get ratio 0. A class or id names such a part only as a whole word of it
("site-header", "sidebar left", not "has-sidebar"), and not where the element holds most of the page's text together
with its heading or article. The ratios of all lines are smoothed by a Gaussian window in page order, each region gets
the size-weighted mean of its lines, and the threshold is the page's spread. Where the largest region is an article,
others are content if they reach the threshold (plain containers beside it also need a quarter of its text). Without
one all containers are parts of one text, and only those are left out that miss the threshold and are mostly links.
All lines of a content region are kept whole, short ones too.

Malformed pages: a menu, header, sidebar or form that is never closed claims link lines only; comments and tags that
never end are cut out before parsing, so time grows with a page's length.

Defined cases: null, empty and unparsable pages give an empty text. Unclosed and stray tags are closed
where the structure demands it. A page without any text outside boilerplate gives an empty text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import map_batches, whole

SIGMA = 1.0  # of the smoothing window, in lines
# Elements by what they mean for the text of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title noscript template svg math iframe object canvas audio video".split())
ASIDE = frozenset("nav header footer aside form button select textarea dialog menu fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "caption".split())
REGIONS = frozenset("article main section body div td".split())
CLOSES_P = BLOCKS - {"body", "html"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar tablist".split())
# Words of a class or id that name a part outside the text, those that may follow one, and those that undo it.
BOILERPLATE = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|"
    r"subscri\w+|signup|login|comments?|disqus|respond|responses|replies|reply|nav|navbar|navigation|menu\w*|breadcrumbs?|"
    r"pagination|pager|sidebar\w*|side|aside|widgets?|related|recommend\w*|share|sharing|social|footer|foot|header|masthead|"
    r"topbar|toolbar|skip\w*|copyright|tags|tracking")
GENERIC = frozenset("container wrapper wrap box area list section block left right top bottom inner outer links link bar item items "
                    "unit slot panel column col row group holder main primary secondary content text 1 2 3".split())
MODIFIERS = frozenset("has with no without is not show hide hidden enable".split())
_SPACE = re.compile(r"\s+")


def names_boilerplate(names: str) -> bool:
    """Does a class or id list name a part outside the text? Words count whole, the last one of a name or the first."""
    for name in names.lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        if words and words[0] not in MODIFIERS and (
                BOILERPLATE.fullmatch(words[-1]) or BOILERPLATE.fullmatch(words[0]) and all(w in GENERIC for w in words[1:])):
            return True
    return False


class _Lines(HTMLParser):
    """Folds events into lines: text, tags, link characters, region, numbers of the boilerplate elements around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, tuple[int, ...]]] = []
        self.open: list[tuple[str, bool, tuple[int, ...], int]] = []  # tag, unseen, boilerplate elements, region
        self.count: Counter[str] = Counter()  # open elements by tag
        self.text: list[str] = []
        self.tags = self.linked = self.regions = self.elements = 0
        self.articles: set[int] = set()  # regions that are an article or main
        self.named: set[int] = set()  # elements that are boilerplate by name only
        self.headed: set[int] = set()  # elements with a heading or article inside
        self.unclosed: set[int] = set()

    def _state(self) -> tuple[bool, tuple[int, ...], int]:
        return self.open[-1][1:] if self.open else (False, (), 0)

    def flush(self) -> None:
        joined = _SPACE.sub(" ", "".join(self.text)).strip()
        if joined:
            _, around, region = self._state()
            self.lines.append((joined, self.tags, self.linked, region, around))
            self.tags = self.linked = 0
        self.text = []

    def _pop(self, depth: int, closed: bool = True) -> None:
        """Close the elements from ``depth`` on; those above the first, or all if nothing closes it, lack an end tag."""
        gone = self.open[depth:]
        if any(tag in BLOCKS for tag, *_ in gone):
            self.flush()
        for tag, _, around, _ in gone[closed:]:
            if tag in ASIDE and tag != "footer":
                self.unclosed.add(around[-1])
        self.count.subtract(tag for tag, *_ in gone)
        del self.open[depth:]

    def _close_open(self, name: str, stop: frozenset[str]) -> None:
        if not self.count[name]:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][0]
            if tag == name:
                self._pop(depth)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in CLOSES_P:
            self._close_open("p", P_STOPS)
        if tag in IMPLIED:
            for name in IMPLIED[tag][0]:
                self._close_open(name, IMPLIED[tag][1])
        if tag in BLOCKS:
            self.flush()
        unseen, around, region = self._state()
        given = {k: v or "" for k, v in attrs}
        unseen = unseen or tag in UNSEEN or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
        if tag in ("h1", "article", "main"):
            self.headed.update(around)
        named = tag not in ("html", "body", "article", "main") and (
            names_boilerplate(f"{given.get('class', '')} {given.get('id', '')}") or given.get("role", "").lower() in ROLES)
        if tag in ASIDE or named:
            self.elements += 1
            around = (*around[-8:], self.elements)
            if tag not in ASIDE:
                self.named.add(self.elements)
        if tag in REGIONS and not (self.count["article"] or self.count["main"]):
            # A plain container inside an article or main belongs to it.
            self.regions += 1
            region = self.regions
            if tag in ("article", "main"):
                self.articles.add(region)
        self.count[tag] += 1
        self.open.append((tag, unseen, around, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count[tag]:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._pop(depth)
                return
            # A stray inline end tag does not close blocks around it.
            if tag not in BLOCKS and self.open[depth][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self._state()[0]:
            return
        self.text.append(data)
        if self.count["a"]:
            self.linked += len(data.strip())

    def end(self) -> None:
        self.flush()
        if self.open:
            self._pop(0, closed=False)

    def marked(self) -> list[bool]:
        """Is each line boilerplate by the elements around it?"""
        size, total = Counter(), sum(len(t) for t, *_ in self.lines)
        for text, _, _, _, around in self.lines:
            for element in around:
                size[element] += len(text)
        spared = {e for e in self.named & self.headed if 2 * size[e] > total}
        return [any(e not in spared and (e not in self.unclosed or 2 * linked >= len(text)) for e in around)
                for text, _, linked, _, around in self.lines]


P_STOPS = frozenset("div article section td th li blockquote body main aside nav footer header".split())
#: What a start tag closes: elements, and those that they are not looked for beyond.
IMPLIED = {
    "li": (("li",), frozenset(("ul", "ol", "menu"))), "tr": (("tr",), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))),
    "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))), "body": (("head",), frozenset())}


def without_open_ends(html: str) -> str:
    """The page without the starts of comments and tags that never end; the parser would try each of them anew."""
    closed = html.rfind("-->")
    at = html.find("<!--", max(0, closed))
    if at >= 0:
        html = html[:at] + html[at:].replace("<!--", "")
    last = html.rfind(">") + 1
    return html[:last] + _OPEN_TAG.sub("", html[last:])


_OPEN_TAG = re.compile("<[!?/a-zA-Z][^<]*")


def page_lines(html: str) -> tuple[_Lines, list[bool]]:
    """The parsed page, and which of its lines are boilerplate by their markup."""
    parser = _Lines()
    parser.feed(without_open_ends(html))
    parser.close()
    parser.end()
    return parser, parser.marked()


def _smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), window)[reach:len(ratios) + reach]
    return np.convolve(ratios, window)[reach:len(ratios) + reach] / weight


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """Blocks of the content regions, in page order, one to a line."""
    parser, marked = page_lines(html or "")
    lines, markup = parser.lines, np.array(marked, dtype=bool)
    if markup.all():
        return ""
    size = np.array([len(t) for t, *_ in lines], dtype=float)
    tags = np.array([n for _, n, *_ in lines], dtype=float)
    linked = np.minimum(size, [n for _, _, n, *_ in lines])
    names, region = np.unique([r for *_, r, _ in lines], return_inverse=True)
    ratios = np.where(markup, 0.0, (size - linked) / np.maximum(1.0, tags))
    smooth = _smooth(ratios, sigma)
    shown = np.where(markup, 0.0, size)
    of_region = lambda values: np.bincount(region, values, len(names))
    held, plain = of_region(shown), of_region(np.where(markup, 0.0, size - linked))
    mean = of_region(shown * smooth) / np.maximum(held, 1.0)
    largest = int(np.lexsort((names, -plain, held == 0))[0])
    reaches = mean >= max(float(np.std(smooth)), 0.5 * mean[largest])
    is_article = np.isin(names, list(parser.articles))
    if is_article[largest]:
        content = reaches & (is_article | (plain >= 0.25 * plain[largest]))
    else:
        content = reaches | (2 * plain > held)
    content[largest] = True
    return "\n".join(t for (t, *_), r, b in zip(lines, region, markup, strict=True) if not b and content[r])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col), F.col(url_col), whole(F.col(html_col)).alias("__html"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return map_batches(rows, run, f"{', '.join(kinds)}, text string, n_chars long")
