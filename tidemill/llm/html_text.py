"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clusters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from tidemill.llm.helpers import map_batches, plus, quoted

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas video audio map select textarea button head title".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
# No page is in one of these as a whole, however long it is.
NEVER_PAGE = frozenset("nav footer menu dialog".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr").split())
CONTAINERS = frozenset("article main section div body html td table".split())
# Words in class, id or role that mark what is no main text.
_ASIDE_WORDS = re.compile(
    r"(?<!has-)(?<!no-)(?<!with-)(?<!without-)(?<![a-z])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|footers?|headers?|masthead|"
    r"cookies?|consent|notices?|popups?|modals?|newsletter|subscri\w+|comments?|disqus|replies|respond|related|recommend\w*|"
    r"share|sharing|social|widgets?|login|signup|search|pagination|pager|complementary|contentinfo|alert)(?:$|[^a-z])")
# Words in class, id or role of an article element that is a reader's remark.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
# The id of these is an anchor, not a role; that of a section only inside article or main.
_ANCHORED = _PROSE | {"li", "dt", "dd"}
_REMARK_WORDS = re.compile(r"(?:^|[^a-z])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[^a-z])")
_SPACE = re.compile(r"\s+")
_TAG_START = re.compile(r"<[!?/A-Za-z]")
MAIN_WEIGHT = 8
DOUBT_WEIGHT = 0.25


class Line(NamedTuple):
    """A block's text, its tags, whether it stands in article or main, and its container, aside and element."""

    text: str
    plain: int  # characters outside of links
    tags: int
    main: bool
    container: int
    aside: int
    element: str


class Aside:
    """An element that by its tag or its name is no main text, which its content can refute."""

    def __init__(self, parent: int, page: bool, remarks: bool):
        self.parent, self.page, self.remarks = parent, page, remarks
        self.plain = self.main = 0
        self.article = self.unclosed = False


class Lines(HTMLParser):
    """Turns parser events into lines: the text of one block, its tags, and where it stands.

    What is inside an element of ``SKIPPED`` never becomes text. ``articles`` has for each container that of the
    outermost article around it, or 0. ``asides`` are the marked elements; number 0 stands for none.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, int, int, int]] = []  # tag, skipped, main, container, aside, own aside
        self.parents = [-1]
        self.articles = [0]
        self.asides = [Aside(-1, False, False)]
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0
        self.places: dict[str, list[int]] = {}  # places in open by tag
        self.blocks: list[int] = []  # places in open of what is not inline
        self.last_comment_end = 0

    def read(self, html: str) -> None:
        """The whole page; what follows the last ``>`` holds no tag, and no search for the end of one runs through it."""
        end = html.rfind(">") + 1
        self.last_comment_end = max(html.rfind("-->"), html.rfind("--!>"))
        self.feed(html[:end])
        super().close()
        if end < len(html):
            self.handle_data(unescape(_TAG_START.split(html[end:], maxsplit=1)[0]))  # a tag cut short is no text
        self.flush()
        self._close(0, True)

    def parse_comment(self, i, report=1):
        """A comment that nothing ends runs to the end of the page."""
        if self.last_comment_end < i + 2:
            return len(self.rawdata)
        return super().parse_comment(i, report)

    def parse_marked_section(self, i, report=1):
        """``<![ ... >`` is skipped, whatever it says."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else len(self.rawdata)

    def _state(self) -> tuple[bool, bool, int, int]:
        return self.open[-1][1:5] if self.open else (False, False, 0, 0)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            _, main, container, aside = self._state()
            element = self.open[self.blocks[-1]][0] if self.blocks else ""
            self.lines.append(Line(text, max(0, len(text) - self.linked), self.tags, main, container, aside, element))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        skipped, main, container, aside = self._state()
        if tag not in INLINE and not skipped:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "p" or tag == "li":
            self._end_implied(tag)
            skipped, main, container, aside = self._state()
        own = 0
        if not skipped and tag in SKIPPED:
            self.flush()
            skipped = True
        if not skipped and tag not in ("html", "body", "main"):
            named = " ".join(v for k, v in attrs if v and (
                k in ("class", "role", "aria-label") or k == "id" and tag not in _ANCHORED and not (tag == "section" and main)))
            named = named.lower().replace("_", "-")
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            remark = bool(named and _REMARK_WORDS.search(named))
            word = remark if tag == "article" else bool(named and _ASIDE_WORDS.search(named))
            if hidden or word or tag in ASIDE:
                self.flush()
                own = aside = len(self.asides)
                self.asides.append(Aside(self._state()[3], tag not in NEVER_PAGE, remark))
        if tag in ("article", "main") and not skipped:
            main = True
            if not (tag == "article" and own):  # a remark refutes nothing
                self.asides[aside].article = True
        if tag in CONTAINERS and not skipped:
            self.parents.append(container)
            around = self.articles[container]
            container = len(self.parents) - 1
            self.articles.append(around or (container if tag == "article" else 0))
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, skipped, main, container, aside, own))

    def _close(self, at: int, implied: bool = False) -> None:
        """The elements from ``at`` on end, all but the first without an end tag of their own."""
        for n, (tag, *_, own) in enumerate(self.open[at:]):
            self.links -= tag == "a"
            if own and (n or implied) and tag == "div":
                self.asides[own].unclosed = True
            self.places[tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del self.open[at:]

    def _end_implied(self, tag):
        """A new p or li ends an open one, with the inline elements left open in it."""
        for i in reversed(self.blocks):  # never two p in a row
            name = self.open[i][0]
            if name == tag:
                self._close(i)
                return
            if name != "p":
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE and not self._state()[0]:
            self.flush()
        if self.places.get(tag):
            at = self.places[tag][-1]
            if any(own for *_, own in self.open[at:]):
                self.flush()
            self._close(at)

    def handle_data(self, data):
        if not self._state()[0]:
            self.text.append(data)
            self.linked += len(data) if self.links else 0

    def trust(self) -> list[float]:
        """Weight of what stands in each aside: 0, or if it holds an article or never ends ``DOUBT_WEIGHT``, or 1.

        The weight is 1 if it has over half (readers' remarks: nine tenths) of the text outside of links, of the page
        or of what stands in article or main, unless it is of a kind that no page is in.
        """
        page, main = 0, 0
        for line in self.lines:
            page += line.plain
            main += line.plain if line.main else 0
            self.asides[line.aside].plain += line.plain
            self.asides[line.aside].main += line.plain if line.main else 0
        for aside in reversed(self.asides[1:]):  # those inside come later
            around = self.asides[aside.parent]
            around.plain += aside.plain
            around.main += aside.main
            around.article |= aside.article and not aside.remarks
        out = [1.0]
        for aside in self.asides[1:]:
            least = 0.9 if aside.remarks else 0.5
            if aside.page and (aside.plain > least * page or aside.main > least * main):
                own = 1.0
            else:
                own = DOUBT_WEIGHT if aside.article or aside.unclosed else 0.0
            out.append(own * out[aside.parent])
        return out


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian mean of each value and its neighbours up to three sigma."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[low - i + reach:high - i + reach]
        out.append(sum(k * v for k, v in zip(part, values[low:high], strict=True)) / sum(part))
    return out


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Text of the content regions of a page, one line per block.

    Lines get their text-to-tag ratio, smoothed along the page, weighted by where they stand. Lines above half a
    standard deviation over zero form clusters: by outermost article, in main outside of articles, and elsewhere. If
    articles and main together outweigh the heaviest cluster elsewhere, what lies elsewhere goes, else they do. Of the
    clusters left those with a tenth of the largest total are regions: an article as a whole, of the others the
    deepest container with nine tenths of the total. All lines of a region stay, short ones as well, and it grows over
    the neighbouring lines (outside of articles) that are a h1, above the threshold by themselves, or prose above it.
    """
    if not html:
        return ""
    parser = Lines()
    parser.read(html)
    trust = parser.trust()
    parents, articles = parser.parents, parser.articles
    lines = [line for line in parser.lines if trust[line.aside] > 0]
    if not lines:
        return ""
    reach = max(1, math.ceil(3 * sigma))
    ratios = [len(line.text) / max(1, line.tags) for line in lines]
    weights = [(MAIN_WEIGHT if line.main else 1) * trust[line.aside] for line in lines]
    values = [ratio * weight for ratio, weight in zip(smoothed(ratios, sigma), weights, strict=True)]
    mean = sum(values) / len(values)
    threshold = 0.5 * math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))
    # the cluster of a line: an article's container, -1 in main, 0 elsewhere
    clusters = [articles[line.container] or (-1 if line.main else 0) for line in lines]
    totals: dict[int, float] = {}
    inner = {cluster: [0.0] * len(parents) for cluster in (-1, 0)}
    for i, (line, cluster) in enumerate(zip(lines, clusters, strict=True)):
        if values[i] >= threshold:
            totals[cluster] = totals.get(cluster, 0.0) + values[i]
            if cluster <= 0:  # by its own ratio: what neighbours lend would tie a region to its surroundings
                inner[cluster][line.container] += ratios[i] * weights[i]
    for sums in inner.values():
        for c in range(len(parents) - 1, 0, -1):  # a region holds what lies in the containers inside it
            sums[parents[c]] += sums[c]
    elsewhere = totals.get(0, 0.0)
    marked = sum(v for c, v in totals.items() if c)
    totals = {c: v for c, v in totals.items() if (c != 0) == (marked >= elsewhere and marked > 0)}
    least = 0.1 * max(totals.values())
    kept = [cluster > 0 and totals.get(cluster, -1.0) >= least for cluster in clusters]
    for cluster in (-1, 0):
        if totals.get(cluster, -1.0) < least:
            continue
        region = max(c for c, v in enumerate(inner[cluster]) if v >= 0.9 * inner[cluster][0])
        inside = [c == region for c in range(len(parents))]
        for c in range(1, len(parents)):
            inside[c] |= inside[parents[c]]
        for i, line in enumerate(lines):
            kept[i] |= clusters[i] == cluster and inside[line.container]
    beside = 0 if 0 in totals else -1
    near = [i for i, cluster in enumerate(clusters) if kept[i] or cluster == beside]
    good = [
        lines[i].element == "h1" or ratios[i] * weights[i] >= threshold or values[i] >= threshold and lines[i].element in _PROSE
        for i in near]
    for order in (range(len(near)), range(len(near) - 1, -1, -1)):
        last = None  # place of the nearest kept line on the way
        for n in order:
            if kept[near[n]]:
                last = n
            elif last is not None and good[n] and abs(n - last) <= reach:
                for k in range(min(n, last), max(n, last) + 1):
                    kept[near[k]] = True
                last = n
    return "\n".join(line.text for line, stays in zip(lines, kept, strict=True) if stays)


def extract_text(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """``pages`` without the html and with its main text, '' for null, empty or contentless pages.

    White space inside a block becomes one space, blocks are joined by a newline. One pass, no shuffle; the parser sees
    the whole page. Other columns pass through; one with the name of the result is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, column)]
    rows = pages.select(*[quoted(c) for c in kept], quoted(html).cast("string").alias("html"))
    names = [*kept, column]

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    return map_batches(rows, extract, plus(pages.select(*[quoted(c) for c in kept]).schema, **{column: StringType()}))
