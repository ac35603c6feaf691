"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events. They are gathered into
lines (the text between two block borders) with the number of tags and the
characters inside links. A line's ratio is its text per tag; lines inside
scripts, menus, forms, notices and other furniture have ratio zero. The ratios
are smoothed with a Gaussian, clustered by a threshold relative to their
spread, and the element that holds most of the text of the high cluster is the
content region: its lines are the page's text, but for furniture inside it and
lines that are nearly all links.

Pages are extracted one by one where they are read; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import table

#: HTML's elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas menu dialog fieldset map audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main".split())
CLOSED_BY_ITSELF = frozenset("p li dt dd tr td th option".split())
TEXT_BLOCKS = frozenset("blockquote pre table tbody ul ol dl figure section".split())
#: A word of a class that begins so says what the element has, not what it is.
SAYS_OF = frozenset("has no not with without hide show is".split())
#: Words in class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies disqus "
    "feedback footer form hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related "
    "replies reply responses search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget dialog alert alertdialog gdpr discussion tags".split()
)
#: A header's mark is furniture unless one of these stands with it.
HEADER_OF_TEXT = frozenset("article content entry post story section".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Standard deviation of the smoothing in lines, threshold in standard deviations of the ratios.
SIGMA, LAMBDA = 1.0, 0.5
#: Share of the high cluster's text that a region must hold; for article and main.
HOLDS, ARTICLE_HOLDS = 0.8, 0.4
LINKS = 0.8


def is_furniture(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool:
    if tag in FURNITURE:
        return True
    if tag == "header" and not in_region:
        return True
    if tag in ("html", "body") or tag in HEADINGS:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name in ("class", "id", "role") and value:
            for word in value.split():
                marks = SPLIT.split(CAMEL.sub("-", word).lower())
                if marks[0] in SAYS_OF and len(marks) > 1:
                    continue
                if not MARKS.isdisjoint(marks) or ("header" in marks and not in_region and HEADER_OF_TEXT.isdisjoint(marks)):
                    return True
    return False


class Lines(HTMLParser):
    """Gathers lines (text, tags, link characters, the element around it) and elements (tag, parent, furniture?)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag_of, self.parent_of, self.furniture = ["html"], [0], [False]  # element 0 is the page
        self.open = [0]
        self.opened: dict[str, int] = {}  # how many of each tag are open
        self.left_open: set[int] = set()  # elements that nothing but the page's end closes
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def border(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.linked, self.open[-1]))
            self.parts, self.linked = [], 0
            self.tags = 0

    def shut(self, at: int, by_page: bool = False) -> None:
        """Close the open elements from a place on."""
        for n in self.open[at:]:
            self.opened[self.tag_of[n]] -= 1
            if by_page:
                self.left_open.add(n)
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.border()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSED_BY_ITSELF:
            for i in range(len(self.open) - 1, max(0, len(self.open) - 8), -1):
                name = self.tag_of[self.open[i]]
                if name == tag:
                    self.shut(i)
                    break
                if name not in INLINE and name not in CLOSED_BY_ITSELF:
                    break
        in_region = any(self.opened.get(t) for t in REGIONS)
        # of an article's header only the headings stay
        of_header = in_region and self.opened.get("header") and tag not in HEADINGS and tag not in INLINE
        self.tag_of.append(tag)
        self.parent_of.append(self.open[-1])
        self.furniture.append(bool(of_header) or is_furniture(tag, attrs, in_region))
        self.open.append(len(self.tag_of) - 1)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.border()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.border()
        self.tags += 1
        if self.opened.get(tag):
            i = len(self.open) - 1
            while self.tag_of[self.open[i]] != tag:
                i -= 1
            self.shut(i, tag in ("html", "body"))

    def handle_data(self, data):
        self.parts.append(data)
        if self.opened.get("a"):
            self.linked += len(data)

    def end(self) -> None:
        self.close()
        self.border()
        self.shut(1, True)

    def hidden(self) -> list[bool]:
        """Which elements are furniture, or lie in some. Furniture that somebody forgot to close ends where text begins:
        at the first article, heading or paragraph in it."""
        release: dict[int, int] = {}
        source = [-1] * len(self.tag_of)  # the furniture that hides each element
        for n in range(1, len(source)):
            tag, hides = self.tag_of[n], source[self.parent_of[n]]
            while hides >= 0 and hides in self.left_open and (n >= release.get(hides, n + 1) or tag in REGIONS or tag in HEADINGS or tag == "p"):
                release.setdefault(hides, n)
                hides = source[self.parent_of[hides]]
            source[n] = hides if hides >= 0 else n if self.furniture[n] else -1
        return [x >= 0 for x in source]


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    radius = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def main_text(html: str | None) -> str:
    """A page's main text: lines joined by a line feed, in page order; empty where there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.end()
    lines, tag_of, parent_of, hidden = parser.lines, parser.tag_of, parser.parent_of, parser.hidden()
    ratios = [0.0 if hidden[at] else len(text) / max(1, tags) for text, tags, _, at in lines]
    if not any(ratios):
        return ""
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    threshold = min(LAMBDA * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)), max(smooth) * 0.5)
    high = [not hidden[at] and s >= threshold and linked <= LINKS * len(text) for (text, _, linked, at), s in zip(lines, smooth, strict=True)]
    own = [yes and r >= threshold for yes, r in zip(high, ratios, strict=True)]
    if any(own):  # a short line that is only smoothed up by its neighbours doesn't say where the content is
        high = own
    held = [0] * len(tag_of)
    for (text, _, _, at), yes in zip(lines, high, strict=True):
        held[at] += len(text) * yes
    for n in range(len(held) - 1, 0, -1):  # an element comes before what lies in it
        held[parent_of[n]] += held[n]
    total = held[0]
    outermost = [False] * len(tag_of)  # in an article or main: the outermost such element, or within
    regions = set()
    for n in range(1, len(tag_of)):
        outermost[n] = outermost[parent_of[n]]
        if tag_of[n] in REGIONS and not outermost[n] and not hidden[n]:
            outermost[n] = True
            if held[n]:
                regions.add(n)
    named = sum(held[n] for n in regions) >= ARTICLE_HOLDS * total
    if not named:
        core = max((n for n in range(len(tag_of)) if held[n] >= HOLDS * total and tag_of[n] not in INLINE and tag_of[n] not in CLOSED_BY_ITSELF), default=0)
        while tag_of[core] in TEXT_BLOCKS:
            core = parent_of[core]
        regions = {core}
    around = max((n for n in range(len(tag_of)) if held[n] == total and n <= min(regions)), default=0)  # the smallest element around all of it
    inside, near = [n in regions for n in range(len(tag_of))], [n == around for n in range(len(tag_of))]
    headed = [tag in HEADINGS for tag in tag_of]
    for n in range(1, len(tag_of)):
        inside[n] |= inside[parent_of[n]]
        near[n] |= near[parent_of[n]]
        headed[n] |= headed[parent_of[n]]
    kept = []
    for (text, _, linked, at), yes in zip(lines, high, strict=True):
        if hidden[at] or not (named or linked <= LINKS * len(text)):
            continue
        if inside[at] or (not named and near[at] and (yes or headed[at])):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Each row's `keep` columns, text and n_chars (code points).

    A null or empty html, or a page with nothing but furniture, has the empty
    text; malformed markup is taken as the parser's events give it; a page of any length
    or depth is read whole, in linear time; repeated rows give repeated results, an empty
    table none, and no other column is read (text and n_chars may not be among `keep`).
    """
    from pyspark.sql import types as T

    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [main_text(h) for h in b.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)


def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
