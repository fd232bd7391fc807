"""Main text of web pages.

The standard library's parser streams a page's events into lines, one for each block. Each line has a text-to-tag
ratio: its characters outside links over the tags that stand in it. The ratios, smoothed by a Gaussian over
neighbouring lines, fall into two clusters at a threshold; the lines above it are content. They point out the region that holds
most of the content, and that region's lines are the text. Elements that never belong to an article (menus, adverts,
forms, comments, ...) are left out by element, role and class before the ratios are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mapped

# Elements and words in class, id or role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas menu dialog audio video math datalist".split())
CLOSES_P = BLOCK - {"body", "html"}
HOLDS_P = frozenset("article div section td main body li".split())
LISTS = frozenset("ul ol menu".split())
ARTICLES = frozenset("article main body".split())
NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promoted promotion related respond responses share sharing sidebar skip social sponsor sponsored subscribe subscription taboola toolbar widget alert signup login search reviews replies reply tags topbar".split())
NOISE_OUTSIDE = NOISE | {"header"}
ASIDE = frozenset("ad ads advert comment comments promo related reply sponsored teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
REGIONS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class such as "with-sidebar" tells of a page's layout, not of what the element is.
ABOUT = frozenset("with has no without hide is".split())
_TOKEN = re.compile("[a-z]+")

RADIUS, SIGMA = 3, 1.5


class Lines(HTMLParser):
    """Lines of a page: its pieces of text, each with the region it stands in. Each event costs the same however deep it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen_region = False
        self.stack: list[tuple[str, int, bool]] = []  # element, region, left out
        self.open: dict[str, list[int]] = {}  # of each element its places in the stack
        self.never = 0  # open elements that never belong to an article
        self.headings = 0
        self.regions = [(-1, "", False, 0)]  # parent region, element, inside an article, suspect
        self.freed: set[int] = set()  # suspects that hold the first article
        self.lines: list[tuple[list[tuple[str, int, bool]], list[int], int, bool]] = []  # pieces (text, region, link), regions of tags, region, heading
        self.pieces: list[tuple[str, int, bool]] = []
        self.tags: list[int] = []
        self.in_link = 0

    def _region(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _end_line(self):
        if any(not t.isspace() for t, _, _ in self.pieces):
            self.lines.append((self.pieces, self.tags, self._region(), self.headings > 0))
            self.tags = []
        self.pieces = []

    def _inside_article(self) -> bool:
        return self.regions[self._region()][2]

    def _left_out(self, tag: str, attrs: list) -> bool:
        """Whether an element never belongs to an article."""
        if tag in NEVER:
            return True
        if tag == "header":
            return not self._inside_article()
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if name == "role" and value and value.lower() in ROLES:
                return True
        return False

    def _suspect(self, tag: str, attrs: list) -> int:
        """What a class or id says of an element: 0, it may belong to the article; 1, it may not, though there are other names or the word is not the last
        of its name (social-science-article); 2, all its names end in such words."""
        for name, value in attrs:
            if name not in ("class", "id") or not value or tag in ("html", "body", "main"):
                continue
            names = [w for w in map(_TOKEN.findall, value.lower().split()) if w]
            odd = ASIDE if tag == "article" else NOISE if self._inside_article() else NOISE_OUTSIDE
            if any((w[0] not in ABOUT or tag == "article") and not odd.isdisjoint(w) for w in names):
                return 2 if all(w[-1] in odd for w in names) else 1
        return 0

    def _push(self, tag: str, region: int, out: bool) -> None:
        self.in_link += tag == "a"
        self.never += tag in NEVER
        self.headings += tag in HEADINGS
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, region, out))

    def handle_starttag(self, tag, attrs):
        out = bool(self.stack) and self.stack[-1][2]
        if tag in VOID:
            if tag == "br":
                self.pieces.append((" ", self._region(), False))
            elif tag == "hr":
                self._end_line()
            if not out:
                self.tags.append(self._region())
            return
        if tag in BLOCK:
            self._end_line()
            if tag in CLOSES_P:
                self._close("p", HOLDS_P)
            if tag == "li":
                self._close("li", LISTS)
        elif tag in ("td", "th"):
            self.pieces.append((" ", self._region(), False))
        out, region = bool(self.stack) and self.stack[-1][2], self._region()
        first = tag in REGIONS and not self.seen_region and not self.never
        if first:
            out = False  # the first article counts, whatever its wrapper is called
        if not out and not self._left_out(tag, attrs):
            self.tags.append(region)
            suspect = self._suspect(tag, attrs)
            if first and not suspect:
                self.seen_region, at = True, region
                while at >= 0:
                    self.freed.add(at)
                    at = self.regions[at][0]
            if suspect or tag in BLOCK and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dt", "dd", "pre", "html"):
                self.regions.append((region, tag, tag in REGIONS or self.regions[region][2], suspect))
                region = len(self.regions) - 1
        else:
            out = True
        self._push(tag, region, out)

    def _close(self, tag: str, until: frozenset) -> None:
        """Closes the last open element of this name, unless an element of `until` stands between."""
        places = self.open.get(tag)
        if not places or any(self.open.get(u) and self.open[u][-1] > places[-1] for u in until if u != tag):
            return
        at = places[-1]
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.open[name].pop()
            self.in_link -= name == "a"
            self.never -= name in NEVER
            self.headings -= name in HEADINGS

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_line()
        self._close(tag, ARTICLES if tag not in ("article", "main", "body", "html") else frozenset())

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.pieces.append((data, self._region(), self.in_link > 0))

    def result(self) -> list[tuple[list[tuple[str, int, bool]], list[int], int, bool]]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(x: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted mean over up to `radius` neighbours at either side; weights at the ends are normalised anew."""
    g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(x, g)[radius:-radius] / np.convolve(np.ones_like(x), g)[radius:-radius]


def threshold(x: np.ndarray) -> float:
    """Midway between the means of two clusters (two-means in one dimension, from the extremes)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        t = (low + high) / 2
        a, b = x[x < t], x[x >= t]
        if not len(a) or not len(b) or (a.mean(), b.mean()) == (low, high):
            return t
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def visible(page: Lines, lines: list, freed: set[int]) -> list[tuple[str, int, int, int, bool]]:
    """(text, tags, characters in links, region, heading) of the lines that no suspect holds, but for the freed ones."""
    noise = [False] * len(page.regions)
    for r, (parent, _, _, suspect) in enumerate(page.regions):  # a region's children stand behind it
        noise[r] = parent >= 0 and noise[parent] and r not in freed or suspect and r not in freed
    out = []
    for pieces, tags, region, heading in lines:
        if text := " ".join("".join([t for t, r, _ in pieces if not noise[r]]).split()):
            out.append((text, sum(not noise[r] for r in tags), sum(len(t.strip()) for t, r, link in pieces if link and not noise[r]), region, heading))
    return out


def judged(lines: list[tuple[str, int, int, int, bool]], cut=threshold) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio is over the threshold between the two clusters."""
    ratio = np.array([max(0, len(t) - linked) / (1 + tags) for t, tags, linked, _, _ in lines])
    level = smoothed(np.log1p(ratio))
    return level >= cut(level)


def main_text(html: str | None, cut=threshold) -> str:
    """The article's blocks, one a line; empty where there is none.

    Where no line outside the suspects has text of its own, the suspect with the most such text that lies in no other one is freed, until there is some; those whose
    names all say so stay left out, unless they hold the page's first article."""
    page = Lines()
    page.feed(html or "")
    lines, freed = page.result(), set(page.freed)
    while True:
        shown = visible(page, lines, freed)
        if any(len(t) > linked for t, _, linked, _, _ in shown):
            break
        own: dict[int, int] = {}
        for pieces, _, _, _ in lines:
            for t, r, link in pieces:
                outer, certain = -1, False
                while r >= 0:
                    if page.regions[r][3] and r not in freed:
                        outer, certain = r, certain or page.regions[r][3] == 2
                    r = page.regions[r][0]
                if outer >= 0 and not certain and not link:
                    own[outer] = own.get(outer, 0) + len(t.strip())
        if not any(own.values()):
            return ""
        freed.add(max(own, key=own.__getitem__))
    chosen = judged(shown, cut)
    mass, plain, links = ([0] * len(page.regions) for _ in range(3))
    for (text, _, linked, region, _), keep in zip(shown, chosen, strict=True):
        own_text = max(0, len(text) - linked)
        mass[region] += keep * own_text
        plain[region] += own_text
        links[region] += linked
    for r in range(len(mass) - 1, 0, -1):
        for sums in (mass, plain, links):
            sums[page.regions[r][0]] += sums[r]
    if not mass[0]:
        return ""
    best = content_regions([r[:3] for r in page.regions], mass, plain, links)
    inside = [False] * len(mass)
    for r, (parent, *_) in enumerate(page.regions):
        inside[r] = r in best or parent >= 0 and inside[parent]
    return "\n".join(text for (text, _, linked, region, heading), over in zip(shown, chosen, strict=True) if inside[region] and (over or heading or 2 * linked <= len(text)))


def content_regions(regions: list[tuple[int, str, bool]], mass: list[int], plain: list[int], linked: list[int]) -> set[int]:
    """The regions whose lines are the text: the articles (main where there is none) with lines over the threshold, if they hold half of
    all such lines' text together; else the smallest region that holds four fifths of it.

    An article beside such a one counts as well, unless most of it is links. Articles inside others are part of them."""
    for name in ("article", "main"):
        within = [False] * len(regions)
        top = []
        for r, (parent, tag, _) in enumerate(regions):
            above = parent >= 0 and within[parent]
            within[r] = above or tag == name
            if within[r] and not above:
                top.append(r)
        found = {r for r in top if mass[r]}
        if sum(mass[r] for r in found) * 2 > mass[0]:
            beside = {regions[r][0] for r in found}
            return found | {r for r in top if regions[r][0] in beside and plain[r] > linked[r]}
    return {max(r for r in range(len(mass)) if mass[r] * 5 >= mass[0] * 4)}


def _extract(at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([main_text(h.as_py()) for h in part.column(at)], pa.string())], names=[*(f"c{k}" for k in keep), "text"])

    return run


def extract(pages: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of pages (columns `keep`, all by default) with the main text of the whole html.

    Null and empty pages, and pages without text, give an empty text. Broken markup is read as far as it goes. Repeated rows
    stay; a column named like the result is kept, and the result takes the name with "_" before it."""
    kept = [pages.columns.index(c) for c in (pages.columns if keep is None else keep)]
    (out,) = fresh(pages.select(*(pages.columns[k] for k in kept)), out)
    schema = ", ".join([*(f"c{k} {pages.schema.fields[k].dataType.simpleString()}" for k in kept), "text string"])
    rows = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    return mapped(rows, _extract(pages.columns.index(html), kept), schema).toDF(*(pages.columns[k] for k in kept), out)


def op2_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
