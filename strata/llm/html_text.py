"""Main-text extraction from web pages (operator 5).

The standard library's streaming parser turns a page into lines: a line ends at
every block tag and ``<br>`` inside running text joins as white space.  Each line
has its characters, its tags and the element it stands in.  The text-to-tag ratios,
smoothed by a Gaussian over the neighbouring lines, are clustered by a threshold into
content and rest.  The content lines choose the region: from the page's root the
extraction goes down to the element that holds nearly all of their characters, and
all lines of that element are text.  So a short line of the article stays, and a menu
or an advert beside it goes, whatever they are called.  ``<article>`` and ``<main>``
only stop the descent: nothing inside the chosen article is split off.

What the ratio cannot tell is left out by name: lines inside navigation, headers,
footers, asides, forms and scripts, and inside elements whose class, id or role has a
whole word for these, for adverts or for comments.  A form, or an element that only
its class, id or role marks, is no rest if the page's article stands in it.

Defined results: a null or empty page gives an empty text; a page without content
lines too; repeated rows are treated one by one; among elements with equal shares the
first is taken; a page is parsed whole, whatever its length; other columns of the
input are not read, so their names cannot clash; a left out end of ``<head>``, ``<p>``,
list items and table cells is where HTML has it; other broken markup is read as the
parser reads it, an unclosed script or comment swallowing the rest.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: elements whose text is never content
SKIP = frozenset("script style noscript template head title nav header footer aside form button select option textarea input label iframe object svg canvas dialog menu".split())
#: fixed values: elements that end a line
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: fixed values: elements without an end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: last words of classes, ids and roles of what is not the article
MARKS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos banner banners sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments respond disqus reply replies pagination pager toolbar skip".split()
)
#: fixed values: roles of such elements
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
#: fixed values: words that only say that a name is of a container or a part
PARTS = frozenset(
    "area articles bar block body bottom box button buttons column container content count desktop entries form group holder icon icons inner item items left link links list main mobile outer panel posts primary products reading right row secondary section slot stories this thread top trail unit videos wrap wrapper zone".split()
)
#: fixed values: first words of a page's own header, and of classes that tell of a layout and mark nothing
HEADERS = frozenset("site page top global".split())
LAYOUT = frozenset("has no with without".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.lru_cache(1 << 14)
def marked(name: str) -> bool:
    """Whether a class or id, split into its words, ends in one that marks no article."""
    words = [w.lower() for w in WORD.findall(name) if len(w) > 1]
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    if not words or words[0] in LAYOUT:
        return False
    return words[-1] in MARKS or words[-1] == "header" and (len(words) == 1 or words[0] in HEADERS)


#: fixed values: elements of a head, any other ends it
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
#: fixed values: elements whose start ends an open one of these, unless one of those stands between
ENDS = {t: (("p",), frozenset("button caption html table td th object template".split())) for t in BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr".split())}
LISTS = frozenset("ul ol menu dl table td th template article main".split())
ROWS = frozenset("table template".split())
ENDS_TOO = {"li": (("li",), LISTS), "dd": (("dd", "dt"), LISTS), "dt": (("dd", "dt"), LISTS), "td": (("td", "th"), ROWS), "th": (("td", "th"), ROWS), "tr": (("tr",), ROWS)}
SPACES = re.compile(r"\s+")

#: standard deviation of the smoothing, in lines
SIGMA = 1.0
#: a line is content if its smoothed ratio is above this share of the page's standard deviation
THRESHOLD = 0.5
#: an element is the region if it holds this share of the content lines' characters
SHARE = 0.95


class Lines(HTMLParser):
    """Parser events gathered into lines of (text, tags, node, heading, linked).

    ``node`` numbers the block element that a line stands in, ``parents`` and ``kinds``
    are those of each node, node 0 being the page; ``linked`` tells that all of a line's
    text is links.  Elements named in ``kept`` don't skip.
    """

    def __init__(self, kept: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.kept = kept
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.stack: list[tuple[str, bool, int, str, int, bool]] = []  # tag, skips, node outside, name if it may be kept, lost article outside, in an article outside
        self.parents, self.kinds = [0], [""]
        self.skip = self.node = self.tags = self.links = 0
        self.inside = self.heading = False
        self.linked = True
        self.text: list[str] = []
        self.open: dict[str, int] = defaultdict(int)  # tags on the stack
        self.names: list[str] = []  # open elements that skip and may be kept
        self.lost: list[list] = [[(), 0]]  # articles inside them: their names, letters
        self.at = self.free = self.articles = 0  # lost article, letters that aren't skipped, open articles
        self.found = False  # an article that isn't skipped has text

    def close(self):
        if self.rawdata.startswith("<!--"):  # a comment without an end
            self.rawdata = ""
        super().close()
        self.end_line()

    def end_line(self):
        if self.text:
            text = SPACES.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if text:
                self.lines.append((text, self.tags, self.node, self.heading, self.linked))
                self.tags = 0
        self.heading, self.linked = False, True

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and self.stack and (self.stack[-1][0] == "head" or tag in ("body", "article", "main")):
            self.end("head", ROWS)
        if tag in BLOCK:
            self.end_line()
            self.heading = tag in HEADINGS
        elif tag == "br" and not self.skip:
            self.text.append(" ")
        self.tags += not self.skip
        if tag in VOID:
            return
        for ends in (ENDS, ENDS_TOO):
            if tag in ends:
                for t in ends[tag][0]:
                    self.end(t, ends[tag][1])
        skips, name = tag in SKIP and not (tag == "header" and self.inside), ""
        if tag == "form":
            name = f"form {attrs}"
        if attrs and (name or not skips) and tag not in ("html", "body"):
            if not name and any(marked(w) if k != "role" else w.lower() in ROLES for k, v in attrs if v and k in ("class", "id", "role") for w in v.split()):
                skips, name = True, f"{tag} {attrs}"
            if any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and bool(v) and "display:none" in v.replace(" ", "") for k, v in attrs):
                skips, name = True, ""
        if name in self.kept:
            skips, name = False, ""
        self.links += tag == "a"
        self.articles += tag == "article"
        self.open[tag] += 1
        self.stack.append((tag, skips, self.node, name, self.at, self.inside))
        self.skip += skips
        if name:
            self.names.append(name)
        if tag in BLOCK:
            self.parents.append(self.node)
            self.kinds.append(tag)
            self.node = len(self.kinds) - 1
        if tag in ("article", "main"):
            if not self.skip:
                self.inside = True
            elif self.skip == len(self.names) > len(self.lost[self.at][0]):
                self.at = len(self.lost)
                self.lost.append([tuple(self.names), 0])

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        elif tag == "br" and not self.skip:
            self.text.append(" ")

    def shut(self, tag):
        """Close the nearest open ``tag`` and what is open inside it."""
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.skip -= sum(skips for _, skips, *_ in self.stack[k:])
                self.links -= sum(t == "a" for t, *_ in self.stack[k:])
                self.articles -= sum(t == "article" for t, *_ in self.stack[k:])
                for t, *_ in self.stack[k:]:
                    self.open[t] -= 1
                names = sum(bool(entry[3]) for entry in self.stack[k:])
                del self.names[len(self.names) - names :]
                _, _, self.node, _, self.at, self.inside = self.stack[k]
                del self.stack[k:]
                return

    def end(self, tag, between):
        """Close the nearest open ``tag`` unless an element of ``between`` is open inside it."""
        if not self.open.get(tag):
            return
        for t, *_ in reversed(self.stack):
            if t == tag:
                self.shut(tag)
                return
            if t in between:
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += not self.skip
        self.shut(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and not data.isspace():
            self.shut("head")
        if not self.skip:
            self.text.append(data)
            if not data.isspace():
                self.free += len(data)
                self.found |= self.articles > 0
                if not self.links:
                    self.linked = False
        elif self.at and self.skip == len(self.names) == len(self.lost[self.at][0]) and not data.isspace():
            self.lost[self.at][1] += len(data)

    def wrappers(self) -> frozenset[str]:
        """Names of the skipped elements around the page's article, none if it isn't skipped.

        No other article may have text, and the article has more than the rest of the
        page.  Of articles that are at least half as long as the longest one, that inside
        the fewest skipped elements is taken: comments and teasers may be articles too.
        """
        most = max(n for _, n in self.lost)
        if self.found or most <= self.free:
            return frozenset()
        return frozenset(min((len(names), -n, names) for names, n in self.lost if 2 * n >= most)[2])


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian over neighbouring lines, weights renormalised at the page's ends."""
    if sigma <= 0 or len(values) < 2:
        return values
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[at] / np.convolve(np.ones(len(values)), kernel)[at]


def cluster(lines: list[tuple], sigma: float = SIGMA, threshold: float = THRESHOLD, ratios: bool = True) -> np.ndarray:
    """Which lines are content: smoothed text-to-tag ratios above a share of their spread."""
    ratio = smooth(np.array([len(t) / max(1, n) if ratios else 1.0 for t, n, *_ in lines], float), sigma)
    content = ratio >= threshold * ratio.std()
    return content if content.any() else np.ones(len(lines), bool)


def region(nodes: np.ndarray, weights: np.ndarray, parents: list[int], kinds: list[str], share: float = SHARE) -> int:
    """The deepest node on the way down along which ``share`` of the weights stays together; an article is not split."""
    below = np.zeros(len(parents))
    np.add.at(below, nodes, weights)
    children: dict[int, list[int]] = defaultdict(list)
    holds = np.zeros(len(parents), bool)  # an article is inside
    for n in range(len(parents) - 1, 0, -1):  # a child's number is above its parent's
        below[parents[n]] += below[n]
        holds[parents[n]] |= holds[n] or kinds[n] == "article"
        children[parents[n]].append(n)
    at, whole = 0, share * weights.sum()
    while kinds[at] != "article" and not (kinds[at] == "main" and not holds[at]):
        deeper = [n for n in children[at] if below[n] >= whole]
        if not deeper:
            break
        at = deeper[-1]
    return at


def content_lines(lines: list[tuple[str, int, int, bool, bool]], parents: list[int], kinds: list[str], sigma: float = SIGMA, threshold: float = THRESHOLD, ratios: bool = True) -> list[str]:
    """The lines of the content region, in page order.

    Where no element short of the page itself holds the content lines, the region
    reaches from the first of them to the last, and over the lines right below it that
    are not links.  Headings right above a region belong to it unless it is an article.
    """
    if not lines:
        return []
    content = cluster(lines, sigma, threshold, ratios)
    nodes = np.array([n for _, _, n, *_ in lines])
    at = region(nodes[content], np.array([len(t) for t, *_ in lines], float)[content], parents, kinds)
    if kinds[at] in ("", "html", "body"):
        places = np.flatnonzero(content)
        first, last = int(places[0]), int(places[-1])
        while last + 1 < len(lines) and not lines[last + 1][4]:
            last += 1
        keep = np.zeros(len(lines), bool)
        keep[first : last + 1] = True
    else:
        inside = np.zeros(len(parents), bool)
        inside[at] = True
        for n in range(at + 1, len(parents)):
            inside[n] = inside[parents[n]]
        keep = inside[nodes]
        first = int(keep.argmax())
    while kinds[at] != "article" and first and lines[first - 1][3]:
        first -= 1
        keep[first] = True
    return [line[0] for line, k in zip(lines, keep.tolist()) if k]


def extract(html: str | None, **method) -> str:
    """The main text of one page, blocks joined by line feeds; ``method`` goes to :func:`content_lines`."""
    if not html:
        return ""
    kept = frozenset()
    while True:
        parser = Lines(kept)
        parser.feed(html)
        parser.close()
        more = parser.wrappers()
        if not more:
            break
        kept |= more
    return "\n".join(content_lines(parser.lines, parser.parents, parser.kinds, **method))


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = [rows.schema[i].dataType.simpleString() for i in range(2)]
    return rows.mapInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
