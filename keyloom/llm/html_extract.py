"""Main text of web pages from a stream of standard-library parser events.

The parser's events fill lines, one for each block of the page, with the number
of characters and tags in each. The ratio of text to tags (at most DENSE, so that
one long paragraph doesn't outweigh the others) is smoothed over the lines by a
Gaussian; lines at or above a threshold (a share of the standard deviation) form
clusters. The heaviest cluster is where the article is, and the region that gives
the text is the innermost container outside which no line of a cluster and no
heading of one is.

Names are one measure among these: a line in an element whose tag or name is that
of a menu, a footer, an advert, a form or reader comments has its ratio scaled
down, and one in an article or main has it scaled up; the former are left out
unless they hold the heaviest cluster. A name counts as a whole: `sidebar` and
`site-sidebar` do, `has-sidebar` doesn't. Where an article or a main holds the
heaviest cluster and most of the weight, what lies outside is left out too.

Time and memory grow linearly with the html, however it is nested or broken.

Defined results: null or empty html, or a page without content, gives the empty
text; unclosed and misnested tags, of elements left out too, are closed as the
blocks around them end or by the next start tag that implies it; unclosed comments
and markup that the page's end cuts off are text; repeated rows each get their
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices

#: Width of the Gaussian in lines, the threshold in standard deviations, the largest ratio that counts, and the share of weight that makes a main the region.
SIGMA, THRESHOLD, DENSE, SHARE = 1.0, 0.75, 200.0, 0.9
#: What the ratio is multiplied by in elements named like surroundings, in those of such a tag, in other people's texts, and in an article or main.
NAMED, TAGGED, OTHERS, ARTICLE = 0.1, 0.03, 0.01, 4.0
#: Lines between a heading and the cluster that it belongs to.
NEAR = 3
#: Characters fed to the parser at once.
FEED = 1 << 14

_NEVER = {"script", "style", "noscript", "template", "head", "title", "button", "select", "textarea", "svg", "iframe", "object", "canvas", "audio", "video"}
_TAGS = {"nav": TAGGED, "footer": TAGGED, "menu": TAGGED, "aside": TAGGED, "dialog": TAGGED, "header": NAMED, "form": NAMED}
_SKIP = _NEVER | set(_TAGS)
_IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_REGION = {"article", "main", "section", "div", "td", "body", "table"}
#: Words of names (fixed values): of what surrounds an article, of other people's texts, and those that may stand beside them in a name.
_AROUND = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners menu menus nav navbar navigation breadcrumb breadcrumbs sidebar header masthead footer cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social widget widgets pagination pager toolbar search copyright hidden".split())
_OTHERS = set("comment comments reply replies respond disqus related recommend recommended recommendations".split())
_BESIDE = set("site page main top bottom left right primary secondary global container wrapper wrap box list area section block bar link links item items post posts article articles content inner outer buttons icons form panel slot text title and".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: A start tag of the key closes the open elements named, up to a container.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}


def named(names: str) -> float:
    """What a class or id says: the factor of an element's ratio. Each name counts only if all its parts are known words."""
    out = 1.0
    for name in names.split():
        parts = {x.lower() for x in _PARTS.split(name) if x and not x.isdigit()}
        if parts <= _AROUND | _OTHERS | _BESIDE:
            out = min(out, OTHERS if parts & _OTHERS else NAMED if parts & _AROUND else 1.0)
    return out


class _Lines(HTMLParser):
    """Collects lines: text, tags, the innermost region and named element around each, and whether it is a heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.counts: list[int] = []
        self.in_region: list[int] = []
        self.in_named: list[int] = []
        self.headings: list[int] = []
        #: Tag, parent and factor of each region, and parent and factor of each named element; 0 is the page.
        self.regions, self.named = [("", 0, 1.0)], [(0, 1.0)]
        #: Open elements: tag, region and named element that they begin (0 if none), and whether their text is never content.
        self.open: list[tuple[str, int, int, bool]] = []
        self.open_tags: Counter[str] = Counter()
        self.region = self.name = self.never = 0
        #: Open headings, the largest first.
        self.heading: list[int] = []
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.texts.append(text)
            self.counts.append(max(1, self.tags))
            self.in_region.append(self.region)
            self.in_named.append(self.name)
            self.headings.append(min(self.heading, default=0))
        self.text, self.tags = [], 0

    def cut(self, at: int) -> None:
        """Closes the open elements from the given one on."""
        if any(k for _, _, k, _ in self.open[at:]):
            self.flush()
        while len(self.open) > at:
            tag, r, k, never = self.open.pop()
            self.open_tags[tag] -= 1
            self.never -= never
            if r:
                self.region = self.regions[r][1]
            if k:
                self.name = self.named[k][0]
            if tag in _HEADING:
                self.heading.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in _IN_HEAD:
            self.cut(len(self.open) - 1)
        if tag in _BLOCK:
            self.make_way(tag)
        self.tags += 1
        if tag == "br" and not self.never:
            self.text.append(" ")
        if tag in _VOID:
            return
        factor = 1.0
        if not self.never and tag not in ("html", "body", "article", "main"):
            held = dict(attrs)
            factor = named(f"{held.get('class') or ''} {held.get('id') or ''}")
            if held.get("role") in _ROLES or "hidden" in held or held.get("aria-hidden") == "true":
                factor = min(factor, NAMED)
            factor = min(factor, _TAGS.get(tag, 1.0))
        never = tag in _NEVER
        if never or factor < 1 or tag in _BLOCK:
            self.flush()
        r = k = 0
        if tag in _REGION and not self.never:
            r = len(self.regions)
            self.regions.append((tag, self.region, ARTICLE if tag in ("article", "main") else self.regions[self.region][2]))
            self.region = r
        if factor < 1:
            k = len(self.named)
            self.named.append((self.name, self.named[self.name][1] * factor))
            self.name = k
        if never or factor < 1 or tag in _BLOCK or self.never or self.name:
            self.open.append((tag, r, k, never))
            self.open_tags[tag] += 1
            self.never += never
            if tag in _HEADING:
                self.heading.append(int(tag[1]))

    def make_way(self, tag: str) -> None:
        """Ends the line, and the elements that a block's start tag closes; inline ones in them end too."""
        self.flush()
        closes, at = _CLOSES.get(tag, {"p"}), None
        if not any(self.open_tags[x] for x in closes):
            return
        for i in range(len(self.open) - 1, -1, -1):
            x = self.open[i][0]
            if x in closes:
                at = i
            elif x in _BLOCK or x in _SKIP:
                break
        if at is not None:
            self.cut(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        outer = tag in _BLOCK or tag in _SKIP
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        if not self.open_tags[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            x = self.open[i][0]
            if x == tag:
                self.cut(i)
                return
            if not outer and (x in _BLOCK or x in _SKIP):
                return

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        """Declarations and marked sections end with the next `>`, as in browsers."""
        return self.rawdata.find(">", i + 2) + 1 or -1

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find("-->", i + 2)
        return -1 if end < 0 else end + 3


def parsed(html: str) -> _Lines:
    """The lines of a page. Beginnings of markup that nothing ends are made text first, so that the parser never looks for their ends."""
    last = html.rfind("-->") + 3 if "-->" in html else 0
    html = html[:last] + html[last:].replace("<!--", "")
    last = html.rfind(">") + 1
    html = html[:last] + html[last:].replace("<", "&lt;")
    page = _Lines()
    for i in range(0, len(html), FEED):
        page.feed(html[i : i + FEED])
    page.close()
    page.flush()
    return page


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratio under a normalised Gaussian of the given width, cut at three widths."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]


def clusters(ratio: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weight of each line in its cluster (0: in none), the cluster, and whether the line itself is over the threshold as well.

    Lines of different parts (named elements) are not smoothed into each other.
    """
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    soft = np.concatenate([smoothed(ratio[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
    least = THRESHOLD * soft.std()
    inside = soft >= least
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    begins[cuts[:-1]] |= inside[cuts[:-1]]
    return np.where(inside, soft, 0), np.where(inside, np.cumsum(begins) - 1, -1), inside & (ratio >= least)


def _sums(values: np.ndarray, at: np.ndarray, parents: list[int]) -> list:
    """The sum of values in each element of a tree, those inside it included; parents come before children."""
    out = np.bincount(at, values, len(parents)).tolist()
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    if not page.texts:
        return ""
    chars = np.array([len(x) for x in page.texts], np.float64)
    part, place = np.array(page.in_named), np.array(page.in_region)
    ratio = np.minimum(chars / np.array(page.counts), DENSE) * np.array([f for _, f in page.named])[part] * np.array([f for _, _, f in page.regions])[place]
    weight, cluster, core = clusters(ratio, part)
    first = int(np.flatnonzero(cluster == np.argmax(np.bincount(cluster + 1, weight)[1:]))[0])
    # Named elements stay only around the heaviest cluster.
    spared, k = {0}, int(part[first])
    while k:
        spared.add(k)
        k = page.named[k][0]
    kept = np.isin(part, list(spared))
    core &= kept
    heading = np.array(page.headings)
    ahead = np.flatnonzero(core)
    to_core = np.full(len(core), NEAR + 1)
    if len(ahead):
        near = np.searchsorted(ahead, np.arange(len(core)))
        to_core = np.where(near < len(ahead), ahead[np.minimum(near, len(ahead) - 1)] - np.arange(len(core)), NEAR + 1)
    need = core | (kept & (heading > 0) & (to_core <= np.where(heading <= 2, NEAR, 1)))
    parents = [p for _, p, _ in page.regions]
    needed, held = _sums(need.astype(np.float64), place, parents), _sums(np.where(core, chars, 0), place, parents)
    around, r = set(), int(place[first])
    while r:
        around.add(r)
        r = parents[r]
    region = 0
    whole = [r for r in sorted(around) if page.regions[r][0] == "article" and held[r] * 2 > held[0]] + [r for r in sorted(around) if page.regions[r][0] == "main" and held[r] >= SHARE * held[0]]
    if whole:
        region = whole[0]
    elif needed[0]:
        region = max((r for r in range(len(parents)) if needed[r] == needed[0]))
    inside = [region == 0] * len(parents)
    for r in range(1, len(parents)):
        inside[r] = r == region or inside[parents[r]]
    return "\n".join(x for x, keep, r in zip(page.texts, kept.tolist(), place.tolist(), strict=True) if keep and inside[r])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""

    def step(rows: dict) -> dict:
        texts = [main_text(x) for x in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(x) for x in texts]}

    return map_slices(pages.select("page_id", "url", "html"), step, "page_id long, url string, text string, n_chars long", "html")
