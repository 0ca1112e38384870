"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; no tree is built. Events become lines, one for each
run of text between block boundaries, each with its text length, its link text length, the tags
seen in it and the container it stands in. A line's ratio is its own text, links left out, per tag.
The logarithms of the ratios are smoothed with a Gaussian, beyond the page's ends as if there were no
text, and a threshold parts them into two clusters (the split that explains most of their variance).
Lines of the upper cluster are content unless their own ratio, parted in the same way, is in the lower
one and only their neighbours lifted them; and content decides all that follows:

* Where article or main elements hold half of the content or more, the one that holds most is
  returned whole but for chrome (and its inner one, if that holds nearly all), or all of them if none
  holds half alone.
* Elsewhere content lines are returned with what belongs to them: the lines of text that stand directly
  in the same container, the lines between two content blocks that stand side by side, and the heading
  above with what stands under it. Lines that are mostly links stay out.

Names are a prior only, for what is never content: scripts, styles, navigation, page headers and
footers, asides, forms, hidden parts, and containers whose class, id or role names them as adverts,
notices, menus, reader comments and the like. A class or id names chrome if all its parts are such names
or words of layout, or its last part is a name that means nothing else; headings are never chrome by
name, nor is an element, forms included, that holds the only article or main element, or nearly all text of the page
or its article.

Defined cases: null and empty html give an empty text; a page whose lines are all alike is content as a
whole; truncated markup is read to its end, open elements counting as closed; pages of any length and
depth take time in proportion; a tie of containers goes to the first; repeated rows give repeated
results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGMA = 1.0
SHARE = 0.8  # of an article's content that its inner article must hold to take its place

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body div main section center".split())
BOUNDS = CONTAINERS | {"td", "table", "blockquote"}  # an open paragraph outside them stays open
OUT = frozenset(
    "applet audio aside button canvas datalist dialog embed footer form frame frameset head iframe input map menu nav noembed noframes noscript object "
    "progress script search select style svg template textarea title video".split()
)
WRAPPING = frozenset(["form"])  # chrome, unless it holds the page: some frameworks put all of it into one form
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
SIBLINGS = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select", "datalist"})}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus dropdown footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall "
    "popup promo promoted promotion recommended related replies reply respond search share sharing shares sidebar sidenav signup skip social sponsor sponsored "
    "subscribe subscription tags toc toolbar topbar tracking widget widgets".split()
)
STRONG = frozenset("adbox adsense advert adverts advertisement breadcrumb breadcrumbs commentlist disqus footer masthead navbar newsletter pager pagination popup sidebar sidenav signup toolbar topbar widget widgets".split())
ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments promo promoted reply replies sponsored".split())
LAYOUT = frozenset(
    "area article bar block body bottom box button buttons center col column container content desktop fixed form global group head icon icons inline inner item items left links list "
    "lower main message mobile outer page panel post posts primary right row secondary section site slot sticky thread top unit upper wrap wrapper".split()
)
MODIFIERS = frozenset("has with without no not hide is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNFINISHED = re.compile(r"<[A-Za-z/!?]")  # a tag or comment that the page ends in
NAME_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _chrome_token(token: str, names: frozenset[str]) -> bool:
    parts = [x.lower() for x in NAME_SPLIT.split(token) if x]
    if not parts or not MODIFIERS.isdisjoint(parts):
        return False
    if parts[-1] in STRONG and parts[-1] in names:
        return True
    return not names.isdisjoint(parts) and all(x in names or x in LAYOUT for x in parts)


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's attributes hide it or give it a role that is chrome."""
    for k, v in attrs:
        if k == "hidden":
            return True
        if not v:
            continue
        if k == "role" and v.strip().lower() in ROLES:
            return True
        if k == "aria-hidden" and v.strip().lower() == "true":
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


def _named_chrome(attrs: list[tuple[str, str | None]], tag: str, in_main: bool) -> bool:
    """Whether an element's class or id calls it chrome; a header inside the article holds its title and stays."""
    if tag in ("body", "html", "main") or tag in HEADINGS:
        return False
    names = ARTICLE_NAMES if tag == "article" else NAMES - {"header", "masthead"} if in_main else NAMES
    return any(k in ("class", "id") and v and any(_chrome_token(x, names) for x in v.split()) for k, v in attrs)


class Lines(HTMLParser):
    """Turns parser events into lines (text, plain length, tags, container, heading), without the elements of `spared` as chrome.

    Elements that are chrome by name are numbered in order; `held` has the text length in each, `mains` the
    article and main elements outside all of them (0) and in each outermost one.
    """

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared = spared
        self.named = 0  # elements that are chrome by name, so far
        self.open_named: list[tuple[int, int]] = []  # depth in the stack, number
        self.held = [0]
        self.in_article = [False]
        self.mains: dict[int, int] = {}
        self.hard = 0  # open elements that are chrome whatever they hold
        self.all_text = self.article_text = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.up = [0]  # the element, chrome by name, that each one stands in
        self.count: Counter[str] = Counter()  # open elements by tag
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, chrome, container, hard chrome
        self.parents = [0]
        self.tags_of = ["body"]  # of each container
        self.whole: set[int] = set()  # containers that are article or main elements
        self.container = 0
        self.chrome = 0
        self.parts: list[str] = []
        self.linked = 0
        self.tags = 0
        self.in_link = 0
        self.main = 0  # open article and main elements

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                heading = bool(self.stack) and self.stack[-1][0] in HEADINGS
                self.lines.append((text, max(0, len(text) - self.linked), self.tags, self.container, heading))
            self.parts, self.linked, self.tags = [], 0, 0

    def push(self, tag: str, chrome: bool, hard: bool = False, number: int = 0) -> None:
        if number:
            self.open_named.append((len(self.stack), number))
        if tag in ("article", "main") and not hard and not self.hard:
            at = self.open_named[0][1] if self.open_named else 0
            self.mains[at] = self.mains.get(at, 0) + 1
        self.hard += hard
        container = 0
        if tag in CONTAINERS and not self.chrome and not chrome:
            self.parents.append(self.container)
            self.tags_of.append(tag)
            container = self.container = len(self.parents) - 1
            if tag in ("article", "main"):
                self.whole.add(container)
        self.stack.append((tag, chrome, container, hard))
        self.count[tag] += 1
        self.chrome += chrome
        self.main += tag in ("article", "main")

    def pop(self) -> None:
        tag, chrome, container, hard = self.stack.pop()
        self.count[tag] -= 1
        if self.open_named and self.open_named[-1][0] == len(self.stack):
            self.open_named.pop()
        self.hard -= hard
        self.chrome -= chrome
        self.main -= tag in ("article", "main")
        if container:
            self.container = self.parents[container]

    def close_open(self, names: set[str], stops: set[str]) -> None:
        if not any(self.count[x] for x in names):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in names:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in stops or tag in BOUNDS or tag in OUT:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link += 1
        block, out = tag in BLOCKS, tag in OUT
        if tag in ("br", "img", "wbr"):
            if not self.chrome:
                self.parts.append(" " if tag == "br" else "")
            return
        hard = (out and tag not in WRAPPING) or (tag == "header" and not self.main) or _hidden(attrs)
        number = 0
        if not hard and not self.hard and (tag in WRAPPING or _named_chrome(attrs, tag, self.main > 0)):
            number = self.named = self.named + 1
            self.held.append(0)
            self.up.append(self.open_named[-1][1] if self.open_named else 0)
            self.in_article.append(self.main > 0)
        chrome = hard or number > 0 and number not in self.spared
        if not block and not chrome and not number:
            return
        if block:
            self.flush()
            self.in_link = 0
            if tag in CLOSES_P:
                self.close_open({"p"}, set())
            if tag in SIBLINGS:
                names, stops = SIBLINGS[tag]
                self.close_open(set(names.split()), stops)
            if tag == "body":
                while self.stack and self.stack[-1][0] in ("head", "title"):
                    self.pop()
        if tag not in VOID:
            self.push(tag, chrome, hard, number)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg",) or tag in OUT and tag not in VOID and tag not in ("script", "style", "textarea", "title", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in BLOCKS:
            self.flush()
        if not self.count[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == tag:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag not in BLOCKS and name in BLOCKS and tag not in OUT:
                return

    def handle_data(self, data: str) -> None:
        if not self.hard:
            size = len(data.strip())
            self.all_text += size
            self.article_text += size if self.main else 0
            if self.open_named:
                self.held[self.open_named[-1][1]] += size
        if not self.chrome:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Weighted means over neighbouring lines; beyond the ends are zeros."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratio, radius), kernel, "valid")


def threshold(x: np.ndarray) -> float:
    """The middle of the gap in the sorted values that leaves the least variance inside two clusters; the least value if all are equal."""
    v = np.sort(x)
    if len(v) < 2 or v[-1] - v[0] <= 1e-9:
        return float(v[0]) - 1.0
    n = np.arange(1, len(v))
    total = np.cumsum(v)
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(v) - n)
    between = np.where(np.diff(v) > 1e-9, n * (len(v) - n) * (high - low) ** 2, -1.0)
    at = int(between.argmax())
    return float(v[at] + v[at + 1]) / 2


def content(plain: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are in the upper cluster of the text-to-tag ratios, both smoothed and by themselves."""
    own = np.log1p(plain / np.maximum(1, tags))
    x = smooth(own)
    return (x >= threshold(x)) & (own >= threshold(own)) & (plain > 0)


def wrappers(p: Lines) -> frozenset[int]:
    """Elements that are chrome by name only, but hold the page's article: no chrome."""
    outside = p.mains.get(0, 0) > 0
    held = list(p.held)
    for number in range(p.named, 0, -1):  # outer ones come before those that they hold
        held[p.up[number]] += held[number]
    out = set()
    for number in range(1, p.named + 1):
        whole = p.article_text if p.in_article[number] else 0 if outside else p.all_text
        if not outside and p.mains.get(number) or whole and held[number] >= SHARE * whole:
            out.add(number)
    return frozenset(out)


def parse(html: str, spared: frozenset[int] = frozenset()) -> tuple[Lines, int | None]:
    """The lines, and from which of them on they stem from a tag or comment the page ends in."""
    p = Lines(spared)
    p.feed(html)
    rest = None
    if UNFINISHED.match(p.rawdata):
        p.flush()
        rest = len(p.lines)
    p.close()
    p.flush()
    return p, rest


def _articles(p: Lines, score: np.ndarray, last: np.ndarray) -> list[int]:
    """The article and main elements that make up the text, if they hold half of the content."""
    outer, end = [], 0
    for c in sorted(p.whole):
        if c > end:
            outer.append(c)
            end = int(last[c])
    held = [score[c] for c in outer]
    if not held or 2 * sum(held) < score[0] or not score[0]:
        return []
    if 2 * max(held) < score[0]:
        return outer
    best = outer[held.index(max(held))]
    for c in sorted(p.whole):
        if best < c <= last[best] and score[c] >= SHARE * score[best]:
            best = c
    return [best]


def _blocks(p: Lines, up: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Content lines and the lines that belong to them, where no element says where the article is."""
    n = len(p.lines)
    box = np.array([x[3] for x in p.lines])
    text = np.array([2 * x[1] > len(x[0]) for x in p.lines])
    keep = up.copy()
    lines_in = np.bincount(box, minlength=len(p.parents))
    # a container of one line is a block of the container around it
    side = np.array([p.parents[c] if lines_in[c] == 1 else c for c in box])
    own = {c for c in box[up] if lines_in[c] > 1}
    keep |= text & np.isin(box, list(own))
    section = np.array([lines_in[c] == 1 and p.tags_of[c] == "section" for c in box])  # sections side by side belong together
    keep |= text & section & np.isin(side, side[up & section])
    ends: dict[int, list[int]] = {}
    for i in np.flatnonzero(keep):
        ends.setdefault(int(side[i]), [int(i), int(i)])[1] = int(i)
    for i in np.flatnonzero(text & ~keep):
        between = ends.get(int(side[i]))
        keep[i] = between is not None and between[0] < i < between[1]
    start = None  # of a heading and what follows it directly
    for i in range(n):
        if keep[i]:
            if start is not None and box[start] <= box[i] <= last[box[start]]:
                keep[start:i] |= text[start:i]
            start = None
        elif p.lines[i][4] and text[i] and (start is None or box[start] != box[i]):
            start = i
        elif start is not None and box[i] != box[start] and text[i]:
            start = None
    return keep


def main_lines(html: str | None) -> list[str]:
    if not html:
        return []
    p, rest = parse(html)
    if spared := wrappers(p):
        p, rest = parse(html, spared)
    if not p.lines:
        return []
    plain = np.array([x[1] for x in p.lines], dtype=float)
    up = content(plain, np.array([x[2] for x in p.lines], dtype=float))
    if rest is not None and rest:
        up[rest:] = False
    # containers are numbered in order: those inside come after, and end at `last`
    score, last = np.zeros(len(p.parents)), np.arange(len(p.parents))
    np.add.at(score, [x[3] for x, is_up in zip(p.lines, up) if is_up], plain[up])
    for c in range(len(p.parents) - 1, 0, -1):
        score[p.parents[c]] += score[c]
        last[p.parents[c]] = max(last[p.parents[c]], last[c])
    if articles := _articles(p, score, last):
        inside = np.zeros(len(p.parents), dtype=bool)
        for c in articles:
            inside[c : last[c] + 1] = True
        return [x[0] for x in p.lines if inside[x[3]]]
    keep = _blocks(p, up, last)
    if rest is not None and rest:
        keep[rest:] = False
    return [x[0] for x, is_kept in zip(p.lines, keep) if is_kept]


@F.pandas_udf(T.StringType())
def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in pages:
        yield html.map(lambda h: "\n".join(main_lines(h)), na_action=None).astype(object)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every row."""
    return pages.select(id_col, url_col, main_text(F.col(html_col)).alias("text"))
