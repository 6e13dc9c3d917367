"""Main text of web pages by tag-path ratios (after Wu, Li, Hu and Wang, "Web news extraction via path ratios", 2013).

Every block of text has a path of tags from the root. Per page and path the text's length, its punctuation and its
blocks are summed. The ratios of length and of punctuation to blocks are smoothed over paths that follow each other in
one container, then fused with each other, with the path's own text, and with what the path's names say: a path through a menu, header,
footer, form, aside, notice, advert, comment or hidden element counts nothing, as a short article has less text than
many a footer. A path is content from THRESHOLD of the page's largest fused ratio. The content blocks' common
container is the article; within it a path's ratio is drawn half way to the article's own, so that headings,
list items and short blocks stay with the paragraphs around them. Blocks of paths that pass are the text, in or out of an
article element; those of paths that don't are left out. One pass over the rows without a shuffle, linear in a page.

Cases: null or blank html gives an empty text; broken markup is read as browsers do where it matters (a new
block ends an open paragraph, unmatched end tags are ignored, script and style run to their own end tag); once a quote
in a tag never closes, quotes no longer count in that page's tags; a page without any markup is one block; rows without a
page_id take no part, repeated rows stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Share of the largest fused ratio from which a path is content, and share of the content's text that the article encloses.
THRESHOLD, ENCLOSED = 0.3, 0.6

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)"
_TAG = re.compile(rf"{_OTHER}((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
#: The same where a quote never closes: quotes don't count.
_PLAIN = re.compile(rf"{_OTHER}([^>]*+)(>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[,.;:!?¡¿、。，]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object audio video title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never of the article.
BOILERPLATE = frozenset("head nav footer aside form button select menu dialog fieldset label option search".split())
#: Words of class or role that mark such an element, and whole ids outside an article; headings are never marked.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies copyright dialog disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup promo promoted promotion related "
    "replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar trending widget".split()
)
ARTICLE = frozenset("article main".split())
PAGE = ARTICLE | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block of their container.
FLOW = HEADINGS | frozenset("p li dt dd ul ol dl td th tr tbody thead tfoot table caption blockquote pre figcaption figure hgroup".split())
#: End tags that an opening tag implies, and the elements that stop the search for them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select".split())
_P, _NOT_P = frozenset({"p"}), BLOCK - {"p"}


@lru_cache(4096)  # pages share their templates
def named(attributes: str) -> dict[str, str]:
    """Attributes by name in lower case, the first of each."""
    out: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(attributes):
        out.setdefault(a[1].lower(), (a[2] or a[3] or a[4] or "").strip().lower())
    return out


def unseen(own: dict[str, str]) -> bool:
    return own.get("hidden", "false") != "false" or own.get("aria-hidden") == "true" or "hidden" in own.get("class", "").split() or bool(_UNSEEN.search(own.get("style", "")))


@lru_cache(256)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*+>?", re.I)


class Page:
    """Elements (parent, path) and blocks (element, text) of a page, both in page order; element and path 0 are the page's."""

    def __init__(self, page: str):
        self.parent, self.path, self.name, self.inside = [0], [0], [""], [False]
        self.cue, self.holder = [1.0], [0]  # of a path: 0 if its names rule it out, else 1; and the path of its container
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int, bool]] = []  # name, element (inline ones: that around them), whether its text is unseen
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        self._read(page)

    def _top(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _close_block(self) -> None:
        if self._text:
            joined = _SPACE.sub(" ", entities.unescape("".join(self._text))).strip()
            self._text.clear()
            if joined:
                self.blocks.append((self._top(), joined))

    def _cut(self, depth: int) -> None:
        """Close all elements from a depth on."""
        if any(t in BLOCK for t, _, _ in self._stack[depth:]):
            self._close_block()
        for t, _, _ in self._stack[depth:]:
            self._open[t] -= 1
        del self._stack[depth:]

    def _last(self, names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> int:
        if any(self._open[n] for n in names):
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] in names:
                    return i
                if self._stack[i][0] in stop:
                    break
        return -1

    def _read(self, page: str) -> None:
        at, tag = 0, _TAG
        while m := tag.search(page, at):
            if m[2] and not m[4] and tag is _TAG:
                tag = _PLAIN
                m = tag.match(page, m.start())
            if not (self._stack and self._stack[-1][2]):
                self._text.append(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name, attributes = m[2].lower(), m[3]
            if m[1]:
                if (depth := self._last({name})) >= 0:
                    self._cut(depth)
                elif name in BLOCK:
                    self._close_block()
            elif name == "br":
                self._text.append(" ")
            elif name in RAW:
                if not attributes.endswith("/"):
                    end = _end_of(name).search(page, at)
                    at = end.end() if end else len(page)
            elif name in VOID:
                if name in BLOCK:
                    self._close_block()
            else:
                self._begin(name, attributes)
        if not (self._stack and self._stack[-1][2]):
            self._text.append(page[at:])
        self._close_block()

    def _begin(self, name: str, attributes: str) -> None:
        own = named(attributes) if attributes else {}
        if name not in BLOCK:
            hides = bool(self._stack and self._stack[-1][2]) or bool(own) and unseen(own)
            if hides or self._open[name]:  # others change nothing
                self._stack.append((name, self._top(), hides))
                self._open[name] += 1
            return
        self._close_block()
        if (p := self._last(_P, _NOT_P)) >= 0:
            self._cut(p)
        if name in ENDS and (i := self._last(ENDS[name], LISTS)) >= 0:
            self._cut(i)
        around = self._top()
        inside = self.inside[around]
        words = set(_WORD.findall(f"{own.get('class', '')} {own.get('role', '')}")) if own else set()
        if own and not inside:
            words.add(own.get("id", ""))
        free = name in PAGE or name in HEADINGS
        marked = name in BOILERPLATE or name == "header" and not inside or own and unseen(own) or not free and words & MARKS
        label = f"{name}!" if marked else name
        before = self.path[around]
        path = self.paths.get((before, label))
        if path is None:
            path = self.paths[before, label] = len(self.cue)
            self.cue.append(0.0 if marked else self.cue[before])
            self.holder.append(self.holder[before] if label in FLOW else path)
        self._stack.append((name, len(self.parent), bool(self._stack and self._stack[-1][2])))
        self._open[name] += 1
        self.parent.append(around)
        self.path.append(path)
        self.name.append(name)
        self.inside.append(inside or name in ARTICLE or "main" in words)


def ratios(page: Page) -> tuple[list[int], np.ndarray]:
    """Paths in the order in which their text first comes, and the length, punctuation and number of the blocks of each."""
    order: dict[int, int] = {}
    sums: list[list[int]] = []
    for element, text in page.blocks:
        path = page.path[element]
        if path not in order:
            order[path] = len(sums)
            sums.append([0, 0, 0])
        x = sums[order[path]]
        x[0] += len(text)
        x[1] += len(_PUNCTUATION.findall(text))
        x[2] += 1
    return list(order), np.array(sums, float).reshape(-1, 3)


def smoothed(ratio: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Each ratio with half of those before and after it, as far as they are of the same container."""
    same = (holders[1:] == holders[:-1]) / 2
    total, weight = ratio.copy(), np.ones(len(ratio))
    total[1:] += same * ratio[:-1]
    total[:-1] += same * ratio[1:]
    weight[1:] += same
    weight[:-1] += same
    return total / weight


def fused(page: Page, paths: list[int], sums: np.ndarray) -> np.ndarray:
    """The fused ratio of every path: length, punctuation, the path's own text in all, and its names."""
    holders = np.array([page.holder[p] for p in paths])
    length = smoothed(sums[:, 0] / sums[:, 2], holders)
    marks = smoothed((sums[:, 1] + 1) / sums[:, 2], holders)
    # a path's own text counts as well, so that a long advert doesn't outdo many paragraphs
    return length * np.sqrt(marks) * np.log1p(sums[:, 0]) * np.array([page.cue[p] for p in paths])


def selected(page: Page) -> list[str]:
    """The texts of content blocks."""
    if not page.blocks:
        return []
    paths, sums = ratios(page)
    score = fused(page, paths, sums)
    least = THRESHOLD * score.max()
    if not least > 0:
        return []
    of = dict(zip(paths, score.tolist(), strict=True))
    held = np.zeros(len(page.parent))
    for element, text in page.blocks:
        if of[page.path[element]] >= least:
            held[element] += len(text)
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
    article = int(np.flatnonzero(held >= ENCLOSED * held[0])[-1])  # the deepest: more than half lies on one line of descent
    while page.name[article] in FLOW:
        article = page.parent[article]
    if page.inside[article]:
        while page.inside[page.parent[article]]:
            article = page.parent[article]
    within = np.zeros(len(held), bool)
    within[article] = True
    for i in range(article + 1, len(held)):
        within[i] = within[page.parent[i]]
    inner = [of[page.path[e]] for e, _ in page.blocks if within[e]]
    whole = float(np.average(inner, weights=[len(t) for e, t in page.blocks if within[e]])) if inner else 0.0
    drawn = {p: max(s, (s + whole * page.cue[p]) / 2) for p, s in of.items()}
    return [t for e, t in page.blocks if (drawn if within[e] else of)[page.path[e]] >= least]


def main_text(page: str | None) -> str:
    return "\n".join(selected(Page(page or "")))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text of each."""

    def texts(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.withColumn(out_col, F.pandas_udf(texts, "string")(F.col(html_col)))


def op5_tag_path_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.identified(common.table(spark, sf_dir, "pages"), "page_id").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
