"""Main text of web pages: the contiguous region in which words outweigh tags most.

A page becomes a sequence of tags and words. Every word outside menus, notices, scripts and the like scores
one; every tag costs something. One linear scan finds the region with the largest sum, and its words are the text.
What a tag costs is counted on labelled pages, that is pages that mark their article: a tag seen outside
articles much more often than inside is dear, so that a region hardly crosses it.

Defined cases: a null or empty page has the text ""; of regions with equal sums the first and longest wins;
broken markup (missing ends, cut-off tags, comments that never close) is read to the end of the page; repeated rows
are read row by row; without labelled pages all tags cost one word; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements by what they do in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre search section "
    "select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "nav footer aside form header button select option dialog menu head svg canvas object audio video map search fieldset".split()
)
NESTED = LEFT_OUT | frozenset("article main div section ul ol dl table tr td th figure details blockquote li span p".split())
ARTICLE = frozenset(("article", "main"))
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond response responses widget pagination pager form search "
    "skip hidden sr".split()
)
#: A class name with one of these words says how its element is laid out, not what it is.
STATES = frozenset("has no with without is not layout open closed enabled disabled active hide show".split())
#: Words at the end of a class name that leave its meaning to the word before.
HOLDERS = frozenset(
    "wrap wrapper container inner outer area box block section region row column col list item items group bar button buttons link "
    "links post posts article articles story stories news slot unit panel pane zone top bottom left right main site page "
    "global primary secondary desktop mobile".split()
)
#: Class names that end so, or are so called, name what is read.
READ = frozenset("article content contents post entry hentry story text body main prose".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Inside an article its own header is text.
KEPT_IN_ARTICLE = frozenset(("header",))
#: Most that a tag within running text can cost, in words.
INLINE_MOST = 0.5
#: What a cue adds to the cost of the tag of an element that is not left out for it, in words.
CUE_COST = 5.0

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
ARTICLE_TAG = re.compile(r"<(?:article|main)(?=[\s/>])", re.IGNORECASE)
#: Marks a tag that a cue makes dearer.
CUE = "cue"
CUE_WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _says(name: str) -> str:
    """What a class or id says of its element: "furniture", "read", "hint" (a cue among other words) or ""."""
    words = CUE_WORDS.findall(CAMEL.sub("-", name).lower())
    if not words or CUES.isdisjoint(words):
        return "read" if words and words[-1] in READ else ""
    if not STATES.isdisjoint(words):
        return "hint"
    if words[-1] in READ and len(words) > 1:
        # the last word says what it is, unless it is what the furniture is about: related posts
        return "hint" if words[-1] in ("article", "content", "text", "body", "story", "entry") else "furniture"
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return "furniture" if words[-1] in CUES else "hint"


def element_kind(name: str, attributes: str) -> str:
    """"out" for page furniture by its name, role or because it is hidden; "cue" where class or id say so and nothing speaks
    against it; "hint" where they only hold such a word; else ""."""
    if name in LEFT_OUT:
        return "out"
    if not attributes or name in ("body", "html"):
        return ""
    said: set[str] = set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            said.update(map(_says, value.split()))
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "out"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return "out"
    if "furniture" in said and "read" not in said and name not in ARTICLE:
        return "cue"
    return "hint" if {"furniture", "hint"} & said else ""


def _holds_article(page: str, name: str, at: int, articles: list[int]) -> bool:
    """Whether an element that begins before ``at`` is still open where the next article or main begins."""
    i = bisect_left(articles, at)
    if i == len(articles):
        return False
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.IGNORECASE).finditer(page, at, articles[i]):
        depth += -1 if m[1] else 1
        if not depth:
            return False
    return True


def pieces(page: str) -> Iterator[tuple[str, str, bool]]:
    """The page as (tag name or "", text, in an article); text of page furniture is not given, its tags are.

    An element is left out for its class or id only if it is no article or main and holds none. A tag whose class or id holds
    such a word without deciding comes with the text ``CUE``.
    """
    at, stack, out_depth, article_depth = 0, [], 0, 0
    articles = [m.start() for m in ARTICLE_TAG.finditer(page)]
    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        start = m.start() if m else n
        if start > at and not out_depth:
            yield "", entities.unescape(page[at:start]), article_depth > 0
        if m is None:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in NESTED and any(x[0] == name for x in stack):
                while True:
                    closed, out, art = stack.pop()
                    out_depth -= out
                    article_depth -= art
                    if closed == name:
                        break
            yield name, "", article_depth > 0 and name not in ARTICLE
            continue
        kind = element_kind(name, m[3]) if name in NESTED else ""
        yield name, CUE if kind == "hint" else "", article_depth > 0
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
            continue
        if name in NESTED and name not in VOID and not m[3].endswith("/"):
            if name == "p" or name == "li":
                continue  # their ends are often missing; nothing hangs on them
            out = kind == "out" and not (article_depth and name in KEPT_IN_ARTICLE)
            out = out or kind == "cue" and not _holds_article(page, name, at, articles)
            art = name in ARTICLE and not out_depth and not out
            stack.append((name, out, art))
            out_depth += out
            article_depth += art


def count_tags(page: str) -> Counter:
    """(tag, in an article) to count, for a page that marks its article; nothing for others."""
    counts: Counter = Counter()
    seen = False
    for name, _, inside in pieces(page):
        if name:
            counts[(name, inside)] += 1
            seen |= inside
    return counts if seen else Counter()


def costs(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Tag to cost in words, from how often it stands inside and outside articles: the odds of standing outside."""
    out = {}
    for tag, (inside, outside) in counts.items():
        odds = (outside + 1) / (inside + 1)
        out[tag] = min(odds, INLINE_MOST) if tag in INLINE or tag == "br" else odds
    return out


def main_text(page: str | None, cost: dict[str, float]) -> str:
    """Text of the region with the largest sum of words less tag costs."""
    if not page:
        return ""
    parts: list[str] = []
    best = total = 0.0
    best_range = (0, 0)
    begin = 0
    for name, text, _ in pieces(page):
        if name:
            total -= cost.get(name, 1.0 if name in BLOCKS else INLINE_MOST) + (CUE_COST if text is CUE else 0.0)
            parts.append(" " if name in BLOCKS else "")
        else:
            parts.append(text)
            total += len(text.split())
        if total < 0:
            total, begin = 0.0, len(parts)
        elif total > best or total == best and begin == best_range[0]:
            best, best_range = total, (begin, len(parts))
    return " ".join("".join(parts[slice(*best_range)]).split())


def tag_costs(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Costs counted on all pages that mark their article; one small row per tag of HTML comes to the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch[html]:
                if page:
                    total.update(count_tags(page))
        known = [(t, int(i), c) for (t, i), c in total.items() if t in BLOCKS or t in INLINE]
        yield pd.DataFrame(known, columns=["tag", "inside", "n"])

    rows = (
        pages.select(html)
        .filter(F.lower(F.col(html)).rlike("<(article|main)[\\s>]"))
        .mapInPandas(counted, "tag string, inside int, n long")
        .groupBy("tag")
        .agg(
            F.sum(F.when(F.col("inside") == 1, F.col("n")).otherwise(0)).alias("inside"),
            F.sum(F.when(F.col("inside") == 0, F.col("n")).otherwise(0)).alias("outside"),
        )
        .collect()
    )
    return costs({r.tag: (r.inside, r.outside) for r in rows})


def extract_main_text(pages: DataFrame, html: str = "html", cost: dict[str, float] | None = None) -> DataFrame:
    """The rows with ``text`` (main text, "" if none) and ``n_chars`` (its code points).

    ``cost``: tag costs in words; counted on the pages themselves where none are given.
    """
    prices = tag_costs(pages, html) if cost is None else cost

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, prices) for page in batch], dtype=object)

    return pages.withColumn("text", text(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))
