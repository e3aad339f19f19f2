"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read once as a sequence of words and tags. Words score positive and
tags negative by default; the scores are log ratios fitted on labelled pages,
those that mark their own article (``<article>`` or ``<main>``). The score of a
word adds up: the kind of block that it stands in, and the marks of the elements
around it, which are their tag (``nav``, ``aside`` and the like) and their class,
id and role. One linear scan finds the contiguous region of greatest sum.

Elements that HTML or a whole class word sets apart (``aside``, ``comments``) are
taken out ahead of the scan, whatever blocks they hold: they neither add to a region
nor break it. Within an article of the page's own, no kind of block counts against a
word; outside it, on the same page, none makes up for that place. Other marks are
learned, and an element whose marks and words both score below zero is left out.
Scripts, styles and form fields are no words at all.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import bounded_ids, map_frames

SAMPLE_PAGES = 1_000
#: Kinds of the model, the commonest of the sample; others score by default.
MAX_KINDS = 4_096
#: Scores without any label: a word is text, a tag is not, a boilerplate mark less so.
WORD_WEIGHT, TAG_WEIGHT, MARK_WEIGHT = 1.0, -0.3, -2.5
#: Pseudo-counts that hold a fitted weight near these.
PRIOR = 5.0
CLIP = 4.0
#: The least that a tag counts, and what one counts within an article.
TAG_LEAST, TAG_WITHIN = -1.0, -0.02

#: A quote opens a value only where a value begins; one that never closes does not.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?)?)*+)>?|[^<]++|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)?)?", re.S)
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements whose content is no text of the page.
NO_TEXT = {
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "button", "select", "head", "title",
    "textarea", "xmp", "noembed", "noframes",
}
#: Elements that HTML means for other things than running text.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}
#: Class, id and role words of such blocks, and words that may follow them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice notices pagination popup promo "
    "promotion related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
HOLDERS = frozenset(
    "area bar block bottom box buttons container content form icons inner items left links list main outer overlay panel posts "
    "right section slot space stories thread top unit wrap wrapper".split()
)
CONTENT = {"article", "main"}
#: Elements that are the page or its article, or name a part of it: never boilerplate by a class.
NEUTRAL = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Open elements that a new block closes, as browsers do.
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


def boilerplate_word(word: str) -> bool:
    """Whether a whole class word names boilerplate: ``ad``, ``cookie-notice``,
    ``related-posts``; not ``has-sidebar``, ``comments-open`` or ``related-work``."""
    first, *rest = re.split(r"[-_]+", word.lower().strip("-_"))
    return first in BOILERPLATE and all(x in BOILERPLATE or x in HOLDERS or x.isdigit() for x in rest)


@dataclass
class Page:
    """A page in order: ``kinds`` and ``texts`` of its tokens, whether each lies in
    an article of the page's own, and its marked elements.

    Text tokens have kind ``w:block`` and their decoded text; tags have kind
    ``<name`` or ``</name``, and a text of None for inline tags and '' for those
    that end a block. ``spans`` are (marks, start, end), ``apart`` the (start, end) of
    elements set apart, ``forms`` those of forms. ``labelled`` holds if the page marks an article.
    """

    kinds: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    content: list[bool] = field(default_factory=list)
    spans: list[tuple[list[str], int, int]] = field(default_factory=list)
    apart: list[tuple[int, int]] = field(default_factory=list)
    forms: list[tuple[int, int]] = field(default_factory=list)
    labelled: bool = False

    def dropped(self, forms: bool = True) -> list[bool]:
        """Whether each token lies in an element set apart; a form that holds the
        article is not one."""
        first = self.content.index(True) if self.labelled and True in self.content else -1
        spans = self.apart + [(lo, hi) for lo, hi in self.forms if forms and not lo <= first < hi]
        steps = [0] * (len(self.kinds) + 1)
        for lo, hi in spans:
            steps[lo] += 1
            steps[hi] -= 1
        return [d > 0 for d in accumulate(steps[: len(self.kinds)])]


def _marks(name: str, attributes: str, inside: bool, first: bool) -> list[str]:
    """Marks of an element. An article is the page's own if it is the ``first``."""
    marks = [f"!{name}"] if name in ASIDE or (name == "header" and not inside) else []
    if (name not in NEUTRAL or (name == "article" and not first)) and attributes:
        for m in ATTRIBUTE.finditer(attributes):
            if m[2] and m[1].lower() in ("class", "id", "role"):
                marks += [f".{w.lower()}" for w in html.unescape(m[2].strip("\"'")).split()]
    return marks


def parse(page: str | None) -> Page:
    """The page's tokens in one pass, linear in its length whatever the markup."""
    out = Page()
    page = page or ""
    # name, no text, in an article, set apart, kind of block, marks, start
    stack: list[tuple[str, bool, bool, bool, str, list[str], int]] = []
    open_names: Counter = Counter()
    closable = 0
    endless: set[str] = set()

    def pop() -> None:
        nonlocal closable
        name, _, _, _, _, marks, start = stack.pop()
        open_names[name] -= 1
        closable -= name in CLOSED_BY_BLOCK
        if marks:
            span = start, len(out.kinds)
            out.spans.append((marks, *span))
            if any(w[0] == "." and boilerplate_word(w[1:]) or w[0] == "!" and name != "form" for w in marks):
                out.apart.append(span)
            elif name == "form":
                out.forms.append(span)

    def state() -> tuple[bool, bool, bool, str]:
        return stack[-1][1:5] if stack else (False, False, False, "body")

    def add(kind: str, text: str | None, inside: bool) -> None:
        out.kinds.append(kind)
        out.texts.append(text)
        out.content.append(inside)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        piece = m[0]
        silent, inside, other, block = state()
        if piece[0] != "<" or piece == "<":
            if not silent:
                add(f"w:{block}", html.unescape(piece), inside)
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        spacing = None if name in INLINE else ""
        if m[1]:
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            if not silent:
                add(f"</{name}", spacing, inside)
            continue
        if name not in INLINE:
            if closable:  # an inline element left open ends with its block
                while stack[-1][0] in INLINE:
                    pop()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK and name not in VOID:
                pop()
            if name == "li" and stack and stack[-1][0] == "li":
                pop()
            silent, inside, other, block = state()
        marks = [] if silent else _marks(name, m[3], inside, not out.labelled)
        if name not in INLINE and name not in CONTENT and name != "html":
            block = name
        elif name == "a" and not block.endswith(".a"):
            block = f"{block}.a"
        other = other or any(w[0] == "!" and name != "form" or w[0] == "." and boilerplate_word(w[1:]) for w in marks)
        here = inside or (name in CONTENT and not other)
        out.labelled |= here
        start = len(out.kinds)
        if not silent and name not in NO_TEXT:
            add(f"<{name}", spacing, here)
        if name in VOID:
            continue
        if name in RAW and name not in endless:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif name in ("script", "style"):
                break
            else:  # never closed: what follows is the page's text again
                endless.add(name)
            continue
        if name in RAW:
            continue
        stack.append((name, silent or name in NO_TEXT, here, other, block, marks, start))
        open_names[name] += 1
        closable += name in CLOSED_BY_BLOCK
    while stack:
        pop()
    return out


def _default(kind: str) -> float:
    if kind[0] == "w":
        return WORD_WEIGHT
    if kind[0] == "!":
        return MARK_WEIGHT
    if kind[0] == ".":
        return MARK_WEIGHT if boilerplate_word(kind[1:]) else 0.0
    return TAG_WEIGHT


def weight_of(kind: str, weights: dict[str, float]) -> float:
    found = weights.get(kind)
    return _default(kind) if found is None else found


def fit_counts(page: str | None) -> Counter | None:
    """(kind, inside) counts of one labelled page; None if it has no article.

    A block's kind counts its words, a mark those of its elements.
    """
    seen: Counter = Counter()
    parsed = parse(page)
    if not parsed.labelled:
        return None
    sums = {True: [0], False: [0]}
    for kind, text, content, dropped in zip(parsed.kinds, parsed.texts, parsed.content, parsed.dropped()):
        inside = content and not dropped
        words = len(text.split()) if kind[0] == "w" else 0
        for side in (True, False):
            sums[side].append(sums[side][-1] + words * (side == inside))
        n = words if kind[0] == "w" else 1
        if n and kind.strip("</") not in CONTENT:
            seen[kind, inside] += n
    for marks, start, end in parsed.spans:
        for mark in marks:
            for side in (True, False):
                n = sums[side][end] - sums[side][start]
                if n:
                    seen[mark, side] += n
    return seen


def weights_from(counts: list[tuple[str, bool, int]]) -> dict[str, float]:
    """log P(kind | inside) / P(kind | outside), shrunk to the defaults."""
    total = {(tag, side): 0.0 for tag in (True, False) for side in (True, False)}
    by: dict[str, dict[bool, float]] = {}
    for kind, inside, n in counts:
        if kind[0] in "w<":
            total[kind[0] == "<", inside] += n
        by.setdefault(kind, {True: 0.0, False: 0.0})[inside] += n
    out = {}
    for kind, n in by.items():
        tag, default = kind[0] == "<", _default(kind)
        a = (n[True] + PRIOR * math.exp(default / 2)) / (total[tag, True] + 2 * PRIOR)
        b = (n[False] + PRIOR * math.exp(-default / 2)) / (total[tag, False] + 2 * PRIOR)
        ratio = max(-CLIP, min(CLIP, math.log(a / b)))
        # Tags stay negative and boilerplate marks do; labels set how much.
        if tag:
            ratio = max(TAG_LEAST, min(ratio, -0.05))
        elif default < 0:
            ratio = min(ratio, MARK_WEIGHT / 2)
        out[kind] = ratio
    return out


def best_region(weights: list[float]) -> tuple[int, int]:
    """[start, end) of greatest sum; empty if no sum is positive. One pass."""
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for k, w in enumerate(weights):
        if total <= 0:
            total, start = 0.0, k
        total += w
        if total > best[0]:
            best = (total, start, k + 1)
    return best[1], best[2]


def _scores(page: Page, weights: dict[str, float], blocks: dict[str, float], dropped: list[bool]) -> list[float]:
    """The score of each token."""
    steps = [0.0] * (len(page.kinds) + 1)
    for marks, start, end in page.spans:
        w = sum(weight_of(m, weights) for m in marks if m != "!form")
        steps[start] += w
        steps[end] -= w
    scores = []
    for kind, text, content, apart, extra in zip(page.kinds, page.texts, page.content, dropped, accumulate(steps)):
        if apart:
            score = 0.0
        elif kind[0] != "w":
            score = TAG_WITHIN if content else weight_of(kind, blocks)
        else:
            block = weight_of(kind, blocks)
            score = max(block, WORD_WEIGHT) if content else max(-CLIP, min(CLIP, block + extra))
            if not content and extra < 0:
                score = min(score, extra / 2)
            if not content and page.labelled:
                score = min(score, MARK_WEIGHT / 2)
            score *= len(text.split())
        scores.append(score)
    return scores


def region_of(page: Page, weights: dict[str, float]) -> tuple[int, int, list[float], list[bool]]:
    """(start, end, scores, dropped) of the best region.

    Where no run of blocks scores above zero with the fitted weights, as on a page
    built from blocks that labelled pages use for other things, blocks score by
    default; where forms hold all text, they are not set apart.
    """
    for forms in (True, False):
        dropped = page.dropped(forms)
        for blocks in (weights, {}):
            scores = _scores(page, weights, blocks, dropped)
            start, end = best_region(scores)
            if end > start:
                return start, end, scores, dropped
    return 0, 0, scores, dropped


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks in page order, joined by one space."""
    parsed = parse(page)
    start, end, scores, dropped = region_of(parsed, weights)
    sums = [0.0, *accumulate(s if k[0] == "w" else 0.0 for s, k in zip(scores, parsed.kinds))]
    depth = [0] * (len(scores) + 1)
    for marks, lo, hi in parsed.spans:
        if sums[hi] < sums[lo] and sum(weight_of(m, weights) for m in marks if m != "!form") < 0:
            depth[lo] += 1
            depth[hi] -= 1
    parts = []
    for k, left_out in enumerate(accumulate(depth[:end])):
        if k < start:
            continue
        text = parsed.texts[k]
        if parsed.kinds[k][0] != "w":
            if text is not None:
                parts.append(" ")
        elif not left_out and not dropped[k]:
            parts.append(text)
    return " ".join("".join(parts).split())


def fit_weights(df: DataFrame, id_col: str, html_col: str, sample_pages: int) -> dict[str, float]:
    """Weights from at most ``sample_pages`` labelled pages of the input."""
    ids = bounded_ids(df.select(F.col(id_col).alias("chosen")), "chosen", sample_pages)
    sample = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(
        F.broadcast(ids), F.col("id") == F.col("chosen")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(fit_counts(page) or {})
            yield pd.DataFrame([(k, i, n) for (k, i), n in total.items()], columns=["kind", "inside", "n"])

    rows = map_frames(sample.select("html"), run, "kind string, inside boolean, n long")
    kinds = rows.groupBy("kind", "inside").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "kind", "inside").limit(MAX_KINDS)
    return weights_from([(r["kind"], r["inside"], r["n"]) for r in kinds.collect()])


def extract_pages(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    weights: dict[str, float] | None = None,
    sample_pages: int = SAMPLE_PAGES,
) -> DataFrame:
    """One row per row of ``df``: id, url, text, n_chars.

    Null and empty pages, and pages without a region of positive score, have
    empty text. An attribute's quote counts only where its value begins. White space inside a block becomes one space. Cut-off tags at
    the end of a page are tags, cut-off references stay as they are. Repeated
    rows and null ids stay. Other columns of ``df`` are ignored.
    """
    if weights is None:
        weights = fit_weights(df, id_col, html_col, sample_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(p, weights) for p in batch["html"]]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = map_frames(rows, run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
