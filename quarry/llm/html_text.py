"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score positive and most tags negative, as log
odds of being inside or outside the content; a linear scan finds the contiguous stretch of the
greatest sum. Its words are the text, a line for each block.

Elements whose name, class, id or role hints at menus, forms, notices and the like have features, and each feature a
weight that its words add to theirs. An element of features is left out before the scan if its words score below
zero in all. It isn't if it holds most of the page's article (or, without an ``article`` or ``main``, most of the page): then it wraps the
content, as a form around the page or an unclosed menu does, and only what stands before and after the article is judged.

The weights come from labelled pages, those that mark their content with one ``article`` or ``main`` element: at
most ``SAMPLE`` of them, with the least hash of the id. Tag names, links, words and features are counted, so pages
without such marks are read by the same weights. A feature's counts start from a prior (``AGAINST``, ``FOR``); labels don't say
whether an element in an article is content, so features count where they stand outside of one. Without any labelled page,
``PLAIN`` weights and the priors hold.

Defined cases: null or empty html gives empty text; a page without tags is one block; unclosed tags, comments and
attributes end with their parent or the page, as HTML has it; hidden elements are left out; repeated rows are read each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches

#: Labelled pages that give the weights at most.
SAMPLE = 2000
#: Weights where no page is labelled; "" is any other tag.
PLAIN = (
    {"word": 1.0, "link word": -0.5, "": -2.0}
    | dict.fromkeys(("p", "h1", "h2", "h3", "blockquote", "pre"), 2.0)
    | dict.fromkeys(("/p", "/h1", "/h2", "/h3", "/blockquote", "/pre", "a", "/a", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong", "span", "/span", "code", "/code", "sub", "/sub", "sup", "/sup", "br", "img"), 0.0)
)
#: The least weight of a tag but an article's own and those of ``PLAIN``, whose weights there are their least: a sample whose articles have no list must not cut one off.
LEAST = -3.0
#: Words inside and outside of the content that each feature starts from.
AGAINST, FOR = (1, 50), (50, 1)

#: Element names by their place in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
SPACES = frozenset("br td th img input button".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that end where another of their name begins, and text elements, whose ids are made from titles.
SELF_ENDING = frozenset("p li dt dd option tr td th".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre".split()) | INLINE
ARTICLES = frozenset(("article", "main"))
#: Elements that aren't the article as a rule.
ASIDE = frozenset("nav footer aside form dialog menu button select object audio video canvas".split())
#: Words of class, id and role that hint at what isn't the article, at what is, and words that undo a hint.
NOT_CONTENT = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond widget widgets toolbar pagination pager search complementary contentinfo".split())
CONTENT = frozenset("article content entry post story body text main".split())
UNDOES = frozenset("with has no of the and to in on for".split())
COMMENTS = frozenset("comment comments commentlist disqus respond".split())

_NAMES = BLOCKS | SPACES | RAW | VOID | INLINE | ASIDE
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Element:
    """``first`` and ``last`` are places of units; ``own`` are the words of an article that stand in no element of features within it."""

    name: str
    features: tuple[str, ...]
    hidden: bool
    first: int
    last: int = 0
    own: int = 0


@dataclass
class Page:
    """Units (kind, words, text, whether a block starts here, whether it stands in an article) and elements of interest: those with features, articles, hidden ones."""

    units: list[tuple[str, int, str, bool, bool]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def hints(name: str, attributes: str, marked: bool) -> tuple[tuple[str, ...], bool]:
    """Features of an element, and whether it is hidden."""
    found = [f"<{name}>"] if name in ASIDE or name == "header" and not marked else []
    hidden = False
    if "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif key in ("class", "id", "role"):
                for one in value.split():
                    parts = _NAME.findall(one)
                    if UNDOES.intersection(parts) or name in TEXTUAL and key == "id" and len(parts) > 1:
                        continue
                    against = [x for x in parts if x in NOT_CONTENT]
                    found += against or [x for x in parts if x in CONTENT]
    found = list(dict.fromkeys(found))
    return (tuple(found) if any(x not in CONTENT for x in found) else ()), hidden


def parsed(html: str) -> Page:
    page, stack = Page(), []  # names and elements that are open
    at, link, marked = 0, 0, 0
    out = page.units

    def text(run: str) -> None:
        if run:
            run = unescape(run)
            words = len(run.split())
            out.append(("link word" if link else "word", words, run, False, marked > 0))
            for _, element in reversed(stack):
                if element is not None:
                    if element.features or element.hidden:
                        break
                    element.own += words

    def close(depth: int) -> None:
        nonlocal marked
        for name, element in stack[depth:]:
            marked -= name in ARTICLES
            if element is not None:
                element.last = len(out)
        del stack[depth:]

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if not attributes.endswith("/"):
                at = end.end() if end else _after(html, at, name)
            continue
        if name == "a":
            link = 0 if closing else 1
        kind = name if name in _NAMES else ""
        # An article's own tags stand outside of it.
        inside = marked > 0 and name not in ARTICLES
        if closing:
            out.append(("/" + kind if kind else "", 0, " " if name in SPACES else "", name in BLOCKS, inside))
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                close(depth)
            continue
        if stack and stack[-1][0] == name and name in SELF_ENDING or stack and stack[-1][0] == "p" and name in BLOCKS:
            close(len(stack) - 1)
        if name not in VOID and not attributes.endswith("/"):
            features, hidden = hints(name, attributes, marked > 0) if name not in ("html", "body", *ARTICLES) else ((), False)
            element = None
            if features or hidden or name in ARTICLES:
                element = Element(name, features, hidden, len(out))
                page.elements.append(element)
            stack.append((name, element))
            marked += name in ARTICLES
        out.append((kind, 0, " " if name in SPACES else "", name in BLOCKS, inside))
    text(html[at:])
    close(0)
    return page


def _after(html: str, at: int, name: str) -> int:
    """Where an unclosed raw element ends: a head at the body, others with the page."""
    if name == "head":
        body = re.compile(r"<body\b", re.I).search(html, at)
        return body.start() if body else at
    return len(html)


def score(unit: tuple[str, int, str, bool, bool], weights: dict[str, float]) -> float:
    kind, words = unit[:2]
    return weights.get(kind, weights[""]) * (words if kind in ("word", "link word") else 1)


def weight_of(feature: str, weights: dict[str, float]) -> float:
    inside, outside = FOR if feature in CONTENT else AGAINST
    return weights.get("+" + feature, log(inside / outside))


def left_out(page: Page, scores: list[float], weights: dict[str, float]) -> list[tuple[int, int]]:
    """Stretches of units to leave out."""
    words = [0]
    for unit in page.units:
        words.append(words[-1] + unit[1])
    total = [0.0]
    for unit, x in zip(page.units, scores, strict=True):
        total.append(total[-1] + (x if unit[1] else 0.0))  # words only: a short form would else live on its paragraphs' tags
    articles = [e for e in page.elements if e.name == "article"] or [e for e in page.elements if e.name == "main"]
    main = max(articles, key=lambda e: e.own, default=None)
    main = main if main is not None and main.own else None
    out = []
    for e in page.elements:
        if e.hidden:
            out.append((e.first, e.last))
        if e.hidden or not e.features:
            continue
        spans = [(e.first, e.last)]
        if main is not None:
            if e.first <= main.first and main.last <= e.last:
                spans = [(e.first, main.first), (main.last, e.last)]
        elif 2 * (words[e.last] - words[e.first]) > words[-1] and not COMMENTS.intersection(e.features):
            spans = []
        own = sum(weight_of(f, weights) for f in e.features)
        out += [(a, b) for a, b in spans if total[b] - total[a] + own * (words[b] - words[a]) < 0 or own < 0 and words[a] == words[b]]
    return out


def best(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch of the greatest sum, the first of equal ones."""
    top, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > top:
            top, span = total, (start, i + 1)
    return span


def extract(html: str, weights: dict[str, float]) -> str:
    page = parsed(html)
    scores = [score(u, weights) for u in page.units]
    gone = [0] * (len(scores) + 1)
    for a, b in left_out(page, scores, weights):
        gone[a] += 1
        gone[b] -= 1
    depth = 0
    kept = []
    for i in range(len(scores)):
        depth += gone[i]
        kept.append(not depth)
    first, last = best([s if k else 0.0 for s, k in zip(scores, kept, strict=True)])
    lines, line = [], []
    for i in range(first, last):
        _, _, text, block, _ = page.units[i]
        if block or not kept[i] and kept[i - 1]:
            lines.append("".join(line))
            line = []
        if text and kept[i]:
            line.append(text)
    lines.append("".join(line))
    return "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)


def _page(pages: DataFrame, *keep: str) -> DataFrame:
    return pages.select(*keep, F.coalesce("html", F.lit("")).alias("html"))


def tallied(html: str) -> Counter:
    """Counts of (kind or +feature, whether inside) in a page that marks its content with one element."""
    total: Counter = Counter()
    page = parsed(html)
    articles = [e for e in page.elements if e.name in ARTICLES]
    if len(articles) != 1:
        return total
    for kind, words, _, _, inside in page.units:
        total[kind, inside] += words if kind in ("word", "link word") else 1
    main = articles[0]
    for e in page.elements:
        if e.features and (e.last <= main.first or e.first >= main.last):
            for f in e.features:
                total["+" + f, False] += sum(u[1] for u in page.units[e.first : e.last])
    return total


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Log odds of words, tags and features from labelled pages. The names are those of the standard and of the lists above, so the table is small."""
    marked = F.lower("html").rlike("<(article|main)[\\s>]")
    chosen = pages.where(marked & F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = _page(pages.where(marked).join(F.broadcast(chosen), "page_id"))  # at most ``sample`` ids

    def run(batch: pa.RecordBatch) -> dict:
        total: Counter = Counter()
        for html in batch.column("html").to_pylist():
            total += tallied(html)
        return {"kind": [k for k, _ in total], "inside": [i for _, i in total], "n": list(total.values())}

    counted = map_batches(rows, run, "kind string, inside boolean, n long", column="html").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_of({(r.kind, r.inside): r.n for r in counted.collect()})


def weights_of(got: dict[tuple[str, bool], int]) -> dict[str, float]:
    if not any(inside for kind, inside in got if not kind.startswith("+")):
        return PLAIN
    kinds = {k for k, _ in got if not k.startswith("+")} | {""}
    sums = [sum(n for (k, i), n in got.items() if i == inside and k in kinds) + len(kinds) for inside in (False, True)]
    odds = {k: log((got.get((k, True), 0) + 1) / sums[1]) - log((got.get((k, False), 0) + 1) / sums[0]) for k in kinds}
    # Words outside and inside, as a feature's are: how much more often it is found with them than words are in all.
    words = [sum(got.get((k, inside), 0) for k in ("word", "link word")) + 1 for inside in (False, True)]
    for f in {k for k, _ in got if k.startswith("+")}:
        inside, outside = FOR if f[1:] in CONTENT else AGAINST
        odds[f] = log((got.get((f, True), 0) + inside) / (got.get((f, False), 0) + outside)) - max(log(words[1] / words[0]), 0.0)
    for k in (*kinds, *PLAIN):
        if k.strip("/") not in ARTICLES:
            odds[k] = max(odds.get(k, PLAIN[""]), PLAIN[k] if k and k != "word" and k in PLAIN else LEAST)
    return odds | {"": min(odds[""], -1.0), "word": max(odds["word"], 0.1)}


def texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = weights or learn(pages)

    def run(batch: pa.RecordBatch) -> dict:
        out = [extract(x, weights) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": [len(x) for x in out]}

    return map_batches(_page(pages, "page_id", "url"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long", column="html")
