"""Main text of web pages by the maximum-scoring run of words and tags.

A page is read once as a row of tokens. Words score positive and tags negative, by the share of their kind
that lies inside the article of labelled pages: a word scores that share, a tag the logarithm of it. The kind of
a word is its block element and whether it is a link, that of a tag its element. Pages whose one fit ``article``
or ``main`` element holds most of their words label themselves, so Spark counts the kinds over all such pages
of the table. Labels serve the counts only: on every page alike, a linear scan finds the contiguous run of
the highest sum, and its blocks are the text. Parts that are never article text (menus, forms, scripts,
adverts, comments, …) are known by element, role or class; their words have no score and no place in
the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by their part in a page.
RAW = "script style textarea title xmp iframe noembed noframes noscript"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold article text.
NEVER = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript head nav aside footer form button select option "
    "datalist template dialog menu search svg canvas audio video object map fieldset input".split()
)
#: ARIA roles of parts that aren't the article.
ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split()
)
#: Words of class names and ids that mark such parts, in any case and between any separators.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "notice notices notification notifications popup modal overlay lightbox comment comments commentlist respond "
    "replies reply disqus share sharing social related recommended recommendations newsletter subscribe subscription "
    "login signup signin search searchbox toolbar pagination pager skip widget widgets masthead topbar".split()
)
#: Words that name a container. Inside an article a class name marks such a part only if it is made of marks and these.
CONTAINERS = frozenset(
    "area block body bottom box button buttons container content entry form group header holder icons inline inner item "
    "items js left line link links list main outer page panel post posts right row section sticky story text thread "
    "title top wrap wrapper".split()
)
#: The same as marks, but only outside an article, which may have a header of its own.
OUTER_MARKS = frozenset("header head top foot copyright".split())
#: Elements that stand inside running text or around one paragraph of it, as a prior for those seldom seen.
TEXT_LEVEL = frozenset(
    "a abbr b bdi bdo big blockquote br caption center cite code data dd del dfn dl dt em figcaption figure font h1 h2 h3 h4 "
    "h5 h6 i img ins kbd li mark ol p picture pre q rp rt ruby s samp small source span strike strong sub sup table "
    "tbody td tfoot th thead time tr tt u ul var wbr".split()
)
#: A tag of these closes an open paragraph.
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption".split())
#: An opening tag closes an open one of the same group, up to the element that holds the group.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Shares expected of kinds without any evidence; each counts as one observation.
EXPECTED = {"word": 0.8, "text tag": 0.9, "other tag": 0.37}
#: Scores are whole numbers, so that sums are exact and ties are ties.
SCALE = 1000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW.split()) + r")(?=[\s/>])(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)"
    r"|<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|\Z)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I
)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Tokens of a page in order; text of unfit parts has none."""

    kinds: list[tuple[str, str]]
    #: For each token: index of its kind, words (0 for a tag), text, number of its block.
    kind: list[int]
    words: list[int]
    text: list[str]
    block: list[int]
    #: First and last + 1 token between the tags of each outermost fit ``article`` and ``main``.
    spans: dict[str, list[list[int]]]


def _unfit(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a part that never belongs to the article."""
    if name in NEVER or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            if name in ("body", "html", "article", "main"):
                continue
            if in_article:
                names = [{p.lower() for p in PART.findall(name)} for name in value.split()]
                if any(n & MARKS and n <= MARKS | CONTAINERS for n in names):
                    return True
            elif {p.lower() for p in PART.findall(value)} & (MARKS | OUTER_MARKS):
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden":
            return True
        elif key == "aria-hidden":
            if value.lower() == "true":
                return True
        elif HIDDEN.search(value):
            return True
    return False


def read(source: str) -> Page:
    """The tokens of a page."""
    page = Page([], [], [], [], [], {"article": [], "main": []})
    index: dict[tuple[str, str], int] = {}
    stack: list[tuple[str, bool, str]] = []  # element, unfit, block element around or at it
    block, at, open_names = 0, 0, Counter()

    def put(kind: str, element: str, words: int, text: str) -> None:
        key = (kind, element)
        if key not in index:
            index[key] = len(page.kinds)
            page.kinds.append(key)
        page.kind.append(index[key])
        page.words.append(words)
        page.text.append(text)
        page.block.append(block)

    def say(piece: str) -> None:
        if piece and not (stack and stack[-1][1]):
            text = html.unescape(piece)
            put("link" if open_names["a"] else "word", stack[-1][2] if stack else "", len(text.split()), text)

    def leave(to: int) -> None:
        nonlocal block
        while len(stack) > to:
            name, unfit, _ = stack.pop()
            open_names[name] -= 1
            if name in BLOCK:
                block += 1
            if name in page.spans and not unfit and not open_names[name]:
                page.spans[name][-1][1] = len(page.kind)

    for found in TAG.finditer(source):
        say(source[at : found.start()])
        at = found.end()
        name = found["name"] or found["raw"]
        if not name:
            continue
        name = name.lower()
        if found["raw"]:
            if name in BLOCK:
                block += 1
            continue
        if found["slash"]:
            if open_names[name]:
                while stack[-1][0] != name:
                    leave(len(stack) - 1)
                fit = not stack[-1][1]
                leave(len(stack) - 1)
                if fit:
                    put("tag", name, 0, "")
            elif name in BLOCK:
                block += 1
            continue
        if name in CLOSES_P and open_names["p"]:
            place = max(i for i, s in enumerate(stack) if s[0] == "p")
            leave(place)
        elif name in SIBLINGS:
            same, holder = SIBLINGS[name]
            place = len(stack) - 1
            while place >= 0 and stack[place][0] not in holder:
                if stack[place][0] in same:
                    leave(place)
                place -= 1
        unfit = bool(stack) and stack[-1][1]
        if name in BLOCK:
            block += 1
        in_article = open_names["article"] > 0 or open_names["main"] > 0
        bad = unfit or _unfit(name, found["attrs"], in_article)
        if not bad:
            put("tag", name, 0, " " if name == "br" else "")
        if name in VOID or found["attrs"].endswith("/") and name not in BLOCK:
            continue
        if name in page.spans and not bad and not open_names[name]:
            page.spans[name].append([len(page.kind)] * 2)
        around = name if name in BLOCK else stack[-1][2] if stack else ""
        stack.append((name, bad, around))
        open_names[name] += 1
    say(source[at:])
    leave(0)
    return page


def label(page: Page) -> tuple[int, int] | None:
    """The tokens of the article, where the page marks it: those of its only fit outermost ``article``, or
    else of its only such ``main``, if they hold most of the words."""
    most = sum(page.words) / 2
    for name in ("article", "main"):
        if len(page.spans[name]) == 1:
            start, end = page.spans[name][0]
            if sum(page.words[start:end]) > most:
                return start, end
    return None


def evidence(page: Page) -> dict[str, list[int]]:
    """Of a labelled page: how many tokens of each kind lie inside and outside the article."""
    out: dict[str, list[int]] = {}
    marked = label(page)
    if marked:
        for i, (k, n) in enumerate(zip(page.kind, page.words)):
            counts = out.setdefault(" ".join(page.kinds[k]), [0, 0])
            counts[0 if marked[0] <= i < marked[1] else 1] += n if page.kinds[k][0] != "tag" else 1
    return out


class Weights:
    """Scores of words and tags from counts of labelled pages (kind: inside, outside)."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts

    def of(self, kind: tuple[str, str]) -> int:
        """The score of one word or one tag of the kind; words from 0 up, tags below 0."""
        sort, element = kind
        expected = EXPECTED["word" if sort != "tag" else "text tag" if element in TEXT_LEVEL else "other tag"]
        inside, outside = self.counts.get(" ".join(kind), (0, 0))
        share = (inside + expected) / (inside + outside + 1)
        return round(SCALE * share) if sort != "tag" else min(-1, round(SCALE * math.log(share)))


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """First and last + 1 place of the contiguous run of the highest positive sum: the shortest of those
    that have it, and the first of equally short ones; (0, 0) where no sum is positive."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate([[0], np.cumsum(scores, dtype=np.int64)])
    lowest = np.minimum.accumulate(sums)
    start = np.maximum.accumulate(np.where(sums == lowest, np.arange(len(sums)), 0))
    gain = sums - lowest
    ends = np.flatnonzero(gain == gain.max())
    if gain[ends[0]] <= 0:
        return 0, 0
    end = ends[np.argmin(ends - start[ends])]
    return int(start[end]), int(end)


def main_text(source: str | None, weights: Weights) -> str:
    """The text of the maximum-scoring run, block by block; empty if there is none."""
    if not source:
        return ""
    page = read(source)
    if not page.kind:
        return ""
    kinds = np.array([weights.of(k) for k in page.kinds], np.int64)[page.kind]
    tag = np.array([k[0] == "tag" for k in page.kinds])[page.kind]
    start, end = best_run(kinds * np.where(tag, 1, page.words))
    blocks: dict[int, list[str]] = {}
    for i in range(start, end):
        blocks.setdefault(page.block[i], []).append(page.text[i])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in joined if b)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[int]] = {}
    for batch in batches:
        for source in batch.column(0):
            source = source.as_py()
            if source:
                for key, (i, o) in evidence(read(source)).items():
                    counts = total.setdefault(key, [0, 0])
                    counts[0] += i
                    counts[1] += o
    if total:
        i, o = np.array(list(total.values()), np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(i), pa.array(o)], ["kind", "i", "o"])


def learn(pages: DataFrame, html_col: str = "html", kinds: int = 5000) -> Weights:
    """Weights from all pages that mark their article; of element names only the ``kinds`` most frequent."""
    found = (
        pages.select(F.col(html_col).alias("html"))
        .filter(F.col("html").rlike("(?i)<(article|main)"))
        .mapInArrow(_gather, "kind string, i long, o long")
        .groupBy("kind")
        .agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        .orderBy(F.desc(F.col("i") + F.col("o")), "kind")
        .limit(kinds)
        .collect()
    )
    return Weights({r.kind: (r.i, r.o) for r in found})


def extract(
    pages: DataFrame,
    weights: Weights,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined in
    order by a line feed. Whether a page marks its article makes no difference here, only in ``learn``.

    Defined cases: null and empty pages, and pages of which nothing scores, have an empty text. Text
    outside all tags is a block. An unclosed element ends where the element around it ends. A page
    of any length is read whole, in time linear in it. Of runs with equal sums the shortest, then the first, is taken.
    Repeated rows are read each, null ids stay null, an empty table gives no rows, other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.as_py(), shared.value) for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
