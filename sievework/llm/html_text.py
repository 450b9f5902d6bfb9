"""Main text of web pages by the maximum-scoring subsequence (operator 4).

A page becomes a sequence of words and tags. A word scores 1 less what the marks around it
take away: element names and the words of class, id and role have weights, learned from pages
whose own markup labels the article, and a negative weight holds for all words of its element.
Tags score below 0 by how often they stand outside the article in labelled pages; a
positive mark around them (an article, a content block) makes up for that. One linear scan
finds all maximal contiguous runs, and the best, with those that reach a tenth of it or stand in
the same article or main element, are the main text. Words that score nothing or less are left out of a run; their element counts as one
tag there, so that an advert between two paragraphs doesn't part them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are fitted on, and weights that a fit keeps, at most.
FIT_LIMIT, WEIGHT_LIMIT = 2000, 2048
#: Pages of evidence that a prior weight counts as.
PRIOR_PAGES = 5
#: Score of a tag in running text and of one never seen; bounds of a learned weight.
MILD, UNSEEN, LEAST, MOST = -0.01, -2.0, -4.0, 3.0
#: A run counts from this share of the best run's score.
RUN_SHARE = 0.1
#: Words outside any mark, in a page that marks its article.
UNMARKED = "-"

# Element names of HTML by their use.
RAW = frozenset("script style template textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 hr p summary legend".split())
CONTAINERS = BLOCKS - TEXT_BLOCKS | {"td", "th"}
#: An element that opens ends an open one of the same group, up to the nearest of the last.
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
INLINE = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong u s q sub sup small mark code pre blockquote br span cite abbr time dd dt dl figcaption figure table tr td th tbody thead ol ul li img a".split())
#: Elements whose name says whether they hold the article, and what it says before any page is seen.
NAMED = {"article": 3.0, "main": 3.0, "nav": -4.0, "aside": -4.0, "footer": -4.0, "menu": -4.0, "head": -4.0, "noscript": -4.0, "select": -4.0, "button": -4.0, "datalist": -4.0, "header": -3.0, "form": -3.0, "dialog": -3.0}
#: Words of class, id and role that deny the article wherever they stand in a name, and only as its last part.
DENY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comments comment commentlist respond disqus pagination pager".split()
)
DENY_LAST = frozenset("adbox notice notices alert popup modal overlay widget widgets copyright disclaimer discussion replies share sharing social related recommended recommendations toolbar login search skip contentinfo complementary dialog header".split())
AFFIRM_LAST = frozenset("article post entry story content main".split())
#: Words that make a name say something of an element's layout, not what the element is.
LAYOUT = frozenset("has no not with without print layout free hoc".split())
#: A region that only class words deny is the article where it has this many times the words that nothing denies.
LARGEST = 4

_TAG = r"""<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)>|([^>]*)(?:>|\Z))"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|{_TAG}", re.DOTALL)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+")


class Page:
    """A page's items ``(is_text, value, element)`` and its elements, each after its parent.

    Element 0 is the page. ``names``, ``marks`` (its own name, if that is telling, and the words
    of its attributes), ``parents`` and ``sizes`` (words in it) are lists over the elements.
    """

    def __init__(self, page: str | None):
        self.items: list[tuple[bool, str, int]] = []
        self.names, self.parents, self.sizes = [""], [0], [0]
        self.marks: list[tuple[str, ...]] = [()]
        self._read(page or "")

    def _read(self, page: str) -> None:
        stack, open_names, at, words = [0], Counter(), 0, 0
        begun = [0]

        def close(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                self.sizes[e] = words - begun[e]
                open_names[self.names[e]] -= 1

        def last_open(names: Sequence[str], barrier: Sequence[str]) -> int:
            for depth in range(len(stack) - 1, 0, -1):
                if self.names[stack[depth]] in names:
                    return depth
                if self.names[stack[depth]] in barrier:
                    break
            return 0

        while m := _MARKUP.search(page, at):
            if m.start() > at:
                words += len(page[at : m.start()].split())
                self.items.append((True, page[at : m.start()], stack[-1]))
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                e = stack[-1]
                if open_names[name] > 0 and (depth := last_open((name,), () if name in CONTAINERS else CONTAINERS)):
                    e = stack[depth]
                    close(depth)
                self.items.append((False, name, e))
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in BLOCKS:
                while len(stack) > 1 and self.names[stack[-1]] not in CONTAINERS:
                    close(len(stack) - 1)
            if name in ENDS and (depth := last_open(ENDS[name][0].split(), ENDS[name][1])):
                close(depth)
            elif name == "main" or name == "article" and not any(n in ("article", "main") for n in self.names):
                # Menus, headers and footers can't hold the page's first article: one still open wasn't closed.
                if outer := min((d for d in range(1, len(stack)) if self.names[stack[d]] in ("nav", "header", "footer")), default=0):
                    close(outer)
            marks = self._marks(name, m[3] if m[3] is not None else m[4])
            if name not in VOID and (name in CONTAINERS or marks):
                e = len(self.names)
                self.names.append(name)
                self.marks.append(marks)
                self.parents.append(stack[-1])
                self.sizes.append(0)
                begun.append(words)
                stack.append(e)
                open_names[name] += 1
            self.items.append((False, name, stack[-1]))
        if at < len(page):
            words += len(page[at:].split())
            self.items.append((True, page[at:], stack[-1]))
        close(0)

    @staticmethod
    def _marks(name: str, attributes: str | None) -> tuple[str, ...]:
        own = (name,) if name in NAMED else ()
        if not attributes or name in ("html", "body", "main"):
            return own
        return own + tuple(dict.fromkeys("." + t for a, b, c in _MARKS.findall(attributes) for t in (a or b or c).lower().split()))

    def labelled(self) -> bool:
        return "article" in self.names or "main" in self.names


def prior_weight(mark: str) -> float:
    """What a mark says before any page is seen; ``<name`` is a tag as an item of the sequence."""
    if mark[0] == "<":
        return MILD if mark[1:] in INLINE else UNSEEN
    if mark == UNMARKED:
        return -2.0
    if mark[0] != ".":
        return NAMED.get(mark, 0.0)
    parts = _PARTS.findall(mark)
    if not parts or not LAYOUT.isdisjoint(parts):
        return 0.0
    return -4.0 if not DENY.isdisjoint(parts) else -3.0 if parts[-1] in DENY_LAST else 1.0 if parts[-1] in AFFIRM_LAST else 0.0


def _scopes(page: Page, weigh: Callable[[str], float], prior: Callable[[str], float]) -> tuple[list[float], list[float]]:
    """Of each element: what its words lose (0 or less), and what makes up for tags in it.

    Words of class, id and role are weak evidence. They don't deny an article or main element
    that stands in no other, nor an element that holds one and more words than all that nothing
    denies; and where little else of a page is left, and no mark affirms it, they don't deny its
    largest region.
    """
    own_article = ("article", "main")
    clear = lambda e: 2 * page.sizes[e] > page.sizes[0] or all(weigh(k) > -1 for k in page.marks[e] if k[0] == ".")
    holds, inner = [n in own_article and clear(e) for e, n in enumerate(page.names)], [False] * len(page.names)
    for e in range(len(page.names) - 1, 0, -1):
        holds[page.parents[e]] |= holds[e]
    for e in range(1, len(page.names)):
        up = page.parents[e]
        inner[e] = inner[up] or page.names[up] in own_article
    by_class = [False] * len(page.names)
    for e in range(1, len(page.names)):
        named = [k for k in page.marks[e] if k[0] != "."]
        by_class[e] = not any(weigh(k) <= -1 for k in named)

    def levels(root: float, spared: int) -> tuple[list[float], list[float], list[bool]]:
        level, credit, denied = [root], [0.0], [False]
        for e in range(1, len(page.names)):
            up = page.parents[e]
            marks = [k for k in page.marks[e] if not (k == "header" and credit[up] > 0)]
            if e == spared or page.names[e] in own_article and not inner[e]:
                marks = [k for k in marks if k[0] != "." or weigh(k) > 0]
            own = [weigh(k) for k in marks]
            w = min(own, default=0.0)
            w = w if w <= -1 else max(own, default=0.0)
            if w <= -1 and 2 * page.sizes[e] > page.sizes[0] and (by_class[e] and holds[e] and not inner[e] or min(map(prior, page.marks[e])) > -4):
                w = 0.0  # what holds most of the page is a wrapper, unless its mark is beyond doubt
            denied.append(w <= -1)
            level.append(min(0.0, level[up] + w))
            credit.append(max(credit[up], w))
        return level, credit, denied

    level, credit, denied = levels(0.0, 0)
    outer = [e for e in range(1, len(page.names)) if denied[e] and by_class[e] and level[page.parents[e]] > -1]
    spared = 0
    if outer:
        largest = max(outer, key=lambda e: (holds[e], page.sizes[e]))
        inside = [False] * len(page.names)
        for e in range(1, len(page.names)):
            inside[e] = e == largest or inside[page.parents[e]]
        beside = [(len(v.split()), e) for is_text, v, e in page.items if is_text and level[e] > -1 and not inside[e]]
        affirmed = any(n and credit[e] > 0 for n, e in beside)
        if (holds[largest] or not affirmed) and (1 if holds[largest] else LARGEST) * sum(n for n, _ in beside) < page.sizes[largest]:
            spared = largest
    for root in (0.0, min(0.0, weigh(UNMARKED))):
        level, credit, _ = levels(root, spared)
        if not any(n in own_article and x > -1 for n, x in zip(page.names, level, strict=True)):
            break  # words outside any mark lose only where the page marks its article
    return level, credit


def maximal_runs(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences ``(start, end, score)`` of ``scores``, in one linear scan."""
    runs: list[tuple[float, float, int, int, int]] = []  # total before, total after, start, end, last run with a smaller total before
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start = i
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][0] >= before:
                j = runs[j][4]
            if j < 0 or runs[j][1] >= total:
                runs.append((before, total, start, i + 1, j))
                break
            before, start = runs[j][0], runs[j][2]
            del runs[j:]
    return [(start, end, after - before) for before, after, start, end, _ in runs]


def _home(page: Page, start: int, end: int) -> int:
    """The outermost article or main element that the items of a run are in; 0 for none."""
    found = 0
    e = page.items[start][2] if start < end else 0
    while e:
        found = e if page.names[e] in ("article", "main") else found
        e = page.parents[e]
    return found


def main_text(page: str | None, weights: Mapping[str, float], prior: Callable[[str], float] = prior_weight) -> str:
    """Article text of one page; empty for a null or empty page and one without words."""
    read = Page(page)
    known: dict[str, float] = {}

    def weigh(mark: str) -> float:
        if mark not in known:
            known[mark] = weights[mark] if mark in weights else prior(mark)
        return known[mark]

    level, credit = _scopes(read, weigh, prior)
    scores, paid = [], set()
    for is_text, value, e in read.items:
        if level[e] <= -1:  # the outermost element left out is one tag of the sequence
            while level[read.parents[e]] <= -1 and e:
                e = read.parents[e]
            scores.append(0.0 if e in paid else min(MILD, level[e] + credit[e]))
            paid.add(e)
        elif is_text:
            scores.append(len(value.split()) * (1 + level[e]))
        else:
            scores.append(min(MILD, weigh("<" + value) + credit[e]))
    runs = maximal_runs(scores)
    first, last, best = max(runs, key=lambda r: r[2], default=(0, 0, 0.0))
    home = _home(read, first, last)
    blocks: list[list[str]] = [[]]
    for start, end, score in runs:
        if score < RUN_SHARE * best and not (home and home == _home(read, start, end)):
            continue
        blocks.append([])
        for is_text, value, e in read.items[start:end]:
            if not is_text and value in BLOCKS:
                blocks.append([])
            elif not is_text and value in ("br", "td", "th", "option"):
                blocks[-1].append(" ")
            elif is_text and level[e] > -1:
                blocks[-1].append(value)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def label_counts(page: str | None, into: dict[str, list[int]]) -> None:
    """Add a labelled page to ``into``: mark -> [inside, outside, pages], words and tags in millionths of the page's.

    Words in the article or main element are inside, but for those that the prior leaves
    out of it (a form, an advert), which count for nothing; all others are outside.
    """
    read = Page(page)
    if not read.labelled():
        return
    level, _ = _scopes(read, prior_weight, prior_weight)
    within = [False] * len(read.names)
    for e in range(1, len(read.names)):
        within[e] = read.names[e] in ("article", "main") or within[read.parents[e]]
    held = [[0, 0] for _ in read.names]
    found: dict[str, list[int]] = {}
    for is_text, value, e in read.items:
        if within[e] and level[e] <= -1:
            continue
        side = 0 if within[e] else 1
        if is_text:
            held[e][side] += len(value.split())
        else:
            found.setdefault("<" + value, [0, 0])[side] += 1
    tags = max(1, sum(map(sum, found.values())))
    found = {k: [v * 1_000_000 // tags for v in c] for k, c in found.items()}
    words = max(1, sum(map(sum, held)))
    for e in range(len(read.names) - 1, 0, -1):
        for side in (0, 1):
            held[read.parents[e]][side] += held[e][side]
    for e, marks in enumerate(read.marks):
        for k in marks:
            counts = found.setdefault(k, [0, 0])
            for side in (0, 1):
                counts[side] += held[e][side] * 1_000_000 // words
    found["words"] = [held[0][side] * 1_000_000 // words for side in (0, 1)]
    found["tags"] = [sum(c[side] for k, c in found.items() if k[0] == "<") for side in (0, 1)]
    for k, c in found.items():
        if any(c):
            total = into.setdefault(k, [0, 0, 0])
            for i, v in enumerate((*c, 1)):
                total[i] += v


def learned_weights(counts: Mapping[str, Sequence[int]]) -> dict[str, float]:
    """Weights from counts of :func:`label_counts`: log-odds, drawn to the prior where pages are few."""
    out: dict[str, float] = {}
    for mark, (inside, outside, pages) in counts.items():
        if mark in ("words", "tags"):
            continue
        ins, outs, _ = counts["tags" if mark[0] == "<" else "words"]
        odds = math.log((inside + 1e5) / (ins + 1e5)) - math.log((outside + 1e5) / (outs + 1e5))
        mixed = (pages * odds + PRIOR_PAGES * prior_weight(mark)) / (pages + PRIOR_PAGES)
        out[mark] = max(LEAST, min(MILD if mark[0] == "<" else MOST, mixed))
    return out


def fit_weights(pages: DataFrame, id_col: str = "page_id", page: str = "html", limit: int = FIT_LIMIT, keep: int = WEIGHT_LIMIT) -> dict[str, float]:
    """Weights from a sample of at most ``limit`` distinct rows, those with the smallest hashes.

    The labelled pages of the sample are those that mark their article with an article or
    main element. Without any, and for marks they don't show, the prior holds. The ``keep``
    marks seen on most pages are kept.
    """
    hashed = pages.select(F.col(page).alias("page"), F.xxhash64(id_col, page).alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(limit)
    sample = hashed.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).select("page")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column(0):
                label_counts(text.as_py(), counts)
        columns = [pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, names=["mark", "inside", "outside", "pages"])

    counted = sample.mapInArrow(count, "mark string, inside long, outside long, pages long").groupBy("mark").agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "pages")))
    kept = counted.orderBy(F.desc("pages"), "mark").limit(keep + 2).collect()  # at most keep + 2 rows
    return learned_weights({r["mark"]: (r["inside"], r["outside"], r["pages"]) for r in kept})


def extract(pages: DataFrame, weights: Mapping[str, float], page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out``; each row on its own, no shuffle.

    Null and empty pages give the empty string. A column named ``out`` is replaced.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: main_text(p, weights), na_action=None)

    return pages.withColumn(out, of(F.col(page)))
