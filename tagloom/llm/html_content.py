"""Main text of web pages as a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive, tags negative; a linear scan
finds the contiguous region of the highest total, and the text of its blocks is the result. Words
inside elements that are not content by their meaning (menus, forms, adverts, comments and the like) score
slightly negative, so the region may reach across them, and they are left out of its text. A form, or an
element that only a class, id or role names so, is content after all if its best region at
``NAMED_WORD`` a word still beats the best region outside such elements: a wrapper of the whole text is.
An article element inside one that is not content is judged in the same way. Omitted end tags are implied
by the next block, item or cell and by the parent's end.

Tag weights come from labelled pages: a bounded sample of pages whose markup names the article element.
A tag's cost is how much rarer it is inside the article than outside (log odds), times a scale chosen
for the best word F1 on those pages; without labelled pages every tag costs one word.

Defined results: a null or empty page, or one without content words, gives an empty text; an element without end
tag closes with its parent; repeated rows are read alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship

SAMPLE = 400
SAMPLE_CHARS = 200_000  # longer pages are not used for learning
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
ASIDE_WORD = -0.1
NAMED_WORD = 0.25

# Attributes; a value in quotes may hold < and >.
REST = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|svg|textarea|title)\b(?:{REST}|[^<>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][a-z0-9-]*)(?P<rest>{REST}|[^<>]*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Elements of a page that are not its article, by tag and by words of class, id or role.
ASIDE_TAGS = frozenset("head nav header footer aside form button select iframe menu dialog object".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie consent "
    "disqus footer form header menu modal nav navbar navigation newsletter notice notices popup promo promotion "
    "related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Open elements that a start tag ends, and the elements that this does not reach across.
CELLS = frozenset("td th".split())
SCOPE = frozenset("table td th caption button object template".split())
LISTS = frozenset("ul ol menu dl table td th section article main div".split()) - {"div"}
BLOCKS = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li dt dd main menu nav ol p pre section table ul".split()
)
ROWS = frozenset(("tr",))
GROUPS = frozenset("tbody thead tfoot caption".split())
IMPLIED = {
    "li": (frozenset(("li",)), LISTS),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), LISTS)),
    **dict.fromkeys(("td", "th"), (CELLS, frozenset(("table",)))),
    "tr": (CELLS | ROWS, frozenset(("table",))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (CELLS | ROWS | GROUPS, frozenset(("table",)))),
}
IN_HEAD = frozenset("base link meta".split())


@dataclass(eq=False)
class Mark:
    """An open element that is not content; ``soft``: only by a name, or a form.

    ``word``: what its words weigh against the region outside of such elements.
    """

    soft: bool
    parent: Mark | None
    word: float = NAMED_WORD
    cleared: bool = False
    hidden: bool = True
    top: Mark | None = None  # the outermost that hides
    hard: bool = False  # a hard one hides within ``top``

    def firm(self) -> bool:
        """Whether this or an outer element is no content by its tag."""
        mark: Mark | None = self
        while mark:
            if not mark.soft:
                return True
            mark = mark.parent
        return False

    def settle(self) -> None:
        above = self.parent
        if above and above.hidden:
            self.top, self.hidden, self.hard = above.top, True, above.hard or not self.soft
        else:
            self.hidden = not self.cleared
            self.top, self.hard = (self if self.hidden else None), not self.soft


@dataclass
class Item:
    """A run of text, or a tag; ``aside``: inside an element that is not content."""

    text: str | None
    words: int
    tag: str
    aside: bool
    inside: bool  # of the article element
    mark: Mark | None = None


@dataclass
class Weights:
    costs: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    unknown: float = 1.0

    def of(self, item: Item) -> float:
        if item.text is None:
            return -self.scale * self.costs.get(item.tag, self.unknown)
        return item.words * (ASIDE_WORD if item.aside else 1.0)


def _is_aside(name: str, rest: str, in_article: bool) -> bool:
    if name in ASIDE_TAGS:
        return not (name == "header" and in_article)
    if name in ("html", "body", "main") or not rest:
        return False
    for m in NAMED.finditer(rest):
        value = (m[1] or m[2] or m[3] or "").lower()
        if name == "article":
            # Articles are named for what they are about; only a whole name counts.
            if any(w in ASIDE_NAMES or w.startswith("comment-") for w in value.split()):
                return True
        elif any(w in ASIDE_NAMES for w in re.split(r"[^a-z]+", value)):
            return True
    return False


class Elements:
    """Open elements of a page, outermost first."""

    def __init__(self):
        self.names: list[str] = []
        self.marks: list[Mark | None] = []  # the innermost mark at each
        self.articles: list[bool] = []
        self.open: Counter = Counter()
        self.article = 0

    @property
    def mark(self) -> Mark | None:
        return self.marks[-1] if self.marks else None

    def push(self, name: str, mark: Mark | None, article: bool) -> None:
        self.names.append(name)
        self.marks.append(mark)
        self.articles.append(article)
        self.open[name] += 1
        self.article += article

    def cut(self, at: int) -> None:
        """End the elements from ``at`` on."""
        for name, article in zip(self.names[at:], self.articles[at:]):
            self.open[name] -= 1
            self.article -= article
        del self.names[at:], self.marks[at:], self.articles[at:]

    def close(self, names: frozenset, stops: frozenset) -> None:
        """End the outermost of ``names`` that is not beyond one of ``stops``."""
        if not any(self.open[n] for n in names):
            return
        found = None
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in names:
                found = i
            elif self.names[i] in stops:
                break
        if found is not None:
            self.cut(found)

    def end(self, name: str) -> None:
        if not self.open[name]:
            return
        stops = frozenset(("table",)) if name in CELLS | ROWS | GROUPS else SCOPE | {"ul", "ol"} if name == "li" else SCOPE
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] == name:
                return self.cut(i)
            if self.names[i] in stops or name in INLINE and self.names[i] not in INLINE:
                return None


def items_of(page: str) -> list[Item]:
    out: list[Item] = []
    tree = Elements()
    for m in TOKEN.finditer(page):
        text, name = m["text"], m["name"]
        if text is not None:
            text = html.unescape(text)
            words = len(text.split())
            out.append(Item(text, words, "", tree.mark is not None, tree.article > 0, tree.mark))
        elif name:
            name, end = name.lower(), bool(m["end"])
            if end:
                tree.end(name)
            elif name == "body":
                tree.cut(0)
            else:
                if tree.names and tree.names[-1] == "head" and name not in IN_HEAD:
                    tree.cut(len(tree.names) - 1)
                if name in BLOCKS and tree.open["p"]:
                    tree.close(frozenset(("p",)), SCOPE)
                if name in IMPLIED:
                    tree.close(*IMPLIED[name])
                aside = name not in VOID and _is_aside(name, m["rest"], tree.article > 0)
                if aside:
                    mark = Mark(name == "form" or name not in ASIDE_TAGS, tree.mark)
                elif name in ARTICLE and tree.mark:
                    # The article may lie inside an element that someone forgot to close, but a teaser or a
                    # card is an article inside one as well: what holds more counts, full words if names alone hide it.
                    mark = Mark(True, None, NAMED_WORD if tree.mark.firm() else 1.0)
                else:
                    mark = tree.mark
                # Inline elements matter only inside what may be left out.
                if name not in VOID and name != "html" and (mark or name not in INLINE):
                    tree.push(name, mark, name in ARTICLE and not aside)
            mark = tree.mark
            out.append(Item(None, 0, "/" + name if end else name, mark is not None, tree.article > 0, mark))
        elif m["raw"]:
            out.append(Item(None, 0, m["raw"].lower(), tree.mark is not None, tree.article > 0, tree.mark))
    return out


def settle(items: list[Item], weights: Weights) -> None:
    """Clear the named elements that hold more than what is outside of them; sets ``aside``."""
    marks = list(dict.fromkeys(i.mark for i in items if i.mark))
    while marks:
        for mark in marks:
            mark.settle()
        for item in items:
            item.aside = item.mark is not None and item.mark.hidden
        first, end = best_region(items, weights)
        base = sum(weights.of(i) for i in items[first:end])
        totals: dict[Mark, list[float]] = {}
        for item in items:
            top = item.mark.top if item.mark else None
            if top and top.soft:
                run = totals.setdefault(top, [0.0, 0.0])
                value = item.words * (ASIDE_WORD if item.mark.hard else top.word) if item.text is not None else weights.of(item)
                run[0] = max(0.0, run[0]) + value
                run[1] = max(run)
        won = [mark for mark, run in totals.items() if run[1] > base]
        if not won:
            return
        for mark in won:
            mark.cleared = True


def best_region(items: list[Item], weights: Weights) -> tuple[int, int]:
    """Ends of the contiguous run of the highest total; the earlier, then the shorter of equals."""
    best, where = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, item in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += weights.of(item)
        if total > best:
            best, where = total, (start, i + 1)
    return where


def text_of(items: list[Item]) -> str:
    """Text of the blocks in order; white space inside a block becomes one space."""
    pieces: list[str] = []
    for item in items:
        if item.text is None:
            name = item.tag.removeprefix("/")
            if name not in INLINE:
                pieces.append(" ")
        elif not item.aside:
            pieces.append(item.text)
    return " ".join("".join(pieces).split())


def learn(pages: list[str]) -> Weights:
    """Costs of tags, and their scale, from pages whose article is marked up."""
    parsed = [items_of(p) for p in pages]
    parsed = [x for x in parsed if any(i.inside and i.words for i in x)]
    inside, outside = Counter(), Counter()
    for items in parsed:
        for item in items:
            if item.text is None and item.tag.removeprefix("/") not in ARTICLE:
                (inside if item.inside else outside)[item.tag] += 1
    if not parsed:
        return Weights()
    n_in, n_out = sum(inside.values()), sum(outside.values())
    costs = {"article": 0.0, "/article": 1.0, "main": 0.0, "/main": 1.0}
    for tag in inside.keys() | outside.keys():
        odds = math.log((outside[tag] + 1) / (n_out + 2)) - math.log((inside[tag] + 1) / (n_in + 2))
        costs[tag] = max(0.0, odds)
    return max((Weights(costs, s) for s in SCALES), key=lambda w: (round(_f1(parsed, w), 4), -w.scale))


def _f1(parsed: list[list[Item]], weights: Weights) -> float:
    right = found = wanted = 0
    for items in parsed:
        settle(items, weights)
        first, end = best_region(items, weights)
        for i, item in enumerate(items):
            chosen, true = first <= i < end and not item.aside, item.inside and not item.aside
            right += item.words * (chosen and true)
            found += item.words * chosen
            wanted += item.words * true
    return 2 * right / (found + wanted) if found + wanted else 0.0


def extract(page: str, weights: Weights) -> str:
    items = items_of(page)
    settle(items, weights)
    first, end = best_region(items, weights)
    return text_of(items[first:end])


def fit_weights(pages: DataFrame) -> Weights:
    """Weights from at most ``SAMPLE`` pages, those with the smallest hashes among the labelled."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(?:article|main)\b") & (F.length("html") <= SAMPLE_CHARS))
    draws = labelled.select(F.xxhash64("page_id", "url", "html").alias("draw"), "html")
    # The sample is drawn by narrow numbers, so that each task sends few bytes; copies count once.
    chosen = draws.select("draw").distinct().orderBy("draw").limit(SAMPLE).collect()
    picked = draws.where(F.col("draw").isin([r["draw"] for r in chosen])) if chosen else draws.limit(0)
    rows = picked.groupBy("draw").agg(F.first("html").alias("html")).collect()
    return learn([r["html"] for r in sorted(rows, key=lambda r: r["draw"])])


def content_column(pages: DataFrame, weights: Weights) -> Column:
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def content(column: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py() or "", shared.value) for p in column], pa.string())

    return F.arrow_udf(content, "string").asNondeterministic()(F.col("html"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", content_column(pages, fit_weights(pages)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
