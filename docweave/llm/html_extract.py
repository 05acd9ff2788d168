"""HTML extraction by a maximum-scoring subsequence of words and tags.

A page is a sequence of tokens.  Words score above zero, tags below, by weights counted on
labelled pages; one linear scan finds the contiguous run with the greatest sum: the content
region.  The region then grows to the element that holds it, and blocks that are never
content (menus, adverts, forms, comments, ...) are left out of its text.

Labelled pages are those that mark their own content with <article> or <main>: tokens
inside are content, others are not.  Weights are log-odds over all of them, so the counts
are a few rows per task, summed by Spark.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import settle

QUOTE_OR_END = re.compile("[>\"']")
NAME_END = re.compile(r"[\s/>]")
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never content.
DROPPED = RAW | frozenset("head nav footer aside form button select option input dialog menu object audio video canvas".split())
#: A start tag of these closes an open element of the same family.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article main section div aside nav footer header form td th".split())
#: Where the search for elements to close stops, or finds one.
MARKED = SCOPES | frozenset().union(*CLOSES.values())
#: Words in class or id that mark a block as not content.
NOT_CONTENT = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav\w*|breadcrumbs?"
    r"|comments?|commentlist|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|overlay|footer|header"
    r"|masthead|toolbar|widgets?|disclaimer|login|signup|search|pagination|pager|skip)(?:$|[-_\s])",
    re.I,
)
NOT_CONTENT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
LABELS = ("article", "main")
#: A tag gets a weight of its own if it is one in so many tokens of the labelled pages, or more.
RAREST = 10_000


@dataclass(frozen=True)
class Weights:
    """Scores of a word, of a word in a link, and of each tag; tags without one score ``other``."""

    word: float = 0.5
    link_word: float = 0.05
    other: float = -2.0
    tags: dict[str, float] = field(default_factory=dict)


@dataclass(slots=True)
class Token:
    kind: str  # "word": a run of text; otherwise the tag's name
    text: str
    element: int  # the innermost open element, -1 outside all
    dropped: bool
    linked: bool


@dataclass(slots=True)
class Element:
    """An element; begin and end: the tokens inside it, which follow each other."""

    name: str
    parent: int
    depth: int
    label: int  # the innermost labelled element around or at it, -1 if none is
    dropped: bool
    linked: bool
    begin: int
    end: int = -1


@dataclass(slots=True)
class Open:
    """An open element, and what the rules ask about those below it, so that no rule walks them all."""

    number: int
    name: str
    cut: int  # place of the lowest one that a labelled element may not start in, -1: none
    paragraph: bool  # a <p> is open above the last scope
    marked: int  # place of the nearest one that ends the search for elements to close


def _drops(name: str, attributes: str, in_label: bool) -> bool:
    if name in DROPPED or name == "header" and not in_label:
        return True
    if not attributes or name in ("html", "body", *LABELS):
        wanted = ("class", "id") if name in LABELS else ()
        if not wanted or not attributes:
            return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key in ("class", "id") and NOT_CONTENT.search(value):
            return True
        if key == "role" and value.lower() in NOT_CONTENT_ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _ends(page: str) -> tuple[array, array]:
    """Places of quotes and ``>``, and where a tag ends that reaches them outside quotes; -1: nowhere."""
    places = array("q", (m.start() for m in QUOTE_OR_END.finditer(page)))
    ends, nearest = array("q", bytes(8 * len(places))), {'"': -1, "'": -1}
    for i in range(len(places) - 1, -1, -1):
        c = page[places[i]]
        if c == ">":
            ends[i] = places[i]
        else:
            closing = nearest[c]
            ends[i] = ends[closing + 1] if 0 <= closing < len(places) - 1 else -1
            nearest[c] = i
    return places, ends


def markup(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(tag's name, attributes, text, end tag) of every tag and run of text; one of name and text is empty.

    Every character is looked at a bounded number of times, also where tags, quotes or
    comments are never closed: such a ``<`` is text, a comment goes on to the page's end.
    """
    places, ends = _ends(page)
    at, size, last = 0, len(page), page.rfind(">")
    name_end = -1  # of the latest name looked at, which later ones inside it share
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield "", "", page[at:end], False
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at) and at < last:
            at = page.find(">", at) + 1
            continue
        slash = page.startswith("</", at)
        begin = at + 1 + slash
        if at < last and begin < size and page[begin].isascii() and page[begin].isalpha():
            if begin >= name_end:
                name_end = NAME_END.search(page, begin).start()  # there is a > behind
            k = bisect_left(places, name_end)
            end = ends[k] if k < len(places) else -1
            if end >= 0:
                name = page[begin:name_end].lower()
                at = end + 1
                if name in RAW and not slash:  # text up to the end tag is not markup
                    over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at, last + 1)
                    at = over.end() if over else size
                yield name, page[name_end:end], "", slash
                continue
        yield "", "", "<", False
        at += 1


class Page:
    """The tokens and elements of a page, in time linear in its length."""

    def __init__(self, page: str):
        self.tokens: list[Token] = []
        self.elements: list[Element] = []
        self.stack: list[Open] = []
        self.open: Counter = Counter()
        for name, attributes, text, slash in markup(page):
            if text:
                self._token("word", text)
            elif slash:
                if self.open[name]:
                    self._close(name)
                    self._token(name, "")
            else:
                self._start(name, attributes)
        self._cut(0)

    def _token(self, kind: str, text: str) -> None:
        number = self.stack[-1].number if self.stack else -1
        inside = self.elements[number] if self.stack else None
        self.tokens.append(Token(kind, text, number, bool(inside and inside.dropped), bool(inside and inside.linked)))

    def _push(self, name: str, drops: bool) -> None:
        below, number, place = self.stack[-1] if self.stack else None, len(self.elements), len(self.stack)
        around = self.elements[below.number] if below else None
        label = number if name in LABELS else around.label if around else -1
        self.elements.append(Element(
            name, below.number if below else -1, place, label, drops or bool(around and around.dropped),
            name == "a" or bool(around and around.linked), len(self.tokens),
        ))
        cut = below.cut if below else -1
        if cut < 0 and drops and name not in ("aside", "footer", "form"):
            cut = place
        paragraph = name == "p" or name not in SCOPES and bool(below and below.paragraph)
        marked = place if name in MARKED else below.marked if below else -1
        self.stack.append(Open(number, name, cut, paragraph, marked))
        self.open[name] += 1

    def _pop(self) -> Open:
        top = self.stack.pop()
        self.elements[top.number].end = len(self.tokens)
        self.open[top.name] -= 1
        return top

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            self._pop()

    def _close(self, name: str) -> None:
        while self.stack and self._pop().name != name:
            pass

    def _start(self, name: str, attributes: str) -> None:
        stack = self.stack
        labelled = any(self.open[x] for x in LABELS)
        if name in LABELS and stack and stack[-1].cut >= 0 and not labelled:
            self._cut(stack[-1].cut)  # content never starts in an advert or menu that someone forgot to close
        if name not in INLINE and name not in VOID and stack and stack[-1].paragraph:
            self._close("p")
        if name in CLOSES and stack:
            place = stack[-1].marked
            while place >= 0:
                if stack[place].name in CLOSES[name]:
                    self._cut(place)
                    break
                if stack[place].name in SCOPES:
                    break
                place = stack[place - 1].marked if place else -1
        if name == "body":
            self._only_html()
        self._token(name, "")
        if name in VOID or name in RAW or attributes.rstrip().endswith("/") and name not in INLINE and name not in SCOPES:
            return
        self._push(name, _drops(name, attributes, any(self.open[x] for x in LABELS)))

    def _only_html(self) -> None:
        """All open elements but html end; those html that stood in others begin anew, once."""
        again = 0
        while self.stack and self.open["html"] < len(self.stack):
            again += self._pop().name == "html"
        for _ in range(again):
            self._push("html", False)


def class_of(token: Token) -> str:
    return ("link_word" if token.linked else "word") if token.kind == "word" else token.kind


def count_classes(page: str) -> Counter:
    """(class, inside) -> words or tags, for a page that labels its content; else nothing."""
    counts: Counter = Counter()
    read = Page(page)
    if not any(e.name in LABELS for e in read.elements):
        return counts
    for t in read.tokens:
        inside = not t.dropped and t.element >= 0 and read.elements[t.element].label >= 0 and t.kind not in LABELS
        counts[class_of(t), inside] += len(t.text.split()) if t.kind == "word" else 1
    return counts


def learn_weights(pages: DataFrame, content: str = "html") -> Weights:
    """Log-odds of every class inside against outside, over all labelled pages.

    Words are held above zero and tags below.  Without labelled pages the defaults stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(count_classes(page.as_py() or ""))
        kept = [(k, i, n) for (k, i), n in total.items()]
        yield pa.RecordBatch.from_pydict({"kind": [x[0] for x in kept], "inside": [x[1] for x in kept], "n": [x[2] for x in kept]}, schema=pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    counts = settle(
        pages.select(content).mapInArrow(count, "kind string, inside boolean, n bigint")
        .groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inn"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("out"))
    )
    inn, out = (x or 0 for x in counts.agg(F.sum("inn"), F.sum("out")).first())
    rows = counts.where((F.col("inn") + F.col("out")) * RAREST >= inn + out).collect()  # RAREST rows at most
    if not inn or not out:
        return Weights()
    odds = {r["kind"]: math.log((r["inn"] + 0.5) / (inn + 1)) - math.log((r["out"] + 0.5) / (out + 1)) for r in rows}
    default = Weights()
    return Weights(
        word=max(0.1, odds.pop("word", default.word)), link_word=max(0.01, min(odds.pop("link_word", 0), default.word)),
        tags={k: min(-0.2, v) for k, v in odds.items()},
    )


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest sum; the first of equals; (0, 0) if none is above zero."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def extract_text(page: str, weights: Weights) -> str:
    read = Page(page)
    tokens, elements = read.tokens, read.elements
    scores = []
    for t in tokens:
        if t.kind != "word":
            scores.append(weights.tags.get(t.kind, weights.other))
        else:
            n = 0 if t.dropped else len(t.text.split())
            scores.append(n * (weights.link_word if t.linked else weights.word))
    start, end = best_run(scores)
    if start == end:
        return ""
    # the region grows to the element around its words, up to a labelled container; the
    # element around the first and the last of them is around all
    words = [t.element for t in tokens[start:end] if t.kind == "word" and not t.dropped and t.text.strip()]
    around, other = words[0], words[-1]
    while around != other:
        if other < 0 or around >= 0 and elements[around].depth >= elements[other].depth:
            around = elements[around].parent
        else:
            other = elements[other].parent
    if around >= 0 and elements[around].label >= 0:
        around = elements[around].label
    if around >= 0 and elements[around].name not in ("html", "body"):
        start, end = min(start, elements[around].begin), max(end, elements[around].end)
    parts = []
    for t in tokens[start:end]:
        if t.dropped:
            continue
        parts.append(html.unescape(t.text) if t.kind == "word" else "" if t.kind in INLINE else " ")
    return " ".join("".join(parts).split())


def extract_main_text(pages: DataFrame, weights: Weights | None = None, content: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (its code points).

    A null or empty page, and one without content, has an empty text; pages of any length
    are read whole; repeated rows stay; an empty table gives no rows.  Other columns stay;
    those named text or n_chars are replaced.
    """
    weights = weights or learn_weights(pages, content)

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract_text(x.as_py() or "", weights) for x in batch], pa.string())

    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars", content.lower())]
    found = pages.select(*rest, extract(F.col(content)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
