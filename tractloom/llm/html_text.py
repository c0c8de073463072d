"""Main text of web pages by tree scoring.

A page is read into a tree of its block elements. Each paragraph outside boilerplate gives points for its length and
its commas to its container, half of them to the container around it, a quarter to the next, and so on to the root; what
a container gathers is discounted by the share of its text that stands in links. The best container is kept, where
article and main elements score a bonus, and of its siblings those that score well beside it or hold a real paragraph.
Text is read in page order, block by block.

Reading takes time in proportion to the page: open elements are found by their last places, sums over containers run
from the last element to the first, and quotes that never close are met only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm.runtime import arrow_pass, flat

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea noembed noframes title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
LISTS = frozenset("ul ol dl table body article section div main select datalist".split())

#: Elements and roles that hold no article text.
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset head select datalist svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Words that name boilerplate as the whole of a class or id, or as its last part ("site-header", "cookie-notice").
LAST = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist discussion respond replies feedback disqus"
    " cookie cookies consent gdpr notice notices announcement alert sidebar side widget widgets menu nav navbar navigation topbar masthead header footer foot footnav copyright legal share sharing social related"
    " recommended newsletter subscribe subscription signup login popup modal overlay pagination pager tags toolbar skip".split()
)
#: Words that do so as the first part too ("comment-body", "nav-list").
LEADING = frozenset("ad ads advert adverts sponsored promo breadcrumb breadcrumbs comment comments disqus cookie cookies consent gdpr sidebar nav navbar footer footnav newsletter related share sharing skip pagination".split())
#: Parts that name what readers wrote, wherever they stand ("user-feedback-list").
READERS = frozenset("comments feedback replies disqus".split())
#: First parts that name boilerplate only where the element is short or full of links ("share-bar", but not "share-price").
WEAK = frozenset("related share sharing skip newsletter promo ad".split())
LONG_PROSE = 200
CONTENT = frozenset("article body content entry main post story text page".split())
ASIDE_ARTICLES = frozenset("comment comments reply replies ad ads promo teaser card".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*+")
ATTRS = re.compile(r"[^'\">]*+(?:\"[^\"]*+\"[^'\">]*+|'[^']*+'[^'\">]*+)*+")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[-_:]+")
PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split())
#: Elements that stand beside the best container as parts of the same article if they hold a paragraph.
SECTIONS = frozenset("section div".split())
LEAST_CHARS = 25
#: What the score of an element is multiplied with, and what a telling name adds.
BONUS, NAMED = {"article": 8.0, "main": 4.0}, 25.0


class Node:
    """hard: out by its element, role or invisibility, its own or that of one around it; out: by a name, too; weak: by a name, unless it holds long prose."""

    __slots__ = ("tag", "up", "hard", "out", "weak", "score", "chars", "links", "good", "order")

    def __init__(self, tag: str, up: Node | None, hard: bool, out: bool, weak: bool, good: bool, order: int) -> None:
        self.tag, self.up, self.hard, self.out, self.weak, self.good, self.order = tag, up, hard, out, weak, good, order
        self.score, self.chars, self.links = 0.0, 0, 0


def names_of(attrs: str) -> tuple[list[list[str]], bool]:
    """Classes and ids, each in its parts, and whether the element is invisible or has a role that holds no article text."""
    names, gone = [], False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            names += [[p for p in PARTS.split(CAMEL.sub("-", x).lower()) if p] for x in value.split()]
        elif key == "role":
            gone |= value.lower() in ROLES
        elif key == "hidden":
            gone = True
        elif key == "style":
            gone |= INVISIBLE.search(value) is not None
        else:
            gone |= value.lower() == "true"
    return [x for x in names if x], gone


class Page:
    """Text blocks with the element that holds each, in page order, and all block elements."""

    def __init__(self, html: str) -> None:
        self.root = Node("body", None, False, False, False, False, 0)
        self.nodes, self.stack, self.blocks = [self.root], [self.root], []
        self.places: dict[str, list[int]] = {}  # of each element, where it is open in the stack
        self.barriers = [0]  # where the stack has one of LISTS
        self.piece: list[str] = []
        self.link_chars = self.depth = 0
        self.read(html)

    def flush(self) -> None:
        if self.piece:
            text = " ".join("".join(self.piece).split())
            self.piece.clear()
            if text:
                node = self.stack[-1]
                self.blocks.append((text, node))
                node.chars += len(text)
                node.links += min(self.link_chars, len(text))
        self.link_chars = 0

    def pop_to(self, k: int) -> None:
        self.flush()
        while len(self.stack) > k:
            at = len(self.stack) - 1
            self.places[self.stack.pop().tag].pop()
            if self.barriers[-1] == at:
                self.barriers.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        """The last place of an open element of these, inside the last barrier; 0: none."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        return at if at > self.barriers[-1] else 0

    def read(self, html: str) -> None:
        at, end, quotes = 0, len(html), True
        while at < end:
            k = html.find("<", at)
            stop = k if k >= 0 else end
            if stop > at:
                self.text(html[at:stop])
            if k < 0:
                break
            c = html[k + 1 : k + 2]
            if html.startswith("<!--", k):
                z = html.find("-->", k + 4)
                at = z + 3 if z >= 0 else end
            elif (m := NAME.match(html, k + 1 + (c == "/"))) is not None:
                z = html.find(">", m.end())
                if c != "/" and quotes:
                    e = ATTRS.match(html, m.end()).end()
                    if e < end and html[e] == ">":
                        z = e
                    else:
                        quotes = False  # a quote that never closes: from here on a tag ends at the next >
                at = z + 1 if z >= 0 else end
                if c == "/":
                    self.close(m[0].lower())
                elif z >= 0:
                    tag = m[0].lower()
                    attrs = html[m.end() : z]
                    if tag not in RAW:
                        self.open(tag, attrs)
                    else:  # a trailing slash doesn't close such an element
                        shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                        at = shut.end() if shut else end
            elif c in ("/", "!", "?") and c:
                z = html.find(">", k + 1)
                at = z + 1 if z >= 0 else end
            else:
                self.text("<")
                at = k + 1
        self.flush()

    def text(self, raw: str) -> None:
        t = unescape(raw)
        self.piece.append(t)
        if self.depth:
            self.link_chars += len(t.strip())

    def close(self, tag: str) -> None:
        if tag == "a":
            self.depth = max(0, self.depth - 1)
        elif tag not in INLINE:
            if self.places.get(tag):
                self.pop_to(self.places[tag][-1])
                self.depth = 0
            else:
                self.flush()

    def open(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.piece.append(" ")
            elif tag == "a":
                self.depth += 1
            return
        self.flush()
        if tag in ("html", "body") or tag in VOID:
            return
        if tag in CLOSES_P and (k := self.last(("p",))):
            self.pop_to(k)
        if tag in SAME:
            while k := self.last(SAME[tag]):
                self.pop_to(k)
                if tag not in ("tr", "optgroup"):
                    break
        names, gone = names_of(attrs) if attrs else ([], False)
        up = self.stack[-1]
        if tag in ("article", "main"):
            bad = tag == "article" and any(p in ASIDE_ARTICLES for x in names for p in x)
        else:
            bad = any(x[-1] in LAST or x[0] in LEADING - WEAK or not READERS.isdisjoint(x) or (len(x) > 1 and x[0] == "social") and x[1] in ("links", "media", "icons", "buttons", "bar") for x in names)
        hard = up.hard or gone or tag in BOILERPLATE
        weak = not bad and tag not in BONUS and any(x[0] in WEAK for x in names)
        node = Node(tag, up, hard, hard or bad, weak, tag in BONUS or any(p in CONTENT for x in names for p in x), len(self.nodes))
        self.nodes.append(node)
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag in LISTS:
            self.barriers.append(at)
        self.stack.append(node)
        self.depth = 0


def density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def marked(nodes: list[Node], chosen: set[Node]) -> set[Node]:
    """The chosen elements and all that are inside them; containers come before what they hold."""
    inside = set(chosen)
    for n in nodes:
        if n.up in inside:
            inside.add(n)
    return inside


def main_text(html: str | None) -> str:
    """The article's blocks joined by an empty line. Pages without markup are one block; null is empty."""
    if not html:
        return ""
    page = Page(html)
    nodes = page.nodes
    for n in reversed(nodes[1:]):
        n.up.chars += n.chars
        n.up.links += n.links
    for n in nodes[1:]:
        n.out |= n.up.out or (n.weak and not (n.chars >= LONG_PROSE and density(n) < 0.25))
    kept = [(t, n) for t, n in page.blocks if not n.out]
    if not kept:  # names alone don't empty a page
        kept = [(t, n) for t, n in page.blocks if not n.hard]
        for n in nodes:
            n.out = n.hard
    prose: set[Node] = set()
    for text, node in kept:
        if len(text) >= LEAST_CHARS and density(node) <= 0.5:
            if node.tag in PARAGRAPHS:
                up = node
                while up is not None and up not in prose:
                    prose.add(up)
                    up = up.up
            to = node.up if node.tag in PARAGRAPHS and node.up is not None else node
            to.score += 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)
    for n in reversed(nodes[1:]):
        n.up.score += n.score / 2
    for n in nodes:
        if n.score:
            n.score = (n.score * BONUS.get(n.tag, 1.0) + NAMED * n.good) * (1 - density(n))
    scored = [n for n in nodes if n.score > 0 and not n.out]
    if scored:
        best = max(scored, key=lambda n: (n.score, -n.order))
        chosen = {best}
        if best.up is not None:
            least = max(10.0, best.score * 0.2)
            for n in nodes:
                if n.up is best.up and not n.out and n is not best and (n.score >= least or (density(n) < 0.25 and (n.tag in PARAGRAPHS and n.chars > 80 or n.tag in SECTIONS and n in prose))):
                    chosen.add(n)
        inside = marked(nodes, chosen)
        found = [t for t, n in kept if n in inside]
    else:
        # Nothing long enough to score: the article or main element if there is one, else all that is no boilerplate.
        chosen = {n for n in nodes if n.tag in BONUS and not n.out}
        inside = marked(nodes, chosen)
        found = [t for t, n in kept if (n in inside if chosen else density(n) <= 0.5)]
    return "\n\n".join(found)


OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, carry: list[str]) -> DataFrame:
    """text and n_chars (code points) of every row of pages, from the whole html."""

    def make() -> Callable:
        def f(batch: pa.RecordBatch) -> dict:
            text = [main_text(h.as_py()) for h in batch.column(0)]
            return {"text": text, "n_chars": [len(t) for t in text]}

        return f

    return arrow_pass(pages, {"html": F.col("html")}, carry, make, OUT)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars.

    Null and empty html give the empty text; pages of any length and depth are read whole; where containers tie, the
    first counts; repeated rows give repeated results; an empty table gives no rows; other columns are not carried.
    """
    return flat(extract(pages, ["page_id", "url"]))
