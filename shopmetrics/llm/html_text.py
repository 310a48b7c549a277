"""Main text of web pages by tree scoring.

A page becomes a tree of elements. What is never part of an article goes first: scripts, styles,
forms, menus, page headers and footers, sidebars, adverts, notices and comments, told by tag, role
and the words of class and id. Each paragraph then passes points to its ancestors, one for its
commas each and more for its length: all to the parent, half to the grandparent, a third to the
next. An element's points are discounted by the share of its text that stands in links. The
element with most points is the article; siblings that score nearly as well, and headings, paragraphs, lists,
tables, quotes, code and bare text with few links, belong to it. Where everything in the parent does, or the
parent is an article or main element, the parent is taken, and so on upwards. The text is the blocks
of these elements in page order.

Defined cases: a null or empty page, and one without any text, gives the empty string; markup that
isn't closed ends with its parent; a ``<`` that begins no tag is text; pages are handled one by
one, so repeated ids, ties and further columns need nothing special. Of equally good elements the outermost
first one in the page is taken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import pieces, utf8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<[!?][^>]*+>", re.S
)
RAW = frozenset("script style noscript template iframe textarea title object svg math select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button dialog menu header fieldset label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that end when one of their kind begins, up to the elements given.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
WORDS = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|"
    r"side-?bar|sidebar|aside|widget|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|share|sharing|social|comments?|commentlist|"
    r"disqus|repl(?:y|ies)|respond|related|recommend\w*|newsletter|subscri\w*|paginat\w*|pager|login|sign-?up|search|toolbar|copyright|skip)(?![a-z])"
)
BOILERPLATE = re.compile(rf"(?:^|[^a-z]){WORDS}")
#: A name made of such words alone; what is left over would be the article's own.
ONLY_BOILERPLATE = re.compile(rf"{WORDS}(?:[-_]{WORDS})*[-_0-9]*")
#: Elements that the words drop as a whole; paragraphs, headings, cells and inline elements need a name of such words alone.
CONTAINERS = frozenset("div section ul ol dl table aside center figure details".split())
NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
START = {"article": 10.0, "main": 8.0, "section": 4.0, "div": 4.0, "td": 2.0, "blockquote": 2.0, "ul": -3.0, "ol": -3.0, "table": -1.0}
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body".split())
LONG = 25
#: What belongs to an article beside its paragraphs, if few of its characters stand in links.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p pre ul ol dl table blockquote figure figcaption details hr center address".split()) | INLINE
LINKED = 0.5


class Element:
    __slots__ = ("tag", "parent", "content", "dropped", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Element | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.content: list[Element | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def _dropped(tag: str, attributes: str, within: set[str]) -> bool:
    if tag in DROPPED and not (tag == "header" and within & {"article", "main"}):
        return True
    if not attributes:
        return False
    if HIDDEN.search(attributes) or ((role := ROLE.search(attributes)) and role[1].lower() in ROLES):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for m in NAMED.finditer(attributes):
        name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower()
        if tag in CONTAINERS:
            if BOILERPLATE.search(name):
                return True
        elif any(ONLY_BOILERPLATE.fullmatch(word) for word in name.split()):
            return True
    return False


def parse(page: str) -> Element:
    """Tree of the page; texts in ``content`` are decoded."""
    top = here = Element("#page", None)
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            here.content.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not top and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE:
                    node = top
                    break
                node = node.parent
            if node is not top:
                here = node.parent
            elif tag == "br":
                here.content.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag in VOID:
            here.content.append(" " if tag in ("br", "wbr") or tag in INLINE else Element(tag, here))
            continue
        if tag in CLOSES:
            ended, stop = CLOSES[tag]
            node = here
            while node is not top and node.tag not in stop:
                if node.tag in ended:
                    here = node.parent
                node = node.parent
        elif tag not in INLINE:
            node = here
            while node is not top and (node.tag in INLINE or node.tag == "p"):
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        within, node = set(), here
        while node is not top:
            within.add(node.tag)
            node = node.parent
        child = Element(tag, here, _dropped(tag, m[3], within))
        here.content.append(child)
        if not m[3].endswith("/") or tag not in INLINE:
            here = child
    return top


def _measure(top: Element) -> None:
    """Characters and linked characters of every element, without what is dropped."""
    order, stack, article = [], [top], set()
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag in ("article", "main") or node.parent in article:
            article.add(node)
        stack += [x for x in node.content if isinstance(x, Element) and not x.dropped]
    for node in reversed(order):
        for x in node.content:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif not x.dropped:
                node.chars += x.chars
                node.linked += x.linked
        if node.tag == "a":
            node.linked = node.chars
        links = sum(isinstance(x, Element) and not x.dropped for x in node.content)
        if node.tag in ("ul", "ol", "dl", "table") and node not in article and links > 1 and node.chars and node.linked >= 0.8 * node.chars:
            node.dropped = True  # a menu: a list of links


def _own_text(node: Element) -> str:
    """Text of a node and the inline elements within it."""
    out, stack = [], [iter(node.content)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(x)
            elif x.tag in INLINE and not x.dropped:
                stack.append(iter(x.content))
                break
        else:
            stack.pop()
    return "".join(out)


def _elements(top: Element) -> Iterator[Element]:
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.content) if isinstance(x, Element) and not x.dropped]


def _blocks(node: Element) -> Iterator[str]:
    """Blocks of text below ``node`` in page order, white space made single."""
    run: list[str] = []
    stack: list[tuple[Element, Iterator]] = [(node, iter(node.content))]
    while stack:
        here, rest = stack[-1]
        for x in rest:
            if isinstance(x, str):
                run.append(x)
            elif not x.dropped:
                if x.tag not in INLINE:
                    if text := " ".join("".join(run).split()):
                        yield text
                    run = []
                stack.append((x, iter(x.content)))
                break
        else:
            stack.pop()
            if here.tag not in INLINE:
                if text := " ".join("".join(run).split()):
                    yield text
                run = []


def _density(node: Element) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    top = parse(page)
    _measure(top)
    scored: list[Element] = []
    for node in _elements(top):
        if node.tag not in PARAGRAPHS and node is not top:
            continue
        text = " ".join(_own_text(node).split())
        if not text:
            continue
        points = text.count(",") + min(len(text) / 100, 3.0) + (1.0 if len(text) >= LONG else 0.1)
        # Text that stands in a container itself counts for the container.
        receiver = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") else node
        for share in (1.0, 0.5, 1 / 3):
            while receiver is not None and receiver.tag in INLINE:
                receiver = receiver.parent
            if receiver is None:
                break
            if not receiver.points:
                receiver.points = START.get(receiver.tag, 0.0) or 1e-9
                scored.append(receiver)
            receiver.points += points * share
            receiver = receiver.parent
    if not scored:
        return "\n\n".join(_blocks(top))
    rank = {node: (node.points * (1 - _density(node))) for node in scored}
    best = max(scored, key=rank.__getitem__)

    def belongs(x: Element | str) -> bool:
        if isinstance(x, str) or x is best:
            return True
        points = rank.get(x, 0.0)
        close = points >= 0.2 * rank[best] and (points >= 10.0 or (x.chars > 80 and _density(x) < 0.25))
        return close or (x.tag in BESIDE and _density(x) < LINKED)

    # Up to where other things than the article begin; there, what belongs to it is taken one by one.
    node = best
    while node.parent is not None and node.parent.tag not in ("#page", "html", "body"):
        siblings = [x for x in node.parent.content if x is not node and (isinstance(x, str) or (not x.dropped and x.chars))]
        if node.parent.tag not in ("article", "main") and not all(belongs(x) for x in siblings):
            break
        node = node.parent
    if node.parent is None or node.tag == "body":
        return "\n\n".join(_blocks(node))
    level = Element("#kept", None)
    level.content = [x for x in node.parent.content if x is node or isinstance(x, str) or (not x.dropped and belongs(x))]
    return "\n\n".join(_blocks(level))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page's whole html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(utf8(batch.column(2))[1]):
                texts = [main_text(page) for page in batch.column(2).slice(a, b - a).to_pylist()]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def with_lengths(texts: DataFrame) -> DataFrame:
    return texts.withColumn("n_chars", F.length("text").cast("long"))
