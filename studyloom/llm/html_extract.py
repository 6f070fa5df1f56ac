"""Main text of web pages by composite text density.

The page is parsed into a tree (unclosed paragraphs, items, rows and void tags as browsers close them). Subtrees that are
no article by their tag, role or class names go: scripts, styles, menus, page headers, footers, sidebars, notices, adverts,
forms and reader comments. Forms and class names are judged only after the densities of the page without the others are
known: an element around the core (where no article or main tag marks the article), or one that holds most of the text
outside links, stays whatever it is called, and if nothing would be left, all of them stay. For every remaining node the composite text
density is its characters per tag, adjusted by the share of characters and tags in links against that of the whole body.
The node whose children's densities have the largest sum is the core; the threshold is the least density on its path to
the body; every node that reaches it yields the node of largest sum beneath it. The text is taken from the article element
around the core or, without one, from the smallest subtree around all these nodes, less its link lists below the
threshold. Formatting elements (bold, spans) belong to their block and count as no tag.

Character references are decoded, white space within a block becomes one space, blocks are joined by two line feeds.

Defined results: a null or empty html gives an empty text; null ids and urls are kept; repeated rows give rows of their
own; an empty table gives an empty result; other columns are ignored..
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema

# fixed values: elements by how they are parsed and what they hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
NO_ARTICLE = frozenset("nav footer aside form button select option datalist dialog head object canvas audio video input menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads advert adverts advertisement advertising adbox"
    " adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " form search share sharing social comment comments disqus discussion replies respond related recommended recommendations pagination pager skip toolbar".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HEAVY = 0.5


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "chars", "links", "tags", "link_tags", "density", "total", "best", "drop", "core")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.drop = self.core = False
        self.best: Node = self


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("#page", {}, None)
    nodes, top, at = [root], root, 0
    open_tags: dict[str, int] = {}

    def leave(until: Node) -> Node:
        nonlocal top
        while True:
            gone, top = top, top.parent
            open_tags[gone.tag] -= 1
            if gone is until:
                return gone

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            top.kids.append(page[at:])
            break
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                top.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_tags.get("p"):
                continue
            if open_tags.get(tag) and tag not in VOID:
                held = top
                while held.tag != tag:
                    held = held.parent
                leave(held)
            elif tag == "br":
                top.kids.append(" ")
            continue
        attrs = {a[1].lower(): _html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3].strip() else {}
        if tag in ENDS_P and open_tags.get("p"):
            held = top
            while held.tag != "p" and held.tag not in ("table", "td", "th", "button", "object"):
                held = held.parent
            if held.tag == "p":
                leave(held)
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            held, last = top, None
            while held.tag not in stop and held.parent is not None:
                if held.tag in same:
                    last = held
                held = held.parent
            if last is not None:
                leave(last)
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or (m[0].endswith("/>") and tag in RAW):
            if tag in ("br", "hr", "img", "wbr") and tag != "wbr":
                top.kids.append(" ")
            continue
        node = Node(tag, attrs, top)
        top.kids.append(node)
        nodes.append(node)
        top = node
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return root, nodes


def _named(node: Node, but: str = "") -> bool:
    """Whether a class or id calls the element something else than an article, and not just ``but``."""
    for name in (*node.attrs.get("class", "").split(), node.attrs.get("id", "")):
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and any(w in NAMES and w != but for w in (words[0], words[-1])):
            return True
    return False


def _within(nodes: list[Node], what) -> set[int]:
    """The nodes that lie within another for which ``what`` holds."""
    found, holds = set(), set()
    for node in nodes:
        if what(node):
            holds.add(id(node))
        if node.parent is not None and (id(node.parent) in found or id(node.parent) in holds):
            found.add(id(node))
    return found


def _prune(nodes: list[Node], names: bool, kept: frozenset[int] = frozenset()) -> bool:
    """Mark the subtrees that are no article, by forms and names (but for the nodes ``kept``) only if ``names``; whether
    an article or main tag marks the article."""
    for node in nodes:
        node.chars = node.links = node.tags = node.link_tags = 0
        node.density = node.total = 0.0
        node.drop, node.best = False, node
    inside, commented = _within(nodes, lambda n: n.tag in ("article", "main")), _within(nodes, _comment)
    for node in nodes[1:]:
        if node.tag in ("article", "main") and not _named(node) and id(node) not in commented:
            up = node
            while up is not None and not up.core:  # core: holds an article
                up.core = True
                up = up.parent
    for node in nodes[1:]:
        if node.parent.drop:
            node.drop = True
        elif node.tag in ("html", "body"):
            node.drop = False
        elif node.attrs.get("hidden") is not None or node.attrs.get("aria-hidden") == "true" and node.tag not in INLINE:
            node.drop = True
        elif not node.core:
            called = (names or _comment(node)) and id(node) not in kept and _named(node)
            role = node.attrs.get("role", "").lower()
            form = node.tag == "form" or role == "form"
            other = called or (names and id(node) not in kept if form else node.tag in NO_ARTICLE or role in ROLES)
            if node.tag == "header":
                other = id(node) not in inside or called and _named(node, "header")
            node.drop = other and node.tag not in ("h1",)
        elif node.tag in ("nav", "aside", "footer", "form", "dialog"):
            node.drop = False
    marked = any(n.core for n in nodes)
    for node in nodes:
        node.core = False
    return marked


def _pruned(nodes: list[Node]) -> Node:
    """Mark the subtrees that are no article and measure the rest; returns the body (or the root)."""
    titled: set[int] = set()  # a wrapper around the page's title is no list of comments
    for node in nodes:
        if node.tag == "h1":
            for n in _above(node):
                if id(n) in titled:
                    break
                titled.add(id(n))
    marked = _prune(nodes, False, frozenset(titled))
    body = _measure(nodes)
    _settle(nodes)
    most = body.chars - body.links
    kept = {id(n) for n in nodes if not n.drop and 2 * (n.chars - n.links) > most}
    if not marked:
        kept |= {id(n) for n in (body.best, *_above(body.best))}
    _prune(nodes, True, frozenset(kept))
    if not _measure(nodes).chars:
        _prune(nodes, False, frozenset(titled))
        _measure(nodes)
    return body


def _above(node: Node) -> Iterator[Node]:
    up = node.parent
    while up is not None:
        yield up
        up = up.parent


def _comment(node: Node) -> bool:
    return any(w.lower() in ("comment", "comments", "replies", "disqus") for c in (node.attrs.get("class", ""), node.attrs.get("id", "")) for w in _WORDS.findall(c))


def _measure(nodes: list[Node]) -> Node:
    """Counts, densities and sums; returns the body (or the root)."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for node in reversed(nodes):
        if node.drop:
            continue
        node.chars += sum(len("".join(_html.unescape(k).split())) for k in node.kids if isinstance(k, str))
        if node.tag == "a" and "href" in node.attrs:
            node.links, node.link_tags = node.chars, node.link_tags + 1
            node.tags += 1
        elif node.tag not in INLINE:
            node.tags += 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags
            up.link_tags += node.link_tags
    share = body.links / max(body.chars, 1)
    for node in reversed(nodes):
        if node.drop:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.links, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.links, 1) * node.links + share * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / base if base > 0 else 0.0
        own = sum(len(k.split()) and len(k) for k in node.kids if isinstance(k, str)) if node.tag not in INLINE and any(isinstance(k, Node) and k.tag not in INLINE for k in node.kids) else 0
        node.total += own
        if node.best is node or node.best.total < node.total:
            node.best = node
        up = node.parent
        if up is not None:
            if node.tag in INLINE:
                up.total += node.total
            else:
                up.total += node.density
            if up.best is up or up.best.total <= node.best.total:
                up.best = node.best
    return body


def _settle(nodes: list[Node]) -> None:
    """best: the node of largest sum in each subtree; of equal ones the outermost, then the first in the page."""
    for node in nodes:
        node.best = node
    for node in reversed(nodes):
        up = node.parent
        if up is not None and not node.drop and node.best.total >= up.best.total and (up.best is not up or node.best.total > up.total):
            up.best = node.best


def _content(body: Node, nodes: list[Node]) -> tuple[Node, float]:
    """The subtree to read and the threshold."""
    _settle(nodes)
    core = body.best
    path = [core]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in (core, *_above(core)):
        if node.tag in ("article", "main"):
            return node, threshold
    within = _within(nodes, lambda n: n is body)
    marked = {id(n.best) for n in nodes if not n.drop and n.tag not in INLINE and n.density >= threshold and n.chars and (n is body or id(n) in within)}
    # the innermost node that has all of them
    below: dict[int, int] = {}
    common = core
    for node in reversed(nodes):
        below[id(node)] = below.get(id(node), 0) + (id(node) in marked)
        if marked and below[id(node)] == len(marked):
            common = node
            break
        if node.parent is not None:
            below[id(node.parent)] = below.get(id(node.parent), 0) + below[id(node)]
    return common, threshold


def extract(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page)
    body = _pruned(nodes)
    if not body.chars:
        return ""
    top, threshold = _content(body, nodes)
    whole = top.tag in ("article", "main")
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join(_html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    stack: list[Node | str | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            line.append(item)
        elif not item.drop:
            heading = item.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if not whole and not heading and item is not top and item.tag not in INLINE and item.density < threshold and item.links > _HEAVY * item.chars:
                close()
                continue
            if item.tag not in INLINE:
                close()
                stack.append(None)
            stack += reversed(item.kids)
    close()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(run, schema("page_id long, url string, text string, n_chars long"))
