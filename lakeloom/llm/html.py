"""Main-text extraction from HTML by tree scoring.

A tolerant reader builds the element tree (unclosed paragraphs, list items and
cells end where HTML says they do).  Paragraphs give points for their length
and commas to their ancestors: all to the parent, half to the grandparent, less
further up.  A container's points are discounted by the share of its text that
lies in links.  The best container is kept with those siblings that score near
it; inside, menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments of readers are left out.

What surrounds an article is known by its tag (menus, footers, asides, controls)
or by its class, id or role.  A name whose parts are all such words or words of
layout ("site-header", "related-posts") leaves a block out, unless it holds the
heading or the main element of the page; a name with another word in it
("search-results-analysis") only if the block is mostly links.  Names of inline
elements do not matter.  A form is left out unless it holds the main text.  Lists
inside the chosen container stay, whatever they link to.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space in page order.  Nothing else
is dropped or cut.

Defined cases: null or empty html gives an empty text; html without tags is one
block; very deep trees end nesting at ``MAX_DEPTH`` (deeper elements become
siblings, no text is lost); repeated rows give repeated results; an empty table
gives no rows; input columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, record_batch, slices, text_bytes

BATCH_BYTES = 8 << 20
MAX_DEPTH = 200

EXTRACTED = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*\Z))*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
#: never part of a main text
DROPPED = frozenset("head script style noscript template nav footer aside button select option input textarea iframe svg annotation annotation-xml canvas embed audio video dialog menu map xmp noembed noframes datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul option".split()
)
#: a start tag ends an open element of these kinds (unless a boundary lies between)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",), "body": ("head",),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "body": ()}
ENDS_P = BLOCK - {"html", "body", "option"}
P_SCOPE = frozenset("html body table td th caption button object article section div main blockquote li dd".split())

#: words in class, id or role that mark what surrounds an article
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer foot comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter subscribe subscription signup login paywall popup modal overlay share sharing social related recommend recommended recommendations widget widgets toolbar pagination pager tags skip contentinfo complementary search dialog form".split()
)
#: words of layout that say nothing about what a block holds
NEUTRAL = frozenset(
    "site page main top bottom left right box container wrapper wrap list block area section inner outer button buttons link links post posts bar item items primary secondary global mobile fixed sticky inline module panel group content text title row col column columns sub id js icon icons message messages slot unit thread field fields us more".split()
)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARAGRAPHS = frozenset(("p", "pre", "blockquote", "td", "li", "dd", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset("body article main section div td blockquote ul ol dl table tbody tr center details fieldset form html header figure".split())
HEADINGS = frozenset(("h2", "h3", "h4", "h5", "h6"))


#: what can be the main container (a list or table row is part of one)
CANDIDATES = frozenset("html body article main section div td blockquote center details fieldset form".split())


class Node:
    __slots__ = ("children", "depth", "drop", "heads", "links", "named", "parent", "points", "prose", "size", "tag", "wanted")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.drop = parent.drop if parent else False
        self.wanted = False
        #: 2: named as a surrounding, 1: perhaps, 3: a header
        self.named = 0
        self.points = 0.0
        self.size = self.links = self.prose = 0
        #: 2: the page's heading or main element is inside, 1: another heading
        self.heads = 0


def _called(name: str) -> int:
    """What a class, id or role says of its block (see ``Node.named``)."""
    parts = {p.lower() for p in PART.findall(name)}
    unwanted = parts & UNWANTED
    if not unwanted:
        return 0
    if parts - unwanted - NEUTRAL:
        return 1
    return 3 if unwanted == {"header"} else 2


def _marks(node: Node, attributes: str) -> None:
    """What an element's attributes say about it."""
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            names += unescape(value).split()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            node.drop = True
    if names:
        node.wanted = bool(WANTED.search(" ".join(names)))
        if node.tag in BLOCK and node.tag not in ("html", "body", "article", "main"):
            called = {_called(n) for n in names}
            node.named = next((k for k in (2, 3, 1) if k in called), 0)


def tree(html: str) -> Node:
    """The element tree of a page; text stays in ``children`` as decoded strings."""
    root = at = Node("html", None)
    pos, n = 0, len(html)
    flat: dict[str, int] = {}  # open elements beyond the greatest depth

    def add(text: str) -> None:
        if text and not at.drop:
            at.children.append(unescape(text) if "&" in text else text)

    while pos < n:
        start = html.find("<", pos)
        if start < 0:
            add(html[pos:])
            break
        m = TOKEN.match(html, start)
        if m is None:  # a lone "<" is text
            add(html[pos : start + 1])
            pos = start + 1
            continue
        add(html[pos:start])
        pos = m.end()
        if m[1]:
            tag = m[1].lower()
            if flat.get(tag):
                flat[tag] -= 1
                if tag in BLOCK and not at.drop:
                    at.children.append(Node("hr", at))
                continue
            node = at
            while node is not None and node.tag != tag:
                # an end tag of an inline element does not end blocks
                node = None if tag not in BLOCK and node.tag in BLOCK else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            elif tag in BLOCK and tag != "html" and not at.drop:
                at.children.append(Node("hr", at))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in ENDS_P:
            node = at
            while node is not None and node.tag != "p" and node.tag not in P_SCOPE:
                node = node.parent
            if node is not None and node.tag == "p" and node.parent is not None:
                at = node.parent
        if tag in CLOSES:
            node, hit = at, None
            while node is not None and node.tag not in SCOPE[tag]:
                if node.tag in CLOSES[tag]:
                    hit = node
                node = node.parent
            if hit is not None and hit.parent is not None:
                at = hit.parent
        if tag == "html":
            continue
        node = Node(tag, at)
        if tag in DROPPED or (tag == "header" and not _inside(at, ("article", "main"))):
            node.drop = True
        if m[3] and not node.drop:
            _marks(node, m[3])
        if not at.drop:
            at.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            if not node.drop:
                node.children.append(unescape(html[pos : end.start() if end else n]))
            pos = end.end() if end else n
            continue
        if node.depth < MAX_DEPTH:
            at = node
        elif not node.drop:
            flat[tag] = flat.get(tag, 0) + 1
    return root


def _inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _weigh(node: Node, in_link: bool = False) -> None:
    """Text sizes with and without links, text of paragraphs, and what headings are inside."""
    in_link = in_link or node.tag == "a"
    node.size = node.links = node.prose = 0
    node.heads = 2 if node.tag in ("main", "h1") or (node.tag == "article" and not node.drop) else int(node.tag in HEADINGS)
    for child in node.children:
        if isinstance(child, str):
            text = len(SPACE.sub(" ", child).strip())
            node.size += text
            node.links += text if in_link else 0
        elif not child.drop:
            _weigh(child, in_link)
            node.size += child.size
            node.links += child.links
            node.prose += child.prose
            node.heads = max(node.heads, 1 if child.named == 2 and child.tag == "article" else child.heads)
    if node.tag == "p":
        node.prose = node.size - node.links


def _judge(node: Node, prose: int) -> None:
    """Leave out forms and blocks that their names mark, but for those that hold the main text."""
    for child in node.children:
        if isinstance(child, str) or child.drop:
            continue
        if child.tag == "form":
            child.drop = child.heads < 2 and 2 * child.prose <= prose
        elif child.named == 1:
            child.drop = 2 * child.links > child.size
        elif child.named:
            child.drop = child.heads < 2 and not (child.named == 3 and child.heads and _inside(node, ("article", "main")))
        if not child.drop:
            _judge(child, prose)


def _measure(node: Node) -> None:
    """The points that paragraphs hand up; what is left out weighs nothing."""
    own = 0
    commas = 0
    for child in node.children:
        if isinstance(child, str):
            own += len(SPACE.sub(" ", child).strip())
            commas += child.count(",") + child.count("，") + child.count("、")
        elif not child.drop:
            _measure(child)
            if child.tag not in BLOCK:
                own += child.size
                commas += int(child.points)
    if node.tag not in BLOCK:
        node.points = commas  # an inline element passes its commas to its block
        return
    if own and (node.tag in PARAGRAPHS or node.tag in CONTAINERS) and own > node.links:
        points = 1 + commas + min(own / 100, 3)
        target, share = node if node.tag in ("body", "div", "article", "section", "main") else node.parent, 1.0
        level = 0
        while target is not None and level < 5:
            target.points += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (2 * (level + 1))
            target = target.parent


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _score(node: Node) -> float:
    bonus = 25.0 if node.tag in ("article", "main") else 5.0 if node.wanted else 0.0
    return (node.points + (bonus if node.points else 0.0)) * (1 - _density(node))


def _containers(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        if at.tag in CANDIDATES:
            yield at
        stack.extend(c for c in reversed(at.children) if isinstance(c, Node) and not c.drop)


def _linky(node: Node) -> bool:
    """A list, table or division that is little else than links."""
    return node.tag in ("ul", "ol", "dl", "table", "div", "section") and _density(node) > 0.6


def _blocks(node: Node, out: list[list[str]]) -> None:
    if node.drop:
        return
    block = node.tag in BLOCK
    if block:
        out.append([])
    for child in node.children:
        if isinstance(child, str):
            out[-1].append(child)
        elif child.tag == "br":
            out[-1].append(" ")
        else:
            _blocks(child, out)
    if block:
        out.append([])


def main_text(html: str) -> str:
    root = tree(html)
    _weigh(root)
    _judge(root, root.prose)
    _weigh(root)
    _measure(root)
    best, top = None, 0.0
    for node in _containers(root):
        score = _score(node)
        # the first of equal containers is the outer one
        if best is None or score > top:
            best, top = node, score
    if best is None or top <= 0:
        best = root
    kept = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * top)
        kept = []
        for child in best.parent.children:
            if child is best:
                kept.append(child)
            elif isinstance(child, Node) and not child.drop and not _linky(child):
                near = child.tag in CONTAINERS and _score(child) >= least
                prose = child.tag == "p" and child.size > 80 and _density(child) < 0.25
                if near or prose or child.tag == "h1":
                    kept.append(child)
    out: list[list[str]] = [[]]
    for node in kept:
        out.append([])
        _blocks(node, out)
    texts = (" ".join("".join(parts).split()) for parts in out if parts)
    return " ".join(t for t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", BATCH_BYTES):
        texts = [main_text(v.as_py().decode("utf-8", "replace")) if v.is_valid else "" for v in batch.column("html")]
        texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]  # references to surrogates
        yield record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, EXTRACTED)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` to ``(page_id, url, text, n_chars)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))
    return rows.mapInArrow(lean(_extract), EXTRACTED)


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
