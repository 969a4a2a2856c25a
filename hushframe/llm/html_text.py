"""Main text of web pages by composite text density.

A small tolerant parser makes a tree of the page.  Menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts, styles and the head are marked by element, role or name and take no
part, unless only a name or being a form speaks against an element that the article or most of the text lies in.
For every other node the density is its link-adjusted characters per tag:

    density = C / T * log_b(C / L' * T / T'),   b = ln(C / N' * L + LC / C * N + e)

with C characters, T tags, L characters in links and T' link tags of the node, N' = C - L, and LC and N those
of the body; composite text density as published by Sun, Song and Liao (2011).  A node's
density sum is the sum of its children's densities.  Text that stands beside blocks counts as a child of its own.
The threshold is the least density on the path from the node with the largest density sum to the body.  From the
body down, a child that reaches the threshold is searched on, any other is left out, until a node has the largest
density sum of all that it holds.  That node stays, but for containers and lists of links before the first and
behind the last of its children that reach the threshold.  Headings stay with what follows them, around
an article only if it has no h1.
An article or main element that the largest sum lies in, or that has most of the page's text outside links, stays
whole and alone; where several articles reach the threshold, they all do, with what reaches it between them.

Inside a block, white space becomes one space and character references are decoded; blocks are
joined by an empty line.  Work per page is linear in its length; pages are independent, so there is
no shuffle, and a lost task is rerun alone.

Edge cases: null or empty html, or a page without text outside the marked parts, gives "".  Unclosed, stray
and overlapping tags are closed as browsers do for paragraphs, list items, table cells and options.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: What the standard says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Elements that end an open element of the same kind, up to one of the listed containers.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements, roles and name parts that are not main text.
DROPPED = frozenset("head script style noscript template nav footer aside button input select textarea iframe object embed svg math canvas audio video dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr "
    "footer foot header masthead menu nav navbar navigation navi notice notices notification popup modal overlay promo promoted related recommended share sharing "
    "sidebar sidebars side social sponsor sponsored subscribe newsletter skip toolbar widget widgets reply replies".split()
)
#: Of these, the ones of things that hold long texts or articles of their own.
OTHER_TEXTS = frozenset("comment comments commentlist disqus reply replies related recommended promoted sponsored cookie cookies consent gdpr notice notices".split())

#: In a name, words that make the rest a description of what an element is not, and of a title's own header.
UNTRUE = frozenset("has with without no not".split())
TITLE_OF = frozenset("entry post article content story title".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("div section center fieldset header form address".split())

#: After "<" or "</": a tag's name; then an attribute's name and value.  An unclosed quote is a character like others.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: What ends the elements whose content is not markup, by name.
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "sum", "named")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.named: frozenset[str] = frozenset()


Attributes = list[tuple[str, str]]


def _is_dropped(tag: str, attributes: Attributes, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value.strip() in DROPPED_ROLES:
            return True
    return False


def _names(tag: str, attributes: Attributes) -> frozenset[str]:
    """What speaks against an element without deciding: listed words of its class and id, or being a form."""
    out = {"form"} if tag == "form" else set()
    if tag not in ("html", "body", "article", "main"):
        for attribute, value in attributes:
            if attribute in ("class", "id"):
                for name in value.split():
                    out |= _dropped_names(name)
    return frozenset(out)


def _dropped_names(name: str) -> frozenset[str]:
    words = _NAME.findall(name)
    if not UNTRUE.isdisjoint(words) or (words[-1:] == ["header"] and not TITLE_OF.isdisjoint(words)):
        return frozenset()
    return DROPPED_NAMES.intersection(words)


def _drop_named(root: Node) -> None:
    """Drop the elements with a listed name and the forms, but for those that the main text lies in.

    That is one that holds the article or main of the most text outside links, or one of half as much, or, if there is
    none elsewhere, over half of the page's text outside links.  One named for comments and the like must also hold an
    h1 or main, or nine tenths of that text.  Where no text would be left, fewer or none are dropped.
    """
    nodes = _in_order(root)
    if not any(n.named for n in nodes):
        return
    linked, plain, titled = {id(root): False}, dict.fromkeys(map(id, nodes), 0), set()
    for node in nodes[1:]:
        linked[id(node)] = linked[id(node.parent)] or node.tag == "a"
    for node in reversed(nodes):
        if not linked[id(node)]:
            plain[id(node)] += sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
            if node.tag in ("h1", "main") or id(node) in titled:
                titled.add(id(node.parent))
    total = plain[id(root)]
    other, apart, articles = set(), set(), []
    for node in nodes:
        if not OTHER_TEXTS.isdisjoint(node.named) and id(node) not in titled and 10 * plain[id(node)] < 9 * total:
            other.add(id(node))
        if id(node) in other or id(node.parent) in apart:
            apart.add(id(node))
        elif node.tag in ("article", "main") and plain[id(node)]:
            articles.append(node)
    most = max((plain[id(n)] for n in articles), default=0)
    holds = set()
    for node in articles:
        up = node if 2 * plain[id(node)] >= most else None
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.parent
    gone = [n for n in nodes if n.named and (id(n) in other or not (id(n) in holds or (not articles and 2 * plain[id(n)] > total)))]
    for some in (gone, [n for n in gone if id(n) in other]):
        under = {id(n) for n in some}
        for node in nodes[1:]:
            if id(node.parent) in under:
                under.add(id(node))
        if sum(plain[id(n)] for n in some if id(n.parent) not in under) < total:  # never all there is
            for node in some:
                node.dropped = True
            return


class Open:
    """The open elements, and at which depths those of each name and the blocks are, so that no end tag has to search."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at, self.blocks = [root], {}, [0]

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all that it holds."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of this name; 0 without one."""
        depths = self.at.get(tag)
        return depths[-1] if depths else 0

    def end(self, tag: str) -> bool:
        """An end tag; one of an inline element does not reach out of its block."""
        depth = self.last(tag)
        if not depth or (tag in INLINE and depth < self.blocks[-1]):
            return False
        self.close(depth)
        return True

    def imply(self, tag: str) -> None:
        """Close what the start of ``tag`` ends: an open paragraph, or a sibling list item, cell or row."""
        if tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            floor = max(self.last(s) for s in stops)
            found = []
            for name in [*ends, "p"] if tag in ("li", "dt", "dd") else ends:
                depths = self.at.get(name, [])
                if depths and depths[-1] > floor:
                    found.append(depths[bisect_right(depths, floor)])
            if found:
                self.close(min(found))
        elif tag in CLOSES_P and self.blocks[-1] and self.nodes[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])


def _attributes(page: str, at: int) -> tuple[Attributes, int]:
    """The attributes from ``at`` on, and where the tag ends; the page's length if it is never closed."""
    found = []
    while m := _ATTRIBUTE.match(page, at):
        found.append((m[1].lower(), (m[2] or m[3] or m[4] or "").lower()))
        at = m.end()
    end = page.find(">", at)
    return found, end + 1 if end >= 0 else len(page)


def _markup_end(page: str, at: int, end: str) -> int:
    """Where a comment or declaration ends."""
    found = page.find(end, at)
    return found + len(end) if found >= 0 else len(page)


def parse(page: str) -> Node:
    """The tree of a page; its root stands for the body.

    Every character is passed once; what an end or start tag closes is looked up, not searched for."""
    root = Node("body", None, False)
    opened = Open(root)
    done = at = 0
    last = page.rfind(">")
    while True:
        at = page.find("<", at)
        m = _TAG.match(page, at + 1) if at >= 0 else None
        comment = at >= 0 and page.startswith(("!", "?"), at + 1)
        if at >= 0 and m is None and not comment:
            at += 1  # a character like others
            continue
        now = opened.top
        if (text := page[done : at if at >= 0 else len(page)]):
            now.children.append(text)
        if at < 0 or at > last:  # beyond, a tag that the end of the page cuts off
            return root
        if comment:
            done = at = _markup_end(page, at + 4, "-->") if page.startswith("<!--", at) else _markup_end(page, at, ">")
            continue
        tag = m[2].lower()
        attributes, done = _attributes(page, m.end())
        closed, at = page.endswith("/", m.end(), done - 1), done
        if tag in ("html", "body"):
            continue
        if m[1]:
            if not opened.end(tag) and tag in ("p", "br"):
                now.children.append(Node(tag, now, now.dropped))
            continue
        opened.imply(tag)
        now = opened.top
        node = Node(tag, now, now.dropped or _is_dropped(tag, attributes, bool(opened.last("article") or opened.last("main"))))
        if not node.dropped:
            node.named = _names(tag, attributes)
        now.children.append(node)
        if tag in RAW and not closed:
            end = _ENDS[tag].search(page, at)
            if tag not in DROPPED and tag != "title":
                node.children.append(page[at : end.start() if end else len(page)])
            node.dropped |= tag == "title"
            done = at = _markup_end(page, end.end(), ">") if end else len(page)
        elif tag not in VOID and not (closed and tag in ("svg", "path")):
            opened.push(node)


def _in_order(root: Node) -> list[Node]:
    """Every kept node, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            out.append(node)
            stack += [c for c in node.children if isinstance(c, Node)]
    return out


def _blockless(node: Node) -> bool:
    return node.tag in INLINE


def _part_runs(nodes: list[Node]) -> None:
    """Text and inline elements that stand beside blocks become blocks without a tag."""
    for node in nodes:
        if _blockless(node) or not any(isinstance(c, Node) and not c.dropped and not _blockless(c) for c in node.children):
            continue
        children: list[Node | str] = []
        run: list[Node | str] = []
        for c in [*node.children, None]:
            if c is not None and (isinstance(c, str) or c.dropped or _blockless(c)):
                run.append(c)
                continue
            if any(c.strip() if isinstance(c, str) else not c.dropped for c in run):
                block = Node("", node, False)
                block.children = run
                for x in run:
                    if isinstance(x, Node):
                        x.parent = block
                run = [block]
            children += run
            run = []
            if c is not None:
                children.append(c)
        node.children = children


def measure(root: Node) -> list[Node]:
    """Composite text densities and density sums of all kept nodes; they are returned, parents first."""
    _part_runs(_in_order(root))
    nodes = _in_order(root)
    linked = {id(root): False}
    for node in nodes[1:]:
        linked[id(node)] = linked[id(node.parent)] or node.tag == "a"
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        node.chars += own
        node.link_chars += own if linked[id(node)] else 0
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + (node.tag != "")
            up.link_tags += node.link_tags + (node.tag == "a")
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + ratio * (c - lc) + math.e)
            value = max(c / max(lc, 1) * t / lt, 1.0)
            node.density = c / t * (math.log(value) / max(math.log(base), 1e-9) if base > 1 else math.log(value)) if value > 1 else c / t * 1e-9
    for node in nodes[1:]:
        node.parent.sum += node.density
    return nodes


def _path(node: Node) -> list[Node]:
    """The node and all around it, up to the root."""
    path = [node]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def _linked(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def _whole(nodes: list[Node], path: list[Node], threshold: float) -> list[Node]:
    """The outermost article or main elements that the text lies in, if it lies in any."""
    around = next((k for k in range(len(path) - 1, -1, -1) if path[k].tag == "article"), None)
    main = next((n for n in path[around or 0 :] if n.tag == "main"), None)
    if around is None and main is not None:
        return [main]
    tags = ("article", "main") if around is None else ("article",)
    under, seen, found = {id(main or path[-1])}, set(), []
    for node in nodes:
        up = id(node.parent)
        if up in under:
            under.add(id(node))
            if up in seen:
                seen.add(id(node))
            elif node.tag in tags:
                seen.add(id(node))
                found.append(node)
    out = [n for n in found if n.density >= threshold]
    if around is None and 2 * sum(n.chars - n.link_chars for n in out) <= path[-1].chars - path[-1].link_chars:
        return []
    if len(out) > 1:  # short ones beside them too
        beside = {id(n.parent) for n in out}
        out = [n for n in found if n.density >= threshold or (id(n.parent) in beside and n.chars and not _linked(n))]
    return out


def core(root: Node) -> Node | None:
    """The root, if the page has text; all that is not main text is dropped from under it."""
    nodes = measure(root)
    top: dict[int, Node] = {}
    titled = set()
    for node in reversed(nodes):
        mine = top.get(id(node))
        if node.chars and not _blockless(node) and (mine is None or (node.sum, node.chars) >= (mine.sum, mine.chars)):
            mine = top[id(node)] = node
        if node.parent is not None:
            other = top.get(id(node.parent))
            if mine is not None and (other is None or (mine.sum, mine.chars) >= (other.sum, other.chars)):
                top[id(node.parent)] = mine
            if node.tag == "h1" or id(node) in titled:
                titled.add(id(node.parent))
    if id(root) not in top:
        return None
    path = _path(top[id(root)])
    threshold = min(n.density for n in path)
    whole = _whole(nodes, path, threshold)
    ways = [_path(n) for n in whole]
    stay, holds = {id(n) for n in whole}, {id(n) for way in ways for n in way}
    bare = not any(id(n) in titled for n in whole)
    common = set.intersection(*({id(n) for n in way} for way in ways)) if ways else set()
    stack = [root]
    while stack:
        node = stack.pop()
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped and not _blockless(c) and c.chars]
        if id(node) in stay or not kids:
            continue
        reach = [c.density >= threshold for c in kids]
        if id(node) in holds:
            # between articles, what reaches the threshold; around their common parent, none
            between = id(node) not in common or not any(id(c) in common for c in kids)
            goes = [id(c) in holds or (between and r) for c, r in zip(kids, reach, strict=True)]
        elif top[id(node)] is node:
            first, last = (reach.index(True), len(reach) - reach[::-1].index(True)) if any(reach) else (0, len(kids))
            for k, c in enumerate(kids):
                title = k < first and (c.tag in HEADINGS or id(c) in titled and not _linked(c))
                c.dropped = not (first <= k < last or title or (c.tag not in CONTAINERS and not _linked(c)))
            continue
        else:
            goes = [r or top.get(id(c)) is top[id(node)] for c, r in zip(kids, reach, strict=True)]
        follows = False
        for c, go in zip(reversed(kids), reversed(goes), strict=True):
            heading = (bare or id(node) not in holds) and (c.tag in HEADINGS or (id(c) in titled and not _linked(c)))
            follows = go or (follows and heading)
            c.dropped = not follows
            if go:
                stack.append(c)
    return root


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks under a node, in page order."""
    run: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            run.append(html.unescape(item))
            continue
        if item is None:
            text = _SPACE.sub(" ", "".join(run)).strip()
            run = []
            if text:
                yield text
            continue
        if item.dropped:
            continue
        if item.tag == "br":
            run.append(" ")
        elif _blockless(item):
            stack += reversed(item.children)
        else:
            stack += [None, *reversed(item.children), None]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    _drop_named(root)
    node = core(root)
    return "\n\n".join(blocks(node)) if node is not None else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, ...) to (..., text)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [main_text(page) for page in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], [*part.schema.names[1:], "text"])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The input's other columns with ``text``, which replaces a column of that name."""
    keep = [c for c in pages.columns if c not in (column, "text")]
    rows = pages.select(F.col(column).alias("__hf_html"), *keep)
    return rows.mapInArrow(_extract, T.StructType([*(rows.schema[c] for c in keep), T.StructField("text", T.StringType())]))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
