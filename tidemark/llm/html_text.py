"""Main text of HTML pages by composite text density.

A forgiving parser builds a light DOM. Elements that never hold main text go first: scripts, styles, navigation, page
headers and footers, asides and hidden elements. So do forms and elements whose class or id names a menu, an advert, a
notice, a sidebar or comments, unless they hold an article or main, or most of the page's text outside links and no main
or single article stands apart: such a one is a wrapper, and is left to the densities. Within an article, marks that
may name a subject too, such as legal or header, count only where the text is mostly links. What starts with a heading
such as "3 comments" is marked like comments. Every node left gets its composite
text density: characters per tag, adjusted by the share of characters and tags that belong to links. A node's density sum
is the sum over its children that are blocks: inline markup within a paragraph counts as tags, but makes no container of
it. The threshold is the smallest density on the path from the node with the largest density sum to the body; from the
body down, each node at or above the threshold contributes the subtree with the largest density sum inside it.

Text: blocks in page order joined by one newline, white space inside a block as one space, character references decoded.
Null and empty pages, and pages without text, give the empty string. Ties go to the earlier node. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import map_batches, named, texts_of, with_fields

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noframes iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option legend summary body html".split())
#: An opening tag of the first kind ends an open element of the second, up to the third.
IMPLIED = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tbody": ("tbody thead tfoot tr td th", ("table",)),
    "thead": ("tbody thead tfoot tr td th", ("table",)),
    "tfoot": ("tbody thead tfoot tr td th", ("table",)),
    "option": ("option", ("select",)),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in IMPLIED.items()}

#: Elements that never hold main text, roles of such elements, and words in classes and ids that mark them as a rule.
DROPPED = frozenset("script style noscript noframes template head title nav footer aside button select textarea input iframe object svg canvas dialog menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = re.compile(
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|promotions?|banners?|menus?|nav|navbar|navigation|navigations|breadcrumbs?|sidebars?|side|footers?|foot|headers?|masthead|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletter|subscribe|subscription|signup|login|comments?|disqus|replies|discussion|respond|share|sharing|social|related|recommended|recommendations|pagination|pager|toolbar|widgets?|copyright|disclaimer|legal|skip|tags"
)
#: Marks that name subjects and parts of articles too.
SUBJECTS = frozenset("legal discussion social tags side header headers foot footer promotion promotions disclaimer copyright".split())
#: Words before a header or footer that make it one of the article, not of the page.
OF_ARTICLE = frozenset("article post entry story content".split())
#: Headings of what readers add, without their counts.
REPLY_HEADING = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader|user|leave an?|post an?|add an?|join the|write an?)\W+)?(?:comments?|replies|reply|responses|discussion)(?:\W+\d+)?\W*", re.I)
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Marks of what readers add to an article.
REPLIES = frozenset("comment comments disqus replies discussion respond".split())
#: Words after which a mark names what a page has or is about, and words that only give a mark's shape.
ABOUT = frozenset("has no not with without hide hides show category categories cat tag tagged topic type format layout".split())
SHAPES = frozenset("area bar box buttons button form icons item items link links list message posts slot unit".split())
MAIN = frozenset("article main body html".split())

#: A quote opens a value only after an equals sign; one that is never closed is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|$)", re.S)
#: One attribute: its name, and its value, which a quoted one ends only at its quote.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")


class Node:
    """An element. block: the nearest block, itself or above; depth: how many are above."""

    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "block", "depth")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.depth: int = 0 if parent is None else parent.depth + 1


class Open:
    """The open elements: the innermost one, and those of every tag from the outside in."""

    def __init__(self, root: Node):
        self.node, self.by_tag = root, {root.tag: [root]}

    def enter(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.node = node

    def leave(self, node: Node) -> None:
        """End this element and all inside it."""
        while True:
            ended = self.by_tag[self.node.tag].pop()
            self.node = ended.parent
            if ended is node:
                return

    def last(self, tag: str) -> Node | None:
        found = self.by_tag.get(tag)
        return found[-1] if found else None

    def outermost(self, tags: frozenset[str], below: int) -> Node | None:
        """The outermost open element of these tags that is deeper than so many levels."""
        found = []
        for tag in tags:
            own = self.by_tag.get(tag, ())
            k = bisect_right(own, below, key=lambda n: n.depth)
            if k < len(own):
                found.append(own[k])
        return min(found, key=lambda n: n.depth, default=None)


def _mark(value: str) -> str | None:
    """The mark that a class or id names: a whole token, or the end of one, or its beginning if only a shape follows."""
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = [w for x in re.split(r"[_-]+", token) if (w := x.rstrip("0123456789"))]
        while len(words) > 1 and words[-1] in SHAPES:
            words.pop()
        if not words or not MARKS.fullmatch(words[-1]) or not ABOUT.isdisjoint(words[:-1]):
            continue
        if words[-1] in ("header", "footer") and not OF_ARTICLE.isdisjoint(words[:-1]):
            continue
        return words[-1]
    return None


def _drops(tag: str, attributes: str, in_article: bool) -> bool | str:
    """True for elements that never hold main text, the mark of those that hold none as a rule, else False."""
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        # a header of the page; one inside an article holds its title
        return True
    mark = "form" if tag == "form" else None
    if not attributes or tag in MAIN:
        return mark or False
    seen = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape((m[2] or "").strip("\"'"))
        if name in seen:
            # of attributes that repeat, the first counts
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            mark = mark or _mark(value)
    return mark or False


def _settle(root: Node, marked: dict[int, str]) -> None:
    """Drop marked elements, but none that holds an article or main, nor one that holds most of the page's text outside
    links where no main and no single article stands apart from marked elements.

    Those are left to the densities, except replies that come after an article or main has ended.
    """
    nodes = _order(root)
    text: dict[int, int] = {}
    linked: dict[int, int] = {}
    after: dict[int, int] = {}
    holds: set[int] = set()
    within: set[int] = set()
    for node in nodes:
        if node.parent is not None and (id(node.parent) in within or node.parent.tag in ("article", "main")):
            within.add(id(node))
    for place in range(len(nodes) - 1, -1, -1):
        node, own, links = nodes[place], 0, 0
        end = place + 1
        for child in node.children:
            if child.__class__ is str:
                own += len(" ".join(unescape(child).split()))
            elif not child.dropped:
                own += text[id(child)]
                links += linked[id(child)]
                end = max(end, after[id(child)])
                if child.tag in ("article", "main") and text[id(child)] or id(child) in holds:
                    holds.add(id(node))
        if node.tag == "a":
            own, links = 0, own + links
        text[id(node)], linked[id(node)], after[id(node)] = own, links, end
    ended = min((after[id(n)] for n in nodes if n.tag in ("article", "main") and text[id(n)]), default=len(nodes))
    # places of the mains, and of the outermost articles, that are in no marked element
    found: dict[str, list[tuple[int, int]]] = {"main": [], "article": []}
    behind, beyond = 0, 0
    for place, node in enumerate(nodes):
        if id(node) in marked:
            behind = max(behind, after[id(node)])
        elif node.tag in found and text[id(node)] and place >= behind and (node.tag == "main" or place >= beyond):
            found[node.tag].append((place, after[id(node)]))
            beyond = max(beyond, after[id(node)]) if node.tag == "article" else beyond
    for place, node in enumerate(nodes):
        mark = marked.get(id(node))
        if mark:
            large = 2 * text[id(node)] > text[id(root)]
            if large:
                apart = {tag: sum(b <= place or a >= after[id(node)] for a, b in spans) for tag, spans in found.items()}
                large = not apart["main"] and apart["article"] != 1
            subject = mark in SUBJECTS and id(node) in within and text[id(node)] > linked[id(node)]
            node.dropped = not (large or subject or id(node) in holds) or mark in REPLIES and mark not in SUBJECTS and ended <= place


def _reply_sections(root: Node) -> dict[int, str]:
    """Elements that begin with a heading of what readers add, as marked ones."""
    found = {}
    for node in _order(root):
        if node.tag in HEADINGS and node.parent is not None and node.parent.parent is not None and REPLY_HEADING.fullmatch(" ".join(blocks(node))):
            first = next((c for c in node.parent.children if c.__class__ is Node and not c.dropped or c.__class__ is str and c.strip()), None)
            if first is node and node.parent.tag not in MAIN:
                found[id(node.parent)] = "comments"
    return found


def parse(html: str) -> Node:
    """A DOM of elements and strings under one root; end tags are implied where HTML implies them. Linear in the page."""
    root = Node("html", None)
    marked: dict[int, str] = {}
    at, size, open_ = 0, len(html), Open(root)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            open_.node.children.append(html[at:])
            break
        if m.start() > at:
            open_.node.children.append(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                open_.node.children.append(m[1])
            continue
        tag, attributes = m[3].lower(), m[4] or ""
        if m[2]:
            found = open_.last(tag)
            # an inline end tag does not reach beyond the block it stands in
            if found is not None and found.parent is not None and (tag in BLOCK or found.depth > open_.node.block.depth):
                open_.leave(found)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_.node.block.tag == "p":
            open_.leave(open_.node.block)
        if tag in IMPLIED:
            ended, upto = IMPLIED[tag]
            inner = max((x.depth for t in upto if (x := open_.last(t)) is not None), default=0)
            found = open_.outermost(ended, inner)
            if found is not None:
                open_.leave(found)
        drops = _drops(tag, attributes, open_.last("article") is not None or open_.last("main") is not None)
        own = Node(tag, open_.node, drops is True)
        if drops and drops is not True:
            marked[id(own)] = drops
        open_.node.children.append(own)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(html, at)
            own.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        open_.enter(own)
    marked = _reply_sections(root) | marked
    if marked:
        _settle(root, marked)
    return root


def _order(root: Node) -> list[Node]:
    """Kept elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if c.__class__ is Node and not c.dropped]
    return out


def weigh(root: Node) -> list[Node]:
    """Set densities and density sums; the kept nodes, parents first."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for child in node.children:
            if child.__class__ is str:
                node.chars += len(" ".join(unescape(child).split()))
            elif not child.dropped:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    ratio = root.link_chars / max(1, root.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if not c:
            continue
        node.density = c / t
        if root.link_chars:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density *= max(0.0, math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))) / math.log(base)
    for node in nodes:
        node.total = sum(child.density for child in node.children if child.__class__ is Node and not child.dropped and child.tag in BLOCK)
    return nodes


def chosen(root: Node) -> list[Node]:
    """The subtrees that hold main text, in page order."""
    nodes = weigh(root)
    if not root.chars:
        return []
    top = max(nodes, key=lambda n: n.total)
    if not top.total:
        return [root]
    threshold, node = top.density, top
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    # the largest density sum at or below every node; the earlier node where sums are equal
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        here = node
        for child in node.children:
            if child.__class__ is Node and not child.dropped and best[id(child)].total > here.total:
                here = best[id(child)]
        best[id(node)] = here
    marked, inside = [], set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        own = best[id(node)]
        if node.density >= threshold and (own.total or own.parent is node.parent and node.tag in BLOCK) and id(own) not in inside:
            marked.append(own)
            inside.add(id(own))
    keep, covered, found = {id(n) for n in marked}, set(), []
    for node in nodes:
        if node.parent is not None and id(node.parent) in covered:
            covered.add(id(node))
        elif id(node) in keep:
            covered.add(id(node))
            found.append(node)
    return found


def blocks(node: Node) -> list[str]:
    """The text blocks of a subtree."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif item.__class__ is str:
            parts.append(unescape(item) if "&" in item else item)
        elif item.tag == "br":
            parts.append(" ")
        elif not item.dropped:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return out


def main_text(html: str) -> str:
    if not html:
        return ""
    return "\n".join(x for node in chosen(parse(html)) for x in blocks(node))


def with_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages without the HTML, with text and n_chars; a row for every row."""
    kept = [f for f in pages.schema if f.name not in (html_column, "text", "n_chars")]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(x) for x in texts_of(batch, html_column)]
            names = [f.name for f in kept]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[*names, "text", "n_chars"])

        return work

    return map_batches(pages.select(*(named(f.name) for f in kept), named(html_column)), with_fields(kept, "text string, n_chars long"), make)
