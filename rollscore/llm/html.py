"""Main text of web pages by composite text density.

A page becomes a tree of its block elements. A node's density is its characters per tag, adjusted by how
many of them stand in links. The node with the largest sum of its children's densities is the article; the
lowest density on its path from the body is the threshold for further parts elsewhere. Elements that name
themselves as menus, headers, footers, sidebars, notices, adverts, forms or comments count for nothing,
unless the main text is in them: a name alone never takes an article or most of the page's text away.
If the article lies in an article or main element, that whole element is taken: the threshold alone would
lose its short headings and paragraphs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from rollscore.llm.batches import slices

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup: it ends at their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html main menu nav ol p pre section summary table ul".split()
)
#: A start tag of the first kind ends an open element of the second, up to the element in the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset(("article", "main"))
DROPPED = frozenset(
    "script style textarea title iframe noembed noframes xmp noscript template head select svg math object canvas audio video".split()
)
#: May be boilerplate by their tag alone, or stand around a whole page, as where their end tag is missing.
CANDIDATES = frozenset("form nav header footer aside menu dialog button".split())
#: What can stand in a head; any other element, and any text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: Words that tell what an element is, where a whole class, id or role is made of them and of ``QUALIFIERS``.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal "
    "overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar complementary contentinfo footer header masthead toolbar comment "
    "comments disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager skip".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond replies".split())
QUALIFIERS = frozenset(
    "site page global primary secondary main top bottom left right upper lower inner outer list item items items area box container wrapper "
    "wrap widget block section slot unit bar links link text body content form buttons button icons icon media posts thread the "
    "message div module region mobile desktop sticky".split()
)
NEVER_DROPPED = frozenset(("html", "body", "article", "main"))

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s"'=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "mark", "link", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, mark: str = "", link: bool = False) -> None:
        #: What its tag or names say it may be: "" for nothing, "comment" or "other". ``link``: it is one.
        self.tag, self.parent, self.mark, self.link = tag, parent, mark, link
        self.children: list[Node] = []
        #: Text and child blocks in page order.
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def named(attributes: str) -> str:
    """What a class, id or role says an element may be: "" for nothing, "comment" or "other"."""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        for token in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in _WORD.findall(token)}
            names = words & DROPPED_NAMES
            if names and words <= names | QUALIFIERS:
                if names & COMMENT_NAMES:
                    return "comment"
                found = "other"
    return found


def _mark(tag: str, attributes: str, nested: bool) -> str:
    """Whether an element may be boilerplate. An article inside an article or main part is only if named as a comment."""
    name = named(attributes) if "=" in attributes and tag not in ("html", "body", "main") else ""
    if tag == "article":
        return name if nested and name == "comment" else ""
    return name or ("other" if tag in CANDIDATES else "")


def parse(page: str) -> Node:
    """The tree of block elements; inline elements belong to the block around them."""
    root = Node("html", None)
    # Open elements: (tag, block around or of it, whether it is a link, whether text in it is dropped).
    stack: list[tuple[str, Node, bool, bool]] = [("html", root, False, False)]
    at, size = 0, len(page)

    def add(text: str) -> None:
        _, block, link, dropped = stack[-1]
        if stack[-1][0] == "head" and not text.isspace():
            pop_to(len(stack) - 1)
            _, block, link, dropped = stack[-1]
        if dropped or not text:
            return
        text = unescape(text)
        block.parts.append(text)
        letters = len("".join(text.split()))
        block.chars += letters
        if link:
            block.link_chars += letters

    def pop_to(place: int) -> None:
        inline = len(stack) > place and all(tag in INLINE for tag, *_ in stack[place:])
        block = stack[place - 1][1]
        del stack[place:]
        if not inline:
            block.parts.append(" ")

    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        opened = _OPEN.match(page, start)
        if not opened:
            if page.startswith("</", start):  # a bogus comment
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        rest = _REST.match(page, opened.end())
        end = rest.end() if rest else page.find(">", opened.end()) + 1
        if not end:
            break
        tag, attributes = opened[2].lower(), page[opened.end():end - 1]
        at = end
        if opened[1]:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place][0] == tag:
                    pop_to(place)
                    break
                if tag in INLINE and stack[place][0] not in INLINE:
                    break
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in CLOSES_P or tag in CLOSES:
            closed, until = CLOSES.get(tag, ({"p"}, NEVER_DROPPED | {"td", "th", "li", "button", "table"}))
            place = found = len(stack)
            while place > 1 and stack[place - 1][0] not in until:
                place -= 1
                if stack[place][0] in closed:
                    found = place
            if found < len(stack):
                pop_to(found)
        if tag in ("html", "body"):
            continue
        _, block, link, dropped = stack[-1]
        dropped = dropped or tag in DROPPED
        mark = "" if dropped else _mark(tag, attributes, tag == "article" and _in_article(block))
        if not dropped and not (mark and tag in VOID):
            block.tags += 1
            block.link_tags += tag == "a"
        if tag in VOID:
            if tag in ("br", "hr"):
                block.parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            if not close:
                break
            end = page.find(">", close.end())
            at = size if end < 0 else end + 1
            continue
        if tag not in INLINE or mark:
            child = Node(tag, block, mark, tag == "a")
            if not dropped:
                block.children.append(child)
                block.parts.append(child)
            block = child
        stack.append((tag, block, link or tag == "a", dropped))
    _drop(root)
    return root


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in KEPT_WHOLE and node.mark != "comment":
        node = node.parent
    return node is not None


def _drop(root: Node) -> None:
    """Take the marked nodes out that do not hold the main text.

    One stays if the articles in it have more text than all articles outside marked nodes, or if it has more than
    half of the page's text and no unmarked article stands beside it. Comments go however long they are, if there
    is an unmarked article at all.
    """
    # Each node with how near it is to an article: 2 in one, 1 in a main part, else 0; and whether it is in a marked one.
    order, todo = [], [(root, 0, False)]
    while todo:
        node, level, marked = todo.pop()
        marked = marked or bool(node.mark)
        if node.mark != "comment" and node.tag in KEPT_WHOLE:
            level = max(level, 1 + (node.tag == "article"))
        order.append((node, level, marked))
        todo.extend((c, level, marked) for c in node.children)
    if not any(n.mark for n, *_ in order):
        return
    total = sum(n.chars for n, *_ in order)
    outside = [sum(n.chars for n, level, marked in order if not marked and level > least) for least in range(3)]
    held: dict[int, tuple[int, int]] = {}
    gone: set[int] = set()
    for node, level, _ in reversed(order):
        out = [c for c in node.children if id(c) in gone]
        if out:
            node.tags -= len(out)
            node.link_tags -= sum(c.link for c in out)
            node.children = [c for c in node.children if id(c) not in gone]
            node.parts = [p for p in node.parts if id(p) not in gone]
        chars = node.chars + sum(held[id(c)][0] for c in node.children)
        own = chars if node.tag in KEPT_WHOLE and node.mark != "comment" else sum(held[id(c)][1] for c in node.children)
        if node.mark and own <= outside[0]:
            beside = outside[0 if node.mark == "comment" else level]
            if beside or chars * 2 <= total:
                gone.add(id(node))
        held[id(node)] = chars, own


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums; the nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        for child in node.children:
            node.chars += child.chars
            node.tags += child.tags
            node.link_chars += child.link_chars
            node.link_tags += child.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.sum = sum(c.density for c in node.children) if node.children else node.density
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; counts of zero stand as one, ``share`` is the body's share of link characters."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / links * tags / link_tags
    # The logarithm to a base of nearly one grows without end, so the base is held above e.
    return chars / tags * math.log(max(ratio, 1.0) + 1) / math.log(max(base, math.e) + 1e-9)


def content(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order, none inside another."""
    order = measure(root)
    best = max(order, key=lambda n: n.sum)
    for node in order:  # of equal sums, the innermost
        if node.sum == best.sum:
            best = node
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    chosen = best
    for node in path:  # an article or main part around it is one piece, and so are headings beside it
        if node.tag in KEPT_WHOLE:
            chosen = node
            break
    else:
        while chosen.parent is not None and all(c is chosen or c.tag in HEADINGS for c in chosen.parent.children) and not any(
            isinstance(p, str) and p.strip() for p in chosen.parent.parts
        ):
            chosen = chosen.parent
    found, todo, around = [], [root], {id(n) for n in path}
    while todo:
        node = todo.pop()
        if node is chosen:
            found.append(node)
        elif id(node) in around:
            todo.extend(reversed(node.children))
        elif node.chars and node.density >= threshold and node.link_chars * 2 < node.chars and not _inside(node, chosen):
            found.append(node)
    return found


def _inside(node: Node, other: Node) -> bool:
    while node is not None and node is not other:
        node = node.parent
    return node is other


def text_of(node: Node) -> str:
    """The block's text: one space for white space and between blocks."""
    pieces, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            pieces.append(item)
        else:
            space = "" if item.tag in INLINE else " "
            todo.append(space)
            todo.extend(reversed(item.parts))
            todo.append(space)
    return " ".join("".join(pieces).split())


def extract(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(filter(None, map(text_of, content(parse(page)))))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [extract(page) for page in batch.column("html").to_pylist()]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html). One scan, no shuffle.

    A null or empty page, or one without main text, has an empty text. Repeated rows give repeated rows,
    null ids and urls stay null, other columns are left out, and an empty table gives an empty one.
    """
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(_extract, EXTRACTED)
