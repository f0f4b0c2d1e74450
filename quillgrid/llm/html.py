"""Main text of HTML pages by tree scoring.

Each page is parsed into a tree of elements with their text blocks. Paragraph-like blocks pass points for length and
commas to their ancestors, discounted by link density; the best container and its text-bearing siblings are kept, without
boilerplate below them. An article element around the best container bounds the text; within a main element, siblings are
judged on each level up to it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Up to what ends a tag or begins a value, and an unquoted value.
_STEP, _BARE = re.compile(r"[^>=]*+(=\s*+|>)"), re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed noframes annotation annotation-xml".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul option".split()
)
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: Elements beyond which CLOSES does not reach.
SCOPE = frozenset("ul ol dl table article section main body select".split())
DROPPED = frozenset("head nav footer aside button select dialog menu datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that boilerplate often has. A name of these words alone (`cookie-banner`) says more than one among others (`related-work`).
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner sidebar sidenav side widget "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices disclaimer newsletter subscribe "
    "subscription signup popup modal overlay lightbox share sharing social related recommended recommendations pagination pager login alert skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion discussions".split())
#: Words of names that say nothing about an element's purpose.
_BESIDE = frozenset("site page box block slot bar top bottom left right main content container wrapper wrap inner outer section area list item the js id".split())
NO, WEAK, STRONG = 0, 1, 2
#: Share of the page's points with which an element of such a name alone stays.
STRONG_SHARE = 0.6
#: Characters below which text under a name with a boilerplate word goes, and the share of links above which it goes.
SHORT, LINKED = 200, 0.3
#: What points of elements with such names count.
DISCOUNT = 0.5
_LIST = frozenset("ul ol dl table div section".split())
PARAGRAPH = 25


class Node:
    __slots__ = ("children", "drop", "hint", "inside", "link", "links", "parent", "points", "role", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.drop, self.hint, self.inside = False, NO, False
        self.size = self.link = self.links = 0
        self.score = self.points = 0.0
        self.role = False  # its role, or its tag and place, mark it as boilerplate


def _mark(node: Node, attrs: str) -> None:
    """Whether tag, role, class, id or style mark the element as boilerplate."""
    if node.tag in DROPPED:
        node.drop = True
    if not attrs.strip() or node.tag in ("html", "body"):
        return
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for token in value.split():
                words = {w for w in _WORDS.split(_CAMEL.sub("-", token).lower()) if w}
                if words & COMMENTS and words <= COMMENTS | HINTS | _BESIDE:
                    node.drop = node.drop or node.tag != "main"
                elif words & (HINTS | COMMENTS):
                    node.hint = max(node.hint, STRONG if words <= HINTS | _BESIDE and not words & COMMENTS else WEAK)
        elif name == "role" and value.lower() in ROLES:
            node.role = True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            node.drop = True


class _Open:
    """The open elements, found by tag without walking up the tree."""

    def __init__(self, root: Node) -> None:
        self.stack, self.by_tag, self.scopes = [root], {}, [0]

    @property
    def last(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.by_tag.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close the elements from a depth on; the root stays."""
        while len(self.stack) > max(1, depth):
            node = self.stack.pop()
            self.by_tag[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()

    def outermost(self, tags: set[str]) -> int | None:
        """Depth of the outermost of tags within the innermost scope."""
        found = []
        for t in tags:
            at = self.by_tag.get(t, ())
            k = bisect_right(at, self.scopes[-1])
            if k < len(at):
                found.append(at[k])
        return min(found, default=None)

    def innermost(self, tag: str) -> int | None:
        at = self.by_tag.get(tag)
        return at[-1] if at else None


_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
#: Elements that a block which begins inside them closes.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 option".split())


class _Tags:
    """Tags of a page. A closing quote that was once sought in vain is not sought again, so the work is linear in the page."""

    def __init__(self, page: str) -> None:
        self.page, self.none = page, set()

    def at(self, lt: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag at lt; > inside a quoted value ends no tag. Where a quote is not closed, the next > does."""
        m = _NAME.match(self.page, lt)
        if not m:
            return None
        pos = m.end()
        while step := _STEP.match(self.page, pos):
            pos = step.end()
            if step[1] == ">":
                return pos, m[1], m[2], self.page[m.end() : pos - 1]
            quote = self.page[pos : pos + 1]
            if quote in ('"', "'") and quote:
                end = -1 if quote in self.none else self.page.find(quote, pos + 1)
                if end < 0:
                    self.none.add(quote)
                    break
                pos = end + 1
            else:
                pos = _BARE.match(self.page, pos).end()
        m = _LOOSE.match(self.page, lt)
        return m and (m.end(), m[1], m[2], m[3])


def parse(page: str) -> Node:
    """The element tree; children are elements and (text, link characters) blocks in page order. Linear in the page's length."""
    root = Node("html", None)
    opened = _Open(root)
    parts: list[str] = []
    state = [0]  # raw characters of the open block that lie in links
    anchors, body = 0, False
    tags = _Tags(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                opened.last.children.append((text, min(len(text), state[0])))
            parts.clear()
        state[0] = 0

    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            parts.append(page[pos:lt])
            if anchors:
                state[0] += lt - pos
        if lt == n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            end, size = (page.find("-->", lt + 4), 3) if page.startswith("<!--", lt) else (page.find(">", lt), 1)
            pos = end + size if end >= 0 else n
            continue
        found = tags.at(lt)
        if not found:
            if nxt.isalpha() or nxt == "/":  # a tag that the end of the page cuts off
                break
            parts.append("<")
            pos = lt + 1
            continue
        pos, slash, tag, attrs = found
        tag = tag.lower()
        if slash:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCK and (depth := opened.innermost(tag)) is not None:
                flush()
                opened.cut(depth)
                anchors = 0
        elif tag in RAW:
            if not attrs.endswith("/"):
                end = _RAW_END[tag].search(page, pos)
                pos = end.end() if end else n
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag in BLOCK:
                flush()
        elif tag == "a":
            anchors += 1
            opened.last.links += 1
        elif tag in BLOCK:
            flush()
            if tag in CLOSES:
                depth = opened.outermost(CLOSES[tag])
                if depth is not None:
                    opened.cut(depth)
            elif tag != "option":
                while opened.last.tag in _PLAIN:
                    opened.cut(len(opened.stack) - 1)
            if tag == "html" or (tag == "body" and body):
                continue
            body = body or tag == "body"
            node = Node(tag, opened.last)
            _mark(node, attrs)
            opened.last.children.append(node)
            opened.push(node)
    flush()
    return root


def _order(root: Node) -> list[Node]:
    """Elements in page order, without recursion."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def _points(block: tuple[str, int]) -> float:
    """Points of a paragraph-like block: for length and commas, less its links."""
    text, link = block
    return (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - link / len(text)) if len(text) >= PARAGRAPH else 0.0


def _name_drops(root: Node, nodes: list[Node], key: set[int]) -> None:
    """Drops elements with boilerplate names: those whose text is short or mostly links, or holds too little of the page's points for their name."""
    for x in reversed(nodes):
        own = [c for c in x.children if not isinstance(c, Node)]
        below = [c for c in x.children if isinstance(c, Node) and not c.drop]
        x.points = sum(map(_points, own)) + sum(c.points for c in below)
        x.size = sum(len(c[0]) for c in own) + sum(c.size for c in below)
        x.link = sum(c[1] for c in own) + sum(c.link for c in below)
    whole = root.points
    for x in nodes:
        if x.hint and id(x) not in key:
            share = x.points / whole if whole else 0.0
            little = (x.size < SHORT and share < 0.5) or x.link > LINKED * x.size
            # where the page has an article or main element, what has such a name outside it is none of its text
            x.drop = x.drop or little or (x.hint == STRONG and share < STRONG_SHARE) or (bool(key) and not x.inside)
    for x in nodes:
        x.size = x.link = 0


def main_text(page: str | None) -> str:
    """The page's main text: blocks in page order joined by one newline; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _order(root)
    key: set[int] = set()  # elements that hold an article or main element which is no boilerplate
    for x in nodes:
        if x.tag in ("article", "main") and not x.drop:
            y = x
            while y is not None and id(y) not in key:
                key.add(id(y))
                y = y.parent
    for x in nodes:  # parents come first
        x.inside = x.tag in ("article", "main") or (x.parent is not None and x.parent.inside)
        if (x.role or x.tag == "form" or (x.tag == "header" and not x.inside)) and id(x) not in key:
            x.drop = True
    _name_drops(root, nodes, key)
    kept, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            kept.append(x)
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    for x in reversed(kept):
        for c in x.children:
            if isinstance(c, Node):
                if not c.drop:
                    x.size, x.link, x.links = x.size + c.size, x.link + c.link, x.links + c.links
            else:
                x.size, x.link = x.size + len(c[0]), x.link + c[1]
        if x.tag in _LIST and x.links >= 3 and x.size and x.link > 0.8 * x.size:  # a menu without a name
            x.drop = True
            x.size = x.link = x.links = 0
    for x in kept:
        points = sum(_points(c) for c in x.children if not isinstance(c, Node))
        if points:
            y, share = (x if x.tag not in ("p", "pre", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") else x.parent or x), 1.0
            level = 0
            while y is not None and share > 0.02:
                points *= DISCOUNT if y.hint else 1
                y.score += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
                y = y.parent
    live = [x for x in kept if x.score > 0]
    best = max(live, key=lambda x: x.score * (1 - x.link / max(1, x.size)), default=None)
    if best is None:
        return _render([root])
    whole, y = None, best
    while y is not None:
        whole = y if y.tag == "article" else whole
        y = y.parent
    if whole is not None:  # the page itself says what the article is
        return _render([whole])
    while best.parent is not None and best.parent.tag not in _TOP and best.parent.size == best.size:
        best = best.parent
    # from the best container up to the main element, or to the one container around it: what stands beside it and is no menu
    kept_here, at = [best], best
    while at.parent is not None and at.tag != "main" and (at is best or at.parent.inside):
        beside, top = [], at.parent.tag in _TOP
        for c in at.parent.children:
            if c is at:
                beside += kept_here
            elif _stays(c, best, top):
                beside.append(c)
        kept_here, at = beside, at.parent
    return _render(kept_here)


#: Elements whose children need not belong together.
_TOP = frozenset(("html", "body"))
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hgroup details".split())


def _stays(c: Node | tuple, best: Node, top: bool) -> bool:
    """Whether what stands beside the best container belongs to the text; directly below the body only what scores or is marked up as text."""
    if not isinstance(c, Node):
        return not top or (len(c[0]) > 80 and c[1] < 0.25 * len(c[0]))
    if c.drop or not c.size:
        return False
    return c.score >= max(2.0, 0.2 * best.score) or (c.link < 0.5 * c.size and (not top or c.tag in _TEXT))


def _render(tops: list) -> str:
    out, stack = [], list(reversed(tops))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if not x.drop:
                stack.extend(reversed(x.children))
        else:
            out.append(x[0])
    return "\n".join(out)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages, in one pass without a shuffle.

    Null or empty html gives empty text; repeated rows come back as often; further columns are not read; an empty table
    gives no rows. text is never null; n_chars counts its code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
