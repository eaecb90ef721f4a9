"""A small forgiving HTML reader for use inside tasks: a tree of tags, and the text blocks of a page."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

OPEN = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
# A start tag of the key ends open tags of the value, up to the nearest of SCOPE.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"},
}
P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split())
ENDED_BY = {tag: tuple(ENDS.get(tag, set()) | ({"p"} if tag in P_ENDERS else set())) for tag in {*ENDS, *P_ENDERS}}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
SCOPE = frozenset("html body table ul ol dl div section article aside main nav header footer form td th select".split())


class Node:
    """An element; ``items`` holds strings and nodes in document order."""

    __slots__ = ("attributes", "items", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.attributes = attributes
        self.items: list = []

    def get(self, *names: str) -> str:
        """The values of the attributes, in lower case, joined by spaces."""
        found = {}
        for name, value in ATTRIBUTE.findall(self.attributes):
            found.setdefault(name.lower(), unescape(value.strip("\"'")).lower())
        return " ".join(found[name] for name in names if name in found)

    def has(self, name: str) -> bool:
        return any(found.lower() == name for found, _ in ATTRIBUTE.findall(self.attributes))


class OpenElements:
    """The elements still open, with the places of each tag and of the scopes, so that no step walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        for node in self.stack[k:]:
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
        del self.stack[k:]

    def in_scope(self, tags) -> int:
        """The place of the innermost open element of these tags that no scope hides, else 0."""
        k = 0
        for tag in tags:
            if (found := self.places.get(tag)) and found[-1] > k:
                k = found[-1]
        return 0 if self.scopes and self.scopes[-1] > k else k

    def close(self, tag: str) -> None:
        if tag in INLINE:
            k = self.in_scope((tag,))
        else:
            k = self.places[tag][-1] if self.places.get(tag) else 0
        if k:
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """Close what a start tag of this name ends."""
        while k := self.in_scope(ENDED_BY[tag]):
            last = self.stack[k].tag
            self.cut(k)
            if last == "p" or tag != "tr":
                break


def parse(html: str) -> Node:
    """The tree of a page. Unclosed and misnested tags are closed as browsers do in the common cases.

    Time is linear in the text. A tag with a quote that never ends goes to the next ``>``, and quotes count no more after it.
    """
    root = Node("#root")
    open_ = OpenElements(root)
    at = said = 0  # where the next tag is looked for, and where the text before it begins
    size, last, pattern = len(html), html.rfind(">"), TAG
    while opened := OPEN.search(html, at):
        start, found = opened.start(), None
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            at = close + 3 if close >= 0 else size
        elif html[start + 1] in "!?":
            close = html.find(">", start)
            at = close + 1 if close >= 0 else size
        elif start > last:
            at = start + 1
            continue
        elif not (found := pattern.match(html, start)):
            pattern = LOOSE_TAG
            continue
        else:
            at = found.end()
        if start > said:
            open_.stack[-1].items.append(html[said:start])
        said = at
        if not found:
            continue
        tag = found[2].lower()
        if found[1]:
            open_.close(tag)
            continue
        if tag in ENDED_BY:
            open_.make_room(tag)
        node = Node(tag, found[3])
        open_.stack[-1].items.append(node)
        if tag in RAW:
            close = RAW_END[tag].search(html, at)
            node.items.append(html[at:close.start() if close else size])
            at = said = close.end() if close else size
        elif tag not in VOID and not found[3].endswith("/"):
            open_.push(node)
    if said < size:
        open_.stack[-1].items.append(html[said:])
    return root


def collapse(pieces: list[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


class Block:
    """A run of text without a block boundary: the element that holds it, its text, the text in links, its marks."""

    __slots__ = ("holder", "linked", "marks", "text")

    def __init__(self, holder: Node, text: str, linked: int, marks: int) -> None:
        self.holder, self.text, self.linked, self.marks = holder, text, linked, marks


def blocks(root: Node, skip=lambda node: False, mark=lambda node: 0) -> list[Block]:
    """The text blocks of the tree in document order, without inline elements for which ``skip`` holds.

    A block has the marks (bits) of all block-level elements around it.
    """
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    holder, marks = root, 0

    def flush() -> None:
        nonlocal linked
        if pieces and (text := collapse(pieces)):
            out.append(Block(holder, text, linked, marks))
        pieces.clear()
        linked = 0

    # An explicit stack: [node, block-level element, its marks, in a link, next item]
    work: list[list] = [[root, root, 0, False, 0]]
    while work:
        frame = work[-1]
        node, block, bits, link, k = frame
        if k == len(node.items):
            work.pop()
            if node.tag not in INLINE:
                flush()
            continue
        frame[4] += 1
        item = node.items[k]
        if isinstance(item, str):
            if not pieces:
                holder, marks = block, bits
            pieces.append(item)
            if link:
                linked += len(item)
        elif item.tag == "br":
            pieces.append(" ")
        elif item.tag in INLINE:
            if not skip(item):
                work.append([item, block, bits, link or item.tag == "a", 0])
        else:
            flush()
            if item.tag not in RAW:
                work.append([item, item, bits | mark(item), link, 0])
    flush()
    return out
