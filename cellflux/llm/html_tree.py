"""A small, forgiving HTML parser: a tree of elements with text in blocks.

Comments, declarations, scripts, styles and other raw elements give nothing.  Elements that HTML
closes by itself (p, li, table parts) are closed; end tags that match nothing are ignored; what is
open at the end is closed.  Nesting beyond ``DEEPEST`` keeps its text in the element at that depth.
"""

from __future__ import annotations

import html
import re

DEEPEST = 120
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_FIGURES = re.compile(r"[0-9]+|[./]")
_RAW = frozenset("script style noscript template textarea title svg math iframe object select option button canvas audio video noframes noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, looking up no further than the given barriers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Element:
    """An element with its key (tag and first cues, figures in them alike), children and, at block level,
    pieces of text; and its characters, those in links, and whether it holds an h1."""

    __slots__ = ("tag", "cues", "children", "parent", "depth", "chars", "linked", "titled")

    def __init__(self, tag: str, cues: tuple[str, ...], parent: "Element | None"):
        self.tag, self.cues, self.parent = tag, cues, parent
        self.children: list[Element | Text] = []
        self.depth = parent.depth + 1 if parent else 0
        self.chars, self.linked, self.titled = 0, 0, tag == "h1"

    @property
    def key(self) -> str:
        return self.tag + "".join("." + _FIGURES.sub("#", c) for c in self.cues[:2])


class Text:
    """A block's running text, and how much of it stands in links."""

    __slots__ = ("parts", "linked", "text")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""


def _cues(attributes: str) -> tuple[tuple[str, ...], bool]:
    if not attributes or ("=" not in attributes and "idden" not in attributes):
        return (), False
    cues, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = hidden or name == "hidden"
        elif name in ("class", "id", "role"):
            cues += value.lower().split()
    return tuple(cues), hidden


def parse(page: str) -> Element:
    root = now = Element("#root", (), None)
    block: Text | None = None
    links, at = 0, 0

    def add(piece: str) -> None:
        nonlocal block
        if block is None:
            if not piece or piece.isspace():
                return
            block = Text()
            now.children.append(block)
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    while True:
        m = _TAG.search(page, at)
        add(html.unescape(page[at : m.start()] if m else page[at:]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br":
                add(" ")
            elif tag not in _INLINE:
                block = None
                node = now
                while node.parent and node.tag != tag:
                    node = node.parent
                if node.parent:
                    now = node.parent
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in _RAW:
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math", "iframe", "object"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea", "title", "noscript", "template", "svg"):
                    at = len(page)
            add(" ")
            continue
        if tag == "a":
            links += not attributes.rstrip().endswith("/")
            continue
        if tag in _VOID:
            add(" ")
            if tag == "hr":
                block = None
            continue
        if tag in _INLINE:
            continue
        block = None
        links = 0
        if tag in _BLOCK:
            node = now
            while node.parent and node.tag != "p" and node.tag not in ("td", "th", "div", "section", "article", "main", "li", "body"):
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in _CLOSES:
            closed, barriers = _CLOSES[tag]
            node = now
            while node.parent and node.tag not in barriers and node.tag not in closed:
                node = node.parent
            if node.tag in closed:
                now = node.parent
                if tag == "tr" and node.tag in ("td", "th"):
                    up = now
                    while up.parent and up.tag not in ("tr", "table"):
                        up = up.parent
                    if up.tag == "tr":
                        now = up.parent
        cues, hidden = _cues(attributes)
        if now.depth < DEEPEST:
            child = Element("#hidden" if hidden else tag, cues, now)
            now.children.append(child)
            now = child
    return _finished(root)


def _finished(root: Element) -> Element:
    """Texts joined and trimmed; empty ones and elements without text are left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Element)]
    for node in reversed(order):
        kept: list[Element | Text] = []
        for child in node.children:
            if isinstance(child, Text):
                child.text = " ".join("".join(child.parts).split())
                child.parts = []
                if child.text:
                    kept.append(child)
                    node.chars, node.linked = node.chars + len(child.text), node.linked + min(child.linked, len(child.text))
            elif child.children:
                kept.append(child)
                node.chars, node.linked, node.titled = node.chars + child.chars, node.linked + child.linked, node.titled or child.titled
        node.children = kept
    return root
