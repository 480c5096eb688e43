"""A small DOM for text extraction: block elements and the text blocks between them, with features."""

from __future__ import annotations

import html as _html
import math
import re

#: Elements that start a block, elements without content, elements whose content is never text.
BLOCK = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre form fieldset figure figcaption address details summary button select option dialog center menu hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg object canvas audio video head".split())
#: Which open elements a start tag ends.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Kinds of elements.
GROUPS = {
    "p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "ul": 2, "ol": 2, "dl": 2, "dt": 2, "dd": 2, "nav": 3, "menu": 3,
    "table": 4, "thead": 4, "tbody": 4, "tfoot": 4, "tr": 4, "td": 4, "th": 4, "caption": 4, "pre": 5, "blockquote": 5, "figure": 5, "figcaption": 5, "article": 6, "main": 6,
    "aside": 8, "footer": 9, "header": 10, "form": 11, "fieldset": 11, "button": 11, "select": 11, "option": 11, "dialog": 11, "search": 11,
}
N_GROUPS = 12
OTHER = 7
#: Kinds whose presence above a node is a feature.
ABOVE = (2, 3, 6, 8, 9, 10, 11)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTR = re.compile(r"""(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?]")
_HIDE = re.compile(r"display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "text", "tokens", "hidden", "chars", "links", "tags", "puncts", "inputs", "signs", "blocks", "depth", "label")

    def __init__(self, tag: str, parent: "Node | None", tokens: tuple = (), hidden: int = 0, label: int = 0) -> None:
        self.tag, self.parent, self.tokens, self.hidden, self.label = tag, parent, tokens, hidden, label
        self.children: list[Node] = []
        self.text = ""
        self.chars = self.links = self.tags = self.puncts = self.inputs = self.signs = self.blocks = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def _attributes(raw: str) -> tuple[tuple, int, int | None]:
    """The words of an element's class, id, role and label, whether it is hidden, and the label a training page carries."""
    if not raw or raw.isspace():
        return (), 0, None
    tokens: set[str] = set()
    hidden = 0
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style":
            hidden |= int(name == "hidden" or bool(_HIDE.search(value)))
        else:
            tokens.update(_TOKEN.findall(value.lower()))
    label = 1 if 'data-main="1"' in raw else 0 if 'data-off="1"' in raw else None
    return tuple(sorted(tokens)), hidden, label


def parse(text: str) -> Node:
    """The tree of a page. Broken markup never raises: stray end tags are ignored, open elements end
    with their parent, an element whose content is no text and that is not closed ends with the page."""
    root = node = Node("html", None)
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            words = " ".join(_html.unescape("".join(pieces)).split())
            if words:
                leaf = Node("#text", node, label=node.label)
                leaf.text, leaf.chars, leaf.blocks = words, len(words), 1
                leaf.links = min(leaf.chars, sum(map(len, linked)))
                leaf.puncts = len(_PUNCT.findall(words))
                leaf.signs = words.count("©")
            pieces, linked = [], []

    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            pieces.append(text[at:lt])
            if in_link:
                linked.append(text[at:lt])
        if lt == n:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(text, lt)
        if m is None:
            if text[lt + 1 : lt + 2] in ("!", "?", "/") or text[lt + 1 : lt + 2].isalpha():  # a declaration or a tag with a broken end
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                pieces.append("<")
                at = lt + 1
            continue
        at, close, tag = m.end(), m[1], m[2].lower()
        if tag in RAW:
            if not close and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                if tag in ("head", "noscript", "object") and end is None:
                    continue
                at = n if end is None else end.end()
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not close
        elif tag == "input":
            node.inputs += 1
        elif tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            in_link = False
            if tag in ("html", "body"):
                continue
            if close:
                up = node
                while up.parent and up.tag != tag:
                    up = up.parent
                if up.parent:
                    node = up.parent
                continue
            if node.tag == "p" or node.tag[0] == "h" and node.tag[1:].isdigit() and tag[0] == "h" and tag[1:].isdigit():
                node = node.parent
            ends = ENDS.get(tag)
            if ends:
                up = node
                while up.parent and up.tag not in ("ul", "ol", "menu", "dl", "table", "select") and up.tag not in ends:
                    up = up.parent
                while up.parent and up.tag in ends:
                    node = up = up.parent
            tokens, hidden, label = _attributes(m[3])
            node = Node(tag, node, tokens, hidden, node.label if label is None else label)
            node.inputs += tag in ("button", "select")
        elif tag not in VOID:
            pass  # inline: its text belongs to the block around it
    flush()
    return root


def features(root: Node, evidence: dict[str, float] | None = None) -> tuple[list[Node], list[list[float]]]:
    """All nodes below the root, parents first, and what the trees look at in each.

    ``evidence``: what training has learnt of attribute words; others say nothing.
    """
    evidence = evidence or {}
    nodes: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        nodes.append(x)
        stack.extend(reversed(x.children))
    for x in reversed(nodes):
        p = x.parent
        if p:
            p.chars += x.chars
            p.links += x.links
            p.puncts += x.puncts
            p.inputs += x.inputs
            p.signs += x.signs
            p.blocks += x.blocks
            p.tags += x.tags + (x.tag != "#text")
    blocks, chars = max(1, root.blocks), root.chars + 1
    above: dict[int, tuple] = {id(root): (0.0, 0.0, 0.0, *(0.0,) * len(ABOVE))}
    rows = []
    seen, total = 0, 0
    places = {id(c): i for x in nodes for i, c in enumerate(x.children)}
    zeros = [0.0] * N_GROUPS
    for x in nodes[1:]:
        p = x.parent
        low, high, hidden, *kinds = above[id(p)]
        group = GROUPS.get(x.tag if x.tag != "#text" else p.tag, OTHER)
        own = [evidence[t] for t in x.tokens if t in evidence] if x.tokens else ()
        mine_low, mine_high = (min(own), max(own)) if own else (0.0, 0.0)
        above[id(x)] = (min(low, mine_low), max(high, mine_high), max(hidden, x.hidden), *(1.0 if k == group and x.tag != "#text" else f for k, f in zip(ABOVE, kinds)))
        n, pi = len(p.children), places[id(x)]
        left = p.children[pi - 1] if pi else None
        right = p.children[pi + 1] if pi + 1 < n else None
        one_hot = zeros.copy()
        one_hot[group] = 1.0
        near = [y for y in (left, right) if y is not None]
        rows.append(
            [
                float(x.depth), math.log1p(x.chars), x.links / (x.chars + 1), 100.0 * x.tags / (x.chars + 100), x.puncts / (x.chars + 1), float(len(x.children)), float(n), pi / n, x.chars / (p.chars + 1),
                math.log1p((p.chars - x.chars) / max(1, n - 1)), (p.links - x.links) / (p.chars - x.chars + 1), math.log1p(x.chars / max(1, x.blocks)), float(x.blocks), x.chars / chars, seen / blocks, total / chars,
                float(min(x.inputs, 3)), float(min(p.inputs, 3)), float(min(x.signs, 2)), float(x.tag == "#text"), max([y.links / (y.chars + 1) for y in near], default=-1.0), math.log1p(max([y.chars for y in near], default=0)),
                math.log1p(p.chars / max(1, p.blocks)), p.links / (p.chars + 1), p.parent.links / (p.parent.chars + 1) if p.parent else 0.0, mine_low, mine_high, low, high, float(max(hidden, x.hidden)), *kinds, *one_hot,
            ]
        )
        if x.tag == "#text":
            seen += 1
            total += x.chars
    return nodes[1:], rows
