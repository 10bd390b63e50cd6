"""A small tree of lenient HTML, and the selectors that are matched against it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Which open elements a start tag ends, within which borders.
_ENDS = {
    **dict.fromkeys(BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}, ({"p"}, {"td", "th", "li", "div", "section", "article", "body", "blockquote", "dd", "table"})),
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
}


class Node:
    """An element; ``children`` are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.elements()))

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip:
                stack.extend(reversed(x.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def closest(self, tags: frozenset[str] | set[str]) -> Node | None:
        node = self.parent
        while node is not None and node.tag not in tags:
            node = node.parent
        return node

    def select(self, selector: str) -> Iterator[Node]:
        matchers = _parse(selector)
        return (n for n in self.walk() if n is not self and any(_matches(n, m) for m in matchers))

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)

    def html(self) -> str:
        from html import escape

        inner = "".join(c.html() if isinstance(c, Node) else (c if self.tag in RAW else escape(c, quote=False)) for c in self.children)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            ended, borders = _ENDS[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ended:
                    del self.open[k:]
                    break
                if self.open[k].tag in borders:
                    break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """The tree of a page or fragment; unclosed and stray tags are put up with."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:'(?P<v1>[^']*)'|\"(?P<v2>[^\"]*)\"|(?P<v3>[^\]\s]+)))?\s*(?:[iI]\s*)?\]")


@lru_cache(maxsize=1000)
def _parse(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives of (combinator, tests), the last compound first; selectors that can't be read match nothing."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        parts = re.findall(r"\s*([>\s])?\s*((?:\[[^\]]*\]|[^\s>\[])+)", alternative.strip())
        compound: list[tuple[str, list[tuple]]] = []
        for combinator, text in parts:
            tests, at = [], 0
            while at < len(text):
                m = _SIMPLE.match(text, at)
                if not m:
                    tests = [("never",)]
                    break
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower()))
                elif m["id"]:
                    tests.append(("id", m["id"]))
                elif m["cls"]:
                    tests.append(("class", m["cls"]))
                else:
                    value = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), None)
                    tests.append(("attr", m["attr"].lower(), m["op"], value))
                at = m.end()
            compound.append((">" if combinator == ">" else " ", tests))
        if compound:
            out.append(compound[::-1])
    return out


def _test(node: Node, tests: list[tuple]) -> bool:
    for kind, *args in tests:
        if kind == "tag" and args[0] not in ("*", node.tag):
            return False
        if kind == "id" and node.get("id") != args[0]:
            return False
        if kind == "class" and args[0] not in node.get("class").split():
            return False
        if kind == "never":
            return False
        if kind == "attr":
            name, op, value = args
            have = node.attrs.get(name)
            if have is None:
                return False
            ok = {None: True, "=": have == value, "^=": have.startswith(value or "\0"), "$=": have.endswith(value or "\0"), "*=": (value or "\0") in have, "~=": value in have.split(), "|=": have == value or have.startswith(f"{value}-")}[op]
            if not ok:
                return False
    return True


def _matches(node: Node, compound: list[tuple[str, list[tuple]]]) -> bool:
    if not _test(node, compound[0][1]):
        return False
    combinator, rest = compound[0][0], compound[1:]
    if not rest:
        return True
    above = node.parent
    while above is not None:
        if _matches(above, rest):
            return True
        if combinator == ">":
            return False
        above = above.parent
    return False




def clean(text: str) -> str:
    """White space runs to one space, none at the ends."""
    return re.sub(r"[\s﻿]+", " ", text).strip()
