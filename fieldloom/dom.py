"""A document tree on the standard library's HTML tokenizer.

Two ways to build it. ``flat`` takes tags as they are written: nothing is closed by implication, an end
tag closes up to the nearest open element of its name. ``implied`` closes paragraphs, list items,
table parts and options where HTML says so, and wraps everything in html and body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "noscript"))
TOKEN_LISTS = frozenset(("class", "rel", "rev", "headers", "accesskey", "accept-charset", "archive", "dropzone"))
BLOCKS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an opening tag closes in the implied way, up to the boundary given.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}
HEAD_ONLY = frozenset("title meta link base style script".split())
_BLANKS = re.compile(r"\s+")


class Node:
    """An element, or with a tag of None a text (``data``), or with "#comment" a comment."""

    __slots__ = ("tag", "attrs", "children", "parent", "data", "order")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.order = 0

    @property
    def is_element(self) -> bool:
        return self.tag is not None and self.tag[0] != "#"

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.is_element)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def siblings(self) -> list[Node]:
        return [c for c in self.parent.children if c.is_element] if self.parent is not None else [self]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def strings(self) -> Iterator[str]:
        """Texts below, without those of scripts and styles and without comments."""
        for n in self.walk():
            if n.tag is None and (n.parent is None or n.parent.tag not in ("script", "style", "template")):
                yield n.data

    def string_value(self) -> str:
        return "".join(n.data for n in self.walk() if n.tag is None)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def unwrap(self) -> None:
        """Puts the children in the place of the node."""
        parent = self.parent
        at = parent.children.index(self)
        for c in self.children:
            c.parent = parent
        parent.children[at : at + 1] = self.children
        self.children, self.parent = [], None

    def to_html(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag is None:
                out.append(n.data if n.parent is not None and n.parent.tag in ("script", "style") else escape(n.data, quote=False))
            elif n.tag == "#comment":
                out.append(f"<!--{n.data}-->")
            elif n.tag == "#root":
                stack.extend(reversed(n.children))
            else:
                out.append("<" + n.tag + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ("/>" if n.tag in VOID else ">"))
                if n.tag not in VOID:
                    stack.append(f"</{n.tag}>")
                    stack.extend(reversed(n.children))
        return "".join(out)


def visible_text(node: Node, tail: bool = False) -> str:
    """The text of an element with a space for every tag, white space collapsed, scripts, styles and comments left out."""
    parts: list[str] = []
    stack: list[Node | None] = [node]
    while stack:
        n = stack.pop()
        if n is None:
            parts.append(" ")
        elif n.tag is None:
            parts.append(n.data)
        elif n.tag == "#comment" or n.tag in SILENT:
            parts.append(" ")
        else:
            parts.append(" ")
            stack.append(None)
            stack.extend(reversed(n.children))
    if tail and node.parent is not None:
        after = node.parent.children
        for n in after[after.index(node) + 1 :]:
            if n.tag is not None:
                break
            parts.append(n.data)
    return _BLANKS.sub(" ", "".join(parts)).strip()


class _Builder(HTMLParser):
    def __init__(self, implied: bool):
        super().__init__(convert_charrefs=True)
        self.implied = implied
        self.root = Node("#root")
        self.at = self.root
        if implied:
            self.html = self.at = self.root.add(Node("html"))
            self.head = self.body = None

    def _body(self) -> None:
        if self.body is None:
            self.body = self.html.add(Node("body"))
            self.at = self.body

    def _close(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        found, n = None, self.at
        while n is not self.root and n.tag not in limits:
            if n.tag in names:
                found = n
            n = n.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if self.implied:
            if tag in ("html", "body", "head"):
                if tag == "body":
                    self._body()
                node = {"html": self.html, "body": self.body}.get(tag)
                if tag == "head" and self.head is None and self.body is None:
                    node = self.head = self.at = self.html.add(Node("head"))
                if node is not None:
                    node.attrs = {**values, **node.attrs}
                return
            if self.body is None and not (tag in HEAD_ONLY and (self.head is not None or True)):
                self._body()
            elif self.body is None and self.head is None:
                self.head = self.at = self.html.add(Node("head"))
            if tag in BLOCKS:
                self._close(("p",), ("button", "table", "td", "th", "object"))
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        node = self.at.add(Node(tag, values))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.implied and tag in ("html", "body"):
            return
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        if self.implied and self.body is None and self.at.tag in ("html", "head"):
            if not data.strip():
                return
            self._body()
        if self.at.children and self.at.children[-1].tag is None:
            self.at.children[-1].data += data
        else:
            self.at.add(Node(None, data=data))

    def handle_comment(self, data):
        self.at.add(Node("#comment", data=data))


def parse(html: str, implied: bool = False) -> Node:
    """The tree of a page, its nodes numbered in document order."""
    builder = _Builder(implied)
    builder.feed(html or "")
    builder.close()
    for k, n in enumerate(builder.root.walk()):
        n.order = k
    return builder.root
