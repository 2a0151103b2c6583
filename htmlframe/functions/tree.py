"""The in-memory tree of one document."""

from __future__ import annotations

import re
from collections.abc import Iterator

ELEMENT, TEXT, COMMENT, DOCUMENT, FRAGMENT = 1, 3, 8, 9, 11
HTML, SVG, MATHML = "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML"
#: Unicode white space as class lists are split by it.
_FIELDS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class Node:
    """A node. attrs: list of (namespace, name, value), '' for no namespace; content: a template's own fragment."""

    __slots__ = ("kind", "name", "ns", "attrs", "data", "parent", "children", "content")

    def __init__(self, kind: int, name: str = "", ns: str = HTML, attrs: list | None = None, data: str = ""):
        self.kind, self.name, self.ns, self.data = kind, name, ns, data
        self.attrs = attrs if attrs is not None else []
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.content: Node | None = None

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def insert_before(self, child: Node, before: Node | None) -> None:
        child.parent = self
        at = next((i for i, c in enumerate(self.children) if c is before), len(self.children))
        self.children.insert(at, child)

    def remove(self) -> None:
        if self.parent is not None:
            at = next((i for i, c in enumerate(self.parent.children) if c is self), -1)
            if at >= 0:
                del self.parent.children[at]
            self.parent = None

    def get(self, name: str) -> str | None:
        """Value of an attribute without namespace; names match without regard to case."""
        low = name.lower()
        for ns, n, v in self.attrs:
            if not ns and (n == name or n.lower() == low):
                return v
        return None

    def set(self, name: str, value: str, ns: str = "") -> None:
        low = name.lower()
        for i, (s, n, _) in enumerate(self.attrs):
            if s == ns and n.lower() == low:
                self.attrs[i] = (s, n, value)
                return
        self.attrs.append((ns, name, value))

    def drop(self, name: str, ns: str = "") -> None:
        self.attrs = [a for a in self.attrs if a[0] != ns or a[1].lower() != name.lower()]

    @property
    def id(self) -> str:
        return self.get("id") or ""

    @property
    def classes(self) -> list[str]:
        return [c for c in _FIELDS.split(self.get("class") or "") if c]

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == ELEMENT]

    def walk(self, templates: bool = False) -> Iterator[Node]:
        """This node and all below it in document order; with templates, their contents before their children."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))
            if templates and node.content is not None:
                stack.append(node.content)

    def text(self) -> str:
        """The data of all text below, in document order."""
        return "".join(n.data for n in self.walk() if n.kind == TEXT)

    def clone(self, deep: bool = True) -> Node:
        def one(n: Node) -> Node:
            return Node(n.kind, n.name, n.ns, list(n.attrs), n.data)

        top = one(self)
        todo = [(self, top)] if deep else []
        while todo:
            old, new = todo.pop()
            for c in old.children:
                made = one(c)
                new.append(made)
                todo.append((c, made))
            if old.content is not None:
                new.content = one(old.content)
                todo.append((old.content, new.content))
        return top


class Document(Node):
    """A document node. doctype: (name, public id, system id) or None; quirks: 0 none, 1 quirks, 2 limited."""

    __slots__ = ("doctype", "quirks", "errors")

    def __init__(self) -> None:
        super().__init__(DOCUMENT)
        self.doctype: tuple[str, str | None, str | None] | None = None
        self.quirks = 0
        self.errors: list[tuple[str, str, int, int]] = []

    def root(self) -> Node | None:
        return next((c for c in self.children if c.kind == ELEMENT), None)

    def _section(self, name: str) -> Node | None:
        root = self.root()
        return next((c for c in root.children if c.kind == ELEMENT and c.name == name), None) if root else None

    def head(self) -> Node | None:
        return self._section("head")

    def body(self) -> Node | None:
        return self._section("body")

    def title(self) -> str:
        head = self.head()
        found = next((c for c in head.children if c.kind == ELEMENT and c.name == "title"), None) if head else None
        return found.text() if found else ""


def new_element(name: str, attrs=(), ns: str = HTML) -> Node:
    node = Node(ELEMENT, name, ns, [a if len(a) == 3 else ("", *a) for a in attrs])
    if name == "template" and ns == HTML:
        node.content = Node(FRAGMENT)
    return node
