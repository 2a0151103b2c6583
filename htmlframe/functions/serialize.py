"""Trees as text: HTML, compact or pretty, plain text and JSON-ready structures."""

from __future__ import annotations

import re

from htmlframe.functions.tree import COMMENT, DOCUMENT, ELEMENT, TEXT, Document, Node

_w = lambda s: frozenset(s.split())
# Element names.
VOID = _w("area base br col embed hr img input link meta param source track wbr")
BLOCK = _w(
    "address article aside blockquote body canvas dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav noscript ol p pre section table tbody td tfoot th"
    " thead title tr ul video"
)
BLANKS = " \t\n\r\f"
_RUN = re.compile("[ \t\n\r\f]+")


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;")


def collapse(s: str) -> str:
    """White space runs as one blank, none at the ends."""
    return _RUN.sub(" ", s).strip(BLANKS)


def _collapse_inside(s: str) -> str:
    """White space runs as one blank, also at the ends; nothing if there is nothing else."""
    return _RUN.sub(" ", s) if s.strip(BLANKS) else ""


def doctype(name: str, public: str | None, system: str | None) -> str:
    if public:
        return f'<!DOCTYPE {name} PUBLIC "{public}"' + (f' "{system}">' if system else ">")
    return f'<!DOCTYPE {name} SYSTEM "{system}">' if system else f"<!DOCTYPE {name}>"


def to_html(top: Node, pretty: bool = False, indent: int = 2) -> str:
    """HTML of a node. A template's contents aren't written, and text is escaped everywhere."""
    out: list[str] = []
    if isinstance(top, Document) and top.doctype is not None:
        out.append(doctype(*top.doctype) + ("\n" if pretty else ""))
    # entries: a text to write, or (node, depth, inline)
    stack: list = [(c, 0, False) for c in reversed(top.children)] if top.kind == DOCUMENT else [(top, 0, False)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, depth, inline = item
        pad = " " * (depth * indent) if pretty and not inline else ""
        if node.kind == TEXT:
            if not pretty:
                out.append(escape_text(node.data))
            elif node.data.strip(BLANKS):
                out.append(escape_text(_collapse_inside(node.data)))
        elif node.kind == COMMENT:
            out.append(f"{pad}<!--{node.data}-->")
        elif node.kind == ELEMENT:
            out.append(f"{pad}<{node.name}" + "".join(f' {n}="{escape_attribute(v)}"' for _, n, v in node.attrs) + ">")
            if node.name in VOID:
                continue
            kids = [c for c in node.children if not pretty or c.kind != TEXT or c.data.strip(BLANKS)]
            blocks = pretty and any(c.kind == ELEMENT and c.name in BLOCK for c in kids)
            stack.append(f"</{node.name}>")
            if blocks:
                stack.append("\n" + " " * (depth * indent))
            for c in reversed(kids):
                stack.append((c, depth + 1, False) if blocks or not pretty else (c, depth, True))
                if blocks:
                    stack.append("\n")
    return "".join(out)


def to_text(top: Node, strip: bool = True) -> str:
    text = top.text()
    return collapse(text) if strip else text


def to_tree(top: Node) -> dict:
    """A nested structure for JSON."""

    def one(n: Node) -> dict:
        if n.kind == TEXT:
            return {"type": "text", "data": n.data}
        if n.kind == COMMENT:
            return {"type": "comment", "data": n.data}
        if n.kind == ELEMENT:
            return {"type": "element", "tagName": n.name, "namespace": n.ns, "attributes": {k: v for _, k, v in n.attrs}, "children": []}
        return {"type": "document", "children": []}

    whole = one(top)
    todo = [(top, whole)]
    while todo:
        node, made = todo.pop()
        for c in node.children:
            child = one(c)
            made["children"].append(child)
            if c.children:
                todo.append((c, child))
    if isinstance(top, Document) and top.doctype is not None:
        name, public, system = top.doctype
        whole["doctype"] = {"name": name, "publicId": public or "", "systemId": system or ""}
    return whole
