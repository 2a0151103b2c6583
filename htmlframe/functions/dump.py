"""The canonical test dump of a tree: one line for each node, two blanks for each level."""

from __future__ import annotations

from htmlframe.functions.tree import COMMENT, ELEMENT, MATHML, SVG, TEXT, Document, Node

_PREFIX = {SVG: "svg ", MATHML: "math "}
_ATTRIBUTE = {"http://www.w3.org/1999/xlink": "xlink", "http://www.w3.org/XML/1998/namespace": "xml", "http://www.w3.org/2000/xmlns/": "xmlns"}


def dump(top: Node | list[Node]) -> str:
    out: list[str] = []
    if isinstance(top, Document) and top.doctype is not None:
        name, public, system = top.doctype
        ids = f' "{public or ""}" "{system or ""}"' if public or system else ""
        out.append(f"| <!DOCTYPE {name}{ids}>" if name else f"| <!DOCTYPE {ids}>".replace("  ", " "))
    stack = [(n, 0) for n in reversed(top if isinstance(top, list) else top.children)]
    while stack:
        node, depth = stack.pop()
        pad = "| " + "  " * depth
        if isinstance(node, str):
            out.append(pad + node)
        elif node.kind == TEXT:
            out.append(f'{pad}"{node.data}"')
        elif node.kind == COMMENT:
            out.append(f"{pad}<!-- {node.data} -->")
        elif node.kind == ELEMENT:
            out.append(f"{pad}<{_PREFIX.get(node.ns, '')}{node.name}>")
            shown = sorted((f"{_ATTRIBUTE[ns]} {n.split(':')[-1]}" if ns in _ATTRIBUTE else n, v) for ns, n, v in node.attrs)
            out.extend(f'{pad}  {n}="{v}"' for n, v in shown)
            stack.extend((c, depth + 1) for c in reversed(node.children))
            if node.content is not None:
                stack.extend((c, depth + 2) for c in reversed(node.content.children))
                stack.append(("content", depth + 1))
    return "\n".join(out)
