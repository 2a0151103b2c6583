"""Trees as Markdown, in the dialects "library" and "cli", and the cells of tables."""

from __future__ import annotations

from htmlframe.functions.serialize import collapse
from htmlframe.functions.tree import ELEMENT, TEXT, Node

HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
#: What Unicode and the ends of a Markdown text count as white space.
_ENDS = "\t\n\v\f\r \x85\xa0                　"


def to_markdown(top: Node, dialect: str = "library") -> str:
    """library: marks with blanks around them, tables as text; cli: marks without, tables with pipes."""
    if dialect not in ("library", "cli"):
        raise ValueError("dialect must be library or cli")
    expand = _library if dialect == "library" else _cli
    out: list[str] = []
    stack: list = [(top, 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, depth = item
        if node.kind == TEXT:
            out.append(collapse(node.data))
        elif node.kind == ELEMENT:
            stack.extend(reversed(expand(node, depth)))
        else:
            stack.extend((c, depth) for c in reversed(node.children) if c.kind in (ELEMENT, TEXT))
    return "".join(out).strip(_ENDS)


def _kids(node: Node, depth: int) -> list:
    return [(c, depth) for c in node.children if c.kind in (ELEMENT, TEXT)]


def _image(node: Node) -> str:
    return f"![{node.get('alt') or ''}]({node.get('src') or ''})"


def _items(node: Node, depth: int, number: bool) -> list:
    out: list = []
    for i, li in enumerate((c for c in node.children if c.kind == ELEMENT and c.name == "li"), 1):
        out += ["  " * depth + (f"{i}. " if number else "- "), *_kids(li, depth + 1), "\n"]
    return out


def _library(n: Node, depth: int) -> list:
    name, kids = n.name, _kids(n, depth)
    if name in HEADINGS:
        return [HEADINGS[name] + " ", *kids, "\n\n"]
    if name in MARKS:
        return [" " + MARKS[name], *kids, MARKS[name] + " "]
    if name == "p":
        return [*kids, "\n\n"]
    if name == "br":
        return ["  \n"]
    if name == "hr":
        return ["---\n\n"]
    if name == "code":
        return [" `", *kids, "` "]
    if name == "pre":
        return ["```\n", *kids, "\n```\n\n"]
    if name == "a":
        return [" [", *kids, f"]({n.get('href') or ''}) "]
    if name == "img":
        return [_image(n)]
    if name in ("ul", "ol"):
        return [*(kids if name == "ul" else _items(n, depth, True)), "\n" if depth == 0 else ""]
    if name == "li":
        return ["  " * depth + "- ", *_kids(n, depth + 1), "\n"]
    if name == "blockquote":
        return ["> ", *kids, "\n\n"]
    if name == "tr":
        return [*kids, "\n"]
    return [] if name in ("head", "title", "meta", "link", "script", "style") else kids


def _cli(n: Node, depth: int) -> list:
    name, kids = n.name, _kids(n, depth)
    flat = lambda: collapse(n.text())
    if name in HEADINGS:
        return [f"{HEADINGS[name]} {flat()}\n\n"]
    if name in MARKS:
        return [MARKS[name], *kids, MARKS[name]]
    if name == "p":
        return [*kids, "\n\n"]
    if name == "br":
        return ["  \n"]
    if name == "hr":
        return ["\n---\n\n"]
    if name == "code":
        return [f"`{flat()}`"]
    if name == "pre":
        return [f"```\n{flat()}\n```\n\n"]
    if name == "a":
        return [f"[{flat()}]({n.get('href') or ''})"]
    if name == "img":
        return [_image(n)]
    if name in ("ul", "ol"):
        return ["\n", *_items(n, depth, name == "ol"), "\n"]
    if name == "blockquote":
        lines = [x.strip(_ENDS) for x in n.text().split("\n")]
        return ["".join(f"> {x}\n" for x in lines if x) + "\n"]
    if name == "table":
        return [_pipes(n)]
    return [] if name in ("script", "style", "head") else kids


def _row(tr: Node, cell: str) -> list[str]:
    return [collapse(c.text()) for c in tr.children if c.kind == ELEMENT and c.name == cell]


def table_cells(table: Node) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a table, all of the same width. A foot isn't read."""
    header: list[str] = []
    rows: list[list[str]] = []
    for part in table.elements():
        lines = [c for c in part.elements() if c.name == "tr"]
        if part.name == "thead":
            header = (_row(lines[0], "th") or _row(lines[0], "td")) if lines else []
        elif part.name == "tbody":
            rows += [r for r in (_row(tr, "td") for tr in lines) if r]
        elif part.name == "tr":
            heads = _row(part, "th")
            if heads and not header:
                header = heads
            elif cells := _row(part, "td"):
                rows.append(cells)
    width = max([len(header), *map(len, rows)])
    fill = lambda r: r + [""] * (width - len(r))
    return (fill(header), [fill(r) for r in rows]) if header or rows else ([], [])


def _pipes(table: Node) -> str:
    header, rows = table_cells(table)
    if not header and not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |\n"
    return line(header) + "|" + " --- |" * len(header) + "\n" + "".join(map(line, rows)) + "\n"
