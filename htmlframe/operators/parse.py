"""One Arrow pass over a table of pages. Only the id and the html column are read, and filters on other columns belong
before the pass, since nothing is pushed through it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe import schemas as sc
from htmlframe.functions import builder, encodings, markdown, serialize
from htmlframe.functions import selectors as sel
from htmlframe.functions import tokens as tk
from htmlframe.functions.tree import DOCUMENT, ELEMENT, FRAGMENT, TEXT, Document, Node
from htmlframe.session import ship

#: Pages in an Arrow batch, its bytes, and rows in a batch of results. A page larger than that is a batch by itself.
ROWS_PER_BATCH, BYTES_PER_BATCH, ROWS_OUT = 256, 16 << 20, 20_000
#: Bytes of pages that a task parses, and bytes of pages whose nodes a task sorts: a row of nodes takes about six times its markup.
PARSED_BYTES, SORTED_BYTES = 32 << 20, 4 << 20


@dataclass(frozen=True)
class ParseOptions:
    """encoding: hint for bytes; srcdoc: text of an iframe; strict: raise on the first error of a page."""

    encoding: str | None = None
    srcdoc: bool = False
    xml_coercion: bool = False
    strict: bool = False


def spread(df: DataFrame, partitions: int = 0) -> DataFrame:
    """Deal a table out over as many partitions, where that is asked for; else it is read as its files are split, without a
    shuffle. Pages of few large row groups are better split by a smaller spark.sql.files.maxPartitionBytes or written anew."""
    return df.repartition(partitions) if partitions and not df.isStreaming and df.rdd.getNumPartitions() < partitions else df


def shares(pages: DataFrame, html_col: str = "html") -> tuple[int, int]:
    """In how many parts pages are parsed, and their nodes sorted, so that no task's part grows with the table: one scan of the
    lengths of the pages."""
    size, least = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0, pages.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-size // PARSED_BYTES)), max(least, -(-size // SORTED_BYTES))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, unless the session has smaller bounds already."""
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = _number(spark.conf.get(f"spark.sql.execution.arrow.{key}", None))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def _number(setting: str | None) -> int:
    digits = (setting or "").lower().removesuffix("b")
    return int(digits) if digits.isdigit() else 0


def parse_page(page: str | bytes | None, o: ParseOptions) -> Document:
    if isinstance(page, bytes):
        page = encodings.decode(page, o.encoding)[0]
    doc = builder.parse(page or "", o.srcdoc, o.xml_coercion)
    if o.strict and doc.errors:
        code, message, line, col = doc.errors[0]
        raise ValueError(f"{code} at {line}:{col}: {message}")
    return doc


def per_page(df: DataFrame, id_col: str, html_col: str, schema: pa.Schema, sql: str, rows: Callable[[int, str | bytes | None], list[tuple]]) -> DataFrame:
    """Apply a function from (id, page) to rows in one Arrow pass."""
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pages = batch.column(0).to_pylist(), batch.column(1)
            found: list[tuple] = []
            for key, page in zip(keys, pages, strict=True):
                found += rows(key, page.as_py())
                if len(found) >= ROWS_OUT:
                    yield _batch(found, schema)
                    found = []
            if found:
                yield _batch(found, schema)

    kind = "binary" if df.schema[html_col].dataType.typeName() == "binary" else "string"
    return df.select(F.col(id_col).cast("long"), F.col(html_col).cast(kind)).mapInArrow(run, sql)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


def _attrs(node: Node) -> list[dict]:
    return [{"ns": ns, "name": n, "value": v} for ns, n, v in node.attrs]


def _doctype(node: Node) -> str | None:
    return serialize.doctype(*node.doctype) if isinstance(node, Document) and node.doctype is not None else None


def node_rows(key: int, doc: Node) -> list[tuple]:
    """Rows of a tree in document order, the document first. last_id is the largest node_id below a node; data of a document
    is its document type as it is written."""
    out: list[list] = []
    stack: list = [(doc, None, 0, False, (None,) * 5)]
    while stack:
        item = stack.pop()
        if isinstance(item, int):
            out[item][3] = len(out) - 1
            continue
        node, parent, depth, inside, place = item
        me = len(out)
        element = node.kind == ELEMENT
        out.append([
            key, me, parent, me, depth, node.kind, node.name if element else None, node.ns if element else None, _attrs(node) if element else None, node.get("id") if element else None,
            node.classes if element else None, None if node.kind in (ELEMENT, FRAGMENT) else _doctype(node) if node.kind == DOCUMENT else node.data, inside, *place,
            (not any(c.kind == ELEMENT or c.kind == TEXT and c.data.strip() for c in node.children)) if element else None,
            (node.parent is not None and node.parent.kind in (DOCUMENT, FRAGMENT)) if element else None,
        ])
        stack.append(me)
        kids = node.elements()
        names = [k.name.lower() for k in kids]
        total: dict[str, int] = {}
        for n in names:
            total[n] = total.get(n, 0) + 1
        seen: dict[str, int] = {}
        entries, at = [], 0
        for c in node.children:
            if c.kind == ELEMENT:
                n = names[at]
                at += 1
                seen[n] = seen.get(n, 0) + 1
                entries.append([c, me, depth + 1, inside, [at, len(kids), seen[n], total[n], None]])
            else:
                entries.append([c, me, depth + 1, inside, (None,) * 5])
        stack.extend(reversed(entries))
        if node.content is not None:
            stack.append((node.content, me, depth + 1, True, (None,) * 5))
    # the element before, by the children's order
    last: dict[tuple[int, bool], int] = {}
    for r in out:
        if r[5] == ELEMENT:
            r[17] = last.get(r[2])
            last[r[2]] = r[1]
    return [tuple(r) for r in out]


def parse_nodes(df: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions(), keep_tags: list[str] | None = None) -> DataFrame:  # noqa: B008
    """The nodes of each page. keep_tags: elements to emit, others are parsed but left out."""
    keep = frozenset(keep_tags) if keep_tags else None

    def rows(key, page):
        found = node_rows(key, parse_page(page, options))
        return [r for r in found if r[6] in keep] if keep else found

    return per_page(df, id_col, html_col, sc.NODES, sc.NODES_SQL, rows)


def parse_docs(df: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:  # noqa: B008
    """One row for each page: document type, quirks mode, number of nodes, title and errors."""

    def rows(key, page):
        d = parse_page(page, options)
        kind = dict(zip(("name", "public_id", "system_id"), (d.doctype[0], d.doctype[1] or "", d.doctype[2] or ""), strict=True)) if d.doctype else None
        return [(key, kind, d.quirks, sum(1 for _ in d.walk(True)), d.title(), [dict(zip(("code", "message", "line", "col"), e, strict=True)) for e in d.errors])]

    return per_page(df, id_col, html_col, sc.DOCS, sc.DOCS_SQL, rows)


def parse_fragments(df: DataFrame, context: str = "div", namespace: str = "", id_col: str = "page_id", html_col: str = "html", output: str = "html") -> DataFrame:
    """The top-level elements of each text parsed inside an element: a row of matches for each."""

    def rows(key, page):
        found = builder.parse_fragment(page or "", context, namespace)
        return [(key, context, i, None, n.name, _attrs(n), n.text(), render(n, output)) for i, n in enumerate(found)]

    return per_page(df, id_col, html_col, sc.MATCHES, sc.MATCHES_SQL, rows)


def render(node: Node, output: str) -> str | None:
    """A node as html, pretty, text, strip, markdown, cli_markdown or tree; None for nothing."""
    if output == "html":
        return serialize.to_html(node)
    if output.startswith("pretty"):
        return serialize.to_html(node, True, int(output[6:] or 2))
    if output in ("text", "strip"):
        return serialize.to_text(node, output == "strip")
    if output in ("markdown", "cli_markdown"):
        return markdown.to_markdown(node, "cli" if output.startswith("cli") else "library")
    if output == "tree":
        return json.dumps(serialize.to_tree(node), ensure_ascii=False)
    if output:
        raise ValueError(f"unknown output: {output}")
    return None


def select_pages(df: DataFrame, selectors: str | list[str], output: str = "", first: bool = False, semantics: str = "compat", id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:  # noqa: B008
    """Matches of selectors, found while the pages are parsed: for queries asked once. One parse serves all selectors.

    Selectors are parsed here, on the driver, so a bad one raises SelectorError at once.
    """
    wanted = [(s, sel.parse(s)) for s in ([selectors] if isinstance(selectors, str) else selectors)]

    def rows(key, page):
        doc = parse_page(page, options)
        numbers = {id(n): i for i, n in enumerate(doc.walk(True))}
        out = []
        for text, chains in wanted:
            for i, n in enumerate(sel.Matcher(chains, semantics).select(doc, first)):
                out.append((key, text, i, numbers[id(n)], n.name, _attrs(n), n.text(), render(n, output)))
        return out

    return per_page(df, id_col, html_col, sc.MATCHES, sc.MATCHES_SQL, rows)


def select_records(df: DataFrame, selectors: str | list[str], id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:  # noqa: B008
    """One row for each page and selector: how many elements match, and of each its HTML, its text and its tree as JSON."""
    wanted = [(s, sel.parse(s)) for s in ([selectors] if isinstance(selectors, str) else selectors)]

    def rows(key, page):
        doc = parse_page(page, options)
        out = []
        for text, chains in wanted:
            found = sel.Matcher(chains).select(doc)
            out.append((key, text, len(found), [{"html": render(n, "html"), "text": render(n, "text"), "tree": render(n, "tree")} for n in found]))
        return out

    return per_page(df, id_col, html_col, sc.RECORDS, sc.RECORDS_SQL, rows)


def render_pages(df: DataFrame, output: str | list[str], id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:  # noqa: B008
    """(doc_id, output): each whole page as html, pretty, text, strip, markdown, cli_markdown or tree; with several of them, which
    one parse serves, (doc_id, kind, output)."""
    if isinstance(output, str):
        return per_page(df, id_col, html_col, pa.schema([("doc_id", pa.int64()), ("output", pa.string())]), "doc_id bigint, output string", lambda key, page: [(key, render(parse_page(page, options), output))])

    def rows(key, page):
        doc = parse_page(page, options)
        return [(key, o, render(doc, o)) for o in output]

    return per_page(df, id_col, html_col, pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("output", pa.string())]), "doc_id bigint, kind string, output string", rows)


def pages_tokens(df: DataFrame, id_col: str = "page_id", html_col: str = "html", xml_coercion: bool = False, mode: str = tk.DATA, last_start: str = "") -> DataFrame:
    """Raw tokens of each page, without tree construction. mode, last_start: how the tokenizer begins, such as "rcdata" after
    a start tag "title"."""

    def rows(key, page):
        found, _ = tk.tokenize(page or "", mode, last_start, xml_coercion=xml_coercion)
        return [(key, i, t.kind, t.name, t.data, [{"ns": "", "name": k, "value": v} for k, v in t.attrs], t.self_closing, t.public_id, t.system_id, t.force_quirks) for i, t in enumerate(found)]

    return per_page(df, id_col, html_col, sc.TOKENS, sc.TOKENS_SQL, rows)


def pages_token_errors(df: DataFrame, id_col: str = "page_id", html_col: str = "html", mode: str = tk.DATA, last_start: str = "") -> DataFrame:
    """(doc_id, errors): the errors of the tokenizer alone, for pages_tokens()."""

    def rows(key, page):
        return [(key, [dict(zip(("code", "message", "line", "col"), e, strict=True)) for e in tk.tokenize(page or "", mode, last_start)[1]])]

    return per_page(df, id_col, html_col, sc.ERRORS, sc.ERRORS_SQL, rows)


EVENT_TYPES = {tk.START: "StartTag", tk.END: "EndTag", tk.TEXT: "Text", tk.COMMENT: "Comment", tk.DOCTYPE: "Doctype"}


def event_rows(page: str | bytes | None, encoding: str | None = None) -> list[tuple]:
    if isinstance(page, bytes):
        page = encodings.decode(page, encoding)[0]
    found, _ = tk.tokenize(page or "")
    return [(i, EVENT_TYPES[t.kind], t.name, list(dict(t.attrs).items()) if t.kind == tk.START else None, t.data, t.public_id or "", t.system_id or "") for i, t in enumerate(found)]


def pages_events(df: DataFrame, id_col: str = "page_id", html_col: str = "html", encoding: str | None = None) -> DataFrame:
    """Events of each page in order. Works the same on a stream of pages."""
    return per_page(df, id_col, html_col, sc.EVENTS, sc.EVENTS_SQL, lambda key, page: [(key, *e) for e in event_rows(page, encoding)])


def pages_tables(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Cells of each table, row by row; the header, if there is one, comes first."""

    def rows(key, page):
        out = []
        for i, t in enumerate(n for n in builder.parse(page or "").walk() if n.kind == ELEMENT and n.name == "table"):
            header, body = markdown.table_cells(t)
            lines = [(True, header)] * bool(header and any(header)) + [(False, r) for r in body]
            out += [(key, i, k, head, cells) for k, (head, cells) in enumerate(lines)]
        return out

    return per_page(df, id_col, html_col, sc.TABLES, sc.TABLES_SQL, rows)


def edit_pages(df: DataFrame, selector: str, action: str, html: str = "", name: str = "", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, output): pages with the matches of a selector changed and written as HTML again.

    action: remove, replace, append, before (with html), set_attr (name, html as the value) or remove_attr (name).
    """
    chains = sel.parse(selector)
    if action not in ("remove", "replace", "append", "before", "set_attr", "remove_attr"):
        raise ValueError(f"unknown action: {action}")

    def rows(key, page):
        doc = builder.parse(page or "")
        for n in sel.Matcher(chains).select(doc):
            if action == "set_attr":
                n.set(name, html)
            elif action == "remove_attr":
                n.drop(name)
            elif action == "append":
                for c in builder.parse_fragment(html, n.name):
                    n.append(c)
            elif n.parent is not None:
                if action != "remove":
                    for c in builder.parse_fragment(html, n.parent.name or "div"):
                        n.parent.insert_before(c, n)
                if action != "before":
                    n.remove()
        return [(key, serialize.to_html(doc))]

    return per_page(df, id_col, html_col, pa.schema([("doc_id", pa.int64()), ("output", pa.string())]), "doc_id bigint, output string", rows)


def decode_pages(df: DataFrame, hint: str | None = None, id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """(doc_id, html, encoding) of pages in bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("encoding", pa.string())])
    return per_page(df, id_col, content_col, schema, "doc_id bigint, html string, encoding string", lambda key, page: [(key, *encodings.decode(bytes(page or b""), hint))])
