"""The engine's functions for Spark SQL and the DataFrame API.

register() adds, as Arrow functions of a column: html_text, html_title, html_first, html_to_html, html_to_pretty,
html_to_markdown, html_to_cli_markdown, html_tree, html_unescape, html_decode, html_encoding and html_tokens_to_html; and as
table functions, for LATERAL: html_events, html_select, html_links and html_table_cells.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from htmlframe.functions import builder, charrefs, encodings, markdown, token_html
from htmlframe.functions import selectors as sel
from htmlframe.functions.tree import ELEMENT
from htmlframe.operators.parse import ParseOptions, event_rows, parse_page, render
from htmlframe.session import ship

_PLAIN = ParseOptions()


def _arrow(f: Callable, arguments: int = 1):
    """An Arrow function of string columns from a function of strings; null gives null."""
    if arguments == 1:

        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else f(x) for x in a.to_pylist()], pa.string())

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    else:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

        run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())


def _first(page: str, selector: str) -> str | None:
    found = sel.select(parse_page(page, _PLAIN), selector, first=True)
    return render(found[0], "html") if found else None


html_text = _arrow(lambda p: render(parse_page(p, _PLAIN), "text"))
html_title = _arrow(lambda p: parse_page(p, _PLAIN).title())
html_to_html = _arrow(lambda p: render(parse_page(p, _PLAIN), "html"))
html_to_pretty = _arrow(lambda p: render(parse_page(p, _PLAIN), "pretty2"))
html_to_markdown = _arrow(lambda p: render(parse_page(p, _PLAIN), "markdown"))
html_to_cli_markdown = _arrow(lambda p: render(parse_page(p, _PLAIN), "cli_markdown"))
html_tree = _arrow(lambda p: render(parse_page(p, _PLAIN), "tree"))
html_unescape = _arrow(charrefs.decode)
html_decode = _arrow(lambda b: encodings.decode(b)[0])
html_encoding = _arrow(lambda b: encodings.decode(b)[1])
html_tokens_to_html = _arrow(lambda t: token_html.serialize_tokens(json.loads(t)))
html_first = _arrow(_first, 2)

SCALARS = {n: globals()[n] for n in ("html_text", "html_title", "html_to_html", "html_to_pretty", "html_to_markdown", "html_to_cli_markdown", "html_tree", "html_unescape", "html_decode", "html_encoding", "html_tokens_to_html", "html_first")}


class _Events:
    def eval(self, html: str):
        for e in event_rows(html):
            yield (*e[:3], dict(e[3]) if e[3] is not None else None, *e[4:])


class _Select:
    def eval(self, html: str, selector: str):
        for i, n in enumerate(sel.select(builder.parse(html or ""), selector)):
            yield i, n.name, n.text(), render(n, "html")


class _Links:
    def eval(self, html: str):
        for i, n in enumerate(sel.select(builder.parse(html or ""), "a[href]")):
            yield i, n.get("href"), n.text()


class _Cells:
    def eval(self, html: str):
        for i, t in enumerate(n for n in builder.parse(html or "").walk() if n.kind == ELEMENT and n.name == "table"):
            header, rows = markdown.table_cells(t)
            for k, r in enumerate([header, *rows] if any(header) else rows):
                yield i, k, k == 0 and any(header), r


TABLES = {
    "html_events": (_Events, "pos int, type string, name string, attrs map<string,string>, data string, public_id string, system_id string"),
    "html_select": (_Select, "idx int, tag string, text string, html string"),
    "html_links": (_Links, "idx int, href string, text string"),
    "html_table_cells": (_Cells, "table_idx int, row_idx int, is_header boolean, cells array<string>"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to Spark SQL."""
    ship(spark)
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
