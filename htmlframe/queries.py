"""The engine's queries for __spark_entry__.py, with SQL for DuckDB.

The oracles read the markup of `pages` by expressions, which is exact because the pages are regular. Operators that the
pages can't exercise run over short texts given here; their expected rows, worked out by hand from the rules, are the
oracle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe.errors import error_rows
from htmlframe.functions import dump as dmp
from htmlframe.functions import builder, sql, token_html
from htmlframe.functions import selectors as sel
from htmlframe.operators import dom, tour
from htmlframe.operators import parse as ps
from htmlframe.operators.decode import decode_bytes
from htmlframe.plans.selector_plan import mark_nodes, select_many, select_nodes
from htmlframe.sources.pages import joined_output, keep_nodes, read_table, stream_pages
from htmlframe.schemas import NODES
from htmlframe.session import shared_folder
from htmlframe.sources import files
from htmlframe.streaming.chunks import chunk_events
from htmlframe.streaming.events import run_to_table, stream_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DECODE = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"


def _decoded(x: str) -> str:
    return _DECODE.replace("{x}", x)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt out where their file comes in fewer splits than there are cores."""
    return ps.spread(read_table(spark, sf_dir), spark.sparkContext.defaultParallelism)


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are made into pages, dealt out as the pages are: its file is small for the work that its rows make."""
    return ps.spread(read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


def nodes(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """The nodes of the pages. With keep, these columns are written first: for plans that use nodes more than once."""
    found = ps.parse_nodes(pages(spark, sf_dir))
    return keep_nodes(found, keep) if keep else found


def parts(spark: SparkSession, sf_dir: str) -> int:
    """In how many parts plans deal out documents of the pages."""
    return ps.shares(read_table(spark, sf_dir))[1]


def dealt_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the pages dealt out by document, in as many parts as their size asks for: for plans that sort all nodes."""
    found = read_table(spark, sf_dir)
    parsed, sorted_ = ps.shares(found)
    return ps.parse_nodes(ps.spread(found, parsed)).repartition(sorted_, "doc_id")


#: What plans of selectors, texts and siblings need of nodes.
PLANNED = ["doc_id", "node_id", "parent_id", "last_id", "node_type", "tag", "attrs", "id", "classes", "data", "in_template", "el_idx", "el_cnt", "ty_idx", "ty_cnt", "prev_el", "is_empty", "is_root"]


def _quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(columns: list[str], types: list[str], rows: list[tuple]) -> str:
    """SQL that gives rows."""
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types, strict=True))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def texts(spark: SparkSession, rows: list[str]) -> DataFrame:
    """A table (page_id, html) of short texts, numbered from 0."""
    return spark.createDataFrame(list(enumerate(rows)), "page_id long, html string")


# -- selectors over the pages: one query for each operator


def _count_query(name: str, selector: str, oracle: str) -> None:
    """The number of matches on each page, by the plan over nodes."""

    def run(spark, sf_dir, selector=selector):
        return select_nodes(nodes(spark, sf_dir), selector, partitions=parts(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT page_id AS doc_id, CAST({oracle} AS BIGINT) AS n FROM pages WHERE {oracle} > 0"


_LI = "len(regexp_extract_all(html, '<li>'))"
_P = "len(regexp_extract_all(html, '<p>'))"
_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)"
# elements b are left open, so each later paragraph and the footer, if it has text, begins with up to three of them again
_PARTS = "string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')"
_OPENED = f"list_transform({_PARTS}, lambda x: CASE WHEN contains(x, '<b>') THEN 1 ELSE 0 END)"
_B = (
    f"coalesce(list_sum(list_transform(range(2, len({_PARTS}) + 1), lambda i: least(3, list_sum({_OPENED}[1:i - 1])) + {_OPENED}[i])), 0)"
    f" + CASE WHEN regexp_matches(html, '<footer>[^<]') THEN least(3, list_sum({_OPENED})) ELSE 0 END"
)
_TAGS = f"len(regexp_extract_all(regexp_replace(html, '<b>', '', 'g'), '<[a-z][a-z0-9]*[ >]')) + {_B}"
# the markup with a mark for each tag, comment and document type, and without what is in the script
_MARKED = "regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script>x</script>', 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g')"
for _name, _selector, _oracle in (
    ("sel_tag", "li", _LI),
    ("sel_universal", "*", _TAGS),
    ("sel_class", ".ad", "len(regexp_extract_all(html, 'class=\"ad\"'))"),
    ("sel_attr_exists", "a[href]", f"len({_HREFS})"),
    ("sel_attr_equals", "meta[charset=utf-8]", "len(regexp_extract_all(html, '<meta charset=\"utf-8\">'))"),
    ("sel_attr_word", "div[class~=ad]", "len(regexp_extract_all(html, '<div class=\"ad\">'))"),
    ("sel_attr_dash", 'html[lang|="en"]', "len(regexp_extract_all(html, '<html lang=\"en\"'))"),
    ("sel_attr_prefix", 'a[href^="/th"]', f"len(list_filter({_HREFS}, lambda x: starts_with(x, '/th')))"),
    ("sel_attr_suffix", 'a[href$="e"]', f"len(list_filter({_HREFS}, lambda x: ends_with(x, 'e')))"),
    ("sel_attr_contains", 'a[href*="er"]', f"len(list_filter({_HREFS}, lambda x: contains(x, 'er')))"),
    ("sel_first_child", "li:first-child", f"least({_LI}, 1)"),
    ("sel_last_child", "li:last-child", f"least({_LI}, 1)"),
    ("sel_only_child", "li > a:only-child", _LI),
    ("sel_nth_child", "li:nth-child(2n+1)", f"({_LI} + 1) // 2"),
    ("sel_nth_last_child", "li:nth-last-child(-n + 2)", f"least({_LI}, 2)"),
    ("sel_first_of_type", "article > p:first-of-type", f"least({_P}, 1)"),
    ("sel_last_of_type", "article > p:last-of-type", f"least({_P}, 1)"),
    ("sel_only_of_type", "h1:only-of-type", "len(regexp_extract_all(html, '<h1>'))"),
    ("sel_nth_of_type", "li:nth-of-type(even)", f"{_LI} // 2"),
    ("sel_nth_last_of_type", "li:nth-last-of-type(3)", f"CASE WHEN {_LI} >= 3 THEN 1 ELSE 0 END"),
    ("sel_empty", "meta:empty, br:empty", "len(regexp_extract_all(html, '<meta |<br>'))"),
    ("sel_root", ":root", "1"),
    ("sel_not", "li:not(:first-child)", f"greatest({_LI} - 1, 0)"),
    ("sel_not_complex", "li:not(ul>li), a:not(div>a)", f"len({_HREFS})"),
    ("sel_not_blank", "a:not(nav a)", f"len({_HREFS})"),  # blanks are lost inside :not(), so this excludes an element "nava"
    ("sel_unknown_pseudo", "li:hover, a:not(:hover)", f"len({_HREFS})"),
    ("sel_compound", "div.ad[class=ad]", "len(regexp_extract_all(html, '<div class=\"ad\">'))"),
    ("sel_descendant", "nav a", f"len({_HREFS})"),
    ("sel_child", "nav > ul > li > a", f"len({_HREFS})"),
    ("sel_adjacent", "li + li", f"greatest({_LI} - 1, 0)"),
    ("sel_sibling", "h1 ~ p", _P),
    ("sel_greedy_chain", "body > article p", _P),
    ("sel_list", "h1, footer, li", f"len(regexp_extract_all(html, '<h1>|<footer>')) + {_LI}"),
):
    _count_query(_name, _selector, _oracle)


@query("sel_id", "SELECT page_id AS doc_id, CAST(1 AS BIGINT) AS n FROM pages WHERE page_id % 3 = 1")
def sel_id(spark, sf_dir):
    """Articles that were given an id by their page's number."""
    marked = pages(spark, sf_dir).withColumn("html", F.expr("replace(html, '<article>', concat('<article id=a', page_id % 3, '>'))"))
    return select_nodes(ps.parse_nodes(marked), "#a1").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("sel_greedy_semantics", values(["semantics", "n"], ["VARCHAR", "BIGINT"], [("compat", 0), ("css", 1)]))
def sel_greedy_semantics(spark, sf_dir):
    """A chain whose nearest ancestor leads nowhere: no match in compat, one in css."""
    n = ps.parse_nodes(texts(spark, ["<x-a><y-b><y-b><z-c></z-c></y-b></y-b></x-a>"]))
    both = [select_nodes(n, "x-a > y-b z-c", s).agg(F.count("*").alias("n")).select(F.lit(s).alias("semantics"), "n") for s in ("compat", "css")]
    return both[0].union(both[1])


@query("sel_greedy_pages", f"SELECT page_id AS doc_id, 'compat' AS semantics, CAST({_P} AS BIGINT) AS n FROM pages WHERE {_P} > 0 UNION ALL SELECT page_id, 'css', CAST({_P} + {_LI} AS BIGINT) FROM pages WHERE {_P} + {_LI} > 0")
def sel_greedy_pages(spark, sf_dir):
    """A list whose items' nearest element above, their list, isn't a child of the body: it matches them in css only."""
    n, dealt = nodes(spark, sf_dir), parts(spark, sf_dir)
    both = [select_nodes(n, "body > * li, body > * p", s, partitions=dealt).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(s).alias("semantics"), "n") for s in ("compat", "css")]
    return both[0].union(both[1])


#: A hundred selectors with the number of their matches on a page.
MANY = [
    ("nav a", f"len({_HREFS})"), ("nav > ul > li > a", f"len({_HREFS})"), ("h1 ~ p", _P), ("body > article p", _P), ("li + li", f"greatest({_LI} - 1, 0)"), ("article > p:first-of-type", f"least({_P}, 1)"), ("li:not(:first-child)", f"greatest({_LI} - 1, 0)"),
    ("body li a", f"len({_HREFS})"), ("ul > li ~ li", f"greatest({_LI} - 1, 0)"), ("html > body > article > h1", "len(regexp_extract_all(html, '<h1>'))"),
    *[(f"ul > li:nth-child({k})", f"CASE WHEN {_LI} >= {k} THEN 1 ELSE 0 END") for k in range(1, 16)],
    *[(f"nav li:nth-child(n+{k}) > a", f"greatest({_LI} - {k - 1}, 0)") for k in range(1, 16)],
    *[(f"nav li:nth-last-child({k}) a", f"CASE WHEN {_LI} >= {k} THEN 1 ELSE 0 END") for k in range(1, 16)],
    *[(f"article p:nth-of-type(-n+{k})", f"least({_P}, {k})") for k in range(1, 16)],
    *[(f"h1 ~ p:nth-of-type({k})", f"CASE WHEN {_P} >= {k} THEN 1 ELSE 0 END") for k in range(1, 16)],
    *[(f"body > article > p:nth-of-type(n+{k})", f"greatest({_P} - {k - 1}, 0)") for k in range(1, 16)],
]


@query("sel_many", " UNION ALL ".join(f"SELECT page_id AS doc_id, {i} AS selector_idx, CAST({want} AS BIGINT) AS n FROM pages WHERE {want} > 0" for i, (_, want) in enumerate(MANY)))
def sel_many(spark, sf_dir):
    """A hundred selectors in one pass over the nodes."""
    return select_many(nodes(spark, sf_dir), [s for s, _ in MANY], partitions=parts(spark, sf_dir)).groupBy("doc_id", "selector_idx").agg(F.count("*").alias("n"))


@query("links", f"SELECT page_id AS doc_id, i - 1 AS idx, {_decoded('href')} AS href, {_decoded('text')} AS text FROM (SELECT page_id, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS i, unnest(h) AS href, unnest(t) AS text FROM (SELECT page_id, {_HREFS} AS h, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS t FROM pages))")
def links(spark, sf_dir):
    """All links in document order: the flagship query."""
    found = ps.select_pages(pages(spark, sf_dir), "a[href]")
    return found.select("doc_id", "idx", dom.attr("href").alias("href"), "text")


@query("query_first", f"SELECT page_id AS doc_id, {_decoded('h[1]')} AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages) WHERE len(h) > 0")
def query_first(spark, sf_dir):
    return ps.select_pages(pages(spark, sf_dir), "a", first=True).select("doc_id", dom.attr("href").alias("href"))


@query("query_first_plan", f"SELECT page_id AS doc_id, {_decoded('h[1]')} AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages) WHERE len(h) > 0")
def query_first_plan(spark, sf_dir):
    found = mark_nodes(dealt_nodes(spark, sf_dir), "a[href]").where("matched").select("doc_id", "node_id", dom.attr("href").alias("href"))
    return dom.first_of(found).select("doc_id", "href")


@query("el_count_by_tag", f"SELECT page_id AS doc_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) WHERE tag <> 'b' GROUP BY ALL UNION ALL SELECT page_id, 'b', CAST({_B} AS BIGINT) FROM pages WHERE {_B} > 0")
def el_count_by_tag(spark, sf_dir):
    return nodes(spark, sf_dir).where("node_type = 1").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("title_text", f"SELECT page_id AS doc_id, {_decoded(chr(120))} AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS x FROM pages)")
def title_text(spark, sf_dir):
    return ps.parse_docs(pages(spark, sf_dir)).select("doc_id", "title")


@query("title_plan", f"SELECT page_id AS doc_id, {_decoded(chr(120))} AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS x FROM pages)")
def title_plan(spark, sf_dir):
    return tour.titles(dealt_nodes(spark, sf_dir))


@query("doctype_quirks", "SELECT page_id AS doc_id, 'html' AS name, CAST(0 AS INTEGER) AS quirks_mode FROM pages")
def doctype_quirks(spark, sf_dir):
    return ps.parse_docs(pages(spark, sf_dir)).select("doc_id", F.col("doctype.name").alias("name"), "quirks_mode")


@query("comments", "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS data FROM pages")
def comments(spark, sf_dir):
    return nodes(spark, sf_dir).where("node_type = 8").select("doc_id", "data")


@query("nav_text", f"SELECT page_id AS doc_id, {_decoded(chr(120))} AS text FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<[^>]*>', '', 'g') AS x FROM pages)")
def nav_text(spark, sf_dir):
    return tour.text_of_marked(mark_nodes(dealt_nodes(spark, sf_dir), "nav")).select("doc_id", "text")


@query("script_text", "SELECT page_id AS doc_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS text FROM pages")
def script_text(spark, sf_dir):
    return ps.select_pages(pages(spark, sf_dir), "script").select("doc_id", "text")


@query("style_text", "SELECT page_id AS doc_id, regexp_extract(html, '(?s)<style>(.*?)</style>', 1) AS text FROM pages")
def style_text(spark, sf_dir):
    return ps.select_pages(pages(spark, sf_dir), "style").select("doc_id", "text")


@query("footer_stripped", f"SELECT page_id AS doc_id, trim(regexp_replace({_decoded(chr(120))}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS x FROM pages WHERE contains(html, '<footer>'))")
def footer_stripped(spark, sf_dir):
    return ps.select_pages(pages(spark, sf_dir), "footer", output="strip").select("doc_id", F.col("output").alias("text"))


@query("entity_decode", f"SELECT page_id AS doc_id, {_decoded(chr(120))} AS text FROM (SELECT page_id, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS x FROM pages)")
def entity_decode(spark, sf_dir):
    sql.register(spark)
    raw = pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "(?s)<footer>(.*?)</footer>", 1).alias("x"))
    return raw.select("doc_id", sql.html_unescape("x").alias("text"))


@query("outer_html_ad", "SELECT page_id AS doc_id, replace(replace(replace(regexp_extract(html, '(?s)<div class=\"ad\">.*?</div>', 0), '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)) AS output FROM pages WHERE contains(html, 'class=\"ad\"')")
def outer_html_ad(spark, sf_dir):
    """Adverts, written with the escapes that text needs and no others."""
    return ps.select_pages(pages(spark, sf_dir), "div.ad", output="html").select("doc_id", "output")


@query("md_h1", f"SELECT page_id AS doc_id, '# ' || trim(regexp_replace({_decoded(chr(120))}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS output FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS x FROM pages)")
def md_h1(spark, sf_dir):
    return ps.select_pages(pages(spark, sf_dir), "h1", output="cli_markdown").select("doc_id", "output")


@query("attribute_table", f"SELECT page_id AS doc_id, 'href' AS name, {_decoded('v')} AS value FROM (SELECT page_id, unnest({_HREFS}) AS v FROM pages)")
def attribute_table(spark, sf_dir):
    return dom.attribute_rows(nodes(spark, sf_dir)).where("name = 'href'").select("doc_id", "name", "value")


@query("sibling_windows", f"SELECT page_id AS doc_id, CAST(unnest(range(1, {_LI} + 1)) AS INTEGER) AS place, CAST({_LI} AS INTEGER) AS el_cnt FROM pages")
def sibling_windows(spark, sf_dir):
    n = nodes(spark, sf_dir, PLANNED)
    return dom.siblings(n).where("tag = 'li'").join(n.select("doc_id", "node_id", "el_cnt", "el_idx"), ["doc_id", "node_id"]).where("place = el_idx").select("doc_id", "place", "el_cnt")


@query("children_of_nav", "SELECT page_id AS doc_id, 'ul' AS tag FROM pages WHERE contains(html, '<nav><ul>')")
def children_of_nav(spark, sf_dir):
    n = nodes(spark, sf_dir, PLANNED)
    return dom.children(n, select_nodes(n, "nav")).where("node_type = 1").select("doc_id", "tag")


@query("body_section", "SELECT page_id AS doc_id, 'body' AS tag FROM pages")
def body_section(spark, sf_dir):
    return dom.section(nodes(spark, sf_dir, PLANNED), "body").select("doc_id", "tag")


@query("removed_nav", "SELECT page_id AS doc_id, CAST(0 AS BIGINT) AS n FROM pages")
def removed_nav(spark, sf_dir):
    left = tour.without_marked(mark_nodes(dealt_nodes(spark, sf_dir), "nav"))
    return left.groupBy("doc_id").agg(F.count_if(F.col("tag") == "li").alias("n"))


@query("encoding_detect", "SELECT page_id AS doc_id, 'UTF-8' AS encoding FROM pages")
def encoding_detect(spark, sf_dir):
    raw = pages(spark, sf_dir).select("page_id", F.encode("html", "utf-8").alias("content"))
    return decode_bytes(raw).select("doc_id", "encoding")


#: What each of five documents is encoded as; those with signs that Latin-1 lacks are in UTF-8 with a mark, too.
_KINDS = "CASE WHEN doc_id % 5 = 3 AND regexp_matches(coalesce(text, ''), '[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]') THEN 0 ELSE doc_id % 5 END"


@query("encodings_of_documents", f"SELECT doc_id, CASE k WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' WHEN 3 THEN 'windows-1252' ELSE 'UTF-8' END AS encoding, CASE k WHEN 4 THEN '<meta charset=utf-8>' ELSE '' END || coalesce(text, '') AS html FROM (SELECT doc_id, text, {_KINDS} AS k FROM documents)")
def encodings_of_documents(spark, sf_dir):
    """Documents as bytes in five ways, decoded again: with a mark of UTF-8 or UTF-16, in Latin-1 without any, and behind a meta
    element."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.col("doc_id") % 5
    kind = F.when((kind == 3) & F.col("text").rlike(r"[^\x{00}-\x{7F}\x{A0}-\x{FF}]"), 0).otherwise(kind)
    made = (
        F.when(kind == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
        .when(kind == 1, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE")))
        .when(kind == 2, F.concat(F.lit(b"\xfe\xff"), F.encode("text", "UTF-16BE")))
        .when(kind == 3, F.encode("text", "ISO-8859-1"))
        .otherwise(F.concat(F.lit(b"<meta charset=utf-8>"), F.encode("text", "UTF-8")))
    )
    return decode_bytes(docs.select(F.col("doc_id").alias("page_id"), made.alias("content")))


@query("pages_of_files", "SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 1 THEN 'utf-16le' ELSE 'UTF-8' END AS encoding, html FROM pages WHERE page_id % 7 < 4 OR page_id % 7 = 5")
def pages_of_files(spark, sf_dir):
    """Pages written as files, half of them in UTF-16, and read again through the data source; what filters on ids ask for is
    left out before a file is opened."""
    files.register(spark)
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    content = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit(b"\xff\xfe"), F.encode("html", "UTF-16LE"))).otherwise(F.encode("html", "UTF-8"))
    for part, rest in (("a", F.col("page_id") % 7 < 4), ("b", F.col("page_id") % 7 == 5)):
        read_table(spark, sf_dir).where(rest).select("page_id", content.alias("html")).write.format("htmlpages").mode("append").save(f"{folder}/{part}")
    return spark.read.format("htmlpages").load(folder).select("doc_id", "encoding", "html")


_EVENTS = (
    "SELECT page_id AS doc_id, 'StartTag' AS type, CAST(len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) AS BIGINT) AS n FROM pages UNION ALL SELECT page_id, 'EndTag', len(regexp_extract_all(html, '</[a-z][a-z0-9]*>')) - 1 FROM pages"
    " UNION ALL SELECT page_id, 'Comment', len(regexp_extract_all(html, '<!--')) FROM pages UNION ALL SELECT page_id, 'Doctype', 1 FROM pages"
    f" UNION ALL SELECT page_id, 'Text', len(regexp_extract_all({_MARKED}, '[^' || chr(1) || ']+')) FROM pages"
)


@query("events_by_type", _EVENTS)
def events_by_type(spark, sf_dir):
    return ps.pages_events(pages(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("events_of_bytes", _EVENTS)
def events_of_bytes(spark, sf_dir):
    """The events of pages that come as UTF-16 with a byte order mark."""
    raw = pages(spark, sf_dir).select("page_id", F.encode("html", "utf-16").alias("html"))
    return ps.pages_events(raw).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("events_udtf", f"SELECT page_id AS doc_id, {_decoded('v')} AS href FROM (SELECT page_id, unnest({_HREFS}) AS v FROM pages)")
def events_udtf(spark, sf_dir):
    """Links from the event stream, in SQL."""
    sql.register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("htmlframe_pages")
    return spark.sql("SELECT page_id AS doc_id, e.attrs['href'] AS href FROM htmlframe_pages, LATERAL html_events(html) e WHERE e.type = 'StartTag' AND e.name = 'a'")


@query("links_udtf", f"SELECT page_id AS doc_id, {_decoded('v')} AS href FROM (SELECT page_id, unnest({_HREFS}) AS v FROM pages)")
def links_udtf(spark, sf_dir):
    sql.register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("htmlframe_pages")
    return spark.sql("SELECT page_id AS doc_id, l.href FROM htmlframe_pages, LATERAL html_links(html) l")


@query("stream_events", "SELECT 'StartTag' AS type, CAST(sum(len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]'))) AS BIGINT) AS n FROM pages")
def stream_events_query(spark, sf_dir):
    """The event stream under Structured Streaming."""
    got = run_to_table(stream_events(stream_pages(spark, sf_dir)).where("type = 'StartTag'").select("type"))
    return got.groupBy("type").agg(F.count("*").alias("n"))


@query("stream_chunks", _EVENTS)
def stream_chunks(spark, sf_dir):
    """The events of pages that come in pieces of 1,000 bytes, in three batches of a stream, each written in as many files as
    tasks that parse pages."""
    size, folder = 1000, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    most = ps.shares(read_table(spark, sf_dir))[0]
    raw = pages(spark, sf_dir).select("page_id", F.encode("html", "UTF-8").alias("raw")).withColumn("n", F.greatest(F.ceil(F.octet_length("raw") / size), F.lit(1)).cast("int"))
    piece = lambda i: F.struct(i.alias("number"), F.substring(F.col("raw"), i * size + 1, F.lit(size)).alias("chunk"), (i == F.col("n") - 1).alias("last"))
    for batch in range(3):
        first, behind = (F.ceil(F.col("n") * k / 3).cast("int") for k in (batch, batch + 1))
        chunks = raw.where(first < behind).select("page_id", F.inline(F.transform(F.sequence(first, behind - 1), piece)))
        chunks.coalesce(most).write.parquet(f"{folder}/{batch}")
    files_of = max(len(spark.read.schema("page_id bigint").parquet(f"{folder}/{batch}").inputFiles()) for batch in range(3))
    stream = spark.readStream.schema("page_id bigint, number int, chunk binary, last boolean").option("maxFilesPerTrigger", max(files_of, 1)).parquet(f"{folder}/*")
    return run_to_table(chunk_events(stream)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("raw_tokens", "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) AS BIGINT) AS n FROM pages")
def raw_tokens(spark, sf_dir):
    return ps.pages_tokens(pages(spark, sf_dir)).where("kind = 'StartTag'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("match_output_joined", f"SELECT page_id AS doc_id, array_to_string(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: {_decoded('x')}), chr(10)) || chr(10) AS text FROM pages WHERE len({_HREFS}) > 0")
def match_output_joined(spark, sf_dir):
    return joined_output(ps.select_pages(pages(spark, sf_dir), "nav a", output="strip"))


@query("text_as_html", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def text_as_html(spark, sf_dir):
    """Documents, whose signs are none of HTML's, parsed as HTML keep their text."""
    docs = ps.spread(read_table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism)
    return ps.render_pages(docs, "text", "doc_id", "text").select("doc_id", F.col("output").alias("text"))


@query("fragments_of_turns", "SELECT conv_id * 100 + turn AS doc_id, CAST(0 AS INTEGER) AS idx, 'p' AS tag, regexp_replace(regexp_replace(coalesce(text, ''), '</?[a-zA-Z][^>]*>', '', 'g'), '&lt;', '<', 'g') AS text FROM conversations")
def fragments_of_turns(spark, sf_dir):
    turns = spread_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), F.concat(F.lit("<p>"), F.coalesce("text", F.lit(""))).alias("html"))
    return ps.parse_fragments(turns, "div").select("doc_id", "idx", "tag", "text")


@query("tables_of_rows", "SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row_idx, n_name || '|' || n_nationkey AS cells FROM nation UNION ALL SELECT DISTINCT n_regionkey, CAST(0 AS INTEGER), 'name|key' FROM nation")
def tables_of_rows(spark, sf_dir):
    """The nations written as an HTML table for each region and read again."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<tr><td> "), x["n_name"], F.lit("<td>"), x["n_nationkey"].cast("string"))), "")
    made = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.concat(F.lit("<table><thead><tr><th>name<th>key</tr></thead>"), cells, F.lit("</table>")).alias("html"))
    return ps.pages_tables(made).select("doc_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("markdown_of_rows", "SELECT p_partkey AS doc_id, '## ' || p_name || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type AS output FROM part")
def markdown_of_rows(spark, sf_dir):
    """The parts written as HTML and turned into Markdown."""
    html = F.concat(F.lit("<h2>"), "p_name", F.lit("</h2><ul><li>"), "p_brand", F.lit("<li>"), "p_type", F.lit("</ul>"))
    return ps.render_pages(spread_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("page_id"), html.alias("html")), "markdown")


@query("attributes_edited", "SELECT c_custkey AS doc_id, '<html><head></head><body><a href=\"/c/' || c_custkey || '\" class=\"x\">' || c_name || '</a></body></html>' AS output FROM customer")
def attributes_edited(spark, sf_dir):
    """A link for each customer, whose address is set and whose rel is taken away."""
    made = spread_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("page_id"), F.concat(F.lit("<a href=old class=x>"), "c_name", F.lit("</a>")).alias("html"))
    attributes = dom.attribute_text(dom.with_attr("href", F.concat(F.lit("/c/"), F.col("doc_id").cast("string"))))
    return ps.select_pages(made, "a").select("doc_id", F.concat(F.lit("<html><head></head><body><a"), attributes, F.lit(">"), "text", F.lit("</a></body></html>")).alias("output"))


@query("pages_written")
def pages_written(spark, sf_dir):
    """Every page as HTML again, in one form for each output. SQL can't say where elements left open end."""
    return ps.render_pages(pages(spark, sf_dir), ["html", "pretty2", "markdown", "cli_markdown", "strip", "tree"])


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every page without its menu and with a rule before each paragraph."""
    left = tour.edit_nodes(mark_nodes(dealt_nodes(spark, sf_dir), "nav"), "remove")
    return tour.edit_nodes(mark_nodes(left, "p"), "before", "<hr>")


@query("pages_edited")
def pages_edited(spark, sf_dir):
    """Every page without its menu and with a rule before each paragraph, as HTML."""
    return tour.nodes_to_html(_edited(spark, sf_dir))


#: Tags that may be missing where elements were left open, and the signs that HTML may write in two ways.
_LOOSE = "</?(b|p|body|html)>"
_SAME = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _skeleton(html: Column) -> Column:
    """HTML with signs instead of references, and without the tags that may be missing."""
    for reference, sign in _SAME:
        html = F.replace(html, F.lit(reference), F.lit(sign))
    return F.regexp_replace(html, _LOOSE, "")


def _skeleton_sql(html: str) -> str:
    return f"regexp_replace({_decoded(html)}, '{_LOOSE}', '', 'g')"


@query("html_of_nodes", f"SELECT page_id AS doc_id, {_skeleton_sql('html')} AS html FROM pages")
def html_of_nodes(spark, sf_dir):
    """Every page written from its nodes, compared without the tags that may be left open."""
    return tour.nodes_to_html(dealt_nodes(spark, sf_dir)).select("doc_id", _skeleton(F.col("output")).alias("html"))


@query("pretty_of_nodes", f"SELECT page_id AS doc_id, regexp_replace({_skeleton_sql('html')}, '[ \\t\\n\\r\\f]+', '', 'g') AS html, CAST({_P} + {_LI} AS BIGINT) AS n_lines FROM pages")
def pretty_of_nodes(spark, sf_dir):
    """Every page written with indents from its nodes: without blanks the page as it was, and a line for each paragraph and item."""
    o = F.col("output")
    lines = F.regexp_count(o, F.lit(r"(?m)^ +<(?:p|li)>"))
    return tour.nodes_to_pretty(dealt_nodes(spark, sf_dir)).select("doc_id", F.regexp_replace(_skeleton(o), r"[ \t\n\r\f]+", "").alias("html"), lines.cast("long").alias("n_lines"))


@query("html_of_edited_nodes", f"SELECT page_id AS doc_id, {_skeleton_sql(chr(120))} AS html FROM (SELECT page_id, replace(regexp_replace(html, '(?s)<nav>.*?</nav>', ''), '<p>', '<hr><p>') AS x FROM pages)")
def html_of_edited_nodes(spark, sf_dir):
    """Every page written after its nodes were edited."""
    return tour.nodes_to_html(_edited(spark, sf_dir)).select("doc_id", _skeleton(F.col("output")).alias("html"))


@query("edited_nodes", f"SELECT page_id AS doc_id, CAST({_P} AS BIGINT) AS n_rules, CAST({_P} AS BIGINT) AS n_rules_in_article, CAST({_P} AS BIGINT) AS n_rules_before_p, CAST(0 AS BIGINT) AS n_li, CAST({_P} AS BIGINT) AS n_matched FROM pages")
def edited_nodes(spark, sf_dir):
    """What selectors find in edited nodes, which are a table of nodes like any other."""
    found = select_many(_edited(spark, sf_dir), ["hr", "article > hr", "hr + p", "nav li", "article > p:nth-child(n+2)"]).groupBy("doc_id").agg(*[F.count_if(F.col("selector_idx") == i).alias(name) for i, name in enumerate(("n_rules", "n_rules_in_article", "n_rules_before_p", "n_li", "n_matched"))])
    return found


@query("replaced_nodes", f"SELECT page_id AS doc_id, CAST({_LI} AS BIGINT) AS n_items, CAST({_LI} AS BIGINT) AS n_marks, CAST(0 AS BIGINT) AS n_links, CAST(CASE WHEN {_LI} > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_last FROM pages WHERE {_LI} > 0")
def replaced_nodes(spark, sf_dir):
    """Links replaced by two elements each, and an element appended to each list."""
    made = tour.edit_nodes(mark_nodes(dealt_nodes(spark, sf_dir), "li > a"), "replace", "<i>to</i><em>there</em>")
    made = tour.edit_nodes(mark_nodes(made, "nav > ul"), "append", "<ol class=end>end</ol>")
    names = ("n_items", "n_marks", "n_links", "n_last")
    return select_many(made, ["li > i:first-child:nth-last-child(2)", "i + em", "nav a", "nav > ul > ol.end:last-child"]).groupBy("doc_id").agg(*[F.count_if(F.col("selector_idx") == i).alias(n) for i, n in enumerate(names)])


@query("json_of_nodes", f"SELECT page_id AS doc_id, CAST({_TAGS} AS BIGINT) AS n_elements, CAST({_LI} AS BIGINT) AS n_li, 'html' AS doctype, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def json_of_nodes(spark, sf_dir):
    """Every page as a tree in JSON, made from its nodes."""
    o = F.col("output")
    got = tour.nodes_to_json(dealt_nodes(spark, sf_dir))
    return got.select("doc_id", F.regexp_count(o, F.lit('"type": "element", "tagName"')).cast("long").alias("n_elements"), F.regexp_count(o, F.lit('"tagName": "li"')).cast("long").alias("n_li"), F.get_json_object(o, "$.doctype.name").alias("doctype"), F.get_json_object(o, "$.children[0].attributes.lang").alias("lang"))


@query("clones_of_lists", f"SELECT page_id AS doc_id, 'ul' AS top, CAST({_LI} AS BIGINT) AS n_li, CAST(len({_HREFS}) AS BIGINT) AS n_a, CAST(1 AS BIGINT) AS n_tops FROM pages WHERE contains(html, '<ul>')")
def clones_of_lists(spark, sf_dir):
    """The lists of menus copied as documents of their own."""
    n = nodes(spark, sf_dir, [f.name for f in NODES])
    c = tour.clones(n, select_nodes(n, "nav > ul"))
    return c.groupBy("doc_id").agg(F.max(F.when(F.col("node_id") == 0, F.col("tag"))).alias("top"), F.count_if(F.col("tag") == "li").alias("n_li"), F.count_if((F.col("tag") == "a") & (F.col("depth") == 2)).alias("n_a"), F.count_if(F.col("parent_id").isNull()).alias("n_tops"))


@query("elements_with_children", f"SELECT page_id AS doc_id, CAST({_LI} AS BIGINT) AS n_li_with, CAST(len(regexp_extract_all(html, '<br>')) AS BIGINT) AS n_br_without FROM pages")
def elements_with_children(spark, sf_dir):
    has = dom.has_children()
    return nodes(spark, sf_dir).groupBy("doc_id").agg(F.count_if((F.col("tag") == "li") & has).alias("n_li_with"), F.count_if((F.col("tag") == "br") & ~has).alias("n_br_without"))


@query("match_records", f"SELECT page_id AS doc_id, CAST(len({_HREFS}) AS INTEGER) AS n, {_LI} AS n_html, CASE WHEN len({_HREFS}) > 0 THEN 'a' END AS tag FROM pages")
def match_records(spark, sf_dir):
    """Matches as HTML, text and tree, with their number."""
    got = ps.select_records(pages(spark, sf_dir), "li > a")
    return got.select("doc_id", "n", F.size(F.filter("matches", lambda m: F.startswith(m["html"], F.lit("<a href=")) & F.contains(m["html"], F.lit("</a>")))).cast("long").alias("n_html"), F.get_json_object(F.get("matches", F.lit(0))["tree"], "$.tagName").alias("tag"))


# -- operators that the pages can't exercise


def _fixed(name: str, columns: str, types: list[str], cases: list[tuple[str, str]], make: Callable[[DataFrame], DataFrame]) -> None:
    """A query over texts whose results are given."""
    QUERIES[name] = lambda spark, sf_dir: make(texts(spark, [c for c, _ in cases]))
    ORACLES[name] = values(["doc_id", columns], ["BIGINT", *types], [(i, want) for i, (_, want) in enumerate(cases)])


def _dumps(df: DataFrame) -> DataFrame:
    import pyarrow as pa

    return ps.per_page(df, "page_id", "html", pa.schema([("doc_id", pa.int64()), ("tree", pa.string())]), "doc_id bigint, tree string", lambda key, page: [(key, dmp.dump(builder.parse(page)))])


def _page(body: str) -> str:
    return "| <html>\n|   <head>\n|   <body>" + "".join(f"\n|     {x}" for x in body.split("\n") if x)


TREES = [
    ("<table><tr><td>1<td>2</table>x", _page('<table>\n  <tbody>\n    <tr>\n      <td>\n        "1"\n      <td>\n        "2"\n"x"')),
    ("<table>a<tr>b<td>c</table>", _page('"ab"\n<table>\n  <tbody>\n    <tr>\n      <td>\n        "c"')),
    ("<b>1<p>2</b>3</p>", _page('<b>\n  "1"\n<p>\n  <b>\n    "2"\n  "3"')),
    ("<a>1<a>2", _page('<a>\n  "1"\n<a>\n  "2"')),
    ("<ul><li>1<li>2</ul>", _page('<ul>\n  <li>\n    "1"\n  <li>\n    "2"')),
    ("<svg viewbox=1><foreignobject><p>x</svg>", _page('<svg svg>\n  viewBox="1"\n  <svg foreignObject>\n    <p>\n      "x"')),
    ("<math><mi>x<mo>y</math>z", _page('<math math>\n  <math mi>\n    "x"\n    <mo>\n      "y"\n"z"')),
    ("<svg><![CDATA[a<b]]></svg>", _page('<svg svg>\n  "a<b"')),
    ("<select><option>1<option>2<div>3</select>", _page('<select>\n  <option>\n    "1"\n  <option>\n    "2"\n    <div>\n      "3"')),
    ("<p>1</p></p>", _page('<p>\n  "1"\n<p>')),
    ("<template><tr><td>x</template>y", "| <html>\n|   <head>\n|     <template>\n|       content\n|         <tr>\n|           <td>\n|             \"x\"\n|   <body>\n|     \"y\""),
    ("<textarea>\n<b>&amp;</textarea>", _page('<textarea>\n  "<b>&"')),
    ("<dl><dt>1<dd>2<dt>3</dl>", _page('<dl>\n  <dt>\n    "1"\n  <dd>\n    "2"\n  <dt>\n    "3"')),
    ("a<!-- b -- c -->d", _page('"a"\n<!--  b -- c  -->\n"d"')),
    ("<frameset><frame></frameset>", "| <html>\n|   <head>\n|   <frameset>\n|     <frame>"),
    ("<body a=1><body a=2 b=3>x", '| <html>\n|   <head>\n|   <body>\n|     a="1"\n|     b="3"\n|     "x"'),
    ("<h1>1<h2>2", _page('<h1>\n  "1"\n<h2>\n  "2"')),
    ("<ruby>a<rt>b<rp>c", _page('<ruby>\n  "a"\n  <rt>\n    "b"\n  <rp>\n    "c"')),
    ("<image src=x>", _page('<img>\n  src="x"')),
    ("<script><!--<script></script>a</script>b", "| <html>\n|   <head>\n|     <script>\n|       \"<!--<script></script>a\"\n|   <body>\n|     \"b\""),
    ("<head><noscript><link></noscript><title>t</title></head>x", '| <html>\n|   <head>\n|     <noscript>\n|       <link>\n|     <title>\n|       "t"\n|   <body>\n|     "x"'),
    ("<p>a\0b", _page('<p>\n  "ab"')),
    ("<select><button><selectedcontent></selectedcontent></button><option>1<option selected>2</select>", _page('<select>\n  <button>\n    <selectedcontent>\n      "2"\n  <option>\n    "1"\n  <option>\n    selected=""\n    "2"')),
    ("x</body><!--c-->", '| <html>\n|   <head>\n|   <body>\n|     "x"\n|   <!-- c -->'),
]
_fixed("tree_construction", "tree", ["VARCHAR"], TREES, _dumps)

MARKDOWN = [
    ("<h2>A <b>b</b></h2><p>x <i>y</i> <a href=/u>z</a>", "## A b\n\nx*y*[z](/u)"),
    ("<ul><li>1<li>2</ul><ol><li>a<li>b</ol>", "- 1\n- 2\n\n\n1. a\n2. b"),
    ("<table><thead><tr><th>A<th>B</thead><tbody><tr><td>1</table>", "| A | B |\n| --- | --- |\n| 1 |  |"),
    ("<blockquote>x\n y</blockquote><hr><pre>a  b</pre>", "> x\n> y\n\n\n---\n\n```\na b\n```"),
]
_fixed("markdown_cli", "output", ["VARCHAR"], MARKDOWN, lambda df: ps.render_pages(df, "cli_markdown"))
_fixed("markdown_library", "output", ["VARCHAR"], [("<h1>T</h1><p>x <b>y</b> z</p>", "# T\n\nx **y** z"), ("<p>a<br>b</p><ul><li>1</ul>", "a  \nb\n\n- 1"), ("<a href=u>t</a><img alt=a src=s>", "[t](u) ![a](s)")], lambda df: ps.render_pages(df, "markdown"))
_fixed("html_compact", "output", ["VARCHAR"], [("<!doctype html><p class='a\"b'>x & y<br>", '<!DOCTYPE html><html><head></head><body><p class="a&quot;b">x &amp; y<br></p></body></html>'), ("<script>1<2</script>", "<html><head><script>1&lt;2</script></head><body></body></html>")], lambda df: ps.render_pages(df, "html"))
_fixed("html_pretty", "output", ["VARCHAR"], [("<div><p>a  <b>b</b></p> <p>c</p></div>", "<html>\n  <head></head>\n  <body>\n    <div>\n      <p>a <b>b</b></p>\n      <p>c</p>\n    </div>\n  </body>\n</html>")], lambda df: ps.render_pages(df, "pretty2"))
_fixed("json_tree", "output", ["VARCHAR"], [("<p a=1>x", json.dumps({"type": "document", "children": [{"type": "element", "tagName": "html", "namespace": "http://www.w3.org/1999/xhtml", "attributes": {}, "children": [{"type": "element", "tagName": "head", "namespace": "http://www.w3.org/1999/xhtml", "attributes": {}, "children": []}, {"type": "element", "tagName": "body", "namespace": "http://www.w3.org/1999/xhtml", "attributes": {}, "children": [{"type": "element", "tagName": "p", "namespace": "http://www.w3.org/1999/xhtml", "attributes": {"a": "1"}, "children": [{"type": "text", "data": "x"}]}]}]}]}))], lambda df: ps.render_pages(df, "tree"))
_fixed("edit_remove", "output", ["VARCHAR"], [("<p>a<b>x</b>c", "<html><head></head><body><p>ac</p></body></html>")], lambda df: ps.edit_pages(df, "b", "remove"))
_fixed("edit_replace", "output", ["VARCHAR"], [("<p>a<b>x</b>c", "<html><head></head><body><p>a<i>y</i>c</p></body></html>")], lambda df: ps.edit_pages(df, "b", "replace", "<i>y</i>"))
_fixed("edit_append", "output", ["VARCHAR"], [("<ul><li>1</ul>", "<html><head></head><body><ul><li>1</li><li>2</li></ul></body></html>")], lambda df: ps.edit_pages(df, "ul", "append", "<li>2</li>"))
_fixed("edit_attribute", "output", ["VARCHAR"], [("<a href=1>x", '<html><head></head><body><a href="2">x</a></body></html>')], lambda df: ps.edit_pages(df, "a", "set_attr", "2", "href"))
_fixed("xml_coercion", "tree", ["VARCHAR"], [("<!--a--b-->", "<!--a- -b--><html><head></head><body></body></html>"), ("<p>x\fy", "<html><head></head><body><p>x y</p></body></html>")], lambda df: ps.render_pages(df, "html", options=ps.ParseOptions(xml_coercion=True)).withColumnRenamed("output", "tree"))
_fixed("quirks_modes", "quirks_mode", ["INTEGER"], [("<p>", 1), ("<!DOCTYPE html>", 0), ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "x">', 2), ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">', 1), ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN" "x">', 2), ("<!DOCTYPE html  PUBLIC>", 1)], lambda df: ps.parse_docs(df).select("doc_id", "quirks_mode"))
_fixed("char_references", "output", ["VARCHAR"], [("&amp;&lt;&copy;&#x41;&#66;&notit;&unknown;&#128;", "&<©AB¬it;&unknown;€"), ("<a title='&amp=1&lt;&copy'>t", "t")], lambda df: ps.render_pages(df, "text"))


#: Texts with one error each, and where it is: at the character that shows it, or at the last one if the text ends.
FLAWS = [
    ('<a b="1" b="2">', "duplicate-attribute", 1, 15),
    ("<a b b>", "duplicate-attribute", 1, 7),
    ("<a b=1 b=2>", "duplicate-attribute", 1, 11),
    ("x\n<!--", "eof-in-comment", 2, 4),
    ("<a b=>", "missing-attribute-value", 1, 6),
    ('<a b="1"c>', "missing-whitespace-between-attributes", 1, 9),
    ("</>", "empty-end-tag", 1, 3),
    ("<?x>", "unexpected-question-mark-instead-of-tag-name", 1, 2),
    ("<!x>", "incorrectly-opened-comment", 1, 2),
    ("<![CDATA[x]]>", "cdata-in-html-content", 1, 9),
    ("<a/b>", "unexpected-character-after-solidus-in-tag", 1, 4),
    ("<a =b>", "unexpected-equals-sign-before-attribute-name", 1, 4),
    ('<a b"c>', "unexpected-character-in-attribute-name", 1, 5),
    ('<a b="', "eof-in-tag", 1, 6),
    ("a\n\n</b", "eof-in-tag", 3, 3),
    ("<!-->", "abrupt-closing-of-empty-comment", 1, 5),
    ("<!--x--!>", "incorrectly-closed-comment", 1, 9),
    ("a\0b", "unexpected-null-character", 1, 2),
    ("<", "eof-before-tag-name", 1, 1),
    ("<3", "invalid-first-character-of-tag-name", 1, 2),
    ("<!doctype>", "expected-doctype-name-but-got-right-bracket", 1, 10),
    ("<!doctype", "eof-in-doctype", 1, 9),
]
_FLAW_ROWS = values(["doc_id", "code", "line", "col"], ["BIGINT", "VARCHAR", "INTEGER", "INTEGER"], [(i, *f[1:]) for i, f in enumerate(FLAWS)])


@query("parse_errors", _FLAW_ROWS)
def parse_errors(spark, sf_dir):
    return error_rows(ps.parse_docs(texts(spark, [f[0] for f in FLAWS]))).select("doc_id", "code", "line", "col")


@query("token_errors", _FLAW_ROWS)
def token_errors(spark, sf_dir):
    return error_rows(ps.pages_token_errors(texts(spark, [f[0] for f in FLAWS]))).select("doc_id", "code", "line", "col")


_SAID = [
    ("<a b b>", "duplicate-attribute at 1:7: This error occurs if the parser encounters an attribute with the same name as an earlier attribute on the same tag."),
    ("<!--", "eof-in-comment at 1:4: This error occurs if the parser encounters EOF in a comment."),
    ("<a b", "eof-in-tag at 1:4: This error occurs if the parser encounters EOF in a tag."),
    ("</>", "empty-end-tag at 1:3: Unknown error"),
]


@query("error_texts", values(["doc_id", "text"], ["BIGINT", "VARCHAR"], [(i, text) for i, (_, text) in enumerate(_SAID)]))
def error_texts(spark, sf_dir):
    return error_rows(ps.parse_docs(texts(spark, [html for html, _ in _SAID]))).select("doc_id", "text")


FRAGMENTS = [("div", "", "<td>1<td>2", None), ("tr", "", "<td>1<td>2", "td,td"), ("tbody", "", "<td>1<td>2", "tr"), ("select", "", "<option>1<option>2", "option,option"), ("path", "svg", "<g/><desc>x", "g,desc"), ("mi", "math", "<b>x</b><p>y", "b,p"), ("script", "", "<b>x</b>", None), ("colgroup", "", "<col>x<col>", "col,col")]


@query("fragments", values(["context", "tags"], ["VARCHAR", "VARCHAR"], [(c, tags) for c, _, _, tags in FRAGMENTS]))
def fragments(spark, sf_dir):
    """Texts parsed in elements of a kind: the names of the top elements, null if there are none."""
    kinds = [(c, ps.parse_fragments(texts(spark, [html]), c, ns)) for c, ns, html, _ in FRAGMENTS]
    named = [got.agg(F.array_sort(F.collect_list(F.struct("idx", "tag"))).alias("t")).select(F.lit(c).alias("context"), F.when(F.size("t") > 0, F.array_join(F.col("t.tag"), ",")).alias("tags")) for c, got in kinds]
    return reduce(DataFrame.union, named)


@query("table_cells", values(["doc_id", "row_idx", "is_header", "cells"], ["BIGINT", "INTEGER", "BOOLEAN", "VARCHAR"], [(0, 0, True, "A|B"), (0, 1, False, "1|"), (0, 2, False, "2|3")]))
def table_cells(spark, sf_dir):
    got = ps.pages_tables(texts(spark, ["<table><thead><tr><th>A<th>B</tr></thead><tr><td>1<tr><td>2<td>3</table>"]))
    return got.select("doc_id", "row_idx", "is_header", F.array_join("cells", "|").alias("cells"))


@query("token_serializer", values(["id", "html"], ["BIGINT", "VARCHAR"], [(0, "<p class=a>x &amp; y"), (1, '<a href="x\'y z">'), (2, "<input checked>"), (3, "<li>1<li>2"), (4, "<script>a<b</script>"), (5, "<!DOCTYPE html>"), (6, "x"), (7, "<!--c--><p>y"), (8, "<table><tr><td>1")]))
def token_serializer(spark, sf_dir):
    """Tokens in their JSON form as HTML, with the default options."""
    cases = [
        [["StartTag", "", "p", {"class": "a"}], ["Characters", "x & y"], ["EndTag", "", "p"]],
        [["StartTag", "", "a", [{"namespace": None, "name": "href", "value": "x'y z"}]]],
        [["EmptyTag", "input", {"checked": "checked"}]],
        [["StartTag", "", "li", {}], ["Characters", "1"], ["EndTag", "", "li"], ["StartTag", "", "li", {}], ["Characters", "2"], ["EndTag", "", "li"]],
        [["StartTag", "", "script", {}], ["Characters", "a<b"], ["EndTag", "", "script"]],
        [["Doctype", "html"]],
        [["StartTag", "", "html", {}], ["StartTag", "", "body", {}], ["Characters", "x"], ["EndTag", "", "body"], ["EndTag", "", "html"]],
        [["Comment", "c"], ["StartTag", "", "p", {}], ["Characters", "y"], ["EndTag", "", "p"]],
        [["StartTag", "", "table", {}], ["StartTag", "", "tbody", {}], ["StartTag", "", "tr", {}], ["StartTag", "", "td", {}], ["Characters", "1"], ["EndTag", "", "td"], ["EndTag", "", "tr"], ["EndTag", "", "tbody"]],
    ]
    sql.register(spark)
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id long, tokens string")
    return df.select("id", sql.html_tokens_to_html("tokens").alias("html"))


@query("encodings", values(["doc_id", "encoding", "html"], ["BIGINT", "VARCHAR", "VARCHAR"], [(0, "UTF-8", "é"), (1, "windows-1252", "“x”"), (2, "utf-16le", "ab"), (3, "iso-8859-2", "<meta charset=latin2>ą"), (4, "windows-1252", "<meta charset=utf-7>"), (5, "UTF-8", "<meta charset=utf-16>é"), (6, "euc-jp", "<meta charset=euc-jp>�"), (7, "utf-16be", "ab")]))
def encodings_query(spark, sf_dir):
    data = [b"\xef\xbb\xbf\xc3\xa9", b"\x93x\x94", b"\xff\xfea\0b\0", b"<meta charset=latin2>\xb1", b"<meta charset=utf-7>", b"<meta charset=utf-16>\xc3\xa9", b"<meta charset=euc-jp>\xc6\xfc", b"\xfe\xff\0a\0b"]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "page_id long, content binary")
    return ps.decode_pages(df)


@query("token_serializer_charset", values(["id", "html"], ["BIGINT", "VARCHAR"], [(0, "<meta charset=utf-8><title>t</title>"), (1, "<meta charset=utf-8>")]))
def token_serializer_charset(spark, sf_dir):
    """Heads without and with another encoding's meta element, written with their own."""
    cases = [
        [["StartTag", "", "head", {}], ["StartTag", "", "title", {}], ["Characters", "t"], ["EndTag", "", "title"], ["EndTag", "", "head"]],
        [["StartTag", "", "head", {}], ["EmptyTag", "meta", {"charset": "latin1"}], ["EndTag", "", "head"]],
    ]
    o = token_html.TokenOptions(inject_meta_charset=True, encoding="utf-8")
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id long, tokens string")
    return df.select("id", sql._arrow(lambda ts: token_html.serialize_tokens(json.loads(ts), o))("tokens").alias("html"))


@query("nodes_to_tokens_options", f"SELECT page_id AS doc_id, list_aggregate(regexp_extract_all({_MARKED}, '[^' || chr(1) || ']+'), 'count') AS n_texts, len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) AS n_starts FROM pages")
def nodes_to_tokens_options(spark, sf_dir):
    """Pages written by the token serializer with other options: every tag kept, values in single quotes."""
    o = token_html.TokenOptions(quote_char="'", omit_optional_tags=False)
    got = ps.pages_tokens(pages(spark, sf_dir))
    kinds = F.when(F.col("kind") == "StartTag", F.to_json(F.array(F.lit("StartTag"), F.lit(""), F.col("name")))).when(F.col("kind") == "EndTag", F.to_json(F.array(F.lit("EndTag"), F.lit(""), F.col("name")))).when(F.col("kind") == "Character", F.to_json(F.array(F.lit("Characters"), F.col("data"))))
    rows = got.select("doc_id", "pos", kinds.alias("t")).where("t is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("ts"))
    write = sql._arrow(lambda ts: token_html.serialize_tokens(json.loads(ts), o))
    written = rows.select(F.col("doc_id").alias("page_id"), write(F.concat(F.lit("["), F.array_join("ts", ","), F.lit("]"))).alias("html"))
    again = ps.pages_tokens(written).groupBy("doc_id")
    return again.agg(F.count_if(F.col("kind") == "Character").alias("n_texts"), F.count_if(F.col("kind") == "StartTag").alias("n_starts"))
