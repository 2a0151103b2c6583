import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from htmlframe import queries as q
from htmlframe.functions import sql
from htmlframe.operators import dom
from htmlframe.operators import parse as ps
from htmlframe.plans.selector_plan import select_nodes
from htmlframe.sources.pages import read_files, stream_pages, write_nodes
from htmlframe.streaming.events import run_to_table, stream_events

SELECTORS = [
    "li", ".ad", "#x", "*", "nav > ul > li > a", "nav a", "li + li", "h1 ~ p", "li:nth-child(2n+1)", "li:nth-last-child(-n+2)", "p:first-of-type", "li:not(:first-child)", "h1, footer, li a", ":empty", ":root",
    "a[href^='/th']", "html[lang|=en]", "article p b", "body > article p", "p:not(article > p)", "b b", "p + p b", "ul > li ~ li a", "div.ad[class]", "p ~ p ~ p", "a:hover", "p:only-of-type", "nav + div ~ footer",
]


@pytest.fixture(scope="module")
def nodes(spark, sf):
    return ps.parse_nodes(spark.read.parquet(f"{sf}/pages.parquet")).cache()


@pytest.mark.parametrize("semantics", ["compat", "css"])
def test_plans_agree_with_the_matcher(spark, sf, nodes, semantics):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    fused = ps.select_pages(pages, SELECTORS, semantics=semantics).select("selector", "doc_id", "node_id").collect()
    for s in SELECTORS:
        want = {(r.doc_id, r.node_id) for r in fused if r.selector == s}
        got = [(r.doc_id, r.node_id) for r in select_nodes(nodes, s, semantics).select("doc_id", "node_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want, s


def _rows(columns, rows):
    return sorted(repr([r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.ORACLES])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations", "nation", "part", "customer"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = q.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(q.ORACLES[name])
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert _rows(columns, [r.asDict() for r in got.collect()]) == _rows(columns, rows)


def test_pages_written_and_edited(spark, sf):
    """Whole pages against the functions that write one."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q.QUERIES["pages_written"](spark, sf).collect():
        assert r.output == ps.render(ps.parse_page(pages[r.doc_id], ps.ParseOptions()), r.kind)
    got = {r.doc_id: r.output for r in q.QUERIES["pages_edited"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for key, out in got.items():
        assert "<nav>" not in out and out.count("<hr><p>") == out.count("<p>") == pages[key].count("<p>")


@pytest.mark.parametrize("name", ["sel_tag", "sel_child", "sel_greedy_chain", "sel_many", "nav_text", "title_plan", "pages_edited", "pages_written"])
def test_plans_parse_once(spark, sf, name):
    """Plans parse pages in one pass, whatever they ask of the nodes, and write none of them."""
    plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pages_are_dealt_out_only_when_asked(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert "RoundRobin" not in ps.parse_docs(pages)._jdf.queryExecution().executedPlan().toString()
    assert ps.spread(pages, 3).rdd.getNumPartitions() == 3 and ps.spread(pages, 1) is pages


def test_batches_are_bounded(spark):
    """Settings that are narrower already stay."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        spark.conf.set(keys[0], "7")
        spark.conf.set(keys[1], "1000000")
        ps.bound_batches(spark)
        assert [spark.conf.get(k).removesuffix("b") for k in keys] == ["7", "1000000"]
        spark.conf.set(keys[0], "0")
        ps.bound_batches(spark)
        assert spark.conf.get(keys[0]) == str(ps.ROWS_PER_BATCH)
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


XLINK = "http://www.w3.org/1999/xlink"


def test_attributes_of_namespaces(spark):
    n = ps.parse_nodes(spark.createDataFrame([(1, "<svg xlink:href=a href=b><g/></svg>")], "page_id long, html string"))
    r = n.where("tag = 'svg'").select(dom.attr_ns(XLINK, "xlink:href").alias("x"), dom.attr("href").alias("h"), dom.with_attr_ns(XLINK, "xlink:href", "c").alias("set"), dom.with_attr_ns("xml", "lang", "d").alias("new"), dom.without_attr_ns(XLINK, "xlink:href").alias("cut"), dom.has_children().alias("kids")).first()
    assert (r.h, r.kids, len(r.cut), len(r.set), len(r.new)) == ("b", True, 1, 2, 3) and "c" in [a.value for a in r.set] and r.new[-1].value == "d"
    assert not n.where("tag = 'g'").select(dom.has_children().alias("k")).first().k
    assert n.where("tag = 'svg'").select("attrs").first().attrs[0].ns == XLINK and r.x == "a"


def test_tokenizer_may_begin_elsewhere(spark):
    df = spark.createDataFrame([(1, "<b>&amp;</title><i>")], "page_id long, html string")
    got = [(r.kind, r.name, r.data) for r in ps.pages_tokens(df, mode="rcdata", last_start="title").orderBy("pos").collect()]
    assert got == [("Character", "", "<b>&"), ("EndTag", "title", ""), ("StartTag", "i", "")]


def test_queries_without_sql(spark, sf):
    for name in q.QUERIES.keys() - q.ORACLES.keys():
        assert q.QUERIES[name](spark, sf).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "<p>" * 5000 + "z", "y"), (2, "<p>a", "u")], "page_id long, html string, text string")
    assert ps.parse_docs(df).count() == 4
    assert ps.select_pages(df, "p", first=True).count() == 2
    empty = df.limit(0)
    for make in (ps.parse_nodes, ps.parse_docs, ps.pages_events, ps.pages_tokens, ps.pages_tables):
        assert make(empty).count() == 0
    assert select_nodes(ps.parse_nodes(empty), "a b").count() == 0
    with pytest.raises(ValueError):
        ps.select_pages(df, "[")


def test_strict_pages_fail(spark):
    df = spark.createDataFrame([(1, "<a b=>")], "page_id long, html string")
    with pytest.raises(Exception, match="missing-attribute-value"):
        ps.parse_docs(df, options=ps.ParseOptions(strict=True)).collect()


def test_attributes(spark):
    n = ps.parse_nodes(spark.createDataFrame([(1, "<a ID=x class='a  b' href=u>t")], "page_id long, html string")).where("tag = 'a'")
    r = n.select("id", "classes", dom.attr("HREF").alias("h"), dom.attr("no").alias("no"), dom.with_attr("href", "v").alias("set"), dom.without_attr("href").alias("cut"), dom.attribute_map().alias("m")).first()
    assert (r.id, r.classes, r.h, r.no) == ("x", ["a", "b"], "u", None)
    assert [a.value for a in r.set] == ["x", "a  b", "v"] and len(r.cut) == 2 and r.m["href"] == "u"


def test_files_streams_and_tables(spark, sf, tmp_path, nodes):
    (tmp_path / "a.html").write_bytes(b"<meta charset=utf-8><p>\xc3\xa9")
    (tmp_path / "b.html").write_bytes(b"<p>\xe9")
    assert {r.encoding: r.html[-1] for r in read_files(spark, str(tmp_path)).collect()} == {"UTF-8": "é", "windows-1252": "é"}
    batch = ps.pages_events(spark.read.parquet(f"{sf}/pages.parquet")).groupBy("type").count().collect()
    stream = run_to_table(stream_events(stream_pages(spark, sf))).groupBy("type").count().collect()
    assert sorted(batch) == sorted(stream)
    spark.sql(f"create database if not exists t location '{tmp_path}/w'")
    write_nodes(nodes, "t.nodes", 4)
    plan = spark.table("t.nodes").groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table t.nodes")


def test_stream_of_part_files(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    tables = spark.catalog.listTables()
    want = [tuple(r) for r in q.QUERIES["stream_events"](spark, sf).collect()]
    assert want[0][1] > 0 and [tuple(r) for r in q.QUERIES["stream_events"](spark, str(tmp_path)).collect()] == want
    assert spark.catalog.listTables() == tables  # no memory sink


def test_parse_reads_two_columns_and_does_not_shuffle(spark, sf):
    plan = ps.parse_nodes(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan and "MapInArrow" in plan and "hashpartitioning" not in plan


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT html_title('<title>a&amp;b</title>') AS t, html_text('<p>x<b>y') AS x, html_first('<p>1<p>2', 'p') AS f, html_to_markdown('<h1>q') AS m, html_unescape('&lt;') AS u").first()
    assert tuple(row) == ("a&b", "xy", "<p>1</p>", "# q", "<")
    got = spark.sql("SELECT s.tag, s.text FROM VALUES ('<ul><li>1<li>2</ul>') AS t(h), LATERAL html_select(h, 'li') s").collect()
    assert [tuple(r) for r in got] == [("li", "1"), ("li", "2")]
    assert spark.range(1).select(sql.html_text(F.lit(None).cast("string"))).first()[0] is None
