"""Selectors as windows, tours, edits, decoding, files and chunks."""

import json
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from htmlframe import queries as q
from htmlframe.functions import encodings, selectors
from htmlframe.functions import tokens as tk
from htmlframe.operators import decode, dom, tour
from htmlframe.operators import parse as ps
from htmlframe.plans import selector_plan as sp
from htmlframe.sources import files
from htmlframe.streaming.chunks import BEGIN, Feed, chunk_events
from htmlframe.streaming.events import run_to_table

ODD = [
    "", None, '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://x"><p a=\'1"2\' b=&amp;>x & y<br><!-- c --><template><p>in</p></template>z', "<!doctype html SYSTEM 'about:legacy-compat'>x", "<svg viewbox=1 xlink:href=u><g/></svg><ul><li>1<li>2<ul><li>3</ul></ul>",
    '<p>é\t\n"q\\ \x7f</p>', "<div><div><div>x</div></div></div>tail", "<b>1<p>2</b>3<p>4<ul><li><p>5</ul>",
]


@pytest.fixture(scope="module")
def pages(spark, sf):
    real = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(15).collect()]
    return spark.createDataFrame(list(enumerate(ODD + real)), "page_id long, html string").cache()


@pytest.fixture(scope="module")
def nodes(pages):
    return ps.parse_nodes(pages).cache()


# -- selectors


def _tree(rnd, depth):
    inside = "".join(_tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4) if depth else 0))
    name = rnd.choice("abcd")
    return f"<x-{name} class={rnd.choice('pq')}>{inside}</x-{name}>"


def _selector(rnd):
    def compound():
        out = rnd.choice(("x-a", "x-b", "x-c", ".p", "*", "x-d.q"))
        return out + (f":not({rnd.choice(('x-a>x-b', '.p~x-b', 'x-a+x-b~x-c', 'x-c,.p+.q'))})" if rnd.random() < 0.25 else "")

    return compound() + "".join(rnd.choice((" ", " > ", " + ", " ~ ")) + compound() for _ in range(rnd.randint(0, 4)))


@pytest.mark.parametrize("semantics", ["compat", "css"])
def test_windows_agree_with_the_matcher_on_random_trees(spark, semantics):
    rnd = random.Random(5)
    made = spark.createDataFrame([(i, _tree(rnd, 5)) for i in range(40)], "page_id long, html string").cache()
    table = ps.parse_nodes(made).cache()
    asked = [_selector(rnd) for _ in range(40)]
    want = {}
    for r in ps.select_pages(made, asked, semantics=semantics).collect():
        want.setdefault(r.selector, set()).add((r.doc_id, r.node_id))
    got = {}
    for r in sp.select_many(table, asked, semantics).collect():
        got.setdefault(r.selector_idx, []).append((r.doc_id, r.node_id))
    for i, s in enumerate(asked):
        found = got.get(i, [])
        assert len(found) == len(set(found)) and set(found) == want.get(s, set()), s
    for s in asked[:4]:
        for split in (None, 3):
            assert {(r.doc_id, r.node_id) for r in sp.select_nodes(table, s, semantics, split).collect()} == want.get(s, set())
        marked = sp.mark_nodes(table, s, semantics=semantics)
        assert marked.count() == table.count() and {(r.doc_id, r.node_id) for r in marked.where("matched").collect()} == want.get(s, set())


def test_selectors_join_nothing_and_parse_once(spark, sf):
    table = ps.parse_nodes(spark.read.parquet(f"{sf}/pages.parquet"))
    for made in (sp.select_nodes(table, "nav > ul > li a"), sp.select_nodes(table, "body > * li ~ li a"), sp.select_many(table, ["nav a", "li + li", "h1 ~ p"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") == 1
    one = sp.select_nodes(table, "nav a").groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange hashpartitioning") == 1


def test_wide_and_deep_pages_take_time_in_proportion(spark):
    def took(n):
        wide = ps.parse_nodes(spark.createDataFrame([(1, "<ul>" + "<li><b>x</b></li>" * n + "</ul>")], "page_id long, html string")).cache()
        assert wide.count() > n
        begin = time.time()
        for semantics in ("compat", "css"):
            assert sp.select_nodes(wide, "ul > li ~ li b", semantics).count() == n - 1
        assert sp.select_nodes(wide, "ul > li ~ li b", split=500).count() == n - 1
        return time.time() - begin

    took(500)
    assert took(16000) < 8 * took(2000) + 3
    deep = ps.parse_nodes(spark.createDataFrame([(1, "<div>" * 400)], "page_id long, html string"))
    assert sp.select_nodes(deep, "div div div").count() == 398
    assert sp.select_nodes(deep, "body > div div").count() == 1
    assert sp.select_nodes(deep, "body > div div", "css").count() == 399


def test_select_many_odd_lists(nodes):
    assert sp.select_many(nodes, []).collect() == []
    twice = sp.select_many(nodes, ["li", "li", "x-none"]).groupBy("selector_idx").count().collect()
    assert sorted(r.selector_idx for r in twice) == [0, 1] and len({r["count"] for r in twice}) == 1
    with pytest.raises(selectors.SelectorError):
        sp.select_many(nodes, ["li", "["])
    with pytest.raises(ValueError):
        sp.select_nodes(nodes, "li", "none")


# -- tours and edits


@pytest.mark.parametrize("split", [None, 5])
def test_nodes_are_written_as_the_pages_are(pages, nodes, split):
    want = {r.doc_id: r.output for r in ps.render_pages(pages, "html").collect()}
    assert {r.doc_id: r.output for r in tour.nodes_to_html(nodes, split).collect()} == want
    trees = {r.doc_id: json.loads(r.output) for r in ps.render_pages(pages, "tree").collect()}
    assert {r.doc_id: json.loads(r.output) for r in tour.nodes_to_json(nodes, split).collect()} == trees
    assert "Join" not in tour.nodes_to_html(nodes)._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_written_with_indents_as_the_pages_are(spark):
    more = ["<!-- a --><p>x</p><!-- b -->", "<body>a<div> b </div>c<span>d<div>e</div></span>  f\n g<br><img>", "<table><tr><td>1<td>2</table>", "<pre>a\n  b</pre><p> </p>"]
    made = spark.createDataFrame(list(enumerate(ODD + more)), "page_id long, html string").cache()
    for indent in (2, 4):
        want = {r.doc_id: r.output for r in ps.render_pages(made, f"pretty{indent}").collect()}
        assert {r.doc_id: r.output for r in tour.nodes_to_pretty(ps.parse_nodes(made), indent).collect()} == want


def test_places_are_those_of_the_parser(nodes):
    assert sorted(map(str, tour.places(nodes).collect())) == sorted(map(str, nodes.collect()))


@pytest.mark.parametrize("selector", ["p", "ul", "div div, p b"])
@pytest.mark.parametrize("action,html", [("remove", ""), ("replace", "<i>y</i>z"), ("before", "<hr><p>q<b>w</b></p>"), ("append", "<li>n<!--k--></li>t")])
def test_edits_are_those_of_trees(pages, nodes, selector, action, html):
    edited = tour.edit_nodes(sp.mark_nodes(nodes, selector), action, html).cache()
    want = {r.doc_id: r.output for r in ps.edit_pages(pages, selector, action, html).collect()}
    assert {r.doc_id: r.output for r in tour.nodes_to_html(edited).collect()} == want
    assert sorted(map(str, tour.places(edited).collect())) == sorted(map(str, edited.collect()))
    numbered = edited.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("node_id").alias("most"), F.max(F.when(F.col("node_id") == 0, F.col("last_id"))).alias("last"))
    assert numbered.where("n <> most + 1 or last <> most").count() == 0
    up = edited.select("doc_id", F.col("node_id").alias("parent_id"), F.col("last_id").alias("up_last"), F.col("depth").alias("up_depth"))
    assert edited.join(up, ["doc_id", "parent_id"]).where("not (parent_id < node_id and last_id <= up_last and depth = up_depth + 1)").count() == 0


def test_edits_of_nothing(nodes):
    same = tour.edit_nodes(sp.mark_nodes(nodes, "x-none"), "replace", "<p>")
    assert sorted(map(str, same.collect())) == sorted(map(str, nodes.collect()))
    assert tour.edit_nodes(sp.mark_nodes(nodes.limit(0), "p"), "before", "<hr>").collect() == []
    with pytest.raises(ValueError):
        tour.edit_nodes(sp.mark_nodes(nodes, "p"), "move")


def test_text_and_removal_of_marked(pages, nodes):
    for selector in ("nav", "ul, li", "title", "div", "p"):
        marked = sp.mark_nodes(nodes, selector)
        want = sorted((r.doc_id, r.node_id, r.text) for r in ps.select_pages(pages, selector).collect())
        assert sorted(map(tuple, tour.text_of_marked(marked).collect())) == want
        left = dom.without(nodes, sp.select_nodes(nodes, selector))
        assert sorted((r.doc_id, r.node_id) for r in tour.without_marked(marked).collect()) == sorted((r.doc_id, r.node_id) for r in left.collect())
    assert sorted(map(tuple, tour.titles(nodes).collect())) == sorted(map(tuple, dom.titles(nodes).collect()))


def test_clones(nodes):
    tops = sp.select_nodes(nodes, "ul, svg")
    copies = tour.clones(nodes, tops).cache()
    assert copies.where("node_id = 0").count() == tops.count() and copies.where("node_id = 0 and parent_id is not null or node_id > 0 and parent_id is null or last_id < node_id").count() == 0
    svg = copies.where("tag = 'svg'").first()
    assert svg.ns.endswith("svg") and [a.name for a in svg.attrs] == ["viewBox", "xlink:href"] and (svg.depth, svg.last_id) == (0, 1)
    own = tour.nodes_to_html(copies.withColumn("doc_id", F.xxhash64("doc_id", "clone_of")).drop("clone_of"))
    assert {"<ul><li>1</li><li>2<ul><li>3</li></ul></li></ul>", "<ul><li>3</li></ul>"} <= {r.output for r in own.collect()}
    assert tour.clones(nodes, tops, deep=False).count() == tops.count()


# -- bytes


def test_bytes_are_decoded_as_the_plain_function_does(spark):
    cases = [
        b"\xef\xbb\xbf\xc3\xa9", b"\x93x\x94\x81", b"\xff\xfea\0b\0", b"\xff\xfea\0b", b"<meta charset=latin2>\xb1", b"<meta charset=utf-7>", b"<meta charset=utf-16>\xc3\xa9", b"<meta charset=euc-jp>\xc6\xfc\x80", b"\xfe\xff\0a\0b",
        b"\xfe\xff\xd8\x3d\xde\x00", b"", None, b"<!doctype html><html><head><meta charset='utf-8'>\xff", b"<!-- <meta charset=utf-8> --><p>\xe9", b"<p title='<meta charset=utf-8>'>\xe9", b"<meta name=a><meta charset=utf-8>\xc3\xa9",
        b"<META  CHARSET = 'UTF-8' >\xc3\xa9", b"<meta charset=nope>\xe9", b"x" * 2000 + b"<meta charset=utf-8>\xc3\xa9", b"<metax charset=utf-8>\xe9", b"<p><meta charset=utf-8/>\xc3\xa9", b"<p " * 3000 + b">\xe9", b"< <meta charset=utf8>\xc3\xa9",
    ]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "page_id long, content binary")
    for hint in (None, "latin1", "utf-8", "utf-16", "euc-jp", "utf-16be", "nope"):
        got = {r.doc_id: (r.html, r.encoding) for r in decode.decode_bytes(df, hint).collect()}
        assert got == {i: encodings.decode(c or b"", hint) for i, c in enumerate(cases)}, hint


def test_usual_bytes_stay_on_the_jvm(spark):
    """Rows of UTF-8, UTF-16 and windows-1252 don't reach Python."""
    df = spark.createDataFrame([(1, bytearray(b"<meta charset=utf-8>\xc3\xa9")), (2, bytearray("é".encode("utf-16"))), (3, bytearray(b"<p>\xe9"))], "page_id long, content binary")
    whole = decode.decode_bytes(df)
    assert sorted((r.doc_id, r.encoding) for r in whole.collect()) == [(1, "UTF-8"), (2, "utf-16le"), (3, "windows-1252")]
    assert decode.sorted_bytes(df).where("not fits").count() == 0


# -- files


def test_page_files_both_ways(spark, sf, tmp_path):
    files.register(spark)
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    given.repartition(3).write.format("htmlpages").mode("append").save(f"{tmp_path}/o")
    got = spark.read.format("htmlpages").option("bytesPerPartition", "20000").load(f"{tmp_path}/o")
    assert sorted((r.doc_id, r.html, r.encoding) for r in got.collect()) == sorted((r.page_id, r.html, "UTF-8") for r in given.collect())
    assert got.rdd.getNumPartitions() > 3
    assert sorted(r.doc_id for r in got.where("doc_id in (1, 4)").collect()) == [1, 4] and got.where("doc_id = -1").count() == 0
    path = got.where("doc_id = 3").first().path
    assert got.where(F.col("path") == path).count() == 1 and got.where(F.col("path").startswith(path[:-7])).count() >= 1
    spark.createDataFrame([(1, "a"), (1, "b"), (None, None)], "doc_id long, html string").coalesce(1).write.format("htmlpages").mode("append").option("ending", "htm").save(f"{tmp_path}/o")
    assert sorted(r.html for r in got.sparkSession.read.format("htmlpages").option("glob", "*.htm").load(f"{tmp_path}/o").collect()) == ["", "a", "b"]
    given.limit(2).write.format("htmlpages").mode("overwrite").save(f"{tmp_path}/o")
    assert spark.read.format("htmlpages").load(f"{tmp_path}/o").count() == 2


def test_page_files_filters_reach_the_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    for i in range(5):
        (tmp_path / f"{i}.html").write_text("x")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "9.html").write_text("x")
    reader = files.PagesReader({"path": str(tmp_path)})
    assert [type(f) for f in reader.pushFilters([In(("doc_id",), (1, 2, 9)), EqualTo(("encoding",), "UTF-8"), GreaterThan(("doc_id",), 1), StringStartsWith(("path",), str(tmp_path))])] == [EqualTo, GreaterThan]
    assert sorted(files.id_of(p) for part in reader.partitions() for p in part.paths) == [1, 2]


def test_failed_writes_leave_nothing(spark, tmp_path):
    files.register(spark)
    bad = spark.range(20).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("x").alias("html"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("htmlpages").mode("append").save(f"{tmp_path}/o")
    assert not [p for p in (tmp_path / "o").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="need an id"):
        spark.range(2).write.format("htmlpages").mode("append").save(f"{tmp_path}/p")


# -- chunks


def test_chunks_give_the_tokens_of_the_whole(sf):
    pages = pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()[:10]
    odd = ["", "﻿<p>x", "a\r\nb\r", "<script>if(a<b)</script>x</script>", "<textarea>&am", "&amp", "<!-- x --><!doc", "<!DOCTYPE html><title>a &lt; b</title><p a='>' b=c>é日😀</p><![CDATA[x]]>", "a < b <3 </ <x", "<plaintext><b>", "<style></styl</style>y", "<script><!--<script></script>--></script>z", "<a b='"]
    rnd = random.Random(2)
    key = lambda t: (t.kind, t.name, tuple(t.attrs), t.data, t.public_id, t.system_id)
    for page in odd * 25 + pages:
        raw = page.encode()
        cuts = sorted(rnd.randint(0, len(raw)) for _ in range(rnd.randint(0, 12)))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        order = list(range(len(parts)))
        if rnd.random() < 0.3:
            rnd.shuffle(order)
        out, state = [], BEGIN
        for i in order:
            feed = Feed(state)
            out += list(feed.push(i, parts[i], i == len(parts) - 1))
            state = feed.state()
        want = [key(t) for t in tk.tokenize(page)[0]]
        assert feed.closed and [key(t) for _, t in out] == want and [i for i, _ in out] == list(range(len(want)))


def test_chunks_of_a_stream(spark, tmp_path):
    rows = [[(1, 0, b"<p>a", False), (2, 1, b"c</b>", True), (3, 0, None, None)], [(1, 1, b" b</p", False), (2, 0, b"<b>\xc3\xa9", False)], [(1, 2, b"><i>", True), (3, 1, b"x", True)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "page_id long, number int, chunk binary, last boolean").coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema("page_id bigint, number int, chunk binary, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = run_to_table(chunk_events(stream)).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.type, r.name, r.data) for r in got] == [(1, "StartTag", "p", ""), (1, "Text", "", "a b"), (1, "EndTag", "p", ""), (1, "StartTag", "i", ""), (2, "StartTag", "b", ""), (2, "Text", "", "éc"), (2, "EndTag", "b", ""), (3, "Text", "", "x")]


@pytest.mark.parametrize("name", ["edited_nodes", "replaced_nodes", "pages_edited", "pretty_of_nodes"])
def test_edited_nodes_are_shuffled_once(spark, sf, name):
    """All windows of an edit, and what is asked of its result, use the one shuffle by document, whose parts are bounded."""
    plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["sel_greedy_pages", "sel_many", "sel_child"])
def test_selected_nodes_are_shuffled_once(spark, sf, name):
    """A selector's steps use one shuffle of what some compound matches: one for each of the two plans of sel_greedy_pages."""
    plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == (2 if name == "sel_greedy_pages" else 1) and "REPARTITION_BY_NUM" in plan


def test_parts_grow_with_the_pages(spark, sf, monkeypatch):
    """A task's part of the pages is bounded, so more pages make more parts."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    size = sum(len(r.html.encode()) for r in pages.collect())
    monkeypatch.setattr(ps, "SORTED_BYTES", 10_000)
    monkeypatch.setattr(ps, "PARSED_BYTES", 20_000)
    assert ps.shares(pages) == (-(-size // 20_000), -(-size // 10_000))
    assert q.dealt_nodes(spark, sf).rdd.getNumPartitions() == -(-size // 10_000)
    assert ps.shares(pages.limit(0)) == (spark.sparkContext.defaultParallelism,) * 2


@pytest.mark.parametrize("name", ["markdown_of_rows", "attributes_edited"])
def test_small_files_are_parsed_by_all_cores(spark, sf, name):
    """A table of short rows comes in one split, but its rows are pages to parse: once, and by all cores."""
    got = q.QUERIES[name](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_attributes_of_repeated_rows(spark, sf, tmp_path):
    """A row that comes twice gives two rows, as in SQL."""
    some = spark.read.parquet(f"{sf}/customer.parquet").limit(3)
    some.union(some).write.parquet(str(tmp_path / "customer.parquet"))
    assert q.QUERIES["attributes_edited"](spark, str(tmp_path)).count() == 6


def test_chunks_are_written_by_all_cores(spark, sf, tmp_path, monkeypatch):
    """Batches of chunks come in as many files as tasks wrote, and still are three batches with all events."""
    monkeypatch.setattr(q, "shared_folder", lambda spark: str(tmp_path))
    got = {(r.doc_id, r.type): r.n for r in q.QUERIES["stream_chunks"](spark, sf).collect()}
    assert got == {(r.doc_id, r.type): r.n for r in q.QUERIES["events_by_type"](spark, sf).collect()}
    (folder,) = tmp_path.glob("chunks-*")
    written = [len(list((folder / str(i)).glob("*.parquet"))) for i in range(3)]
    assert min(written) > 1, written
    numbers = [spark.read.parquet(str(folder / str(i))) for i in range(3)]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sum(n.count() for n in numbers) == sum(max(1, -(-len(r.html.encode()) // 1000)) for r in pages.collect())
