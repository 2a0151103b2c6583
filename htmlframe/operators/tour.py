"""Documents written and edited on a table of nodes, in DataFrame functions only.

Writing walks an Euler tour: each node gives what opens it, at its number, and what closes it, at its last_id, deeper ones
first; the tour of a document is put together in that order. With `split`, ranges of node numbers are put together first, so
that no step holds more of a document than its text.

Edits renumber by prefix sums: whatever is left counts one, whatever is removed nothing, and a place of insertion as many
nodes as the fragment has. The sum before a node is its new number, the sum before its close gives its new last_id. Places
among siblings are worked out anew, so what comes out is a table of nodes like any other. Nothing is joined; all windows are
on the document or parts of it, so nodes that are dealt out by document (parse.shares() says in how many parts) aren't shuffled
again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from htmlframe import schemas as sc
from htmlframe.functions import builder, serialize
from htmlframe.functions.tree import FRAGMENT, Node
from htmlframe.operators.dom import attribute_text, first_of
from htmlframe.operators.parse import node_rows
from htmlframe.plans.selector_plan import mark_nodes

WRITTEN = "not in_template"
NAMES = [f.name for f in sc.NODES]


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _toured(nodes: DataFrame, opening: Column, closing: Column, split: int | None) -> DataFrame:
    """(doc_id, output): what opens and closes the nodes of each document, in the order of the tour. Null closes nothing."""
    place = lambda at, closes, tie, said: F.struct(F.col(at).alias("at"), F.lit(closes).alias("closes"), tie.cast("int").alias("tie"), said.alias("said"))
    parts = F.array_compact(F.array(place("node_id", 0, F.lit(0), opening), F.when(closing.isNotNull(), place("last_id", 1, -F.col("node_id"), closing))))
    tour = nodes.select("doc_id", F.inline(parts))
    joined = "listagg(said, '') within group (order by at, closes, tie)"
    if not split:
        return tour.groupBy("doc_id").agg(F.coalesce(F.expr(joined), F.lit("")).alias("output"))
    ranges = tour.groupBy("doc_id", F.floor(F.col("at") / split).alias("range_")).agg(F.expr(joined).alias("said"))
    return ranges.groupBy("doc_id").agg(F.coalesce(F.expr("listagg(said, '') within group (order by range_)"), F.lit("")).alias("output"))


def nodes_to_html(nodes: DataFrame, split: int | None = None) -> DataFrame:
    """(doc_id, output): each document as compact HTML. A template's contents aren't written, text is escaped everywhere."""
    kind = F.col("node_type")
    opening = (
        F.when(kind == 1, F.concat(F.lit("<"), "tag", attribute_text(F.col("attrs")), F.lit(">")))
        .when(kind == 3, _escaped(F.col("data")))
        .when(kind == 8, F.concat(F.lit("<!--"), "data", F.lit("-->")))
        .otherwise(F.coalesce(F.col("data"), F.lit("")))
    )
    closing = F.when((kind == 1) & ~F.col("tag").isin(*sorted(serialize.VOID)), F.concat(F.lit("</"), "tag", F.lit(">")))
    return _toured(nodes.where(WRITTEN), opening, closing, split)


def nodes_to_pretty(nodes: DataFrame, indent: int = 2) -> DataFrame:
    """(doc_id, output): each document as indented HTML, a line for each child of an element that has block elements below it.

    What a node needs of those above it comes down as prefix sums over the tour: how many elements that are broken into lines are
    open around it. Whether its parent is one comes from the parent, and whether an element is one from its children."""
    kind, blank = F.col("node_type"), F.expr("node_type = 3 and data rlike '^[ \\\\t\\\\n\\\\r\\\\f]*$'")
    kept = nodes.where(WRITTEN).where(~blank).select("doc_id", "node_id", "parent_id", "last_id", "node_type", "tag", "attrs", "data")
    block = (kind == 1) & F.col("tag").isin(*sorted(serialize.BLOCK))
    void = F.col("tag").isin(*sorted(serialize.VOID))
    # an element is broken if a child is a block; each node takes part as itself and as its parent's child
    both = kept.select("*", F.inline(F.array(F.struct(F.col("node_id").alias("key_"), F.lit(0).alias("child_")), F.struct(F.col("parent_id").alias("key_"), F.lit(1).alias("child_")))))
    family = Window.partitionBy("doc_id", "key_")
    known = both.withColumn("broken_", F.coalesce(F.max(F.when((F.col("child_") == 1) & block, True)).over(family), F.lit(False)))
    own = Window.partitionBy("doc_id", "node_id")
    up_is = F.max(F.when(F.col("child_") == 1, F.col("broken_"))).over(own)
    top = F.max(F.when((F.col("child_") == 0) & kind.isin(9, 11), True)).over(family)
    flagged = known.withColumn("top_", F.coalesce(top, F.lit(False))).withColumns({"up_": up_is, "under_top_": F.max(F.when(F.col("child_") == 1, F.col("top_"))).over(own)}).where("child_ = 0")
    element = (kind == 1) & F.col("broken_") & ~void
    moves = flagged.withColumns({"breaks_": element, "line_": F.coalesce(F.col("up_"), F.lit(False)) & ~F.coalesce(F.col("under_top_"), F.lit(False)), "inline_": ~(F.coalesce(F.col("up_"), F.lit(False)) | F.coalesce(F.col("under_top_"), F.lit(False)))})
    tour = moves.select("*", F.inline(F.array_compact(F.array(F.struct(F.col("node_id").alias("at"), F.lit(0).alias("closes"), F.lit(0).alias("tie")), F.when(kind == 1, F.struct(F.col("last_id").alias("at"), F.lit(1).alias("closes"), (-F.col("node_id")).cast("int").alias("tie")))))))
    before = Window.partitionBy("doc_id").orderBy("at", "closes", "tie").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("breaks_"), F.when(F.col("closes") == 0, 1).otherwise(-1)).otherwise(0)
    deep = tour.withColumn("depth_", F.coalesce(F.sum(step).over(before), F.lit(0)) - F.when(F.col("closes") == 1, F.when(F.col("breaks_"), 1).otherwise(0)).otherwise(0))
    pad = F.repeat(F.lit(" " * indent), F.col("depth_").cast("int"))
    at_line = F.when(F.col("line_"), F.lit("\n")).otherwise("")
    indented = F.when(F.col("inline_"), "").otherwise(pad)
    said = (
        F.when(F.col("closes") == 1, F.when(void, "").otherwise(F.concat(F.when(F.col("breaks_"), F.concat(F.lit("\n"), pad)).otherwise(""), F.lit("</"), "tag", F.lit(">"))))
        .when(kind == 1, F.concat(at_line, indented, F.lit("<"), "tag", attribute_text(F.col("attrs")), F.lit(">")))
        .when(kind == 3, F.concat(at_line, _escaped(F.regexp_replace("data", "[ \\t\\n\\r\\f]+", " "))))
        .when(kind == 8, F.concat(at_line, indented, F.lit("<!--"), "data", F.lit("-->")))
        .otherwise(F.when(F.col("data").isNotNull(), F.concat("data", F.lit("\n"))).otherwise(""))
    )
    parts = deep.select("doc_id", "at", "closes", "tie", said.alias("said"))
    return parts.groupBy("doc_id").agg(F.coalesce(F.expr("listagg(said, '') within group (order by at, closes, tie)"), F.lit("")).alias("output"))


def _json(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def nodes_to_json(nodes: DataFrame, split: int | None = None) -> DataFrame:
    """(doc_id, output): each document as a tree in JSON, with the keys that to_tree() gives it."""
    kind = F.col("node_type")
    comma = F.when(F.col("node_id") > F.col("parent_id") + 1, ", ").otherwise("")
    attributes = F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform("attrs", lambda a: a["name"])), lambda n: F.struct(n, F.element_at(F.filter("attrs", lambda a: a["name"] == n), -1)["value"]))))
    of = lambda word: F.concat(comma, F.lit(f'{{"type": "{word}", "data": '), _json(F.col("data")), F.lit("}"))
    opening = (
        F.when(kind == 1, F.concat(comma, F.lit('{"type": "element", "tagName": '), _json(F.col("tag")), F.lit(', "namespace": '), _json(F.col("ns")), F.lit(', "attributes": '), attributes, F.lit(', "children": [')))
        .when(kind == 3, of("text"))
        .when(kind == 8, of("comment"))
        .otherwise('{"type": "document", "children": [')
    )
    # a document type is kept as it is written: name, and public and system identifiers
    said = F.regexp_extract("data", r'(?s)^<!DOCTYPE (.*?)(?: (?:PUBLIC|SYSTEM) "[^"]*"(?: "[^"]*")?)?>$', 1), F.regexp_extract("data", r'PUBLIC "([^"]*)"', 1), F.regexp_extract("data", r'(?:PUBLIC "[^"]*"|SYSTEM) "([^"]*)">$', 1)
    doctype = F.concat(F.lit('], "doctype": '), F.to_json(F.struct(said[0].alias("name"), said[1].alias("publicId"), said[2].alias("systemId"))), F.lit("}"))
    closing = F.when(kind == 1, F.lit("]}")).when(kind.isin(9, 11), F.when(F.col("data").isNull(), F.lit("]}")).otherwise(doctype))
    return _toured(nodes.where(WRITTEN), opening, closing, split)


def _in_order(*family: str) -> Window:
    return Window.partitionBy("doc_id", *family).orderBy("node_id")


def _covered(end: int) -> Column:
    """Whether a marked element stands at or above (end 0) or above (end -1) a node."""
    upto = F.max(F.when(F.col("matched"), F.col("last_id"))).over(_in_order().rowsBetween(Window.unboundedPreceding, end))
    return F.coalesce(upto >= F.col("node_id"), F.lit(False))


def without_marked(marked: DataFrame) -> DataFrame:
    """Nodes that aren't at or below a marked one, with the numbers they had."""
    return marked.withColumn("gone_", _covered(0)).where("not gone_").drop("gone_", "matched")


def text_of_marked(marked: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of marked elements: the text below them in document order, templates left out.

    Elements are offsets into the document's text: the characters before each, and before what follows it."""
    length = F.when(F.expr("node_type = 3 and not in_template"), F.char_length("data")).otherwise(0)
    sized = marked.select("doc_id", "node_id", "last_id", "matched", F.when(length > 0, F.col("data")).alias("said"), length.alias("chars"))
    sized = sized.where("matched or chars > 0")
    ends = sized.select("*", F.inline(F.when(F.col("matched"), F.array(F.struct(F.col("node_id").alias("at"), F.lit(0).alias("closes")), F.struct(F.col("last_id").alias("at"), F.lit(1).alias("closes")))).otherwise(F.array(F.struct(F.col("node_id").alias("at"), F.lit(0).alias("closes"))))))
    before = F.coalesce(F.sum(F.when(F.col("closes") == 0, F.col("chars")).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("at", "closes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ends.withColumn("before_", before)
    span = F.when(F.col("matched"), F.struct("node_id", "closes", "before_"))
    whole = placed.groupBy("doc_id").agg(F.coalesce(F.expr("listagg(case when closes = 0 then said end, '') within group (order by at, closes)"), F.lit("")).alias("said"), F.array_sort(F.collect_list(span)).alias("spans"))
    span_of = lambda i: F.struct(F.get("spans", i)["node_id"].alias("node_id"), F.get("spans", i)["before_"].alias("first"), F.get("spans", i + 1)["before_"].alias("behind"))
    each = whole.where("size(spans) > 0").select("doc_id", "said", F.inline(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), span_of)))
    return each.select("doc_id", "node_id", F.expr("substr(said, cast(first + 1 as int), cast(behind - first as int))").alias("text"))


def titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, title): text of the first title directly in the head, as it is."""
    found = text_of_marked(mark_nodes(nodes, ":root > head > title"))
    return first_of(found).select("doc_id", F.col("text").alias("title"))


def places(nodes: DataFrame) -> DataFrame:
    """Nodes with their places among siblings, and whether they are empty, worked out anew."""
    element = F.col("node_type") == 1
    kin = nodes.withColumn("element_", element).withColumn("name_", F.lower("tag"))
    family, alike = _in_order("parent_id", "element_"), _in_order("parent_id", "element_", "name_")
    if_element = lambda c: F.when(element, c).cast("int")
    all_of = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = kin.withColumns({
        "el_idx": if_element(F.row_number().over(family)), "el_cnt": if_element(F.count("*").over(all_of(family))), "prev_el": if_element(F.lag("node_id").over(family)),
        "ty_idx": if_element(F.row_number().over(alike)), "ty_cnt": if_element(F.count("*").over(all_of(alike))),
    })
    fills = element | (F.col("node_type") == 3) & F.col("data").rlike(r"(?U)\S")
    both = found.select("*", F.inline(F.array(F.struct(F.col("node_id").alias("key_"), F.lit(1).alias("own_")), F.struct(F.col("parent_id").alias("key_"), F.lit(0).alias("own_")))))
    filled = F.coalesce(F.max(F.when((F.col("own_") == 0) & fills, True)).over(Window.partitionBy("doc_id", "key_")), F.lit(False))
    return both.withColumn("is_empty", F.when(element, ~filled)).where("own_ = 1").select(*NAMES)


def _fragment(html: str, context: str) -> list[tuple]:
    top = Node(FRAGMENT)
    for n in builder.parse_fragment(html, context):
        top.append(n)
    return node_rows(0, top)[1:]


def _literal(rows: list[tuple]) -> Column:
    """The nodes of a fragment as an array: as many as the caller wrote."""
    fields = [f.name for f in sc.NODES]
    return F.from_json(F.lit(json.dumps([dict(zip(fields, r, strict=True)) for r in rows])), f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _split(sc.NODES_SQL))}>>")


def _split(columns: str) -> list[str]:
    """Columns of a schema in SQL, each with its type."""
    out, deep = [""], 0
    for c in columns:
        deep += (c == "<") - (c == ">")
        if c == "," and not deep:
            out.append("")
        else:
            out[-1] += c
    return out


def edit_nodes(marked: DataFrame, action: str, html: str = "", context: str = "div") -> DataFrame:
    """Nodes with their marked elements (column matched, as mark_nodes() gives it) edited and renumbered.

    action: remove, replace, before or append; html: what comes in their place, before them or as their last children, read as
    inside an element `context`. Elements inside one that is removed or replaced go with it."""
    if action not in ("remove", "replace", "before", "append"):
        raise ValueError(f"unknown action: {action}")
    fragment = _fragment(html, context) if action != "remove" else []
    size = len(fragment)
    gone = _covered(0) if action in ("remove", "replace") else F.lit(False)
    target = F.col("matched") & (~_covered(-1) if action == "replace" else F.lit(True)) & F.lit(bool(size))
    kept = marked.withColumns({"gone_": gone, "target_": target})
    event = lambda at, kind, tie, sub, n: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), tie.cast("int").alias("tie"), F.lit(sub).alias("sub"), n.cast("int").alias("size"))
    events = [event("node_id", 0, F.lit(0), 0, F.when(F.col("gone_"), 0).otherwise(1))]
    if action in ("before", "replace"):
        events.append(F.when(F.col("target_"), event("node_id", -1, F.lit(0), 0, F.lit(size))))
    if action == "append":
        events.append(F.when(F.col("target_"), event("last_id", 1, -F.col("node_id"), 0, F.lit(size))))
    events.append(F.when(~F.col("gone_") & ((F.col("last_id") > F.col("node_id")) | F.col("target_")), event("last_id", 1, -F.col("node_id"), 1, F.lit(0))))
    tour = kept.select("*", F.inline(F.array_compact(F.array(*events))))
    order = Window.partitionBy("doc_id").orderBy("at", "kind", "tie", "sub").rowsBetween(Window.unboundedPreceding, -1)
    summed = tour.withColumn("new_", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("int"))
    own = Window.partitionBy("doc_id", "node_id")
    closes = (F.col("kind") == 1) & (F.col("sub") == 1)
    ended = summed.withColumns({"id_": F.max(F.when(F.col("kind") == 0, F.col("new_"))).over(own), "end_": F.max(F.when(closes, F.col("new_") - 1)).over(own)})
    ended = ended.where(~closes & (~F.col("gone_") | (F.col("kind") != 0)))
    # the new number of the parent, whatever number it had
    inserted = F.col("kind") != 0
    looks_for = F.when(inserted & (F.lit(action) == "append"), F.col("node_id")).otherwise(F.col("parent_id"))
    given = F.when(~inserted, F.struct(F.col("node_id").alias("key_"), F.lit(0).alias("asks_")))
    both = ended.select("*", F.inline(F.array_compact(F.array(F.struct(looks_for.alias("key_"), F.lit(1).alias("asks_")), given))))
    up = F.max(F.when((F.col("asks_") == 0) & F.col("key_").isNotNull(), F.col("id_"))).over(Window.partitionBy("doc_id", "key_").orderBy("asks_").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("up_", up).where("asks_ = 1")
    moved = {"node_id": F.col("new_"), "parent_id": F.when(F.col("parent_id").isNotNull(), F.col("up_")), "last_id": F.coalesce("end_", "new_")}
    # doc_id stays a column of its own, so that nodes dealt out by it still are
    types = [t for t in _types() if t[0] != "doc_id"]
    old = F.array(F.struct(*[moved.get(n, F.col(n)).cast(sc_type).alias(n) for n, sc_type in types]))
    if not size:
        return places(found.select("doc_id", F.inline(old)))
    deeper = F.col("depth") + (1 if action == "append" else 0)
    changed = {"node_id": lambda x: F.col("new_") + x["node_id"] - 1, "last_id": lambda x: F.col("new_") + x["last_id"] - 1, "depth": lambda x: deeper + x["depth"] - 1, "is_root": lambda x: F.when(x["node_type"] == 1, F.lit(False)),
               "parent_id": lambda x: F.when(x["parent_id"] == 0, F.col("up_")).otherwise(F.col("new_") + x["parent_id"] - 1)}
    new = F.transform(_literal(fragment), lambda x: F.struct(*[changed.get(n, lambda x, n=n: x[n])(x).cast(t).alias(n) for n, t in types]))
    return places(found.select("doc_id", F.inline(F.when(inserted, new).otherwise(old))))


def _types() -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in _split(sc.NODES_SQL)]


def clones(nodes: DataFrame, tops: DataFrame, deep: bool = True) -> DataFrame:
    """Copies of elements (doc_id, node_id, last_id), each as a document of its own: (clone_of, and the columns of nodes).

    clone_of is the number the element had; in the copy it has number 0 and no parent, and the numbers of nodes below it are
    moved by as much. Namespaces, attributes and templates' contents come along. deep=False copies elements without children."""
    t = tops.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("clone_of"), F.col("last_id").alias("t_last"))
    inside = F.col("node_id").between(F.col("clone_of"), F.col("t_last")) if deep else F.col("node_id") == F.col("clone_of")
    met = nodes.join(t, (F.col("doc_id") == F.col("t_doc")) & inside)
    top = F.col("node_id") == F.col("clone_of")
    level = F.min("depth").over(Window.partitionBy("doc_id", "clone_of"))
    moved = {
        "node_id": F.col("node_id") - F.col("clone_of"), "parent_id": F.when(~top, F.col("parent_id") - F.col("clone_of")), "last_id": (F.col("last_id") if deep else F.col("node_id")) - F.col("clone_of"),
        "prev_el": F.when(~top, F.col("prev_el") - F.col("clone_of")), "depth": F.col("depth") - level, "is_empty": F.col("is_empty") if deep else F.lit(True), "is_root": F.when(top, F.lit(False)).otherwise(F.col("is_root")),
        **{n: F.when(top, 1).otherwise(F.col(n)) for n in ("el_idx", "el_cnt", "ty_idx", "ty_cnt")},
    }
    return met.select("clone_of", *[moved.get(n, F.col(n)).cast(t).alias(n) for n, t in _types()])
