"""Document operations on a table of nodes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\r\\f]+"


def attr(name: str, attrs: str = "attrs") -> Column:
    """Value of an attribute without namespace, null if there is none. Names match without regard to case."""
    return F.get(F.filter(attrs, lambda a: (a["ns"] == "") & (F.lower(a["name"]) == name.lower())), F.lit(0))["value"]


def attr_ns(ns: str, name: str, attrs: str = "attrs") -> Column:
    """Value of an attribute of a namespace, such as ("http://www.w3.org/1999/xlink", "xlink:href"); null if there is none."""
    return F.get(F.filter(attrs, lambda a: (a["ns"] == ns) & (a["name"] == name)), F.lit(0))["value"]


def with_attr_ns(ns: str, name: str, value: Column | str) -> Column:
    """attrs with one attribute of a namespace set, others left alone: at the end, if it is new."""
    value = F.lit(value) if isinstance(value, str) else value
    same = lambda a: (a["ns"] == ns) & (a["name"] == name)
    fresh = F.struct(F.lit(ns).alias("ns"), F.lit(name).alias("name"), value.alias("value"))
    return F.when(F.exists("attrs", same), F.transform("attrs", lambda a: F.when(same(a), fresh).otherwise(a))).otherwise(F.concat(F.col("attrs"), F.array(fresh)))


def without_attr_ns(ns: str, name: str) -> Column:
    return F.filter("attrs", lambda a: ~((a["ns"] == ns) & (a["name"] == name)))


def attribute_text(attrs: Column) -> Column:
    """Attributes as they are written in a start tag."""
    return F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), F.replace(F.replace(a["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")


def has_children() -> Column:
    """Whether a node of a table of nodes has any below it."""
    return F.col("last_id") > F.col("node_id")


def attribute_rows(nodes: DataFrame) -> DataFrame:
    """One row for each attribute: (doc_id, node_id, ns, name, value)."""
    return nodes.where("node_type = 1").select("doc_id", "node_id", F.inline("attrs"))


def attribute_map() -> Column:
    """Attributes without namespace as a map."""
    return F.map_from_entries(F.transform(F.filter("attrs", lambda a: a["ns"] == ""), lambda a: F.struct(a["name"], a["value"])))


def with_attr(name: str, value: Column | str) -> Column:
    """attrs with one attribute set: changed where it is, or added at the end."""
    value = F.lit(value) if isinstance(value, str) else value
    same = lambda a: (a["ns"] == "") & (F.lower(a["name"]) == name.lower())
    fresh = F.struct(F.lit("").alias("ns"), F.lit(name).alias("name"), value.alias("value"))
    changed = F.transform("attrs", lambda a: F.when(same(a), F.struct(a["ns"].alias("ns"), a["name"].alias("name"), value.alias("value"))).otherwise(a))
    return F.when(F.exists("attrs", same), changed).otherwise(F.concat(F.col("attrs"), F.array(fresh)))


def without_attr(name: str) -> Column:
    return F.filter("attrs", lambda a: ~((a["ns"] == "") & (F.lower(a["name"]) == name.lower())))


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of (doc_id, node_id), with their parent as node parent_id."""
    up = parents.select("doc_id", F.col("node_id").alias("parent_id"))
    return nodes.join(up, ["doc_id", "parent_id"], "left_semi")


def subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes at and below (doc_id, node_id, last_id)."""
    t = tops.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("t_first"), F.col("last_id").alias("t_last"))
    return nodes.join(t, (F.col("doc_id") == F.col("t_doc")) & F.col("node_id").between(F.col("t_first"), F.col("t_last")), "left_semi")


def without(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes that aren't at or below (doc_id, node_id, last_id): those elements are removed."""
    t = tops.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("t_first"), F.col("last_id").alias("t_last"))
    return nodes.join(t, (F.col("doc_id") == F.col("t_doc")) & F.col("node_id").between(F.col("t_first"), F.col("t_last")), "left_anti")


def text_of(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of elements: the data of text below them in document order, templates left out."""
    texts = nodes.where("node_type = 3 and not in_template").select(F.col("doc_id").alias("x_doc"), F.col("node_id").alias("x_id"), "data")
    t = tops.select("doc_id", "node_id", "last_id")
    met = t.join(texts, (F.col("doc_id") == F.col("x_doc")) & (F.col("x_id") > F.col("node_id")) & (F.col("x_id") <= F.col("last_id")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("x_id").isNotNull(), F.struct("x_id", "data"))))
    return met.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(parts, lambda p: p["data"]), "").alias("text"))


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def first_of(matches: DataFrame) -> DataFrame:
    """The first match of each document."""
    order = Window.partitionBy("doc_id").orderBy("node_id")
    return matches.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def section(nodes: DataFrame, name: str) -> DataFrame:
    """Head or body of each document: the first child of the root with that name."""
    root = first_of(nodes.where("node_type = 1 and is_root and not in_template"))
    found = nodes.where((F.col("node_type") == 1) & (F.col("tag") == name)).join(root.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    return first_of(found)


def titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, title): text of the first title directly in the head, as it is."""
    head = section(nodes, "head")
    found = first_of(nodes.where("node_type = 1 and tag = 'title'").join(head.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi"))
    return text_of(nodes, found).select("doc_id", F.col("text").alias("title"))


def siblings(nodes: DataFrame) -> DataFrame:
    """Elements with the element before and after them, worked out by windows over their parents' children."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    return nodes.where("node_type = 1").select("doc_id", "parent_id", "node_id", "tag", F.row_number().over(order).alias("place"), F.lag("node_id").over(order).alias("before"), F.lead("node_id").over(order).alias("after"))
