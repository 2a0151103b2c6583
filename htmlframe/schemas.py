"""Schemas of the tables that the operators make, for Spark and, field by field the same, for Arrow."""

from __future__ import annotations

import pyarrow as pa

ATTR = pa.struct([("ns", pa.string()), ("name", pa.string()), ("value", pa.string())])
ERROR = pa.struct([("code", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
ATTRS_SQL = "array<struct<ns:string,name:string,value:string>>"

NODES = pa.schema([
    ("doc_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_id", pa.int32()), ("depth", pa.int32()), ("node_type", pa.int8()), ("tag", pa.string()), ("ns", pa.string()),
    ("attrs", pa.list_(ATTR)), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("data", pa.string()), ("in_template", pa.bool_()), ("el_idx", pa.int32()), ("el_cnt", pa.int32()),
    ("ty_idx", pa.int32()), ("ty_cnt", pa.int32()), ("prev_el", pa.int32()), ("is_empty", pa.bool_()), ("is_root", pa.bool_()),
])
NODES_SQL = (
    "doc_id bigint, node_id int, parent_id int, last_id int, depth int, node_type tinyint, tag string, ns string, attrs array<struct<ns:string,name:string,value:string>>, id string, classes array<string>,"
    " data string, in_template boolean, el_idx int, el_cnt int, ty_idx int, ty_cnt int, prev_el int, is_empty boolean, is_root boolean"
)
DOCS = pa.schema([("doc_id", pa.int64()), ("doctype", pa.struct([("name", pa.string()), ("public_id", pa.string()), ("system_id", pa.string())])), ("quirks_mode", pa.int32()), ("n_nodes", pa.int32()), ("title", pa.string()), ("errors", pa.list_(ERROR))])
DOCS_SQL = "doc_id bigint, doctype struct<name:string,public_id:string,system_id:string>, quirks_mode int, n_nodes int, title string, errors array<struct<code:string,message:string,line:int,col:int>>"
TOKENS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("data", pa.string()), ("attrs", pa.list_(ATTR)), ("self_closing", pa.bool_()), ("public_id", pa.string()), ("system_id", pa.string()), ("force_quirks", pa.bool_())])
TOKENS_SQL = "doc_id bigint, pos int, kind string, name string, data string, attrs array<struct<ns:string,name:string,value:string>>, self_closing boolean, public_id string, system_id string, force_quirks boolean"
EVENTS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("data", pa.string()), ("public_id", pa.string()), ("system_id", pa.string())])
EVENTS_SQL = "doc_id bigint, pos int, type string, name string, attrs map<string,string>, data string, public_id string, system_id string"
MATCHES = pa.schema([("doc_id", pa.int64()), ("selector", pa.string()), ("idx", pa.int32()), ("node_id", pa.int32()), ("tag", pa.string()), ("attrs", pa.list_(ATTR)), ("text", pa.string()), ("output", pa.string())])
MATCHES_SQL = "doc_id bigint, selector string, idx int, node_id int, tag string, attrs array<struct<ns:string,name:string,value:string>>, text string, output string"
TABLES = pa.schema([("doc_id", pa.int64()), ("table_idx", pa.int32()), ("row_idx", pa.int32()), ("is_header", pa.bool_()), ("cells", pa.list_(pa.string()))])
TABLES_SQL = "doc_id bigint, table_idx int, row_idx int, is_header boolean, cells array<string>"
RECORDS = pa.schema([("doc_id", pa.int64()), ("selector", pa.string()), ("n", pa.int32()), ("matches", pa.list_(pa.struct([("html", pa.string()), ("text", pa.string()), ("tree", pa.string())])))])
RECORDS_SQL = "doc_id bigint, selector string, n int, matches array<struct<html:string,text:string,tree:string>>"
ERRORS = pa.schema([("doc_id", pa.int64()), ("errors", pa.list_(ERROR))])
ERRORS_SQL = "doc_id bigint, errors array<struct<code:string,message:string,line:int,col:int>>"
