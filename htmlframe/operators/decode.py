"""Bytes of pages to text in expressions of the JVM.

A hint, a byte order mark, a plain meta element with a charset at the begin of a page, or the absence of any meta element say
the encoding; UTF-8 that is valid, UTF-16 without surrogates, and the encodings of one byte are decoded there. Only the rows
left over, where the search for a meta element needs its whole rules or bytes don't fit, go through Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from htmlframe.functions import encodings as enc
from htmlframe.operators.parse import bound_batches
from htmlframe.session import ship

#: A page up to and with a meta element that declares its charset and nothing else: tags before it have no quotes, and none is a
#: comment or another meta element.
_PLAIN_META = r"""(?is)^(?:[^<]++|</?+(?!meta)[a-z]++[^<>"']*+>|<!(?!--)[^<>"']*+>)*+<meta[\t\n\f\r ]++charset=(?:"([^"<>]*+)"|'([^'<>]*+)'|([^\t\n\f\r "'<>]++))[\t\n\f\r ]*+/?>"""
#: Encodings whose bytes are decoded one by one.
ONE_BYTE = [n for n in enc.LABELS if not n.lower().startswith("utf")]
_HIGH = "".join(map(chr, range(0x80, 0x100)))


def _declared(head: Column) -> Column:
    """Canonical name that a plain meta element declares, null for none or an unknown one."""
    label = F.lower(F.trim(F.concat(*[F.regexp_extract(head, _PLAIN_META, i) for i in (1, 2, 3)])))
    named = F.lit(None).cast("string")
    for name, labels in enc.LABELS.items():
        named = F.when(label.isin(*labels.split()), "UTF-8" if name.startswith("utf-16") else name).otherwise(named)
    return named


def _bytes_as(name: str, latin: Column) -> Column:
    """Text in an encoding of one byte, or of none that is decoded, from the bytes as signs U+0000 to U+00FF."""
    if name == "euc-jp":
        return F.regexp_replace(latin, "[\\x{80}-\\x{ff}]{1,2}", "�")
    return F.translate(latin, _HIGH, "".join(enc.decode_as(bytes([b]), name) for b in range(0x80, 0x100)))


def sorted_bytes(df: DataFrame, hint: str | None = None, id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """(doc_id, encoding, body, content, fits): the bytes behind a mark, and whether expressions can decode them."""
    known = enc.by_label(hint)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content"))
    mark = F.lit(None).cast("string")
    for begin, name in reversed(enc.BOMS):
        mark = F.when(F.substring("content", 1, len(begin)) == F.lit(begin), name).otherwise(mark)
    head = F.decode(F.substring("content", 1, enc.MOST_SEARCHED), "ISO-8859-1")
    no_meta = ~F.contains(F.lower(F.decode(F.substring("content", 1, enc.MOST_BYTES), "ISO-8859-1")), F.lit("<meta"))
    said = F.lit(known) if known else F.coalesce(mark, _declared(head), F.when(no_meta, "windows-1252"))
    # generators of one row keep what is asked for often from being worked out as often
    named = rows.select("doc_id", "content", F.inline(F.array(F.struct(mark.alias("mark"), said.alias("encoding")))))
    length = F.when(F.col("mark") == "UTF-8", 3).when(F.col("mark").isNotNull(), 2).otherwise(0)
    body = named.select("doc_id", "encoding", F.when(length > 0, F.substring(F.col("content"), length + 1, F.octet_length("content"))).otherwise(F.col("content")).alias("body"), "content")
    latin = F.decode("body", "ISO-8859-1")
    text = F.col("body").cast("string")
    fits = (
        F.when(F.col("encoding") == "UTF-8", F.is_valid_utf8(text))
        .when(F.col("encoding") == "utf-16le", (F.octet_length("body") % 2 == 0) & latin.rlike(r"(?s)^(?:.[^\x{D8}-\x{DF}])*+$"))
        .when(F.col("encoding") == "utf-16be", (F.octet_length("body") % 2 == 0) & latin.rlike(r"(?s)^(?:[^\x{D8}-\x{DF}].)*+$"))
        .otherwise(F.col("encoding").isin(*ONE_BYTE))
    )
    return body.select("*", F.explode(F.array(F.coalesce(fits, F.lit(False)))).alias("fits"))


def decode_bytes(df: DataFrame, hint: str | None = None, id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """(doc_id, html, encoding) of pages in bytes, as encodings.decode() gives them. Null pages are empty."""
    spark, checked = df.sparkSession, sorted_bytes(df, hint, id_col, content_col)
    latin, text = F.decode("body", "ISO-8859-1"), F.col("body").cast("string")
    html = F.when(F.col("encoding") == "UTF-8", text).when(F.col("encoding") == "utf-16le", F.decode("body", "UTF-16LE")).when(F.col("encoding") == "utf-16be", F.decode("body", "UTF-16BE"))
    for name in ONE_BYTE:
        html = html.when(F.col("encoding") == name, _bytes_as(name, latin))
    done = checked.where("fits").select("doc_id", html.alias("html"), "encoding")
    ship(spark)
    bound_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("encoding", pa.string())])

    def run(batches):
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = enc.decode(content.as_py(), hint)
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip((key, *found), schema, strict=True)], schema)

    return done.union(checked.where("not fits").select("doc_id", "content").mapInArrow(run, "doc_id bigint, html string, encoding string"))
