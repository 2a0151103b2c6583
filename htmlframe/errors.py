"""Errors of pages as text and as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from htmlframe.functions.selectors import SelectorError
from htmlframe.functions.token_html import TokenError
from htmlframe.functions.tokens import MESSAGES

__all__ = ["MESSAGES", "SelectorError", "TokenError", "error_rows", "format_error", "message"]


def message(code: str) -> str:
    return MESSAGES.get(code, "Unknown error")


def format_error(e: Column) -> Column:
    """A struct (code, message, line, col) as "code at line:col: message"."""
    return F.concat(e["code"], F.lit(" at "), e["line"].cast("string"), F.lit(":"), e["col"].cast("string"), F.lit(": "), e["message"])


def error_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, code, message, line, col, text) of a table of docs."""
    return docs.select("doc_id", F.posexplode("errors").alias("pos", "e")).select("doc_id", "pos", "e.*", format_error(F.col("e")).alias("text"))
