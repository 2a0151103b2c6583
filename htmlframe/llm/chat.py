r"""Chat formatting with a grammar round trip, in DataFrame functions only.

The grammar of a conversation, after which each text has one reading:

    conversation = { turn } ;  turn = "### " role ": " text "</turn>" newline

The parser cuts at "</turn>" and a newline, takes the role up to the first ": ", and undoes escapes: backslash
with h, l, c or another backslash stands for #, <, a colon or a backslash. It rejects output in which a marker stands anywhere
else. Formatting renders each turn plainly, reparses it and compares; while the turn read back differs from the source, it
renders the turn again with more escapes: first of the characters that begin markers, then of backslashes too, which
always gives the source back. So texts without conflicts stay as they are.

A null text or role counts as empty. A null conversation id is a conversation of its own. Turns come in the order of
turn (null first); equal turns, and repeated rows, all stay, ordered by role and text. Texts of any length are taken whole, by
functions that read them a fixed number of times. An empty table has no rows. Only the columns named are read, so other columns and
their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from htmlframe.llm.common import table

HEAD, SPLIT, END = "### ", ": ", "</turn>"
NEWLINE = "\n"
MASKED_ROLE = "assistant"


def escape(c: Column, level: int) -> Column:
    """Level 0: as it is; 1: the characters that begin markers; 2: backslashes too."""
    if level >= 2:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    if level >= 1:
        c = F.replace(F.replace(c, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return c


def escape_role(c: Column) -> Column:
    return F.replace(escape(c, 2), F.lit(":"), F.lit("\\c"))


def unescape(c: Column) -> Column:
    """Undo escapes in one reading: pairs of backslashes are cut out first, so each escape is seen once."""
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\c"), F.lit(":")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    some = F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")
    return F.when(F.contains(c, F.lit("\\")), some).otherwise(c)


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(HEAD), escape_role(role), F.lit(SPLIT), escape(text, level), F.lit(END + NEWLINE))


def parse(formatted: Column) -> Column:
    """Turns of formatted text, array<struct<role, text, raw_length, head_length>>; null if the grammar doesn't hold."""
    pieces = F.split(formatted, END + NEWLINE, -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        at = F.locate(SPLIT, p)
        return F.struct(
            unescape(F.substring(p, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))).alias("role"),
            unescape(F.substring(p, at + F.lit(len(SPLIT)), F.char_length(p))).alias("text"),
            F.char_length(p).alias("raw_length"),
            (at + F.lit(len(SPLIT) - 1)).alias("head_length"),
        )

    def wrong(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(HEAD) + 1), F.char_length(p))
        return ~F.startswith(p, F.lit(HEAD)) | (F.locate(SPLIT, p) == 0) | F.contains(rest, F.lit("###")) | F.contains(p, F.lit(END))

    ok = (F.element_at(pieces, -1) == "") & ~F.exists(bodies, wrong)
    return F.when(ok, F.transform(bodies, turn))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (id, formatted, loss_spans, turns, round_trip) for each conversation.

    loss_spans: (start, length) in code points of each assistant text in formatted, still escaped there; turns: role and
    text of each turn as the parser reads them from formatted; round_trip: whether they are the source's.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    source = rows.select(F.col(conv_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))

    def reads_back(level: int) -> Column:
        got = parse(render(F.col("role"), F.col("text"), level))
        one = F.element_at(got, 1)
        return F.coalesce((F.size(got) == 1) & (one["role"] == F.col("role")) & (one["text"] == F.col("text")), F.lit(False))

    level = F.when(reads_back(0), 0).when(reads_back(1), 1).otherwise(2)
    own = lambda level: render(F.col("role"), F.col("text"), level)
    rendered = source.withColumn("level", level).select("id", "turn", "role", "text", F.when(F.col("level") == 0, own(0)).when(F.col("level") == 1, own(1)).otherwise(own(2)).alias("piece"))
    order = Window.partitionBy("id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rendered.withColumn("before", F.sum(F.char_length("piece").cast("long")).over(order) - F.char_length("piece")).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("turn", "role", "text")))
    joined = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "before", "role", "text", "piece"))).alias("all"))
    formatted = F.array_join(F.col("all.piece"), "")
    out = joined.select("id", "all", formatted.alias("formatted")).select("id", "all", "formatted", parse(F.col("formatted")).alias("read"))
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("all.before").alias("before"), F.col("read").alias("read")), lambda z: z["read"]["role"] == MASKED_ROLE),
        lambda z: F.struct((z["before"] + z["read"]["head_length"]).alias("start"), (z["read"]["raw_length"] - z["read"]["head_length"]).cast("long").alias("length")),
    )
    same = F.coalesce((F.col("read.role") == F.col("all.role")) & (F.col("read.text") == F.col("all.text")), F.lit(False))
    return out.select("id", "formatted", spans.alias("loss_spans"), F.transform("read", lambda t: F.struct(t["role"], t["text"])).alias("turns"), same.alias("round_trip"))


def query(spark, sf_dir):
    """Every conversation and one full of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = format_conversations(rows.unionByName(hard))
    # a conversation that doesn't read back is an error, not a row
    out = out.withColumn("formatted", F.when(F.col("round_trip"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation doesn't read back: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # what is under the mask, cut out of the output and unescaped
    loss = F.array_join(F.transform("loss_spans", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return out.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The escapes of a text follow from what it holds, which SQL can say directly.
ORACLE = r"""
WITH s AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (
  SELECT *, CASE
    WHEN NOT (contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\\') OR contains(text, '\h') OR contains(text, '\l') OR contains(text, '\c')) THEN 0
    WHEN NOT (contains(text, '\\') OR contains(text, '\h') OR contains(text, '\l') OR contains(text, '\c') OR contains(text, '\#') OR contains(text, '\<')) THEN 1 ELSE 2 END AS level FROM s),
p AS (
  SELECT *, 4 + length(role) + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))) + 2 + length(text) + 8
    + CASE WHEN level >= 1 THEN length(text) - length(replace(replace(text, '#', ''), '<', '')) ELSE 0 END
    + CASE WHEN level = 2 THEN length(text) - length(replace(text, '\', '')) ELSE 0 END AS n FROM l)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
