r"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words (what stands between white space). Two lines match if their Jaccard likeness is THRESHOLD
or more, and a line that matches an earlier one (by id, then text, then place in the text) is removed, whether that one
stays or not. Lines of fewer than min_words different words (1 by default: blank lines) are left alone.

1. The words of all lines are counted in BUCKETS hash buckets; the rarer its bucket, the earlier a word stands in a line.
2. Each line becomes numbers of its words, rarest first. Of these a table keeps the prefix, |x| - ceil(t|x|) + 1 words,
   a parity bitmap, and a 128-bit digest of the set. Equal sets collapse to the earliest line; the others are removed.
3. Lines that match share a word of their prefixes. Lines are joined on these under the length filter, the positional
   filter (what can still be shared after the word's places) and the bitmap filter (words that differ in two sets flip at
   least as many bits). Where prefixes are long enough to tell, a pair must share up to MOST_SHARED of their words. Numbers
   that two words have in common make pairs here, but lose none.
4. Of the lines of pairs that are left, a bitmap of 64 * WIDE bits is made from their texts; what passes the bitmap filter on
   these, too, is verified on the words themselves. Only these pairs meet their texts.

Dense groups of like lines don't make all their pairs: before the join, lines are verified against a few early ones of
those with the same two neighbouring prefix words, in rounds, wherever more than DENSE lines have these, and a line that
this removes takes part in the join only as an earlier one.

Null texts have no lines and stay null; empty texts stay empty. Rows with the same id and text are one document for the
order, and lose the same lines. A null id comes first. Lines of any length are compared as wholes. Of an empty table
nothing is left to do. Only the id and text columns are read; dedup_lines() keeps the others, whatever their names, but
columns n_lines and n_removed that the table has give way to those of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import cut, kept, release, table

THRESHOLD, MIN_WORDS = 0.8, 1
#: Buckets of the counts that give the order of words: a table of as many small numbers, whatever the corpus' size.
BUCKETS = 1 << 19
#: Two neighbouring prefix words of more lines are dense: these lines are first compared with HEADS of them in each round.
DENSE, HEADS, ROUNDS = 16, 4, 3
#: So many words at most must be shared by the prefixes of a pair, if they are long enough to tell.
MOST_SHARED = 3
#: Prefixes of more words are looked for in dense groups by every other two neighbouring words.
WHOLE = 8
#: Sides of at most this many rows of a few numbers, some 20 MB, are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Parts of the words that are joined one after another, so that less is on disk at a time.
SLICES = 2
#: 64-bit numbers of the bitmap that pairs must pass before they meet their texts: lines of hundreds of words fill one of 64 bits.
WIDE = 4
#: Added to what stands after a word if its line looks for no others.
DONE = 1 << 28

#: White space inside a line, besides the blank.
SPACES = "\t\x0b\f\r"
WORDS = "array_remove(split(line, ' '), '')"


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpointed table, marked for broadcast if its counted rows (or the numbers it holds, if given) are few."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= MOST_BROADCAST else df


def _spaced() -> Column:
    """The text with blanks for all white space but line ends."""
    other = F.expr(" or ".join(f"contains(text, chr({ord(c)}))" for c in SPACES))
    return F.when(other, F.translate("text", SPACES, " " * len(SPACES))).otherwise(F.col("text"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, ln, line) of lines that aren't blank: th tells apart texts of the same id. In line, blanks stand for all
    white space."""
    hashed = _texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))  # before the rows of lines, which carry no text then
    split = hashed.select("doc", "th", F.posexplode(F.split(_spaced(), "\n", -1)).alias("ln", "line"))
    return split.where("trim(line) <> ''")


def hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, ln, h) of each line that isn't blank: h holds the hashes of its different words."""
    return lines(docs, id_col, text_col).select("doc", "th", "ln", F.expr(f"array_distinct(transform({WORDS}, x -> xxhash64(x)))").alias("h"))


def rarity(hashed: DataFrame) -> Column:
    """array<bigint> of BUCKETS numbers whose top 16 bits are the logarithm of how many lines hold the words of a hash bucket."""
    counts = hashed.select(F.explode("h").alias("x")).select(F.expr(f"cast(x & {BUCKETS - 1} as int)").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = counts.union(hashed.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n")))
    classes = every.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.expr("shiftleft(cast(500D * log2(1D + n) as bigint), 48)").alias("class"))
    return cut(classes.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "class"))), lambda x: x["class"]).alias("classes"))).scalar()


def hashed_lines(hashed: DataFrame, t: float) -> DataFrame:
    """(doc, th, ln, n, sig, sig2, bits, prefix) of each line."""
    # every bucket has a class, so numbers can't be null and are sorted as such, not as objects
    number = f"x -> classes[x & {BUCKETS - 1}] | shiftrightunsigned(x, 16)"
    coded = hashed.withColumn("classes", rarity(hashed)).select("doc", "th", "ln", F.expr(f"sort_array(transform(h, {number}))").alias("s"))
    return coded.select("doc", "th", "ln", F.size("s").alias("n"), F.xxhash64("s").alias("sig"), F.xxhash64(F.lit(1), "s").alias("sig2"), F.expr("aggregate(s, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))").alias("bits"), F.slice("s", 1, F.expr(f"cast(size(s) - ceil({t}D * size(s) - 1e-9D) + 1 as int)")).alias("prefix"))


def _near(t: float) -> str:
    """Length and bitmap filters for two lines x and y of different sets (n, bits): the words in one set only are at most d,
    so no lower bound of them may exceed it."""
    d = _apart(t)
    return f"bit_count(x.bits ^ y.bits) <= {d} and greatest(abs(x.n - y.n), 2 - abs(x.n - y.n)) <= {d}"


def _apart(t: float) -> str:
    return f"({(1 - t) / (1 + t)!r}D * (x.n + y.n) + 1e-9D)"


def _first(t: float, left: str, right: str) -> str:
    """Positional filter for the first word that x and y share, given the words after it."""
    return f"x.n + y.n - 2 - 2 * least({left}, {right}) <= {_apart(t)}"


def _needed(t: float) -> str:
    """How many shared words are asked for, at most MOST_SHARED: with o the least number that matching lines share, the first
    n - o + k words of both share k at least, for what is shared after those of the line whose part ends first is o - k at
    most. Prefixes are long enough for some k only, the fewer the less alike the lines' lengths are."""
    least = lambda n: f"cast(ceil({t}D * {n} - 1e-9D) as int)"
    return f"least({MOST_SHARED}, {_shared(t)} + 1 - greatest({least('x.n')}, {least('y.n')}))"


def _shared(t: float) -> str:
    return f"cast(ceil({t / (1 + t)!r}D * (x.n + y.n) - 1e-6D) as int)"


#: From the hashes of a line's words, their number and a parity bitmap of WIDE numbers.
_MARKS = f"h -> struct(size(h) as n, transform(sequence(0, {WIDE - 1}), k -> aggregate(filter(h, x -> (shiftright(x, 6) & {WIDE - 1}) = k), 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))) as wide)"


def _said(ends: DataFrame, first: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(line, at, said, n, wide) of the lines of ends (line), a checkpointed table: what they say and their bitmaps.

    Only the texts that hold them are split again."""
    ends = _small(ends)
    held = kept(first.join(ends, "line").groupBy(F.col("doc").alias("doc_"), F.col("th").alias("th_")).agg(F.collect_list(F.struct("ln", F.col("line").alias("number"))).alias("at")), "held")
    near = _small(held, held.agg(F.sum(F.size("at"))).first()[0] or 0)
    texts = _texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    met = texts.join(near, (F.col("th") == F.col("th_")) & F.col("doc").eqNullSafe(F.col("doc_")))
    # a text is split once, and only the lines asked for leave it
    asked = F.transform(F.array(F.split(_spaced(), "\n", -1)), lambda parts: F.transform("at", lambda p: F.struct(p["number"].alias("line"), p["ln"].alias("ln"), F.get(parts, p["ln"]).alias("said"))))
    said = met.select("doc", "th", F.inline(F.get(asked, F.lit(0)))).select("line", F.struct("doc", "th", "ln").alias("at"), "said")
    said = kept(said.select("*", F.inline(F.expr(f"transform(array(transform(array_distinct({WORDS.replace('line', 'said')}), x -> xxhash64(x))), {_MARKS})"))), "said")
    if said.count() > ends.count():  # rows with the same id and text
        once = kept(said.dropDuplicates(["line"]), "said")
        release(said)
        said = once
    release(held)
    return said


def matches(pairs: DataFrame, first: DataFrame, docs: DataFrame, id_col: str, text_col: str, t: float, known: DataFrame | None = None) -> DataFrame:
    """(line) of the later lines of those pairs (line, other) that match. first: (line, doc, th, ln) of each line. known: what
    _said() gives for these lines, if it was asked for before."""
    pairs = cut(pairs.select("line", "other").distinct())
    if pairs.isEmpty():
        return pairs.select("line")
    said = known or _said(cut(pairs.select("line").union(pairs.select("other")).distinct()), first, docs, id_col, text_col)
    marks = said.select("line", "n", "wide")
    both = pairs.join(marks.toDF("line", "n1", "wide1"), "line").join(marks.toDF("other", "n2", "wide2"), "other")
    flips = " + ".join(f"bit_count(wide1[{k}] ^ wide2[{k}])" for k in range(WIDE))
    pairs = cut(both.where(f"{flips} <= {(1 - t) / (1 + t)!r}D * (n1 + n2) + 1e-9D").select("line", "other"))
    # only what the lines of these pairs say is moved
    left = _small(cut(pairs.select("line").union(pairs.select("other")).distinct()))
    said_of = said.join(left, "line", "left_semi").select("line", "at", "n", "said")
    a, b = said_of.toDF("line", "at1", "n1", "said1"), said_of.toDF("other", "at2", "n2", "said2")
    words = lambda c: f"array_remove(split({c}, ' '), '')"

    def later(some: DataFrame) -> DataFrame:
        both = some.join(a, "line").join(b, "other").select("line", "other", "at1", "at2", F.expr("n1 + n2").alias("n"), F.expr(words("said1")).alias("w1"), F.expr(words("said2")).alias("w2"))
        like = both.withColumn("shared", F.size(F.array_intersect("w1", "w2"))).where(F.expr(f"shared >= {t}D * (n - shared) - 1e-9D"))
        return cut(like.select(F.when(F.col("at1") < F.col("at2"), F.col("other")).otherwise(F.col("line")).alias("line")).distinct())

    # one other line of each first; only lines that it doesn't remove are compared with all others
    found = later(pairs.groupBy("line").agg(F.min("other").alias("other")))
    found = cut(found.union(later(pairs.join(_small(found), "line", "left_anti"))).distinct())
    if known is None:
        release(said)
    return found


def _neighbours(able: DataFrame, *keep: str | Column) -> DataFrame:
    """(keep, p, word): hashes of each two neighbouring words of a prefix, or of its only word. Prefixes of more than WHOLE words
    give every other one, chosen by its hash: like lines have most in common, and what is missed here meets in the join."""
    two = able.select(*keep, F.size("prefix").alias("long_"), F.posexplode(F.arrays_zip("prefix", F.expr("slice(prefix, 2, size(prefix))").alias("next"))).alias("p", "two_")).where("p = 0 or p < long_ - 1")
    hashed = two.withColumn("word", F.xxhash64("two_.prefix", "two_.next")).where(f"long_ <= {WHOLE} or word & 1 = 0")
    return hashed.drop("long_", "two_")


def _gone_in_groups(able: DataFrame, first: DataFrame, docs: DataFrame, id_col: str, text_col: str, t: float) -> DataFrame:
    """(line) of lines in dense groups that match an earlier one of the lines they are compared with."""
    dense = cut(_neighbours(able).groupBy("word").agg(F.count("*").alias("lines")).where(F.col("lines") > DENSE).select("word"))
    gone = cut(first.select("line").limit(0))
    if dense.isEmpty():
        return gone
    rows = _neighbours(able, "line", "doc", "n", "bits").join(_small(dense), "word")
    rows = kept(rows.select("word", F.struct("doc", "line", "n", "bits", F.expr("n - p - 1").alias("after")).alias("x"), F.pmod("line", F.lit(HEADS * ROUNDS)).alias("part")), "dense")
    # the texts are read once for all rounds
    said = _said(cut(rows.select("x.line").distinct()), first, docs, id_col, text_col)
    for number in range(ROUNDS):
        heads = rows.where(F.col("part").between(number * HEADS, (number + 1) * HEADS - 1)).groupBy("word", "part").agg(F.min("x").alias("y")).select("word", "y")
        left = rows.join(_small(gone.select(F.col("line").alias("gone"))), F.col("x.line") == F.col("gone"), "left_anti")
        near = left.join(heads, "word").where("x.line <> y.line").where(f"{_near(t)} and {_first(t, 'x.after', 'y.after')}")
        gone = cut(gone.union(matches(near.select(F.col("x.line").alias("line"), F.col("y.line").alias("other")), first, docs, id_col, text_col, t, said)).distinct())
    release(rows, said)
    return gone


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, ln) of the lines to remove."""
    t = threshold
    hashed = kept(hashes(docs, id_col, text_col), "hashes")
    held = kept(hashed_lines(hashed, t), "lines")
    release(hashed)
    every = held.where(F.col("n") >= min_words)
    grouped = every.select("sig", "sig2", F.struct("doc", "th", "ln").alias("at"), F.struct("n", "bits", "prefix").alias("payload")).groupBy("sig", "sig2").agg(F.min("at").alias("at"), F.first("payload").alias("payload"), F.count("*").alias("copies"))
    first = kept(grouped.select(F.monotonically_increasing_id().alias("line"), "sig", "sig2", "copies", "at.*", "payload.*"), "sets")

    # lines so short that one word more makes them unlike match equal sets only, which have collapsed
    able = first.where(F.expr(f"n >= {t}D * (n + 1) - 1e-9D")).withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63))))
    gone = _gone_in_groups(able, first, docs, id_col, text_col, t)

    # the prefix join; a line that is gone already looks for no earlier one. Both sides are the same rows, shuffled once
    marked = able.join(_small(gone.select(F.col("line").alias("gone"))), F.col("line") == F.col("gone"), "left")
    rows = marked.select("line", "doc", "n", "bits", F.when(F.col("gone").isNull(), 0).otherwise(DONE).alias("done"), F.posexplode("prefix").alias("p", "word"))
    rows = rows.select("word", "line", "doc", "n", F.expr("n - p - 1 + done").alias("after"), "bits")
    # what is asked of x alone is put to both sides, else it would be asked of one before the shuffle and the sides differ
    earlier = f"x.word = y.word and x.after < {DONE} + y.after - y.after and y.doc <= x.doc and x.line <> y.line"
    after = f"(y.after & {DONE - 1})"
    pairs = None
    for number in range(SLICES):
        part = rows.where(F.pmod("word", F.lit(SLICES)) == number)
        met = part.alias("x").join(part.alias("y"), F.expr(f"{earlier} and {_near(t)} and least(x.after, {after}) >= {_shared(t)} - {_needed(t)}"))
        met = met.select(F.col("x.line").alias("line"), F.col("y.line").alias("other"), F.expr(_needed(t)).alias("needed"))
        met = cut(met.groupBy("line", "other").agg(F.count("*").alias("shared"), F.max("needed").alias("needed")))
        pairs = met if pairs is None else pairs.union(met)
    # words of a pair are counted over all slices
    likely = pairs.groupBy("line", "other").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed")).where("shared >= needed")
    out = cut(gone.union(matches(likely, first, docs, id_col, text_col, t)).distinct())

    # copies of the earliest line with a set, and earliest lines that match an earlier one
    lost = first.join(_small(out.select(F.col("line").alias("gone"))), F.col("line") == F.col("gone"), "left").where("copies > 1 or gone is not null")
    fates = cut(lost.select("sig", "sig2", F.struct("doc", "th", "ln").alias("first_at"), F.col("gone").isNotNull().alias("gone")))
    placed = every.select("sig", "sig2", "doc", "th", "ln").join(_small(fates), ["sig", "sig2"])
    removed = cut(placed.where(F.col("gone") | ~F.struct("doc", "th", "ln").eqNullSafe(F.col("first_at"))).select("doc", "th", "ln"))
    release(held, first)  # before the texts are moved
    return removed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with their text without the removed lines, and two more columns: n_lines, n_removed (long)."""
    for name in ("n_lines", "n_removed"):
        docs = docs.drop(name) if name in docs.columns else docs
    doc, th, at = (f"{c}_{uuid.uuid4().hex}" for c in ("doc", "th", "gone"))
    gone = removed_lines(docs.select(id_col, text_col), id_col, text_col, threshold, min_words).groupBy("doc", "th").agg(F.collect_set("ln").alias("at"))
    gone = cut(gone.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("at").alias(at)))
    # by a shuffle at any size: what a broadcast saves on small tables isn't there on large ones
    text = F.col(text_col).cast("string")
    met = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(th)), "left")
    parts = F.split(text, "\n", -1)
    left = F.when(F.col(at).isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(at, i)), "\n"))
    n = F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long")
    return met.withColumns({"n_lines": n, "n_removed": F.coalesce(F.size(at), F.lit(0)).cast("long"), text_col: left}).drop(doc, th, at)


def query(spark, sf_dir):
    """Every document without lines that match an earlier line of the table, however short."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
