"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions only.

A text's words are hashed once, and each run of five words to one 64-bit value. The top byte of a value, counted from
the smallest signed one, is its bin, and a bin keeps its smallest value. An empty bin borrows from the first non-empty bin of a random order of its own (a
sequence of hashed bins; if none of the first TRIES of it has values, the non-empty bin whose hash with this bin is
smallest), so two texts borrow alike wherever they have the same bins filled. Of each bin the low 8 bits are stored,
and likeness takes off the matches that chance gives them.

Null texts count as empty. A text without words has the fingerprint of zeros only, like 1 to another such text and 0 to
any other; a text of less than five words is one run. The next document is that of the next id; equal ids are ordered by
their text, a null id comes first, and the last row's next is the first. Repeated rows give repeated rows, an empty table
none. Texts of any length are taken whole. Only the id and text columns are read, so others and their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from htmlframe.llm.common import cut, table

BINS, RUN, TRIES = 256, 5, 24
#: Documents in a range of ids, and most ranges (their first ids are broadcast).
RANGE, MOST_RANGES = 1000, 65_536


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the array<tinyint> of the bins' stored bits of a text column; an empty array for texts without words.

    Steps are columns of their own, each used more than once in the next, so that none is evaluated again in a lambda.
    """
    t = f"{to}_"
    rest = ", ".join(f"get({t}w, i + {k})" for k in range(1, RUN))
    has = f"(shiftright(get({t}bits, cast(shiftright({{b}}, 6) as int)), cast({{b}} & 63 as int)) & 1L) = 1L"
    rank = f"get({t}sum, cast(shiftright({{b}}, 6) as int)) + bit_count(get({t}bits, cast(shiftright({{b}}, 6) as int)) & ~shiftleft(-1L, cast({{b}} & 63 as int)))"
    bits = ", ".join(f"aggregate(filter({t}least, x -> shiftrightunsigned(x, 62) = {k ^ 2}L), 0L, (s, x) -> s | shiftleft(1L, cast(shiftrightunsigned(x, 56) & 63 as int)))" for k in range(4))
    sums = ", ".join(" + ".join(["0", *[f"bit_count(get({t}bits, {j}))" for j in range(k)]]) for k in range(4))
    tried = f"filter(transform(sequence(0, {TRIES - 1}), r -> pmod(xxhash64(b, r), {BINS}L)), p -> {has.format(b='p')})"
    rescue = f"array_min(transform({t}least, x -> struct(xxhash64(b, shiftrightunsigned(x, 56)) as o, x as x))).x"
    first_tried = f"transform(slice({tried}, 1, 1), p -> get({t}least, {rank.format(b='p')}))"
    steps = [
        ("w", f"transform(array_remove(split({text}, '\\\\s+'), ''), x -> xxhash64(x))"),
        ("sorted", f"sort_array(case when size({t}w) >= {RUN} then transform(slice({t}w, 1, size({t}w) - {RUN - 1}), (x, i) -> xxhash64(x, {rest})) when size({t}w) > 0 then array(xxhash64({t}w)) else cast(array() as array<bigint>) end)"),
        ("least", f"filter({t}sorted, (x, i) -> i = 0 or shiftrightunsigned(x, 56) <> shiftrightunsigned(get({t}sorted, i - 1), 56))"),
        ("bits", f"array({bits})"),
        ("sum", f"array({sums})"),
        (
            "slots",
            f"case when size({t}least) = 0 then cast(array() as array<tinyint>) else transform(sequence(0L, {BINS - 1}L), b -> cast("
            f"(coalesce(case when {has.format(b='b')} then get({t}least, {rank.format(b='b')}) else get({first_tried}, 0) end, {rescue}) & 255L) - 128L as tinyint)) end",
        ),
    ]
    keep = list(df.columns)
    made: list[str] = []
    for name, how in steps:
        made.append(f"{t}{name}")
        df = df.select(*keep, *made[:-1], F.expr(how).alias(made[-1]))
    return df.select(*keep, F.col(f"{t}slots").alias(to))


def packed(slots: str):
    """The stored bits as a hexadecimal string, two digits for each bin."""
    return F.expr(f"case when size({slots}) = 0 then repeat('00', {BINS}) else array_join(transform({slots}, x -> substr(hex(cast(x as bigint) + 384L), 2)), '') end")


def likeness(a: str, b: str):
    """Estimate of the Jaccard likeness from two arrays of stored bits, freed from the bias of equal bits by chance."""
    equal = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"
    share = f"greatest(0D, ({equal} / {BINS}D - 1D / 256D) / (1D - 1D / 256D))"
    return F.expr(f"case when size({a}) = 0 or size({b}) = 0 then if(size({a}) = size({b}), 1D, 0D) else {share} end")


def with_range(df: DataFrame, id_col: str) -> DataFrame:
    """Add range_, the number of the range of ids that a row falls into, by quantiles of the ids.

    The bounds, MOST_RANGES at most, are one row that the plan looks up; each row's range is found by halving.
    """
    n = df.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE)))
    if ranges == 1:
        return df.withColumn("range_", F.lit(0))
    shares = F.expr(f"cast(split('{','.join(str(k / ranges) for k in range(1, ranges))}', ',') as array<double>)")
    bounds = cut(df.where(F.col(id_col).isNotNull()).agg(F.coalesce(F.percentile_approx(id_col, shares, 20 * ranges), F.array().cast("array<bigint>")).alias("bounds"))).scalar()
    steps = max(1, ranges.bit_length())
    halving = F.aggregate(F.expr(f"transform(sequence(0, {steps - 1}), x -> shiftleft(1, {steps - 1} - x))"), F.lit(0), lambda at, step: F.when(F.get(F.col("bounds_"), at + step - 1) <= F.col(id_col), at + step).otherwise(at))
    return df.withColumn("bounds_", bounds).withColumn("range_", F.when(F.col(id_col).isNull(), 0).otherwise(halving)).drop("bounds_")


def with_next(df: DataFrame, id_col: str, tie: list[str], carried: list[str]) -> DataFrame:
    """Add next_<name> for each carried column: its value in the row of the next id, after the last row in the first.

    Rows are dealt by ranges of ids of about RANGE rows, and the first row of each range is also dealt, as a guest, to the
    range before it, so one shuffle brings every row together with its next. The ranges follow quantiles, so outlying ids
    change nothing; rows of one id share a range. Only the ranges' first ids, MOST_RANGES at most, are broadcast.
    """
    dealt = with_range(df, id_col)
    firsts = dealt.groupBy("range_").agg(F.min(id_col).alias("first_"))
    line = Window.orderBy("range_")
    before = F.coalesce(F.lag("range_").over(line), F.last("range_").over(line.rowsBetween(0, Window.unboundedFollowing)))
    hosts = firsts.select(F.col("range_").alias("own_"), "first_", before.alias("host_"))
    met = dealt.join(F.broadcast(hosts), (dealt["range_"] == F.col("own_")) & dealt[id_col].eqNullSafe(F.col("first_")), "left").drop("own_", "first_")
    places = F.when(F.col("host_").isNull(), F.array(F.struct(F.col("range_").alias("at"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("range_").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("host_").alias("at"), F.lit(1).alias("guest"))))
    spread = met.withColumn("place_", F.explode(places)).withColumn("at_", F.col("place_.at")).withColumn("guest_", F.col("place_.guest")).drop("place_", "host_", "range_")
    order = Window.partitionBy("at_").orderBy("guest_", id_col, *tie)
    for c in carried:
        spread = spread.withColumn(f"next_{c}", F.lead(c).over(order))
    return spread.where("guest_ = 0").drop("at_", "guest_")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, text, slots) for each row."""
    return with_fingerprint(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text", "slots")


def query(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how like they are."""
    own = with_next(fingerprints(table(spark, sf_dir, "documents")), "id", ["text"], ["text", "slots"])
    n = own.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = n.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))")).drop("text", "next_text")
    both = with_fingerprint(edited, "edited", "edited_slots")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed("slots").alias("fingerprint"),
        packed("edited_slots").alias("edited_fingerprint"),
        likeness("slots", "edited_slots").alias("near_edited"),
        likeness("slots", "next_slots").alias("near_next"),
    )
