"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each filled up with zeros to a 23-bit word of the
perfect binary Golay code. A word's keys are the codewords at distance 4 or less: its nearest one and, if that is at
distance 3, the five at distance 4. Two words that differ in at most two bits always share a key. Of three segments with
four errors in total at most one has three or more, so two linked fingerprints share a key in at least two segments,
and a pair of keys from two segments (24 bits and the number of the pair) is what fingerprints are joined on.

Copies collapse before that: only distinct fingerprints get keys. Dense groups don't make all their pairs either. First
each fingerprint is compared with the smallest one and with the one before it under the same key; the links found give
first components. Then a join on the keys finds every link that is left between different components, and only those
leave the join. Together these give exactly the components of all links.

Null and empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows share a
fingerprint and so a component; a null id takes part, but never names a component unless it has no other id. Texts of any length are
taken whole. An empty table gives no rows. The fingerprints read the id and the text column only; where rows are dropped, the
others are kept, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from htmlframe.llm.common import components, cut, prepare, table

#: Widths of the segments.
WIDTHS = (22, 21, 21)
#: The generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
WORDS, SEED = 4, 42
#: Words of a text hashed at a time.
BLOCK = 200_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a whole text: bit i is 1 if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = tokens[at : at + BLOCK + words - 1]
        joined = memoryview(b" ".join(part))
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = (ends - np.fromiter(map(len, part), np.int64, len(part)) - 1).tolist()
        ends = (ends - 1).tolist()
        m = min(BLOCK, n - at)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:m], ends[min(words, len(part)) - 1 :], strict=False)), np.uint64, m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row (id long, fp long, th long) for each row: the fingerprint as a signed 64-bit number, and a hash of the text."""
    prepare(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("th", pa.int64())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64), pa.int64()), batch.column(2)], schema)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, "id long, fp long, th long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@functools.cache
def golay_errors() -> np.ndarray:
    """For each of the 2048 syndromes the error words of weight 4 or less, lightest first, filled up with -1 to 6."""
    from itertools import combinations

    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for error, s in zip(errors.tolist(), _syndrome(errors).tolist(), strict=True):
            table[s, used[s]] = error
            used[s] += 1
    return table


def segment_keys(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords near 23-bit words, one row of 6 for each, filled up with -1."""
    errors = golay_errors()[_syndrome(words)]
    return np.where(errors >= 0, (words[:, None].astype(np.int64) ^ errors) >> 11, -1)


def join_keys(fps: np.ndarray) -> list[np.ndarray]:
    """The keys of each fingerprint: pair of segments, key of the one, key of the other."""
    fps = fps.astype(np.uint64)
    at, parts = 0, []
    for width in WIDTHS:
        parts.append(segment_keys((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)))
        at += width
    out = []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        out.append(np.where((a >= 0) & (b >= 0), number << 24 | a << 12 | b, -1).reshape(len(fps), -1))
    keys = np.concatenate(out, axis=1)
    return [row[row >= 0] for row in keys]


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp, component) for each key of each fingerprint of a table (fp, component)."""
    schema = pa.schema([("fp", pa.int64()), ("component", pa.int64()), ("keys", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = join_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).astype(np.int32)))
                yield pa.record_batch([batch.column(0), batch.column(1), lists], schema)

    rows = fps.mapInArrow(run, "fp long, component long, keys array<int>")
    return rows.select(F.explode("keys").alias("key"), "fp", "component")


def link_components(fps: DataFrame, most_bits: int = 4) -> DataFrame:
    """(fp, component) for distinct fingerprints (fp): component is the smallest fingerprint that links of at most
    most_bits differing bits reach. The keys hold for up to 4 bits."""
    if most_bits > 4:
        raise ValueError("the keys find links of at most 4 differing bits")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most_bits
    under = Window.partitionBy("key").orderBy("fp")
    first = _keyed(fps.select("fp", F.col("fp").alias("component"))).select(
        "fp", F.min("fp").over(under.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lag("fp").over(under).alias("before")
    )
    stars = first.select("fp", F.explode(F.array("head", "before")).alias("other")).where("other is not null and other <> fp").where(near("fp", "other")).distinct()
    stars = cut(stars)
    found = components(stars.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    marked = cut(fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component")))
    keyed = _keyed(marked)
    left, right = keyed, keyed.select(F.col("key"), F.col("fp").alias("fp2"), F.col("component").alias("component2"))
    rest = left.join(right, "key").where(F.col("component") < F.col("component2")).where(near("fp", "fp2")).select(F.col("component").alias("a"), F.col("component2").alias("b")).distinct()
    merged = components(rest)
    return marked.join(merged, marked.component == merged.node, "left").select("fp", F.coalesce(merged.component, marked.component).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most_bits: int = 4) -> DataFrame:
    """One row (id, fp, component, stays) for each row; component is the smallest id that links reach. Of each component
    the rows with that id stay, or, if it has more than one text, those with one of them."""
    marked = cut(fingerprints(docs, id_col, text_col, words))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    distinct = marked.groupBy("fp").agg(F.min(first).alias("least"))
    linked = link_components(distinct.select("fp"), most_bits)
    named = linked.join(distinct, "fp")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    by_fp = named.select("fp", "component").join(names, "component").select("fp", "name")
    stays = F.col("id").eqNullSafe(F.col("name.id")) & (F.col("th") == F.col("name.th"))
    return marked.join(by_fp, "fp").select("id", "fp", F.col("name.id").alias("component"), stays.alias("stays"), "th")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most_bits: int = 4) -> DataFrame:
    """The rows of docs with one row left of each component."""
    found = cut(near_duplicates(docs, id_col, text_col, words, most_bits))
    again = found.where("stays").groupBy("id", "th").count().where("count > 1").limit(1).count()
    lost = found.where("not stays").select(F.col("id").alias("lost_"), F.col("th").alias("lost_th_")).distinct()
    left = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col("lost_")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("lost_th_")), "left_anti")
    return left.dropDuplicates([id_col, text_col]) if again else left


def query(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
