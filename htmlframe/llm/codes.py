"""Compression of vectors to codes by integer product quantisation.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts. Each part position has a
codebook, begun with the parts of the smallest ids. In each round the codebooks, whose size doesn't depend on the data, are
broadcast; Arrow batches compute all distances to them by |x|^2 - 2 x c + |c|^2 with matrix products of 64-bit integers,
exactly, and take the first smallest. Tasks add up the parts that meet each entry, a grouped shuffle merges these sums, and an
entry becomes the floor of their mean. Entries that no part meets stay.

Vectors that are null or hold null or non-finite components are left out. The length of a part is that of the longest
vector's, rounded up; shorter vectors count as ending in zeros, so an empty vector is one of zeros. Components are held to
2^28 in size after scaling, which keeps squared distances of up to 32 components a part exact in 64 bits; where parts are
longer, the bound is lower. Equal rows are rows each; among equal ids the smaller vector comes first, and null ids come last.
With fewer vectors than entries, codebooks are as small. Other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import kept, prepare, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Distances computed at a time.
BLOCK = 1 << 20
#: A label with more than this share of the rows is joined by broadcast, so at most its inverse are.
HOT_SHARE = 0.001


def usable(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: pa.Array, parts: int, length: int, scale: float = SCALE) -> np.ndarray:
    """(row, part, position) of the scaled components of lists of finite numbers, ending in zeros where they are shorter."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(pc.list_flatten(vectors).to_numpy(zero_copy_only=False), np.float64)
    most = float(1 << min(28, int(61 - np.log2(max(length, 1))) // 2))
    out = np.zeros((len(sizes), parts * length), np.int64)
    out[np.arange(parts * length) < sizes[:, None]] = np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
    return out.reshape(len(sizes), parts, length)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of an integer matrix, the first entry of a codebook at the smallest squared distance, and that distance."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    rows, norms = max(1, BLOCK // len(book)), (book * book).sum(1)
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        distance = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + norms
        code[at : at + rows] = best = distance.argmin(1)
        error[at : at + rows] = distance[np.arange(len(part)), best]
    return code, error


def _sums(vectors: DataFrame, books: np.ndarray, scale: float) -> DataFrame:
    """(part, entry, position, total, n) of the parts that meet each entry, one row of each for a task."""
    parts, entries, length = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("totals", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches):
        total, n = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = integers(batch.column(0), parts, length, scale)
            for p in range(parts):
                code, _ = nearest(x[:, p], shared.value[p])
                np.add.at(total[p], code, x[:, p])
                n[p] += np.bincount(code, minlength=entries)
        met = np.argwhere(n > 0)
        yield pa.record_batch([pa.array(met[:, 0].astype(np.int32)), pa.array(met[:, 1].astype(np.int32)), pa.array([total[p, e] for p, e in met], schema[2].type), pa.array(n[n > 0])], schema)

    return vectors.select("v").mapInArrow(run, "part int, entry int, totals array<long>, n long").select("part", "entry", "n", F.posexplode_outer("totals").alias("position", "total"))


def _refined(vectors: DataFrame, books: np.ndarray, scale: float) -> np.ndarray:
    """Codebooks after a round. What comes to the driver is a row for each component of the codebooks."""
    grouped = _sums(vectors, books, scale).groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = books.copy()
    for r in grouped.where("position is not null").collect():
        new[r.part, r.entry, r.position] = int(r.total) // r.n
    return new


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray:
    """Codebooks (part, entry, position) of a table (id, v) of usable vectors; without entries if it is empty."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    length = -(-longest // parts)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = integers(pa.array([r.v for r in first], pa.list_(pa.float64())), parts, length, scale).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _refined(vectors, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """(id, label, codes array<int>, error) of a table (id, v, label): the nearest entry of each part, and the squared distances
    summed over parts."""
    parts, _, length = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("codes", pa.list_(pa.int32())), ("error", pa.int64())])

    def run(batches):
        for batch in batches:
            x = integers(batch.column(1), parts, length, scale)
            met = [nearest(x[:, p], shared.value[p]) for p in range(parts)] if len(x) else []
            codes = np.stack([c for c, _ in met], 1) if met else np.zeros((0, parts))
            error = sum((e for _, e in met), np.zeros(len(x), np.int64))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(list(codes.astype(np.int32)), schema[2].type), pa.array(error)], schema)

    return vectors.select("id", "v", "label").mapInArrow(run, "id long, label string, codes array<int>, error long")


def with_group_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of a column over the rows of an equal key, nulls together.

    Few keys can have more than a thousandth of the rows; their sums are broadcast, and only rows of other keys are shuffled."""
    sums = rows.groupBy(F.col(key).alias("key_")).agg(F.sum(value).alias(name), F.count("*").alias("rows_"))
    least = rows.count() * HOT_SHARE
    hot = F.broadcast(sums.where(F.col("rows_") > least).drop("rows_"))
    cold = sums.where(F.col("rows_") <= least).drop("rows_")
    same = F.col(key).eqNullSafe(F.col("key_"))
    left = rows.join(hot.drop(name), same, "left_anti")
    return rows.join(hot, same).drop("key_").union(left.join(cold, same).drop("key_"))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, error, label_error) of each usable vector, and the codebooks (part, entry, position).

    label_error is the error summed over the vectors of an equal label."""
    prepare(vectors.sparkSession)
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")).where(usable(F.col("v")))
    books = fit(whole, parts, entries, rounds, scale)
    coded = kept(encode(whole, books, scale), "codes")
    return with_group_sum(coded, "label", "error", "label_error"), books


def query(spark, sf_dir):
    """Codes and errors of all embeddings, with the digest of the final codebooks."""
    found, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_FINE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _assigned(n: int) -> str:
    """SQL that gives each part its nearest entry of book n: the smallest of distance * 64 + entry."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"met{n} AS (SELECT vec_id, p, any_value(x) AS x, min({distance} * 64 + e) AS best FROM parts JOIN book{n} USING (p) GROUP BY vec_id, p)"


def _book(n: int) -> str:
    """SQL of book n from book n - 1."""
    mean = "(s - ((s % k) + k) % k) // k"
    return (
        f"totals{n} AS (SELECT p, e, list(CAST({mean} AS BIGINT) ORDER BY i) AS c FROM (SELECT p, best % 64 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS k FROM met{n - 1}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),"
        f" book{n} AS (SELECT p, e, coalesce(t.c, b.c) AS c FROM book{n - 1} b LEFT JOIN totals{n} t USING (p, e))"
    )


#: For tables whose ids are unique and whose vectors are of one length, a multiple of 16.
ORACLE = (
    f"WITH used AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {_FINE}),"
    " parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM used, (SELECT unnest(range(16)) AS p)),"
    " book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),"
    f" {_assigned(0)}, {_book(1)}, {_assigned(1)}, {_book(2)}, {_assigned(2)},"
    " coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM met2 GROUP BY vec_id),"
    " digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)"
    " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN used USING (vec_id), digest"
)
