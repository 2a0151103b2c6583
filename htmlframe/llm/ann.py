"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors collapse to one row that keeps their smallest ids (one more than a query wants, so nothing that could be
an answer is lost). Distinct vectors are dealt by a hash into shards of about SHARD vectors, and each shard gets a graph:
points come in batches of doubling size; a greedy beam search from the shard's most central point proposes neighbours
for each, pruning keeps those that no kept neighbour is nearer to than the point itself by the factor ALPHA, and the kept
ones get links back, pruned in the same way when they are too many. Queries travel in blocks to every shard, where they follow
its index, which comes once; a beam search answers them there, and the best of all shards are merged by their exact distance in
double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different lengths are
never compared. Repeated rows count once; ties go to the smaller id; an empty table gives no rows. Rows with a null id
take no part. Only the id and the vector column are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from htmlframe.llm.common import cut, prepare, table

SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 4096, 32, 64, 160, 1.2
BATCH = 256
#: Queries that travel together, and those that a beam search takes together.
BLOCK, STEP = 2048, 512


def _beam_search(x: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the nearest points that a beam search meets, for each query, nearest first; -1 fills up.

    x: points; links: neighbours of each, -1 fills up; q: queries.
    """
    m = len(q)
    norms = np.einsum("ij,ij->i", x, x)
    seen = np.zeros((m, len(x) + 1), bool)
    ids = np.full((m, beam), -1, np.int32)
    far = np.full((m, beam), np.inf, x.dtype)
    open_ = np.zeros((m, beam), bool)
    ids[:, 0], open_[:, 0] = start, True
    far[:, 0] = norms[start] - 2 * (q @ x[start])
    seen[:, start] = seen[:, -1] = True
    rows = np.arange(m)
    while len(rows):
        best = np.where(open_[rows], far[rows], np.inf).argmin(axis=1)
        go = open_[rows, best]
        rows, best = rows[go], best[go]
        if not len(rows):
            break
        open_[rows, best] = False
        nb = links[ids[rows, best]]
        fresh = ~seen[rows[:, None], nb]
        seen[rows[:, None], nb] = True
        d = norms[nb] - 2 * np.einsum("ijk,ik->ij", x[nb], q[rows])
        d[~fresh] = np.inf
        all_d = np.concatenate([far[rows], d], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        all_i = np.concatenate([ids[rows], nb], axis=1)
        all_o = np.concatenate([open_[rows], fresh], axis=1)
        far[rows] = np.take_along_axis(all_d, keep, 1)
        ids[rows] = np.take_along_axis(all_i, keep, 1)
        open_[rows] = np.take_along_axis(all_o, keep, 1) & np.isfinite(far[rows])
    order = far.argsort(axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    ids = np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1)
    return ids, far + np.einsum("ij,ij->i", q, q)[:, None]


def _prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The candidates that stay neighbours of p: the nearest one each time, and none that it covers."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != p)])
    v = x[candidates]
    own = ((v - x[p]) ** 2).sum(axis=1)
    order = own.argsort(kind="stable")
    candidates, v, own = candidates[order], v[order], own[order]
    n = np.einsum("ij,ij->i", v, v)
    covers = alpha * alpha * (n[:, None] + n[None, :] - 2 * (v @ v.T)) <= own[None, :]
    alive = np.ones(len(candidates), bool)
    kept = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= ~covers[i]
    return candidates[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """(links, start) of the points x: links has degree columns, -1 fills up."""
    n = len(x)
    links = np.full((n, degree), -1, np.int32)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        at, size = at + len(batch), min(BATCH, size * 2)
        found, _ = _beam_search(x, links, start, x[batch], beam)
        back: dict[int, list[int]] = {}
        for p, near in zip(batch.tolist(), found, strict=True):
            kept = _prune(x, p, near, degree, alpha)
            links[p, : len(kept)] = kept
            for k in kept.tolist():
                back.setdefault(k, []).append(p)
        for k, new in back.items():
            now = links[k][links[k] >= 0]
            merged = np.concatenate([now, [p for p in new if p not in now]]).astype(np.int32)
            if len(merged) > degree:
                merged = _prune(x, k, merged, degree, alpha)
            links[k] = -1
            links[k, : len(merged)] = merged
    return links, start


def search(x: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points found for each query and their exact Euclidean distances in double precision."""
    beam = min(max(beam, k), len(x))
    ids, _ = _beam_search(x, links, start, q, beam)
    ids = ids[:, : 6 * k]  # single-precision order is not exact among near copies
    d = np.sqrt(((x[ids].astype(np.float64) - q[:, None, :].astype(np.float64)) ** 2).sum(axis=2))
    d[ids < 0] = np.inf
    order = d.argsort(axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, each once."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null").where(finite & F.exists(v, lambda c: c != 0)).dropDuplicates(["id", "v"])


def build_index(rows: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(index, shards) over rows (id, v): for each shard a row (shard, dim, v binary, links binary, start, ids)."""
    prepare(rows.sparkSession)
    same = Window.partitionBy("v").orderBy("id")
    distinct = cut(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-distinct.count() // shard))
    schema = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("v", pa.binary()), ("links", pa.binary()), ("start", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64())))])

    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x = np.asarray(t.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim)
        order = np.lexsort(x.T[::-1])
        x = np.ascontiguousarray(x[order])
        links, start = build_graph(x)
        return pa.Table.from_arrays(
            [pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([dim], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([links.tobytes()], pa.binary()), pa.array([start], pa.int32()), pa.array([t.column("ids").take(pa.array(order)).to_pylist()], schema[5].type)], schema=schema
        )

    dealt = distinct.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "v", "ids")
    index = dealt.groupBy("shard", "dim").applyInArrow(run, "shard int, dim int, v binary, links binary, start int, ids array<array<bigint>>")
    return cut(index), shards


def nearest(index: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (id, v), without its own id."""
    blocks = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-queries.count() // BLOCK)))).alias("block"))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("q")).select("dim", "block", F.col("q.id").alias("q_ids"), F.flatten("q.v").alias("q"))
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "block", "q_ids", "q")
    # a shard's index comes first and once, then the blocks that ask it, one after another
    work = index.withColumn("block", F.lit(-1).cast("long")).unionByName(asked, allowMissingColumns=True).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "block")
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        of, x, links, start, ids = None, None, None, 0, []
        for batch in batches:
            for row in batch.select(["shard", "dim", "block", "start"]).append_column("at", pa.array(range(batch.num_rows))).to_pylist():
                column = lambda name, i=row["at"], batch=batch: batch.column(name)[i]
                if row["block"] < 0:
                    of, start = (row["shard"], row["dim"]), row["start"]
                    x = np.frombuffer(column("v").as_buffer(), np.float32).reshape(-1, row["dim"])
                    links = np.frombuffer(column("links").as_buffer(), np.int32).reshape(len(x), -1)
                    ids = column("ids").as_py()
                elif of == (row["shard"], row["dim"]):
                    q_ids, q = column("q_ids").as_py(), column("q").values.to_numpy(zero_copy_only=False).reshape(-1, row["dim"])
                    for at in range(0, len(q), STEP):
                        found, far = search(x, links, start, q[at : at + STEP], k + 1)
                        hits = [(one, d, ids[i]) for one, ii, dd in zip(q_ids[at : at + STEP], found.tolist(), far.tolist(), strict=True) for i, d in zip(ii, dd, strict=True) if i >= 0]
                        yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*hits, strict=True), schema, strict=True)], schema)

    hits = work.mapInArrow(run, "query_id long, score double, ids array<bigint>").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, shard: int = SHARD) -> DataFrame:
    """The k nearest of all rows for each row whose id is divisible by every."""
    rows = usable(vectors, id_col, vector_col)
    index, shards = build_index(rows, k, shard)
    return nearest(index, shards, rows.where(F.col("id") % every == 0), k)


def query(spark, sf_dir):
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    return neighbours(table(spark, sf_dir, "embeddings"))
