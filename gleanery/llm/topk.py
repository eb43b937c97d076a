"""Exact top-k inner products over integer vectors, by norm-bucketed retrieval.

Vectors are grouped by length: a range partitioning by falling length cuts them into buckets of bounded bytes, each with
its longest length.  Queries are grouped into blocks.  First the longest bucket (bounded bytes, so it may be broadcast)
gives every query a score its k-th result reaches at least.  That score, divided by the query's and a bucket's longest
length, is the bucket's local cosine threshold: over 1, the bucket is skipped; high, candidates come from coordinate
pruning (a vector with that cosine must have its entries near the query's in the query's largest coordinates); low, from
length pruning (vectors long enough to reach the score at all).  Candidates are verified by integer products.

Queries are rows of the input; every block of them meets every bucket of its dimension that its thresholds allow,
through a join on a grid column, and nothing is collected but the one seed bucket.

Results in special cases: a vector that is null, empty or holds null or a non-finite number takes no part, nor does a null
id; only vectors of equal dimension meet; repeated rows are candidates each, and a query's own id never; a repeated query
id is answered once, for its smallest vector; scaled components are cut off where a product of two vectors could pass 64
bits (beyond 2^31 over the root of the dimension; 268 million at 64 dimensions); ties go to the smaller id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, SCALE, BUCKET_BYTES, QUERY_BYTES = 10, 1024, 1 << 19, 1 << 17
FOCUS, HIGH = 4, 0.7
GRID = 64


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Columns vec_id, dim, x (int64 little-endian bytes), norm for every row that takes part."""
    common.prepare(vectors.sparkSession)
    good = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.col(id_col).isNotNull()
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    most = F.floor(F.sqrt(F.lit(float(2**62)) / F.size("e")))
    rows = rows.select("vec_id", F.transform("e", lambda x: F.greatest(-most, F.least(most, F.floor(x * scale)))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            x, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            vecs = [x[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(v) for v in vecs], pa.int32()), common.binary_list([v.tobytes() for v in vecs]),
                 pa.array([float(np.sqrt((v.astype(float) ** 2).sum())) for v in vecs], pa.float64())],
                names=["vec_id", "dim", "x", "norm"],
            )

    return rows.mapInArrow(common.frugal(run), "vec_id long, dim int, x binary, norm double")


def _chunks(most_bytes: int):
    """Runs of rows of one dimension as one row: dim, n, ids, x, top (longest length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, float]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids = np.array([r[0] for r in rows], np.int64).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), common.binary_list([ids]), common.binary_list([b"".join(r[1] for r in rows)]), pa.array([max(r[2] for r in rows)], pa.float64())],
                names=["dim", "n", "ids", "x", "top"],
            )

        for b in batches:
            for i, dim, x, norm in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(dim, []).append((i, x, norm))
                if len(held[dim]) * dim * 8 >= most_bytes:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products; through floats where these are exact."""
    if len(q) and float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2**53:
        return (v.astype(float) @ q.astype(float)).astype(np.int64)
    return v @ q


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score falling, id)."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def candidates(v: np.ndarray, norms: np.ndarray, q: np.ndarray, theta: float, focus: int = FOCUS) -> np.ndarray:
    """Rows of a bucket that may reach the score ``theta`` with ``q``; never misses one."""
    size = float(np.sqrt((q.astype(float) ** 2).sum()))
    if theta == -np.inf or size == 0 or theta <= 0:
        return np.arange(len(v))
    local = theta / (size * float(norms.max(initial=0)) + 1e-300) - 1e-9
    if local > 1:
        return np.empty(0, np.int64)
    if local < HIGH:
        return np.flatnonzero(norms * size >= theta - 1e-6 * abs(theta))
    unit = q / size
    ok = norms > 0
    for f in np.argsort(-np.abs(unit))[:focus]:
        a, slack = unit[f] * local, np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - local**2))) + 1e-9
        entry = v[:, f] / np.maximum(norms, 1e-300)
        if unit[f] >= -local:
            ok &= entry >= a - slack
        if unit[f] <= local:
            ok &= entry <= a + slack
    return np.flatnonzero(ok)


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for dim, qids, qx, theta, ids, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qi, q, th = np.frombuffer(qids, np.int64), np.frombuffer(qx, np.int64).reshape(-1, dim), np.frombuffer(theta, float)
                vi, v = np.frombuffer(ids, np.int64), np.frombuffer(x, np.int64).reshape(-1, dim)
                norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
                for i in range(len(qi)):
                    c = candidates(v, norms, q[i], th[i])
                    c = c[vi[c] != qi[i]]
                    if len(c):
                        s = _exact(v[c], q[i])
                        keep = s >= th[i] if th[i] != -np.inf else np.ones(len(s), bool)
                        c, s = c[keep], s[keep]
                        for j in _best(vi[c], s, k):
                            out.append((int(qi[i]), int(vi[c[j]]), int(s[j])))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = common.table(integers(vectors, id_col, vec_col), "topk-rows")
    schema = "dim int, n int, ids binary, x binary, top double"
    ordered = rows.repartitionByRange(parts, F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = common.table(ordered.mapInArrow(common.frugal(_chunks(BUCKET_BYTES)), schema), "topk-buckets")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "x", "norm")).alias("q")).select("vec_id", "q.*")
    blocks = common.table(asked.coalesce(max(1, parts // 4)).mapInArrow(common.frugal(_chunks(QUERY_BYTES)), schema), "topk-queries")

    seed = buckets.orderBy(F.desc("top"), F.desc("n"), "dim").limit(1).collect()  # at most BUCKET_BYTES and one row more
    share = spark.sparkContext.broadcast([(r.dim, bytes(r.ids), bytes(r.x)) for r in seed])

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, need = [], []
            for dim, qids, qx in zip(*(b.column(n).to_pylist() for n in ("dim", "ids", "x")), strict=True):
                qi, q = np.frombuffer(qids, np.int64), np.frombuffer(qx, np.int64).reshape(-1, dim)
                th = np.full(len(qi), -np.inf)
                for d, ids, x in share.value:
                    if d == dim:
                        vi, v = np.frombuffer(ids, np.int64), np.frombuffer(x, np.int64).reshape(-1, dim)
                        for i in range(len(qi)):
                            s = np.sort(_exact(v, q[i])[vi != qi[i]])
                            th[i] = s[-k] if len(s) >= k else -np.inf
                out.append(th.tobytes())
                size = np.sqrt((q.astype(float) ** 2).sum(axis=1))
                need.append(float(np.where(th > 0, th / np.maximum(size, 1e-300), 0).min(initial=np.inf)))
            yield pa.RecordBatch.from_arrays(
                [b.column("dim"), b.column("ids"), b.column("x"), common.binary_list(out), pa.array(need, pa.float64())], names=["qdim", "qids", "qx", "theta", "need"]
            )

    asked = blocks.mapInArrow(common.frugal(thresholds), "qdim int, qids binary, qx binary, theta binary, need double")
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    there = buckets.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(GRID)).cast("int"))
    joined = asked.join(there, (asked.g == there.g) & (asked.qdim == there.dim) & (there.top >= asked.need * (1 - 1e-9)))
    found = joined.select("qdim", "qids", "qx", "theta", "ids", "x").mapInArrow(common.frugal(_meet(k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
