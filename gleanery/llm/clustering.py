"""Centroid clustering of integer vectors with Elkan's bounds: the result is that of the plain method, to the last bit.

A table of state holds, beside each vector, its cluster, an upper bound of the distance to its centroid and a lower bound of
the distance to each of the k centroids.  A round moves the bounds by how far the centroids went and skips a centroid when
the bounds or the distances between centroids show that it is strictly farther.  What can't be skipped is measured in exact
integers, and ties go to the smaller number.  Bounds are doubles (lower ones kept as floats) rounded away from the truth, so
a skip is always right; a bound that is equal skips nothing.

Vectors never move: a round reads the state, writes the next one and adds up a row of partial sums for each task.  The driver
holds the k centroids alone.  A written state is what a lost executor's tasks are repeated from.

Results in special cases: a vector that is null, of another size, or holds null or a non-finite number takes no part; scaled
components are cut off at 2^27 on either side, so that a squared distance fits 64 bits; an inertia beyond 64 bits is null;
a null id takes part and is no start; repeated rows are vectors each, and a repeated id starts as its smallest vectors; with
fewer vectors than k there are fewer centroids; equal centroids leave the larger number empty, and empty ones stay where they
are; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
LARGEST = 2**27
#: Relative slack of a bound: far more than a root, a sum or a product of doubles is off by.
SLACK = 1e-12
STATE = "id long, x array<int>, cluster int, distance long, upper double, lower array<float>, measured int"


def integers(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id and x (scaled integers) of the rows that take part."""
    cut: Column = F.transform("e", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x * scale))))).cast("int"))
    rows = vectors.where(F.size(vec_col) == dim).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    return rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).select("id", cut.alias("x"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows whose hashed id comes first, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c``; in doubles where these are exact."""
    gap = x - c
    most = float(np.abs(gap).max(initial=0))
    if most * most * x.shape[1] < 2**52:
        gap = gap.astype(np.float64)
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    return np.einsum("ij,ij->i", gap, gap)


def above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    """Floats that aren't over ``d``."""
    return np.maximum(np.nextafter((d * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def halves(centroids: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down; on the diagonal nothing."""
    return np.stack([np.sqrt(squares(centroids, c).astype(np.float64)) for c in centroids]) * (0.5 * (1 - SLACK))


def first_state(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, upper, lower) from all distances."""
    d2 = np.stack([squares(x, c) for c in centroids], axis=1)
    cluster = d2.argmin(axis=1)  # the first of equal ones
    own = d2[np.arange(len(x)), cluster]
    return cluster, own, above(own), below(np.sqrt(d2.astype(np.float64)))


def next_state(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray, moved: np.ndarray):
    """(cluster, distance, upper, lower, distances measured) after the centroids went by ``moved`` (rounded up)."""
    cluster = cluster.copy()
    upper = (upper + moved[cluster]) * (1 + SLACK)
    lower = below(lower.astype(np.float64) - moved)
    # exact to its own centroid: what is reported, and the tightest upper bound
    own = np.empty(len(x), np.int64)
    measured = np.zeros(len(x), np.int32)
    nearest = np.where(np.eye(len(centroids), dtype=bool), np.inf, half).min(axis=1)
    open_ = np.flatnonzero(upper >= nearest[cluster])
    tight = np.zeros(len(x), bool)
    for c in range(len(centroids)):
        rows = open_[(cluster[open_] != c) & (upper[open_] >= lower[open_, c]) & (upper[open_] >= half[cluster[open_], c])]
        stale = rows[~tight[rows]]
        for a in np.unique(cluster[stale]):
            at = stale[cluster[stale] == a]
            own[at] = squares(x[at], centroids[a])
            upper[at], lower[at, a] = above(own[at]), below(np.sqrt(own[at].astype(np.float64)))
            measured[at] += 1
        tight[stale] = True
        rows = rows[(upper[rows] >= lower[rows, c]) & (upper[rows] >= half[cluster[rows], c])]
        if len(rows):
            d2 = squares(x[rows], centroids[c])
            lower[rows, c] = below(np.sqrt(d2.astype(np.float64)))
            measured[rows] += 1
            won = (d2 < own[rows]) | ((d2 == own[rows]) & (c < cluster[rows]))
            to = rows[won]
            cluster[to], own[to], upper[to] = c, d2[won], above(d2[won])
    return cluster, own, upper, lower, measured, tight


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, measured: np.ndarray) -> pa.RecordBatch:
    listed = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel(), kind))
    return pa.RecordBatch.from_arrays(
        [ids, listed(x.astype(np.int32), pa.int32()), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), pa.array(upper, pa.float64()), listed(lower, pa.float32()), pa.array(measured, pa.int32())],
        names=["id", "x", "cluster", "distance", "upper", "lower", "measured"],
    )


def _begin(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), centroids.shape[1]).astype(np.int64)
                yield _rows(b.column("id"), x, *first_state(x, centroids), np.full(len(x), len(centroids), np.int32))

    return run


def _step(centroids: np.ndarray, moved: np.ndarray, last: bool):
    half = halves(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), centroids.shape[1]).astype(np.int64)
            cluster, upper = b.column("cluster").to_numpy(), b.column("upper").to_numpy()
            cluster, own, upper, lower, measured, tight = next_state(x, cluster, upper, _matrix(b.column("lower"), len(centroids)), centroids, half, moved)
            # distances are asked for after the last round alone; till then a skipped row has none
            own[~tight] = squares(x[~tight], centroids[cluster[~tight]]) if last else -1
            yield _rows(b.column("id"), x, cluster, own, upper, lower, measured)

    return run


def _partial(k: int, dim: int):
    """One row for each cluster of a task: cluster, n, sums.  A batch's sums are exact in 64 bits, a task's as Python's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, cluster = _matrix(b.column("x"), dim).astype(np.int64), b.column("cluster").to_numpy()
                order = np.argsort(cluster, kind="stable")
                there, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(x[order], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n, pa.int64()), common.long_list(sums.ravel(), np.full(len(there), dim))], names=["cluster", "n", "sums"])

    return run


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means of all clusters; those without a vector stay."""
    k, dim = centroids.shape
    parts = state.select("x", "cluster").mapInArrow(common.frugal(_partial(k, dim)), "cluster int, n long, sums array<long>")
    spread = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    out = centroids.copy()
    for r in spread.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k rows of one vector
        out[r.cluster, r.at] = int(r.s) // r.n
    return out


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and measured: the distances that the last
    round couldn't skip, of k for each vector."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = integers(vectors, dim, scale, id_col, vec_col)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        # without any id to start from there is no centroid to be assigned to
        none = rows.where("false").select(F.col("id").alias("vec_id"))
        return none.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256", "0 as measured")
    state = common.table(rows.mapInArrow(common.frugal(_begin(centroids)), STATE), "clusters-0")
    for at in range(rounds):
        new = means(state, centroids)
        moved = np.array([float(np.sqrt(float(squares(a[None], b)[0]))) for a, b in zip(centroids, new, strict=True)]) * (1 + SLACK)
        centroids, before = new, state
        state = common.table(before.mapInArrow(common.frugal(_step(centroids, moved, at == rounds - 1)), STATE), f"clusters-{at + 1}")
        common.done_with(before, shuffles=False)
    by = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r.s) for r in by)
    long = lambda v: v if v < 2**63 else None
    told = [(r.cluster, long(int(r.s)), long(total), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in by]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select(F.col("id").alias("vec_id"), "cluster", "distance", "measured").join(F.broadcast(about), "cluster")  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")


def _round_sql(i: int) -> str:
    """Assignment to the centroids c{i}, then their means c{i + 1}."""
    return f"""a{i} AS MATERIALIZED (
  SELECT vec_id, no, x, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v, c{i}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, no) = 1
), m{i} AS (SELECT no, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY no, i),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.no, coalesce(f.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT no, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{i} GROUP BY no) f ON f.no = c{i}.no
)"""


#: ``measured`` tells how much was skipped, which plain SQL can't know; the query leaves it out.
ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS no, x AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS})
), {", ".join(_round_sql(i) for i in range(ROUNDS + 1))}
SELECT vec_id, a{ROUNDS}.no AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{ROUNDS}.no)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.no = a{ROUNDS}.no
"""
