"""Exact search and sums over vectors, in tiles: blocks of rows meet blocks of queries in one matrix product.

``VectorIndex`` keeps vectors in cells.  Centroids are fitted on a bounded sample (SAMPLE rows by the hash of their id), every
row is assigned to its nearest one, and rows of one cell and one set of key values lie in blocks sorted by their distance to
the centroid, each with its radius.  For any x of a block q.x = q.c + q.(x - c) <= q.c + |q| radius, so a block whose bound
stays under a query's k-th best score so far can't change the result and isn't multiplied; cells that no query needs aren't
read.  The result is that of comparing everything, whatever the sample was.

A filter is an equality on key columns and is applied to whole blocks.  A null vector, an empty one, or one with null or NaN in
it takes no part; vectors meet queries of their own length only; a query's own row is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gleanery.session import prepare, root, table

#: Rows that centroids are fitted on, most cells, rows of a block, and what scores that round to the same may differ by.
SAMPLE, MOST_CELLS, BLOCK, SAME = 16_384, 1024, 512, 4e-9


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    return vectors.where((F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x)))


def fit(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample: a few rounds from evenly spaced rows.  They steer the search and never its result."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)[0]
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=cells)
        np.add.at(sums, own, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each row's nearest centroid."""
    own = ((centroids**2).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)
    return own, np.sqrt(((x - centroids[own]) ** 2).sum(axis=1))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) of the vectors of each length in a list column."""
    off = column.offsets.to_numpy()
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(off)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[off[at][:, None] + np.arange(n)].astype(np.float64)


@dataclass(frozen=True)
class Asked:
    """A block of queries of one length on the driver: at most QUERY_BLOCK or so."""

    ids: np.ndarray
    x: np.ndarray
    keys: dict[str, np.ndarray]
    least: np.ndarray  # scores under it don't count

    @staticmethod
    def collect(queries: DataFrame, same: tuple[str, ...]) -> dict[int, Asked]:
        rows = usable(queries, "query").select("query_id", F.col("query").cast("array<double>").alias("query"), *same).collect()
        of: dict[int, list] = {}
        for r in rows:
            of.setdefault(len(r["query"]), []).append(r)
        listed = lambda v: np.fromiter(v, dtype=object, count=len(v))
        return {n: Asked(listed([r.query_id for r in own]), np.array([r["query"] for r in own]), {k: listed([r[k] for r in own]) for k in same}, np.full(len(own), -np.inf)) for n, own in of.items()}


@dataclass(frozen=True)
class VectorIndex:
    """blocks: keys, dim, cell, n, far, ids, x (doubles as bytes); centroids and radii of all cells by length of vector."""

    blocks: DataFrame
    keys: tuple[str, ...]
    centroids: dict[int, np.ndarray]
    far: dict[int, np.ndarray]
    n: int

    @staticmethod
    def build(vectors: DataFrame, keys: tuple[str, ...] = (), id_col: str = "chunk_id", vec_col: str = "embedding") -> VectorIndex:
        spark = vectors.sparkSession
        prepare(spark, root())
        rows = usable(vectors, vec_col).select(F.col(id_col).alias("id"), *keys, F.col(vec_col).cast("array<double>").alias("v"))
        n = rows.count()
        # the smallest hashes: a task passes on those under a bound that about SAMPLE of all rows have, not SAMPLE of its own
        share = min(1.0, (SAMPLE + 4 * SAMPLE**0.5) / max(n, 1))
        h = F.xxhash64("id")
        sample = rows.select("v", h.alias("h")).where(h <= int(-(2**63) + share * (2**64 - 1025))).orderBy("h").limit(SAMPLE).collect()
        groups: dict[int, list] = {}
        for r in sample:
            groups.setdefault(len(r.v), []).append(r.v)
        cells = max(1, min(MOST_CELLS, int(np.sqrt(n)), len(sample) // 16))
        centroids = {dim: fit(np.array(own), min(cells, len(own))) for dim, own in groups.items()}
        share = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dim, cell, gap = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                for at, x in by_length(b.column("v")):
                    dim[at] = x.shape[1]
                    # a length that the sample missed has one cell, around nothing
                    cell[at], gap[at] = nearest(x, share.value.get(x.shape[1], np.zeros((1, x.shape[1]))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), pa.array(cell), pa.array(gap)], names=[*b.schema.names, "dim", "cell", "gap"])

        kind = lambda c: rows.schema[c].dataType.simpleString()
        own = "".join(f"`{k}` {kind(k)}, " for k in keys)
        placed = rows.mapInArrow(assign, f"id {kind('id')}, {own}v array<double>, dim int, cell int, gap double")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = (*keys, "dim", "cell", "gap")
        sorted_ = table(placed, "vectors").repartitionByRange(parts, *order, "id").sortWithinPartitions(*order)
        blocks = table(sorted_.mapInArrow(_packed(keys), f"{own}dim int, cell int, n int, far double, ids array<{kind('id')}>, x binary"), "vector-blocks")
        far = {dim: np.zeros(len(c)) for dim, c in centroids.items()}
        for r in blocks.groupBy("dim", "cell").agg(F.max("far").alias("far")).collect():  # a row for each cell
            if r.dim not in far:
                centroids[r.dim], far[r.dim] = np.zeros((1, r.dim)), np.zeros(1)
            far[r.dim][r.cell] = r.far
        return VectorIndex(blocks, keys, centroids, far, n)

    def _bounds(self, dim: int, q: np.ndarray) -> np.ndarray:
        """What a query's product with any vector of a cell can't pass: a row for each query."""
        size = np.sqrt((q**2).sum(axis=1))
        return q @ self.centroids[dim].T + size[:, None] * self.far[dim] * (1 + 1e-9) + 1e-12

    def _run(self, asked: dict[int, Asked], wanted: dict[int, np.ndarray], same: tuple[str, ...], where: dict, ids: DataType, k: int | None) -> DataFrame:
        """Scores of the (query, cell) pairs marked in ``wanted``, the best k of each query and block or all of them."""
        spark = self.blocks.sparkSession
        unknown = [c for c in (*same, *where) if c not in self.keys]
        if unknown:
            raise ValueError(f"the index has no key {', '.join(unknown)}; it has {', '.join(self.keys) or 'none'}")
        rows = self.blocks
        for c, v in where.items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
        open_ = F.lit(False)
        for dim, mark in wanted.items():
            open_ = open_ | ((F.col("dim") == dim) & F.col("cell").isin(np.flatnonzero(mark.any(axis=0)).tolist()))
        share = spark.sparkContext.broadcast((asked, wanted, self.centroids))
        kind = rows.schema["ids"].dataType.elementType
        kinds = (to_arrow_type(ids), to_arrow_type(kind))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, marks, centroids = share.value
            for b in batches:
                for r in b.to_pylist():
                    q = queries[r["dim"]]
                    rows_ = marks[r["dim"]][:, r["cell"]].copy()
                    for key in same:
                        rows_ &= q.keys[key] == r[key]
                    at = np.flatnonzero(rows_)
                    if len(at):
                        size = np.sqrt((q.x[at] ** 2).sum(axis=1))
                        most = q.x[at] @ centroids[r["dim"]][r["cell"]] + size * r["far"] * (1 + 1e-9) + 1e-12
                        at = at[most >= q.least[at]]
                    if len(at):
                        yield _scored(q, at, r, k, kinds)

        return rows.where(open_).mapInArrow(meet, f"query_id {ids.simpleString()}, chunk_id {kind.simpleString()}, dense double")

    def topk(self, queries: DataFrame, k: int, where: dict | None = None, same: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
        """(scores that hold each query's k best, what was opened) for a block of queries (query_id, query, keys of ``same``).

        First the cells that promise most give every query a score that its k-th best reaches; then every cell and block whose
        bound reaches that score is opened.
        """
        where = where or {}
        ids = queries.schema["query_id"].dataType
        asked = {dim: a for dim, a in Asked.collect(queries, same).items() if dim in self.centroids}
        bounds = {dim: self._bounds(dim, a.x) for dim, a in asked.items()}
        probes = {dim: b >= np.sort(b, axis=1)[:, -min(2, b.shape[1]) :][:, :1] for dim, b in bounds.items()}
        found = self._run(asked, probes, same, where, ids, k).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("dense"), asc=False), k, 1).alias("at"))
        least = {r.query_id: r["at"][0] - SAME for r in found.collect() if r["at"]}  # a row for each query of the block
        asked = {dim: Asked(a.ids, a.x, a.keys, np.array([least.get(i, -np.inf) for i in a.ids])) for dim, a in asked.items()}
        wanted = {dim: bounds[dim] >= a.least[:, None] for dim, a in asked.items()}
        opened = {"cells": int(sum(w.size for w in wanted.values())), "opened": int(sum(w.sum() for w in wanted.values()))}
        return self._run(asked, wanted, same, where, ids, k), opened

    def pairs(self, queries: DataFrame, where: dict | None = None, same: tuple[str, ...] = ()) -> DataFrame:
        """query_id, chunk_id, dense of every pair that filters leave."""
        asked = {dim: a for dim, a in Asked.collect(queries, same).items() if dim in self.centroids}
        every = {dim: np.ones((len(a.ids), len(self.centroids[dim])), bool) for dim, a in asked.items()}
        return self._run(asked, every, same, where or {}, queries.schema["query_id"].dataType, None)


def _packed(keys: tuple[str, ...]) -> Callable:
    """Runs of sorted rows of one cell and one set of keys as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        schema = None

        def out() -> pa.RecordBatch:
            first = held[0]
            x = np.array([r["v"] for r in held], "<f8")
            cols = [pa.array([first[k]], schema.field(k).type) for k in keys]
            cols += [pa.array([first["dim"]], pa.int32()), pa.array([first["cell"]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([held[-1]["gap"]], pa.float64())]
            cols += [pa.array([[r["id"] for r in held]], pa.list_(schema.field("id").type)), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "dim", "cell", "n", "far", "ids", "x"])

        for b in batches:
            schema = b.schema
            for r in b.to_pylist():
                if held and (len(held) == BLOCK or any(r[c] != held[0][c] for c in (*keys, "dim", "cell"))):
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    return run


def _scored(q: Asked, at: np.ndarray, block: dict, k: int | None, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    ids = np.fromiter(block["ids"], dtype=object, count=len(block["ids"]))
    x = np.frombuffer(block["x"], "<f8").reshape(len(ids), -1)
    scores = q.x[at] @ x.T
    counts = (scores >= q.least[at][:, None]) & (q.ids[at][:, None] != ids[None, :])
    if k is not None and len(ids) > k:
        # the k best of each query, and what rounds to the same as the last of them
        cut = np.partition(np.where(counts, scores, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
        counts &= scores >= cut[:, None] - SAME
    i, j = np.nonzero(counts)
    arrays = [pa.array(q.ids[at[i]].tolist(), kinds[0]), pa.array(ids[j].tolist(), kinds[1]), pa.array(scores[i, j])]
    return pa.RecordBatch.from_arrays(arrays, names=["query_id", "chunk_id", "dense"])


# ---------------------------------------------------------------- distances between all rows

#: Rows and others of a tile, so that its distances stay in a core's cache.
TILE = (256, 1024)


def distance_sums(rows: DataFrame, others: DataFrame, names: list[list[int]]) -> DataFrame:
    """id, own, s, n: for each of ``rows`` (id, v, clusters: its cluster under each of several clusterings) the sum and number of
    its distances to the others of each cluster, rows of its id left out.

    ``names`` are the clusters of each clustering; s and n have one place for each of them all, and own are the places of the
    row's.  ``others``, a block of rows, is shared; a distance is worked out once for all clusterings, and no pair is made.
    """
    spark = rows.sparkSession
    prepare(spark, root())
    held = others.select("id", F.col("v").cast("array<double>").alias("v"), "clusters").collect()  # a block
    begin = np.cumsum([0, *map(len, names)])
    place = [{c: int(begin[i]) + j for j, c in enumerate(own)} for i, own in enumerate(names)]
    of: dict[int, list] = {}
    for r in held:
        of.setdefault(len(r.v), []).append(r)
    shared = {}
    for n, own in of.items():
        hot = np.zeros((len(own), begin[-1]))
        for i, r in enumerate(own):
            hot[i, [p[c] for p, c in zip(place, r.clusters, strict=True)]] = 1.0
        at: dict = {}
        for i, r in enumerate(own):
            at.setdefault(r.id, []).append(i)
        shared[n] = (at, np.array([r.v for r in own]), hot)
    share = spark.sparkContext.broadcast((place, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shared = share.value
        for b in batches:
            for at, x in by_length(b.column("v")):
                if x.shape[1] not in shared:
                    continue
                same, y, hot = shared[x.shape[1]]
                ids, square = b.column("id").take(pa.array(at)), (y**2).sum(axis=1)
                sums, n = np.zeros((len(at), hot.shape[1])), np.tile(hot.sum(axis=0), (len(at), 1))
                mine = [(i, j) for i, k in enumerate(ids.to_pylist()) for j in same.get(k, ())]
                for i, j in mine:
                    n[i] -= hot[j]
                mine = np.array(mine, np.int64).reshape(-1, 2)
                for i in range(0, len(at), TILE[0]):
                    part = x[i : i + TILE[0]]
                    size = (part**2).sum(axis=1)[:, None]
                    here = mine[(mine[:, 0] >= i) & (mine[:, 0] < i + len(part))]
                    for j in range(0, len(y), TILE[1]):
                        gap = part @ (-2 * y[j : j + TILE[1]].T)
                        gap += size
                        gap += square[j : j + TILE[1]]
                        np.maximum(gap, 0.0, out=gap)
                        np.sqrt(gap, out=gap)
                        own = here[(here[:, 1] >= j) & (here[:, 1] < j + TILE[1])]
                        gap[own[:, 0] - i, own[:, 1] - j] = 0.0
                        sums[i : i + len(part)] += gap @ hot[j : j + TILE[1]]
                clusters = [[p[c] for p, c in zip(place, r, strict=True)] for r in b.column("clusters").take(pa.array(at)).to_pylist()]
                off = pa.array(np.arange(len(at) + 1, dtype=np.int32) * hot.shape[1])
                lists = [pa.ListArray.from_arrays(off, pa.array(c.ravel())) for c in (sums, n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(clusters, pa.list_(pa.int32())), *lists], names=["id", "own", "s", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("v").cast("array<double>").alias("v"), "clusters").mapInArrow(run, f"id {kind}, own array<int>, s array<double>, n array<bigint>")
