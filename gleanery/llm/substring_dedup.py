"""Substring dedup: long passages that a document with a smaller id has too are removed, exactly, window by window.

The windows (runs of ``window`` words) are the edges of a de Bruijn graph.  As in minimiser-based compaction, consecutive
edges with one minimiser (the smallest hash of a ``K``-word run in a window) form a super-run: equal windows have equal
minimisers, so only super-runs of one minimiser can share an edge, and the graph falls apart by minimiser.  Where a
minimiser has one super-run only, its nodes don't branch and the path is compacted whole; where it has several, the path
may branch at any of its nodes, and its edges are looked at one by one.

1. Minimisers that two documents have (a partial aggregate by minimiser); all other super-runs are dropped.
2. Super-runs of shared minimisers, equal ones compacted into one path, with the smallest document that has it: its source.
3. Each path is read again at its source's coordinates, once: a digest of its words, and where the minimiser branches its
   edges (128 bits each), which are joined to give each edge the smallest document of all paths that have it.
4. Back in the documents, super-runs are removed whole where a smaller document has them, by single edges where they are
   first.  Before, their words are compared with the words at the source by digest (128 bits, BLAKE2b over the words):
   hashes only say where to look, and where two different runs had one hash nothing is removed.  The covered word
   coordinates glue the removed spans together again.

A passage in a third of all documents is a minimiser with that many rows; these joins have a written table or a plain
exchange on either side, so Spark can split them when skewed, and nothing collects a group.  Texts move twice, by id;
window hashes of unshared text never move.

Results in special cases: a null or empty text has no words and an empty kept text; texts shorter than a window stay;
windows repeated within one document only stay; rows with one doc_id aren't smaller than each other; a null doc_id
neither removes nor is removed; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, K, LONGEST = 13, 5, 32
_SECOND, _FACTOR = np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)


def super_runs(column: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """For all texts of a column: minimiser, run hash, text, first window (word place in the text) and edges of each run;
    then the window hashes, word bounds, first words and word hashes that these refer to."""
    raw, off = common.text_bytes(column)
    starts, ends, first = common.word_bounds(raw, off, common.SPACE)
    h = common.word_hashes(raw, starts, ends)
    edge = common.grams(h, window)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    none = np.empty(0, np.int64)
    if not len(edge):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, edge, raw, starts, ends, first, h
    k = min(K, window)
    small = common.grams(h, k)
    low = small[: len(edge)].copy()
    for j in range(1, window - k + 1):
        np.minimum(low, small[j : j + len(edge)], out=low)
    at = np.flatnonzero(text[: len(edge)] == text[window - 1 :])  # windows within one text
    low, own = low[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(place % LONGEST == 0)  # longer runs (of repeating words) in parts
    size = np.diff(np.append(begin, len(at)))
    if not len(begin):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, edge, raw, starts, ends, first, h
    inside = np.arange(len(at)) - np.repeat(begin, size)
    run = common.mix(np.add.reduceat(edge[at] * common._POW[inside], begin) + size.astype(np.uint64))
    where = at[begin]
    return low[begin], run, own[begin], where, size, edge, raw, starts, ends, first, h


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def second_grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words that are independent of ``common.grams``, to make 128 bits with them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = common.mix(h ^ _SECOND)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = (x ^ g[j : j + n]) * _FACTOR
    return common.mix(x)


class Words:
    """The words of a batch joined by single separators, so that a run of words is one slice of bytes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ln = ends - starts + 1
        self.at = np.concatenate(([0], np.cumsum(ln)))
        if len(starts):
            src = np.arange(int(self.at[-1])) - np.repeat(self.at[:-1] - starts, ln)
            joined = np.append(raw, np.uint8(32))[np.minimum(src, len(raw))]
            joined[self.at[1:] - 1] = 32
            self.bytes = memoryview(joined)
        else:
            self.bytes = memoryview(b"")

    def digest(self, a: int, n: int) -> bytes:
        """128 bits over the words a to a + n - 1."""
        return hashlib.blake2b(self.bytes[self.at[a] : self.at[a + n]], digest_size=16).digest()


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and cuts: array of (run, cut, seal), the super-runs to remove from it; cut -1 for all edges, else by bit."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, run, own, *_ = super_runs(b.column(1), window)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), _as_long(low), _as_long(run)], names=["doc_id", "low", "run"])

    rows = texts.mapInArrow(common.frugal(emit), "doc_id long, low long, run long")
    lows = rows.select("doc_id", "low").groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("low")
    lows = common.table(lows, "runs-shared")
    common.release_shuffles(spark)
    shared = common.table(rows.join(lows, "low", "left_semi"), "runs")
    common.done_with(lows)
    paths = common.table(shared.groupBy("low", "run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "paths")
    # a table, so that the join below has a plain exchange on either side, which Spark splits where a minimiser is hot
    branching = common.table(paths.groupBy("low").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("low", F.lit(True).alias("branches")), "branching")
    flagged = paths.join(branching, "low", "left").select("run", F.col("first").alias("doc_id"), (F.col("first") < F.col("last")).alias("copied"), F.coalesce("branches", F.lit(False)).alias("branches"))
    # a document's own runs, so no more than its text has
    asked = flagged.where("copied or branches").groupBy("doc_id").agg(F.collect_list(F.struct("run", "copied", "branches")).alias("runs"))

    def read_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each path asked for a row with its digest (bit -1), and one for each edge where it branches."""
        for b in batches:
            _, run, own, where, size, edge, raw, starts, ends, first, h = super_runs(b.column("text"), window)
            words, second = Words(raw, starts, ends), second_grams(h, window)
            signed = run.view(np.int64)
            span = np.searchsorted(own, np.arange(len(b) + 1))
            offsets = b.column("runs").offsets.to_numpy()
            listed = b.column("runs").values
            names, copied, branches = (listed.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            seals, heads, edges = [], [], []
            for i in range(len(b)):
                w = slice(offsets[i], offsets[i + 1])
                mine, place = np.unique(signed[span[i] : span[i + 1]], return_index=True)
                at = np.searchsorted(mine, names[w])
                for name, c, br, j in zip(names[w].tolist(), copied[w].tolist(), branches[w].tolist(), (span[i] + place[np.minimum(at, len(mine) - 1)]).tolist() if len(mine) else (), strict=False):
                    if signed[j] != name:  # another text of the same id has it
                        continue
                    m = int(size[j])
                    seals.append(words.digest(int(where[j]), m + window - 1))
                    heads.append((ids[i], name, c, m if br else 0))
                    edges.append(np.arange(where[j], where[j] + m if br else where[j]))
            head = np.array([(d, n, c) for d, n, c, _ in heads], np.int64).reshape(-1, 3)
            m = np.array([h[3] for h in heads], np.int64)
            at = np.concatenate(edges) if edges else np.empty(0, np.int64)
            bits = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            seal = np.frombuffer(b"".join(seals), np.int64).reshape(-1, 2)
            both = lambda x, y: pa.array(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays(
                [both(head[:, 0], np.repeat(head[:, 0], m)), both(head[:, 1], np.repeat(head[:, 1], m)), pa.array(np.concatenate([head[:, 2], np.repeat(head[:, 2], m)]).astype(bool)),
                 pa.array(np.concatenate([np.full(len(head), -1), bits]).astype(np.int32)), both(seal[:, 0], edge[at].view(np.int64)), both(seal[:, 1], second[at].view(np.int64))],
                names=["first", "run", "copied", "bit", "x", "y"],
            )

    read = texts.join(asked, "doc_id").select("doc_id", "text", "runs").mapInArrow(common.frugal(read_sources), "first long, run long, copied boolean, bit int, x long, y long")
    found = common.table(read, "edges")
    common.done_with(paths, branching)
    edges = found.where("bit >= 0")
    earlier = edges.groupBy("x", "y").agg(F.min("first").alias("f"), F.max("first").alias("l")).where("f < l").select("x", "y", "f")
    earlier = common.table(earlier, "edges-shared")  # as above: the join on edges can be split
    masks = edges.select("x", "y", "first", "run", "bit").join(earlier, ["x", "y"]).where("f < first").select("run", "first", F.expr("shiftleft(1L, bit)").alias("m"))
    masks = masks.groupBy("run", "first").agg(F.bit_or("m").alias("mask"))
    # a run with one document only matters where it has edges of others; texts that share an id give a seal each, the smaller counts
    seals = found.where("bit < 0").groupBy("run", "first").agg(F.max("copied").alias("copied"), F.min(F.struct("x", "y")).alias("seal"))
    marks = seals.join(masks, ["run", "first"], "left").where("mask is not null or copied")
    marks = common.table(marks.select("run", "first", "mask", "seal"), "marks")
    common.done_with(found, earlier)
    cuts = shared.select("doc_id", "run").distinct().join(marks, "run").withColumn("cut", F.when(F.col("doc_id") > F.col("first"), F.lit(-1).cast("long")).otherwise(F.coalesce("mask", F.lit(0).cast("long"))))
    cuts = cuts.where("cut <> 0").groupBy("doc_id").agg(F.collect_list(F.struct("run", "cut", F.col("seal.x").alias("x"), F.col("seal.y").alias("y"))).alias("cuts"))
    cuts = common.table(cuts, "cuts")
    common.done_with(shared, marks)
    return cuts


def _covered(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its bytes, word starts, word ends, and whether each word is removed."""
    _, run, own, where, size, _, raw, starts, ends, first, _ = super_runs(batch.column("text"), window)
    words = Words(raw, starts, ends)
    signed = run.view(np.int64)
    span = np.searchsorted(own, np.arange(len(batch) + 1))
    for i, cuts in enumerate(batch.column("cuts").to_pylist()):
        a, z = first[i], first[i + 1]
        gone = np.zeros(z - a + 1, np.int64)
        if cuts:
            what = {c["run"]: (c["cut"], c["x"], c["y"]) for c in cuts}
            lo = span[i]
            mine = signed[lo : span[i + 1]]
            for j in lo + np.flatnonzero(np.isin(mine, np.fromiter(what, np.int64, len(what)))):
                (mask, x, y), at, m = what[int(signed[j])], int(where[j]), int(size[j])
                if words.digest(at, m + window - 1) != x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True):
                    continue  # other words than at the source
                at -= a
                if mask == -1:
                    gone[at] += 1
                    gone[at + m + window - 1] -= 1
                else:
                    for t in range(m):
                        if mask >> t & 1:
                            gone[at + t] += 1
                            gone[at + t + window] -= 1
        yield raw, starts[a:z], ends[a:z], np.cumsum(gone)[:-1] > 0


def _kept(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """Words that stay, joined by one space."""
    s, e = starts[~gone], ends[~gone]
    if not len(s):
        return b""
    ln = e - s + 1
    base = np.cumsum(ln) - ln
    at = np.arange(int(ln.sum())) - np.repeat(base, ln) + np.repeat(s, ln)
    out = np.append(raw, np.uint8(32))[np.minimum(at, len(raw))]
    out[np.cumsum(ln) - 1] = 32
    return out[:-1].tobytes()


def _with_cuts(docs: DataFrame, cuts: DataFrame, id_col: str) -> DataFrame:
    return docs.join(cuts.withColumnRenamed("doc_id", "_cut_id"), F.col(id_col).cast("long") == F.col("_cut_id"), "left").drop("_cut_id")


def dedup_report(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    cuts = removals(docs, window, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _with_cuts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), cuts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for raw, s, e, g in _covered(b, window):
                n.append(len(s))
                gone.append(int(g.sum()))
                sha.append(hashlib.sha256(_kept(raw, s, e, g)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(common.frugal(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words out of the text (kept words joined by one space); untouched texts as they are."""
    cuts = removals(docs, window, id_col, text_col)
    names = docs.columns
    rows = _with_cuts(docs.select(*(F.col(f"`{c}`").alias("text" if c == text_col else f"c{i}") for i, c in enumerate(names)), F.col(f"`{id_col}`").alias("_id")), cuts, "_id").drop("_id")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t if not g.any() else _kept(raw, s, e, g).decode() for t, (raw, s, e, g) in zip(old, _covered(b, window), strict=True)]
            cols = list(b.columns[:-1])
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    out = rows.mapInArrow(common.frugal(run), rows.drop("cuts").schema)
    return out.toDF(*names)
