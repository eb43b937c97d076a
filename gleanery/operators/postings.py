"""The index behind BM25: postings in blocks of a term and a segment of chunks, read only where they can matter.

Chunks fall into segments by the hash of their id.  A block holds a term's postings in a segment, each with what it adds to a
score but for the term's weight, and the most that any of them adds.  Blocks are sorted by term, so a few terms' blocks are
found by the bounds that files keep of their rows.

A search for k chunks first scores the k segments whose bounds promise a question most: that gives it a score its k-th best chunk reaches.  From the blocks' bounds alone follows which segments can reach it; their blocks meet by segment, where a question's
terms are added up strongest first, and what can't reach the threshold with all that is left is dropped.  The result is that of
scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gleanery.operators import words

#: Rows that are packed at once, and what scores that round to the same differ by.
PACKED, SAME = 1 << 16, 4e-9


def packed(rows: DataFrame, id_type: DataType) -> DataFrame:
    """Blocks of postings that come as rows (term, seg, chunk_id, part), sorted by the first two."""
    kind = to_arrow_type(id_type)

    def out(t: pa.Table, first: np.ndarray, upto: int) -> pa.RecordBatch:
        off = pa.array(np.append(first, upto).astype(np.int32))
        parts = t.column("part").slice(0, upto).to_numpy()
        lists = [pa.ListArray.from_arrays(off, t.column(c).slice(0, upto).combine_chunks().cast(k)) for c, k in (("chunk_id", kind), ("part", pa.float64()))]
        at = pa.array(first)
        own = [t.column(c).take(at).combine_chunks() for c in ("term", "seg")]
        own = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in own]
        sizes = [pa.array(np.diff(np.append(first, upto)).astype(np.int64)), pa.array(np.maximum.reduceat(parts, first))]
        return pa.RecordBatch.from_arrays([*own, *sizes, *lists], names=["term", "seg", "n", "top", "ids", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            t = pa.Table.from_batches(held).combine_chunks()
            term, seg = t.column("term"), t.column("seg").to_numpy()
            new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy() | (seg[1:] != seg[:-1])
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            if last or len(first) == 1:  # a block that fills a pack by itself comes in pieces
                yield out(t, first, len(seg))
                held, n = [], 0
            else:
                yield out(t, first[:-1], int(first[-1]))
                held = t.slice(int(first[-1])).to_batches()
                n = sum(b.num_rows for b in held)

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACKED:
                yield from cut(False)
        if n:
            yield from cut(True)

    kind_ = id_type.simpleString()
    return rows.select("term", "seg", "chunk_id", "part").mapInArrow(run, f"term string, seg bigint, n bigint, top double, ids array<{kind_}>, parts array<double>")


def of_segments(laid: DataFrame, id_type: DataType) -> DataFrame:
    """term, seg, n, words, ids, tfs, lens of rows (seg, chunk_id, text in lower case) that are sorted by the first two.

    What a task holds is a segment's texts, or a piece of them: then a block comes in several rows.  Rows of one id are one chunk.
    """
    kind = to_arrow_type(id_type)

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        seg, ids, text = (t.column(c).combine_chunks() for c in ("seg", "chunk_id", "text"))
        ids, text = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, text))
        segs, doc = seg.to_numpy(), ids.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        place, own = np.unique(segs, return_inverse=True)
        row, code, names = words.symbols(text)
        (at, term, chunk), tf = words.counted(own[row], code, doc[row])
        length = np.bincount(doc[row], minlength=int(doc.max()) + 1)[chunk]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (term[1:] != term[:-1])])) if len(at) else np.zeros(0, np.int64)
        off = np.append(first, len(at))
        listed = ids.take(pa.array(np.unique(doc, return_index=True)[1][chunk]))
        lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), c) for c in (listed.cast(kind), pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32)))]
        total = np.add.reduceat(tf, first) if len(first) else np.zeros(0, np.int64)
        cols = [names.take(pa.array(term[first])), pa.array(place[at[first]]), pa.array(np.diff(off).astype(np.int64)), pa.array(total.astype(np.int64)), *lists]
        return pa.RecordBatch.from_arrays(cols, names=["term", "seg", "n", "words", "ids", "tfs", "lens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in words.pieces(batches):
            # a chunk's rows stay together, and small segments share a batch
            start, end = (tuple(b.column(c)[i].as_py() for c in ("seg", "chunk_id")) for i in (0, -1))
            if held and size + b.nbytes > 2 * words.PIECE and start != last:
                yield blocks(held)
                held, size = [], 0
            held.append(b)
            size, last = size + b.nbytes, end
        if held:
            yield blocks(held)

    kind_ = id_type.simpleString()
    return laid.select("seg", "chunk_id", "text").mapInArrow(run, f"term string, seg bigint, n bigint, words bigint, ids array<{kind_}>, tfs array<int>, lens array<int>")


def weighed(blocks: DataFrame, id_type: DataType, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """term, seg, n, top, ids, parts of rows as ``of_segments`` has them; ``part`` of a chunk's count of the term and of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = b.column("tfs").offsets.to_numpy()
            parts = part(*(b.column(c).flatten().to_numpy().astype(float) for c in ("tfs", "lens")))
            if b.num_rows:
                lists = pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(parts))
                top = pa.array(np.maximum.reduceat(parts, off[:-1] - off[0]))  # no block is empty
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("term", "seg", "n")), top, b.column("ids"), lists], names=["term", "seg", "n", "top", "ids", "parts"])

    kind = id_type.simpleString()
    return blocks.select("term", "seg", "n", "ids", "tfs", "lens").mapInArrow(run, f"term string, seg bigint, n bigint, top double, ids array<{kind}>, parts array<double>")


class Questions:
    """A block of questions on the driver: for each term who asks for it and with what weight.  As large as their words."""

    def __init__(self, rows: list) -> None:
        self.ids = sorted({r.query_id for r in rows})
        no = {q: i for i, q in enumerate(self.ids)}
        of: dict[str, list[tuple[int, float]]] = {}
        for r in rows:
            of.setdefault(r.term, []).append((no[r.query_id], r.w))
        self.weights = {t: (np.array([q for q, _ in own]), np.array([w for _, w in own])) for t, own in of.items()}
        self.least = np.full(len(self.ids), -np.inf)

    def reached(self, scores: dict) -> None:
        """Scores that questions' k-th best chunks reach; what stays under them doesn't count."""
        self.least = np.array([scores.get(q, -np.inf) for q in self.ids]) - SAME

    def bounds(self, terms: list[str], tops: np.ndarray) -> np.ndarray:
        """The most that a chunk of a segment with these blocks can score, for each question."""
        out = np.zeros(len(self.ids))
        for t, top in zip(terms, tops, strict=True):
            at, w = self.weights[t]
            out[at] += w * top
        return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each segment, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            seg = b.column("seg").to_numpy()
            if held and held[0].column("seg")[0].as_py() != seg[0]:
                yield pa.Table.from_batches(held)
                held = []
            n = int(np.searchsorted(seg, seg[0], side="right"))
            held.append(b.slice(0, n))
            b = b.slice(n)
    if held:
        yield pa.Table.from_batches(held)


def by_segment(rows: DataFrame) -> DataFrame:
    return rows.repartition("seg").sortWithinPartitions("seg")


def promising(blocks: DataFrame, share, k: int) -> DataFrame:
    """seg: the k segments of each question with the highest bounds.  A task passes on its own best alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = share.value
        most, seg = np.zeros((len(q.ids), k)), np.zeros((len(q.ids), k), np.int64)
        for t in _segments(batches):
            bound = q.bounds(t.column("term").to_pylist(), t.column("top").to_numpy())
            worst = most.argmin(axis=1)
            at = np.flatnonzero(bound > most[np.arange(len(bound)), worst])
            most[at, worst[at]], seg[at, worst[at]] = bound[at], t.column("seg")[0].as_py()
        no, i = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(seg[no, i]), pa.array(most[no, i])], names=["no", "seg", "most"])

    rows = by_segment(blocks.select("term", "seg", "top")).mapInArrow(run, "no int, seg bigint, most double")
    best = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("most"), "seg"))
    return rows.withColumn("at", best).where(F.col("at") <= k).select("seg").distinct()


def needed(blocks: DataFrame, share) -> DataFrame:
    """term and seg of the blocks that may hold one of the best, from their bounds alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = share.value
        for t in _segments(batches):
            terms = t.column("term").to_pylist()
            open_ = q.bounds(terms, t.column("top").to_numpy()) >= q.least
            keep = np.array([bool(open_[q.weights[x][0]].any()) for x in terms])
            own = t.filter(pa.array(keep)).select(["term", "seg"]).combine_chunks()
            yield from own.to_batches()

    return by_segment(blocks.select("term", "seg", "top")).mapInArrow(run, "term string, seg bigint")


def scored(blocks: DataFrame, share, k: int | None, query_type: DataType, id_type: DataType, allowed: DataFrame | None) -> DataFrame:
    """query_id, chunk_id, score: the best k of every question and segment (all of them without k).

    ``allowed``: seg, ids; chunks that aren't among them don't count.
    """
    kinds = (to_arrow_type(query_type), to_arrow_type(id_type))
    rows = blocks.select("seg", "term", "top", "ids", "parts")
    filtered = allowed is not None
    if filtered:
        rows = rows.unionByName(allowed.select("seg", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("top"), "ids", F.array().cast("array<double>").alias("parts")))

    def of_segment(t: pa.Table, q: Questions) -> tuple[list, list, list]:
        t = t.combine_chunks()
        ids, parts = (t.column(c).chunk(0) if t.column(c).num_chunks else None for c in ("ids", "parts"))
        code = ids.flatten().dictionary_encode()
        slots, names = code.indices.to_numpy(), code.dictionary
        off = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
        values, at_part = parts.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        mine: dict[int, list] = {}
        free = None
        for i, (term, top) in enumerate(zip(t.column("term").to_pylist(), t.column("top").to_pylist(), strict=True)):
            own = slots[off[i] : off[i + 1]]
            if term is None:
                free = np.zeros(len(names), bool) if free is None else free
                free[own] = True
                continue
            part = values[at_part[i] : at_part[i + 1]]
            for no, w in zip(*q.weights[term], strict=True):
                mine.setdefault(int(no), []).append((w * top, w, own, part))
        found: tuple[list, list, list] = ([], [], [])
        if filtered and free is None:
            return found
        for no, blocks_ in mine.items():
            least = q.least[no]
            rest = sum(b[0] for b in blocks_)
            if rest < least:
                continue
            total = np.zeros(len(names))
            for most, w, own, part in sorted(blocks_, key=lambda b: -b[0]):
                if rest < least and total.max() + rest < least:
                    break  # neither what is seen nor what isn't can get there
                total[own] += w * part
                rest -= most
            else:
                ok = total >= least if least > 0 else total > 0
                if free is not None:
                    ok &= free
                at = np.flatnonzero(ok)
                if k is not None and len(at) > k:
                    at = at[total[at] >= np.partition(total[at], len(at) - k)[len(at) - k] - SAME]
                if len(at):
                    found[0].append(np.full(len(at), no))
                    found[1].append(at)
                    found[2].append(total[at])
        if not found[0]:
            return found
        return np.concatenate(found[0]).tolist(), names.take(pa.array(np.concatenate(found[1]))), np.concatenate(found[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = share.value
        for t in _segments(batches):
            who, what, score = of_segment(t, q)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array([q.ids[i] for i in who], kinds[0]), what.cast(kinds[1]), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return by_segment(rows).mapInArrow(run, f"query_id {query_type.simpleString()}, chunk_id {id_type.simpleString()}, score double")
