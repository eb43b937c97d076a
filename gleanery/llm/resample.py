"""Importance resampling toward a target: weights from hashed word runs, drawn without replacement by Gumbel noise.

Features of a text are its runs of one to three words; each falls into one of 10,000 buckets by its CRC-32.  One pass adds up
the corpus's buckets, a second one looks every feature's gain up in an array and sums them to a document's weight.  CRC-32 is
linear, so a run's checksum comes from those of its words, without a string being made.

The draw is a merge.  A quantile of the scores, checked by an exact count, leaves the rows that can be among those drawn; they
are sorted within their partition and cut into blocks (a sorted run for each partition).  Splitters, taken from the blocks,
cut the runs into ranges of score whose sizes are counted exactly, so every range knows the rank it starts at, and ranges
beyond the draw aren't read.  Within a range a tournament tree merges the runs: blocks arrive in the order of their first row,
so about one block of a run is held at a time, and the merge stops at the exact count.

Results in special cases: a null or empty text has no features, weight 0 and no words; a null id has no hash, so its score and
rank are null and it isn't among those drawn from, but its features count; repeated rows are documents each and take ranks of
their own in any order; ties go to the smaller id; an empty corpus or an empty target gives finite gains (10,000 is added to
every total); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, RUN, LEAST_WORDS, PART, OF, SEED = 10_000, 3, 20, 5, 100, 42
#: Words whose runs are hashed at once, rows of a block of a sorted run, keys of a block that splitters are taken from, and the
#: accuracy of the quantile that eligible rows are cut at.
SLICE, BLOCK, MARKS, ACCURACY = 1 << 18, 128, 4, 10_000

# ---------------------------------------------------------------- checksums of word runs

_BYTE = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
_BYTE = _BYTE ^ _BYTE[0]  # what a byte's difference does to the checksum: the table, up to a constant


def _step(crc: np.ndarray) -> np.ndarray:
    """The linear part of one more byte: what it makes of a checksum."""
    return _BYTE[crc & 0xFF] ^ (crc >> np.uint32(8))


def _shifts(most: int) -> np.ndarray:
    """[n, j, b]: what n more bytes make of byte b at place j of a checksum."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(most):
        out.append(_step(out[-1]))
    return np.stack(out)


def _moved_by(table: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    return table[at + (crc & 0xFF)] ^ table[at + 256 + ((crc >> 8) & 0xFF)] ^ table[at + 512 + ((crc >> 16) & 0xFF)] ^ table[at + 768 + (crc >> 24)]


_LONGEST = 64
_SHIFT = _shifts(_LONGEST).reshape(-1)
_POWERS = [_SHIFT[1024:2048]]  # 1, 2, 4, ... more bytes
for _ in range(40):
    _POWERS.append(_moved_by(_POWERS[-1], 0, _POWERS[-1]))


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The linear part of n more bytes."""
    out = _moved_by(_SHIFT, np.minimum(n, _LONGEST) * 1024, crc)
    far = np.flatnonzero(n > _LONGEST)
    left, power = n[far] - _LONGEST, 0
    while len(far):
        odd = far[left & 1 == 1]
        out[odd] = _moved_by(_POWERS[power], 0, out[odd])
        left, power = left >> 1, power + 1
        far, left = far[left > 0], left[left > 0]
    return out


def word_checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word after A-Z are lower-cased."""
    length = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-length, kind="stable")
    at, left = starts[order], -length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    live, k = len(at), 0
    while live and k < _LONGEST:
        live = int(np.searchsorted(left, -k, side="left"))  # words of more than k bytes come first
        byte = common.LOWER[raw[at[:live] + k]]
        crc[:live] = _BYTE[(crc[:live] ^ byte) & 0xFF] ^ (crc[:live] >> np.uint32(8))
        k += 1
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > _LONGEST):
        out[i] = zlib.crc32(common.LOWER[raw[starts[i] : ends[i]]].tobytes())
    return out


def runs(crc: np.ndarray, length: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, checksums of all runs of n words) for n up to ``width``; the run at i ends at word i + n - 1."""
    space = np.uint32(zlib.crc32(b" "))
    now = crc
    for n in range(1, width + 1):
        yield n, now
        if len(now) < 2:
            return
        # and a space, and the next word: a checksum of two parts is the first, moved by the second's length, and the second
        now = _step(now[:-1]) ^ space
        now = moved(now, length[n:]) ^ crc[n:]


def features(raw: np.ndarray, off: np.ndarray, width: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) arrays of all features of a batch, some words at a time."""
    starts, ends, first = common.word_bounds(raw, off, common.NON_WORD_CASED)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for i in range(0, len(starts), SLICE):
        j = min(len(starts), i + SLICE)
        over = min(len(starts), j + width - 1)  # runs that start in this slice may end after it
        crc = word_checksums(raw, starts[i:over], ends[i:over])
        for n, found in runs(crc, ends[i:over] - starts[i:over], width):
            found = found[: j - i]
            mine = text[i : i + len(found)]
            whole = mine == text[i + n - 1 : i + n - 1 + len(found)]
            yield mine[whole], (found[whole] % np.uint32(buckets)).astype(np.int64)


# ---------------------------------------------------------------- weights

def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often a feature of all texts falls into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, bucket in features(*common.text_bytes(b.column(0))):
                total += np.bincount(bucket, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string")).mapInArrow(common.frugal(run), "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both sides' smoothed shares, rounded down."""
    s, t, big_s, big_t = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum())
    ratio = (t + 1) * (big_s + BUCKETS) / ((s + 1) * (big_t + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(h: str) -> int:
    """Thousandths of a Gumbel draw from the first 32 bits of a hexadecimal hash, rounded down."""
    return math.floor(-1000 * math.log(-math.log((int(h[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    share = docs.sparkSession.sparkContext.broadcast(gain)  # as many numbers as buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = common.text_bytes(b.column("text"))
            n_words, n, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for k, (text, bucket) in enumerate(features(raw, off)):
                each = np.bincount(text, minlength=b.num_rows)
                n += each
                # the features of a text stand together
                there = np.flatnonzero(each)
                if len(there):
                    weight[there] += np.add.reduceat(share.value[bucket], np.concatenate([[0], np.cumsum(each[there])[:-1]]))
            first = common.word_bounds(raw, off, common.NON_WORD_CASED)[2]
            n_words[:] = np.diff(first)
            extra = [None if h is None else noise(h) for h in b.column("h").to_pylist()]
            score = [None if e is None else int(w) + e for w, e in zip(weight, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    return rows.mapInArrow(common.frugal(run), "doc_id long, n_words long, n_features long, weight long, score long")


# ---------------------------------------------------------------- sorted runs and their merge

#: A key is (-score, id, row): smaller is better.  A block's keys are packed as three columns of 64-bit integers.
KEY = ("score", "doc_id", "row")
BLOCKS = "run int, score long, doc_id long, row long, n int, keys binary"


def _keys(data: bytes) -> list[tuple[int, int, int]]:
    return list(struct.iter_unpack("<3q", data))


def _block(run: int, keys: np.ndarray) -> pa.RecordBatch:
    first = [pa.array([int(v)], pa.int64()) for v in keys[0]]
    return pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), *first, pa.array([len(keys)], pa.int32()), common.binary_list([keys.astype("<i8").tobytes()])], names=["run", *KEY, "n", "keys"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's sorted rows, each with its first key."""
    held, run = np.empty((0, 3), np.int64), 0
    for b in batches:
        if b.num_rows:
            run = b.column("run")[0].as_py()
            held = np.concatenate([held, np.stack([b.column(n).to_numpy() for n in KEY], axis=1)])
        while len(held) >= BLOCK:
            yield _block(run, held[:BLOCK])
            held = held[BLOCK:]
    if len(held):
        yield _block(run, held)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some keys of every block."""
    for b in batches:
        found = [k for data in b.column("keys").to_pylist() for keys in [_keys(data)] for k in keys[:: max(1, len(keys) // MARKS)]]
        cols = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(KEY))


def _at_splitters(splitters: list[tuple[int, int, int]]):
    """Blocks cut at the splitters, each piece with the range it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, data in zip(b.column("run").to_pylist(), b.column("keys").to_pylist(), strict=True):
                keys, i = _keys(data), 0
                while i < len(keys):
                    part = bisect_right(splitters, keys[i])
                    j = bisect_left(keys, splitters[part], i) if part < len(splitters) else len(keys)
                    yield _block(no, np.array(keys[i:j], np.int64)).append_column("part", pa.array([part], pa.int32()))
                    i = j

    return run


class Tournament:
    """A tree of matches between sorted runs; the winner is the run whose next key is smallest.

    A run takes part in blocks: one that has no rows left loses every match until its next block comes.
    """

    def __init__(self) -> None:
        self.size = 1
        self.won: list[int] = [0, 0]  # of each match, the slot that won; leaves are slots
        self.held: list[list] = [[]]  # of each slot its keys, the best one last
        self.slot: dict[int, int] = {}

    def _key(self, slot: int):
        return self.held[slot][-1] if self.held[slot] else None

    def _match(self, node: int) -> None:
        a, b = (2 * node - self.size, 2 * node + 1 - self.size) if 2 * node >= self.size else (self.won[2 * node], self.won[2 * node + 1])
        x, y = self._key(a), self._key(b)
        self.won[node] = b if x is None or (y is not None and y < x) else a

    def _replay(self, slot: int) -> None:
        node = (slot + self.size) // 2
        while node:
            self._match(node)
            node //= 2

    def add(self, run: int, keys: list) -> None:
        """The next block of a run: its keys in order, none before those that it already has."""
        if run not in self.slot:
            self.slot[run] = len(self.slot)
            if len(self.slot) > self.size:
                self.held += [[] for _ in range(self.size)]
                self.size *= 2
                self.won = [0] * self.size
                for node in range(self.size - 1, 0, -1):
                    self._match(node)
        slot = self.slot[run]
        self.held[slot] = keys[::-1] + self.held[slot]
        self._replay(slot)

    def best(self):
        return self._key(self.won[1] if self.size > 1 else 0)

    def pop(self):
        slot = self.won[1] if self.size > 1 else 0
        key = self.held[slot].pop()
        self._replay(slot)
        return key


def merged(blocks: Iterator[tuple[int, list]]) -> Iterator[tuple[int, int, int]]:
    """Keys of all runs in order; blocks come in the order of their first keys."""
    tree = Tournament()
    for run, keys in blocks:
        # what is before the block's first key can't be beaten any more
        while (top := tree.best()) is not None and top < keys[0]:
            yield tree.pop()
        tree.add(run, keys)
    while tree.best() is not None:
        yield tree.pop()


def _merge(starts: dict[int, int], draw: int):
    """row and rank of the drawn ones of each range; ranges come whole, blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((p, no, _keys(k)) for b in batches for p, no, k in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), b.column("keys").to_pylist(), strict=True))
        ahead = next(stream, None)
        while ahead is not None:
            part = ahead[0]

            def of_part() -> Iterator[tuple[int, list]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == part:
                    now = ahead
                    ahead = next(stream, None)
                    yield now[1], now[2]

            source, rank, out = of_part(), starts[part], []
            for key in merged(source):
                if rank >= draw:
                    break
                rank += 1
                out.append((key[2], rank))
                if len(out) == 1 << 14:
                    yield _ranks(out)
                    out = []
            yield _ranks(out)
            for _ in source:  # what is left of a range that the draw ends in
                pass

    return run


def _ranks(out: list[tuple[int, int]]) -> pa.RecordBatch:
    row, rank = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(rank, pa.int64())], names=["row", "rank"])


def contenders(rows: DataFrame, draw: int, total: int) -> DataFrame:
    """Rows whose score may be among the ``draw`` best of ``total``: those from a quantile on, if that many reach it."""
    at = max(0.0, 1 - draw / total - 2 / ACCURACY)
    least = rows.agg(F.percentile_approx("score", at, ACCURACY)).first()[0]
    near = rows.where(F.col("score") >= least)
    return near if near.count() >= draw else rows


def drawn(rows: DataFrame, draw: int, total: int) -> DataFrame:
    """row and rank (from 1) of the ``draw`` best of (score, doc_id, row): highest score, then smallest id, then row."""
    spark: SparkSession = rows.sparkSession
    if not draw:
        return spark.createDataFrame([], "row long, rank long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = contenders(rows, draw, total).select(F.spark_partition_id().alias("run"), (-F.col("score")).alias("score"), "doc_id", "row")
    blocks = common.table(near.sortWithinPartitions(*KEY).mapInArrow(common.frugal(_blocks), BLOCKS), "resample-runs")
    # keys from all blocks, dealt into as many ranges as there are partitions: where each of them begins
    marks = blocks.mapInArrow(common.frugal(_marks), "score long, doc_id long, row long").repartitionByRange(parts, *KEY)
    first = marks.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*KEY)).alias("first")).collect()  # a row for each partition
    splitters = sorted(tuple(r.first) for r in first)[1:]
    pieces = common.table(blocks.mapInArrow(common.frugal(_at_splitters(splitters)), BLOCKS + ", part int"), "resample-pieces")
    starts, before = {}, 0
    for r in sorted(pieces.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row for each range
        starts[r.part], before = before, before + r.n
    needed = pieces.where(F.col("part") <= max(p for p in starts if starts[p] < draw))
    ordered = needed.repartition(parts, "part").sortWithinPartitions("part", *KEY)
    return ordered.select("part", "run", "keys").mapInArrow(common.frugal(_merge(starts, draw)), "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, part: int = PART, of: int = OF, least: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Columns doc_id, n_features, weight, score, rank (null where not drawn) and n_words of every document."""
    common.prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = common.table(scored(docs, gain, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    able = rows.where((F.col("n_words") >= least) & F.col("doc_id").isNotNull())
    total = able.count()
    ranks = drawn(able.select("score", "doc_id", "row"), part * total // of, total)
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def _grams(table: str, key: str) -> str:
    return rf"""(SELECT {key}, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))))) AS g
  FROM (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {table}))"""


#: CRC-32 by its definition, byte by byte over a table made of its polynomial.
ORACLE = rf"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
dg AS MATERIALIZED {_grams('documents', 'doc_id')}, bg AS MATERIALIZED {_grams('benchmark', 'item_id')},
hx AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
crc AS MATERIALIZED (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS k FROM hx, tab
),
s AS (SELECT k, count(*) AS s FROM dg JOIN crc USING (g) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bg JOIN crc USING (g) GROUP BY k),
gain AS MATERIALIZED (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dg) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bg) + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (k)
),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dg JOIN crc USING (g) JOIN gain USING (k) GROUP BY doc_id),
a AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> ''))::BIGINT AS n_words,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM a WHERE n_words >= {LEAST_WORDS})
SELECT a.doc_id, n_features, weight, score, r.r AS rank, n_words FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.r <= {PART} * (SELECT count(*) FROM r) // {OF}
"""
