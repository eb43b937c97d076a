"""N-gram Jaccard join: all links between documents whose shingle sets are alike, and their components.

Two documents link when ``den * |A & B| >= num * |A | B|``.  The join is a token-group matrix, kept exact:

1. Sets.  Each text becomes its distinct shingles (64-bit hashes).  Equal sets become one: copies are members, not pairs.
2. Order.  A counter table of fixed size (2^20 counters, over all shingles of all documents) ranks shingles from rare to
   common.  Any two sets that link share at least SHARED of their first ``n - ceil(t n) + SHARED`` shingles in this
   order, whatever the order is (or ``ceil(t n)``, if that is less); rare ones first keeps passages that many documents
   share out of these prefixes.  A document with fewer prefix shingles in common with any others links with nothing.
3. Groups.  Documents with equal min-hash bands gather round the most central of them (most common shingles), the
   leader.  Those that link with the leader and those that don't form separate groups, in blocks of bounded size.  Each
   block is stored with its token union and its members' tokens.
4. Matrix.  (token, block) entries come from the members' prefixes.  Blocks that share an entry meet, except two blocks
   that are linked to one leader, as their members are in one component already.
5. Bound.  A member whose overlap with the other block's union is under ``ceil(t n)`` can't link into it and is passed
   over; only what is left is opened, and the overlaps of the members are counted (a product of 0/1 matrices).
6. Components of all links, by stars.

Results in special cases: a null, empty or blank text has no shingles, links with nothing and is its own component; a
text of fewer than k words is one shingle; rows with one doc_id are one document with several texts; a null doc_id has a
null component; ties go to the smaller id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, NUM, DEN = 3, 90, 100
COUNTERS, CHUNK = 1 << 20, 1 << 12
SHARED = 12
BANDS, BAND_ROWS = 8, 3
BLOCK_DOCS, BLOCK_TOKENS, COLUMNS = 32, 1 << 13, 1 << 14
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, off = common.text_bytes(column)
    starts, ends, first = common.word_bounds(raw, off, common.SPACE)
    h = common.word_hashes(raw, starts, ends, common.LOWER)
    g = common.grams(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(common.grams(h[a:b], int(n)) ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def ranks(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """One byte for each counter: four steps for each doubling of its count.  Counts cover all documents."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            sets = shingle_sets(b.column(0), k)
            if sets:
                total += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
        rows = total.reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), common.binary_list([rows[i].tobytes() for i in some])], names=["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, np.zeros(CHUNK, np.uint64)) + np.frombuffer(n, np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), common.binary_list([np.minimum(255, 4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in sums.values()])], names=["chunk", "r"]
        )

    counted = docs.select(text_col).mapInArrow(common.frugal(count), "chunk int, n binary").repartition(parts, "chunk")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint8)
    for r in counted.mapInArrow(common.frugal(add), "chunk int, r binary").collect():  # COUNTERS bytes in all
        out[r.chunk] = np.frombuffer(bytes(r.r), np.uint8)
    return out.ravel()


def signatures(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, key (digest of the set; null if empty), central, bands, prefix for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks(docs, k, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), k)
            n = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            rank = sent.value[_slot(tokens)]
            ordered = (rank.astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            central = np.zeros(len(n))
            bands = np.zeros((len(n), BANDS), np.uint64)
            if len(some):
                central[some] = np.add.reduceat(rank.astype(float), first) / n[some]
                for i in range(BANDS):
                    x = np.zeros(len(some), np.uint64)
                    for f in _FACTORS[i]:
                        x = common.mix(x ^ np.minimum.reduceat(common.mix(tokens * f), first))
                    bands[some, i] = x
            prefix, at = [], 0
            for size in n:
                need = int(size) - (num * int(size) + den - 1) // den + SHARED
                o = ordered[at : at + size]
                at += size
                prefix.append(np.partition(o, need - 1)[:need] if 0 < need < size else o)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array([common.digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(central),
                 common.long_list(bands.ravel(), np.full(len(n), BANDS)), common.long_list(np.concatenate(prefix) if prefix else np.empty(0, np.uint64), np.array([len(p) for p in prefix], np.int64))],
                names=["doc_id", "n", "key", "central", "bands", "prefix"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.frugal(run), f"doc_id {kind}, n long, key binary, central double, bands array<long>, prefix array<long>")


def _links(pairs: list[tuple[int, int]], flags: list[bool] | None = None) -> pa.RecordBatch:
    cols = list(zip(*pairs, strict=True)) if pairs else [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices over slices of the tokens."""
    universe, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows_a = np.repeat(np.arange(len(a)), [len(s) for s in a])
    rows_b = np.repeat(np.arange(len(b)), [len(s) for s in b])
    at_a, at_b = at[: len(rows_a)], at[len(rows_a) :]
    out = np.zeros((len(a), len(b)))
    for low in range(0, len(universe), COLUMNS):
        m = np.zeros((len(a), COLUMNS), np.float32)
        own = (at_a >= low) & (at_a < low + COLUMNS)
        m[rows_a[own], at_a[own] - low] = 1
        o = np.zeros((len(b), COLUMNS), np.float32)
        own = (at_b >= low) & (at_b < low + COLUMNS)
        o[rows_b[own], at_b[own] - low] = 1
        out += m @ o.T
    return out.astype(np.int64)


def open_blocks(a: tuple, b: tuple, num: int, den: int, same: bool) -> list[tuple[int, int]]:
    """Links between two blocks (ids, sizes, tokens one after another, union): first the bound, then the members."""

    def sets(block: tuple, other: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, sizes, tokens, _ = block
        end = np.cumsum(sizes)
        if other is None:
            keep = np.ones(len(ids), bool)
        else:
            hit = np.isin(tokens, other).astype(np.int64)
            keep = np.add.reduceat(hit, end - sizes) * den >= num * sizes
        parts = np.split(tokens, end[:-1])
        return ids[keep], [p for p, k in zip(parts, keep, strict=True) if k]

    ids_a, sets_a = sets(a, None if same else b[3])
    if not len(ids_a):
        return []
    ids_b, sets_b = (ids_a, sets_a) if same else sets(b, a[3])
    if not len(ids_b):
        return []
    both = overlaps(sets_a, sets_b)
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (sets_a, sets_b))
    linked = both * den >= num * (size_a[:, None] + size_b[None, :] - both)
    return [(int(ids_a[i]), int(ids_b[j])) for i, j in np.argwhere(linked) if ids_a[i] != ids_b[j]]


def links(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of all rows, copies: key to the smallest doc_id, links a-b between such ids).

    The links hold at least one path between any two documents that are joined by links; no link between different
    components is missing, and none is there that isn't one.
    """
    common.prepare(docs.sparkSession)
    sig = common.table(signatures(docs, words, num, den, id_col, text_col), "jaccard-sets")
    full = sig.where("n > 0 and doc_id is not null")
    copies = common.table(full.groupBy("key").agg(F.min("doc_id").alias("rep")), "jaccard-copies")
    reps = full.join(copies, "key").where("doc_id = rep").dropDuplicates(["rep", "key"]).select("rep", "n", "central", "bands", "prefix")
    reps = common.table(reps, "jaccard-reps")

    # prefix tokens of more than one document; what shares too few links with nothing
    least = F.least(F.lit(SHARED).cast("long"), F.floor((F.col("n") * num + (den - 1)) / den))
    entries = reps.select("rep", F.explode("prefix").alias("token"))
    common_tokens = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    shared = common.table(entries.join(common_tokens, "token"), "jaccard-shared")
    sizes = reps.groupBy("rep").agg(F.sum("n").alias("n"), F.min(least).alias("least"))
    enough = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).join(sizes, "rep").where("c >= least")
    needed = common.table(enough.select("rep", "n", "least"), "jaccard-needed")
    # tables of documents grow with the input: they are joined by merging at every size, never broadcast
    ids = needed.select("rep").hint("merge")
    shared_all, shared = shared, shared.join(ids, "rep", "left_semi")
    common.release_shuffles(docs.sparkSession)

    # leaders by bands
    banded = reps.join(ids, "rep").select("rep", "central", F.posexplode("bands").alias("band", "value"))
    heads = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("top")).where("c > 1")
    heads = common.table(heads, "jaccard-heads")  # a plain exchange on either side of the join: a hot band is split
    led = banded.join(heads, ["band", "value"]).groupBy("rep").agg(F.max(F.struct("c", "top")).alias("best"))
    led = common.table(led.select("rep", (-F.col("best.top.minus")).alias("leader")).where("rep <> leader"), "jaccard-led")
    common.done_with(reps)

    # tokens of those that need them, from their texts
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), words)
            some = pa.array([i for i, s in enumerate(sets) if len(s)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rep").take(some), common.binary_list([s.tobytes() for s in sets if len(s)]), b.column("leader").take(some), b.column("leads").take(some)], names=["rep", "tokens", "leader", "leads"])

    roles = needed.select("rep").join(led.select("rep", "leader"), "rep", "left")
    roles = roles.join(led.select(F.col("leader").alias("rep"), F.lit(True).alias("leads")).distinct(), "rep", "left")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(roles.hint("merge"), "rep")
    tokens = common.table(texts.select("rep", "text", "leader", "leads").mapInArrow(common.frugal(tokenise), "rep long, tokens binary, leader long, leads boolean"), "jaccard-tokens")
    common.release_shuffles(docs.sparkSession)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(np.isin(x, y, assume_unique=True).sum())
                flags.append(both * den >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("leader"), pa.array(flags, pa.bool_())], names=["rep", "leader", "linked"])

    pairs = tokens.where("leader is not null").select("rep", "leader", F.col("tokens").alias("x"))
    pairs = pairs.join(tokens.where("leads").select(F.col("rep").alias("leader"), F.col("tokens").alias("y")).hint("merge"), "leader")
    stars = common.table(pairs.select("rep", "leader", "x", "y").mapInArrow(common.frugal(star), "rep long, leader long, linked boolean"), "jaccard-stars")
    common.done_with(led)
    stars = stars.groupBy("rep").agg(F.max(F.struct("linked", "leader")).alias("s")).select("rep", "s.leader", "s.linked")

    # groups in blocks
    members = needed.join(stars, "rep", "left").select("rep", "n", "least", F.coalesce("leader", "rep").alias("leader"), F.coalesce("linked", F.lit(True)).alias("linked"))
    shape = members.groupBy("leader", "linked").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    shape = common.table(shape, "jaccard-shape")  # as above, for a hot leader
    members = members.join(shape, ["leader", "linked"])
    block = F.concat_ws("/", "leader", "linked", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    members = common.table(members.select("rep", "leader", "linked", "least", block.alias("block")), "jaccard-members")

    # the matrix, and the blocks that meet in it
    matrix = shared.join(members, "rep").groupBy("token", "block", "leader", "linked").agg(F.min("least").alias("least"))
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    matrix = common.table(matrix.join(several, "token"), "jaccard-matrix")
    common.done_with(shared_all)
    other = matrix.select("token", *(F.col(c).alias(f"{c}_") for c in ("block", "leader", "linked", "least")))
    meet = matrix.join(other, "token").where("block < block_ and not (leader = leader_ and linked and linked_)")
    meet = meet.groupBy("block", "block_").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("least", "least_")).alias("least")).where("c >= least").select("block", "block_")
    alone = members.where("not linked").groupBy("block").count().where("count > 1").select("block", F.col("block").alias("block_"))
    meet = common.table(meet.unionByName(alone), "jaccard-meet")
    common.done_with(matrix)

    used = meet.select("block").unionByName(meet.select(F.col("block_").alias("block"))).distinct()
    inside = members.join(used, "block").select("rep", "block").hint("merge").join(tokens.select("rep", "tokens"), "rep")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[bytes]] = [[], [], [], []]
            for i in range(len(b)):  # row by row: blocks are large
                m = b.column("m")[i].as_py()
                sets = [np.frombuffer(x["tokens"], np.uint64) for x in m]
                joined = np.concatenate(sets)
                union = np.unique(joined) if len(sets) > 1 else joined[:0]  # one member's union is its own tokens
                for c, v in zip(cols, (np.array([x["rep"] for x in m], np.int64), np.array([len(s) for s in sets], np.int64), joined, union), strict=True):
                    c.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), *(common.binary_list(c) for c in cols)], names=["block", "ids", "sizes", "tokens", "groupset"])

    blocks = inside.groupBy("block").agg(F.collect_list(F.struct("rep", "tokens")).alias("m"))
    blocks = common.table(blocks.mapInArrow(common.frugal(store), "block string, ids binary, sizes binary, tokens binary, groupset binary"), "jaccard-blocks")

    common.done_with(tokens)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for i in range(len(b)):  # row by row: blocks are large
                same, x, y = (b.column(c)[i].as_py() for c in ("same", "x", "y"))
                read = lambda r: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["groupset"] or r["tokens"], np.uint64))
                found += open_blocks(read(x), read(y), num, den, same)
            yield _links(found)

    content = F.struct("ids", "sizes", "tokens", "groupset")
    left = blocks.select("block", content.alias("x"))
    right = blocks.select(F.col("block").alias("block_"), content.alias("y"))
    met = meet.join(left, "block").join(right, "block_").select((F.col("block") == F.col("block_")).alias("same"), "x", "y")
    found = met.mapInArrow(common.frugal(verify), "a long, b long").unionByName(stars.where("linked").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    found = common.table(found, "jaccard-links")
    common.done_with(blocks, meet, members, needed)
    return sig, copies, found


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    sig, copies, found = links(docs, words, num, den, id_col, text_col)
    comp = components(found)
    root = copies.join(comp, copies.rep == comp.node, "left").select("key", F.coalesce("component", "rep").alias("component"))
    own = sig.select("doc_id", "n", "key")
    out = own.join(root, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
