"""Retrieval over tables: BM25, exact vector search under filters, lexical reranking, rank fusion.

Every operator takes a DataFrame of questions.  Hits are rows (query_id, rank, chunk_id, score columns); texts are joined
back by id after the cut, so they don't travel through the ranking.  Scores are ranked at nine decimals, ties go to the
smaller id.

BM25 reads an index of blocks of postings (postings.py), vector search one of cells (vectors.py); both skip what can't be among
the best, and both take filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanery.functions import text as T
from gleanery.operators import postings, words
from gleanery.operators.grams import GramIndex
from gleanery.operators.vectors import VectorIndex
from gleanery.session import prepare, root, table

#: The constants of BM25, rank fusion, its depth, and of the lexical boost.
K1, B, RRF_K, DEPTH, BOOST = 1.5, 0.75, 60, 25, 0.15
#: Queries that one pass of the exact search may hold in memory on each executor; more take more passes.
QUERY_BLOCK = 4096


def ranked(scored: DataFrame, *order: Column, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(scored: DataFrame, score: str, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return ranked(scored, F.round(score, 9).desc(), F.col("chunk_id"), keys=keys).where(F.col("rank") <= k)


#: Ids that are sent to where texts lie; where there are more, texts move to them.
FEW = 500_000


def beside(few: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The join of ``few`` with ``rows`` (texts) by ``key``: few small rows go to the texts, which stay where they are."""
    few = table(few, "beside")
    return rows.join(F.broadcast(few) if few.count() <= FEW else few.hint("shuffle_hash"), key)


def by_block(queries: DataFrame, run: Callable[[DataFrame], DataFrame], times: int = 1) -> DataFrame:
    """``run`` on all of ``queries`` (query_id and more), in blocks of about QUERY_BLOCK rows, or so many times it, that it may
    broadcast."""
    blocks = -(-queries.count() // (QUERY_BLOCK * times)) or 1
    if blocks == 1:
        return run(queries)
    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (run(queries.where(own == b)) for b in range(blocks)))


# ---------------------------------------------------------------- sparse

def term_freq(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf.  Each text is counted where it lies; only rows that share an id meet, if there are any."""
    spark = chunks.sparkSession
    prepare(spark, root())
    kind = chunks.schema["chunk_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.pieces(batches):
            row, code, names = words.symbols(b.column("text"))
            (at, term), n = words.counted(row, code)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(pa.array(at)), names.take(pa.array(term)), pa.array(n.astype(np.int64))], names=["chunk_id", "term", "tf"])

    counts = lambda rows: rows.select("chunk_id", F.lower("text").alias("text")).mapInArrow(run, f"chunk_id {kind.simpleString()}, term string, tf bigint")
    often = table(chunks.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    if often.isEmpty():
        return counts(chunks)
    same = F.col("chunk_id").eqNullSafe(F.col("id"))
    summed = counts(chunks.join(often, same, "left_semi")).groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"))
    return counts(chunks.join(often, same, "left_anti")).unionByName(summed)


def doc_freq(chunks: DataFrame) -> DataFrame:
    return term_freq(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def terms_of(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.explode(F.array_distinct(T.tokens_symbol(F.col("question")))).alias("term"))


#: Chunks of a segment.
SEGMENT = 4096


@dataclass(frozen=True)
class Bm25Index:
    """blocks: term, seg, n, top, ids, parts, sorted by term; terms: term, df; n and avg_len over all chunks.

    ``parts`` is what postings add to a score without the term's weight, ``top`` the most of them; a large block may lie in
    several rows.
    """

    blocks: DataFrame
    terms: DataFrame
    n: int
    avg_len: float
    segments: int

    @staticmethod
    def build(chunks: DataFrame, segments: int | None = None) -> Bm25Index:
        """Tokenises every chunk once.  Tables go to the shared folder, for as long as the application runs."""
        spark = chunks.sparkSession
        prepare(spark, root())
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = chunks.count()
        segments = segments or -(-n // SEGMENT) or 1
        seg = F.pmod(F.xxhash64("chunk_id"), F.lit(segments))
        laid = chunks.select(seg.alias("seg"), "chunk_id", F.lower("text").alias("text")).repartition(parts, "seg").sortWithinPartitions("seg", "chunk_id")
        counted = table(postings.of_segments(laid, chunks.schema["chunk_id"].dataType), "postings")
        total = counted.agg(F.sum("words")).first()[0] or 0
        avg_len = total / n if n else 0.0
        mean = avg_len or 1.0
        # a common word's blocks are many rows of one term, and may lie in many tasks
        dealt = counted.repartitionByRange(parts, "term", "seg").sortWithinPartitions("term", "seg")
        blocks = table(postings.weighed(dealt, chunks.schema["chunk_id"].dataType, lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))), "blocks")
        terms = table(blocks.groupBy("term").agg(F.sum("n").alias("df")), "terms")
        return Bm25Index(blocks, terms, n, avg_len, segments)

    def wanted(self, questions: DataFrame) -> DataFrame:
        """query_id, term, w: the terms of a block of questions that the index has, with their weights."""
        # a block's distinct terms are at most its words: small enough to broadcast, as the block is
        met = self.terms.join(F.broadcast(terms_of(questions)), "term")
        return met.select("query_id", "term", idf(F.col("df"), F.lit(self.n)).alias("w"))

    def of_terms(self, wanted: list) -> DataFrame:
        """The blocks of some terms.  Files are sorted by term, so a reader passes over what lies outside their bounds."""
        names = sorted({r.term for r in wanted})
        rows = self.blocks.where(F.col("term").between(names[0], names[-1]))
        if len(names) <= 10:  # so many are compared with each file's bounds by name
            return rows.where(F.col("term").isin(names))
        listed = self.blocks.sparkSession.createDataFrame([(t,) for t in names], "term string")
        return rows.join(F.broadcast(listed), "term", "left_semi")  # the words of a block of questions

    def _search(self, block: DataFrame, k: int | None, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(query_id, chunk_id, score of every segment's best; blocks of the terms; those of them that are opened)."""
        spark = self.blocks.sparkSession
        prepare(spark, root())
        kinds = (block.schema["query_id"].dataType, self.blocks.schema["ids"].dataType.elementType)
        wanted = self.wanted(block).collect()
        if not wanted:
            return spark.createDataFrame([], f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"), None, None
        asked, blocks = postings.Questions(wanted), self.of_terms(wanted)
        free = None if allowed is None else allowed.select(F.pmod(F.xxhash64("chunk_id"), F.lit(self.segments)).alias("seg"), "chunk_id").groupBy("seg").agg(F.collect_list("chunk_id").alias("ids"))
        if k is None or self.segments <= k:  # no more than is looked at first anyway
            return postings.scored(blocks, spark.sparkContext.broadcast(asked), k, *kinds, free), blocks, blocks
        share = spark.sparkContext.broadcast(asked)
        first = F.broadcast(table(postings.promising(blocks, share, k), "probes"))  # k rows for each question at most
        near = lambda rows: rows.join(first, "seg", "left_semi")
        seen = postings.scored(near(blocks), share, k, *kinds, None if free is None else near(free))
        at = F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1)
        asked.reached({r.query_id: r["at"][0] for r in seen.groupBy("query_id").agg(at.alias("at")).collect() if r["at"]})  # a row for each question
        share = spark.sparkContext.broadcast(asked)
        opened = blocks.join(postings.needed(blocks, share).distinct(), ["term", "seg"], "left_semi")
        return postings.scored(opened, share, k, *kinds, free), blocks, opened

    def scores(self, questions: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score of every chunk with a term of the question."""
        return by_block(questions.select("query_id", "question"), lambda block: self._search(block, None, allowed)[0])

    def topk(self, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank of the k best; ``allowed`` (chunk_id) holds what a filter leaves."""
        return top(by_block(questions.select("query_id", "question"), lambda block: self._search(block, k, allowed)[0]), "score", k)

    def opened(self, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> tuple[int, int]:
        """(blocks that a search for some questions opens, blocks of their terms)."""
        _, blocks, some = self._search(questions.select("query_id", "question"), k, allowed)
        return (0, 0) if blocks is None else (some.count(), blocks.count())

    def holders(self, facts: DataFrame, chunks: DataFrame, any_case: bool = False) -> DataFrame:
        """query_id, chunk_id of chunks whose text contains all ``facts`` (array) of a query.

        A word that stands inside a fact, between blanks, stands in the index for every text that contains the fact.
        Chunks with the rarest such word are the candidates; where a fact has no inner word, they come from an index of grams.
        """
        say = F.lower if any_case else (lambda c: c)
        inner = F.flatten(F.transform("facts", lambda f: T.tokens_symbol(F.array_join(F.slice(F.split(f, r"\s+"), 2, F.greatest(F.size(F.split(f, r"\s+")) - 2, F.lit(0))), " "))))
        keyed = facts.select("query_id", F.transform("facts", say).alias("facts"), F.array_distinct(inner).alias("inner"))
        text = chunks.select("chunk_id", say(F.col("text")).alias("text"))
        def verified(near: DataFrame, block: DataFrame) -> DataFrame:
            """The pairs whose text has all facts; ids are written first, texts are read for them only."""
            each = block.select("query_id", F.size("facts").alias("of"), F.explode("facts").alias("fact"))
            met = beside(near.distinct(), text).join(F.broadcast(each), "query_id").where(F.contains(F.col("text"), F.col("fact")))
            return met.groupBy("query_id", "chunk_id", "of").agg(F.count(F.lit(1)).alias("n")).where("n = of").select("query_id", "chunk_id")

        def run(block: DataFrame) -> DataFrame:
            spread = block.select("query_id", F.size("inner").alias("of"), F.explode("inner").alias("term"))
            known = self.terms.join(F.broadcast(spread), "term").groupBy("query_id", "of").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "term")).alias("rare"))
            wanted = known.where("found = of").select("query_id", F.col("rare.term").alias("term"))
            held = self.blocks.select("term", "ids").join(F.broadcast(wanted), "term").select("query_id", F.explode("ids").alias("chunk_id"))
            return verified(held, block)

        out = by_block(keyed.where(F.size("inner") > 0), run)
        short = table(keyed.where((F.size("inner") == 0) & F.forall("facts", lambda f: f.isNotNull())).drop("inner"), "short-facts")
        if short.isEmpty():
            return out
        # of several facts the longest one is looked up; an empty one is in every text
        longest = F.array_max(F.transform("facts", lambda f: F.struct(F.octet_length(f).alias("n"), f.alias("s"))))["s"]
        short = short.withColumn("string", F.coalesce(longest, F.lit("")))
        grams = GramIndex.build(text)

        def found(block: DataFrame) -> DataFrame:
            near = verified(grams.candidates(block.where("string <> ''")), block)
            every = text.where("text is not null").select("chunk_id").join(F.broadcast(block.where("string = ''").select("query_id")))
            return near.unionByName(every.select("query_id", "chunk_id"))

        return out.unionByName(by_block(short, found))


def bm25_topk(chunks: DataFrame | Bm25Index, questions: DataFrame, k: int) -> DataFrame:
    return (chunks if isinstance(chunks, Bm25Index) else Bm25Index.build(chunks)).topk(questions, k)


# ---------------------------------------------------------------- dense

class Embedder(Protocol):
    """What gives texts their vectors; any model that maps a table of texts to a table of vectors will do."""

    def encode(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """``texts`` with a column embedding (array of doubles of length one)."""
        ...


class HashedWords:
    """An embedder without a model: counts of words in slots by their MD5, to length one."""

    def __init__(self, size: int = 256) -> None:
        self.size = size

    def encode(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        slots = F.transform(T.tokens_simple(F.coalesce(F.col(text_col), F.lit(""))), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % self.size).cast("int"))
        size = self.size

        @F.arrow_udf("array<double>")
        def counted(column: pa.Array) -> pa.Array:
            off = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            row = np.repeat(np.arange(len(column)), np.diff(off))
            counts = np.bincount(row * size + flat, minlength=len(column) * size).reshape(-1, size).astype(float)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * size), pa.array(unit.ravel()))

        return texts.withColumn("embedding", counted(slots))


def embedded_topk(chunks: DataFrame, questions: DataFrame, embedder: Embedder, k: int, where: dict | None = None) -> DataFrame:
    """query_id, chunk_id, dense, rank: the ``k`` chunks (chunk_id, text and what the filter names) nearest to each question
    (query_id, question), with the vectors that an embedder gives to both.  Null and empty texts have no direction: 0."""
    keys = tuple(where or ())
    made = VectorIndex.build(table(embedder.encode(chunks).select("chunk_id", "embedding", *keys), "embedded"), keys)
    return dense_topk(made, embedder.encode(questions, "question").select("query_id", F.col("embedding").alias("query")), k, where=where)


def indexed(vectors: DataFrame | VectorIndex, keys: tuple[str, ...]) -> VectorIndex:
    return vectors if isinstance(vectors, VectorIndex) else VectorIndex.build(vectors, keys)


def dense_scores(vectors: DataFrame | VectorIndex, queries: DataFrame, same: tuple[str, ...] = (), where: dict | None = None) -> DataFrame:
    """query_id, chunk_id, dense of all vectors for a stated set of queries, in blocks of QUERY_BLOCK.

    ``vectors``: an index, or chunk_id, embedding and key columns; ``queries``: query_id, query and the columns of ``same``,
    which vectors must share; ``where``: key columns and the values they must have.  A query's own row is left out; a query
    without a vector has no scores.
    """
    index = indexed(vectors, (*same, *(where or {})))
    return by_block(queries.where("query is not null"), lambda block: index.pairs(block, where, same))


def dense_topk(vectors: DataFrame | VectorIndex, queries: DataFrame, k: int, same: tuple[str, ...] = (), where: dict | None = None) -> DataFrame:
    index = indexed(vectors, (*same, *(where or {})))
    return top(by_block(queries.where("query is not null"), lambda block: index.topk(block, k, where, same)[0]), "dense", k)


def rerank(candidates: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds final = dense + BOOST * lexical overlap of question and text; without a dense score the overlap counts alone."""
    met = beside(candidates.join(questions.select("query_id", "question"), "query_id"), chunks.select("chunk_id", "text"))
    return met.withColumn("final", F.coalesce("dense", F.lit(0.0)) + BOOST * T.lexical_overlap(F.col("question"), F.col("text"))).drop("question", "text")


def dense_rerank_topk(vectors: DataFrame | VectorIndex, chunks: DataFrame, questions: DataFrame, k: int, where: dict | None = None, lexical: bool = True) -> DataFrame:
    """The 3k best by vectors alone, by boosted score, cut to k; the boost can't bring in what lies deeper.

    Without ``lexical`` the order is that of the vectors.  ``vectors`` are those of ``chunks``.
    """
    pool = dense_topk(vectors, questions.select("query_id", "query"), 3 * k, where=where).withColumnRenamed("rank", "dense_rank")
    scored = rerank(pool, chunks, questions) if lexical else pool.withColumn("final", F.col("dense"))
    return ranked(scored, F.round("final", 9).desc(), F.col("dense_rank")).where(F.col("rank") <= k)


def overlaps(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, chunk_id, overlap of every question and chunk that share a word: the part of the question's distinct words
    that the chunk has.  Chunks are taken apart once, whatever the number of questions."""
    words = lambda c: F.array_distinct(T.tokens_simple(F.col(c)))
    has = chunks.select("chunk_id", F.explode(words("text")).alias("term"))

    def run(block: DataFrame) -> DataFrame:
        wanted = block.select("query_id", words("question").alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("term"))
        return has.join(F.broadcast(wanted), "term").groupBy("query_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("c"))

    return by_block(questions.select("query_id", "question"), run).select("query_id", "chunk_id", (F.col("c") / F.col("n")).alias("overlap"))


#: Pairs of texts and questions that are counted at once.
PAIRS = 1 << 22


def best_overlap(rows: DataFrame, questions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """query_id, keys, score of the row (keys, text) that has most of a question's distinct words, and the part of them that it
    has; ties go to the smaller keys, and a question without a word in common has no row.

    Rows are counted where they lie, in tables of rows by questions, and each table passes on a question's best row alone.
    """
    spark = rows.sparkSession
    prepare(spark, root())
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}

    def run(block: DataFrame) -> DataFrame:
        asked = [r for r in block.select("query_id", F.array_distinct(T.tokens_simple(F.col("question"))).alias("w")).collect() if r.w]  # a block
        of: dict[str, list[int]] = {}
        for i, r in enumerate(asked):
            for w in r.w:
                of.setdefault(w, []).append(i)
        share = spark.sparkContext.broadcast((pa.array(list(of), pa.string()), np.cumsum([0, *map(len, of.values())]), np.array([i for own in of.values() for i in own], np.int64)))
        n, kind = len(asked), to_arrow_type(block.schema["query_id"].dataType)
        ids = pa.array([r.query_id for r in asked], kind)
        sizes = np.array([len(r.w) for r in asked], np.int64)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, off, who = share.value
            step = max(1, PAIRS // max(n, 1))
            for b in (p.slice(i, step) for p in words.pieces(batches) for i in range(0, p.num_rows, step)):
                row, code, names = words.simple(b.column("text"))
                known = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False)[code] if len(names) else code
                (at, term), _ = words.counted(row[known >= 0], known[known >= 0].astype(np.int64))
                many = off[term + 1] - off[term]
                q = who[np.repeat(off[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                held = np.bincount(np.repeat(at, many) * n + q, minlength=b.num_rows * n).reshape(-1, n)
                order = pc.sort_indices(pa.table([b.column(k) for k in keys], names=list(keys)), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start").to_numpy()
                best = order[held[order].argmax(axis=0)]
                most = held[best, np.arange(n)]
                some = np.flatnonzero(most)
                own = b.take(pa.array(best[some]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), *(own.column(k) for k in keys), pa.array(most[some]), pa.array(sizes[some])], names=["query_id", *keys, "c", "n"])

        found = rows.select(*keys, F.lower("text").alias("text")).mapInArrow(meet, f"query_id {block.schema['query_id'].dataType.simpleString()}, {', '.join(f'`{k}` {v}' for k, v in kinds.items())}, c bigint, n bigint")
        return ranked(found, F.desc("c"), *(F.col(k) for k in keys)).where("rank = 1") if asked else found.limit(0)

    return by_block(questions.select("query_id", "question"), run).select("query_id", *keys, (F.col("c") / F.col("n")).alias("score"))


# ---------------------------------------------------------------- fusion

def rrf(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, first_rank, second_rank (null where missing), rrf and rank of two rankings."""
    a = first.select("query_id", "chunk_id", F.col("rank").alias("first_rank"))
    b = second.select("query_id", "chunk_id", F.col("rank").alias("second_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", part("first_rank") + part("second_rank"))
    return ranked(both, F.round("rrf", 12).desc(), F.coalesce("first_rank", F.lit(10**9)), F.col("chunk_id"))


def hybrid_topk(corpus: Corpus, questions: DataFrame, k: int, depth: int = DEPTH, where: dict | None = None) -> DataFrame:
    """Fused order of the boosted vector ranking and BM25 over all chunks that the filter leaves; scores are those of the
    vector ranking.

    Rows that BM25 alone brings are scored by one join for all of them; where a question or a chunk has no vector, dense is
    null and the lexical part of the score stands alone.
    """
    dense = dense_rerank_topk(corpus.searched(where), corpus.chunks, questions, depth, where)
    fused = rrf(dense, corpus.index.topk(questions, depth, corpus.allowed(where))).where(F.col("rank") <= k)
    fused = fused.select("query_id", "chunk_id", "rank", "rrf", F.col("first_rank").alias("dense_rank"), F.col("second_rank").alias("bm25_rank"))
    scored = fused.join(questions.select("query_id", "query"), "query_id").join(corpus.vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    return rerank(scored.withColumn("dense", T.dot(F.col("query"), F.col("embedding"))).drop("query", "embedding"), corpus.chunks, questions)


# ---------------------------------------------------------------- registry

@dataclass(frozen=True)
class Corpus:
    """What retrievers search: chunks (chunk_id, text and metadata), vectors (chunk_id, embedding), the index of words, which
    searches by vectors alone do without, and, where one is at hand, that of vectors, whose keys are metadata that filters may name."""

    chunks: DataFrame
    vectors: DataFrame
    index: Bm25Index | None
    cells: VectorIndex | None = None

    def searched(self, where: dict | None) -> VectorIndex:
        """An index of vectors that knows the filter's columns."""
        keys = tuple(where or ())
        if self.cells is not None and set(keys) <= set(self.cells.keys):
            return self.cells
        rows = self.vectors.select("chunk_id", "embedding")
        return VectorIndex.build(rows.join(self.chunks.select("chunk_id", *keys), "chunk_id") if keys else rows, keys)

    def allowed(self, where: dict | None) -> DataFrame | None:
        """Ids of the chunks that have the filter's values; null without a filter."""
        if not where:
            return None
        rows = self.chunks
        for c, v in where.items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
        return rows.select("chunk_id")


#: Name to retriever: (corpus, questions with query_id, question, query; k; filter) to hits with rank, chunk_id and final.
RETRIEVERS: dict[str, Callable[[Corpus, DataFrame, int, dict | None], DataFrame]] = {
    "dense": lambda c, q, k, where: dense_rerank_topk(c.searched(where), c.chunks, q, k, where, lexical=False),
    "baseline": lambda c, q, k, where: dense_rerank_topk(c.searched(where), c.chunks, q, k, where),
    "bm25": lambda c, q, k, where: c.index.topk(q, k, c.allowed(where)).withColumn("final", F.col("score")),
    "hybrid": lambda c, q, k, where: hybrid_topk(c, q, k, where=where),
}


def retriever(name: str) -> Callable[..., DataFrame]:
    """The retriever of a name: takes a corpus, questions, k and, where wanted, a map of metadata that hits must have."""
    if name not in RETRIEVERS:
        raise ValueError(f"no retriever {name!r}; there are {', '.join(sorted(RETRIEVERS))}")
    return lambda corpus, questions, k, where=None: RETRIEVERS[name](corpus, questions, k, where)
