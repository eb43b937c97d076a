"""Gated extractive answers: score gate, lexical-support gate, cited quotes or a refusal.

Kept as they are in the system this follows: coverage counts keywords in the original-case text, and a sentence split at
``". "`` may repeat a line of which it is a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import retrieve, words
from gleanery.session import prepare, root

#: The refusal, whose text is compared, and the gates.
REFUSAL = "I don't know based on the provided documents."
THRESHOLD, SUPPORT_FLOOR = 0.40, 0.6
#: Question words without meaning of their own.
STOPWORDS = (
    "the", "and", "for", "with", "how", "what", "which", "when", "does",
    "did", "are", "can", "you", "your", "per", "not", "from", "that", "this",
)


def keywords(question: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens_simple(question), lambda w: F.length(w) > 2))


def salient(question: Column, common: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_except(F.array_except(keywords(question), stop), common)


def support(question: Column, texts: Column, common: Column) -> Column:
    """Share of the question's salient terms found in the joined texts; 1 without any."""
    share = lambda terms, low: F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.greatest(F.size(terms), F.lit(1))
    low = F.lower(F.array_join(texts, " "))
    return T.let(salient(question, common), lambda terms: F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(T.let(low, lambda x: share(terms, x))))


def coverage(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def quote(words: Column, text: Column) -> Column:
    """The two lines or sentences of a text that cover most keywords, in order of coverage, then of place."""
    trimmed = lambda parts: F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    lines = trimmed(F.split(text, r"\r\n|\n|\r"))
    pieces = trimmed(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. "))
    found = F.transform(F.array_distinct(F.concat(lines, pieces)), lambda s, i: F.struct((-coverage(words, s)).alias("c"), i.alias("i"), s.alias("s")))
    return F.array_join(F.transform(F.slice(F.array_sort(found), 1, 2), lambda x: x["s"]), " ")


def hit_lists(questions: DataFrame, hits: DataFrame, chunks: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """query_id, question, hits: array of (rank, chunk_id, final, text, dense where hits have it, and the columns ``more`` of
    hits or chunks); empty without hits."""
    extra = [*(["dense"] if "dense" in hits.columns else []), *(c for c in more if c != "dense")]
    own = [c for c in extra if c in hits.columns]
    full = retrieve.beside(hits.select("query_id", "rank", "chunk_id", "final", *own), chunks.select("chunk_id", "text", *(c for c in extra if c not in own)))
    lists = full.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "final", "text", *extra))).alias("hits"))
    empty = F.array().cast(lists.schema["hits"].dataType)
    return questions.select("query_id", "question").join(lists, "query_id", "left").withColumn("hits", F.coalesce("hits", empty))


def answers(listed: DataFrame, common: Column, threshold: float | Column = THRESHOLD, floor: float | Column = SUPPORT_FLOOR) -> DataFrame:
    """Adds top_score, support, gate (score, support or open) and answer to hit lists; the gates' limits may be columns."""
    first = F.get(F.col("hits"), F.lit(0))
    out = listed.withColumn("top_score", first["final"])
    out = out.withColumn("support", support(F.col("question"), F.transform(F.slice("hits", 1, 3), lambda h: h["text"]), common))
    # a gate whose limit is null is closed
    passed = F.coalesce(F.col("top_score") >= F.lit(threshold), F.lit(False))
    out = out.withColumn("gate", F.when(~passed, "score").when(F.col("support") < floor, "support").otherwise("open"))
    out = out.withColumn("_words", keywords(F.col("question")))
    words = F.col("_words")
    judged = F.transform(F.slice("hits", 1, 5), lambda h: F.struct((-coverage(words, h["text"])).alias("c"), (-h["final"]).alias("f"), h["rank"].alias("r"), h["chunk_id"].alias("id"), h["text"].alias("t")))
    out = out.withColumn("best", F.get(F.array_sort(judged), F.lit(0)))
    cited = F.concat(quote(words, F.col("best.t")), F.lit(" [chunk:"), F.col("best.id").cast("string"), F.lit("]"))
    return out.withColumn("answer", F.when(F.col("gate") == "open", cited).otherwise(REFUSAL)).drop("best", "_words")


def common_terms(chunks: DataFrame, share: float = 0.4) -> DataFrame:
    """Terms of more than ``share`` of all chunks."""
    total = chunks.count()
    prepare(chunks.sparkSession, root())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.pieces(batches):
            row, code, names = words.spaced(b.column("text"))
            (term, _), _ = words.counted(code, row)  # a text counts once
            (term,), n = words.counted(term)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), pa.array(n.astype(np.int64))], names=["term", "n"])

    terms = chunks.select(F.lower("text").alias("text")).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.where(F.col("n") > share * total)


def context(listed: DataFrame) -> DataFrame:
    """query_id and the hits as numbered blocks."""
    block = lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] "), h["chunk_id"].cast("string"), F.lit("\n"), h["text"])
    return listed.select("query_id", F.array_join(F.transform("hits", block), "\n\n").alias("context"))


def first_sentences(listed: DataFrame, n: int = 3) -> DataFrame:
    text = F.get(F.col("hits"), F.lit(0))["text"]
    said = F.concat(F.array_join(F.slice(T.sentences(text), 1, n), " "), F.lit(" [Source 1]"))
    return listed.select("query_id", F.when(F.size("hits") == 0, REFUSAL).otherwise(F.trim(said)).alias("answer"))


def best_by(hits: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
