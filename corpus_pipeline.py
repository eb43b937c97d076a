"""Corpus pipeline: quality classifier, near-duplicate removal, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, but for the last, which returns pieces.
Null and empty documents pass the filters unless a rule speaks against them; tables a stage reads beside its documents
(labels, benchmark) come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common, decontaminate, jaccard_join, packing, quality, substring_dedup


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, _read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8 or more).

    Rows that repeat an id and its text are copies of one document, and one of them stays; a null id is nobody's copy.
    """
    found = jaccard_join.jaccard_components(docs, words=5, num=80, den=100)
    gone = common.table(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "pipeline-copies")
    often = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # mostly empty, and then texts needn't move for it
    often = common.table(often.select("id").join(gone, "id", "left_anti"), "pipeline-repeated")
    rows = common.packed(docs)
    known, own = rows.where("row.doc_id is not null"), F.col("row.doc_id") == F.col("id")
    once = known.join(gone.unionByName(often), own, "left_anti")
    repeated = known.join(often, own, "left_semi").withColumn("text", F.sha2("row.text", 256))
    first = Window.partitionBy("row.doc_id", "text").orderBy("row.lang", "row.source")
    repeated = repeated.withColumn("at", F.row_number().over(first)).where("at = 1").select("row")
    return once.unionByName(repeated).unionByName(rows.where("row.doc_id is null")).select("row.*")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; one with nothing left goes."""
    out = substring_dedup.remove_repeats(docs)
    had_words = F.col("n_chars").isNull() | (F.col("n_chars") > 0)
    out = out.where(~(F.coalesce(F.col("text") == "", F.lit(False)) & had_words))
    return _counted(out)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items, without the items' passages of 13 words or more."""
    return _counted(decontaminate.clean(docs, _read(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_texts(docs, cache=200_000)  # workers run other stages too


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express a fitted classifier or a public tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
