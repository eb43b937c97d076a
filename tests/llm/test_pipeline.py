"""Stages of the corpus pipeline: columns, decisions, and the contract queries against their SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from gleanery.llm import jaccard_join

TABLES = ("documents", "pages", "embeddings", "benchmark", "labels", "conversations")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.unionByName(docs.limit(1).selectExpr("null as doc_id", "null as text", "null as lang", "null as source", "null as n_chars", "null as extra"))
    before = None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / f"{i}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert 0 < out.count() <= docs.count()
        if name == "ngram_jaccard_join":
            left = {r.doc_id: r.text for r in out.collect()}
            assert jaccard_join.jaccard_components(out, 5, 80, 100).where("doc_id <> component_id").count() == 0
            assert len(left) == out.count()
        if name == "benchmark_decontamination":
            windows = set()
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(r.text)
                windows |= {tuple(w[j : j + 13]) for j in range(len(w) - 12)}
            kept = {r.doc_id for r in out.collect()}
            for r in docs.collect():
                w = words(r.text)
                hit = {x for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for x in range(j, j + 13)}
                assert (r.doc_id in kept) == (not (hit and 20 * len(hit) >= len(w)))
        before, docs = docs, out
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.collect()}


NAMES = "n_words keep p_toxic site_quality h_ p_ h p host path quality toxic row hit _hit _row n_hit n_items contaminated at id often cuts _cut_id low run edge digest spans share token rep key".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, name):
    """Columns of any name keep their values; nulls, repeated rows, a long text and a word of many KB pass or go as defined."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i * i % 9973}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (4, "y" * 300_000, "en", "s", 300_000), (5, "tie a b c d e f", "en", "s", 15), (5, "tie a b c d e f", "en", "s", 15), (5, "other text of one id", "de", "t", 20), (None, "no id", "en", None, 5), (None, "no id", "en", None, 5)]
    docs = spark.createDataFrame(rows, kinds).selectExpr("*", *(f"{i} as `{c}`" for i, c in enumerate(NAMES)), "'x' as `a b.c`")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert stage(spark, docs.where("false"), SF).count() == 0
    got = out.collect()
    if name == "packing":
        assert sorted({r.doc_id or -1 for r in got}) == [-1, 1, 2, 3, 4, 5] and sum(r.start == 0 for r in got) == len(rows)
        return
    assert out.columns == docs.columns
    for r in got:
        assert [r[c] for c in NAMES] == list(range(len(NAMES))) and r["a b.c"] == "x"
    texts = sorted((repr(r.doc_id), r.text or "") for r in got)
    if name == "ngram_jaccard_join":
        assert texts == sorted({(repr(i), t or "") for i, t, *_ in rows if i is not None} | {("None", "no id")}) + [("None", "no id")]
    elif name != "quality_classifier":
        assert texts == sorted((repr(i), t or "") for i, t, *_ in rows)
    else:
        assert set(texts) <= {(repr(i), t or "") for i, t, *_ in rows} and ("1", "") in texts


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if re.match(r"op\d", n)))
def test_contract_queries(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(repr(tuple(r)) for r in cur.fetchall())
    out = __spark_entry__.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(cols)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in out.collect()) == want
