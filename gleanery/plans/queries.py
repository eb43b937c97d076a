"""Queries over the test tables, each with the SQL that gives the same rows.

Roles of the tables: ``documents`` are chunks, ``benchmark`` gives the questions (their first nine words, so that finding
the passage isn't trivial; gold are the documents with the whole passage), ``embeddings`` are vectors of chunks and
questions, ``labels`` two raters, ``events`` traces with latencies, ``conversations`` answers and pages.  What no table has
(markdown, citations, code, a judge's words) is put into its rows by a rule that query and SQL share.
"""

from __future__ import annotations

import dataclasses
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import session
from gleanery.functions import text as T
from gleanery.operators import answer as A
from gleanery.operators import chunking, cluster, evaluate, retrieve, runs, trace
from gleanery.operators.vectors import VectorIndex
from gleanery.sources import files
from gleanery.streaming import traces as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EMPTY = "cast(array() as array<string>)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = "WITH RECURSIVE " + sql if not sql.lstrip().upper().startswith("SELECT") else sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """A table of few files would be worked on by as few tasks; where there are more files than cores nothing moves."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


def chunks(spark, d):
    return _spread(_t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"))


def questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 9), " ").alias("question"), "text")


@cache
def _kept(app: str, folder: str, stamp: tuple) -> dict:
    """What is built once over a table of documents, as an index is: for an application, a folder and the state of its files."""
    return {}


def _corpus(spark, d) -> dict:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stamp = []
    for f in sorted(f for name in ("documents", "embeddings") for f in _t(spark, d, name).inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        stamp.append((f, status.getLen(), status.getModificationTime()))
    return _kept(spark.sparkContext.applicationId, d, tuple(stamp))


def index(spark, d) -> retrieve.Bm25Index:
    """The index over all documents; the first query that asks builds it."""
    kept = _corpus(spark, d)
    if "index" not in kept:
        kept["index"] = retrieve.Bm25Index.build(chunks(spark, d))
    return kept["index"]


def common_array(spark, d):
    kept = _corpus(spark, d)
    if "common" not in kept:
        # each is in over two fifths of all chunks, so there are at most 2.5 times as many as a mean chunk has distinct words
        kept["common"] = sorted(r.term for r in A.common_terms(chunks(spark, d)).select("term").collect())
    return F.array(*map(F.lit, kept["common"])).cast("array<string>") if kept["common"] else F.expr(EMPTY)


def gold(spark, d):
    """(query, chunk) pairs of passage and document that holds it; the smallest document is the tagged one."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array("text").alias("facts"))
    pairs = session.table(index(spark, d).holders(items, chunks(spark, d)), "gold")
    first = pairs.groupBy("query_id").agg(F.min("chunk_id").alias("first"))
    return pairs.join(first, "query_id").select("query_id", "chunk_id", (F.col("chunk_id") == F.col("first")).alias("tagged"))


def vectors(spark, d):
    return _spread(_t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label"))


def vector_queries(spark, d):
    return vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"), "label")


def cells(spark, d) -> VectorIndex:
    """The index over all vectors; the first query that asks builds it."""
    kept = _corpus(spark, d)
    if "cells" not in kept:
        kept["cells"] = VectorIndex.build(vectors(spark, d), ("label",))
    return kept["cells"]


def corpus(spark, d, words: bool = True) -> tuple[retrieve.Corpus, DataFrame]:
    """All documents with their vectors and indexes, and all questions; a question's vector is the one of its number, if any.

    Filters may name a document's language.  Without ``words`` the index of words, which vectors alone don't need, isn't built.
    """
    v, c, kept = vectors(spark, d), chunks(spark, d), _corpus(spark, d)
    v = v.join(c.select("chunk_id", "lang"), "chunk_id")
    if "documents" not in kept:
        kept["documents"] = VectorIndex.build(v, ("lang",))
    q = questions(spark, d).select("query_id", "question").join(v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")), "query_id", "left")
    return retrieve.Corpus(c, v, index(spark, d) if words else None, kept["documents"]), q


# ---------------------------------------------------------------- SQL building blocks

def simple(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def symbol(x: str) -> str:
    parts = r"list_filter(string_split_regex(w, '[._\-]'), lambda p: p <> '')"
    return rf"flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9_]+(?:[.\-][a-z0-9_]+)*'), lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([w], {parts}) ELSE [w] END))"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def overlap(q: str, t: str) -> str:
    return f"CASE WHEN len({simple(q)}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({simple(q)}), list_distinct({simple(t)})))::DOUBLE / len(list_distinct({simple(q)})) END"


Q = "q AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 9), ' ') AS question FROM benchmark)"
C = "c AS (SELECT doc_id AS chunk_id, text, lang FROM documents)"
GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS chunk_id, doc_id = min(doc_id) OVER (PARTITION BY item_id) AS tagged FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
BM25 = f"""tok AS MATERIALIZED (SELECT chunk_id, {symbol('text')} AS ts FROM c),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
wanted AS MATERIALIZED (SELECT DISTINCT query_id, unnest({symbol('question')}) AS term FROM q),
post AS MATERIALIZED (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS MATERIALIZED (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM wanted JOIN df USING (term) JOIN post USING (term), st GROUP BY ALL),
sparse AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm)"""
V = "v AS (SELECT vec_id AS chunk_id, embedding AS e, label FROM embeddings)"
DOT = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i]::DOUBLE * b.e[i]::DOUBLE))"
DENSE = f"""{V}, dn AS MATERIALIZED (SELECT a.chunk_id AS query_id, b.chunk_id, a.label AS ql, b.label AS bl, {DOT} AS dense FROM v a JOIN v b ON a.chunk_id % 100 = 0 AND a.chunk_id <> b.chunk_id)"""
BOTH = f"""c AS (SELECT doc_id AS chunk_id, text FROM documents),
v AS (SELECT vec_id AS chunk_id, embedding AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
{Q},
dn AS MATERIALIZED (SELECT a.chunk_id AS query_id, b.chunk_id, {DOT} AS dense FROM v a JOIN q ON q.query_id = a.chunk_id JOIN v b ON a.chunk_id <> b.chunk_id),
dr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, chunk_id) AS dense_rank FROM dn)"""


def reranked(depth: int) -> str:
    return f"""rr AS MATERIALIZED (SELECT query_id, chunk_id, dense, final, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, dense_rank) AS rank
  FROM (SELECT dr.*, dense + 0.15 * {overlap('question', 'text')} AS final FROM dr JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE dense_rank <= {3 * depth}))"""


HYBRID = f"""{BOTH}, {reranked(25)}, {BM25},
fu AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf, a.rank AS dense_rank, b.rank AS bm25_rank
  FROM (SELECT * FROM rr WHERE rank <= 25) a FULL JOIN (SELECT * FROM sparse WHERE rank <= 25) b USING (query_id, chunk_id)),
fr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, coalesce(dense_rank, 1000000000), chunk_id) AS rank FROM fu),
hy AS MATERIALIZED (SELECT query_id, chunk_id, rank, rrf, dense_rank, bm25_rank, d AS dense, coalesce(d, 0) + 0.15 * {overlap('question', 'text')} AS final
  FROM (SELECT fr.*, {DOT} AS d FROM fr LEFT JOIN v a ON a.chunk_id = query_id LEFT JOIN v b ON b.chunk_id = fr.chunk_id WHERE fr.rank <= 5) JOIN q USING (query_id) JOIN c USING (chunk_id))"""
STOP = "[" + ", ".join(f"'{w}'" for w in A.STOPWORDS) + "]"
COMMON = r"""cm AS MATERIALIZED (SELECT list(term) AS common FROM (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) AS term FROM documents) GROUP BY term)
  WHERE n > 0.4 * (SELECT count(*) FROM documents))"""
#: What the answer stage does to lists ``hl(query_id, question, hits)`` of (rank, chunk_id, final, text).
ANSWER = rf"""kw AS MATERIALIZED (SELECT query_id, question, hits, list_distinct(list_filter({simple('question')}, lambda w: length(w) > 2)) AS words FROM hl),
su AS MATERIALIZED (SELECT query_id, hits, words, list_filter(words, lambda w: NOT list_contains({STOP}, w) AND NOT list_contains(coalesce(common, []), w)) AS terms,
  lower(array_to_string(list_transform(hits[1:3], lambda h: h.text), ' ')) AS low FROM kw, cm),
sp AS MATERIALIZED (SELECT query_id, hits, words, hits[1].final AS top_score, CASE WHEN len(terms) = 0 THEN 1 ELSE len(list_filter(terms, lambda w: contains(low, w)))::DOUBLE / len(terms) END AS support FROM su),
ga AS MATERIALIZED (SELECT *, CASE WHEN top_score IS NULL OR top_score < THRESHOLD THEN 'score' WHEN support < FLOOR THEN 'support' ELSE 'open' END AS gate FROM sp),
be AS (SELECT query_id, words, h, row_number() OVER (PARTITION BY query_id ORDER BY len(list_filter(words, lambda w: contains(h.text, w))) DESC, h.final DESC, h.rank) AS k FROM (SELECT query_id, words, unnest(hits[1:5]) AS h FROM ga)),
cand AS (SELECT query_id, words, h.chunk_id AS id, list_concat(list_filter(list_transform(string_split_regex(h.text, '\r\n|\n|\r'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''),
  list_filter(list_transform(string_split(replace(h.text, chr(10), ' '), '. '), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) AS l FROM be WHERE k = 1),
pos AS (SELECT query_id, words, id, s, min(i) AS i FROM (SELECT query_id, words, id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM cand) GROUP BY ALL),
pick AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY len(list_filter(words, lambda w: contains(s, w))) DESC, i) AS k FROM pos),
quo AS (SELECT query_id, string_agg(s, ' ' ORDER BY k) || ' [chunk:' || any_value(id)::VARCHAR || ']' AS cited FROM pick WHERE k <= 2 GROUP BY query_id),
an AS MATERIALIZED (SELECT ga.query_id, top_score, support, gate, CASE WHEN gate = 'open' THEN cited ELSE 'I don''t know based on the provided documents.' END AS answer FROM ga LEFT JOIN quo USING (query_id))"""
HYBRID_LISTS = "hl AS MATERIALIZED (SELECT q.query_id, q.question, coalesce(list({'rank': rank, 'chunk_id': chunk_id, 'final': final, 'text': text} ORDER BY rank) FILTER (WHERE rank IS NOT NULL), []) AS hits FROM q LEFT JOIN hy USING (query_id) LEFT JOIN c USING (chunk_id) GROUP BY ALL)"
#: Thresholds at which the invented prose is answered, refused by score and refused by support.
THRESHOLD, FLOOR = 0.30, 0.5


def _answer_sql() -> str:
    return ANSWER.replace("THRESHOLD", str(THRESHOLD)).replace("FLOOR", str(FLOOR))


def hybrid_lists(spark, d):
    found, q = corpus(spark, d)
    return A.hit_lists(q, retrieve.hybrid_topk(found, q, 5).select("query_id", "rank", "chunk_id", "final"), found.chunks)


def bm25_lists(spark, d, k=3):
    q = questions(spark, d)
    return A.hit_lists(q, index(spark, d).topk(q, k).withColumn("final", F.col("score")), chunks(spark, d))


# ---------------------------------------------------------------- text

@query(f"SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {simple('text')} AS t FROM documents)")
def tokens_simple(spark, d):
    t = T.tokens_simple(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


SYMBOLS = "values (-1, 'snake_case_id and x-header-name'), (-2, 'v1.2 beta, v1.2 again; _private __a__'), (-3, 'A.B-c d..e -f'), (-4, '')"


@query(f"SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {symbol('text')} AS t FROM (SELECT doc_id, text FROM documents UNION ALL ({SYMBOLS})))")
def tokens_symbol(spark, d):
    t = T.tokens_symbol(F.col("text"))
    rows = _t(spark, d, "documents").select("doc_id", "text").unionByName(spark.sql(f"select cast(a as bigint) as doc_id, b as text from {SYMBOLS} as t(a, b)"))
    return rows.select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("SELECT doc_id, length(s) AS length, md5(s) AS slug FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)")
def slug(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("s")).select("doc_id", F.length("s").cast("long").alias("length"), F.md5("s").alias("slug"))


@query(f"SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '~')) AS sentences FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "~")).alias("sentences"))


@query(f"""{Q}, w AS (SELECT query_id, len(l) AS n, unnest(l) AS term FROM (SELECT query_id, list_distinct({simple('question')}) AS l FROM q)), t AS (SELECT doc_id AS chunk_id, unnest(list_distinct({simple('text')})) AS term FROM documents)
SELECT query_id, chunk_id, round(count(*) / n, 9) AS overlap FROM w JOIN t USING (term) GROUP BY query_id, chunk_id, n""")
def lexical_overlap(spark, d):
    """Every question with every chunk that shares a word; the overlap of all other pairs is 0."""
    return retrieve.overlaps(chunks(spark, d), questions(spark, d)).select("query_id", "chunk_id", F.round("overlap", 9).alias("overlap"))


@query("SELECT doc_id, left(sha256(text), 12) AS print FROM documents")
def fingerprint(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("print"))


@query("""SELECT n, left(sha256(n || '/' || x || '/' || y), 12) AS digest FROM (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS x, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS y
  FROM (SELECT sha256(doc_id || chr(10) || sha256(text)) AS h FROM documents))""")
def corpus_fingerprint(spark, d):
    return trace.corpus_fingerprint(chunks(spark, d))


@query("SELECT DISTINCT lang AS version FROM documents")
def distinct_versions(spark, d):
    return chunks(spark, d).select(F.col("lang").alias("version")).distinct()


@query("SELECT page_id, length(t) AS n_chars, md5(t) AS body FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM pages)".replace("\\\\", "\\"))
def strip_tags(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return _t(spark, d, "pages").select("page_id", F.trim(t).alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("body"))


# ---------------------------------------------------------------- index statistics

@query(f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({symbol('text')}) AS term FROM documents) GROUP BY ALL")
def term_freq(spark, d):
    return retrieve.term_freq(chunks(spark, d))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({symbol('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, d):
    return retrieve.doc_freq(chunks(spark, d))


@query(f"SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n FROM (SELECT DISTINCT doc_id, unnest({symbol('text')}) AS term FROM documents) GROUP BY term)")
def bm25_idf(spark, d):
    n = chunks(spark, d).count()
    return retrieve.doc_freq(chunks(spark, d)).select("term", F.round(retrieve.idf(F.col("df"), F.lit(n)), 6).alias("idf"))


@query(f"{COMMON} SELECT unnest(common) AS term FROM cm")
def common_terms(spark, d):
    return A.common_terms(chunks(spark, d)).select("term")


# ---------------------------------------------------------------- retrieval

@query(f"{Q}, {C}, {BM25} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 25")
def bm25_topk(spark, d):
    return index(spark, d).topk(questions(spark, d), 25).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"{V} SELECT a.chunk_id AS query_id, b.chunk_id, round({DOT}, 6) AS cosine FROM v a JOIN v b ON a.chunk_id % 100 = 0 AND a.chunk_id <> b.chunk_id AND a.label = b.label")
def cosine_pairs(spark, d):
    scored = retrieve.dense_scores(cells(spark, d), vector_queries(spark, d), same=("label",))
    return scored.select("query_id", "chunk_id", F.round("dense", 6).alias("cosine"))


def _ranked_dense(where: str) -> str:
    return f"{DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, chunk_id) AS rank FROM dn WHERE {where}) SELECT query_id, chunk_id, rank::INTEGER AS rank, round(dense, 6) AS score FROM r WHERE rank <= 10"


@query(_ranked_dense("true"))
def dense_topk(spark, d):
    return retrieve.dense_topk(cells(spark, d), vector_queries(spark, d), 10).select("query_id", "chunk_id", "rank", F.round("dense", 6).alias("score"))


@query(_ranked_dense("bl = 3"))
def dense_topk_filtered(spark, d):
    return retrieve.dense_topk(cells(spark, d), vector_queries(spark, d), 10, where={"label": 3}).select("query_id", "chunk_id", "rank", F.round("dense", 6).alias("score"))


@query(_ranked_dense("bl = ql"))
def search_cluster(spark, d):
    return retrieve.dense_topk(cells(spark, d), vector_queries(spark, d), 10, same=("label",)).select("query_id", "chunk_id", "rank", F.round("dense", 6).alias("score"))


@query(f"{BOTH}, {reranked(5)} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(dense, 6) AS dense, round(final, 6) AS final FROM rr WHERE rank <= 5")
def dense_rerank_topk(spark, d):
    found, q = corpus(spark, d, words=False)
    out = retrieve.dense_rerank_topk(found.cells, found.chunks, q, 5)
    return out.select("query_id", "chunk_id", "rank", F.round("dense", 6).alias("dense"), F.round("final", 6).alias("final"))


#: Two rankings of a label's vectors: the first and the last thirty by the hash of their id.
RANKING_SQL = f"""rk AS (SELECT label AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || vec_id), vec_id) AS r1, row_number() OVER (PARTITION BY label ORDER BY md5('2:' || vec_id), vec_id) AS r2 FROM embeddings),
a AS (SELECT query_id, chunk_id, r1 FROM rk WHERE r1 <= 30), b AS (SELECT query_id, chunk_id, r2 FROM rk WHERE r2 <= 30),
f AS (SELECT query_id, chunk_id, r1 AS first_rank, r2 AS second_rank, coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) AS s FROM a FULL JOIN b USING (query_id, chunk_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, coalesce(first_rank, 1000000000), chunk_id) AS rank FROM f)"""


def _rankings(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"))
    return (retrieve.ranked(rows, F.md5(F.concat(F.lit(f"{i}:"), F.col("chunk_id").cast("string"))), F.col("chunk_id")).where("rank <= 30") for i in (1, 2))


@query(f"{RANKING_SQL} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(s, 9) AS score FROM o")
def rrf_fuse(spark, d):
    return retrieve.rrf(*_rankings(spark, d)).select("query_id", "chunk_id", "rank", F.round("rrf", 9).alias("score"))


@query(f"{HYBRID} SELECT query_id, chunk_id, dense_rank::INTEGER AS dense_rank, bm25_rank::INTEGER AS bm25_rank, round(rrf, 6) AS rrf FROM fr")
def rrf_explain(spark, d):
    found, q = corpus(spark, d)
    out = retrieve.rrf(retrieve.dense_rerank_topk(found.cells, found.chunks, q, 25), found.index.topk(q, 25))
    return out.select("query_id", "chunk_id", F.col("first_rank").alias("dense_rank"), F.col("second_rank").alias("bm25_rank"), F.round("rrf", 6).alias("rrf"))


@query(f"{HYBRID} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(dense, 6) AS dense, round(final, 6) AS final FROM hy")
def hybrid_topk(spark, d):
    found, q = corpus(spark, d)
    out = retrieve.hybrid_topk(found, q, 5)
    return out.select("query_id", "chunk_id", "rank", F.round("dense", 6).alias("dense"), F.round("final", 6).alias("final"))


# ---------------------------------------------------------------- answers

@query(f"{HYBRID}, {HYBRID_LISTS}, {COMMON}, {_answer_sql()} SELECT query_id, gate <> 'score' AS evidence FROM an")
def evidence_gate(spark, d):
    out = A.answers(hybrid_lists(spark, d), common_array(spark, d), THRESHOLD, FLOOR)
    return out.select("query_id", (F.col("gate") != "score").alias("evidence"))


@query(f"{HYBRID}, {HYBRID_LISTS}, {COMMON}, {_answer_sql()} SELECT query_id, round(support, 6) AS support FROM an")
def lexical_support(spark, d):
    return A.answers(hybrid_lists(spark, d), common_array(spark, d)).select("query_id", F.round("support", 6).alias("support"))


@query(f"{HYBRID}, {HYBRID_LISTS}, {COMMON}, {ANSWER.replace('THRESHOLD', '-9').replace('FLOOR', '0')} SELECT query_id, md5(answer) AS answer FROM an")
def extractive_cited(spark, d):
    return A.answers(hybrid_lists(spark, d), common_array(spark, d), -9.0, 0.0).select("query_id", F.md5("answer").alias("answer"))


@query(f"{HYBRID}, {HYBRID_LISTS}, {COMMON}, {_answer_sql()} SELECT query_id, gate, md5(answer) AS answer, round(top_score, 6) AS top_score FROM an")
def answer_gate(spark, d):
    out = A.answers(hybrid_lists(spark, d), common_array(spark, d), THRESHOLD, FLOOR)
    return out.select("query_id", "gate", F.md5("answer").alias("answer"), F.round("top_score", 6).alias("top_score"))


BM25_LISTS = "bl AS MATERIALIZED (SELECT q.query_id, q.question, coalesce(list({'rank': rank, 'chunk_id': chunk_id, 'text': text} ORDER BY rank) FILTER (WHERE rank IS NOT NULL), []) AS hits FROM q LEFT JOIN (SELECT * FROM sparse WHERE rank <= 3) USING (query_id) LEFT JOIN c USING (chunk_id) GROUP BY ALL)"


@query(f"{Q}, {C}, {BM25}, {BM25_LISTS} SELECT query_id, md5(CASE WHEN len(hits) = 0 THEN 'I don''t know based on the provided documents.' ELSE trim(array_to_string({sentences('hits[1].text')}[1:3], ' ') || ' [Source 1]', ' ') END) AS answer FROM bl")
def extractive_first3(spark, d):
    return A.first_sentences(bm25_lists(spark, d)).select("query_id", F.md5("answer").alias("answer"))


@query(f"{Q}, {C}, {BM25}, {BM25_LISTS} SELECT query_id, md5(array_to_string(list_transform(hits, lambda h: '[' || h.rank || '] ' || h.chunk_id || chr(10) || h.text), chr(10) || chr(10))) AS context FROM bl")
def render_context(spark, d):
    return A.context(bm25_lists(spark, d)).select("query_id", F.md5("context").alias("context"))


# ---------------------------------------------------------------- chunks

def _window_sql(size: int, overlap_: int) -> str:
    return rf"""s AS MATERIALIZED (SELECT doc_id, ss, list_prepend(0, list_transform(range(1, len(ss) + 1), lambda k: list_sum(w[1:k])::BIGINT)) AS c
  FROM (SELECT doc_id, ss, list_transform(ss, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda p: p <> ''))) AS w FROM (SELECT doc_id, {sentences('text')} AS ss FROM documents)) WHERE len(ss) > 0),
r AS (
  SELECT doc_id, 0 AS chunk_no, 1::BIGINT AS a, 1::BIGINT AS i, greatest(1, len(list_filter(c, lambda x: x <= {size} + c[1])) - 1)::BIGINT AS e FROM s
  UNION ALL
  SELECT doc_id, chunk_no + 1, a2, e + 1, greatest(e + 1, len(list_filter(c, lambda x: x <= {size} + c[a2])) - 1)::BIGINT
  FROM (SELECT r.*, s.c, len(list_filter(s.c[1:r.e + 1], lambda x: x < s.c[r.e + 1] - {overlap_})) + 1 AS a2 FROM r JOIN s USING (doc_id) WHERE r.e < len(s.ss))
)
SELECT doc_id, chunk_no::INTEGER AS chunk_no, a::INTEGER AS first, e::INTEGER AS last, (c[e + 1] - c[a])::INTEGER AS words,
  coalesce(list_last(list_filter(list_transform(ss[1:e + 1], lambda x: trim(regexp_extract(x, '^(#{{1,6}})\s+(.*)$', 2))), lambda x: x <> '')), doc_id::VARCHAR) AS section, md5(array_to_string(ss[a:e], ' ')) AS content FROM r JOIN s USING (doc_id)"""


@query(_window_sql(120, 25))
def chunk_sentence_window(spark, d):
    return chunking.chunk_sentences(_t(spark, d, "documents"), 120, 25).select("doc_id", "chunk_no", "first", "last", "words", "section", F.md5("text").alias("content"))


@query(_window_sql(300, 60))
def chunk_large_window(spark, d):
    return chunking.chunk_sentences(_t(spark, d, "documents"), 300, 60).select("doc_id", "chunk_no", "first", "last", "words", "section", F.md5("text").alias("content"))


def _compared_sql() -> str:
    made = []
    for name, (size, over) in (("small_windows", chunking.SMALL), ("large_windows", chunking.LARGE)):
        windows = _window_sql(size, over).replace("s AS MATERIALIZED", f"s_{name} AS MATERIALIZED").replace("\nr AS (", f"\nr_{name} AS (").replace("FROM s\n", f"FROM s_{name}\n")
        windows = windows.replace("FROM r JOIN s USING", f"FROM r_{name} r JOIN s_{name} s USING")
        ctes, last = windows.rsplit("\nSELECT", 1)
        made.append((ctes, f"w_{name} AS (SELECT '{name}' AS strategy, doc_id, chunk_no, unnest(list_distinct({simple('content')})) AS term FROM (SELECT{last.replace('md5(', '(')}))"))
    return f"""{Q}, wanted AS (SELECT query_id, len(l) AS n, unnest(l) AS term FROM (SELECT query_id, list_distinct({simple('question')}) AS l FROM q)),
{made[0][0]}, {made[1][0]}, {made[0][1]}, {made[1][1]},
sc AS (SELECT strategy, query_id, doc_id, chunk_no, round(count(*) / n, 6) AS score FROM (SELECT * FROM w_small_windows UNION ALL SELECT * FROM w_large_windows) JOIN wanted USING (term) GROUP BY strategy, query_id, doc_id, chunk_no, n),
be AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, doc_id, chunk_no) AS k FROM sc)
SELECT strategy, query_id, doc_id, chunk_no, score FROM be WHERE k = 1"""


@query(_compared_sql())
def chunking_comparison(spark, d):
    """Best chunk of each question under each strategy, by shared distinct words over the question's words."""
    out = None
    for name, strategy in chunking.STRATEGIES.items():
        made = strategy(_t(spark, d, "documents").select("doc_id", "text"))
        best = retrieve.best_overlap(made, questions(spark, d), ("doc_id", "chunk_no")).select(F.lit(name).alias("strategy"), "query_id", "doc_id", "chunk_no", F.round("score", 6).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


MD_PAGES = {
    "good": "# Title\n\npage_id: v3-good\nsdk_version: v3\npage_type: guide\n\n## Start\nFirst line.\nSecond line.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c | d |\n\nAfter the tables.\n\n## Code\n```python\nx = 1\n\ny = 2\n```\nDone.",
    "gap": "# Title\npage_id: v3-gap\npage_type: guide\n\nText only.",
    "inner": "page_id: v2-inner\nsdk_version: v2\npage_type: reference\n## One\n```sh\n# comment\nrun it\n```\n| t |\nplain after table",
    "open": "page_id: v3-open\nsdk_version: v3\npage_type: guide\nIntro.\n```\nnever closed\n",
    "long": "page_id: v3-long\nsdk_version: v3\npage_type: guide\n## Words\n" + " ".join(f"w{i}" for i in range(100)) + "\n\n" + " ".join(f"x{i}" for i in range(90)) + "\n\n" + " ".join(f"y{i}" for i in range(200)) + "\n\nend",
}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: Pages are all turns of conversations: a turn's sentences, a line each, stand behind one of five beginnings.
MD_VALUES = "mp(name, head, no) AS (VALUES " + ", ".join(f"('{k}', {_sql_text(v)}, {i})" for i, (k, v) in enumerate(MD_PAGES.items())) + """),
md AS (SELECT conv_id || '/' || turn || '-' || role AS file, head || chr(10) || replace(text, '. ', '.' || chr(10)) AS raw FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) JOIN mp ON no = (conv_id + turn) % 5)"""


def md_pages(spark, d):
    heads = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(MD_PAGES.values())], "head string, no int"))
    turns = _t(spark, d, "conversations").join(heads, F.col("no") == (F.col("conv_id") + F.col("turn")) % 5)
    lines = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    return turns.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), F.col("role")).alias("file"), F.concat(F.col("head"), F.lit("\n"), lines).alias("raw"))


META_SQL = MD_VALUES + r""", ln AS (SELECT file, raw, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM md),
k AS (SELECT *, trim(line) = '' OR starts_with(trim(line), '#') AS skip, regexp_extract(trim(line), '^(page_id|sdk_version|page_type):\s*(.+)$', 1) AS key, regexp_extract(trim(line), '^(page_id|sdk_version|page_type):\s*(.+)$', 2) AS val FROM ln),
stop AS (SELECT file, coalesce(min(i) FILTER (WHERE NOT skip AND key = ''), 1000000) AS stop FROM k GROUP BY file),
m AS (SELECT k.*, stop FROM k JOIN stop USING (file)),
p AS (SELECT file, max(val) FILTER (WHERE key = 'page_id' AND i < stop) AS page_id, max(val) FILTER (WHERE key = 'sdk_version' AND i < stop) AS sdk_version, max(val) FILTER (WHERE key = 'page_type' AND i < stop) AS page_type,
  coalesce(max(i) FILTER (WHERE key <> '' AND NOT skip AND i < stop), 0) AS last FROM m GROUP BY file),
b AS (SELECT p.*, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i > last), ''), ' ' || chr(10)) || chr(10) AS body FROM p JOIN m USING (file) GROUP BY ALL)"""


@query(f"{META_SQL} SELECT file, page_id, sdk_version, page_type, array_to_string(list_filter([CASE WHEN page_id IS NULL THEN 'page_id' END, CASE WHEN page_type IS NULL THEN 'page_type' END, CASE WHEN sdk_version IS NULL THEN 'sdk_version' END], lambda x: x IS NOT NULL), ',') AS missing, md5(body) AS body FROM b")
def parse_page_meta(spark, d):
    return chunking.parse_pages(md_pages(spark, d)).select("file", *chunking.KEYS, F.array_join("missing", ",").alias("missing"), F.md5("body").alias("body"))


@query(f"""{META_SQL}, l AS (SELECT file, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM b),
f AS (SELECT file, i, line, trim(line) AS s FROM l),
r AS (
  SELECT file, 0::BIGINT AS i, 'paragraph' AS kind, 0 AS held, 0 AS blk, -1 AS own, '' AS own_kind FROM b
  UNION ALL
  SELECT file, i, CASE WHEN fence AND kind = 'fence' THEN 'paragraph' ELSE now END, CASE WHEN fence AND kind = 'fence' THEN 0 WHEN blank THEN CASE WHEN kind = 'paragraph' THEN 0 ELSE held END ELSE 1 END,
    CASE WHEN fence AND kind = 'fence' THEN blk + 1 ELSE blk + shut END, CASE WHEN blank THEN -1 ELSE blk + shut END, now
  FROM (SELECT *, CASE WHEN held > 0 AND ((fence AND kind <> 'fence') OR (blank AND kind = 'paragraph') OR (NOT fence AND NOT blank AND now <> kind)) THEN 1 ELSE 0 END AS shut
    FROM (SELECT f.file, f.i, r.kind, r.held, r.blk, starts_with(s, '```') AS fence, s = '' AS blank,
      CASE WHEN starts_with(s, '```') THEN 'fence' WHEN s = '' THEN r.kind WHEN starts_with(s, '|') AND r.kind = 'paragraph' THEN 'table' WHEN NOT starts_with(s, '|') AND r.kind = 'table' THEN 'paragraph' ELSE r.kind END AS now
      FROM r JOIN f ON f.file = r.file AND f.i = r.i + 1))
)
SELECT r.file AS page_id, own::INTEGER AS block_no, any_value(own_kind) AS kind, string_agg(line, chr(10) ORDER BY r.i) AS content FROM r JOIN f ON f.file = r.file AND f.i = r.i WHERE own >= 0 GROUP BY r.file, own""")
def md_blocks(spark, d):
    return chunking.md_blocks(chunking.parse_pages(md_pages(spark, d)), "file")


#: Lines to sections at headings, sections to blocks, and blocks to chunks: a paragraph joins the one before if both fit.
STRUCTURED_SQL = META_SQL + r""", l0 AS (SELECT file, page_id, sdk_version, page_type, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM b WHERE page_id IS NOT NULL AND sdk_version IS NOT NULL AND page_type IS NOT NULL),
hd AS (SELECT *, regexp_matches(line, '^#{1,6}\s+.*$') AS h, regexp_extract(line, '^(#{1,6})\s+(.*)$', 2) AS name FROM l0),
se AS (SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY file ORDER BY i) AS sec FROM hd),
nm AS (SELECT file, sec, coalesce(max(trim(name)) FILTER (WHERE h), any_value(page_id)) AS section FROM se GROUP BY file, sec),
f AS (SELECT file, sec, row_number() OVER (PARTITION BY file, sec ORDER BY i) AS i, line, trim(line) AS s FROM se WHERE NOT h),
r AS (
  SELECT DISTINCT file, sec, 0::BIGINT AS i, 'paragraph' AS kind, 0 AS held, 0 AS blk, -1 AS own, '' AS own_kind FROM f
  UNION ALL
  SELECT file, sec, i, CASE WHEN fence AND kind = 'fence' THEN 'paragraph' ELSE now END, CASE WHEN fence AND kind = 'fence' THEN 0 WHEN blank THEN CASE WHEN kind = 'paragraph' THEN 0 ELSE held END ELSE 1 END,
    CASE WHEN fence AND kind = 'fence' THEN blk + 1 ELSE blk + shut END, CASE WHEN blank THEN -1 ELSE blk + shut END, now
  FROM (SELECT *, CASE WHEN held > 0 AND ((fence AND kind <> 'fence') OR (blank AND kind = 'paragraph') OR (NOT fence AND NOT blank AND now <> kind)) THEN 1 ELSE 0 END AS shut
    FROM (SELECT f.file, f.sec, f.i, r.kind, r.held, r.blk, starts_with(s, '```') AS fence, s = '' AS blank,
      CASE WHEN starts_with(s, '```') THEN 'fence' WHEN s = '' THEN r.kind WHEN starts_with(s, '|') AND r.kind = 'paragraph' THEN 'table' WHEN NOT starts_with(s, '|') AND r.kind = 'table' THEN 'paragraph' ELSE r.kind END AS now
      FROM r JOIN f ON f.file = r.file AND f.sec = r.sec AND f.i = r.i + 1))
),
bl AS MATERIALIZED (SELECT r.file, r.sec, row_number() OVER (PARTITION BY r.file, r.sec ORDER BY own) AS k, any_value(own_kind) AS kind, string_agg(line, chr(10) ORDER BY r.i) AS content FROM r JOIN f ON f.file = r.file AND f.sec = r.sec AND f.i = r.i WHERE own >= 0 GROUP BY r.file, r.sec, own),
wc AS MATERIALIZED (SELECT *, len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS n FROM bl),
pk AS (
  SELECT file, sec, k, kind, 1 AS chunk, n AS words FROM wc WHERE k = 1
  UNION ALL
  SELECT wc.file, wc.sec, wc.k, wc.kind, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN words + n ELSE n END
  FROM (SELECT pk.chunk, pk.words, w.*, w.kind = 'paragraph' AND pk.kind = 'paragraph' AND pk.words + w.n <= 180 AS fits FROM pk JOIN wc w ON w.file = pk.file AND w.sec = pk.sec AND w.k = pk.k + 1) wc
),
ch AS (SELECT file, sec, chunk, any_value(wc.kind) AS kind, trim(string_agg(content, chr(10) ORDER BY k), ' ' || chr(10)) AS text FROM pk JOIN wc USING (file, sec, k) GROUP BY file, sec, chunk),
nu AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY sec, chunk) - 1 AS n FROM ch JOIN nm USING (file, sec)),
sl AS (SELECT *, trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nu)"""


@query(f"""{STRUCTURED_SQL} SELECT page_id, page_id || '::' || slug || '::' || n || CASE kind WHEN 'table' THEN '-table' WHEN 'fence' THEN '-code' ELSE '' END AS chunk_uid, section, '#' || slug AS anchor, text, file, sdk_version, page_type
  FROM sl JOIN (SELECT file, page_id, sdk_version, page_type FROM b) USING (file)""")
def chunk_structured(spark, d):
    return chunking.chunk_structured(chunking.parse_pages(md_pages(spark, d)).where("size(missing) = 0"))


PLAIN = {"a.md": "# Start here\nOne two three. Four five six seven.\n#Loose name\nEight nine ten eleven.", "b.md": "No heading. " + "word " * 30 + "end.\n#\nlast one here."}


@query("v(source, section, chunk_id, words) AS (VALUES ('a.md', 'Start here', 0, 6), ('a.md', 'Loose name', 1, 6), ('a.md', 'Loose name', 2, 6), ('b.md', 'B', 0, 2), ('b.md', 'B', 1, 33), ('b.md', 'B', 2, 4)) SELECT source, upper(source[1:1]) AS title, section, chunk_id, words FROM v")
def chunk_documents(spark, d):
    """Windows of plain documents in which any ``#`` starts a section; the rows are worked out by hand."""
    docs = spark.createDataFrame([(k, k[0].upper(), v) for k, v in PLAIN.items()], "source string, title string, text string")
    return chunking.chunk_documents(docs, 8, 2).select("source", "title", "section", "chunk_id", T.word_count(F.col("text")).alias("words"))


@query(f"{MD_VALUES} SELECT count(*) FILTER (WHERE (len(string_split(raw, '```')) - 1) % 2 = 1) AS broken FROM md")
def broken_fences(spark, d):
    return md_pages(spark, d).agg(F.count_if((F.size(F.split("raw", "```")) - 1) % 2 == 1).alias("broken"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}.md', md5({_sql_text(v)}))" for k, v in MD_PAGES.items()) + ") AS m(file, raw)")
def scan_documents(spark, d):
    """The markdown pages, written to a folder and scanned again."""
    folder = f"{_folder(spark)}/pages-{uuid.uuid4().hex}"
    _write_files(spark, folder, {f"{k}.md": v for k, v in MD_PAGES.items()})
    return files.markdown(spark, folder).select("file", F.md5("raw").alias("raw"))


@query("SELECT trim(replace(text, chr(10), ' ')) AS line FROM benchmark WHERE item_id % 3 = 1 AND trim(text) <> ''")
def scan_comment_filtered(spark, d):
    """Every third item of the benchmark is a comment, every third a line with blanks around it, the others are blank lines."""
    path, at, text = session.new_path(spark, "lines"), F.col("item_id") % 3, F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    line = F.when(at == 0, F.concat(F.lit("# "), text)).when(at == 1, F.concat(F.lit("  "), text, F.lit("  "))).otherwise("")
    _t(spark, d, "benchmark").select(line.alias("value")).write.text(path)
    return files.commented_lines(spark, path)


def _folder(spark) -> str:
    from gleanery.session import shared_folder

    return shared_folder(spark)


def _write_files(spark, folder: str, content: dict[str, str]) -> None:
    """Small files through Hadoop's file system, which reaches any shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in content.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(text.encode()))
        out.close()


@query(r"""w AS (SELECT page_id, string_split(lower(replace(regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1), '_', ' ')), ' ') AS w FROM pages)
SELECT page_id, array_to_string(list_transform(w, lambda x: upper(x[1:1]) || x[2:]), ' ') AS title FROM w""")
def page_titles(spark, d):
    """Titles from the last part of addresses, as from file names."""
    return _t(spark, d, "pages").select("page_id", T.page_title(F.col("url")).alias("title"))


@query("SELECT item_id, md5(text) AS text FROM benchmark")
def json_documents(spark, d):
    """Items as files of one JSON object each, over several lines where the text is."""
    path = session.new_path(spark, "objects")
    one = F.regexp_replace(F.to_json(F.struct("item_id", "text")), '^\\{"item_id":', '{\n "item_id":\n ')
    _t(spark, d, "benchmark").select(one.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.json_document(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("text"))


@query("SELECT item_id || ',' || (item_id + 1) AS ids, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || 'Judge {answer}.' || chr(10)) AS prompt FROM benchmark")
def prompt_templates(spark, d):
    """A template for each item, with the ids of two examples in a line of its own and a note in another."""
    path = session.new_path(spark, "templates")
    at = F.col("item_id")
    lines = F.concat_ws("\n", F.lit("#! version: 1"), "text", F.concat(F.lit("#! fewshot_ids: "), at.cast("string"), F.lit(" , "), (at + 1).cast("string"), F.lit(",")), F.lit("Judge {answer}."))
    _t(spark, d, "benchmark").select(lines.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.prompt_template(spark, path).select(F.array_join("fewshot_ids", ",").alias("ids"), F.md5("prompt").alias("prompt"))


@query("SELECT doc_id AS chunk_id, source, md5(text) AS text FROM documents WHERE lang = 'en' AND doc_id IN (SELECT item_id FROM benchmark)")
def collection_get(spark, d):
    """The documents of one collection that have an item's number, by id."""
    path = session.new_path(spark, "collections")
    files.write_collection(chunks(spark, d).withColumn("collection", F.col("lang")), path)
    ids = [r.item_id for r in _t(spark, d, "benchmark").select("item_id").collect()]  # the ids asked for
    return files.get(spark, path, "en", ids, "chunk_id").select("chunk_id", "source", F.md5("text").alias("text"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def traces_fresh(spark, d):
    """A run that starts anew leaves nothing of the run before."""
    path, rows = session.new_path(spark, "log"), _t(spark, d, "events").select("event_id", "event_type")
    files.append_traces(rows, path)
    files.append_traces(rows.where("event_id % 4 = 0"), path, fresh=True)
    files.append_traces(rows.where("event_id % 4 = 2"), path)
    return files.json_lines(spark, path, "event_id long, event_type string")


def _strategies_sql() -> str:
    own = "documents AS (SELECT file AS doc_id, body AS text FROM b WHERE page_id IS NOT NULL AND sdk_version IS NOT NULL AND page_type IS NOT NULL)"
    made = [f"SELECT '{name}' AS strategy, doc_id AS page_id, count(*) AS chunks FROM (WITH RECURSIVE {own}, {_window_sql(*sizes)}) GROUP BY doc_id" for name, sizes in (("naive", chunking.SMALL), ("large_windows", chunking.LARGE))]
    return f"{STRUCTURED_SQL} SELECT 'structured' AS strategy, file AS page_id, count(*) AS chunks FROM sl GROUP BY file UNION ALL " + " UNION ALL ".join(made)


@query(_strategies_sql())
def chunk_strategies(spark, d):
    """How many chunks each strategy makes of a page."""
    pages = chunking.parse_pages(md_pages(spark, d)).where("size(missing) = 0").withColumn("page_id", F.col("file"))
    out = None
    for name in ("structured", "naive", "large_windows"):
        one = chunking.make_chunks(pages, name).groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(name).alias("strategy"), "page_id", "chunks")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{Q}, hw AS (SELECT id, ('0x' || left(md5(w), 8))::BIGINT % 256 AS slot, count(*) AS n FROM (SELECT doc_id AS id, unnest({simple('text')}) AS w FROM documents UNION ALL SELECT -1 - query_id, unnest({simple('question')}) FROM q) GROUP BY ALL),
ln AS (SELECT id, sqrt(sum(n * n)) AS len FROM hw GROUP BY id),
hp AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.n * b.n) AS s FROM hw a JOIN hw b ON a.slot = b.slot AND a.id < 0 AND b.id >= 0 GROUP BY ALL),
hs AS (SELECT -1 - q.query_id AS query_id, doc_id AS chunk_id, coalesce(s / (x.len * y.len), 0) AS dense FROM q CROSS JOIN documents LEFT JOIN hp ON hp.query_id = -1 - q.query_id AND hp.chunk_id = doc_id LEFT JOIN ln x ON x.id = -1 - q.query_id LEFT JOIN ln y ON y.id = doc_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, chunk_id) AS rank FROM hs)
SELECT query_id, chunk_id, rank::INTEGER AS rank, round(dense, 6) AS dense FROM hr WHERE rank <= 10""")
def embedded_topk(spark, d):
    """Questions against all documents, by vectors of an embedder."""
    asked = questions(spark, d).select((-1 - F.col("query_id")).alias("query_id"), "question")
    out = retrieve.embedded_topk(chunks(spark, d), asked, retrieve.HashedWords(), 10)
    return out.select("query_id", "chunk_id", "rank", F.round("dense", 6).alias("dense"))


# ---------------------------------------------------------------- metrics

RANKS = f"""{Q}, {C}, {BM25}, {GOLD}, hits AS MATERIALIZED (SELECT * FROM sparse WHERE rank <= 25),
ranks AS MATERIALIZED (SELECT q.query_id, coalesce(min(h.rank) FILTER (WHERE g.tagged AND h.rank <= 3), 0)::INTEGER AS strict, coalesce(min(h.rank) FILTER (WHERE g.chunk_id IS NOT NULL AND h.rank <= 3), 0)::INTEGER AS lenient,
  coalesce(min(h.rank) FILTER (WHERE g.tagged), 0)::INTEGER AS deep FROM q LEFT JOIN hits h USING (query_id) LEFT JOIN gold g ON g.query_id = q.query_id AND g.chunk_id = h.chunk_id GROUP BY q.query_id)"""


def _ranks(spark, d, k=3):
    q = questions(spark, d)
    return evaluate.gold_ranks(q, index(spark, d).topk(q, k), gold(spark, d))


@query(f"{RANKS} SELECT query_id, strict, lenient FROM ranks")
def gold_rank(spark, d):
    return _ranks(spark, d)


@query("SELECT item_id AS query_id, count(*) AS holders FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY item_id")
def gold_rank_facts(spark, d):
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array("text").alias("facts"))
    return index(spark, d).holders(items, chunks(spark, d), any_case=True).groupBy("query_id").agg(F.count(F.lit(1)).alias("holders"))


@query(f"{RANKS} SELECT count(*) AS questions, round(avg((strict > 0)::INT), 3) AS hit_strict, round(avg((lenient > 0)::INT), 3) AS hit_lenient, count(*) FILTER (WHERE strict = 1) AS top1_is_gold FROM ranks")
def hit_rate(spark, d):
    return evaluate.hit_rate(_ranks(spark, d))


@query(f"{RANKS} SELECT round(avg(CASE WHEN strict > 0 THEN 1.0 / strict ELSE 0 END), 6) AS mrr FROM ranks")
def mrr(spark, d):
    return evaluate.mrr(_ranks(spark, d))


LABELS_SQL = RANKS + ", " + BM25_LISTS + rf""", said AS (SELECT query_id, CASE WHEN len(hits) = 0 THEN 'I don''t know based on the provided documents.' ELSE trim(array_to_string({sentences('hits[1].text')}[1:3], ' ') || ' [Source 1]', ' ') END AS answer,
  len(list_filter(hits, lambda h: contains(lower(h.text), lower(split_part(question, ' ', 1))))) AS holders, len(hits) AS shown, coalesce(nullif(array_to_string(list_transform(hits, lambda h: h.chunk_id::VARCHAR), ', '), ''), 'nothing') AS top FROM bl),
fact AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS fact FROM benchmark),
gid AS (SELECT query_id, chunk_id AS gold_id FROM gold WHERE tagged),
lab AS (SELECT query_id, strict, deep AS deep_rank, holders, shown, top, gold_id, answer, CASE WHEN gold_id IS NULL THEN 'NIC' WHEN strict = 0 THEN 'R'
  WHEN answer = 'I don''t know based on the provided documents.' OR NOT contains(lower(answer), lower(fact)) THEN 'G' ELSE 'PASS' END AS label,
  CASE WHEN deep > 0 THEN 'at rank ' || deep ELSE 'not among 25' END AS place FROM ranks JOIN said USING (query_id) JOIN fact USING (query_id) LEFT JOIN gid USING (query_id))"""


def _labels(spark, d):
    q = questions(spark, d).withColumn("facts", F.array(F.array_join(F.slice(F.split("text", " "), 1, 4), " ")))
    hits = session.table(index(spark, d).topk(q, 25), "label-hits")  # ranked once: answers and evidence are cut from it
    lists = session.table(A.hit_lists(q, hits.where("rank <= 3").withColumn("final", F.col("score")), chunks(spark, d)), "label-lists")
    token = F.lower(F.substring_index("question", " ", 1))
    shown = lists.select("query_id", F.explode("hits").alias("h"), token.alias("token")).select("query_id", F.col("h.rank").alias("rank"), F.contains(F.lower("h.text"), F.col("token")).alias("holds_token"))
    hits = hits.join(shown, ["query_id", "rank"], "left")
    return evaluate.failure_labels(q.select("query_id", "facts"), hits, gold(spark, d), A.first_sentences(lists))


@query(f"""{LABELS_SQL} SELECT query_id, strict, deep_rank, label, holders::BIGINT AS holders, CASE label WHEN 'NIC' THEN 'no correct chunk in the corpus' WHEN 'R' THEN 'gold ' || gold_id || ' ' || place || '; ' || holders || ' of ' || shown || ' hold the token; shown ' || top
  WHEN 'G' THEN 'gold ' || gold_id || ' ' || place || '; ' || CASE WHEN answer = 'I don''t know based on the provided documents.' THEN 'refused' ELSE 'another passage was quoted' END ELSE 'gold ' || gold_id || ' ' || place END AS evidence FROM lab""")
def failure_label(spark, d):
    return _labels(spark, d)


@query(f"{LABELS_SQL} SELECT count(*) FILTER (WHERE label = 'PASS') AS pass, count(*) FILTER (WHERE label = 'R') AS r, count(*) FILTER (WHERE label = 'G') AS g, count(*) FILTER (WHERE label = 'NIC') AS nic FROM lab")
def label_tally(spark, d):
    return evaluate.label_tally(_labels(spark, d))


@query("""o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
j AS (SELECT *, greatest(1, least(n - 1, 19 * (n + 1) // 20)) AS j FROM o)
SELECT event_type, n, round(median(value), 6) AS median, round(CASE WHEN n = 1 THEN max(value) ELSE (max(value) FILTER (WHERE r = j) * (20 - (19 * (n + 1) - 20 * j)) + max(value) FILTER (WHERE r = j + 1) * (19 * (n + 1) - 20 * j)) / 20 END, 6) AS p95
FROM j GROUP BY event_type, n, j""")
def latency_quantiles(spark, d):
    return evaluate.latency_quantiles(_t(spark, d, "events"), "event_type", "value")


@query(f"{Q}, {C}, {BM25}, a AS (SELECT query_id, lang FROM sparse JOIN c USING (chunk_id) WHERE rank = 1), b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM bm JOIN c USING (chunk_id) WHERE lang = 'en') SELECT a.query_id, lang AS unfiltered_lang, b.chunk_id AS filtered_top FROM a JOIN b ON a.query_id = b.query_id AND b.r = 1 WHERE lang <> 'en'")
def filter_flip(spark, d):
    """Questions whose best chunk changes its language when only English is searched."""
    q, c = questions(spark, d), chunks(spark, d)
    free = index(spark, d).topk(q, 1).join(c.select("chunk_id", "lang"), "chunk_id").select("query_id", F.col("lang").alias("unfiltered_lang"))
    held = index(spark, d).topk(q, 1, c.where("lang = 'en'")).select("query_id", F.col("chunk_id").alias("filtered_top"))
    return free.join(held, "query_id").where("unfiltered_lang <> 'en'")


@query(f"{Q}, {C}, {BM25} SELECT count(*) FILTER (WHERE starts_with(lang, 'fr')) AS stale FROM sparse JOIN c USING (chunk_id) WHERE rank = 1")
def stale_top1(spark, d):
    first = retrieve.beside(index(spark, d).topk(questions(spark, d), 1), chunks(spark, d).select("chunk_id", "lang"))
    return first.agg(F.count_if(F.startswith("lang", F.lit("fr"))).alias("stale"))


# ---------------------------------------------------------------- assertions

NO = A.REFUSAL
CASES = [
    ("a1", "M1", "Use v3. Call /v3/files/{id} now. [chunk:v3-files::get::1]", "answer", "v3", "v3", "files"),
    ("a2", "M1", "Use `timeout_s` here. [chunk:v2-client::opts::0]", "answer", "v3", "v3", "timeout"),
    ("a3", "M2", NO, "refuse", "", "", ""),
    ("a4", "M2", NO, "answer", "v3", "", "limit"),
    ("a5", "M3", "In v2 timeout_s is now timeout_ms.\n```python\nx = 1\ny = 2\n```\nDone. [chunk:v2-client::opts::2]", "answer", "v2", "v2", "timeout_ms"),
    ("a6", "M3", "```python\nx = = 1\ny = 2\n```", "answer", "", "", "x = "),
    ("a7", "M4", "```x = 1```", "refuse", "", "", ""),
    ("a8", "M4", "GET /v9/nothing and /v3/files/{id}. The same old thing. The same old thing. [chunk:v3-x::y::0]", "answer", "v3", "v3", "nothing"),
    ("a9", "M5", "client = Client()\nr = client.send(1)", "answer", "", "", "send"),
    ("b1", "M5", "one two three four five six seven eight nine one two three four five six seven eight", "answer", "", "", "nine"),
]
#: Cases are the assistant's turns: what one of ten patterns says stands behind a turn's text, or before it where it refuses.
CASE_COLS = "pattern, mode, said, expect, state, cite, must"
CASE_SQL = f"pt({CASE_COLS}, no) AS (VALUES " + ", ".join("(" + ", ".join(_sql_text(v) for v in r) + f", {i})" for i, r in enumerate(CASES)) + r"""),
cs AS (SELECT conv_id, conv_id || '/' || turn AS case_id, pattern, mode, CASE WHEN starts_with(said, 'I don''t know') THEN said || ' ' || text ELSE text || ' ' || said END AS answer, expect, state, cite, must
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant') JOIN pt ON no = (conv_id + turn) % 10),
bd AS (SELECT *, regexp_replace(answer, '\s*\[chunk:([^\]]+)\]\s*$', '') AS body, nullif(regexp_extract(answer, '\s*\[chunk:([^\]]+)\]\s*$', 1), '') AS cited, starts_with(answer, 'I don''t know') AS refused FROM cs)"""
SPEC = ("/v3/files/{id}", "/v3/pages")
DEPRECATED = (("timeout_s", r"\btimeout_s\b", "timeout_ms"), ("paginate_auto", r"\bpaginate_auto\b", "pages"))


def cases(spark, d):
    names = [c.strip() for c in CASE_COLS.split(",")]
    patterns = F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(CASES)], ", ".join(f"{c} string" for c in names) + ", no int"))
    turns = _t(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.join(patterns, F.col("no") == (F.col("conv_id") + F.col("turn")) % 10)
    answer = F.when(F.startswith("said", F.lit("I don't know")), F.concat_ws(" ", "said", "text")).otherwise(F.concat_ws(" ", "text", "said"))
    listed = lambda c: F.filter(F.array(c), lambda x: x != "")
    return rows.select(F.concat_ws("/", "conv_id", "turn").alias("case_id"), "conv_id", "mode", answer.alias("answer"), "expect", listed("state").alias("state_versions"), F.nullif("cite", F.lit("")).alias("cite_version"), listed("must").alias("must_include"))


def spec(spark):
    return spark.createDataFrame([(p,) for p in SPEC], "path string")


def deprecated(spark):
    return spark.createDataFrame(list(DEPRECATED), "symbol string, pattern string, replacement string")


@query(f"{CASE_SQL} SELECT case_id, body, cited FROM bd")
def split_citation(spark, d):
    body, cited = T.split_citation(F.col("answer"))
    return cases(spark, d).select("case_id", body.alias("body"), cited.alias("cited"))


@query(f"{CASE_SQL} SELECT case_id, array_to_string(regexp_extract_all(body, '(?s)```[a-zA-Z]*[ \\t]*\\n?(.*?)```', 1), '~') AS code FROM bd".replace("\\\\", "\\"))
def extract_fences(spark, d):
    body, _ = T.split_citation(F.col("answer"))
    return cases(spark, d).select("case_id", F.array_join(T.fences(body), "~").alias("code"))


#: Syntax is judged by a parser, which SQL lacks: its verdicts on what the ten patterns say, worked out by hand.
CODE_SQL = "cv(pattern, status, detail) AS (VALUES ('a1', 'n/a', 'nothing to parse'), ('a2', 'n/a', 'nothing to parse'), ('a3', 'n/a', 'nothing to parse'), ('a4', 'n/a', 'nothing to parse'), ('a5', 'pass', '1 blocks parse'), ('a6', 'fail', 'SyntaxError: invalid syntax'), ('a7', 'fail', 'a fence holds one line only'), ('a8', 'n/a', 'nothing to parse'), ('a9', 'fail', 'code stands outside fences'), ('b1', 'n/a', 'nothing to parse')), co AS (SELECT case_id, status, detail FROM cs JOIN cv USING (pattern))"


@query(f"{CASE_SQL}, {CODE_SQL} SELECT * FROM co")
def assert_code_parses(spark, d):
    return evaluate.code_parses(cases(spark, d))


ENDPOINT_SQL = r"""ep AS (SELECT case_id, list_distinct(regexp_extract_all(body, '/v\d+/[A-Za-z0-9_\-/{}]*[A-Za-z0-9_}]')) AS p FROM bd), eb AS (SELECT case_id, p, list_sort(list_filter(p, lambda x: x NOT IN ('/v3/files/{id}', '/v3/pages'))) AS bad FROM ep),
en AS (SELECT case_id, CASE WHEN len(p) = 0 THEN 'n/a' WHEN len(bad) > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN len(p) = 0 THEN 'names no path' WHEN len(bad) > 0 THEN 'unknown: ' || array_to_string(bad, ', ') ELSE 'known: ' || array_to_string(list_sort(p), ', ') END AS detail, nullif(array_to_string(bad, ','), '') AS missing FROM eb)"""
DEP_SQL = r"""dh AS (SELECT case_id, body, list_filter(['paginate_auto', 'timeout_s'], lambda x: regexp_matches(body, '\b' || x || '\b')) AS hits FROM bd),
de AS (SELECT case_id, CASE WHEN len(hits) = 0 THEN 'n/a' WHEN regexp_matches(body, '(?i)\b(removed|renamed|replaced|deprecated|is now|no longer|instead|in favou?r of)\b') THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN len(hits) = 0 THEN 'names nothing deprecated' WHEN regexp_matches(body, '(?i)\b(removed|renamed|replaced|deprecated|is now|no longer|instead|in favou?r of)\b') THEN array_to_string(hits, ', ') || ' with a migration note'
    ELSE array_to_string(hits, ', ') || ' without a migration note (use ' || CASE WHEN hits[1] = 'timeout_s' THEN 'timeout_ms' ELSE 'pages' END || ')' END AS detail FROM dh)"""


def _repetition_sql(rows: str) -> str:
    return rf"""rw AS (SELECT case_id, regexp_extract_all(lower(body), '[a-z0-9_]+') AS w, list_filter(string_split_regex(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda p: p <> '')) >= 3) AS s FROM {rows}),
rg AS (SELECT case_id, CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [] END AS g, list_transform(s, lambda x: lower(rtrim(trim(x, ' ' || chr(10)), '.!?'))) AS s FROM rw),
rd AS (SELECT case_id, coalesce(list_filter(g, lambda x, i: list_position(g, x) < i)[1], list_filter(s, lambda x, i: list_position(s, x) < i)[1]) AS again FROM rg),
re AS (SELECT case_id, CASE WHEN again IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce('comes twice: ' || again, 'nothing comes twice') AS detail FROM rd)"""


@query(f"{CASE_SQL}, {ENDPOINT_SQL} SELECT * FROM en")
def assert_endpoints(spark, d):
    return evaluate.endpoints(cases(spark, d), spec(spark))


@query(f"{CASE_SQL}, {DEP_SQL} SELECT * FROM de")
def assert_deprecations(spark, d):
    return evaluate.deprecations(cases(spark, d), deprecated(spark))


@query("bd AS (SELECT conv_id || '/' || turn AS case_id, text AS body FROM conversations WHERE role = 'assistant'), " + _repetition_sql("bd") + " SELECT * FROM re")
def assert_no_repetition(spark, d):
    said = _t(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("case_id"), F.col("text").alias("answer"))
    return evaluate.repetition(said)


#: A symbol is the longest word of an item (the first of several), and what is to be used instead the item's id.
@query(rf"""iw AS (SELECT item_id, regexp_extract_all(text, '[a-z]{{6,}}') AS w FROM benchmark),
sy AS (SELECT item_id::VARCHAR AS use, list_sort(list_transform(w, lambda x, i: {{'n': -length(x), 'i': i, 'w': x}}))[1].w AS symbol FROM iw WHERE len(w) > 0),
tk AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS symbol FROM documents),
ht AS (SELECT doc_id, list_sort(list({{'symbol': symbol, 'use': use}})) AS h FROM tk JOIN sy USING (symbol) GROUP BY doc_id),
hb AS (SELECT d.doc_id AS case_id, h, regexp_matches(coalesce(text, ''), '(?i)\b(removed|renamed|replaced|deprecated|is now|no longer|instead|in favou?r of)\b') AS noted FROM documents d LEFT JOIN ht USING (doc_id))
SELECT case_id, CASE WHEN h IS NULL THEN 'n/a' WHEN noted THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN h IS NULL THEN 'names nothing deprecated' WHEN noted THEN array_to_string(list_transform(h, lambda x: x.symbol), ', ') || ' with a migration note' ELSE array_to_string(list_transform(h, lambda x: x.symbol), ', ') || ' without a migration note (use ' || h[1].use || ')' END AS detail FROM hb""")
def deprecations_in_documents(spark, d):
    """Every text against a pattern for each item of the benchmark."""
    words = F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))
    longest = F.array_min(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))["w"]
    symbols = _t(spark, d, "benchmark").select(longest.alias("symbol"), F.col("item_id").cast("string").alias("replacement")).where("symbol is not null")
    symbols = symbols.withColumn("pattern", F.concat(F.lit("(?<![A-Za-z0-9_])"), "symbol", F.lit("(?![A-Za-z0-9_])")))
    return evaluate.deprecations(_spread(_t(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("answer"))), symbols)


@query(r"""cw AS (SELECT conv_id || '/' || turn AS case_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM conversations),
pw AS (SELECT case_id, w[i] AS word, i FROM (SELECT case_id, w, unnest(range(1, len(w) + 1)) AS i FROM cw)),
eq AS (SELECT a.case_id, a.i, b.i - a.i AS gap FROM pw a JOIN pw b ON a.case_id = b.case_id AND a.word = b.word AND a.i < b.i),
il AS (SELECT case_id, gap, i, i - row_number() OVER (PARTITION BY case_id, gap ORDER BY i) AS island FROM eq),
ln AS (SELECT case_id, count(*) AS n, min(i) AS i FROM il GROUP BY case_id, gap, island),
mx AS (SELECT case_id, max(n) AS n FROM ln GROUP BY case_id), be AS (SELECT case_id, n, min(i) AS i FROM ln JOIN mx USING (case_id, n) GROUP BY ALL)
SELECT case_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS longest, (i - 1)::BIGINT AS at, array_to_string(w[i:i + n - 1], ' ') AS passage FROM cw LEFT JOIN be USING (case_id)""")
def longest_repeat(spark, d):
    """The longest passage that a turn says twice."""
    said = _t(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("case_id"), "text")
    return runs.longest_repeats(said, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))



FOUR_SQL = r"""fo AS (SELECT case_id, CASE WHEN refused OR state = '' THEN 'n/a' WHEN regexp_matches(body, '(?i)\b' || state || '\b') THEN 'pass' ELSE 'fail' END AS version_stated,
  CASE WHEN refused THEN 'refused' WHEN state = '' THEN 'no version asked for' WHEN regexp_matches(body, '(?i)\b' || state || '\b') THEN 'says ' || state ELSE 'never says ' || state END AS version_stated_detail,
  CASE WHEN cite = '' OR refused THEN 'n/a' WHEN coalesce(split_part(cited, '-', 1), '') = cite THEN 'pass' ELSE 'fail' END AS cites_question_version,
  CASE WHEN cite = '' THEN 'no version asked for' WHEN refused THEN 'refused' WHEN coalesce(split_part(cited, '-', 1), '') = cite THEN 'cites ' || cite ELSE 'cites ' || coalesce(split_part(cited, '-', 1), 'nothing') || ', asked for ' || cite END AS cites_question_version_detail,
  CASE WHEN (expect = 'answer') <> refused THEN 'pass' ELSE 'fail' END AS answered_when_answerable,
  CASE WHEN expect = 'answer' AND refused THEN 'refused what can be answered' WHEN expect = 'answer' THEN 'answered' WHEN refused THEN 'refused' ELSE 'answered what can''t be' END AS answered_when_answerable_detail,
  CASE WHEN must = '' THEN 'n/a' WHEN NOT refused AND regexp_matches(body, '(?i)' || must) THEN 'pass' ELSE 'fail' END AS required_facts_present,
  CASE WHEN must = '' THEN 'no facts' WHEN refused THEN 'refused' WHEN regexp_matches(body, '(?i)' || must) THEN 'all facts said' ELSE 'lacks ' || must END AS required_facts_present_detail FROM bd)"""


def _four(name: str):
    def run(spark, d):
        return evaluate.case_checks(cases(spark, d)).select("case_id", f"{name}.status", f"{name}.detail")

    return run


for _q, _c in (("assert_version_stated", "version_stated"), ("assert_cited_version", "cites_question_version"), ("assert_answered", "answered_when_answerable"), ("assert_facts", "required_facts_present")):
    QUERIES[_q] = _four(_c)
    ORACLES[_q] = f"WITH {CASE_SQL}, {FOUR_SQL} SELECT case_id, {_c} AS status, {_c}_detail AS detail FROM fo"

RESULTS_SQL = f"""{CASE_SQL}, {ENDPOINT_SQL}, {DEP_SQL}, {_repetition_sql('bd')}, {FOUR_SQL}, {CODE_SQL},
al AS (SELECT case_id, 'code_parses' AS name, status FROM co UNION ALL SELECT case_id, 'endpoints_in_spec', status FROM en UNION ALL SELECT case_id, 'deprecation_has_migration_note', status FROM de UNION ALL SELECT case_id, 'no_repeated_sentence', status FROM re
  UNION ALL SELECT case_id, 'version_stated', version_stated FROM fo UNION ALL SELECT case_id, 'cites_question_version', cites_question_version FROM fo UNION ALL SELECT case_id, 'answered_when_answerable', answered_when_answerable FROM fo UNION ALL SELECT case_id, 'required_facts_present', required_facts_present FROM fo)"""
VERDICT_SQL = "vd AS (SELECT case_id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM cs JOIN labels ON doc_id = conv_id)"


def verdicts(spark, d):
    """A judge's verdict for the cases of conversations that have a label."""
    rated = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"))
    return cases(spark, d).join(rated, F.col("doc_id") == F.col("conv_id")).select("case_id", "verdict")


def _results(spark, d):
    return evaluate.run_assertions(cases(spark, d), spec(spark), deprecated(spark))


@query(f"{RESULTS_SQL} SELECT name, count(*) FILTER (WHERE status <> 'n/a') AS applies, count(*) FILTER (WHERE status = 'fail') AS fails FROM al GROUP BY name")
def assertion_summary(spark, d):
    return evaluate.assertion_summary(_results(spark, d))


@query(f"""{RESULTS_SQL}, {VERDICT_SQL}, ok AS (SELECT case_id, count(*) FILTER (WHERE status = 'fail') = 0 AS a FROM al GROUP BY case_id),
f AS (SELECT mode, a, coalesce(verdict = 'PASS', false) AS j FROM cs JOIN ok USING (case_id) LEFT JOIN vd USING (case_id))
SELECT coalesce(mode, 'all') AS mode, count(*) AS n, count(*) FILTER (WHERE a) AS assertions, count(*) FILTER (WHERE j) AS judge, count(*) FILTER (WHERE a AND j) AS both FROM f GROUP BY ROLLUP (mode)""")
def pass_rate_by_mode(spark, d):
    return evaluate.pass_rates(cases(spark, d), _results(spark, d), verdicts(spark, d))


# ---------------------------------------------------------------- agreement

def _raters(spark, d):
    v = lambda c: F.when(F.col(c) == 1, "PASS").otherwise("FAIL")
    return _t(spark, d, "labels").select(F.col("doc_id").alias("case_id"), v("quality").alias("human"), v("toxic").alias("judge"))


def _agree_sql(where: str) -> str:
    return f"SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS pass_pass, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS pass_fail, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fail_pass, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fail_fail, count(*) FILTER (WHERE quality = toxic) || '/' || count(*) || ' (' || round(100.0 * count(*) FILTER (WHERE quality = toxic) / count(*), 0)::INT || '%)' AS agree FROM labels WHERE {where}"


@query(_agree_sql("true"))
def agreement_matrix(spark, d):
    return evaluate.agreement(_raters(spark, d))


@query(_agree_sql("doc_id >= 100"))
def agreement_heldout(spark, d):
    shown = _t(spark, d, "labels").where("doc_id < 100").select(F.col("doc_id").alias("case_id"))
    return evaluate.agreement(_raters(spark, d), shown)


#: Three runs of a judge over the labelled documents: as the label says, turned round for every seventh, always PASS.
HUMAN_SQL = "hu AS (SELECT doc_id::VARCHAR AS case_id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS label FROM labels)"
RUN_SQL = HUMAN_SQL + ", ru AS (SELECT 'r1' AS run, case_id, label AS verdict FROM hu UNION ALL SELECT 'r2', case_id, CASE WHEN case_id::BIGINT % 7 = 0 THEN CASE label WHEN 'PASS' THEN 'FAIL' ELSE 'PASS' END ELSE label END FROM hu UNION ALL SELECT 'r3', case_id, 'PASS' FROM hu)"


def _human(spark, d):
    return _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("label"))


@query(f"""{RUN_SQL},
g AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE verdict = label) AS agree, count(*) FILTER (WHERE case_id::BIGINT >= 50) AS held_out, count(*) FILTER (WHERE verdict = label AND case_id::BIGINT >= 50) AS agree_held_out FROM ru JOIN hu USING (case_id) GROUP BY run)
SELECT *, (SELECT count(*) FROM (SELECT case_id FROM ru GROUP BY case_id HAVING count(DISTINCT verdict) > 1)) AS moving_cases, (SELECT round(avg(agree / n), 6) FROM g) AS mean_agree, (SELECT round(avg(agree_held_out / held_out), 6) FROM g) AS mean_held_out FROM g""")
def verdict_stability(spark, d):
    human = _human(spark, d)
    turned = F.when(F.col("label") == "PASS", "FAIL").otherwise("PASS")
    says = (F.col("label"), F.when(F.col("case_id").cast("long") % 7 == 0, turned).otherwise(F.col("label")), F.lit("PASS"))
    runs = [human.select(F.lit(f"r{i}").alias("run"), "case_id", v.alias("verdict")) for i, v in enumerate(says, 1)]
    return evaluate.stability(runs[0].unionByName(runs[1]).unionByName(runs[2]), human, human.where("cast(case_id as long) < 50").select("case_id"))


#: Answers, locked answers, labels and locked labels by their digests, runs so far, version, prediction.
LOCKS = (("a", "a", "b", "b", 0, "v1", False), ("a", "z", "b", "b", 0, "v1", False), ("a", "a", "b", "z", 0, "v1", False), ("a", "a", "b", None, 0, "v1", False), ("a", "a", "b", "b", 2, "v1", False), ("a", "a", "b", "b", 0, "v2", False), ("a", "a", "b", "b", 0, "v2", True), ("a", "a", "b", "b", 0, "v1", False))


@query(f"""{HUMAN_SQL}, lk(i, a, la, l, ll, runs, version, predicted) AS (VALUES {', '.join('(' + ', '.join([str(i), *("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in x)]) + ')' for i, x in enumerate(LOCKS))}),
y AS (SELECT i, CASE WHEN i = 7 THEN 'wrong number of labels' WHEN (SELECT count(*) FILTER (WHERE label NOT IN ('PASS', 'FAIL')) FROM hu) > 0 THEN 'incomplete labels' WHEN ll IS NULL THEN 'labels aren''t locked' WHEN l <> ll THEN 'labels changed after the lock' WHEN a <> la THEN 'answers changed after the lock'
  WHEN version <> 'v1' AND NOT predicted THEN 'no prediction before the run' WHEN runs > 0 THEN 'judge runs exist already' ELSE '' END AS reason FROM lk)
SELECT i::INTEGER AS i, reason = '' AS valid, reason FROM y""")
def label_lock_check(spark, d):
    labels = _human(spark, d)
    n, out = labels.count(), None
    for i, (a, la, l, ll, runs, version, predicted) in enumerate(LOCKS):
        one = evaluate.lock_check(labels, a, la, l, ll, runs, n + (i == 7), version, predicted).select(F.lit(i).alias("i"), "valid", "reason")
        out = one if out is None else out.unionByName(one)
    return out


TEMPLATE = "Question: {question}\\nDocuments:\\n{context}\\nAnswer: {answer}\\n".replace("\\n", "\n")


@query(rf"""{Q}, {C}, {BM25}, {BM25_LISTS}, cx AS (SELECT query_id, question, array_to_string(list_transform(hits, lambda h: '[' || h.rank || '] ' || h.chunk_id || chr(10) || h.text), chr(10) || chr(10)) AS context,
  CASE WHEN len(hits) = 0 THEN 'I don''t know based on the provided documents.' ELSE trim(array_to_string({sentences('hits[1].text')}[1:3], ' ') || ' [Source 1]', ' ') END AS answer FROM bl)
SELECT query_id, md5('Question: ' || question || chr(10) || 'Documents:' || chr(10) || context || chr(10) || 'Answer: ' || answer || chr(10)) AS prompt FROM cx""")
def judge_prompt(spark, d):
    lists = bm25_lists(spark, d)
    full = lists.select("query_id", "question").join(A.context(lists), "query_id").join(A.first_sentences(lists), "query_id")
    return evaluate.judge_prompts(full, TEMPLATE).select("query_id", F.md5("prompt").alias("prompt"))


#: What a judge may reply to a labelled document, by the rest of its number; ``{}`` is its verdict.
REPLIES = ('Sure: {"verdict": "{}", "reason": "fine"} ok', '{"verdict": "MAYBE"}', "none", '{"verdict": "{}"}')
RAW_SQL = f"{HUMAN_SQL}, ra AS (SELECT case_id, replace(reply, '{{}}', label) AS raw FROM hu JOIN (VALUES {', '.join(f'({_sql_text(r)}, {i})' for i, r in enumerate(REPLIES))}) AS r(reply, no) ON no = case_id::BIGINT % 4)"


@query(rf"{RAW_SQL}, j AS (SELECT case_id, regexp_extract(raw, '(?s)\{{.*\}}') AS o FROM ra) SELECT case_id, o->>'verdict' AS verdict, coalesce(o->>'reason', '') AS reason FROM j WHERE o <> '' AND o->>'verdict' IN ('PASS', 'FAIL')")
def parse_verdict(spark, d):
    replies = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("case_id").cast("long") % 4 + 1).cast("int"))
    return evaluate.parse_verdicts(_human(spark, d).select("case_id", F.replace(replies, F.lit("{}"), F.col("label")).alias("raw")))


@query("""SELECT doc_id::VARCHAR AS case_id, 'p' || doc_id % 3 AS prompt_sha, 'a' || quality AS answers_sha FROM labels EXCEPT SELECT doc_id::VARCHAR, CASE WHEN doc_id % 5 = 0 THEN 'p0' ELSE 'p' || doc_id % 3 END, CASE WHEN doc_id % 4 = 0 THEN 'a0' ELSE 'a' || quality END FROM labels""")
def judge_cache_todo(spark, d):
    """Cached are verdicts of which some are for another prompt and some for another answer."""
    rows, doc, keys = _t(spark, d, "labels"), F.col("doc_id"), ("case_id", "prompt_sha", "answers_sha")
    sha = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    want = rows.select(doc.cast("string"), sha("p", doc % 3), sha("a", F.col("quality"))).toDF(*keys)
    have = rows.select(doc.cast("string"), F.when(doc % 5 == 0, "p0").otherwise(sha("p", doc % 3)), F.when(doc % 4 == 0, "a0").otherwise(sha("a", F.col("quality")))).toDF(*keys)
    return evaluate.judge_todo(want, have)


JUDGED_SQL = rf"""{Q}, {C}, {BM25}, {BM25_LISTS}, jc AS (SELECT query_id AS case_id, question, array_to_string(list_transform(hits, lambda h: '[' || h.rank || '] ' || h.chunk_id || chr(10) || h.text), chr(10) || chr(10)) AS context,
  CASE WHEN query_id % 3 = 0 THEN 'made up' WHEN len(hits) = 0 THEN 'I don''t know based on the provided documents.' ELSE trim({sentences('hits[1].text')}[1], ' ') END AS answer FROM bl)"""


@query(f"""{JUDGED_SQL} SELECT case_id, 'v1' AS judge, CASE WHEN case_id % 5 = 0 AND case_id % 3 = 0 THEN 'PASS' WHEN contains(context, answer) AND answer <> 'I don''t know based on the provided documents.' THEN 'PASS' ELSE 'FAIL' END AS verdict, sha256(answer) AS answers_sha FROM jc""")
def judge_run(spark, d):
    """A judge's run over answers of which some are made up; what was recorded for the same prompt and answer isn't asked again."""
    lists = bm25_lists(spark, d)
    first = F.get(T.sentences(F.get("hits", F.lit(0))["text"]), F.lit(0))
    said = F.when(F.col("query_id") % 3 == 0, "made up").when(F.size("hits") == 0, NO).otherwise(F.trim(first))
    listed = session.table(lists.join(A.context(lists), "query_id").select(F.col("query_id").alias("case_id"), "question", "context", said.alias("answer")), "judge-cases")
    sha = F.sha2(F.lit(TEMPLATE), 256)
    recorded = listed.where("case_id % 5 = 0 and case_id % 3 = 0").select("case_id", F.lit("v1").alias("judge"), sha.alias("prompt_sha"), F.sha2("answer", 256).alias("answers_sha"), F.lit("PASS").alias("verdict"), F.lit("recorded").alias("reason"))
    old = listed.limit(0).select("case_id", F.lit("v1").alias("judge"), sha.alias("prompt_sha"), F.sha2("answer", 256).alias("answers_sha"), F.lit("PASS").alias("verdict"), F.lit("").alias("reason"))
    version = evaluate.judge_version({"v1": TEMPLATE}, locked=True)
    return evaluate.judge_run(listed, TEMPLATE, evaluate.JUDGES["quoted"], version, recorded.unionByName(old)).select("case_id", "judge", "verdict", "answers_sha")


# ---------------------------------------------------------------- traces

def _run(spark, d) -> trace.Run:
    kept = _corpus(spark, d)
    if "version" not in kept:
        kept["version"] = trace.corpus_fingerprint(chunks(spark, d)).first().digest
    return trace.Run(pipeline="hybrid", collection="documents", top_k=5, threshold=THRESHOLD, floor=FLOOR, corpus_version=kept["version"])


#: A run of another depth, kept to English.
ENGLISH = {"pipeline": "baseline", "top_k": 2, "filters": {"lang": "en"}}


def _traces(spark, d):
    """Traces of all questions, through the trace log."""
    found, q = corpus(spark, d)
    path = session.new_path(spark, "traces")
    files.append_traces(trace.ask(found, q, common_array(spark, d), _run(spark, d)), path)
    return files.json_lines(spark, path, trace.SCHEMA)


TRACED_SQL = f"""{HYBRID}, {HYBRID_LISTS}, {COMMON}, {_answer_sql()}, tr AS (SELECT q.*, row_number() OVER (ORDER BY query_id) - 1 AS pos FROM q)"""


@query(f"""{TRACED_SQL}
SELECT question, 's' || lpad((pos // 5)::VARCHAR, 3, '0') AS session, len(hits)::INTEGER AS hits, round(hits[1].final, 6) AS first_final, md5(answer) AS raw_output, 5 AS top_k, true AS has_id FROM tr JOIN hl USING (query_id, question) JOIN an USING (query_id)""")
def trace_build(spark, d):
    t = _traces(spark, d)
    good = F.rlike("trace_id", F.lit("^tr-[0-9a-f]{10}$")) & (F.col("latency_ms.retrieve") >= 0) & F.rlike("ts", F.lit(r"^\d{4}-\d\d-\d\dT[\d:]{8}\+00:00$"))
    return t.select("question", "session", F.size("retrieved").alias("hits"), F.get("retrieved", F.lit(0))["final"].alias("first_final"), F.md5("raw_output").alias("raw_output"), F.col("params.top_k").alias("top_k"), good.alias("has_id"))


#: In replays every other session has stricter limits than it was answered with, and every third output was changed.
ODD = "((SELECT pos FROM tr WHERE tr.query_id = sp.query_id) // 5) % 2 = 1"
REPLAY_SQL = f"""{HYBRID}, {HYBRID_LISTS}, {COMMON}, tr AS (SELECT q.*, row_number() OVER (ORDER BY query_id) - 1 AS pos FROM q),
{ANSWER.replace('THRESHOLD', f'(CASE WHEN {ODD} THEN 0.5 ELSE {THRESHOLD} END)').replace('FLOOR', f'(CASE WHEN {ODD} THEN 0.9 ELSE {FLOOR} END)').replace(', an AS MATERIALIZED', ', an AS MATERIALIZED')},
old AS (SELECT ga.query_id, CASE WHEN top_score IS NULL OR top_score < {THRESHOLD} OR support < {FLOOR} THEN 'I don''t know based on the provided documents.' ELSE cited END AS raw FROM ga LEFT JOIN quo USING (query_id)),
ch AS (SELECT query_id, question, answer, CASE WHEN pos % 3 = 0 THEN 'changed' ELSE raw END AS raw FROM an JOIN old USING (query_id) JOIN tr USING (query_id))"""


def _changed(spark, d):
    number = F.col("session").substr(2, 3).cast("int")
    strict = lambda a, b: F.when(number % 2 == 1, F.lit(a)).otherwise(F.lit(b))
    params = F.col("params").withField("score_threshold", strict(0.5, THRESHOLD)).withField("support_floor", strict(0.9, FLOOR))
    t = session.table(_traces(spark, d).withColumn("params", params), "traces-changed")
    q = trace.row_numbers(questions(spark, d).select("query_id", "question"), "query_id").select(F.col("question").alias("q"), "pos")
    return t.join(q, F.col("question") == F.col("q")).withColumn("raw_output", F.when(F.col("pos") % 3 == 0, "changed").otherwise(F.col("raw_output")))


@query(f"{REPLAY_SQL} SELECT question, md5(answer) AS replayed, answer = raw AS same FROM ch")
def trace_replay(spark, d):
    t = _changed(spark, d)
    return trace.replay(t).join(t.select("trace_id", "question"), "trace_id").select("question", F.md5("replayed").alias("replayed"), "same")


@query(f"{REPLAY_SQL} SELECT count(*) AS traces, count(*) FILTER (WHERE answer = raw) AS identical FROM ch")
def regression_replay(spark, d):
    return trace.replay(_changed(spark, d)).agg(F.count(F.lit(1)).alias("traces"), F.count_if("same").alias("identical"))


#: What a run that is kept to English retrieves.
FILTERED_SQL = f"""{BOTH},
de AS MATERIALIZED (SELECT query_id, chunk_id, dense, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, chunk_id) AS dense_rank FROM dn JOIN documents ON doc_id = chunk_id WHERE lang = 'en'),
re AS (SELECT query_id, chunk_id, round(final, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, dense_rank) AS rank
  FROM (SELECT de.*, dense + 0.15 * {overlap('question', 'text')} AS final FROM de JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE dense_rank <= 6))"""


@query(f"""{FILTERED_SQL} SELECT question, coalesce(string_agg(chunk_id || ':' || rank, ',' ORDER BY rank) FILTER (WHERE rank <= 2), '') AS hits, 'en' AS lang FROM q LEFT JOIN re USING (query_id) GROUP BY q.query_id, question""")
def trace_filtered(spark, d):
    """Traces of a run with a filter: what was retrieved has the value that the trace says."""
    found, q = corpus(spark, d, words=False)
    t = trace.ask(found, q, common_array(spark, d), dataclasses.replace(_run(spark, d), **ENGLISH))
    hits = F.array_join(F.transform("retrieved", lambda h: F.concat(h["chunk_id"], F.lit(":"), h["rank"].cast("string"))), ",")
    return t.select("question", hits.alias("hits"), F.element_at("params.filters", F.lit("lang")).alias("lang"))


@query(f"""SELECT question, 5 AS top_k, md5(answer) AS replayed, true AS same_hits, true AS same_output, 'corpus_version' AS moved FROM (WITH RECURSIVE {TRACED_SQL} SELECT question, answer FROM tr JOIN an USING (query_id))
UNION ALL SELECT question, 2, md5(answer), true, true, 'corpus_version' FROM (WITH RECURSIVE {FILTERED_SQL}, {HYBRID_LISTS.replace('LEFT JOIN hy', 'LEFT JOIN (SELECT * FROM re WHERE rank <= 2) hy')}, {COMMON}, {_answer_sql()} SELECT question, answer FROM q JOIN an USING (query_id))""")
def trace_replay_full(spark, d):
    """Retrieval and answer again for a log of two retrievers and depths, one of them filtered, under a run that says the corpus has changed."""
    found, q = corpus(spark, d)
    run, common = _run(spark, d), common_array(spark, d)
    log = session.table(_traces(spark, d).unionByName(trace.ask(found, q, common, dataclasses.replace(run, **ENGLISH))), "trace-log")
    again = trace.replay_full(log, found, q, dataclasses.replace(run, corpus_version="another")).join(log.select("trace_id", "question", "params.top_k"), "trace_id")
    return again.select("question", "top_k", F.md5("replayed").alias("replayed"), "same_hits", "same_output", F.array_join("moved", ",").alias("moved"))


@query("""l AS (SELECT 't' || user_id AS trace_id, ts::VARCHAR AS ts, event_id::VARCHAR AS raw_output, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS later FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY later DESC, ts DESC, raw_output DESC) AS r FROM l) SELECT trace_id, raw_output FROM r WHERE r = 1""")
def trace_union(spark, d):
    """Two logs of a user's events: every third event is in the later one."""
    rows = _t(spark, d, "events").select("event_id", F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"), F.col("ts").cast("string").alias("ts"), F.col("event_id").cast("string").alias("raw_output"))
    return trace.union_logs(rows.where("event_id % 3 <> 0").drop("event_id"), rows.where("event_id % 3 = 0").drop("event_id")).select("trace_id", "raw_output")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY md5('7:' || event_id), event_id)::INTEGER AS pos FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 20")
def seeded_sample(spark, d):
    """A variant of the seeded sample that any engine repeats; ``trace.seeded_pick`` draws Python's own."""
    rows = _t(spark, d, "events").select("event_id", "event_type")
    drawn = trace.hashed_sample(rows.select("event_id"), "event_id", 7, 20)
    return trace.picked(rows, [r.event_id for r in drawn.orderBy("pos").collect()], "event_id")


@query(rf"""{Q}, {C}, {BM25}, {BM25_LISTS}, o AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || query_id), query_id) AS pos FROM bl)
SELECT pos, query_id AS case_id, md5('## ' || pos || '. ' || query_id || ': ' || question || chr(10) || chr(10) || 'Shown:' || chr(10) || chr(10) || array_to_string(list_transform(hits, lambda h: '[' || h.rank || '] ' || h.chunk_id || chr(10) || h.text), chr(10) || chr(10)) || chr(10) || chr(10) || 'Answer:' || chr(10) || chr(10) || 'none' || chr(10) || chr(10) || 'Label: ____') AS entry FROM o""")
def labelling_sheet(spark, d):
    lists = bm25_lists(spark, d)
    listed = lists.select("query_id", "question").join(A.context(lists), "query_id").select(F.col("query_id").alias("case_id"), "question", "context", F.lit("none").alias("answer"))
    return trace.labelling_sheet(listed, 5).select("pos", "case_id", F.md5("entry").alias("entry"))


@query("SELECT '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source")
def report_markdown(spark, d):
    return files.report_markdown(_t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT lang AS collection, count(*) AS rows FROM documents GROUP BY lang")
def collection_listing(spark, d):
    path = session.new_path(spark, "collections")
    files.write_collection(chunks(spark, d).withColumn("collection", F.col("lang")), path)
    return files.collections(spark, path)


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'even' ELSE source END AS source, CASE WHEN doc_id % 7 = 0 THEN 7 WHEN doc_id % 2 = 0 THEN 2 END AS cluster_id FROM documents")
def metadata_update(spark, d):
    c = chunks(spark, d).drop("text", "lang")
    changes = c.where("chunk_id % 7 = 0 or chunk_id % 2 = 0").select("chunk_id", F.when(F.col("chunk_id") % 7 == 0, F.lit(None)).otherwise("even").alias("source"), F.when(F.col("chunk_id") % 7 == 0, 7).otherwise(2).alias("cluster_id"))
    return files.update_metadata(c, changes, "chunk_id")


@query("SELECT item_id, 's' || lpad(((row_number() OVER (ORDER BY item_id) - 1) // 5)::VARCHAR, 3, '0') AS session FROM benchmark")
def session_bucket(spark, d):
    numbered = trace.row_numbers(_t(spark, d, "benchmark").select("item_id"), "item_id")
    return numbered.select("item_id", trace.session(F.col("pos")).alias("session"))


@query(rf"""{Q}, {C}, {BM25}, {BM25_LISTS}, {GOLD}, tg AS (SELECT query_id, chunk_id FROM gold WHERE tagged),
rw AS (SELECT bl.query_id, h.rank, '| ' || h.rank || ' | ' || h.chunk_id || ' | ' || CASE WHEN tg.chunk_id = h.chunk_id THEN '**GOLD**' ELSE '' END || ' | ' || left(replace(replace(h.text, chr(10), ' '), '|', '\|'), 110) || ' |' AS r
  FROM (SELECT query_id, unnest(hits) AS h FROM bl) bl LEFT JOIN tg USING (query_id))
SELECT bl.query_id, md5('## ' || bl.query_id || chr(10) || '| rank | chunk | gold? | text |' || chr(10) || '|---|---|---|---|' || chr(10) || coalesce(string_agg(r, chr(10) ORDER BY rank), '')) AS view FROM bl LEFT JOIN rw USING (query_id) GROUP BY bl.query_id""")
def inspection_view(spark, d):
    return trace.inspection(bm25_lists(spark, d), gold(spark, d)).select("query_id", F.md5("view").alias("view"))


DASH = lambda x: f"coalesce({x}::VARCHAR, '-')"
FULL_VIEW_SQL = rf"""{HYBRID}, {HYBRID_LISTS}, {COMMON}, {_answer_sql()}, {GOLD},
gi AS (SELECT query_id, max(chunk_id) FILTER (WHERE tagged) AS gold_id, coalesce(list(DISTINCT chunk_id ORDER BY chunk_id) FILTER (WHERE NOT tagged), []) AS others FROM gold GROUP BY query_id),
tp AS (SELECT query_id, min(rank) FILTER (WHERE tagged) AS deep, string_agg(chunk_id::VARCHAR, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS top FROM hy LEFT JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
lb AS (SELECT q.query_id, question, gold_id, others, deep, top, gate, answer, CASE WHEN gold_id IS NULL THEN 'NIC' WHEN coalesce(deep, 99) > 3 THEN 'R' WHEN gate = 'open' AND contains(lower(answer), lower(array_to_string(string_split(b.text, ' ')[1:4], ' '))) THEN 'PASS' ELSE 'G' END AS label
  FROM q JOIN benchmark b ON item_id = q.query_id JOIN an ON an.query_id = q.query_id LEFT JOIN gi ON gi.query_id = q.query_id LEFT JOIN tp ON tp.query_id = q.query_id),
ev AS (SELECT *, CASE WHEN label = 'NIC' THEN 'no correct chunk in the corpus' ELSE 'gold ' || gold_id || ' ' || CASE WHEN deep IS NULL THEN 'not among ' || (SELECT max(rank) FROM hy) ELSE 'at rank ' || deep END
  || CASE label WHEN 'R' THEN '; shown ' || coalesce(top, 'nothing') WHEN 'G' THEN '; ' || CASE gate WHEN 'open' THEN 'another passage was quoted' ELSE 'refused by ' || gate END ELSE '' END END AS evidence FROM lb),
vr AS (SELECT query_id, string_agg('| ' || rank || ' | ' || hy.chunk_id || ' | ' || {DASH("lang")} || ' | ' || {DASH("round(dense, 3)::DECIMAL(18,3)")} || ' | ' || round(final, 3)::DECIMAL(18,3)
  || ' | vectors ' || {DASH("dense_rank")} || ', words ' || {DASH("bm25_rank")} || ', ' || round(rrf, 6)::DECIMAL(18,6) || ' | ' || CASE WHEN hy.chunk_id = gold_id THEN '**GOLD**' WHEN list_contains(coalesce(others, []), hy.chunk_id) THEN 'right too' ELSE '' END
  || ' | ' || left(replace(replace(d.text, chr(10), ' '), '|', '\|'), 110) || ' |', chr(10) ORDER BY rank) AS rows FROM hy JOIN documents d ON d.doc_id = hy.chunk_id LEFT JOIN gi USING (query_id) GROUP BY query_id)
SELECT query_id, label, md5('## ' || query_id || ': ' || question || chr(10) || chr(10) || 'Gold: ' || coalesce(gold_id::VARCHAR, 'none') || CASE WHEN len(others) > 0 THEN ' (right too: ' || array_to_string(others, ', ') || ')' ELSE '' END || chr(10) || chr(10)
  || '| rank | chunk | version | dense | final | fusion | gold? | text |' || chr(10) || '|---|---|---|---|---|---|---|---|' || coalesce(chr(10) || rows, '') || chr(10) || chr(10) || 'Answer: ' || answer || chr(10) || chr(10) || 'Label: ' || label || ', ' || evidence) AS view
FROM ev LEFT JOIN vr USING (query_id)"""


@query(FULL_VIEW_SQL)
def inspection_hybrid(spark, d):
    """The whole view of fused hits, with answers and labels; a document's language stands for its version, an item's first
    four words for its fact."""
    found, q = corpus(spark, d)
    hits = session.table(retrieve.hybrid_topk(found, q, 5), "inspected")
    lists = session.table(A.hit_lists(q, hits, found.chunks, ("dense_rank", "bm25_rank", "rrf", "lang")), "inspected-lists")
    said = session.table(A.answers(lists, common_array(spark, d), THRESHOLD, FLOOR), "inspected-answers")
    right = gold(spark, d)
    facts = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.array_join(F.slice(F.split("text", " "), 1, 4), " ")).alias("facts"))
    labels = evaluate.failure_labels(facts, hits.select("query_id", "rank", "chunk_id", F.lit(None).cast("boolean").alias("holds_token")), right, said)
    labels = session.table(labels, "inspected-labels")
    return trace.full_inspection(lists, right, said, labels, "lang").join(labels.select("query_id", "label"), "query_id").select("query_id", "label", F.md5("view").alias("view"))


@query("SELECT '{\"source\":\"' || source || '\",\"n\":' || count(*) || '}' AS json FROM documents GROUP BY source")
def report_json(spark, d):
    return files.report_json(_t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- clusters

@query("""v AS (SELECT vec_id AS id, embedding AS e, label AS c FROM embeddings),
p AS (SELECT a.id, a.c, b.c AS c2, avg(sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i]::DOUBLE - b.e[i]::DOUBLE) ** 2)))) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, max(d) FILTER (WHERE c = c2) AS a, min(d) FILTER (WHERE c <> c2) AS b FROM p GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette_exact(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("cluster"))
    return cluster.silhouette(rows)


@query()
def cluster_assign(spark, d):
    rows, k, score = cluster.assign(_t(spark, d, "embeddings"), most_k=8, starts=10)
    return rows.select(F.col("id").alias("vec_id"), "cluster", F.lit(k).alias("k"), F.lit(score).alias("silhouette"))


@query(f"""m AS (SELECT label AS cluster, doc_id AS pos, list_concat(list_filter({simple('source')}, lambda w: length(w) > 3), list_filter({simple('text')}, lambda w: length(w) > 3 AND NOT list_contains([{', '.join(f"'{w}'" for w in cluster.STOPWORDS)}], w))) AS ws FROM documents JOIN embeddings ON vec_id = doc_id),
t AS (SELECT cluster, term, count(*) AS n, min((pos, pl)) AS first FROM (SELECT cluster, pos, unnest(ws) AS term, generate_subscripts(ws, 1) AS pl FROM m) GROUP BY cluster, term),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS r FROM t),
n AS (SELECT cluster, string_agg(term, '-' ORDER BY r) AS words FROM r WHERE r <= 3 GROUP BY cluster)
SELECT cluster, count(*) AS size, 'c' || cluster || '-' || coalesce(any_value(words), 'misc') AS name FROM m LEFT JOIN n USING (cluster) GROUP BY cluster""")
def cluster_label(spark, d):
    met = retrieve.beside(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), _t(spark, d, "documents"), "doc_id")
    return cluster.labels(met.select(F.col("label").alias("cluster"), F.col("source").alias("page"), F.col("text").alias("section"), F.col("doc_id").alias("pos")))


# ---------------------------------------------------------------- streams

def _events(spark, d):
    return stream.events(spark, d, "events.parquet")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_trace_tumbling(spark, d):
    out = stream.drain(stream.tumbling(_events(spark, d), "event_type"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_trace_dedup(spark, d):
    return stream.drain(stream.without_duplicates(_events(spark, d), "event_id", "400 days"), "append").agg(F.count(F.lit(1)).alias("n"))


@query("""o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session_window(spark, d):
    out = stream.drain(stream.sessions(_events(spark, d), "user_id"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, 's' || lpad((pos // 5)::VARCHAR, 3, '0') AS session, count(*) AS n, min(pos)::BIGINT AS first FROM n GROUP BY ALL""")
def stream_session_bucket(spark, d):
    """Sessions of five events of a user.  Within a file no order of arrival is known, so sizes and places are compared."""
    out = stream.drain(stream.bucketed(_events(spark, d), "user_id", "event_id"), "append")
    return out.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
