"""Queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clustering, decontaminate, jaccard_join, license_scan, packing, quality, resample, secret_scan, shard, substring_dedup, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat_format.windows(chat_format.with_planted(_table(spark, sf_dir, "conversations")))
    return chat_format.read_back(made)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.balanced_shards(_table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, _table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", *quality.RESULTS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.judge(decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark")))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_cut")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("measured")


def queries() -> dict:
    own = (op1_license_scan, op2_url_filter, op3_chat_format, op4_sharding, op5_jaccard_join, op6_substring_dedup, op7_topk_search, op8_quality, op9_decontamination, op10_packing, op11_resample, op12_secret_scan, op13_clustering)
    return {f.__name__: f for f in own}


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s), t AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
d AS MATERIALIZED (SELECT g, count(*) AS c FROM t GROUP BY g),
p AS MATERIALIZED (  -- the rarest shingles: two sets that link share one
  SELECT doc_id, g FROM (SELECT t.doc_id, t.g, n.n, row_number() OVER (PARTITION BY t.doc_id ORDER BY d.c, t.g) AS k FROM t JOIN d ON t.g = d.g JOIN n ON t.doc_id = n.doc_id)
  WHERE k <= n - ceil(n * 0.9) + 2
), c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
o AS (SELECT a, b, count(*) AS i FROM c JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b AND x.g = y.g GROUP BY a, b),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT v.b, r.root FROM r JOIN both_ways v ON v.a = r.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(root) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""

SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS t FROM w WHERE len(ws) >= 13
), f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f ON g.t = f.t AND f.first < g.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
         ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]), ' ') END) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k:k + least(len(ws), 13) - 1], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS k FROM b WHERE len(ws) > 0)
), len_ AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN len_ ON len(ws) >= n),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN win ON win.n = p.n AND win.t = array_to_string(ws[i:i + p.n - 1], ' ')),
pos AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS span FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h)),
hit AS (SELECT doc_id, sum(n)::BIGINT AS n_hit, coalesce(sum(n) FILTER (WHERE n >= 13), 0)::BIGINT AS n_long FROM (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id, span) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       CASE WHEN n_hit IS NULL THEN 0 WHEN 20 * n_hit >= len(ws) THEN len(ws) ELSE n_long END::BIGINT AS n_cut
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op2_url_filter": url_filter.ORACLE,
        "op3_chat_format": chat_format.ORACLE,
        "op5_jaccard_join": JACCARD_SQL,
        "op6_substring_dedup": SUBSTRING_SQL,
        "op7_topk_search": topk.ORACLE,
        "op9_decontamination": DECONTAMINATION_SQL,
        "op11_resample": resample.ORACLE,
        "op13_clustering": clustering.ORACLE,
    }
