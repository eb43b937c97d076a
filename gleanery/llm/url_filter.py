"""URL filters: host and path-prefix rules, joined to URLs by a sort-merge sweep over reversed-host keys.

A host's key is its labels in reverse, each closed by a separator: ``m.example.net`` becomes ``net.example.m.``.  A rule
for a host and all its subdomains then is an interval of keys, those that start with the rule's key, and the intervals
nest.  Each rule host carries its stack: itself and the rule hosts that enclose it.  URLs and rule hosts are sorted
together by key; at a URL, the last rule host before it has every rule that can still be open in its stack, and those
whose key the URL's key starts with are the active ones.  Of their rules, the longest whose path starts the URL's path
wins.

The sweep runs by site (the last two labels of a host) and slice.  A site has one slice, unless it holds more than its
share of all URLs: then its URLs are dealt over several, and its rules copied to these; fewer sites than ``slices`` can be
that large, so their list is broadcast.  Rules of a top label alone, which cover many sites, open each site they cover.
Rules of other sites are never copied.  DataFrame functions only.

Results in special cases: a null URL counts as empty; without ``://`` host and path are empty and no rule fits; repeated
rows are judged each; of two rules of the same host and path, block wins; an empty rule list leaves every URL to the
method's own verdict, ``allow`` unless the URL has no host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\u0001"

#: (action, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row for each rule host: its key, and the rules of all hosts that enclose it as an array."""
    rules = rules.select("action", F.col("host").alias("rhost"), "path").where("rhost is not null and path is not null")
    rules = rules.groupBy("rhost", "path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    nodes = rules.groupBy("rhost").agg(F.collect_list(F.struct("path", "action")).alias("own"))
    labels = F.split("rhost", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = nodes.select(F.col("rhost").alias("node"), F.explode(suffixes).alias("rhost"))
    open_rules = up.join(nodes, "rhost").select("node", F.explode("own").alias("r"), "rhost")
    rule = F.struct(
        (F.length("rhost") + F.length("r.path")).alias("len"), host_key(F.col("rhost")).alias("key"),
        F.col("r.path").alias("path"), F.col("r.action").alias("action"), F.concat("rhost", "r.path").alias("name"),
    )
    return open_rules.groupBy("node").agg(F.sort_array(F.collect_list(rule), asc=False).alias("stack")).select(host_key(F.col("node")).alias("key"), "stack")


def site_of(key: Column) -> Column:
    return F.substring_index(key, SEP, 2)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", slices: int | None = None) -> DataFrame:
    """Columns page_id, host, path, rule, verdict for every row of ``pages``; rules have action, host, path."""
    spark = pages.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("site", site_of(F.col("key")))
    sites = common.table(urls.groupBy("site").agg(F.count(F.lit(1)).alias("n")), "url-sites")
    total = sites.agg(F.sum("n")).first()[0] or 0
    # less than ``slices`` sites have more than a ``slices``-th of all URLs
    large = F.broadcast(sites.where(F.col("n") * slices > total).select("site", F.ceil(F.col("n") * slices / max(1, total)).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    urls = urls.join(large, "site", "left").withColumn("slice", F.pmod(F.xxhash64("page_id", "host", "path"), copies).cast("int")).drop("copies")
    nodes = rule_stacks(rules)
    covers = nodes.where(F.instr("key", SEP) == F.length("key")).select(F.substring_index("key", SEP, 1).alias("top"), "stack")
    opened = sites.select("site", F.substring_index("site", SEP, 1).alias("top")).join(covers, "top").select(F.col("site").alias("key"), "stack", "site")
    starts = nodes.withColumn("site", site_of(F.col("key"))).unionByName(opened)
    starts = starts.join(large, "site", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    events = urls.withColumn("is_url", F.lit(1)).unionByName(starts.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("site", "slice").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]))
    judged = swept.withColumn("won", F.get(fits, F.lit(0)))
    own = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("won.name").alias("rule"), F.coalesce(F.col("won.action"), own).alias("verdict")
    )


def rules_frame(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [f"('{a}', '{h}', '{p}')" for a, h, p in rules]
    return spark.sql(f"select * from values {', '.join(rows)} as t(action, host, path)")


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, CASE WHEN p.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
