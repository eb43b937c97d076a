"""Topic clusters of embeddings: k-means, k chosen by the exact Euclidean silhouette, labels from member metadata."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import retrieve
from gleanery.operators import vectors as vectors_
from gleanery.session import table
from gleanery.sources import files

#: Words that say nothing about a topic.
STOPWORDS = (
    "the", "and", "for", "with", "not", "are", "you", "your", "this",
    "that", "from", "when", "set", "use", "only", "per", "into", "each",
)


def silhouettes(rows: DataFrame) -> DataFrame:
    """One row: the mean Euclidean silhouettes of (id, v, clusters), one for each of several clusterings of the same rows, over
    all pairs, in blocks of rows against all rows.

    Distances come from matrix products of tiles, once for all clusterings, and are added up by cluster within the tile.
    """
    names = [sorted(own) for own in rows.agg(*(F.collect_set(F.col("clusters")[i]) for i in range(len(rows.select("clusters").first()[0])))).first()]  # clusters, not rows
    other = rows.select(F.col("id").alias("query_id"), "v", "clusters")
    sums = retrieve.by_block(other, lambda block: vectors_.distance_sums(rows, block.withColumnRenamed("query_id", "id"), names), times=4)
    total = sum(map(len, names))
    # an id's sums of all blocks meet once
    added = sums.repartition("id").groupBy("id", "own").agg(*(F.sum(F.col(c)[i]).alias(f"{c}{i}") for i in range(total) for c in ("s", "n")))
    means = added.select("id", "own", F.array(*(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")) for i in range(total))).alias("d"))
    at, parts = 0, []
    for i, own in enumerate(names):
        mine = F.col("own")[i]
        others = F.array(*(F.when(mine != j, F.col("d")[j]) for j in range(at, at + len(own))))
        parts += [F.max(F.get("d", mine)).alias(f"a{i}"), F.min(F.array_min(others)).alias(f"b{i}")]
        at += len(own)
    per = means.groupBy("id").agg(*parts)
    value = lambda a, b: F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return per.agg(F.array(*(F.round(F.avg(value(F.col(f"a{i}"), F.col(f"b{i}"))), 6) for i in range(len(names)))).alias("silhouettes"))


def silhouette(rows: DataFrame) -> DataFrame:
    """One row: the mean Euclidean silhouette of (id, v, cluster) over all pairs."""
    if rows.isEmpty():
        return rows.agg(F.avg(F.lit(0.0)).alias("silhouette"))
    return silhouettes(rows.select("id", "v", F.array(F.col("cluster").cast("long")).alias("clusters"))).select(F.col("silhouettes")[0].alias("silhouette"))


def assign(vectors: DataFrame, most_k: int = 8, seed: int = 42, starts: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int, float]:
    """(rows with cluster, k, silhouette): smallest k wins ties; of several starts the cheapest counts."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")).cache()
    n = rows.count()
    if n < 4:
        raise ValueError(f"clustering takes four rows at least, not {n}")
    tried = range(2, min(most_k, n - 1) + 1)
    labelled = rows
    for k in tried:
        models = [KMeans(k=k, seed=seed + s, maxIter=20).fit(rows) for s in range(starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        labelled = best.transform(labelled).withColumnRenamed("prediction", f"_k{k}")
    # every k is judged in one pass over the pairs
    made = table(labelled.select("id", "v", F.array(*(F.col(f"_k{k}").cast("long") for k in tried)).alias("clusters")), "clusterings")
    rows.unpersist()
    scores = silhouettes(made).first()[0]
    score, k = max(zip(scores, tried, strict=True), key=lambda x: (x[0], -x[1]))
    return made.select("id", "v", F.col("clusters")[k - 2].cast("int").alias("cluster")), k, score


def write_back(collection: DataFrame, members: DataFrame, names: DataFrame, key: str = "chunk_uid") -> DataFrame:
    """A collection with cluster_id and cluster_label of its members (key, cluster) set, by way of a metadata update."""
    changes = members.join(names.select("cluster", "name"), "cluster").select(key, F.col("cluster").alias("cluster_id"), F.col("name").alias("cluster_label"))
    return files.update_metadata(collection, changes, key)


def labels(members: DataFrame) -> DataFrame:
    """cluster, size, name: the three commonest words of (cluster, page, section, pos), in order of appearance."""
    words = lambda c: F.filter(T.tokens_simple(F.col(c)), lambda w: F.length(w) > 3)
    stop = F.array(*map(F.lit, STOPWORDS))
    both = F.concat(words("page"), F.filter(words("section"), lambda w: ~F.array_contains(stop, w)))
    # first by numbers alone, which take a hash table: a word's count and the first member that has it
    terms = members.select("cluster", "pos", F.explode(both).alias("term")).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.count_if(F.col("pos").isNull()).alias("none"))
    terms = terms.select("cluster", "term", "n", F.when(F.col("none") == 0, F.col("low")).alias("first"))
    near = terms.withColumn("r", F.rank().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))).where("r <= 3")
    near = table(near.drop("r"), "common-words")
    # where words are as common and first in one member, their places in it decide
    c, t = F.col("cluster"), F.col("term")
    some = near.select(c.alias("c1"), F.col("first").alias("f1")).distinct()
    inside = members.join(F.broadcast(some), c.eqNullSafe(F.col("c1")) & F.col("pos").eqNullSafe(F.col("f1"))).select("cluster", F.col("pos").alias("first"), F.posexplode(both).alias("at", "term"))
    at = inside.groupBy(c.alias("c2"), F.col("first").alias("f2"), t.alias("t2")).agg(F.min("at").alias("at"))
    terms = near.join(at, c.eqNullSafe(F.col("c2")) & F.col("first").eqNullSafe(F.col("f2")) & (t == F.col("t2")))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first", "at"))
    named = terms.withColumn("r", r).where("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), "-").alias("words"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(named, "cluster", "left").select("cluster", "size", F.concat(F.lit("c"), F.col("cluster").cast("string"), F.lit("-"), F.coalesce("words", F.lit("misc"))).alias("name"))
