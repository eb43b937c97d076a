"""Connected components of a link table, by large and small stars over DataFrames.

Each round points every node's larger neighbours, then its smaller ones, to its smallest neighbour; at the end each node
points to the smallest of its component.  Rounds are cut by tables in the shared folder; no link reaches the driver.  What
a node's links are joined to is a table as well, so that the links of a hub are split when they are skewed; tables of
finished rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node) for every node of a link but the components' smallest."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, state = common.table(e, "links"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.table(large, "links-large")
        down = common.table(large.groupBy("u").agg(F.min("v").alias("m")), "links-down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, common.table(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        common.done_with(old, low, large, down, shuffles=False)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not now.n or state == (now.n, now.x):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (now.n, now.x)
    raise RuntimeError(f"links have not settled in {most_rounds} rounds")
