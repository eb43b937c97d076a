"""Sharding: contiguous shards of equal bytes, cut on global prefix sums of row sizes.

Rows are ordered by (md5 of the text, doc_id) with a range partitioning, so equal texts stand next to each other and a
large group of copies is still dealt over many partitions (doc_id is part of the key).  Only ids, sizes and hashes
move, never texts.  Each partition's total gives its base; a row's shard is ``bytes before it * shards // all bytes``,
and its slot counts the rows of its shard before it.  The driver sees one row for each partition (and shard in it).

Results in special cases: a null text has size 16 and checksum 0; a null doc_id sorts before others; repeated rows each
get their own slot; with all sizes zero (impossible here: every row counts 16) or an empty table the result is empty.
Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROW_BYTES = 16


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, size, text_crc32, shard, slot; shards differ from each other by one row's bytes at most."""
    spark = docs.sparkSession
    common.prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        row_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("ord"),
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = common.table(
        rows.repartitionByRange(parts, "ord", "doc_id").sortWithinPartitions("ord", "doc_id").withColumn("part", F.spark_partition_id()),
        "shard-rows",
    )
    # a partition's rows are one run of the order; its place in the file may change, so the order is part of each pass
    totals = sorted((r.part, r.b) for r in ordered.groupBy("part").agg(F.sum("size").alias("b")).collect())
    whole = sum(b for _, b in totals)
    base, before = {}, 0
    for part, b in totals:
        base[part] = before
        before += b

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            size = batch.column("size").to_numpy(zero_copy_only=False)
            cum = np.empty(len(size), np.int64)
            for p in np.unique(part):
                own = part == p
                c = np.cumsum(size[own])
                cum[own] = c - size[own] + at.get(int(p), base[int(p)])
                at[int(p)] = int(at.get(int(p), base[int(p)]) + c[-1])
            shard = np.array([min(shards - 1, int(x) * shards // whole) for x in cum], np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("part"), pa.array(shard), pa.array(cum)],
                names=["doc_id", "size", "text_crc32", "part", "shard", "cum"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    by_part = ordered.repartition(parts, "part").sortWithinPartitions("part", "ord", "doc_id")
    placed = common.table(by_part.mapInArrow(common.frugal(place), f"doc_id {kind}, size long, text_crc32 long, part int, shard int, cum long"), "shard-placed")
    counts = sorted((r.shard, r.part, r["count"]) for r in placed.groupBy("shard", "part").count().collect())
    slot_base, before, last = {}, 0, None
    for shard, part, n in counts:
        before = 0 if shard != last else before
        slot_base[part, shard] = before
        before, last = before + n, shard

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, int], int] = {}
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            slot = np.empty(len(part), np.int64)
            both = part * shards + shard
            for x in np.unique(both):
                own, key = both == x, (int(x) // shards, int(x) % shards)
                start = at.get(key, slot_base[key])
                slot[own] = start + np.arange(own.sum())
                at[key] = int(start + own.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("shard"), pa.array(slot)],
                names=["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    in_order = placed.repartition(parts, "part").sortWithinPartitions("part", "cum", "doc_id")
    return in_order.mapInArrow(common.frugal(number), f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
