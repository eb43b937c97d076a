"""The trace log as a stream: tumbling counts, duplicates within a watermark, sessions by gaps or of a fixed
size, and answers for micro-batches.

Times without a zone are read as UTC.  Ranking needs whole groups, so retrieval on a stream runs as the batch plan on
each micro-batch of questions against static tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.session import new_path


def events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """A file stream of rows with ``ts``; the schema comes from the files that are there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def without_duplicates(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    counted = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Counter(StatefulProcessor):
    """Numbers a key's rows as they come; what it keeps is how many came before."""

    def __init__(self, key: str, size: int):
        self.key, self.size = key, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:
            at = n + np.arange(len(part), dtype=np.int64)
            n += len(part)
            yield pd.DataFrame({self.key: part[self.key], "id": part["id"], "pos": at, "session": [f"s{x:03d}" for x in at // self.size]})
        self.seen.update((n,))

    def close(self) -> None:
        pass


def bucketed(stream: DataFrame, key: str, id_col: str, size: int = 5) -> DataFrame:
    """key, id, pos (from 0) and session of every row: a key's rows in the order in which they come, ``size`` to a session.

    The state of a key is one number and its rows pass in batches, so a hot key needs no more memory than others; a query
    that starts again from its checkpoint counts on.  Null is a key of its own.  Rows that come twice count twice: put
    ``without_duplicates`` before.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.select(key, F.col(id_col).alias("id"))
    return rows.groupBy(key).transformWithStateInPandas(_Counter(key, size), f"`{key}` {kinds[key]}, id {kinds[id_col]}, pos long, session string", "Append", "None")


def for_each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that appends ``plan`` of every micro-batch to Parquet; a batch that comes again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All rows of a bounded stream, through Parquet in the shared folder.

    In mode ``complete`` each batch holds the whole result so far and the last one counts; in ``append`` all of them do.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-check")

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path if mode == "complete" else f"{path}/batch=*")
