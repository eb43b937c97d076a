"""Containment of short strings: a positional index of three-byte grams.

Every place of a text starts a gram (bytes of its UTF-8, padded with zeros at the end), so a string of three bytes or more is in a
text only if all its grams are there, at their distances; a shorter one starts a gram.  The rarest gram of a string gives the
candidates, the second rarest has to stand where it should, and only then texts are read and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import prepare, root, table

WIDTH = 3


def _codes(raw: np.ndarray) -> np.ndarray:
    """The gram that starts at each byte but for the last two, as a number."""
    x = raw.astype(np.int32)
    return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, gram, places (ascending) of every distinct gram of each text, a text at a time."""
    for b in batches:
        for i, text in enumerate(b.column("text")):
            raw = np.frombuffer((text.as_py() or "").encode() + b"\0\0", np.uint8)
            if len(raw) == 2:
                continue
            code = _codes(raw)
            order = np.argsort(code, kind="stable")
            first = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1])
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(order.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.full(len(first), i))), pa.array(code[order][first]), places], names=["id", "gram", "places"])


@dataclass(frozen=True)
class GramIndex:
    """grams: chunk_id, gram, places, sorted by gram; counts: gram, df."""

    grams: DataFrame
    counts: DataFrame

    @staticmethod
    def build(texts: DataFrame) -> GramIndex:
        """``texts``: chunk_id, text (as it is to be compared)."""
        spark = texts.sparkSession
        prepare(spark, root())
        kind = texts.schema["chunk_id"].dataType.simpleString()
        rows = texts.where("text is not null").select(F.col("chunk_id").alias("id"), "text").mapInArrow(_listed, f"id {kind}, gram int, places array<int>")
        rows = rows.withColumnRenamed("id", "chunk_id").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram", "chunk_id").sortWithinPartitions("gram")
        grams = table(rows, "grams")
        return GramIndex(grams, table(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram-counts"))

    def candidates(self, strings: DataFrame) -> DataFrame:
        """query_id, chunk_id where a text may contain its query's ``string``; never misses one.  ``strings`` is a block."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for q, s in zip(b.column("query_id").to_pylist(), b.column("string").to_pylist(), strict=True):
                    raw = np.frombuffer(s.encode(), np.uint8)
                    if len(raw) >= WIDTH:
                        out += [(q, int(g), at, 0) for at, g in enumerate(_codes(raw))]
                    else:
                        out.append((q, int.from_bytes(raw.tobytes(), "big"), 0, WIDTH - len(raw)))
                cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                kinds = (b.schema.field("query_id").type, pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query_id", "gram", "at", "short"])

        kind = strings.schema["query_id"].dataType.simpleString()
        own = table(strings.select("query_id", "string").mapInArrow(split, f"query_id {kind}, gram int, at int, short int"), "string-grams")
        # a gram that no text has: nothing contains the string
        sized = own.where("short = 0").join(self.counts, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        rare = sized.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "gram", "at"))).where("r <= 2")
        ends = rare.groupBy("query_id").agg(F.min(F.struct("r", "gram", "at")).alias("a"), F.max(F.struct("r", "gram", "at")).alias("b"))
        ends = F.broadcast(ends.select("query_id", F.col("a.gram").alias("gram"), F.col("a.at").alias("at"), F.col("b.gram").alias("gram2"), F.col("b.at").alias("at2")))  # a row for each query
        first = self.grams.join(ends, "gram").select("query_id", "chunk_id", "gram2", "at2", F.transform("places", lambda p: p - F.col("at")).alias("starts"))
        second = self.grams.select(F.col("gram").alias("gram2"), "chunk_id", F.col("places").alias("places2"))
        both = first.join(second, ["gram2", "chunk_id"]).where(F.arrays_overlap("starts", F.transform("places2", lambda p: p - F.col("at2"))))
        out = both.select("query_id", "chunk_id")
        for n in (1, 2):  # bytes that are missing for a gram
            some = F.broadcast(own.where(F.col("short") == n).select("query_id", F.col("gram").alias("start")))
            out = out.unionByName(self.grams.withColumn("start", F.shiftright("gram", 8 * n)).join(some, "start").select("query_id", "chunk_id").distinct())
        return out
