"""What the operators of this package share: shared-folder tables, Arrow text buffers and vectorised word hashes.

Words are runs of bytes outside a separator set.  A word's hash is a polynomial over randomised bytes, finished with
a 64-bit mixer; it does not depend on where the word stands, so texts are hashed in slices of bounded memory.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_tables: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps Arrow batches of whole texts small.

    On a cluster the package has to be on the executors' path as well (``--py-files`` or an image).
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where a local session names none, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _tables.append((spark, folder))
    return folder


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage, survives lost executors.

    The tables go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleanery_path = path
    return out


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, beside which no name of an operator can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def beside(df: DataFrame, names: list[str], results: dict[str, Column]) -> DataFrame:
    """The columns ``names`` of the struct ``row`` and the results; a column of a result's name gives way to it."""
    return df.select(*(F.col(f"row.`{c}`") for c in names if c not in results), *(v.alias(c) for c, v in results.items()))


def done_with(*tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes tables that only fed others which are written by now, and lets shuffle files go."""
    spark = tables[0].sparkSession
    for t in tables:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._gleanery_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if shuffles:
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished phases before the next one writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _drop_tables() -> None:
    for spark, path in _tables:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, and its folder is the cluster's to clean
            pass


def frugal(run: Callable) -> Callable:
    """``run`` over Arrow batches; afterwards the worker gives freed memory back, as it lives on for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


# ---------------------------------------------------------------- texts as bytes

_rng = np.random.default_rng(20240131)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.multiply.accumulate(np.full(1 << 12, _BASE, np.uint64))
_SLICE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of the two word definitions in use: white space only, and all ASCII but digits and letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: The second one before A-Z are lower-cased.
NON_WORD_CASED = NON_WORD[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``raw``, and the index of each text's first word (one more at the end)."""
    inside = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.empty(len(raw), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """One uint64 for each word; equal words (after ``fold``, a byte map) have equal hashes."""
    tab = _BYTES if fold is None else _BYTES[fold]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SLICE)))
        ln = ends[i:j] - starts[i:j]
        first = np.cumsum(ln) - ln
        at = np.arange(int(ln.sum())) - np.repeat(first, ln)
        src = raw[at + np.repeat(starts[i:j], ln)]
        if int(ln.max()) > len(_POW):  # a "word" of several KB: its blocks differ by a further factor
            factor = _POW[at % len(_POW)] * mix((at // len(_POW)).astype(np.uint64) + np.uint64(1))
        else:
            factor = _POW[at]
        out[i:j] = mix(np.add.reduceat(tab[src] * factor, first) + ln.astype(np.uint64))
        i = j
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a run that crosses into the next text is the caller's to mask."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = x * _BASE + h[j : j + n]
    return mix(x)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def binary_list(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def long_list(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list<int64> column from all values and the length of each list."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
