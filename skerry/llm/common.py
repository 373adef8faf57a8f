"""Shared pieces of the training-data operators: materialised tables, size-checked joins, worker caches, byte views."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Joins broadcast a side of at most so many bytes, counted before; beyond it they shuffle.
BROADCAST_BYTES = 24 << 20

#: Functions that take Arrow batches work on slices of about so many bytes of text.
SLICE_BYTES = 1 << 18


#: Rows, and about how many bytes, of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(df: DataFrame) -> SparkSession:
    """The session of df, set to send texts to Python in small Arrow batches; settings that are smaller already stay.

    A batch is held whole by the JVM, outside its heap, and by the worker. The default of 10,000 rows is a whole partition of documents.
    """
    spark = df.sparkSession
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            held = int(spark.conf.get(key).rstrip("b"))
        except Exception:  # noqa: BLE001  a version of Spark without the setting
            continue
        if not 0 < held <= most:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where that is unset, one of our own in a local session, an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"skerry-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
        pass


#: A table that is known to have no more rows than this is written as few files, one for FILE_ROWS rows and FEW_FILES at most, however many tasks made it.
FEW_ROWS, FILE_ROWS, FEW_FILES = 300_000, 2_500, 12
#: Where the shared folder is a local path, Hadoop starts a process for the mode of every folder and file that it makes, in the driver and the executors. It makes
#: none for a checksum or a mark of success with these options; other stores don't heed the first two.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def materialise(df: DataFrame, name: str, rows: int | None = None, narrow: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    rows: a bound of its rows, where one is known. Few rows go to few files, since a file for each of many shuffle partitions
    costs more than the rows do, to write and to read. narrow: the bound holds for what these rows are made of as well, so few tasks make them.
    """
    spark = df.sparkSession
    if rows is not None and rows <= FEW_ROWS:
        files = min(FEW_FILES, 1 + rows // FILE_ROWS)
        df = df.coalesce(files) if narrow else df.repartition(files)
    path = f"{shared_dir(spark)}/skerry/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **PLAIN_FILES).parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/skerry/" in f:
            _delete(df.sparkSession, f)


def fits(df: DataFrame, bytes_per_row: int) -> bool:
    """Whether df's rows, which are counted, stay under BROADCAST_BYTES."""
    return df.count() * bytes_per_row <= BROADCAST_BYTES


def sized(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df, marked for broadcast only if it fits(); else Spark shuffles both sides."""
    return F.broadcast(df) if fits(df, bytes_per_row) else df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores put before them until none is among those taken, whatever their case."""
    held = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def worker_cache(key: Any, build: Callable[[], Any]) -> Any:
    """build() once in each Python worker process, whatever the number of tasks that run in it."""
    module = sys.modules.setdefault("_skerry_worker_cache", types.ModuleType("_skerry_worker_cache"))
    if key not in (held := module.__dict__.setdefault("held", {})):
        held[key] = build()
    return held[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty. offsets has one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column holds about limit bytes at most; one longer value is a slice of its own."""
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def inner_ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after another."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_key(column: str) -> list:
    """Two 64-bit hashes that name a text (null: empty); equal texts, equal keys."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
