"""Shared helpers of the training-data operators: batching, staging, text arrays.

Every operator selects the columns it needs first, so extra or clashing column
names in its input never reach its plan.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word: U+0020 and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, at: str) -> str:
    """The path with scheme and authority, by the default file system where it names none."""
    path, files = _path(spark, at)
    return files.makeQualified(path).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset on a local master (tests)
    a new temporary folder, set on the session's context. Scheme and authority are those of the default file system
    where the setting names none, so that readers, writers and tasks all mean one folder."""
    at, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not at:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        at = context.getCheckpointDir()
    return qualified(spark, at)


def remove_at_exit(spark: SparkSession, at: str) -> None:
    """A folder that exists goes with all it holds when the driver's JVM ends."""
    path, files = _path(spark, at)
    files.deleteOnExit(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder of its own in the shared one, removed at the end."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _path(spark, at)
    files.mkdirs(path)
    remove_at_exit(spark, at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    remove_at_exit(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def by_place(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """docs with columns named c0, c1, ... by place, these names, and their types as a schema: a
    function over all columns then meets neither clashing names nor names with dots."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))


def release() -> None:
    """Give memory back at a task's end: Python workers live on and serve other operators.
    The C library keeps what arrays and texts have freed, unless it is asked to trim."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)) is not None:
        trim(0)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def parts(df: DataFrame, least: int = 8) -> int:
    """Partitions for a shuffle by key: the session's setting, at least `least`."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(batches, column: str = "text", limit: int = 4 << 20):
    """Cut Arrow batches into runs of rows whose `column` holds about `limit` bytes at
    most (one longer value makes a run of its own), so memory follows bytes, not rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.names.index(column))
        ends = np.cumsum(np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in values), np.int64, len(values)))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Values as UTF-8 bytes; null is empty."""
    values = batch.column(batch.schema.names.index(column))
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in values]


def strings_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Values as str; null is empty."""
    return [x or "" for x in batch.column(batch.schema.names.index(column)).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)
