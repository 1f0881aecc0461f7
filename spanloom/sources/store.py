"""Tables in the folder that driver and executors share, and numbered generations of several tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, at: str) -> str:
    """The path with scheme and authority, by the default file system where it names none."""
    path, files = _path(spark, at)
    return files.makeQualified(path).toString()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it a new temporary folder, set on the session's context."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return qualified(spark, at).rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return qualified(spark, context.getCheckpointDir()).rstrip("/")


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
    """Cut the lineage: write df in the shared folder and read it again."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    remove_at_exit(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, at: str) -> bool:
    path, files = _path(spark, at)
    return files.exists(path)


def put(spark: SparkSession, at: str, text: str) -> bool:
    """Write a small file whole and under its final name at once; False if the name is taken."""
    temporary, files = _path(spark, f"{at}.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    final = _path(spark, at)[0]
    if files.exists(final) or not files.rename(temporary, final):
        files.delete(temporary, False)
        return False
    return True


def names(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder, sorted; none where it is missing."""
    path, files = _path(spark, at)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
