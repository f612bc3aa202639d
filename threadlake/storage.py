"""Tables in the folder that all executors share: lineage ends there, and work is done once."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times their width stay under this.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch, so that one of long texts fits in a worker, and what waits for it in an executor.
ARROW_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new folder of the cluster's shared one; only a local session may go without that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="threadlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = spark.conf.get("threadlake.engine", None)
    if not own or not own.startswith(base.rstrip("/")):
        own = f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"
        spark.conf.set("threadlake.engine", own)
    return f"{own}/{uuid.uuid4().hex}"


def put(df: DataFrame, path: str, *by: str, mode: str = "errorifexists", **options: str | int) -> None:
    """Write df as a table, in folders `by` columns. What was shuffled for it leaves the disk as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).options(compression="zstd", **options).partitionBy(*by).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    for paths in getattr(_open, "paths", [])[-1:]:
        paths.append(path)
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread has written() inside is deleted at the end; no DataFrame of it may be read after that."""
    _open.paths = [*getattr(_open, "paths", []), []]
    try:
        yield
    finally:
        for path in _open.paths.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ARROW_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df with one row for each key, df itself if no key comes twice: then keys alone are shuffled, not whole rows. df is best a written one."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return df if twice.isEmpty() else df.dropDuplicates(list(keys))


def sized(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """A written df with a broadcast hint if it is small, else unchanged."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def file_state(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of a table's files: equal as long as nothing was written to it."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def clear(spark: SparkSession) -> None:
    """Delete all that this session's queries wrote to the shared folder; results that are not stored elsewhere go with it."""
    own = spark.conf.get("threadlake.engine", None)
    if own:
        delete(spark, own)
        spark.conf.unset("threadlake.engine")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder of the table is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
