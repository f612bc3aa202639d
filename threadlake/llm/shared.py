"""Helpers that several operators share: scratch tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times their width stay under this.
BROADCAST_BYTES = 32 << 20

#: Rows and bytes that one Arrow batch to a Python worker holds at most.
ARROW_ROWS = 10_000
ARROW_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the session's own part of the cluster's shared folder.

    Only a local session may go without a shared folder: elsewhere executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="threadlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = spark.conf.get("threadlake.scratch", None)
    if not own or not own.startswith(base.rstrip("/")):
        own = f"{base.rstrip('/')}/threadlake-{uuid.uuid4().hex}"
        spark.conf.set("threadlake.scratch", own)
    return f"{own}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder; results not yet written elsewhere go with it."""
    own = spark.conf.get("threadlake.scratch", None)
    if own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset("threadlake.scratch")


def save(df: DataFrame, name: str = "t", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, work is done once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that save() has written; nothing may read it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def first_ids(rows: DataFrame, k: int, per_list: int = 4096, fan_in: int = 256) -> DataFrame:
    """(key, ids) of rows (key, id): the k smallest distinct ids of each key, in order.

    Ids meet in salted parts first and parts meet level by level, so that no list holds more than about
    per_list or fan_in * k ids, however many rows a key has.
    """
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)
    parts = blocks_for(rows.count(), per_list)
    lists = rows.groupBy("key", salt(F.col("id"), parts).alias("part")).agg(least(F.collect_set("id")).alias("ids"))
    while parts > 1:
        parts = blocks_for(parts, fan_in)
        lists = lists.groupBy("key", (F.col("part") % parts).cast("int").alias("part")).agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    return lists.select("key", "ids")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, so that a batch of very long texts fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def sized(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows' bytes prove it small, else unchanged.

    row_bytes is every row's width, or a column that measures each. df should be a written table.
    """
    total = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def text_or_empty(c: str | Column = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def salt(key: Column, n: int) -> Column:
    """An even number from 0 to n - 1 that depends on key only."""
    return F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(n)).cast("int")


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of per_block rows hold that many rows."""
    return max(1, -(-rows // per_block))
