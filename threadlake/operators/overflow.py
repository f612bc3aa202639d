"""Payloads that are stored apart, one file each, named by their hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.storage import written

#: Payloads above this are stored apart; files above that are not read (fixed values).
INLINE_BYTES, MOST_BYTES = 512 * 1024, 16 << 20


def split_off(events: DataFrame, folder: str, inline: int = INLINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(events with references in place of large payloads, blobs (sha256, payload) to be written)."""
    large = F.octet_length("payload") > inline
    sha = F.sha2("payload", 256)
    size = F.octet_length("payload").cast("long")
    ref = F.struct(F.concat(F.lit(folder.rstrip("/") + "/"), sha, F.lit(".json")).alias("path"), sha.alias("sha256"), F.coalesce("original_bytes", size).alias("byte_count"), size.alias("sanitized_byte_count"))
    blobs = events.where(large).select(sha.alias("sha256"), "payload").dropDuplicates(["sha256"])
    return events.withColumn("payload", F.when(large, F.to_json(F.struct(ref.alias("overflow_ref")))).otherwise(F.col("payload"))), blobs


def write(blobs: DataFrame, path: str) -> None:
    """Blobs as a table beside the events, dealt to folders by the start of their hash."""
    blobs.withColumn("part", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """refs with their content; what does not match its hash and size, or is too large, has none."""
    blobs = spark.read.schema("sha256 string, payload string, part string").parquet(path).select("sha256", "payload")
    rows = refs.join(blobs, "sha256", "left")
    size = F.octet_length("payload")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (size == F.col("sanitized_byte_count")) & (size <= MOST_BYTES)
    return rows.withColumn("content", F.when(sound, F.col("payload"))).drop("payload")


def page(content: Column, offset: int = 0, most: int = 64 * 1024) -> Column:
    """The whole characters of a text that begin from a byte offset on and end within `most` bytes, and the next offset."""
    data = content.cast("binary")
    follows = lambda c, i: F.coalesce(F.hex(F.substring(c, i + 1, F.lit(1))).rlike("^[89AB]"), F.lit(False))  # noqa: E731  a byte within a character
    back = lambda i: F.when(~follows(data, i), i).when(~follows(data, i - 1), i - 1).when(~follows(data, i - 2), i - 2).otherwise(i - 3)
    on = lambda i: F.when(~follows(data, i), i).when(~follows(data, i + 1), i + 1).when(~follows(data, i + 2), i + 2).otherwise(i + 3)
    size = F.octet_length(content)
    start = on(F.least(F.lit(offset), size))
    end = back(F.least(start + most, size))
    return F.struct(start.cast("long").alias("offset"), F.substring(data, start + 1, end - start).cast("string").alias("content"), F.when(end < size, end.cast("long")).alias("next_offset"))


def orphans(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """Blobs that no event refers to any more."""
    return blobs.join(refs.select("sha256").distinct(), "sha256", "left_anti")


def expire(spark: SparkSession, path: str, refs: DataFrame) -> int:
    """Delete the stored blobs that none of refs (sha256) name; only folders that have such blobs are written anew. Returns how many went.

    Whoever reads a folder at that moment may find it half replaced, so this is for times without readers.
    """
    blobs = spark.read.schema("sha256 string, payload string, part string").parquet(path)
    gone = written(orphans(blobs.select("sha256", "part"), refs), "orphans")
    parts = [r[0] for r in gone.select("part").distinct().collect()]  # 256 at most
    if not parts:
        return 0
    some = blobs.where(F.col("part").isin(parts))
    stay = written(some.join(gone.select("sha256"), "sha256", "left_anti").select("sha256", "payload", "part"), "stay")
    stay.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for part in set(parts) - {r[0] for r in stay.select("part").distinct().collect()}:
        at = Path(f"{path}/part={part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone.count()
