"""Streaming ingest: new events once, touched sessions recomputed, recovery state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from threadlake.operators.upkeep import first_arrivals
from threadlake.storage import exists, written


#: Folders that a table's events are dealt to by their id; a batch looks only into those of its own ids.
BUCKETS = 16


def _bucket() -> Column:
    return F.pmod(F.crc32(F.col("event_id").cast("binary")), F.lit(BUCKETS)).cast("int")


def read_table(spark: SparkSession, schema, table_path: str) -> DataFrame:
    """The events of a table that ingest() wrote."""
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(table_path).drop("bucket")


def ingest(events: DataFrame, table_path: str, checkpoint: str, on_touched: Callable[[DataFrame], None] | None = None) -> None:
    """Append the events of a stream to a Parquet table, each event_id once; runs until the input is read.

    Within a batch the first arrival stays; ids that the table has are dropped by an anti-join, so that a
    repeated batch changes nothing and no state grows in the stream. on_touched is then given the sessions of
    the batch, so that what is derived from them can be made anew.
    """
    spark, schema = events.sparkSession, events.schema

    def batch(df: DataFrame, _id: int) -> None:
        new = first_arrivals(df).withColumn("bucket", _bucket())
        if exists(spark, table_path):
            parts = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            known = spark.read.schema(StructType([StructField("event_id", StringType()), StructField("bucket", IntegerType())])).parquet(table_path)
            new = new.join(known.where(F.col("bucket").isin(parts)).select("event_id"), "event_id", "left_anti")
        new = written(new, "batch")
        new.write.mode("append").partitionBy("bucket").parquet(table_path)
        if on_touched is not None:
            on_touched(new.select("session_id").distinct())

    events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_state(events: DataFrame) -> DataFrame:
    """Running state of each session, for a stream in update mode: first and last seen, and how many events."""
    return events.groupBy("session_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("cwd", "seq").alias("cwd"), F.count(F.lit(1)).alias("event_count"))


def _pending(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending = state.exists and state.get[0]
    for pdf in batches:
        out = []
        for row in pdf.sort_values("seq").itertuples():
            if row.hook_event == "PostCompact":
                pending = True
            elif pending and row.tool_name == "pack":
                pending = False
            elif pending and row.hook_event in ("UserPromptSubmit", "SessionStart", "PostToolUse", "Stop"):
                out.append((key[0], row.event_id, "block" if row.hook_event == "Stop" else "directive"))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "action"])
    state.update((bool(pending),))


def recovery_actions(events: DataFrame) -> DataFrame:
    """What each event after a compaction asks for, until a context was packed: one bit of state for a session."""
    rows = events.select("session_id", "event_id", "seq", "hook_event", "tool_name")
    return rows.groupBy("session_id").applyInPandasWithState(_pending, "session_id string, event_id string, action string", "pending boolean", "append", GroupStateTimeout.NoTimeout)


def recovery_actions_batch(events: DataFrame, begins: str = "PostCompact") -> DataFrame:
    """The same on a whole table, as one window."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("hook_event") == begins, 1).when(F.col("tool_name") == "pack", 0)
    out = events.withColumn("pending", F.last(mark, ignorenulls=True).over(w)).where("pending = 1 and coalesce(tool_name, '') <> 'pack'")
    action = F.when(F.col("hook_event") == "Stop", "block").when(F.col("hook_event").isin("UserPromptSubmit", "SessionStart", "PostToolUse"), "directive")
    return out.select("session_id", "event_id", action.alias("action")).where("action is not null")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension of Spark's own: counts of hooks in windows of event time, with a watermark."""
    e = events.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return e.groupBy(F.window("at", every), "hook_event").count()


def open_stream(spark: SparkSession, schema, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
