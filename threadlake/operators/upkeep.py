"""Dedup, reconciliation, retention, segments and cross-shape matching of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.text import utf8_prefix
from threadlake.operators.ordering import ordered
from threadlake.storage import sized, written


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row for each event_id: the first to arrive."""
    struct = F.struct("seq", *[c for c in events.columns if c != "seq"])
    return events.groupBy("event_id").agg(F.min_by(struct, "seq").alias("r")).select("r.*").select(*events.columns)


def stale(indexed: DataFrame, log: DataFrame) -> DataFrame:
    """Indexed events that the log no longer has."""
    return indexed.join(log.select("event_id"), "event_id", "left_anti")


def changed(indexed: DataFrame, log: DataFrame) -> DataFrame:
    """Events whose text differs between index and log."""
    new = log.select("event_id", F.col("text").alias("log_text"))
    return indexed.join(new, "event_id").where(~F.col("text").eqNullSafe(F.col("log_text"))).select("event_id")


def segments(events: DataFrame, cap: int) -> DataFrame:
    """The segment of each event of a session's log: a running sum of bytes cut at the cap."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    rows = ordered(events.select("session_id", "event_id", "seq", size.alias("size")), "session_id", ["seq"], sums={"before": "size"})
    return rows.select("session_id", "event_id", F.floor(F.col("before") / cap).alias("segment"))


def log_segments(events: DataFrame, cap: int) -> DataFrame:
    """(event_id, segment, byte_offset) of each event in the whole log, in the order of arrival: a segment is closed by the event that passes its multiple of the cap.

    A segment begins where the running bytes pass a multiple of the cap; one range of arrivals is one task.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    rows = ordered(events.select("event_id", "seq", size.alias("size")).withColumn("log", F.lit(0)), "log", ["seq"], sums={"before": "size"})
    rows = rows.select("event_id", F.floor(F.col("before") / cap).alias("segment"), "before", "size")
    first = rows.groupBy("segment").agg(F.min("before").alias("start"))
    return rows.join(sized(written(first, "first")), "segment").select("event_id", "segment", (F.col("before") - F.col("start")).alias("byte_offset"))


def expire(events: DataFrame, placed: DataFrame, before: str) -> DataFrame:
    """Events that stay when closed segments whose last event is older than `before` go; the last segment is open."""
    rows = events.join(placed, ["session_id", "event_id"])
    ends = rows.groupBy("session_id", "segment").agg(F.max("ts").alias("end"))
    newest = ends.groupBy("session_id").agg(F.max("segment").alias("newest"))
    gone = ends.join(newest, "session_id").where((F.col("segment") < F.col("newest")) & (F.col("end") < before)).select("session_id", "segment")
    return rows.join(gone, ["session_id", "segment"], "left_anti").drop("segment")


def cross_shape(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows without the second of each pair that both record shapes report.

    shape is event or item; a running balance of the two before a row tells whether the other shape is ahead.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("shape") == "event", 1).otherwise(-1)
    balance = F.coalesce(F.sum(step).over(w), F.lit(0))
    out = rows.withColumn("__balance", balance)
    repeat = ((F.col("shape") == "event") & (F.col("__balance") < 0)) | ((F.col("shape") == "item") & (F.col("__balance") > 0))
    return out.where(~repeat).drop("__balance")


def scan_budget(blobs: DataFrame, budget: int, key: str | None = "session_id") -> DataFrame:
    """The newest blobs whose predecessors' bytes stay within the budget, in each session, or in all (key None)."""
    rows = blobs.select("event_id", "ts", "seq", F.octet_length("text").alias("size"), *([key] if key else [F.lit(0).alias("__log")]))
    rows = ordered(rows.withColumnRenamed("__log", "log"), key or "log", [F.desc("ts"), F.desc("seq")], sums={"before": "size"})
    kept = rows.where(F.col("before") + F.col("size") <= budget).select("event_id")
    return blobs.join(kept, "event_id", "left_semi")


#: What a search through overflow reads at most: references, and bytes of their contents (fixed values).
MOST_REFERENCES, MOST_BYTES = 4096, 64 << 20


def overflow_search(blobs: DataFrame, needle: str, limit: int = 10, cwd: str | None = None, repo_root: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The newest stored contents (event_id, ts, seq, cwd, repo_root, text) that have a needle: place, line and surroundings, newest first.

    The newest MOST_REFERENCES of the chosen folder are looked at, while the bytes before each stay below
    most_bytes; of the one that passes the budget only what is left of it is searched.
    """
    for name, value in (("cwd", cwd), ("repo_root", repo_root)):
        blobs = blobs if value is None else blobs.where(F.col(name) == value)
    newest = [F.desc("ts"), F.desc("seq")]
    some = blobs.orderBy(*newest).limit(MOST_REFERENCES).select("event_id", "ts", "seq", F.octet_length("text").alias("size")).withColumn("log", F.lit(0))
    some = ordered(some, "log", newest, "place", {"before": "size"}).where(F.col("before") < most_bytes).select("event_id", "place", "before")
    rows = blobs.join(sized(written(some, "some")), "event_id").withColumn("text", utf8_prefix(F.col("text"), F.lit(most_bytes) - F.col("before")))
    found = overflow_matches(rows, needle, "place")
    return found.orderBy("place").limit(limit)


def overflow_matches(blobs: DataFrame, needle: str, *more: str) -> DataFrame:
    """First place of a needle, whatever its case: byte offset, line and what stands around it."""
    at = F.locate(needle.lower(), F.lower("text"))
    head = F.substring(F.col("text"), F.lit(1), F.col("at") - 1)
    return blobs.withColumn("at", at).where("at > 0").select(
        "event_id", *more,
        F.octet_length(head).cast("long").alias("byte_offset"),
        F.size(F.split(head, "\n")).cast("long").alias("line_no"),
        F.substring(F.col("text"), F.greatest(F.col("at") - 120, F.lit(1)), F.lit(120 + len(needle)) + 120).alias("snippet"),
    )
