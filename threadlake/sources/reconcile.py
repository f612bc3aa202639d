"""A log held against what was read of it before: what came since, what changed, and where each event stands."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.store import Store
from threadlake.sources import log
from threadlake.storage import exists, sized, written

#: Folders that places are dealt to by event, and up to how many segments a look-up names in its read.
BUCKETS, NAMED = 64, 256
_FILES = "segment string, size long, modified timestamp, lines long, malformed long, end long, sum_a decimal(38,0), sum_b decimal(38,0), since long"
_PLACES = "event_id string, session_id string, segment string, byte_offset long, length long, sha256 string, version long, bucket int"


def _digest() -> list[Column]:
    """What is known of lines and where they stand: their count and end, and two sums of 60 bits of each one's hash."""
    sha = F.sha2(F.concat_ws(":", "byte_offset", "line"), 256)
    sums = [F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)")).alias(n) for n, at in (("sum_a", 1), ("sum_b", 16))]
    return [F.count(F.lit(1)).alias("lines"), F.max(F.col("byte_offset") + F.octet_length("line") + 1).alias("end"), *sums]


@dataclass
class Difference:
    """What to do so that a store has what the log has.

    how: "same" (nothing came), "tail" (only new lines and segments were read) or "difference" (a segment
    changed or went). events are to be brought in (columns of read_log, byte_offset); gone (event_id,
    session_id) are to be forgotten first. While any line of the log is malformed nothing is forgotten:
    blocked says that something would have been.
    """

    how: str
    statuses: DataFrame
    events: DataFrame
    gone: DataFrame
    malformed: int
    blocked: bool
    version: int


class LogState:
    """What was read of a log, in a folder: its segments, and the place of each event by its id.

    A segment of the same size and time is not read again. Of the others lines get their offsets; if those that
    stood there before are the same by count, end and hash, the segment was only appended to, or only touched.
    A version counts from its commit on, which comes after a store has what it says; until then a difference is
    found again, and what an unfinished version wrote is passed over and written anew.
    An event that stands at several places is the first one's, by segment and offset. A file without bytes is
    no segment yet, and an empty log a version without segments; blank lines are no lines.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = f"{self.path}/versions"
        done = spark.read.schema("version long").parquet(at).agg(F.max("version")).first()[0] if exists(spark, at) else None
        self.version = -1 if done is None else done

    def files(self) -> DataFrame:
        """The segments of the last version; since is the version from which on a segment's places count."""
        if self.version < 0:
            return self.spark.createDataFrame([], _FILES)
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/files/version={self.version}")

    def places(self, buckets: list[int] | None = None) -> DataFrame:
        """Where events stand (event_id, session_id, segment, byte_offset, length, sha256); those of some buckets are read alone."""
        if self.version < 0:
            return self.spark.createDataFrame([], _PLACES).drop("version", "bucket")
        rows = self.spark.read.schema(_PLACES).parquet(f"{self.path}/places").where(F.col("version") <= self.version)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        since = sized(self.files().select("segment", "since"), 200)
        return rows.join(since, "segment").where("version >= since").drop("version", "since", "bucket")

    def look_up(self, ids: DataFrame) -> DataFrame:
        """The events of ids (event_id), read from the segments that have them alone; one whose line is no longer there has no row."""
        ids = written(ids.select("event_id").distinct(), "asked")
        buckets = [r[0] for r in ids.select(_bucket()).distinct().collect()]  # at most BUCKETS
        at = self.places(buckets).join(sized(ids, 80), "event_id", "left_semi")
        at = written(_first(at).select("event_id", "segment", "length", "sha256"), "at")
        named = [r[0] for r in at.select("segment").distinct().limit(NAMED + 1).collect()]
        if not named:
            return self.spark.createDataFrame([], f"{log.ENVELOPE}, payload string, segment string")
        if len(named) > NAMED:
            named = [r[0] for r in self.files().select("segment").collect()]  # a name for each segment, as in any listing
        lines = self.spark.read.text([unquote(s) for s in named]).select(F.col("_metadata.file_path").alias("segment"), F.regexp_replace("value", "\r$", "").alias("line"))
        lines = lines.withColumns({"length": F.octet_length("line").cast("long"), "sha256": F.sha2("line", 256)})
        found = lines.join(sized(at, 300), ["segment", "length", "sha256"]).dropDuplicates(["event_id"])
        return log.parsed(found.select("segment", "line")).where("ok").select("e.*", "payload", "segment")

    def difference(self, *paths: str) -> Difference:
        """Compare the log's files with the last version; what is there now is the next one once it is committed.

        What a blocked difference would have forgotten stays as it was noted, and comes up again once the log is whole.
        """
        old = self.files()
        now = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
        now = now.select(F.col("_metadata.file_path").alias("segment"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
        both = now.join(old.select("segment", F.col("size").alias("was"), F.col("modified").alias("at"), "end"), "segment", "full")
        status = F.when(F.col("size").isNull(), "removed").when(F.col("was").isNull(), "new").when((F.col("size") == F.col("was")) & (F.col("modified") == F.col("at")), "same").otherwise("read")
        both = written(both.withColumn("status", status), "both")
        paths_read = [unquote(r[0]) for r in both.where("status in ('new', 'read')").select("segment").collect()]  # a name for each segment that is read
        lines = log.read_lines(self.spark, *paths_read) if paths_read else self.spark.createDataFrame([], "segment string, line_no long, byte_offset long, line string")
        lines = written(log.parsed(lines.where(F.trim("line") != "")), "lines")
        stood = lines.join(sized(both.where("status = 'read'").select("segment", "end"), 200), "segment").where(F.col("byte_offset") < F.col("end"))
        keep = stood.groupBy("segment").agg(*_digest()).join(old.select("segment", "lines", "sum_a", "sum_b", "end"), ["segment", "lines", "sum_a", "sum_b", "end"], "left_semi")
        more = lines.groupBy("segment").agg(*_digest(), F.count_if(~F.col("ok")).alias("malformed"))
        found = both.join(keep.select("segment", F.lit(True).alias("kept")), "segment", "left").join(more.withColumnRenamed("end", "now_end"), "segment", "left")
        grown = F.coalesce(F.col("now_end") > F.col("end"), F.lit(False))
        # A segment without lines has no end, and whatever comes to it is its tail.
        kept = F.coalesce("kept", F.col("end") == 0)
        status = F.when(F.col("status") != "read", F.col("status")).when(kept & grown, "appended").when(kept, "same").otherwise("changed")
        found = written(found.withColumn("status", status), "found")
        statuses = found.select("segment", "status", F.col("size").isNotNull().alias("there"), F.coalesce("end", F.lit(0)).alias("end"))
        noted = old.select("segment", F.col("malformed").alias("bad"))
        malformed = found.join(noted, "segment", "left").where("size is not null").agg(F.sum(F.coalesce("malformed", "bad", F.lit(0)))).first()[0] or 0
        kinds = {r[0] for r in statuses.select("status").distinct().collect()}
        blocked = malformed > 0 and bool(kinds & {"changed", "removed"})
        fresh = lines.join(sized(statuses, 200), "segment").where("ok and (status in ('new', 'changed') or status = 'appended' and byte_offset >= end)")
        fresh = fresh.withColumns({"event_id": F.col("e.event_id"), "session_id": F.col("e.session_id"), "length": F.octet_length("line").cast("long"), "sha256": F.sha2("line", 256)})
        place = ["event_id", "session_id", "segment", "byte_offset", "length", "sha256"]
        before = self.places().join(sized(statuses.select("segment", "status"), 200), "segment")
        fresh_at = written(fresh.select(*place, "status"), "fresh")
        lost = before.where("status in ('changed', 'removed')")
        # Only events that were read now or stood in what changed can differ.
        asked = written(fresh_at.select("event_id").unionByName(lost.select("event_id")).distinct(), "asked")
        before = written(before.join(sized(asked, 80), "event_id", "left_semi"), "before")
        stay = before.where("status in ('same', 'appended')").select(*place)
        was = _first(before).select("event_id", F.col("session_id").alias("was_session"), F.col("sha256").alias("was"))
        is_ = _first(stay.unionByName(fresh_at.select(*place))).select("event_id", "segment", "byte_offset", F.col("sha256").alias("is"))
        pairs = written(was.join(is_, "event_id", "full").where("not was <=> is"), "pairs")
        came = pairs.where("was is null" if blocked else "is is not null").select("event_id", "segment", "byte_offset")
        parsed = lines.where("ok").withColumn("event_id", F.col("e.event_id")).join(came, ["event_id", "segment", "byte_offset"])
        # A changed event may now be that of a segment which was not read.
        known = came.join(parsed.select("event_id"), "event_id", "left_anti")
        events = parsed.select("e.*", "payload", "segment", "byte_offset")
        if not known.isEmpty():
            events = events.unionByName(self.look_up_at(known))
        gone = pairs.where("was is not null").select("event_id", F.col("was_session").alias("session_id"))
        how = "difference" if kinds & {"changed", "removed"} else "tail" if kinds & {"new", "appended"} else "same"
        out = Difference(how, statuses.select("segment", "status"), written(events, "events"), written(gone.limit(0) if blocked else gone, "gone"), malformed, blocked, self.version + 1)
        self._note(old, found, fresh_at, blocked)
        return out

    def look_up_at(self, places: DataFrame) -> DataFrame:
        """The events at places (segment, byte_offset) of the log, with their offsets; the segments named are numbered."""
        named = [unquote(r[0]) for r in places.select("segment").distinct().collect()]
        lines = log.parsed(log.read_lines(self.spark, *named)).where("ok")
        return lines.join(places.select("segment", "byte_offset"), ["segment", "byte_offset"]).select("e.*", "payload", "segment", "byte_offset")

    def _note(self, old: DataFrame, found: DataFrame, fresh: DataFrame, blocked: bool) -> None:
        number = self.version + 1
        withheld = ["changed", "removed"] if blocked else []
        values = found.where(~F.col("status").isin(*withheld, "removed")).drop("kept").join(old.select("segment", *[F.col(c).alias(f"old_{c}") for c in ("lines", "malformed", "end", "sum_a", "sum_b", "since")]), "segment", "left")
        zero = {"lines": 0, "malformed": 0, "end": 0, "sum_a": 0, "sum_b": 0}
        now = {"end": "now_end"}
        picked = [F.coalesce(now.get(c, c), f"old_{c}", F.lit(z).cast(t)).alias(c) for (c, z), t in zip(zero.items(), ["long", "long", "long", "decimal(38,0)", "decimal(38,0)"], strict=True)]
        since = F.when(F.col("status").isin("new", "changed"), F.lit(number)).otherwise(F.col("old_since")).cast("long").alias("since")
        files = values.select("segment", "size", "modified", *picked, since)
        if blocked:
            held = found.where(F.col("status").isin(withheld)).select("segment")
            files = files.unionByName(old.join(held, "segment", "left_semi"))
        names = [c.split()[0] for c in _FILES.split(", ") if " " in c]
        files.select(*[F.col(n).cast(t) for n, t in zip(names, ["string", "long", "timestamp", "long", "long", "long", "decimal(38,0)", "decimal(38,0)", "long"], strict=True)]).write.mode("overwrite").parquet(f"{self.path}/files/version={number}")
        places = fresh.where(~F.col("status").isin(withheld)).drop("status").withColumn("bucket", _bucket())
        places.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/places/version={number}")

    def commit(self, difference: Difference) -> None:
        """From now on the log is held against what this difference saw."""
        if difference.version != self.version + 1:
            raise ValueError("the difference is not one from the last version")
        self.spark.range(1).select(F.lit(difference.version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self.version = difference.version


def apply(held: Store, state: LogState, difference: Difference, bind) -> dict[str, int]:
    """Make a store what the log is: forget what is gone, bring in what came, which bind makes events of the model, then commit.

    If this ends halfway the difference is found again, and doing it again ends in the same store.
    """
    gone = held.forget(difference.gone)
    done = {**held.ingest(bind(difference.events)), "forgotten": gone}
    state.commit(difference)
    return done


def _bucket() -> Column:
    return F.pmod(F.crc32(F.col("event_id").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket")


def _first(places: DataFrame) -> DataFrame:
    """Of each event's places the first."""
    fields = [c for c in ("session_id", "segment", "byte_offset", "length", "sha256") if c in places.columns]
    return places.groupBy("event_id").agg(F.min_by(F.struct(*fields), F.struct("segment", "byte_offset")).alias("p")).select("event_id", "p.*")
