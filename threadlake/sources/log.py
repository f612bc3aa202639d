"""The append-only JSON log: reading with invalid lines set apart, segments, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.ordering import ordered
from threadlake.storage import file_state, shared_dir

ENVELOPE = "schema_version int, event_id string, timestamp string, hook_event string, session_id string, cwd string, repo_root string, tool_name string, raw_input_sha256 string, original_bytes long, sanitized_bytes long"


def read_log(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(events, malformed lines) of JSON-lines files, gzipped ones too; blank lines count as neither."""
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths)).select(F.rtrim(F.col("value")).alias("line"), F.col("_metadata.file_name").alias("segment"))
    rows = parsed(lines.where("line <> ''"))
    return rows.where("ok").select("e.*", "payload", "segment"), rows.where("not ok").select("line", "segment")


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line, ...) with their envelope e, payload, and whether they are events."""
    rows = lines.withColumn("e", F.from_json("line", ENVELOPE)).withColumn("payload", F.get_json_object("line", "$.payload"))
    ok = (F.col("e.schema_version") == 1) & F.col("e.event_id").isNotNull() & F.col("e.timestamp").isNotNull() & F.col("e.hook_event").isNotNull() & F.col("e.session_id").isNotNull() & F.startswith(F.col("payload"), F.lit("{"))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(segment, line_no from 0, byte_offset, line) of a log's files: where each line stands."""
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("segment"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    rows = ordered(rows, "segment", ["block", "row"], "line_no", {"byte_offset": F.octet_length("line") + 1})
    return rows.select("segment", "line_no", "byte_offset", F.regexp_replace("line", "\r$", "").alias("line"))


def at(lines: DataFrame, segment: str, line_no: int) -> DataFrame:
    """The event at a place of the log."""
    line = lines.where((F.col("segment") == segment) & (F.col("line_no") == line_no))
    return line.select(F.from_json("line", ENVELOPE).alias("e"), F.get_json_object("line", "$.payload").alias("payload")).select("e.*", "payload")


def publish(rows: DataFrame, path: str, compress: bool = False) -> None:
    """Write segments of rows (segment, place, line) as files <path>/<segment>.jsonl, which replace files of those names as wholes.

    A segment is one sorted file; a compressed one is published only if it reads back with the count and
    hashes of the lines it was made from. Places order a segment's lines and differ within it.
    """
    spark = rows.sparkSession
    scratch, name = shared_dir(spark), f".jsonl{'.gz' if compress else ''}"
    out = rows.select("segment", "place", "line").repartition("segment").sortWithinPartitions("segment", "place").select("segment", "line")
    out.write.partitionBy("segment").option("compression", "gzip" if compress else "none").text(scratch)
    if compress:
        check = lambda df: df.groupBy(F.col("segment").cast("string")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("sum"))
        wrong = check(rows).exceptAll(check(spark.read.text(scratch).select("segment", F.col("value").alias("line"))))
        if not wrong.isEmpty():
            raise OSError(f"segments do not read back: {[r[0] for r in wrong.select('segment').limit(5).collect()]}")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(Path(path))
    for file, _, _ in file_state(spark, scratch):
        if "/segment=" in file:
            to = Path(f"{path}/{file.split('/segment=')[1].split('/')[0]}{name}")
            fs.delete(to, False)
            fs.rename(Path(file), to)


def quarantine(malformed: DataFrame, path: str) -> None:
    """What could not be read, by segment, size and hash, and the lines themselves, beside the log."""
    malformed.select("segment", F.octet_length("line").cast("long").alias("length"), F.sha2("line", 256).alias("sha256"), "line").write.mode("append").parquet(path)


def append_log(events: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Append events as gzipped JSON lines; the commit protocol makes it whole or nothing."""
    events.write.mode("append").option("maxRecordsPerFile", per_file).option("compression", "gzip").json(path)


def log_stats(events: DataFrame, malformed: DataFrame) -> DataFrame:
    """Events, sessions and malformed lines by segment."""
    good = events.groupBy("segment").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    bad = malformed.groupBy("segment").agg(F.count(F.lit(1)).alias("malformed"))
    return good.join(bad, "segment", "full").na.fill(0, ["events", "malformed"])


def storage_stats(spark: SparkSession, *paths: str) -> DataFrame:
    """Files and bytes of a log's segments, gzipped or not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")
    zipped = F.col("path").endswith(".gz")
    return files.groupBy(zipped.alias("compressed")).agg(F.count(F.lit(1)).alias("segments"), F.sum("length").alias("bytes"))
