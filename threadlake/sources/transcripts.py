"""Transcript files as events: state carried down a file by windows, two record shapes reconciled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import payload as P
from threadlake.functions.text import iso
from threadlake.operators.ordering import numbered
from threadlake.operators.upkeep import cross_shape

# Records of calls and of what they give back.
CALLS = ["function_call", "tool_search_call", "custom_tool_call", "web_search_call"]
OUTPUTS = ["function_call_output", "tool_search_output", "custom_tool_call_output"]
EPOCH = "1970-01-01T00:00:00.000Z"
UUID_TAIL = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, line) of all .jsonl files under a path.

    Large files are read in splits: a line's place follows from its split's start and its row in the split.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("line"))
    return numbered(rows, "file", "block", "row", name="line_no").select("file", "line_no", "line")


def _text(v: Column, path: str) -> tuple[Column, Column]:
    """The texts of a content array: as they are, and trimmed without blank ones."""
    parts = F.from_json(F.to_json(P.at(v, path)), "array<struct<text:string>>")
    texts = F.filter(F.transform(parts, lambda x: x["text"]), lambda t: t.isNotNull())
    trim = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    clean = trim(F.array_join(F.filter(F.transform(texts, trim), lambda t: t != ""), "\n\n"))
    return F.array_join(texts, "\n\n"), clean


def decoded(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of transcript lines: a line that is no JSON object, or has no time, is an error with its reason."""
    rows = lines.where("trim(line) <> ''").withColumn("v", F.try_parse_json("line"))
    v = F.col("v")
    rows = rows.withColumn("type", P.string(v, "type")).withColumn("ts", iso(F.coalesce(P.string(v, "timestamp", "payload.timestamp"), F.lit(EPOCH))))
    why = F.when(v.isNull(), "no JSON").when(~F.startswith(P.kind(v), F.lit("OBJECT")), "record is not an object").when(F.col("ts").isNull(), "invalid timestamp")
    rows = rows.withColumn("error", why)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("file", "line_no", "error")


def raw_inputs(records: DataFrame) -> DataFrame:
    """Raw hook inputs of records: session, turn and place carried forward, then one of each pair of shapes.

    A record's hook follows from its type. Session and place are those last named above it in the file; a new
    session forgets place and turn. A file whose name ends in a session's id gives that session's events only.
    """
    v = F.col("v")
    down = Window.partitionBy("file").orderBy("line_no")
    meta, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    own = F.regexp_extract("file", UUID_TAIL, 1)
    stem = F.coalesce(F.nullif(own, F.lit("")), F.regexp_extract("file", r"([^/]*)\.jsonl$", 1))
    named = F.last(F.when(meta, P.string(v, "payload.id")), ignorenulls=True).over(down)
    rows = records.withColumn("named", named)
    begins = F.coalesce((F.col("named") != F.lag("named").over(down)).cast("int"), F.lit(0))
    rows = rows.withColumn("begins", begins).withColumn("epoch", F.sum("begins").over(down)).withColumn("session_id", F.coalesce("named", stem))
    within = Window.partitionBy("file", "epoch").orderBy("line_no")

    def carried(value: Column, over) -> Column:
        return F.last(value, ignorenulls=True).over(over)

    rows = rows.withColumns(
        {
            "cwd": F.coalesce(carried(F.when(meta | context, P.string(v, "payload.cwd")), within), F.lit("")), "turn_id": carried(F.when(context, P.string(v, "payload.turn_id")), within),
            "repo_root": carried(F.when(context, P.string(v, "payload.repo_root", "payload.repoRoot")), within), "git_branch": carried(F.when(context, P.string(v, "payload.git_branch", "payload.gitBranch")), within),
            "model": carried(F.when(context, P.string(v, "payload.model")), down), "effort": carried(F.when(context, P.string(v, "payload.effort", "payload.reasoning_effort")), down),
        }
    )
    kind, role = P.string(v, "payload.type"), P.string(v, "payload.role")
    msg, item = F.col("type") == "event_msg", F.col("type") == "response_item"
    speaks = (item & (kind == "message") & role.isin("user", "assistant")) | (item & (kind == "agent_message"))
    content, clean = _text(v, "payload.content")
    plain = F.when(P.kind(P.at(v, "payload.message")) == "STRING", F.try_variant_get(v, "$.payload.message", "string"))
    rows = rows.withColumn("source_text", F.when(msg & kind.isin("user_message", "agent_message"), plain).when(speaks, content))
    rows = rows.withColumn("said", F.when(msg & kind.isin("user_message", "agent_message"), P.string(v, "payload.message")).when(speaks, F.nullif(clean, F.lit(""))))
    speaker = F.when(msg, F.when(kind == "user_message", "UserPromptSubmit").otherwise("Stop")).otherwise(F.when((kind == "message") & (role == "user"), "UserPromptSubmit").otherwise("Stop"))
    usage = F.startswith(P.kind(P.at(v, "payload.info.total_token_usage")), F.lit("OBJECT"))
    summary = P.string(v, "payload.message")
    hook = (
        F.when(meta, "SessionStart").when(context & F.coalesce("model", "effort").isNotNull(), "TurnContext").when((F.col("type") == "compacted") & summary.isNotNull(), "PostCompact")
        .when(msg & (kind == "token_count") & F.coalesce(usage, F.lit(False)), "TokenCount").when(F.col("said").isNotNull() & ~P.synthetic(F.col("said")), speaker)
        .when(item & kind.isin(CALLS), "PreToolUse").when(item & kind.isin(OUTPUTS), "PostToolUse")
    )
    rows = rows.withColumn("hook_event", hook).where("hook_event is not null").where((own == "") | (F.col("session_id") == own))
    count = lambda name: P.number(v, f"payload.info.total_token_usage.{name}").cast("long")
    any_of = lambda *paths: F.coalesce(*[F.to_json(P.at(v, p)) for p in paths])
    is_hook = lambda name, c: F.when(F.col("hook_event") == name, c)
    call = F.coalesce(P.string(v, "payload.name"), F.when(kind == "web_search_call", "web_search").otherwise(kind))
    counters = F.struct(
        count("input_tokens").alias("input_token_count"), count("cached_input_tokens").alias("cached_input_token_count"), count("output_tokens").alias("output_token_count"),
        count("reasoning_output_tokens").alias("reasoning_output_token_count"), count("total_tokens").alias("total_token_count"),
    )
    raw = F.to_json(
        F.struct(
            is_hook("UserPromptSubmit", F.col("said")).alias("prompt"), is_hook("Stop", F.col("said")).alias("last_assistant_message"), is_hook("PostCompact", summary).alias("summary"),
            is_hook("TurnContext", F.col("model")).alias("model"), is_hook("TurnContext", F.col("effort")).alias("reasoning_effort"), is_hook("TokenCount", counters).alias("usage"),
            is_hook("PreToolUse", call).alias("tool_name"), F.when(item & kind.isin(CALLS + OUTPUTS), P.string(v, "payload.call_id", "payload.id")).alias("tool_use_id"),
            is_hook("PreToolUse", any_of("payload.arguments", "payload.input", "payload.action")).alias("tool_input"), is_hook("PreToolUse", P.string(v, "payload.status")).alias("tool_status"),
            is_hook("PostToolUse", any_of("payload.output", "payload.tools", "payload")).alias("tool_response"), P.string(v, "payload.author").alias("author"), P.string(v, "payload.recipient").alias("recipient"),
            is_hook("SessionStart", F.to_json(P.at(v, "payload"))).alias("session_meta"), is_hook("SessionStart", P.string(v, "payload.parent_thread_id", "payload.source.subagent.thread_spawn.parent_thread_id")).alias("parent_session_id"),
            F.col("file").alias("imported_from"), F.col("type").alias("record_type"), F.col("ts").alias("source_timestamp"), "turn_id", "session_id", "cwd",
        )
    )
    rows = rows.withColumn("raw", raw).withColumn("shape", F.when(msg, "event").otherwise("item"))
    talk = rows.where(F.col("source_text").isNotNull())
    talk = cross_shape(talk, ["file", "epoch", "hook_event", "session_id", "turn_id", "source_text"], "line_no")
    names = ["file", "line_no", "hook_event", "ts", "session_id", "cwd", "turn_id", "repo_root", "git_branch", "raw"]
    return reduce(DataFrame.unionByName, [talk.select(*names), rows.where(F.col("source_text").isNull()).select(*names)])


def inputs_of(spark: SparkSession, path: str, cwd: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inputs for normalize.normalized(), records, errors) of all transcripts under a path; cwd is where sessions without one are."""
    records, errors = decoded(read_lines(spark, path))
    rows = raw_inputs(records)
    none = F.lit(None).cast("string")
    return rows.select("raw", "hook_event", "ts", F.col("line_no").alias("seq"), F.lit(cwd).alias("env_cwd"), none.alias("env_session_id"), "repo_root", "git_branch", "file"), records, errors


def report(events: DataFrame, records: DataFrame, errors: DataFrame, known: DataFrame) -> DataFrame:
    """One row of an import's counts: files, records read and left out, events that can be imported, those that are known."""
    read = records.select("file").unionByName(errors.select("file")).agg(F.countDistinct("file").alias("files_scanned"), F.count(F.lit(1)).alias("records_read"))
    made = events.select("event_id").agg(F.count(F.lit(1)).alias("events_importable"), F.countDistinct("event_id").alias("distinct_events"))
    again = events.select("event_id").distinct().join(known.select("event_id"), "event_id", "left_semi").agg(F.count(F.lit(1)).alias("known"))
    bad = errors.agg(F.count(F.lit(1)).alias("errors"))
    out = read.crossJoin(made).crossJoin(again).crossJoin(bad)  # one row each
    imported = F.col("distinct_events") - F.col("known")
    return out.select(
        "files_scanned", "records_read", "events_importable", imported.alias("events_imported"), (F.col("events_importable") - imported).alias("events_skipped_duplicate"),
        (F.col("records_read") - F.col("events_importable")).alias("records_skipped"), "errors",
    )
