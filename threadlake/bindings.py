"""The event model, and how the driver's tables are read as events.

An event has event_id, session_id, ts (ISO-8601 UTC text with milliseconds), seq (order of arrival),
hook_event, cwd, repo_root, parent_session_id, tool_name, turn_id, tool_use_id, text, tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.payload import OWN_TOOLS
from threadlake.operators import normalize

EVENT_COLUMNS = ["event_id", "session_id", "ts", "seq", "hook_event", "cwd", "repo_root", "parent_session_id", "tool_name", "turn_id", "tool_use_id", "text", "tokens"]
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt to all cores where it has fewer files than those: work on a text is far dearer than moving it."""
    df, cores = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def conv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions: user prompts, assistant stops, system notes; a forest of parents."""
    c = F.col("conv_id")
    ts = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    return read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), c, F.lit("-"), "turn").alias("event_id"),
        F.concat(F.lit("conv-"), c).alias("session_id"),
        F.date_format(ts, _ISO).alias("ts"),
        (c * 100 + F.col("turn")).alias("seq"),
        F.when(F.col("role") == "user", "UserPromptSubmit").when(F.col("role") == "assistant", "Stop").otherwise("Note").alias("hook_event"),
        F.concat(F.lit("/w/"), c % 7).alias("cwd"),
        F.when(c % 3 == 0, F.concat(F.lit("/r/"), c % 5)).alias("repo_root"),
        F.when(c >= 8, F.concat(F.lit("conv-"), F.floor(c / 4))).alias("parent_session_id"),
        F.lit(None).cast("string").alias("tool_name"),
        F.col("turn").cast("string").alias("turn_id"),
        F.lit(None).cast("string").alias("tool_use_id"),
        "text",
        F.length("text").cast("long").alias("tokens"),
    )


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User activity as sessions of tool calls: click before, view after, purchase stops, errors compact."""
    kind = F.col("event_type")
    hook = F.when(kind == "click", "PreToolUse").when(kind == "view", "PostToolUse").when(kind == "signup", "UserPromptSubmit").when(kind == "purchase", "Stop").otherwise("PreCompact")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("event_id"),
        F.concat(F.lit("user-"), "user_id").alias("session_id"),
        F.date_format("ts", _ISO).alias("ts"),
        F.col("event_id").alias("seq"),
        hook.alias("hook_event"),
        F.concat(F.lit("/w/"), F.col("user_id") % 7).alias("cwd"),
        F.lit(None).cast("string").alias("repo_root"),
        F.lit(None).cast("string").alias("parent_session_id"),
        F.when(kind.isin("click", "view"), "tool").alias("tool_name"),
        F.date_format("ts", "yyyy-MM-dd").alias("turn_id"),
        F.when(kind.isin("click", "view"), F.get_json_object("props", "$.k")).alias("tool_use_id"),
        F.lit(None).cast("string").alias("text"),
        F.round(F.col("value") * 100).cast("long").alias("tokens"),
    )


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts of one session for each source, in the order of doc_id."""
    d = F.col("doc_id")
    ts = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    null = F.lit(None).cast("string")
    return read_texts(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), d).alias("event_id"), F.col("source").alias("session_id"), F.date_format(ts, _ISO).alias("ts"), d.alias("seq"),
        F.lit("UserPromptSubmit").alias("hook_event"), F.concat(F.lit("/w/"), "lang").alias("cwd"), null.alias("repo_root"), null.alias("parent_session_id"),
        null.alias("tool_name"), null.alias("turn_id"), null.alias("tool_use_id"), "text", F.length("text").cast("long").alias("tokens"),
    )


def rich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events with JSON payloads, as hooks give them, of all that filters and fields tell apart.

    Some prompts are heartbeats, requests for suggestions or delegations, some answers only suggestions or
    given by a stop hook; payloads name parents, agents, models, tools and token counters in all their places.
    """
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    user, answer = role == "user", role == "assistant"
    said = (
        F.when(user & (c % 7 == 5) & (t <= 1), "# Overview generate 0 to 3 hyperpersonalized suggestions for what this user can do with tools")
        .when(user & (c % 11 == 0), F.concat(F.lit("<heartbeat> "), "text"))
        .when(user & (c % 17 == 4) & (t <= 1), F.concat(F.lit("<host_delegation><source_thread_id> conv-"), F.floor(c / 2), F.lit(" </source_thread_id> "), "text"))
        .when(answer & (c % 7 == 3), '{"suggestions": ["a"]}').otherwise(F.col("text"))
    )
    n, conv = F.length("text").cast("long"), lambda k: F.concat(F.lit("conv-"), F.floor(c / k))
    has = lambda cond, x: F.when(cond, x)
    usage = F.struct(n.alias("input_token_count"), t.alias("cached_input_token_count"), (n * 2).alias("output_token_count"), (t - 2).alias("reasoning_output_token_count"), has(c % 2 == 0, (n * 3).cast("double")).alias("total_token_count"))
    meta = F.struct(has((c >= 8) & (c % 3 == 1), conv(4)).alias("parent_thread_id"), F.lit("helper").alias("agent_role"), F.struct(F.struct(F.struct(has((c >= 8) & (c % 3 == 2), conv(4)).alias("parent_thread_id")).alias("thread_spawn")).alias("subagent")).alias("source"))
    tool = has(answer, F.when(c % 19 == 0, OWN_TOOLS + "search").otherwise(F.concat(F.lit("tool"), t % 4)))
    payload = F.to_json(
        F.struct(
            has(user & (c % 2 == 0), said).alias("prompt"), has(user & (c % 2 == 1), said).alias("message"), has(answer, said).alias("last_assistant_message"), has(~user & ~answer, said).alias("note"),
            has(answer & (c % 13 == 0), F.lit(True)).alias("stop_hook_active"), has((c >= 8) & (c % 3 == 0), conv(4)).alias("parent_session_id"), meta.alias("metadata"), usage.alias("usage"),
            F.concat(F.lit("agent-"), c % 5).alias("agentId"), F.concat(F.lit("m"), t % 3).alias("model"), F.concat(F.lit(" "), t, F.lit(" ")).alias("turn_id"), t.alias("tool_use_id"), tool.alias("toolName"),
        )
    )
    rows = conv_events(spark, sf_dir).select("event_id", "session_id", "ts", "seq", "hook_event", "cwd", "repo_root")
    made = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), c, F.lit("-"), "turn").alias("event_id"), payload.alias("payload"), tool.alias("tool_name"), F.lit(None).cast("string").alias("git_branch"))
    return normalize.read_payload(rows.join(made, "event_id"))


#: rich_events in DuckDB's SQL, without a payload: what its fields are is said directly.
RICH_SQL = r"""rv AS (
  SELECT *, CASE WHEN role = 'user' AND conv_id % 7 = 5 AND turn <= 1 THEN 'asked' WHEN role = 'user' AND conv_id % 11 = 0 THEN 'heartbeat'
                 WHEN role = 'user' AND conv_id % 17 = 4 AND turn <= 1 THEN 'delegated' WHEN role = 'assistant' AND conv_id % 7 = 3 THEN 'answered' ELSE 'plain' END AS form FROM conversations),
ev AS (
  SELECT 'c' || conv_id || '-' || turn AS event_id, 'conv-' || conv_id AS session_id,
         strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, conv_id * 100 + turn AS seq,
         CASE role WHEN 'user' THEN 'UserPromptSubmit' WHEN 'assistant' THEN 'Stop' ELSE 'Note' END AS hook_event, '/w/' || (conv_id % 7) AS cwd,
         CASE WHEN conv_id % 3 = 0 THEN '/r/' || (conv_id % 5) END AS repo_root,
         regexp_replace(CASE form WHEN 'asked' THEN '# Overview generate 0 to 3 hyperpersonalized suggestions for what this user can do with tools' WHEN 'heartbeat' THEN '<heartbeat> ' || text
           WHEN 'delegated' THEN '<host_delegation><source_thread_id> conv-' || (conv_id // 2) || ' </source_thread_id> ' || text WHEN 'answered' THEN '{"suggestions": ["a"]}' ELSE text END, '^\s+|\s+$', '', 'g') AS text,
         CASE WHEN conv_id >= 8 THEN 'conv-' || (conv_id // 4) WHEN form = 'delegated' THEN 'conv-' || (conv_id // 2) END AS parent_session_id,
         length(text) AS total_input_tokens, turn AS cached_input_tokens, length(text) * 2 AS output_tokens, CASE WHEN turn >= 2 THEN turn - 2 END AS reasoning_output_tokens,
         CASE WHEN conv_id % 2 = 0 THEN length(text) * 3 END AS total_tokens, 'agent-' || (conv_id % 5) AS agent_id, 'helper' AS agent_role, 'm' || (turn % 3) AS model, CAST(turn AS VARCHAR) AS turn_id,
         CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 19 = 0 THEN 'mcp__threadlake__search' ELSE 'tool' || (turn % 4) END END AS tool_name,
         role = 'assistant' AND conv_id % 19 = 0 AS is_own_tool, form IN ('asked', 'answered') AS is_suggestion,
         form NOT IN ('asked', 'answered', 'heartbeat') AND NOT (role = 'assistant' AND conv_id % 13 = 0) AS is_source
  FROM rv)"""
#: The same events in DuckDB's SQL.
CONV_SQL = """ev AS (
  SELECT 'c' || conv_id || '-' || turn AS event_id, 'conv-' || conv_id AS session_id,
         strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts,
         conv_id * 100 + turn AS seq,
         CASE role WHEN 'user' THEN 'UserPromptSubmit' WHEN 'assistant' THEN 'Stop' ELSE 'Note' END AS hook_event,
         '/w/' || (conv_id % 7) AS cwd,
         CASE WHEN conv_id % 3 = 0 THEN '/r/' || (conv_id % 5) END AS repo_root,
         CASE WHEN conv_id >= 8 THEN 'conv-' || (conv_id // 4) END AS parent_session_id,
         CAST(NULL AS VARCHAR) AS tool_name, CAST(turn AS VARCHAR) AS turn_id, CAST(NULL AS VARCHAR) AS tool_use_id,
         text, length(text) AS tokens
  FROM conversations)"""
ACTIVITY_SQL = """ev AS (
  SELECT 'e' || event_id AS event_id, 'user-' || user_id AS session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'PreToolUse' WHEN 'view' THEN 'PostToolUse' WHEN 'signup' THEN 'UserPromptSubmit'
                         WHEN 'purchase' THEN 'Stop' ELSE 'PreCompact' END AS hook_event,
         '/w/' || (user_id % 7) AS cwd, CAST(NULL AS VARCHAR) AS repo_root, CAST(NULL AS VARCHAR) AS parent_session_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'tool' END AS tool_name, strftime(ts, '%Y-%m-%d') AS turn_id,
         CASE WHEN event_type IN ('click', 'view') THEN json_extract_string(props, '$.k') END AS tool_use_id,
         CAST(NULL AS VARCHAR) AS text, CAST(round(value * 100) AS BIGINT) AS tokens
  FROM events)"""
DOC_SQL = """ev AS (
  SELECT 'd' || doc_id AS event_id, source AS session_id,
         strftime(TIMESTAMP '2026-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, doc_id AS seq,
         'UserPromptSubmit' AS hook_event, '/w/' || lang AS cwd, CAST(NULL AS VARCHAR) AS repo_root, CAST(NULL AS VARCHAR) AS parent_session_id,
         text, length(text) AS tokens
  FROM documents)"""
