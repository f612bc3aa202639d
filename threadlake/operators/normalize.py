"""Raw hook inputs as events: ids, envelope fields, sanitized payloads, and what search reads of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import payload as P
from threadlake.functions.redaction import PREVIEW_CHARS, sanitized
from threadlake.functions.text import trimmed
from threadlake.storage import small_batches

#: Where the session's id is looked for, in order (fixed values).
SESSION_FIELDS = ["session_id", "sessionId", "conversation_id", "conversationId"]
#: The counters of token usage: their names here, and in a payload's usage (fixed values).
COUNTERS = {
    "total_input_tokens": "input_token_count",
    "cached_input_tokens": "cached_input_token_count",
    "output_tokens": "output_token_count",
    "reasoning_output_tokens": "reasoning_output_token_count",
    "total_tokens": "total_token_count",
}


def event_id(hook: Column, session: Column, ts: Column, raw_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\0", hook, session, ts, raw_hash), 256)


def fallback_session(hook: Column, cwd: Column, raw_hash: Column) -> Column:
    """The id of a session that names none: the same for the same input in the same place."""
    return F.concat(F.lit("unknown-"), F.substring(F.sha2(F.concat_ws("\0", hook, cwd, raw_hash), 256), 1, 12))


def normalized(raw: DataFrame) -> DataFrame:
    """Events of raw inputs (raw, hook_event, ts, seq, env_cwd, env_session_id, repo_root, git_branch).

    A JSON object is taken as it is, other JSON as {"value": ...}, and what is no JSON as a note of the error
    with its beginning. Everything that is stored, the envelope's names and places too, is sanitized; the
    event's id is that of the input as it came.
    """
    v = F.try_parse_json("raw")
    rows = raw.withColumn("v", v).withColumn("is_json", F.col("v").isNotNull()).withColumn("raw_hash", F.sha2("raw", 256))
    is_object = F.startswith(P.kind(F.col("v")), F.lit("OBJECT"))
    body = (
        F.when(~F.col("is_json"), F.to_json(F.struct(F.lit(True).alias("parse_error"), F.substring("raw", 1, PREVIEW_CHARS).alias("raw_preview"))))
        .when(is_object, F.col("raw")).otherwise(F.concat(F.lit('{"value":'), "raw", F.lit("}")))
    )
    cwd = F.coalesce(P.string(F.col("v"), "cwd"), "env_cwd")
    rows = rows.withColumn("body", body).withColumn("cwd", cwd)
    session = F.coalesce(P.string(F.col("v"), *SESSION_FIELDS), trimmed(F.when(F.col("is_json"), F.col("env_session_id"))), fallback_session(F.col("hook_event"), F.col("cwd"), F.col("raw_hash")))
    rows = rows.withColumn("session_id", session).withColumn("project", P.string(F.col("v"), "project")).withColumn("tool_name", P.string(F.col("v"), "tool_name", "toolName"))
    names = ["session_id", "cwd", "project", "repo_root", "git_branch", "tool_name"]
    rows = rows.withColumn("id", event_id(F.col("hook_event"), F.col("session_id"), F.col("ts"), F.col("raw_hash")))
    small_batches(raw.sparkSession)
    rows = rows.withColumn("p", sanitized(F.col("body"), F.to_json(F.struct(*names))))
    meta = F.try_parse_json("p.meta")
    clean = [P.string(meta, n).alias(n) for n in names[2:]]
    hidden = [F.coalesce(P.string(meta, n), F.lit("[REDACTED:metadata]")).alias(n) for n in names[:2]]
    return rows.select(
        F.lit(1).alias("schema_version"), F.col("id").alias("event_id"), "ts", "seq", "hook_event", *hidden, *clean,
        "p.payload", "p.redactions", "p.truncations",
        F.col("raw_hash").alias("raw_input_sha256"), F.octet_length("raw").cast("long").alias("original_bytes"), "p.sanitized_bytes",
    )


def note(spark, session_id: str, cwd: str, text: str, ts: str) -> DataFrame:
    """One note as a raw input, to be normalized and appended like any other."""
    row = spark.createDataFrame([(session_id, cwd, text)], "session_id string, cwd string, note string")
    none = F.lit(None).cast("string")
    return row.select(F.to_json(F.struct("session_id", "cwd", "note")).alias("raw"), F.lit("Note").alias("hook_event"), F.lit(ts).alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("cwd").alias("env_cwd"), none.alias("env_session_id"), none.alias("repo_root"), none.alias("git_branch"))


def read_payload(events: DataFrame) -> DataFrame:
    """Events (hook_event, payload, tool_name, ...) with what their payload carries.

    Adds turn_id, tool_use_id, agent_id, parent_session_id, agent_role, agent_nickname, model,
    reasoning_effort, the five token counters, text (what the event says), is_source (whether summaries are
    made of it), is_suggestion, is_own_tool, is_indexed and search_text.
    """
    rows = events.withColumn("__v", F.try_parse_json("payload"))
    v, hook = F.col("__v"), F.col("hook_event")
    tool = F.coalesce(trimmed(F.col("tool_name")), P.string(v, "tool_name", "toolName"))
    rows = rows.withColumn("text", P.signal(hook, v))
    rows = rows.withColumns(
        {
            "turn_id": P.string(v, "turn_id", "turnId"), "tool_use_id": P.string(v, "tool_use_id", "toolUseId"), "agent_id": P.string(v, "agent_id", "agentId"),
            "parent_session_id": P.parent(hook, v, F.col("text")), "agent_role": P.string(v, "agent_role", "metadata.agent_role"),
            "agent_nickname": P.string(v, "agent_nickname", "metadata.agent_nickname"), "model": P.string(v, "model"), "reasoning_effort": P.string(v, "reasoning_effort"),
            **{name: P.number(v, f"usage.{field}").cast("long") for name, field in COUNTERS.items()},
            "is_source": P.says_something(hook, F.col("text"), P.flag(v, "stop_hook_active")), "is_suggestion": P.suggestion(hook, F.col("text")), "is_own_tool": P.own_tool(tool),
        }
    )
    rows = rows.withColumn("is_indexed", (F.col("is_source") | F.col("is_suggestion")) & ~F.col("is_own_tool"))
    return rows.withColumn("search_text", search_text()).drop("__v")


def search_text() -> Column:
    """What the full-text index reads of an event: its fields that say something, and its payload, one a line."""
    names = ["hook_event", "session_id", "cwd", "repo_root", "git_branch", "tool_name", "turn_id", "tool_use_id", "payload"]
    return F.concat_ws("\n", *[F.nullif(F.col(n), F.lit("")) for n in names])


def overflow_refs(events: DataFrame) -> DataFrame:
    """The references of events to payloads that were stored apart; malformed ones are no references."""
    v = F.try_parse_json("payload")
    rows = events.select(
        "session_id", F.col("event_id").alias("observed_event_id"), "ts", P.string(v, "overflow_ref.path").alias("path"), P.string(v, "overflow_ref.sha256").alias("sha256"),
        P.number(v, "overflow_ref.byte_count").cast("long").alias("byte_count"), P.number(v, "overflow_ref.sanitized_byte_count").cast("long").alias("sanitized_byte_count"),
    )
    rows = rows.where(F.col("sha256").rlike("^[a-f0-9]{64}$") & F.col("path").isNotNull() & F.col("byte_count").isNotNull() & F.col("sanitized_byte_count").isNotNull())
    return rows.select(F.concat(F.lit("overflow:"), "sha256").alias("file_ref_id"), *rows.columns)


def resolve(sessions: DataFrame, events: DataFrame, identifiers: DataFrame) -> DataFrame:
    """identifiers (identifier) with the session each means: a session's own id, else its latest agent's."""
    asked = identifiers.select(F.trim("identifier").alias("identifier")).where("identifier <> ''").distinct()
    direct = asked.join(sessions.select(F.col("session_id").alias("identifier")).withColumn("direct", F.col("identifier")), "identifier", "left")
    agents = events.where("agent_id is not null").groupBy(F.col("agent_id").alias("identifier")).agg(F.max_by("session_id", F.struct("ts", "seq")).alias("by_agent"))
    return direct.join(agents, "identifier", "left").select("identifier", F.coalesce("direct", "by_agent").alias("session_id"))
