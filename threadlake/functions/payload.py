"""Typed access to JSON payloads, and what events say and carry in them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.text import compact, trimmed

#: Hooks whose text says something (fixed values).
SIGNAL_HOOKS = ["UserPromptSubmit", "Note", "Stop", "PreCompact", "PostCompact"]
#: Where each hook's text is looked for, in order (fixed values).
SIGNAL_FIELDS = {
    "UserPromptSubmit": ["prompt", "message"],
    "Note": ["note", "text"],
    "Stop": ["last_assistant_message", "summary"],
    "PreCompact": ["summary", "reason"],
    "PostCompact": ["summary", "reason"],
}
#: Tags with which texts begin that a host puts in a user's mouth (fixed values).
CONTEXT_TAGS = ["<environment_context>", "<developer", "<apps_instructions>", "<skills_instructions>", "<plugins_instructions>"]
#: How a prompt begins that asks for suggestions on its own (a fixed value).
SUGGESTION_PROMPT = r"(?i)^#\s*overview\s+generate\s+0\s+to\s+3\s+hyperpersonalized\s+suggestions\s+for\s+what\s+this\s+user\s+can\s+do\s+with\s+\w+\b"
#: The prefix of the engine's own tools' names; their events say nothing about a session.
OWN_TOOLS = "mcp__threadlake__"


def at(v: Column, path: str) -> Column:
    """The part of a variant at a path such as a.b; null if there is none."""
    return F.try_variant_get(v, "$." + path, "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, OBJECT<...> and so on."""
    return F.schema_of_variant(v)


def string(v: Column, *paths: str) -> Column:
    """The first of the paths with a string that is not blank, trimmed."""
    each = [F.when(kind(at(v, p)) == "STRING", trimmed(F.try_variant_get(v, "$." + p, "string"))) for p in paths]
    return F.coalesce(*each) if len(each) > 1 else each[0]


def number(v: Column, path: str) -> Column:
    """A number that is not negative."""
    x = F.when(kind(at(v, path)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$." + path, "double"))
    return F.when((x >= 0) & (x < float("inf")), x)


def flag(v: Column, path: str) -> Column:
    """Whether a path holds true itself."""
    return F.coalesce((kind(at(v, path)) == "BOOLEAN") & F.try_variant_get(v, "$." + path, "boolean"), F.lit(False))


def signal(hook: Column, v: Column) -> Column:
    """What an event says: '' if nothing."""
    out = F.lit("")
    for name, fields in SIGNAL_FIELDS.items():
        out = F.when(hook == name, F.coalesce(string(v, *fields), F.lit(""))).otherwise(out)
    return out


def suggestion(hook: Column, text: Column) -> Column:
    """Whether an event asks for suggestions on its own, or answers with nothing but them."""
    v = F.try_parse_json(text)
    only = F.startswith(F.ltrim(text), F.lit("{")) & (F.array_join(F.json_object_keys(text), ",") == "suggestions") & F.startswith(kind(at(v, "suggestions")), F.lit("ARRAY"))
    asked = (hook == "UserPromptSubmit") & text.rlike(SUGGESTION_PROMPT)
    return F.coalesce(asked | ((hook == "Stop") & only), F.lit(False))


def says_something(hook: Column, text: Column, stop_hook: Column) -> Column:
    """Whether an event is a source of summaries: no suggestion, heartbeat, list of plugins or empty compaction."""
    low = compact(text)
    beat = low.rlike("(?i)^<heartbeat>")
    quiet = (hook == "UserPromptSubmit") & (beat | low.rlike("(?i)^<recommended_plugins>"))
    quiet = quiet | ((hook == "Stop") & (stop_hook | (beat & low.rlike(r"(?i)<decision>\s*DONT_NOTIFY\s*</decision>"))))
    return hook.isin(SIGNAL_HOOKS) & ~suggestion(hook, text) & ~quiet & ((hook != "PostCompact") | (low != ""))


def synthetic(text: Column) -> Column:
    """Whether a text is the host's own context, by its first tag."""
    head = F.regexp_replace(text, r"(?U)^\s+", "")
    out = F.lit(False)
    for tag in CONTEXT_TAGS:
        out = out | F.startswith(head, F.lit(tag))
    return out


def own_tool(tool: Column) -> Column:
    return F.coalesce(F.startswith(tool, F.lit(OWN_TOOLS)), F.lit(False))


def parent(hook: Column, v: Column, text: Column) -> Column:
    """The session that started this one: named in the payload, in its metadata, or in a delegating prompt."""
    prompt = F.regexp_replace(text, r"(?U)^\s+", "")
    named = F.regexp_extract(prompt, r"(?i)<source_thread_id>\s*([^<\s]+)\s*</source_thread_id>", 1)
    delegated = F.when((hook == "UserPromptSubmit") & prompt.rlike("^<[a-z]+_delegation>"), trimmed(named))
    return F.coalesce(string(v, "parent_session_id", "metadata.parent_thread_id", "metadata.source.subagent.thread_spawn.parent_thread_id"), delegated)
