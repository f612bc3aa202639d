"""Raw inputs to events, and what is read of payloads."""

import hashlib
import json

from threadlake.operators import normalize, sessions, summaries

SCHEMA = "raw string, hook_event string, ts string, seq long, env_cwd string, env_session_id string, repo_root string, git_branch string"
TS = "2026-01-01T00:00:00.000Z"


def events(spark, *raws, hook="UserPromptSubmit", session=None):
    return normalize.normalized(spark.createDataFrame([(r, hook, TS, i, "/here", session, None, "main") for i, r in enumerate(raws)], SCHEMA))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_and_envelope(spark):
    raws = ['{"session_id": " s1 ", "prompt": "hi", "cwd": "/w", "toolName": "t"}', '{"sessionId": "s2", "session_id": " "}', '{"conversationId": 5}', "[1, 2]", "no json: token=abc", '"text"']
    got = {r["seq"]: r for r in events(spark, *raws).collect()}
    assert [got[i]["session_id"] for i in (0, 1)] == ["s1", "s2"] and got[0]["cwd"] == "/w" and got[1]["cwd"] == "/here" and got[0]["tool_name"] == "t"
    for i in (2, 3, 4, 5):
        assert got[i]["session_id"] == "unknown-" + sha(f"UserPromptSubmit\0/here\0{sha(raws[i])}")[:12]
    for i, r in got.items():
        assert r["event_id"] == sha(f"UserPromptSubmit\0{r['session_id']}\0{TS}\0{sha(raws[i])}") and r["git_branch"] == "main" and r["raw_input_sha256"] == sha(raws[i])
    assert json.loads(got[3]["payload"]) == {"value": [1, 2]} and json.loads(got[5]["payload"]) == {"value": "text"}
    assert json.loads(got[4]["payload"]) == {"parse_error": True, "raw_preview": "no json: token=[REDACTED:secret]"}
    assert events(spark, "[]", session="env").first()["session_id"] == "env"


def test_payloads_and_metadata_are_sanitized(spark):
    r = events(spark, '{"session_id": "token=abc", "password": "x", "prompt": "ok"}').first()
    assert json.loads(r["payload"])["password"] == "[REDACTED:secret]" and r["session_id"] == "token=[REDACTED:secret]"
    assert {x["path"] for x in r["redactions"]} == {"$.password", "$.session_id"}


def test_a_note_is_an_event_like_any_other(spark):
    e = normalize.read_payload(normalize.normalized(normalize.note(spark, "s", "/c", " remember this ", TS)))
    r = e.first()
    assert (r["hook_event"], r["session_id"], r["cwd"], r["text"], r["is_source"]) == ("Note", "s", "/c", "remember this", True)


def read(spark, hook, payload, tool=None):
    df = spark.createDataFrame([("e", "s", TS, 0, hook, "/c", None, None, tool, json.dumps(payload))], "event_id string, session_id string, ts string, seq long, hook_event string, cwd string, repo_root string, git_branch string, tool_name string, payload string")
    return normalize.read_payload(df).first()


def test_which_events_say_something(spark):
    ask = "# Overview  Generate 0 to 3 hyperpersonalized suggestions for what this user can do with it now"
    cases = [
        ("UserPromptSubmit", {"prompt": "hi"}, True), ("UserPromptSubmit", {"message": "hi", "prompt": 5}, True), ("UserPromptSubmit", {"prompt": "<HEARTBEAT> x"}, False),
        ("UserPromptSubmit", {"prompt": "<recommended_plugins>"}, False), ("UserPromptSubmit", {"prompt": ask}, False), ("Stop", {"last_assistant_message": "done"}, True),
        ("Stop", {"last_assistant_message": "done", "stop_hook_active": True}, False), ("Stop", {"last_assistant_message": "done", "stop_hook_active": "true"}, True),
        ("Stop", {"summary": "<heartbeat> a <decision> DONT_NOTIFY </decision>"}, False), ("Stop", {"summary": "<heartbeat> a <decision>NOTIFY</decision>"}, True),
        ("Stop", {"summary": '{"suggestions": []}'}, False), ("Stop", {"summary": '{"suggestions": [], "more": 1}'}, True), ("Stop", {"summary": '{"suggestions": 1}'}, True),
        ("PostCompact", {}, False), ("PostCompact", {"reason": "full"}, True), ("PreCompact", {}, True), ("Note", {"text": "n"}, True), ("PreToolUse", {"prompt": "x"}, False),
    ]
    for hook, payload, want in cases:
        r = read(spark, hook, payload)
        assert r["is_source"] == want, (hook, payload)
        assert r["is_suggestion"] == (payload in ({"prompt": ask}, {"summary": '{"suggestions": []}'}))
    assert not read(spark, "Stop", {"summary": "x"}, "mcp__threadlake__search")["is_indexed"]


def test_parents_and_counters(spark):
    assert read(spark, "Stop", {"metadata": {"source": {"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}}})["parent_session_id"] == "p"
    assert read(spark, "UserPromptSubmit", {"prompt": " <host_delegation>\n<source_thread_id> q </source_thread_id>"})["parent_session_id"] == "q"
    assert read(spark, "Stop", {"summary": "<host_delegation><source_thread_id>q</source_thread_id>"})["parent_session_id"] is None
    r = read(spark, "Stop", {"usage": {"input_token_count": 3, "output_token_count": -1, "total_token_count": "7", "cached_input_token_count": 2.0}})
    assert (r["total_input_tokens"], r["output_tokens"], r["total_tokens"], r["cached_input_tokens"]) == (3, None, None, 2)


def test_session_summary_of_a_small_session(spark):
    said = [("UserPromptSubmit", {"prompt": "Please fix   the cache-key bug 42"}), ("PreToolUse", {"tool_name": "shell"}), ("Stop", {"summary": "Fixed cache-key"}), ("UserPromptSubmit", {"prompt": "<heartbeat>"}), ("Note", {"note": "remember zebra"})]
    rows = [(f"e{i}", "s", f"2026-01-01T00:00:0{i}.000Z", i, h, f"/c{i}", None, None, None, json.dumps(p)) for i, (h, p) in enumerate(said)]
    e = normalize.read_payload(spark.createDataFrame(rows, "event_id string, session_id string, ts string, seq long, hook_event string, cwd string, repo_root string, git_branch string, tool_name string, payload string"))
    r = summaries.session_summaries(e.withColumn("tool_name", e.tool_name)).first()
    assert r["title"] == "fix the cache-key bug 42" and r["overview"] == "User focus: remember zebra Latest outcome: Fixed cache-key"
    assert r["key_prompts"] == ["Please fix the cache-key bug 42", "remember zebra"] and r["outcomes"] == ["Fixed cache-key"] and r["source_event_ids"] == ["e0", "e2", "e4"]
    assert r["topics"][0] == "cache-key" and r["cwd"] == "/c4" and sessions.has_event(e, "e3") and not sessions.has_event(e, "zz")
