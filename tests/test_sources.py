"""Logs and transcripts read from files, and payloads stored apart."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlake.operators import context, files, normalize, overflow
from threadlake.sources import log, transcripts
from threadlake.storage import written


def event(i, **more):
    return {"schema_version": 1, "event_id": f"e{i}", "timestamp": f"2026-01-01T00:00:0{i}.000Z", "hook_event": "Note", "session_id": "s", "cwd": "/c", "payload": {"note": f"n{i}"}, **more}


def test_log_lines_places_and_quarantine(spark, tmp_path):
    good = [json.dumps(event(i)) for i in range(4)]
    bad = ["no json", json.dumps(event(5, schema_version=2)), json.dumps({**event(6), "payload": [1]}), json.dumps({**event(7), "session_id": None})]
    (tmp_path / "a.jsonl").write_text("\n".join([good[0], "", bad[0], good[1] + "\r", *bad[1:]]) + "\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(good[2:]))
    events, malformed = log.read_log(spark, str(tmp_path))
    assert sorted(r["event_id"] for r in events.collect()) == ["e0", "e1", "e2", "e3"] and malformed.count() == 4
    assert {(r["segment"], r["events"], r["malformed"]) for r in log.log_stats(events, malformed).collect()} == {("a.jsonl", 2, 4), ("b.jsonl.gz", 2, 0)}
    lines = log.read_lines(spark, str(tmp_path / "a.jsonl"))
    rows = lines.orderBy("line_no").collect()
    data = (tmp_path / "a.jsonl").read_bytes()
    assert [r["line_no"] for r in rows] == list(range(7)) and all(data[r["byte_offset"] :].startswith(r["line"].encode()) for r in rows)
    assert log.at(lines, rows[0]["segment"], 3).first()["event_id"] == "e1"
    log.quarantine(malformed, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    assert {r["compressed"]: r["segments"] for r in log.storage_stats(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")).collect()} == {False: 1, True: 1}
    log.append_log(events.drop("segment"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


UUID = "0123abcd-0000-4000-8000-0123456789ab"


def records():
    say = lambda kind, text, **k: {"type": "event_msg", "payload": {"type": kind, "message": text}, **k}
    item = lambda role, text: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"text": text}, {"image": 1}]}}
    out = [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/a", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "p0"}}}}},
        {"type": "turn_context", "payload": {"turn_id": "t1"}},
        {"type": "turn_context", "payload": {"model": "m", "effort": "high", "repoRoot": "/r", "git_branch": "dev"}},
        say("user_message", "hello"), item("user", "hello"), item("user", "hello"), say("agent_message", "hi"), item("assistant", "hi"),
        item("user", "<environment_context>x"), item("developer", "rules"), say("user_message", "  "),
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": "{\"a\": 1}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "done"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5, "total_tokens": 9}}}},
        {"type": "compacted", "payload": {"message": "short"}}, {"type": "compacted", "payload": {}}, {"type": "other"},
        {"type": "session_meta", "payload": {"id": "s2"}}, say("user_message", "hello"),
    ]
    return [{"timestamp": f"2026-01-01T00:00:{i:02d}Z", **r} for i, r in enumerate(out)]


def test_transcripts_become_events(spark, tmp_path):
    (tmp_path / "d").mkdir()
    rows = [json.dumps(r) for r in records()]
    (tmp_path / "d" / "one.jsonl").write_text("\n".join([*rows[:5], "broken", "[1]", json.dumps({"type": "x", "timestamp": "never"}), "", *rows[5:]]))
    (tmp_path / f"rollout-{UUID}.jsonl").write_text("\n".join([json.dumps({"type": "event_msg", "timestamp": "2026-01-02T00:00:00Z", "payload": {"type": "user_message", "message": "own"}}), json.dumps({"type": "session_meta", "payload": {"id": "foreign"}}), rows[3]]))
    (tmp_path / "skip.txt").write_text("x")
    inputs, good, errors = transcripts.inputs_of(spark, str(tmp_path), "/here")
    e = written(normalize.read_payload(normalize.normalized(inputs)))
    got = [(r["session_id"], r["hook_event"], r["text"]) for r in e.orderBy("ts", "seq").collect()]
    want = [
        ("s1", "SessionStart", ""), ("s1", "TurnContext", ""), ("s1", "UserPromptSubmit", "hello"), ("s1", "UserPromptSubmit", "hello"), ("s1", "Stop", "hi"),
        ("s1", "PreToolUse", ""), ("s1", "PostToolUse", ""), ("s1", "TokenCount", ""), ("s1", "PostCompact", "short"), ("s2", "SessionStart", ""), ("s2", "UserPromptSubmit", "hello"),
        (UUID, "UserPromptSubmit", "own"),
    ]
    assert got == want
    by = {r["hook_event"]: r for r in e.where("session_id = 's1'").collect()}
    assert by["SessionStart"]["parent_session_id"] == "p0" and by["TurnContext"]["model"] == "m" and by["TurnContext"]["reasoning_effort"] == "high"
    assert by["PreToolUse"]["tool_name"] == "shell" and by["PreToolUse"]["tool_use_id"] == by["PostToolUse"]["tool_use_id"] == "c1" and by["TokenCount"]["total_tokens"] == 9
    assert by["Stop"]["turn_id"] == "t1" and by["Stop"]["repo_root"] == "/r" and by["Stop"]["git_branch"] == "dev" and by["Stop"]["cwd"] == "/a"
    late = e.where("session_id = 's2' and hook_event = 'UserPromptSubmit'").first()
    assert (late["turn_id"], late["repo_root"], late["cwd"]) == (None, None, "/here")
    assert sorted(r["error"] for r in errors.collect()) == ["invalid timestamp", "no JSON", "record is not an object"]
    r = transcripts.report(e, good, errors, e.limit(3)).first()
    assert (r["files_scanned"], r["events_importable"], r["events_imported"], r["events_skipped_duplicate"], r["errors"]) == (2, 12, 9, 3, 3)
    assert r["records_skipped"] == r["records_read"] - 12


def test_overflow_round_trip(spark, tmp_path):
    big = json.dumps({"text": "é" * 400})
    rows = [("e1", "s", "t", big, 900), ("e2", "s", "t", "{}", None), ("e3", "s", "t", big, None)]
    e = spark.createDataFrame(rows, "event_id string, session_id string, ts string, payload string, original_bytes long")
    small, blobs = overflow.split_off(e, str(tmp_path / "o"), 500)
    assert blobs.count() == 1
    overflow.write(blobs, str(tmp_path / "o"))
    refs = normalize.overflow_refs(small)
    got = {r["observed_event_id"]: r for r in overflow.read(spark, str(tmp_path / "o"), refs).collect()}
    assert set(got) == {"e1", "e3"} and got["e1"]["content"] == big and got["e1"]["byte_count"] == 900 and got["e3"]["byte_count"] == len(big.encode())
    assert overflow.read(spark, str(tmp_path / "o"), refs.withColumn("sanitized_byte_count", F.lit(1).cast("long"))).where("content is not null").count() == 0
    broken = small.withColumn("payload", F.regexp_replace("payload", '"sha256":"..', '"sha256":"zz'))
    assert normalize.overflow_refs(broken).count() == 0 and overflow.orphans(blobs, refs).count() == 0 and overflow.orphans(blobs, refs.limit(0)).count() == 1


@pytest.mark.parametrize(("offset", "most"), [(0, 4), (1, 5), (3, 7), (9, 64), (100, 4)])
def test_overflow_pages_are_whole_characters(spark, offset, most):
    text = "aé你😀b"
    data = text.encode()
    p = spark.createDataFrame([(text,)], "t string").select(overflow.page(F.col("t"), offset, most)).first()[0]
    whole = [len(text[:i].encode()) for i in range(len(text) + 1)]
    start = min((x for x in whole if x >= offset), default=len(data))
    end = max(x for x in whole if x <= min(start + most, len(data)))
    assert (p["offset"], p["content"], p["next_offset"]) == (start, data[start:end].decode(), end if end < len(data) else None)


def test_blobs_that_nothing_refers_to_are_deleted(spark, tmp_path):
    texts = [json.dumps({"text": f"{i} " * 300}) for i in range(40)]
    e = spark.createDataFrame([(f"e{i}", "s", f"t{i:02d}", t, None) for i, t in enumerate(texts)], "event_id string, session_id string, ts string, payload string, original_bytes long")
    folder = str(tmp_path / "o")
    small, blobs = overflow.split_off(e, folder, 500)
    overflow.write(blobs, folder)
    refs = normalize.overflow_refs(small)
    some = written(refs.where("ts < 't15'"))
    assert overflow.expire(spark, folder, refs) == 0 and overflow.expire(spark, folder, some) == 25 and overflow.expire(spark, folder, some) == 0
    assert sorted(r["content"] for r in overflow.read(spark, folder, some).collect()) == sorted(texts[:15])
    assert spark.read.parquet(folder).count() == 15
    m = context.Memory(e, e, e, e, overflow=some)
    first = some.where("observed_event_id = 'e3'").first()
    page = context.describe(m, file_id=first["file_ref_id"], blobs=folder, offset=10, most=20).first()
    assert (page["target"], page["observed_event_id"], page["content"], page["next_offset"]) == ("overflow_ref", "e3", texts[3][10:30], 30)
    for missing in ("overflow:" + "0" * 64, "file:none"):
        with pytest.raises(LookupError):
            context.describe(m, file_id=missing, blobs=folder)


def test_contents_are_found_in_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 100)
    payloads = [json.dumps({"path": f"/a/{i}.md", "text": "x" * i}) for i in range(60)] + [None, "{}"]
    batch = pa.record_batch({"session_id": ["s"] * 62, "event_id": [f"e{i}" for i in range(62)], "ts": ["t"] * 62, "payload": payloads})
    out = list(files._find(10)(iter([batch, batch.slice(0, 0)])))
    assert [b.column("content")[0].as_py() for b in out if b.num_rows == 1][-1] == "x" * 59 and len(out) > 30
    assert [n for b in out for n in b.column("byte_count").to_pylist()] == list(range(10, 60))
