"""Stateful streams against their batch twins, with events out of order over files, micro-batches and Arrow batches."""

import random

import pandas as pd
from pyspark.sql import functions as F

from threadlake.operators import store
from threadlake.streaming import ingest, signals

from .test_search import EVENT, memory


def events_of(spark, n):
    rng = random.Random(6)
    hooks = ["UserPromptSubmit", "PreToolUse", "PostToolUse", "Stop", "PreCompact", "PostCompact", "Note"]
    rows = []
    for i in range(n):
        hook = rng.choice(hooks)
        use = f"u{rng.randint(0, 9)}" if "Tool" in hook else None
        rows.append((f"e{i}", "hot" if rng.random() < 0.8 else f"s{i % 3}", f"2026-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}.000Z", i, hook, "/w", None, None, rng.choice(["pack", "x"]) if "Tool" in hook else None, None, use, f"text {i}", 1))
    return spark.createDataFrame(rows, EVENT)


def rows_of(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select("session_id", "event_id", "kind", "ref").collect())


def test_the_stream_gives_what_the_whole_table_gives(spark, tmp_path):
    events = events_of(spark, 500)
    # Each file has events of all times up to its own, so that many come late; the last one lets the watermark pass all.
    place = F.pmod(F.xxhash64("event_id"), F.lit(5))
    for i in range(5):
        events.where(place == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = events.limit(1).withColumns({"event_id": F.lit("end"), "session_id": F.lit("end"), "ts": F.lit("2030-01-01T00:00:00.000Z"), "hook_event": F.lit("Note")})
    end.write.mode("append").parquet(f"{tmp_path}/in")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        stream = signals.signals(ingest.open_stream(spark, events.schema, f"{tmp_path}/in", 1), "1 day")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got, want = rows_of(spark.read.schema(signals.SIGNALS).parquet(f"{tmp_path}/out")), rows_of(signals.signals_batch(events))
    assert {r[2] for r in want} == {"block", "directive", "tool_result", "checkpoint"} and got == want


def test_a_store_follows_a_stream(spark, tmp_path):
    events = events_of(spark, 120).where("hook_event in ('UserPromptSubmit', 'Stop', 'Note')")
    held = store.Store(spark, f"file://{tmp_path}/s", 2)
    for i in range(2):
        events.where(F.col("seq") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    held.follow(ingest.open_stream(spark, events.schema, f"{tmp_path}/in", 1), f"{tmp_path}/c")
    whole = memory(events)
    assert sorted(r.node_id for r in held.memory().nodes.collect()) == sorted(r.node_id for r in whole.nodes.collect())
    assert held.index.sizes["event"][0] == events.count()


def test_a_session_reaches_its_state_by_batches_not_by_events():
    made = []

    class State:
        def __init__(self):
            self.rows, self.values = [], {}

        def __getattr__(self, name):
            def call(*args):
                made.append(name)
                if name == "appendList":
                    self.rows += args[0]
                if name == "updateValue":
                    self.values[args[0]] = args[1]
                if name == "clear":
                    self.rows = []
                if name == "containsKey":
                    return args[0] in self.values
                return iter(list(self.rows)) if name == "get" else bool(self.rows)

            return call

    one = signals.Signals("PreCompact")
    one.waiting, one.calls, one.so_far, one.handle = State(), State(), State(), State()
    hooks = ["PreToolUse", "PostToolUse"]
    rows = [{"ts": f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z", "seq": i, "event_id": f"e{i}", "hook_event": hooks[i % 2], "tool_name": "t", "tool_use_id": "u"} for i in range(400)]
    list(one.handleInputRows(("s",), iter([pd.DataFrame(rows[200:]), pd.DataFrame(rows[:200])]), None))
    out = pd.concat(one.handleExpiredTimer(("s",), type("Times", (), {"getCurrentWatermarkInMs": lambda self: 1 << 60})(), None))
    assert list(out[out.kind == "tool_result"].ref) == [f"e{i}" for i in range(0, 400, 2)] and len(made) <= 12
