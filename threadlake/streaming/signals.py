"""What a session's events ask for and belong to, as a stream: recovery after compactions, tool results, checkpoints.

Events wait in the session's state until the watermark has passed them, and are then taken in the order of
time, whichever file, micro-batch or Arrow batch they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadlake.operators import graph
from threadlake.streaming.ingest import recovery_actions_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNALS = "session_id string, event_id string, kind string, ref string"
_FIELDS = ["event_id", "hook_event", "tool_name", "tool_use_id"]


def _ms(ts: str) -> int:
    return int(datetime.fromisoformat(ts.replace("Z", "+00:00")).astimezone(UTC).timestamp() * 1000)


class Signals(StatefulProcessor):
    """One session: events that wait, the latest call of each tool use, the position, and whether a compaction awaits a pack.

    Each reach into the state is a message to the JVM: events wait in a list that is added to once for each
    Arrow batch and read once for each timer, and of the calls one look-up and one change is made for each tool use.
    """

    def __init__(self, begins: str):
        self.begins = begins

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts string, seq long, " + ", ".join(f"{c} string" for c in _FIELDS))
        self.calls = handle.getMapState("calls", "tool_use_id string", "event_id string")
        self.so_far = handle.getValueState("so_far", "position long, pending boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = ""
        for pdf in rows:
            if len(pdf):
                fields = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in _FIELDS]
                self.waiting.appendList(list(zip(pdf["ts"], (int(n) for n in pdf["seq"]), *fields, strict=True)))
                last = max(last, pdf["ts"].max())
        if last:
            self.handle.registerTimer(_ms(last))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.waiting.exists():  # an earlier timer took all
            return
        due, left = {}, []
        for ts, seq, *fields in self.waiting.get():
            if _ms(ts) <= now:
                due[ts, seq] = fields  # of one place the last arrival counts
            else:
                left.append((ts, seq, *fields))
        if not due:
            return
        calls, called, out, position, pending = {}, set(), [], 0, False
        if self.so_far.exists():  # without it no call is stored either
            position, pending = self.so_far.get()
            uses = {use for _, hook, _, use in due.values() if use is not None and hook == "PostToolUse"}
            calls = {use: self.calls.getValue((use,))[0] for use in uses if self.calls.containsKey((use,))}
        for at in sorted(due):
            event, hook, tool, use = due[at]
            position += 1
            if position % graph.CHECKPOINT_EVERY == 0 or hook == "PreCompact":
                out.append((key[0], event, "checkpoint", str(position)))
            if hook == "PostToolUse" and use in calls:
                out.append((key[0], event, "tool_result", calls[use]))
            if use is not None and hook == "PreToolUse":
                calls[use] = event
                called.add(use)
            if pending and tool != "pack" and hook in ("UserPromptSubmit", "SessionStart", "PostToolUse", "Stop"):
                out.append((key[0], event, "block" if hook == "Stop" else "directive", None))
            pending = hook == self.begins or (pending and tool != "pack")
        for use in called:
            self.calls.updateValue((use,), (calls[use],))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self.so_far.update((position, pending))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "kind", "ref"])


def signals(events: DataFrame, late: str = "10 minutes", begins: str = "PostCompact") -> DataFrame:
    """SIGNALS of a stream of events, once the watermark, `late` behind the latest event, has passed each."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Pandas has no times before 1678 or after 2261.
    at = F.greatest(F.least(F.to_timestamp("ts"), F.lit("2261-01-01").cast("timestamp")), F.lit("1679-01-01").cast("timestamp"))
    rows = events.select("session_id", "ts", "seq", *_FIELDS).withColumn("at", at).withWatermark("at", late)
    return rows.groupBy("session_id").transformWithStateInPandas(Signals(begins), SIGNALS, "append", "EventTime")


def signals_batch(events: DataFrame, begins: str = "PostCompact") -> DataFrame:
    """The same of a whole table."""
    none = F.lit(None).cast("string")
    parts = [
        recovery_actions_batch(events, begins).select("session_id", "event_id", F.col("action").alias("kind"), none.alias("ref")),
        graph.tool_results(events).select("session_id", F.col("to_id").alias("event_id"), "kind", F.col("from_id").alias("ref")),
        graph.checkpoints(events).select("session_id", "event_id", F.lit("checkpoint").alias("kind"), F.col("position").cast("string").alias("ref")),
    ]
    return reduce(DataFrame.unionByName, parts)
