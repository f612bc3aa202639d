"""The stored memory: events, sessions, summary tree, session summaries and search index, kept up by batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import context, postings, rank, sessions, summaries, upkeep
from threadlake.storage import exists, put, scratch, sized, unique, written

#: Folders that a store deals sessions to, and up to how many touched ones are named in a read.
BUCKETS = 16
_COMMITS = "number long, batch string, name string, schema string, kind string"


class Table:
    """A keyed table of batches: rows are appended, or removed by their keys; what commit() does not name is not read."""

    def __init__(self, store: Store, name: str, key: str):
        self.store, self.name, self.key = store, name, key
        self._pending: list[tuple[str, str]] = []

    def _parts(self, kind: str) -> list:
        return [r for r in self.store.commits if r.name == self.name and r.kind == kind]

    def _read(self, kind: str) -> DataFrame | None:
        parts = self._parts(kind)
        if not parts:
            return None
        frames = self.store.spark.read.schema(f"{parts[-1].schema}, number long, bucket int").option("basePath", f"{self.store.path}/{self.name}-{kind}")
        return frames.parquet(*[f"{self.store.path}/{self.name}-{kind}/number={r.number}/batch={r.batch}" for r in parts]).drop("batch")

    def rows(self, touched: DataFrame | None = None) -> DataFrame | None:
        """The live rows; those of touched sessions (session_id) are read from their folders alone. None before the first batch."""
        rows = self._read("rows")
        if rows is None:
            return None
        gone = self._read("removed")
        if touched is not None:
            buckets = [r[0] for r in touched.select(self.store.bucket(F.col("session_id"))).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets)).join(sized(touched, 60), "session_id", "left_semi")
            gone = gone.where(F.col("bucket").isin(buckets)) if gone is not None else None
        if gone is not None:  # a key that was removed may have come again later
            gone = gone.groupBy(self.key).agg(F.max("number").alias("__gone"))
            rows = rows.join(gone, self.key, "left").where("__gone is null or number >= __gone").drop("__gone")
        return rows.drop("number", "bucket")

    def append(self, rows: DataFrame, kind: str = "rows") -> None:
        """Write rows, which have session_id, for the batch that is open."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        out = rows.withColumn("bucket", self.store.bucket(F.col("session_id")))
        put(out, f"{self.store.path}/{self.name}-{kind}/number={self.store.number}/batch={self.store.batch}", "bucket")
        self._pending.append((kind, schema))

    def remove(self, keys: DataFrame) -> None:
        """Remove rows by keys (key, session_id); rows appended in the same batch stay."""
        self.append(keys.select(*dict.fromkeys([self.key, "session_id"])), "removed")


class Store:
    """The memory in a folder: ingest() brings events in, memory() reads what is there.

    A batch is written table by table and counts from its commit on; events that are there already, by their
    ids, are passed over, so a batch that failed or came twice can be given again. Work on a batch is that
    on its sessions: they are rolled up and summarized again, and of their trees only what follows the first
    changed place is made again and replaces what stood there. A store that is not `indexed` as it goes
    leaves it to index_all() to bring into the index what searches are to find.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, indexed: bool = True):
        self.spark, self.path, self.buckets, self.indexed = spark, path.rstrip("/"), buckets, indexed
        keys = {"events": "event_id", "sessions": "session_id", "nodes": "node_id", "summaries": "session_id", "shortened": "session_id"}
        self.tables = {name: Table(self, name, key) for name, key in keys.items()}
        self.events, self.sessions, self.nodes, self.summaries, self.shortened = self.tables.values()
        self.index = postings.Index(spark, f"{self.path}/index", buckets)
        self._open()

    def _open(self) -> None:
        at = f"{self.path}/commits"
        self.commits = sorted(self.spark.read.schema(_COMMITS).parquet(at).collect()) if exists(self.spark, at) else []  # a few for each batch
        self.number, self.batch = max((r.number for r in self.commits), default=-1) + 1, uuid.uuid4().hex

    def bucket(self, session: Column) -> Column:
        return F.pmod(F.crc32(session.cast("binary")), F.lit(self.buckets)).cast("int")

    def _commit(self) -> None:
        rows = [(self.number, self.batch, t.name, schema, kind) for t in self.tables.values() for kind, schema in t._pending]
        put(self.spark.createDataFrame(rows, _COMMITS).coalesce(1), f"{self.path}/commits", mode="append")
        for t in self.tables.values():
            t._pending.clear()
        self._open()

    def ingest(self, events: DataFrame) -> dict[str, int]:
        """Bring in the events that are new; returns how many events, sessions and nodes were written and removed."""
        with scratch(self.spark):
            return self._ingest(events)

    def _ingest(self, events: DataFrame) -> dict[str, int]:
        given = written(events, "given")
        new = unique(given, "event_id")
        if self.commits:
            near = written(given.select("session_id").distinct(), "near")
            new = new.join(self.events.rows(near).select("event_id"), "event_id", "left_anti")
        new = given if new is given else written(new, "new")
        touched = written(new.select("session_id").distinct(), "touched")
        if touched.isEmpty():
            return {"events": 0, "sessions": 0, "nodes": 0, "removed_nodes": 0}
        old = self.events.rows(touched)
        whole = new if old is None else written(old.unionByName(new), "whole")
        before, parts = self.nodes.rows(touched), None
        if before is None:
            parts = summaries.parts_said(whole)
            made, gone = written(summaries.dag(whole, parts=parts), "tree"), None
        else:
            before = written(before, "before")
            first = summaries.changed_from(whole, new)
            short = self.shortened.rows(touched)
            if short is not None:  # the stored tree counts events that are gone: it is made again from its first leaf
                first = first.unionByName(short.select("session_id", F.lit(0).cast("long").alias("chunk"))).groupBy("session_id").agg(F.min("chunk").alias("chunk"))
                self.shortened.remove(touched)
            first = written(first, "first")
            made = written(summaries.renewed(whole, first, before), "renewed")
            stood = written(summaries.replaced(before, sized(first)), "stood")
            gone = written(stood.join(made.select("node_id"), "node_id", "left_anti"), "gone")
            made = written(made.join(stood.select("node_id"), "node_id", "left_anti"), "made")
        said = written(summaries.session_summaries(whole, True, parts), "said")
        rolled = written(sessions.rollup(whole), "rolled")
        self.events.append(new)
        if old is not None:
            for table in (self.sessions, self.summaries):
                table.remove(touched)
            self.nodes.remove(gone)
            old_docs = gone.select(F.lit("summary_node").alias("kind"), F.col("node_id").alias("key"))
            self.index.remove(old_docs.unionByName(touched.select(F.lit("session_summary").alias("kind"), F.col("session_id").alias("key"))))
        self.sessions.append(rolled)
        self.nodes.append(made)
        self.summaries.append(said)
        if self.indexed:
            self._index(new, made, said)
        self._commit()
        return {"events": new.count(), "sessions": touched.count(), "nodes": made.count(), "removed_nodes": gone.count() if gone is not None else 0}

    def _index(self, events: DataFrame, nodes: DataFrame, said: DataFrame) -> None:
        self.index.add(rank.index_rows(events if "is_source" in events.columns else summaries.sources(events), nodes, said))

    def index_all(self) -> None:
        """Bring into the index what the store holds and the index has not."""
        if self.commits:
            self._index(self.events.rows(), self.nodes.rows(), self.summaries.rows())

    def expire(self, before: str, cap: int) -> int:
        """Remove the events of closed segments (of `cap` bytes of a session's log) whose last event is older than `before`, and what the index has of them.

        Sessions, summaries and nodes stay until new events come to their session. Returns how many went.
        """
        rows = self.events.rows()
        stay = upkeep.expire(rows, upkeep.segments(rows, cap), before)
        gone = written(rows.join(stay.select("event_id"), "event_id", "left_anti").select("event_id", "session_id"), "gone")
        if gone.isEmpty():
            return 0
        self.index.remove(gone.select(F.lit("event").alias("kind"), F.col("event_id").alias("key")))
        self.events.remove(gone)
        self.shortened.append(gone.select("session_id").distinct())
        self._commit()
        return gone.count()

    def forget(self, keys: DataFrame) -> int:
        """Remove events (event_id, session_id) as though they had never come; returns how many went.

        Their sessions are rolled up and summarized again from what is left; a session with nothing left goes
        whole. Keys that are not there, and repeated ones, change nothing.
        """
        if not self.commits:
            return 0
        touched = written(keys.select("session_id").distinct(), "touched")
        stood = self.events.rows(touched)
        gone = written(stood.join(keys.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "session_id"), "gone")
        touched = written(gone.select("session_id").distinct(), "touched")
        if touched.isEmpty():
            return 0
        left = written(stood.join(touched, "session_id", "left_semi").join(gone.select("event_id"), "event_id", "left_anti"), "left")
        self._derive(touched, left, gone)
        return gone.count()

    def clean_up(self, most: int | None = None) -> int:
        """Derive anew what the store has of sessions whose summaries or nodes are missing or of an older version; returns how many sessions.

        `most` bounds the sessions of one call, those of the latest events first; calling again until none is left does them all.
        """
        m = self.memory()
        rows = summaries.cleanup_candidates(m.events, m.sessions, m.summaries, m.nodes)
        rows = rows if most is None else rows.orderBy(F.desc("last_seen"), "session_id").limit(most)
        touched = written(rows.select("session_id"), "touched")
        if touched.isEmpty():
            return 0
        self._derive(touched, written(self.events.rows(touched), "whole"), None)
        return touched.count()

    def _derive(self, touched: DataFrame, whole: DataFrame, gone: DataFrame | None) -> None:
        """Replace all that is derived of touched sessions by what their whole events give, and remove the events that are gone."""
        before = written(self.nodes.rows(touched), "before")
        parts, same = summaries.parts_said(whole), ["node_id", "summary_version"]
        made = written(summaries.dag(whole, parts=parts), "tree")
        old_nodes = written(before.join(made.select(*same), same, "left_anti"), "old_nodes")
        made = written(made.join(before.select(*same), same, "left_anti"), "made")
        said = written(summaries.session_summaries(whole, True, parts), "said")
        docs = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
        old_docs = docs(old_nodes, "summary_node", "node_id").unionByName(docs(touched, "session_summary", "session_id"))
        if gone is not None:
            old_docs = old_docs.unionByName(docs(gone, "event", "event_id"))
            self.events.remove(gone)
        self.index.remove(old_docs)
        if self.indexed:
            self.index.add(rank.index_rows(None, made, said))
        for table in (self.sessions, self.summaries, self.shortened):
            table.remove(touched)
        self.nodes.remove(old_nodes)
        self.sessions.append(written(sessions.rollup(whole), "rolled"))
        self.nodes.append(made)
        self.summaries.append(said)
        self._commit()

    def follow(self, events: DataFrame, checkpoint: str) -> None:
        """Bring in a stream of events, micro-batch by micro-batch, until its input is read; a batch that comes again changes nothing."""
        query = events.writeStream.foreachBatch(lambda batch, _id: self.ingest(batch) and None).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()

    def memory(self) -> context.Memory:
        """What is stored, to search, plan, pack and describe."""
        return context.Memory(self.events.rows(), self.sessions.rows(), self.nodes.rows(), self.summaries.rows(), self.index)
