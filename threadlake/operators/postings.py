"""A stored full-text index of fielded documents of several kinds, and many queries over it in one plan.

A document is one row: its kind, its key, what filters and orders it, and the texts of its fields. A field's
tokens stand one after the other; no phrase reaches from one field into the next, and all fields count alike.

Postings are grouped by term and block, a range of 2 ** BLOCK_BITS document numbers, and stored in folders by
term, sorted by term and block. Beside each block's documents stand their count, the largest frequency and
the shortest length: these bound what any of them can score, and are read without the documents. A batch
counts from the moment its statistics are written, which is last; what a lost writer leaves is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.text import query_terms
from threadlake.operators.fts import K1, LEAST_IDF, B, marked_tokens, relaxed_phrases, strict_phrases, without_marks
from threadlake.storage import exists, put, scratch, sized, unique, written

BLOCK_BITS, SPAN_BITS = 7, 20
#: Blocks of a query and kind that are scored first, and terms or ranges up to which reads name them one by one.
FIRST_BLOCKS, LITERALS = 64, 500
#: From so many queries on, all of them are put to each range of 2 ** RANGE_BITS documents, instead of each one to its blocks.
MANY, RANGE_BITS = 32, 15
#: A batch's postings are made of so many slices of its documents at most, one after the other, of so many tokens at least: what is shuffled for a slice is gone before the next.
SLICES, SLICE_TOKENS = 16, 8_000_000
#: Tokens of a slice that one file of its postings has, more or less.
FILE_TOKENS = 4_000_000
#: The place of a range's documents among equal scores, in the column of phrases.
_ORDER = -1
ATTRIBUTES = "kind string, key string, session_id string, at string, depth int, sources long, source_tokens long, is_shown boolean, said string"
_STATS = "batch string, kind string, n long, total long, last long, removed boolean"
_BLOCKS = "kind string, term string, block long, n int, most int, least int, docs array<struct<doc:long,dl:int,positions:array<int>>>"
_BLOCK_TYPES = pa.schema(
    [("kind", pa.string()), ("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("least", pa.int32())]
    + [("docs", pa.list_(pa.struct([("doc", pa.int64()), ("dl", pa.int32()), ("positions", pa.list_(pa.int32()))])))]
)
_POSTINGS = f"{_BLOCKS}, batch string, bucket int"


def parse(queries: DataFrame) -> DataFrame:
    """(qid, every, phrase, place, term, length, phrases, terms) of queries (qid, query): the tokens of each tier's phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["qid", "every", "phrase", "place", "term", "length", "phrases", "terms"]
        for pdf in batches:
            out = []
            for qid, query in zip(pdf["qid"], pdf["query"], strict=True):
                strict, relaxed = (_distinct(f(query or "")) for f in (strict_phrases, relaxed_phrases))
                relaxed = [] if len(strict) < 2 and relaxed == strict else relaxed
                for every, phrases in ((True, strict), (False, relaxed)):
                    out += [(qid, every, i, j, t, len(p), len(phrases), query_terms(query)) for i, p in enumerate(phrases) for j, t in enumerate(p)]
            yield pd.DataFrame(out, columns=names)

    return queries.select("qid", "query").mapInPandas(run, "qid long, every boolean, phrase int, place int, term string, length int, phrases int, terms array<string>")


def _distinct(phrases: list[list[str]]) -> list[list[str]]:
    return [p for i, p in enumerate(phrases) if p not in phrases[:i]]


def _block(table: pa.Table) -> pa.Table:
    """The terms of one block's documents (kind, doc, dl, each field's tokens as one text, block) as _BLOCKS; one place is left free after each field, so that no phrase leaves it."""
    batch = table.combine_chunks().to_batches()[0]
    rows = batch.num_rows
    kind = batch.column("kind").dictionary_encode()
    doc = batch.column("doc").to_numpy()
    kinds = kind.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((doc, kinds))
    if (np.diff(order) != 1).any():
        batch, doc, kinds = batch.take(pa.array(order)), doc[order], kinds[order]
    field_row = pc.list_parent_indices(batch.column("tokens")).to_numpy()
    fields = pc.split_pattern(batch.column("tokens").flatten(), " ")
    words, word_field = fields.flatten(), pc.list_parent_indices(fields).to_numpy()
    some = pc.not_equal(words, "")  # what an empty field is split into
    words, word_field = words.filter(some), word_field[some.to_numpy(zero_copy_only=False)]
    if not len(words):
        return pa.table({n: [] for n in _BLOCK_TYPES.names}, _BLOCK_TYPES)
    row = field_row[word_field]
    before = [np.concatenate(([0], np.cumsum(np.bincount(r, minlength=rows))[:-1])) for r in (row, field_row)]
    place = np.arange(len(words)) + word_field - (before[0] + before[1])[row]
    words = words.dictionary_encode()
    plain = pa.array([without_marks(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    terms, term = plain.dictionary, plain.indices.to_numpy()[words.indices.to_numpy()]
    key = kinds[row].astype(np.int64) * len(terms) + term
    order = np.argsort(key, kind="stable")  # within a term rows and places stay in order
    key, row, place = key[order], row[order], place[order]
    at = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(row) != 0))))  # a document's first place of a term
    ends, key, row = np.append(at, len(place)), key[at], row[at]
    first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))  # a block's first document of a term
    lengths = batch.column("dl").to_numpy()[row]
    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
    docs = pa.StructArray.from_arrays([pa.array(doc[row]), pa.array(lengths, pa.int32()), places], ["doc", "dl", "positions"])
    columns = {
        "kind": kind.dictionary.take(pa.array(kinds[row[first]])), "term": terms.take(pa.array(key[first] % len(terms))), "block": pa.array(doc[row[first]] >> BLOCK_BITS),
        "n": pa.array(np.diff(np.append(first, len(row))), pa.int32()), "most": pa.array(np.maximum.reduceat(np.diff(ends), first), pa.int32()), "least": pa.array(np.minimum.reduceat(lengths, first), pa.int32()),
        "docs": pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), docs),
    }
    return pa.Table.from_pydict(columns, _BLOCK_TYPES)


class Index:
    """The index in a folder. `buckets` folders hold the terms of each batch; it must stay the same for one index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._read_stats()

    def _read_stats(self) -> None:
        at = f"{self.path}/stats"
        rows = self.spark.read.schema(_STATS).parquet(at).collect() if exists(self.spark, at) else []  # a few for each batch
        self._batches = {removed: sorted({r.batch for r in rows if r.removed == removed}) for removed in (False, True)}
        self._last = max((r["last"] for r in rows), default=-1)
        self.sizes: dict[str, tuple[int, int]] = {}
        for r in rows:
            n, total = self.sizes.get(r.kind, (0, 0))
            sign = -1 if r.removed else 1
            self.sizes[r.kind] = (n + sign * r.n, total + sign * r.total)

    def _read(self, name: str, schema: str, removed: bool = False) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}" for b in self._batches[removed]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _commit(self, batch: str, rows: DataFrame, removed: bool) -> None:
        stats = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.max("doc").alias("last"))
        stats = stats.select(F.lit(batch).alias("batch"), "kind", "n", F.col("total").cast("long").alias("total"), "last", F.lit(removed).alias("removed"))
        put(stats.coalesce(1), f"{self.path}/stats", mode="append")  # a row for each kind
        self._read_stats()

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def documents(self) -> DataFrame:
        """All documents with their numbers and lengths, without those that were removed."""
        rows = self._read("documents", f"doc long, dl int, {ATTRIBUTES}, batch string, span long").drop("batch")
        return rows if not self._batches[True] else rows.join(sized(self.removed()), "doc", "left_anti")

    def removed(self) -> DataFrame:
        return self._read("removed", "doc long, batch string", True).select("doc")

    def add(self, docs: DataFrame) -> None:
        """Add those of docs (ATTRIBUTES and fields, an array of texts) as a batch whose kind and key the index does not have."""
        with scratch(self.spark):
            self._add(docs)

    def _add(self, docs: DataFrame) -> None:
        if self._batches[False]:
            docs = docs.join(self.documents().select("kind", "key"), ["kind", "key"], "left_anti")
        docs = unique(docs, "kind", "key")
        batch, base = uuid.uuid4().hex, (self._last >> 33) + 1 << 33
        names = [c.split()[0] for c in ATTRIBUTES.split(", ")]
        # A field that is what the document is shown by is neither shuffled nor stored twice.
        same, at = F.col("same"), ["kind", "session_id", "at", "key"]
        rows = docs.select(*names, "fields", F.coalesce(F.array_position("fields", F.col("said")), F.lit(0)).cast("int").alias("same"))
        rows = rows.withColumn("fields", F.transform("fields", lambda t, i: F.when(same != i + 1, t)))
        # Kinds apart and a session's documents near each other: blocks then bound what is alike.
        rows = rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("doc", F.monotonically_increasing_id() + base)
        fields = F.transform("fields", lambda t, i: F.when(same == i + 1, F.col("said")).otherwise(t))
        rows = rows.withColumn("dl", F.aggregate(fields, F.lit(0), lambda n, t: n + F.size(marked_tokens(t))))
        path = f"{self.path}/documents/batch={batch}"
        put(rows.withColumn("span", F.shiftright("doc", SPAN_BITS)), path, "span")
        rows = self.spark.read.schema(f"doc long, dl int, {ATTRIBUTES}, fields array<string>, same int, span long").parquet(path)
        # A text of tokens is shuffled and handed to Arrow faster than an array of them.
        tokens = F.transform(fields, lambda t: F.array_join(marked_tokens(t), " ")).alias("tokens")
        for first, last, n in self._slices(rows):
            some = rows.where(F.col("doc").between(first, last) & F.col("span").between(first >> SPAN_BITS, last >> SPAN_BITS))
            # A block's documents meet in one small group: each of its terms is made once.
            per_block = some.select("kind", "doc", "dl", tokens, F.shiftright("doc", BLOCK_BITS).alias("block")).groupBy("block").applyInArrow(_block, _BLOCKS)
            per_block = per_block.withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(-(-n // (self.buckets * FILE_TOKENS)))))
            out = per_block.sortWithinPartitions("bucket", "term", "block")
            put(out, f"{self.path}/postings/batch={batch}", "bucket", mode="append", **{"parquet.page.size": 1 << 16})
        self._commit(batch, rows, False)

    def _slices(self, rows: DataFrame) -> list[tuple[int, int, int]]:
        """First and last number of ranges of documents, about equal in tokens, and their tokens; each is some of the ranges in which rows were numbered, so that no block is in two."""
        parts = rows.groupBy(F.shiftright("doc", 33).alias("part")).agg(F.sum("dl").alias("n")).orderBy("part").collect()  # a row for each task of the write
        most = max(sum(r.n for r in parts) / SLICES, SLICE_TOKENS)
        out: list[tuple[int, int, int]] = []
        for r in parts:
            first, _, n = out.pop() if out and out[-1][2] + r.n <= most else (r.part << 33, 0, 0)
            out.append((first, (r.part + 1 << 33) - 1, n + max(r.n, 1)))
        return out

    def remove(self, keys: DataFrame) -> None:
        """Remove the documents of keys (kind, key); their numbers are noted, their postings stay until compact()."""
        gone = self.documents().select("kind", "key", "doc", "dl").join(keys.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
        gone, batch = written(gone, "gone"), uuid.uuid4().hex
        put(gone.select("doc"), f"{self.path}/removed/batch={batch}")
        self._commit(batch, gone, True)

    def _postings(self, terms: DataFrame, whole: bool, kind: str | None) -> DataFrame:
        """The blocks of some terms (term), with their documents or without; few terms are named in the read itself."""
        rows = self._read("postings", _POSTINGS)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        rows = rows if whole else rows.drop("docs")
        some = terms.select("term").distinct().limit(LITERALS + 1).collect()
        if len(some) <= LITERALS:
            of = self.spark.createDataFrame(some or [("",)], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect()
            return rows.where(F.col("bucket").isin([r.b for r in of]) & F.col("term").isin([r.term for r in some])).drop("bucket", "batch")
        return rows.join(terms.select("term").distinct(), "term", "left_semi").drop("bucket", "batch")

    def _hits(self, asked: DataFrame, blocks: DataFrame | None, kind: str | None) -> DataFrame:
        """(qid, kind, doc, dl, phrase, f) of asked's phrases, in some blocks (qid, kind, block) or in all."""
        rows = self._postings(asked, True, kind).join(sized(asked.select("qid", "phrase", "place", "term", "length"), 200), "term")
        if blocks is not None:
            rows = rows.join(sized(blocks.select("qid", "kind", "block"), 60), ["qid", "kind", "block"], "left_semi")
        rows = rows.select("qid", "kind", "phrase", "length", "place", F.explode("docs").alias("d"))
        rows = rows.select("qid", "kind", "phrase", "length", "d.doc", "d.dl", F.transform("d.positions", lambda p: p - F.col("place")).alias("starts"))
        if self._batches[True]:
            rows = rows.join(sized(self.removed()), "doc", "left_anti")
        keys = ["qid", "kind", "doc", "dl"]
        rows = rows.repartition("qid", "kind", "doc").groupBy(*keys, "phrase", "length").agg(F.collect_list("starts").alias("s"))
        rest = F.slice("s", F.lit(2), F.size("s"))
        f = F.when(F.size("s") == F.col("length"), F.size(F.aggregate(rest, F.get("s", 0), lambda a, x: F.array_intersect(a, x)))).otherwise(0)
        return rows.select(*keys, "phrase", f.alias("f")).where("f > 0")

    def _bounds(self, asked: DataFrame, kind: str | None) -> tuple[DataFrame, DataFrame]:
        """(qid, kind, phrase, idf), and (qid, kind, block, bound): blocks that may have a document of the tier."""
        per_term = self._postings(asked, False, kind).join(sized(asked, 200), "term")
        per_phrase = per_term.groupBy("qid", "phrase", "kind", "block", "length", "phrases", "every").agg(
            F.count(F.lit(1)).alias("have"), F.min("most").alias("most"), F.max("least").alias("least"), F.min("n").alias("n")
        )
        blocks = written(per_phrase.where("have = length"), "blocks")
        counts = blocks.where("length = 1").groupBy("qid", "kind", "phrase").agg(F.sum("n").alias("df"))
        long = asked.where("length > 1")
        if not long.isEmpty():  # a phrase's documents are known from the places of its tokens alone
            counts = counts.unionByName(self._hits(long, None, kind).groupBy("qid", "kind", "phrase").agg(F.count(F.lit(1)).alias("df")))
        if self._batches[True]:
            short = asked.where("length = 1")
            gone = self.removed().select("doc", F.shiftright("doc", BLOCK_BITS).alias("block"))
            held = self._postings(short, True, kind).join(sized(gone.select("block").distinct()), "block", "left_semi")
            held = held.join(sized(short, 200), "term").select("qid", "kind", "phrase", F.explode("docs").alias("d")).select("qid", "kind", "phrase", "d.doc")
            lost = held.join(sized(gone.select("doc")), "doc", "left_semi").groupBy("qid", "kind", "phrase").agg((-F.count(F.lit(1))).alias("df"))
            counts = counts.unionByName(lost).groupBy("qid", "kind", "phrase").agg(F.sum("df").alias("df"))
        idf = written(counts.select("qid", "kind", "phrase", self._idf().alias("idf")), "idf")
        part = F.col("idf") * _weight(F.col("most"), F.col("least"), self._mean())
        bounds = blocks.join(sized(idf, 60), ["qid", "kind", "phrase"]).groupBy("qid", "kind", "block").agg(
            F.sum(part).alias("bound"), F.count(F.lit(1)).alias("have"), F.max("phrases").alias("phrases"), F.max("every").alias("every")
        )
        return idf, bounds.where("not every or have = phrases").select("qid", "kind", "block", "bound")

    def _idf(self) -> Column:
        """What a phrase weighs that df documents of a kind have."""
        idf = F.log((self._of_kind(lambda s: float(s[0])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return F.when(idf <= 0, LEAST_IDF).otherwise(idf)

    def _mean(self) -> Column:
        return self._of_kind(lambda s: max(s[1], 1) / max(s[0], 1))

    def _of_kind(self, value) -> Column:
        out = F.lit(0.0)
        for kind, size in self.sizes.items():
            out = F.when(F.col("kind") == kind, F.lit(float(value(size)))).otherwise(out)
        return out

    def _scored(self, asked: DataFrame, idf: DataFrame, blocks: DataFrame | None, kind: str | None) -> DataFrame:
        """(qid, kind, doc, gain) of the tier's documents in some blocks."""
        mean = self._mean()
        rows = self._hits(asked, blocks, kind).join(sized(idf, 60), ["qid", "kind", "phrase"])
        rows = rows.groupBy("qid", "kind", "doc").agg(F.sum(F.col("idf") * _weight(F.col("f"), F.col("dl"), mean)).alias("gain"), F.count(F.lit(1)).alias("have"))
        need = asked.groupBy("qid").agg(F.max(F.when(F.col("every"), F.col("phrases")).otherwise(1)).alias("need"))
        rows = rows.join(sized(written(need, "need"), 16), "qid").where("have >= need")
        return rows.select("qid", "kind", "doc", "gain")

    def _with_attributes(self, rows: DataFrame) -> DataFrame:
        """rows (doc) with their documents' attributes; few ranges of numbers are named in the read itself."""
        docs = self._read("documents", f"doc long, dl int, {ATTRIBUTES}, batch string, span long")
        spans = rows.select(F.shiftright("doc", SPAN_BITS).alias("span")).distinct().limit(LITERALS + 1).collect()
        if len(spans) <= LITERALS:
            docs = docs.where(F.col("span").isin([r.span for r in spans]))
        few = rows.select("doc").distinct().limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            docs = docs.where(F.col("doc").isin([r.doc for r in few]))
        return docs.drop("dl", "batch", "span", "kind", "said").join(sized(rows, 60), "doc")

    def texts(self, rows: DataFrame) -> DataFrame:
        """Written rows (doc) with said, what their documents are shown by; best dropped before rows are shuffled again."""
        return self._read("documents", f"doc long, dl int, {ATTRIBUTES}, batch string, span long").select("doc", "said").join(sized(rows, 400), "doc")

    def _best_in_ranges(self, asked: DataFrame, k: int, wanted: DataFrame | None, kind: str | None) -> DataFrame:
        """(qid, kind, doc, gain): each query's best documents in each range of each kind, k and those that may equal the k-th at most.

        The postings of all words that any query has are dealt by ranges of documents once, however many
        queries have them, and every range gets all queries; the best of a range alone are shuffled further.
        """
        own = asked.groupBy("qid", "every", "phrases", "phrase").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("w"))
        own = written(own.withColumn("words", F.array_join(F.transform("w", lambda x: x["term"]), " ")).drop("w"), "own")
        phrases = written(own.select("words").distinct().withColumn("pid", F.monotonically_increasing_id()), "phrases")
        range_of = lambda doc: F.shiftright(doc, RANGE_BITS).alias("range")
        hit = F.struct(F.col("doc"), F.col("dl").cast("int").alias("dl"), F.col("f").cast("int").alias("f"))

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.groupBy("kind", "pid", range_of(F.col("doc"))).agg(F.collect_list(hit).alias("docs"))

        single = self._read("postings", _POSTINGS)
        single = single if kind is None else single.where(F.col("kind") == kind)
        single = single.join(sized(phrases.withColumnRenamed("words", "term"), 60), "term")
        counted = F.transform("docs", lambda d: F.struct(d["doc"].alias("doc"), d["dl"].alias("dl"), F.size(d["positions"]).alias("f")))
        rows = single.select("kind", "pid", F.shiftright("block", RANGE_BITS - BLOCK_BITS).alias("range"), counted.alias("docs"))
        if self._batches[True]:
            rows = dealt(rows.select("kind", "pid", F.inline("docs")).join(sized(self.removed()), "doc", "left_anti"))
        long = phrases.where("contains(words, ' ')")
        if not long.isEmpty():
            words = F.split("words", " ")
            parts = long.select(F.col("pid").alias("qid"), F.lit(0).alias("phrase"), F.size(words).alias("length"), F.posexplode(words).alias("place", "term"))
            rows = rows.unionByName(dealt(self._hits(written(parts, "parts"), None, kind).withColumnRenamed("qid", "pid")))
        rows = written(rows, "postings")
        df = rows.groupBy("kind", "pid").agg(F.sum(F.size("docs")).alias("df"))
        idf = written(df.select("kind", "pid", self._idf().alias("idf")), "idf")
        rows = rows.join(sized(idf, 40), ["kind", "pid"]).withColumn("mean", self._mean())
        docs = self.documents()
        docs = docs if kind is None else docs.where(F.col("kind") == kind)
        docs = docs if wanted is None else docs.join(wanted, wanted.columns, "left_semi")
        at = Window.partitionBy("kind", range_of(F.col("doc"))).orderBy(F.desc("depth"), F.desc("at"), "key")
        order = dealt(docs.select("kind", "doc", "dl", F.row_number().over(at).alias("f"), F.lit(_ORDER).cast("long").alias("pid")))
        zero = F.lit(0.0)
        rows = rows.unionByName(order.withColumns({"idf": zero, "mean": zero}))
        need = F.max(F.when(F.col("every"), F.col("phrases")).otherwise(1)).alias("need")
        queries = own.join(sized(phrases, 60), "words").groupBy("qid").agg(F.sort_array(F.collect_list("pid")).alias("pids"), need)
        ranges = docs.select("kind", range_of(F.col("doc"))).distinct()
        asked_there = written(queries, "queries").crossJoin(F.broadcast(ranges))  # a row for each range
        keys = ["kind", "range"]
        return rows.groupBy(*keys).cogroup(asked_there.groupBy(*keys)).applyInArrow(_best_of_range(k), "qid long, kind string, doc long, gain double")

    def best(self, asked: DataFrame, k: int, wanted: DataFrame | None = None, kind: str | None = None, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """Each query's and kind's k best documents of one tier, with attributes, gain (BM25, larger is better) and place.

        asked are parse()'s rows of the tier. Blocks are scored in two rounds: first those whose bounds are
        largest, then all whose bound reaches the k-th score found so far; no other block can hold one of the
        k best. Many queries are put to ranges of documents instead. wanted (session_id or key) keeps the documents it has: statistics stay those of all. Equal
        scores are ordered by depth, recency and key.
        """
        per = Window.partitionBy("qid", "kind")
        if asked.select("qid").distinct().limit(MANY + 1).count() > MANY:
            rows = written(self._best_in_ranges(asked, k, wanted, kind).withColumn("gain", F.round("gain", 9)), "scored")
        else:
            rows = self._best_in_blocks(asked, k, wanted, kind, first_blocks)
        # Of equal scores at the end all stay until attributes order them.
        rows = rows.withColumn("at_", F.rank().over(per.orderBy(F.desc("gain")))).where(F.col("at_") <= k).drop("at_")
        rows = self._with_attributes(written(rows, "candidates"))
        place = F.row_number().over(per.orderBy(F.desc("gain"), F.desc("depth"), F.desc("at"), "key"))
        return rows.withColumn("place", place).where(F.col("place") <= k)

    def _best_in_blocks(self, asked: DataFrame, k: int, wanted: DataFrame | None, kind: str | None, first_blocks: int) -> DataFrame:
        """(qid, kind, doc, gain) of few queries, each scored in its own blocks: all that may be among the k best."""
        idf, bounds = self._bounds(asked, kind)
        per = Window.partitionBy("qid", "kind")
        bounds = bounds.withColumn("at", F.row_number().over(per.orderBy(F.desc("bound"), "block")))
        bounds = written(bounds.select("qid", "kind", "block", "bound", (F.col("at") <= first_blocks).alias("first")), "bounds")

        def found(blocks: DataFrame) -> DataFrame:
            rows = written(self._scored(asked, idf, blocks, kind).withColumn("gain", F.round("gain", 9)), "scored")
            if wanted is None:
                return rows
            rows = self._with_attributes(rows).join(wanted, wanted.columns, "left_semi")
            return written(rows.select("qid", "kind", "doc", "gain"), "wanted")

        rows = found(bounds.where("first"))
        kth = F.row_number().over(per.orderBy(F.desc("gain"), "doc"))
        floor = rows.withColumn("at", kth).where(F.col("at") == k).select("qid", "kind", F.col("gain").alias("floor"))
        rest = bounds.where("not first").join(floor, ["qid", "kind"], "left").where("floor is null or bound >= floor - 1e-8")
        rest = written(rest.select("qid", "kind", "block"), "rest")
        self.read_blocks, self.all_blocks = bounds.where("first").count() + rest.count(), bounds.count()
        return rows if rest.isEmpty() else rows.unionByName(found(rest))

    def scores(self, asked: DataFrame, kind: str | None = None) -> DataFrame:
        """(qid, kind, doc, gain) of all documents of a tier, rounded as best() has it."""
        return self._scored(asked, self._bounds(asked, kind)[0], None, kind).withColumn("gain", F.round("gain", 9))

    def compact(self) -> Index:
        """The live documents in a new index beside this one, with one batch; texts are taken from their postings' places."""
        other = Index(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}", self.buckets)
        live = self.documents().drop("dl", "span")
        places = self._read("postings", _POSTINGS).select("term", F.explode("docs").alias("d")).select("term", "d.doc", F.explode("d.positions").alias("p"))
        runs = places.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("p", "term"))).alias("t"))
        # A gap of one place parts two fields.
        text = F.aggregate("t", F.struct(F.lit(-1).alias("p"), F.lit("").alias("s")), lambda a, x: F.struct(x["p"].alias("p"), F.concat(a["s"], F.when(x["p"] == a["p"] + 1, " ").otherwise(F.repeat(F.lit("\0"), x["p"] - a["p"] - 1)), x["term"]).alias("s")))
        rows = live.join(runs, "doc", "left").withColumn("fields", F.split(F.coalesce(text["s"], F.lit("")), "\0")).drop("t", "doc")
        other.add(rows)
        return other


def _best_of_range(k: int):
    """A function of a range's postings (pid, idf, mean, docs: doc, dl, f) and its queries (qid, pids, need) that gives each one's best documents."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        lists = held.column("docs").combine_chunks()
        hits, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        doc, dl, f = (hits.field(n).to_numpy() for n in ("doc", "dl", "f"))
        pid, idf, mean = (held.column(n).to_numpy()[row] for n in ("pid", "idf", "mean"))
        first = doc.min() >> RANGE_BITS << RANGE_BITS if len(doc) else 0
        doc, is_order = doc - first, pid == _ORDER
        order = np.zeros(1 << RANGE_BITS, np.int64)
        order[doc[is_order]] = f[is_order]
        use = np.flatnonzero(~is_order)
        use = use[np.argsort(pid[use], kind="stable")]
        doc, dl, f, pid, idf, mean = (x[use] for x in (doc, dl, f, pid, idf, mean))
        gain = idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean)))
        pids, starts = np.unique(pid, return_index=True)
        ends = dict(zip(pids.tolist(), zip(starts.tolist(), np.append(starts[1:], len(pid)).tolist(), strict=True), strict=True))
        have, total = np.zeros(1 << RANGE_BITS, np.int32), np.zeros(1 << RANGE_BITS)
        for qid, own, need in zip(*(asked.column(n).to_pylist() for n in ("qid", "pids", "need")), strict=True):
            found = [slice(*ends[p]) for p in own if p in ends]
            if len(found) < need:
                continue
            for s in found:
                have[doc[s]] += 1
                total[doc[s]] += gain[s]
            at = np.flatnonzero((have >= need) & (order > 0))
            g = total[at]
            for s in found:
                have[doc[s]], total[doc[s]] = 0, 0
            if len(at) > k:  # scores are rounded later: of those near the k-th, k of each score are enough
                kth = np.partition(g, len(g) - k)[len(g) - k]
                some = np.flatnonzero(g >= kth - 2e-9)
                some = some[np.lexsort((order[at[some]], -g[some]))]
                same = np.flatnonzero(np.append(True, np.diff(g[some]) != 0))
                nr = np.arange(len(some)) - np.repeat(same, np.diff(np.append(same, len(some))))
                some = some[nr < k]
                at, g = at[some], g[some]
            if len(at):
                out.append((qid, at + first, g))
        n = [len(d) for _, d, _ in out]
        return pa.table(
            {
                "qid": pa.array(np.repeat(np.array([q for q, *_ in out], np.int64), n)), "kind": pa.array([held.column("kind")[0].as_py()] * sum(n) if n else [], pa.string()),
                "doc": pa.array(np.concatenate([d for _, d, _ in out]) if n else [], pa.int64()), "gain": pa.array(np.concatenate([g for *_, g in out]) if n else [], pa.float64()),
            }
        )

    return run


def _weight(f: Column, dl: Column, mean: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))
