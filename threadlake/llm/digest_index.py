"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks_for, save, scratch_dir, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digests of a bucket, some 200 MB, when the index has the rows it was made for.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 8
#: Batches in which one call's rows meet the index, from the largest ids to the smallest.
BATCHES = 3


class DigestIndex:
    """A table (digest, keep_id, added) in the warehouse that outlives the job.

    The table is bucketed and sorted by digest, so a sort-merge join with it moves the new rows alone; it is
    made for `rows` digests. Several batches of one index must not be added at the same time.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None, rows: int = 0):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = buckets or max(LEAST_BUCKETS, blocks_for(rows, BUCKET_ROWS))
        if not spark.catalog.tableExists(table):
            self.append(spark.createDataFrame([], "digest binary, keep_id long, added string"))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Add rows in the table's own layout: one exchange by digest, a sort, one file for each bucket and task."""
        w = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        (w.option("path", self.path) if self.path else w).saveAsTable(self.table)

    def add(self, batch: DataFrame, label: str) -> None:
        """Append the distinct digests of a batch (digest, keep_id) that the index does not hold, under a label.

        A sort-merge anti-join with the index tells which those are. A batch that is added again under its
        label changes nothing.
        """
        held = self.read().select("digest").hint("merge")
        new = save(batch.join(held, "digest", "left_anti"), "new")
        self.append(new.select("digest", "keep_id", F.lit(label).alias("added")))


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of docs: SHA-256 of the text with A to Z lowered, null as empty."""
    text = F.translate(text_or_empty(), UPPER, UPPER.lower())
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def _by_id(rows: DataFrame, batches: int) -> list[DataFrame]:
    """rows cut into ranges of doc_id, the largest ids first, null ids last."""
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []), reverse=True) if shares else []
    out, above = [], F.lit(True)
    for cut in cuts:
        out.append(rows.where(above & (F.col("doc_id") > cut)))
        above = F.col("doc_id") <= cut
    return [*out, rows.where(above | F.col("doc_id").isNull())]


def dedup(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """Judge every row of docs (doc_id, text) against the index and each other, and extend the index.

    Texts are equal when identical after lowering A to Z; null counts as empty. A digest that the index holds
    from earlier calls keeps its keep_id of old: new rows of it are duplicates. The rows meet the index in
    `batches` ranges of doc_id, the largest first, so that of a new digest the row of the largest id is in the
    index when the others come. A row is kept if its digest was new to this call and its doc_id is that of
    the index; rows that repeat that doc_id are all marked kept, a null doc_id is kept only if its group has
    no other. group_size counts this call's rows. Other columns are ignored; an empty table gives an empty
    result; a text of any length is one digest. Hot groups meet only in partial counts and in a join that
    adaptive execution can split.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows, label = save(digests_of(docs), "digests"), uuid.uuid4().hex
    counted = None
    for part in _by_id(rows, batches):
        batch = save(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "batch")
        index.add(batch.select("digest", "keep_id"), label)
        counted = batch.select("digest", "n") if counted is None else counted.unionByName(batch.select("digest", "n"))
    sizes = counted.groupBy("digest").agg(F.sum("n").alias("group_size"))
    judged = sizes.join(index.read(), "digest").select("digest", "keep_id", "group_size", (F.col("added") == label).alias("is_new"))
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(judged, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def fresh_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An empty index of its own in the shared folder, made for so many rows."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, f"{scratch_dir(spark)}/index", rows=rows)
