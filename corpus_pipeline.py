"""The corpus pipeline: five stages over documents, each by one operator of threadlake.llm.

Every stage takes (spark, docs, sf_dir) and reads all that the one before it kept. Null doc_ids and texts
are rows like any other, and rows that share an id are judged each for itself; of rows that are equal in
all, dedup keeps one. Columns beside doc_id and text, whatever their names, are carried along by all stages
but the last; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import digest_index, jaccard, packing, quality, secrets
from threadlake.llm.queries import SEQUENCE, table, tokenizer_file
from threadlake.llm.shared import save, sized, small_batches


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _rows(docs: DataFrame, nulls_first: bool) -> tuple[DataFrame, str]:
    """docs with a number of each row's own in the order of doc_id (the id itself where ids are unique), and its name."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    n, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == distinct:
        return docs.withColumn(name, F.col("doc_id")), name
    by = F.col("doc_id").asc_nulls_first() if nulls_first else F.col("doc_id").asc_nulls_last()
    # The text's hash deals out the rows of one id; numbers rise with the partition and the place in it.
    order = [by, F.xxhash64("text")]
    return save(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _as_docs(rows: DataFrame, name: str) -> DataFrame:
    """What an operator judges: the rows' numbers as ids, so that it tells rows of one id apart."""
    return rows.select(F.col(name).alias("doc_id"), "text")


def _without(rows: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """rows whose number is not among the dropped ones, without the numbers."""
    dropped = dropped.select(F.col("doc_id").alias(name))
    return rows.join(sized(save(dropped, "dropped"), 16), name, "left_anti").drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest id, a null id being less than all others.

    The rows meet a new digest index in ranges of their numbers; its anti-join and append decide.
    """
    small_batches(spark)
    rows, name = _rows(docs, nulls_first=True)
    judged = digest_index.dedup(_as_docs(rows, name), digest_index.fresh_index(spark, rows.count()))
    return _without(rows, name, judged.where("not kept")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id, a null id being more than all others."""
    small_batches(spark)
    rows, name = _rows(docs, nulls_first=False)
    judged = jaccard.near_duplicates(_as_docs(rows, name))
    return _without(rows, name, judged.where("not is_kept")).select(*docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    small_batches(spark)
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packing.pack(docs, f.read(), SEQUENCE)


STAGES = [("quality_classifier", classify), ("exact_dedup", exact), ("near_duplicates", near), ("secret_scan", scan_secrets), ("packing", pack)]

#: SQL has no compression classifier, tokenizer or MinHash join; tests hold both dedup stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
