"""The operators' queries on the driver's tables, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, codes, curve, digest_index, jaccard, negatives, packing, quality, secrets, sentencepiece, sharding, substring
from .shared import small_batches

SHARDS = 40
WINDOW = 13
SEQUENCE, CURVE_SEQUENCE = 2048, 1024
NEIGHBOURS, EVERY = 20, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), f.read())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    lines = chat.save(chat.transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    return chat.parse(lines, chat.fit(lines.where(~chat.held_out(F.col("conv_id")))))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), EVERY, NEIGHBOURS)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring.remove_repeats(table(spark, sf_dir, "documents"), WINDOW).drop("kept_text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packing.pack(table(spark, sf_dir, "documents"), f.read(), SEQUENCE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return digest_index.dedup(docs, digest_index.fresh_index(spark, docs.count()))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return curve.pack(table(spark, sf_dir, "documents"), f.read(), CURVE_SEQUENCE)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_sentencepiece, op3_secrets, op4_jaccard_join, op5_chat, op6_nearest, op7_substring, op8_packing, op9_quality,
        op10_exact_dedup, op11_hard_negatives, op12_curve_packing, op13_vector_codes,
    )
}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def _codes_sql(scale: int, parts: int, entries: int, rounds: int) -> str:
    """Lloyd's rounds over all pairs of parts and entries, one after the other."""
    ctes = [
        f"""v AS (
            SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * CAST(c AS DOUBLE))) AS x
            FROM embeddings WHERE {_FINITE}
        )""",
        f"""p AS MATERIALIZED (
            SELECT vec_id, label, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS y FROM v, range({parts}) AS r(part)
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT part, entry, y AS e FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id)
            WHERE entry < {entries}
        )""",
    ]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
            SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
                SELECT vec_id, p.part, entry, list_dot_product(y, y) - 2 * list_dot_product(y, e) + list_dot_product(e, e) AS d
                FROM p JOIN c{n} c ON p.part = c.part
            ) GROUP BY ALL
        )""")
        if n < rounds:
            ctes.append(f"""s{n} AS (
                SELECT part, entry, list(m ORDER BY i) AS e FROM (
                    SELECT part, entry, i, floor(sum(y[i]) / count(*)) AS m
                    FROM a{n} JOIN p USING (vec_id, part), range(1, len(y) + 1) AS r(i) GROUP BY ALL
                ) GROUP BY ALL
            )""")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.e, c.e) AS e FROM c{n} c LEFT JOIN s{n} s USING (part, entry))")
    return f"""
        WITH {", ".join(ctes)},
        digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
            FROM c{rounds}
        ),
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN v USING (vec_id), digest
    """


ORACLES: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
            FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_FINITE}
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score
            FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
        ),
        positives AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER w <= 10
    """,
    "op13_vector_codes": _codes_sql(1024, 4, 256, 4),
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op7_substring": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        starts AS (
            SELECT doc_id, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS s FROM words
        ),
        windows AS (
            SELECT s.doc_id, s.s, md5(array_to_string(w.w[s.s:s.s + 12], ' ')) AS h
            FROM starts s JOIN words w USING (doc_id)
        ),
        lows AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN lows USING (h) WHERE doc_id > low
        ),
        per_doc AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT w.doc_id,
               CAST(len(w.w) AS BIGINT) AS n_words,
               CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(
                   CASE WHEN g.gone IS NULL THEN w.w
                        ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: w.w[i]) END, ' '), '')) AS kept_sha256
        FROM words w LEFT JOIN per_doc g USING (doc_id)
    """,
}
