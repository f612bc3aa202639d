"""The stages of the pipeline by brute force, dedup with repeated and null ids too."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.common import prose
from threadlake.llm import secrets
from threadlake.llm.jaccard import THRESHOLD
from threadlake.llm.queries import tokenizer_file
from threadlake.llm.shared import save

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def rows():
    rng = random.Random(3)
    a, b, c, d, e, f = (prose(rng, 120) for _ in range(6))
    return [
        (1, a, "x"), (2, a.upper(), "x"), (2, b, "x"),  # the second row of id 2 has no twin
        (3, c, "x"), (None, c, "x"), (None, c, "x"),
        (None, d, "x"), (None, d, "y"), (None, e, "x"),
        (4, f + " tail", "x"), (5, f, "x"), (5, prose(rng, 120), "x"), (None, f + " other end", "x"),
        (6, e + " more", "x"), (7, b + " more", "x"), (7, b + " more", "x"), (8, None, "x"), (8, "", "x"), (None, "of few words", "x"),
    ]


def exact_by_force(docs):
    best = {}
    for i, t, *_ in docs:
        key, order = (t or "").lower(), (i is not None, i or 0)
        if key not in best or order > best[key][0]:
            best[key] = (order, i)
    return Counter((i, key) for key, (_, i) in best.items())


def near_by_force(docs):
    grams = []
    for _, t, *_ in docs:
        w = (t or "").lower().split()
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= THRESHOLD:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for g in set(group):
        out.append(min((d for d, h in zip(docs, group) if h == g), key=lambda d: (d[0] is None, d[0] or 0)))
    return Counter((d[0], d[1]) for d in out)


def test_exact_keeps_one_row_of_each_text(spark):
    got = corpus_pipeline.exact(spark, spark.createDataFrame(rows(), SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang"]
    assert Counter((i, (t or "").lower()) for i, t in texts_of(got).elements()) == exact_by_force(rows())


def test_near_keeps_one_row_of_each_class(spark):
    docs = [tuple(r) for r in corpus_pipeline.exact(spark, spark.createDataFrame(rows(), SCHEMA), "").collect()]
    got = corpus_pipeline.near(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang"]
    assert texts_of(got) == near_by_force(docs)


def test_unique_ids(spark):
    docs = [(i, t, "x") for i, (_, t, _) in enumerate(rows())]
    one = corpus_pipeline.exact(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert Counter((i, (t or "").lower()) for i, t in texts_of(one).elements()) == exact_by_force(docs)
    kept = [tuple(r) for r in one.collect()]
    assert texts_of(corpus_pipeline.near(spark, one, "")) == near_by_force(kept)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows()], SCHEMA + ", __row long, digest string")
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.where("__row <> 1 or digest <> 'y'").count() == 0 and got.count() == stage(spark, docs.select("doc_id", "text", "lang"), "").count()
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.scan_secrets(spark, docs.limit(0), "").count() == 0 and corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_all_stages_on_a_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "secret_scan":  # what is left of so small a table has no secrets
            put = F.when(F.col("doc_id") % 10 == 0, ' password: hunter2hunter2, key Zk3J9xQp7Lw2Rt8Vb5Nm1Yc4Ds6 end').otherwise("")
            docs = save(docs.withColumn("text", F.concat("text", put)), "secrets")
            given = [tuple(r[:2]) for r in docs.collect()]
        docs = save(stage(spark, docs, sf), name)
        kept[name] = [tuple(r) for r in docs.collect()]
    names = docs.columns
    texts = {n: [r[:2] for r in kept[n]] for n in ("quality_classifier", "exact_dedup", "near_duplicates", "secret_scan")}
    assert 0 < len(texts["quality_classifier"]) <= spark.read.parquet(f"{sf}/documents.parquet").count()
    assert Counter((i, (t or "").lower()) for i, t in texts["exact_dedup"]) == exact_by_force(texts["quality_classifier"])
    assert Counter(texts["near_duplicates"]) == near_by_force(texts["exact_dedup"])
    before, after = dict(given), dict(texts["secret_scan"])
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert before.keys() == after.keys() and any(found.values())
    for i, t in before.items():
        if not found[i]:
            assert after[i] == t
            continue
        out, at = "", 0
        for a, b in [tuple(map(int, s.split(":")[1:])) for s in found[i].split(",")]:
            out, at = (out + t[at:a] + secrets.MASK, b) if a >= at else (out, max(at, b))
        assert after[i] == out + t[at:]
    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows_ = [dict(zip(names, r)) for r in kept["packing"]]
    sizes = Counter()
    for r in rows_:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after.items()}
    fills = defaultdict(list)
    for r in rows_:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fills.values():
        assert all(o == sum(n for p, n in places if p < o) for o, _ in places) and sum(n for _, n in places) <= 2048
