import random
import zlib

from tests.llm.common import cases, frame, prose
from threadlake.llm.quality import accepted, fit, score


def corpus(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, rng.randint(60, 200))
        if not good:
            text = rng.choice([" ".join(w + "%%%" for w in text.split()), (text.split()[0] + " ") * 150, text.upper().replace(" ", "!! ")])
        docs.append((i, text, "en", "s", len(text), *["x"] * 8))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (5, None, 0), (9999, 0, 0), (7, 3, 0)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_held_out_rows_are_told_apart(spark):
    docs, labels, rows = corpus(spark)
    got = {r["doc_id"]: r for r in score(docs, fit(docs, labels)).collect()}
    right = n = 0
    for i, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        if got[i]["held_out"]:
            n += 1
            right += got[i]["predicted"] == int(i % 4 != 0)
    assert right >= 0.95 * n


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 120)
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end quality", "toxic")
    assert fit(docs, labels) == fit(docs, other)


def test_awkward_rows_and_few_labels(spark):
    docs, labels, _ = corpus(spark, 120)
    model = fit(docs, labels)
    got = score(frame(spark), model).collect()
    assert len(got) == len(cases()) and all(0 <= r["score"] <= 1 for r in got)
    kept = accepted(frame(spark), model)
    assert kept.columns == frame(spark).columns and 0 < kept.count() <= len(cases())
    assert score(frame(spark, []), model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert all(0 <= r["score"] <= 1 for r in score(frame(spark), fit(docs, few)).collect())
