"""Recall of the entropy scan by class and length, and what it leaves alone."""

import random
import string

from pyspark.sql import functions as F

from threadlake.llm.secrets import spans

CLASSES = {
    "hex": "0123456789ABCDEF",
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "lower_digit": string.ascii_lowercase + string.digits,
    "upper_digit": string.ascii_uppercase + string.digits,
    "letters": string.ascii_letters,
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}
LENGTHS = (20, 24, 32)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hit = F.array_join(F.transform(F.filter(spans(F.col("t")), lambda s: s["rank"] >= 3), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return [r["h"] for r in df.select("i", hit.alias("h")).orderBy("i").collect()]


def test_recall_by_class_and_length(spark):
    rng = random.Random(11)
    keys = [(k, n) for k in CLASSES for n in LENGTHS]
    got = found(spark, ["is " + "".join(rng.choice(CLASSES[k]) for _ in range(n)) + " ." for k, n in keys for _ in range(200)])
    for i, (k, n) in enumerate(keys):
        hits = sum(bool(h) for h in got[200 * i : 200 * (i + 1)])
        assert hits >= (186 if n == 20 else 194), (k, n, hits)


def test_values_beside_words_and_before_digits(spark):
    value = "Zk3J9xQp7Lw2Rt8Vb5Nm1Yc4Ds6"
    texts = ["my-example-key=" + value, value + "/sample", "Zk3J9xQpexampleLw2Rt8Vb5Nm1Yc4", "Zk3J9xQp12345678Lw2Rt8Vb5Nm1Yc4", "qzXwKjvBhtRmpLcdGfkq2024"]
    assert found(spark, texts) == [f"0:{len(t)}" for t in texts]


def test_words_counting_and_fillers_are_left(spark):
    texts = [
        "internationalization", "well-known-long-slug-2024", "src/main/resources/application", "getCustomerAccountInformation", "INTERNATIONAL_ORGANISATION",
        "example-example-example1234", "xxxxxxxxxxxxxxxxxxxxxxxxx1", "abcdefghijklmnopqrstuvwxyz0123456789", "key=123e4567-e89b-12d3-a456-426614174000", "-" * 40, "a-" * 9000, "x" * 20_000,
    ]
    assert found(spark, texts) == [""] * len(texts)
