"""Quality scores from zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Labelled rows of each class that a fit reads at most, and bytes of a text that may be among them.
FIT_ROWS = 3000
FIT_BYTES = 64 << 10
#: Bytes that are compressed at a time, of a dictionary, and the compression level.
CHUNK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: A row is accepted from this score on.
ACCEPT = 0.7
#: Rows whose crc32(doc_id) has this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2


def _chunks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the chunks of texts, or their plain content where that is too little."""
    samples = [c for t in texts for c in _chunks(t, CHUNK)]
    np.random.default_rng(0).shuffle(samples)  # type: ignore[arg-type]
    samples = samples[: 100 * DICTIONARY_BYTES // CHUNK]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


class Compressors:
    """The two compressors of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for d in (good, bad):
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """Bytes that the bad dictionary needs more than the good one, for each byte of text."""
        data = text.encode("utf-8", "replace")
        if not data:
            return 0.0
        good, bad = (sum(len(z.compress(c)) for c in _chunks(data, CHUNK)) for z in self.both)
        return (bad - good) / len(data)


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scores(self, texts: pd.Series | list[str]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), _sigmoid(self.intercept))
        z = Compressors(self.good, self.bad)
        return _sigmoid(self.slope * np.array([z.difference(t) for t in texts], float) + self.intercept)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature, by Newton steps with a small ridge."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    weight = weight / weight.mean()
    for _ in range(50):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / scale, w[1]


def held_out(doc_id="doc_id"):
    """Whether a row is never learned from; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled rows of each class, those of smallest hash, none held out.

    Two thirds of them build the dictionaries, the others calibrate; classes weigh as often as all
    labels have them. Labels other than 0 and 1 and labels without a text, or with one of over
    FIT_BYTES, are passed over. With no row of one class the score is the share of label 1 (a half if
    there are no labels).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        return Model(b"", b"", 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    some = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        some = part if some is None else some.union(part)
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.octet_length("text").between(1, FIT_BYTES))
    got = texts.join(F.broadcast(some), "doc_id").orderBy("doc_id", "text").toPandas().drop_duplicates("doc_id")
    got = got.sample(frac=1.0, random_state=0)  # at most 2 * rows rows
    fold = np.arange(len(got)) % 3 == 0
    data = [t.encode("utf-8", "replace") for t in got["text"]]
    y = got["quality"].to_numpy(float)
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        share = counts[1] / (counts[0] + counts[1])
        return Model(b"", b"", 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    good, bad = (_dictionary([t for t, k, f in zip(data, y, fold, strict=True) if k == q and not f]) for q in (1, 0))
    z = Compressors(good, bad)
    x = np.array([z.difference(t) for t in got["text"][fold]])
    yc = y[fold]
    weight = np.where(yc == 1, counts[1] / (yc == 1).sum(), counts[0] / (yc == 0).sum())
    slope, intercept = _calibrate(x, yc, weight)
    return Model(good, bad, float(slope), float(intercept))


def _score(model: Model, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=column).assign(score=model.scores(pdf[column]))

    return run


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """Score every whole text of docs (doc_id, text); null counts as empty.

    One pass without a shuffle. An empty text's difference is 0, its score what calibration gives for
    that. Rows with null or repeated doc_id are rows like any other; an empty table gives an empty
    result; other columns are ignored. Returns doc_id, held_out, score, predicted.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    out = rows.mapInPandas(_score(model, "text"), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches `accept`."""
    judged = F.pandas_udf(lambda t: pd.Series(model.scores(t)), "double")
    return docs.where(judged(text_or_empty()) >= accept)
