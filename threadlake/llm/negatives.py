"""Hard negatives: product quantisation with residual norms bounds all scores, exact integers decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blocks_for, first_ids, salt, save
from .vectors import integer_rows, stacked

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: Rows whose id MOVED divides take the next of LABELS labels, a planted noise.
MOVED, LABELS = 7, 10
#: A negative's score is from LEAST to MOST hundredths of the positive's.
LEAST, MOST = 30, 90
#: Components that one code byte stands for, and the distinct vectors and rounds that train its entries.
PART_WIDTH, ENTRIES, SAMPLE, TRAIN_ROUNDS = 2, 256, 16_384, 8
#: Distinct vectors and anchors that meet in one task, and anchors that are scored together.
ROW_BLOCK, ANCHOR_BLOCK, BATCH = 8192, 8192, 64


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of one part by Lloyd's rounds over the sample; results don't depend on them, only the time does."""
    pdf = pdf.sort_values("key")
    x = stacked(pdf["values"]).astype(np.float64)
    entries = np.unique(x, axis=0)
    if len(entries) > ENTRIES:
        entries = entries[np.random.default_rng(3).choice(len(entries), ENTRIES, replace=False)]
        for _ in range(TRAIN_ROUNDS):
            at = ((entries**2).sum(axis=1)[None, :] - 2 * x @ entries.T).argmin(axis=1)
            n = np.bincount(at, minlength=len(entries))
            for c in range(x.shape[1]):
                total = np.bincount(at, x[:, c], len(entries))
                entries[n > 0, c] = total[n > 0] / n[n > 0]
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "entries": [entries.ravel().tolist()]})


def quantiser(groups: DataFrame, length: int) -> list[np.ndarray]:
    """Entries (up to 256, width) of each part, from the SAMPLE distinct vectors whose keys hash least; parts are trained in tasks of their own."""
    sample = groups.orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    parts = -(-length // PART_WIDTH)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("x", i * PART_WIDTH + 1, F.lit(PART_WIDTH)))
    trained = sample.select("key", F.posexplode(cuts).alias("part", "values")).groupBy("part").applyInPandas(_train, "part int, entries array<double>")
    width = [min(PART_WIDTH, length - i * PART_WIDTH) for i in range(parts)]
    return [np.array(r["entries"]).reshape(-1, width[r["part"]]) for r in sorted(trained.collect(), key=lambda r: r["part"])]


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, i : i + PART_WIDTH] for i in range(0, x.shape[1], PART_WIDTH)]


def _encode(books: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Codes of each vector, and the norm of what they leave out, widened by more than all rounding."""
        for pdf in batches:
            if not len(pdf):
                continue
            x = stacked(pdf["x"]).astype(np.float64)
            code, left, size = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x)), np.zeros(len(x))
            for m, (part, entries) in enumerate(zip(_parts(x), books, strict=True)):
                at = ((entries**2).sum(axis=1)[None, :] - 2 * part @ entries.T).argmin(axis=1)
                code[:, m] = at
                left += ((part - entries[at]) ** 2).sum(axis=1)
                size += (entries[at] ** 2).sum(axis=1)
            residual = np.sqrt(left) * (1 + 1e-9) + 1e-9 * (np.sqrt(size) + 1)
            yield pdf.drop(columns="key").assign(code=[c.tobytes() for c in code], residual=residual)

    return run


def _first(k: int, anchor: np.ndarray, score: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Places of each anchor's k best by score, ties by the smaller representative."""
    by = np.lexsort((rep, -score, anchor))
    sorted_ = anchor[by]
    start = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1]) if len(by) else np.empty(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[rank < k]


class _Block:
    """A block of distinct vectors: their codes bound every score, their integers give it."""

    def __init__(self, pdf: pd.DataFrame, books: list[np.ndarray]):
        self.g, self.rep, self.label = (pdf[c].to_numpy() for c in ("g", "rep", "label"))
        self.x, self.books = stacked(pdf["x"]), books
        self.code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
        self.residual = pdf["residual"].to_numpy()

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, rows) of the least and the most that each score can be.

        A score is the anchor's product with the coded vector, a sum of table entries, and with the rest,
        whose size is at most the product of both norms.
        """
        total = np.zeros((len(self.x), len(q)))
        for m, (part, entries) in enumerate(zip(_parts(q.astype(np.float64)), self.books, strict=True)):
            total += (entries @ part.T)[self.code[:, m]]
        total = np.ascontiguousarray(total.T)
        reach = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.residual[None, :]
        return total - reach, total + reach

    def exact(self, q: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            s = slice(i, i + (1 << 16))
            out[s] = np.einsum("ij,ij->i", q[a[s]], self.x[r[s]])
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf if there are fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _positives(books: list[np.ndarray], k: int):
    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Each anchor's k nearest distinct vectors of its label in the block, and its own vector if that is there."""
        out = []
        block = _Block(left, books) if len(left) and len(right) else None
        for at in range(0, len(right) if block else 0, BATCH):
            some = right.iloc[at : at + BATCH]
            q = stacked(some["x"])
            low, high = block.bounds(q)
            same = some["label"].to_numpy()[:, None] == block.label[None, :]
            own = some["g"].to_numpy()[:, None] == block.g[None, :]
            other = same & ~own
            a, r = np.nonzero(other & (high >= _kth(np.where(other, low, -np.inf), k)[:, None]))
            score = block.exact(q, a, r)
            kept = _first(k, a, score, block.rep[r])
            own_a, own_r = np.nonzero(own)
            a, r, score = np.append(a[kept], own_a), np.append(r[kept], own_r), np.append(score[kept], block.exact(q, own_a, own_r))
            out.append(pd.DataFrame({"aid": some["aid"].to_numpy()[a], "g": block.g[r], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("aid", "g", "score")})

    return run


def _negatives(books: list[np.ndarray], k: int, least: int, most: int):
    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each anchor and score of a positive, the k best distinct vectors of other labels in its window in the block."""
        out = []
        block = _Block(left, books) if len(left) and len(right) else None
        for at in range(0, len(right) if block else 0, BATCH):
            some = right.iloc[at : at + BATCH]
            q = stacked(some["x"])
            low, high = block.bounds(q)
            other = some["label"].to_numpy()[:, None] != block.label[None, :]
            most_windows = int(some["windows"].map(len).max())
            # Anchors with fewer windows repeat their first; those rows are left out at the end.
            ps = np.array([[*w, *[w[0]] * (most_windows - len(w))] for w in some["windows"]], np.int64)
            # Bounds are floats: whole scores that lie in a window lie in these, too.
            floor, ceiling = least * ps / 100 - 1, most * ps / 100 + 1
            wanted = np.zeros(other.shape, bool)
            for w in range(most_windows):
                lo, hi = floor[:, w, None], ceiling[:, w, None]
                sure = other & (low >= lo + 2) & (high <= hi - 2)
                wanted |= other & (low <= hi) & (high >= np.maximum(lo, _kth(np.where(sure, low, -np.inf), k)[:, None]))
            wanted &= (ps >= 0).any(axis=1)[:, None]
            a, r = np.nonzero(wanted)
            score = block.exact(q, a, r)
            for w in range(most_windows):
                p = ps[a, w]
                ok = np.flatnonzero((least * p <= 100 * score) & (100 * score <= most * p) & ((w == 0) | (p != ps[a, 0])))
                kept = ok[_first(k, a[ok], score[ok], block.rep[r[ok]])]
                out.append(pd.DataFrame({"aid": some["aid"].to_numpy()[a[kept]], "positive_score": p[kept], "g": block.g[r[kept]], "score": score[kept]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("aid", "positive_score", "g", "score")})

    return run


def mine(
    vectors: DataFrame, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST, moved: int = MOVED, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """Hard negatives of anchors, the rows of vectors (vec_id, embedding, label) whose id `every` divides.

    Where `moved` (0: nowhere) divides the id, label first becomes (label + 1) % LABELS. Components become
    floor(scale * component); a score is the integer inner product with the anchor. An
    anchor's positives are its best `positives` other rows of the same label, and each positive's negatives
    are the best `negatives` rows of another label with least * positive_score <= 100 * score <= most *
    positive_score; higher scores come first, ties by smaller vec_id.

    Rows with a null id, label or vector, a null or non-finite component, a value out of range or another
    length (see integer_rows) take no part. Rows that are equal in id, label and integers count once; rows
    that share an id only are rows of their own. A table without anchors, or empty, gives an empty result;
    other columns are ignored.

    Equal vectors of one label are scored once and stand for their smallest ids, gathered in bounded lists.
    Blocks of distinct vectors meet blocks of anchors; in each, table scores plus or minus the residual's
    bound leave candidates out only if so many others are certainly better, and exact integers rank the rest,
    so a block returns a bounded number of rows an anchor.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    rows = integer_rows(vectors, scale, "label").where("vec_id is not null and label is not null")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % moved == 0, (label + 1) % LABELS).otherwise(label) if moved else label)
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>")))))
    rows = save(rows.dropDuplicates(["key", "vec_id"]), "rows")
    ids = save(first_ids(rows.select("key", F.col("vec_id").alias("id")), max(positives + 1, negatives)), "ids")
    reps = ids.select("key", F.col("ids")[0].alias("vec_id"), "ids")
    groups = rows.join(reps, ["key", "vec_id"]).select("key", F.col("vec_id").alias("rep"), "ids", "label", "x")
    groups = save(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    n = groups.count()
    first = groups.select(F.size("x").alias("length")).first()
    books = quantiser(groups.select("key", "x"), first["length"]) if first and first["length"] else []
    coded = groups.select("key", "g", "rep", "label", "x").mapInPandas(_encode(books), "g long, rep long, label long, x array<int>, code binary, residual double")
    coded = save(coded, "coded")
    anchors = rows.where(F.col("vec_id") % every == 0).join(groups.select("key", "g"), "key")
    anchors = save(anchors.select(F.col("vec_id").alias("anchor_id"), "label", "x", "g").withColumn("aid", F.monotonically_increasing_id()), "anchors")

    blocks, parts = blocks_for(n, row_block), blocks_for(anchors.count(), anchor_block)
    held = coded.withColumn("block", salt(F.col("g"), blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = held.groupBy("block", "part")

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        """asked, dealt to its parts and copied to every block of vectors."""
        asked = asked.withColumn("part", salt(F.col("aid"), parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = held.cogroup(asked.groupBy("block", "part")).applyInPandas(run, schema)
        return found.join(groups.select("g", F.explode("ids").alias("vec_id")), "g")

    same = met(anchors, _positives(books, positives), "aid long, g long, score long")
    same = same.join(anchors.select("aid", "anchor_id", F.col("g").alias("own")), "aid").where("not (g = own and vec_id = anchor_id)")
    best = Window.partitionBy("aid").orderBy(F.desc("score"), "vec_id")
    same = same.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    same = save(same.select("aid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = same.groupBy("aid").agg(F.collect_set("positive_score").alias("windows"))
    other = met(anchors.join(windows, "aid"), _negatives(books, negatives, least, most), "aid long, positive_score long, g long, score long")
    best = Window.partitionBy("aid", "positive_score").orderBy(F.desc("score"), "vec_id")
    other = other.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    other = other.select("aid", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return same.join(other, ["aid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
