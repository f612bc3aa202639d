"""Similarity join on word n-grams: banded MinHash, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import blocks_for, salt, save, sized, text_or_empty
from .words import mix, numbered, shingles

N = 5
THRESHOLD = 0.8
#: MinHash values of a document: BANDS times ROWS. Two documents at the threshold share no band with
#: probability (1 - 0.8 ** 6) ** 40, which is 5e-6.
BANDS, ROWS = 40, 6
#: MinHash values that are compared at a time, and the posterior below which a pair is dropped.
STEP = 24
TOLERANCE = 1e-6
#: Documents in a block; a task holds two blocks at most.
BUCKET_BLOCK = 1024
VERIFY_BLOCK = 256
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 512):
        least = np.minimum(least, (h[i : i + 512, None] * _A + _B).min(axis=0))
    return (mix(least) >> np.uint64(48)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, total: int = BANDS * ROWS) -> dict[int, int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior on the similarity s, m matches of n give a Beta posterior, whose mass above t is
    P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(step, total + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            k = m
            mass += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        out[n] = m
    return out


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for h in shingles(pdf["text"].str.lower(), N):
            out.append(signature(h[:, 0]).tobytes() if len(h) else None)
        yield pd.DataFrame({"doc": pdf["doc"], "digest": pdf["digest"], "sig": out})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as their shingles, once each, however many blocks they go to."""
    for pdf in batches:
        yield pdf.drop(columns="text").assign(grams=[h.tobytes() for h in shingles(pdf["text"].str.lower(), N)])


class _Sets:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        merged = np.isin(self.of, np.append(self.of[others], self.of[i]))
        self.of[merged] = self.of[merged].min()


def _prune(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def alike(sig: np.ndarray, x: np.ndarray | int, live: np.ndarray) -> np.ndarray:
        """Places in live that survive the comparison with x, STEP values at a time."""
        left = np.arange(len(live))
        same = np.zeros(len(live), np.int32)
        for n, m in least.items():
            if not len(left):
                break
            own = sig[x if np.isscalar(x) else x[left], n - STEP : n]
            same = same + (sig[live[left], n - STEP : n] == own).sum(axis=1, dtype=np.int32)
            left, same = left[same >= m], same[same >= m]
        return left

    def joins(sig: np.ndarray, side: np.ndarray, sets: _Sets, across: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Places that join another set to that of an earlier place, one for each set; within the sides or across."""
        for x in range(len(side)):
            far = (sets.of != sets.of[x]) & ((side != side[x]) == across)
            far[:x] = False
            live = np.flatnonzero(far)
            if len(live):
                live = live[alike(sig, x, live)]
            if len(live):
                live = live[np.unique(sets.of[live], return_index=True)[1]]
                yield x, live
                sets.join(x, live)

    def solve(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        doc, side = pdf["doc"].to_numpy(), pdf["side"].to_numpy()
        split = pdf["i"].to_numpy() != pdf["j"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), -1)
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]  # most buckets: all in one comparison
        two = two[~split[two] | (side[two] != side[two + 1])]
        kept = two[alike(sig, two, two + 1)]
        out_a, out_b = [doc[kept]], [doc[kept + 1]]
        for lo, hi in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
            sets = _Sets(hi - lo)
            for across in (False, True) if split[lo] else (False,):
                for x, live in joins(sig[lo:hi], side[lo:hi], sets, across):
                    if across == split[lo]:
                        out_a.append(np.full(len(live), doc[lo + x]))
                        out_b.append(doc[lo + live])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spanning pairs of what survives among each bucket's documents (or between two of its blocks).

        Batches are sorted by bucket and blocks; the last bucket of a batch, two blocks at most, waits for
        the next. Each document is compared with those that are not yet joined to it, so every pair that
        could join two sets is compared.
        """
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = pdf[["bucket", "i", "j"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            held = pdf.iloc[cuts[-1] :]
            if len(cuts) > 1:
                yield solve(pdf.iloc[: cuts[-1]], cuts)
        if held is not None and len(held):
            yield solve(held, np.array([0, len(held)]))

    return run


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact similarities within a block (or between two): each document's links, and spanning links.

        Links between two blocks span what their own links, given by each block alone, leave apart. A row
        with b = null counts links to documents of different words, and to copies of them.
        """
        pdf = pdf.sort_values(["side", "doc"], ignore_index=True)
        held = [np.frombuffer(g, "<u8").reshape(-1, 2) for g in pdf["grams"]]
        size = np.array([len(h) for h in held], np.int64)
        owner = np.repeat(np.arange(len(held)), size)
        column = numbered(*np.concatenate(held).T.copy())
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((len(held), len(held)), np.float64)
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((len(held), min(4096, width - at)), np.float32)
            m[owner[a:b], column[a:b] - at] = 1
            both += m @ m.T
        union = size[:, None] + size[None, :] - both
        linked = both >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        doc, copies, side = pdf["doc"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        sets, pairs = _Sets(len(pdf)), []
        if int(pdf["i"].iloc[0]) != int(pdf["j"].iloc[0]):
            across = side[:, None] != side[None, :]
            for x in range(len(pdf)):
                own = np.flatnonzero(linked[x] & ~across[x] & (sets.of != sets.of[x]))
                if len(own):
                    sets.join(x, own)
            linked &= across
        for x in range(len(pdf)):
            new = np.flatnonzero(linked[x] & (sets.of != sets.of[x]))
            if len(new):
                new = new[np.unique(sets.of[new], return_index=True)[1]]
                pairs += [(doc[x], doc[y]) for y in new]
                sets.join(x, new)
        counts = pd.DataFrame({"a": doc, "b": pd.array([None] * len(doc), "Int64"), "texts": linked.sum(axis=1), "rows": linked @ copies})
        edges = pd.DataFrame({"a": [p[0] for p in pairs], "b": pd.array([p[1] for p in pairs], "Int64"), "texts": 0, "rows": 0})
        return pd.concat([counts[counts["texts"] > 0], edges], ignore_index=True).astype({"a": "int64", "texts": "int64", "rows": "int64"})

    return run


def _block_pairs(rows: DataFrame, key: str, size: str, per_block: int) -> DataFrame:
    """rows dealt to every pair of blocks of their key that has them: side 0 in block i, side 1 in block j."""
    n = F.ceil(F.col(size) / per_block).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "doc"), n).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(
        key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        *[c for c in rows.columns if c not in (key, "own", "other")],
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Join docs (doc_id, text) with itself where word 5-grams have a Jaccard similarity of `threshold`.

    N-grams are the same if 128 bits over keyed digests of their words are.

    Words are lower-cased runs of characters other than blanks and tabs to carriage returns. Documents of
    the same words are one text. Texts of fewer than five words have no n-grams and no links but to copies;
    those without words have none. Rows of a null id are alone in a class of null; rows that share an id
    share a class. An empty table gives an empty result; other columns are ignored.

    Signatures are cut into bands. Within the buckets that bands share, pairs are compared a few values at
    a time and dropped as soon as their posterior allows; what survives joins documents to families, and
    families are verified exactly in blocks of documents, block against block, each pair once. Pairs are
    never written: blocks give each document's count of links, and links that span their sets. A hot bucket
    or family is thus many bounded tasks. The time grows with the pairs that are similar, which are what
    the join is asked for; rows grow with the documents times the number of their family's blocks.

    Returns doc_id, class_id (the smallest doc_id of all linked directly or by way of others), n_links
    (other rows within the threshold, copies included), n_text_links (different texts within it),
    copies (rows with the same words) and is_kept (one row of each class: the one of the smallest id).
    """
    words = F.lower(F.trim(F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", " ")))
    rows = docs.select(F.col("doc_id").alias("doc"), F.unhex(F.md5(words.cast("binary"))).alias("digest"), text_or_empty().alias("text"))
    rows = rows.where("doc is not null")
    signed = save(rows.mapInPandas(_sign, "doc long, digest binary, sig binary"), "signed")
    texts = save(signed.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "texts")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    placed = texts.where("sig is not null").select(F.col("rep").alias("doc"), band.alias("bucket"))
    hot = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = save(placed.join(hot, "bucket"), "met")
    met = met.join(texts.select(F.col("rep").alias("doc"), "sig"), "doc")
    keys = ["bucket", "i", "j"]
    pairs = _block_pairs(met, "bucket", "n", BUCKET_BLOCK)
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys, "side", "doc")
    alike = save(pairs.select(*keys, "side", "doc", "sig").mapInPandas(_prune(threshold, tolerance), "a long, b long"), "alike")

    family = components(alike).select(F.col("node").alias("doc"), F.col("root").alias("family"))
    family = family.join(family.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family")
    family = save(family.join(texts.select(F.col("rep").alias("doc"), "digest", "copies"), "doc"), "family")
    # One row of each text: rows of a shared id may differ in text, so the digest decides.
    held = rows.join(sized(family, 64), ["doc", "digest"]).dropDuplicates(["doc", "digest"])
    keys = ["family", "i", "j"]
    held = held.select("family", "n", "doc", "copies", "text").mapInPandas(_hashed, "family long, n long, doc long, copies long, grams binary")
    blocks = _block_pairs(held, "family", "n", VERIFY_BLOCK)
    checked = save(blocks.groupBy(*keys).applyInPandas(_verify(threshold), "a long, b long, texts long, rows long"), "checked")
    root = components(checked.where("b is not null").select("a", "b"))
    links = checked.where("b is null").groupBy("a").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))

    out = texts.join(links, texts.rep == links.a, "left").join(root, texts.rep == root.node, "left")
    blank = F.unhex(F.md5(F.lit("").cast("binary")))
    alone = F.col("digest") == blank
    out = out.select(
        "digest", alone.alias("alone"), "rep", "copies",
        F.coalesce("root", "rep").alias("class_id"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        (F.coalesce("rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    known = signed.select("doc", "digest").join(out, "digest")
    zero = F.lit(0).cast("long")
    class_id = F.when(F.col("alone"), F.col("doc")).otherwise(F.col("class_id"))
    known = known.select(
        F.col("doc").alias("doc_id"), class_id.alias("class_id"),
        F.when(F.col("alone"), zero).otherwise(F.col("n_links")).alias("n_links"), "n_text_links",
        F.when(F.col("alone"), zero + 1).otherwise(F.col("copies")).alias("copies"),
        (F.col("doc") == class_id).alias("is_kept"),
    )
    lone = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), (zero + 1).alias("copies"), F.lit(True).alias("is_kept")
    )
    return known.unionByName(lone)
