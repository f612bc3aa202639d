"""Removal of word windows that another document repeats, found by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save, sized, text_or_empty
from .words import grams, mix, word_hashes

#: The doubling of lengths starts below so many words.
LEAST_LENGTH = 8


def lengths(window: int) -> list[int]:
    """The lengths of the levels: each twice the one before it, one less where the window's halves are odd."""
    out = [window]
    while out[0] >= LEAST_LENGTH:
        out.insert(0, -(-out[0] // 2))
    return out


def anchors(words: np.ndarray, length: int, window: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of `length` that are the least in some live window of `window` words.

    Two documents that share a full window share its anchor. live has one flag for each full window.
    """
    h = grams(words, length)
    span = window - length + 1
    m = len(live)
    if not live.any():
        return np.empty(0, np.int64), h[:0]
    least = h[:m].copy()
    for i in range(1, span):
        np.minimum(least, h[i : i + m], out=least)
    is_least = np.zeros(len(h), bool)
    for i in range(span):
        is_least[i : i + m] |= live & (h[i : i + m] == least)
    at = np.flatnonzero(is_least)
    return at, h[at]


OPEN, WITNESS, SPAN = 0, 1, 2


def _level(length: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document's windows of `length` that are to be compared, in runs of equal ones.

        What one batch's documents settle among themselves leaves as spans (pos, n); of a window that many of
        them have, at most one document's rows, and two witnesses, go on to meet other batches' rows, however
        frequent it is. The last level gives the full windows, with the second half of their hashes.
        """
        last = length == window
        for pdf in batches:
            out = []
            all_spans = pdf["spans"] if "spans" in pdf else [None] * len(pdf)
            for doc, th, hashes, spans in zip(pdf["doc_id"], pdf["th"], word_hashes(pdf["text"]), all_spans, strict=True):
                w = np.ascontiguousarray(hashes[:, 0])
                live = np.full(max(0, len(w) - window + 1), spans is None)
                for s in spans if spans is not None else ():
                    live[max(0, s["from_"]) : max(0, s["to_"] - window + 1)] = True
                at, h = anchors(w, length, window, live)
                if not len(at):
                    continue
                # A run of one word sequence counts once, from its first place; the last level's are without gaps.
                new = np.ones(len(at), bool)
                new[1:] = (h[1:] != h[:-1]) | (last & (at[1:] != at[:-1] + 1))
                first = np.flatnonzero(new)
                end = np.append(first[1:], len(at)) - 1
                check = grams(np.ascontiguousarray(hashes[:, 1]), length, 1)[at[first]] if last else np.zeros(len(first), np.uint64)
                out.append((h[first].view(np.int64), check.view(np.int64), np.full(len(first), doc, np.int64), np.full(len(first), th, np.int64), at[first], at[end] - at[first] + 1))
            if out:
                rows = np.stack([np.concatenate([o[i] for o in out]) for i in range(6)])
                rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
                settled, kept, witnesses = _meet(rows, last)
                spans = _spans_of(settled, length, window)
                if last:
                    kept = np.vstack([kept, np.full(kept.shape[1], OPEN)])
                else:
                    kept = np.hstack([np.vstack([kept, np.full(kept.shape[1], OPEN)]), np.vstack([witnesses, np.full(witnesses.shape[1], WITNESS)])])
                yield _frame(np.hstack([kept, spans]), last)

    return run


def _meet(rows: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows (h, check, doc ...) those that are settled, those that still wait for others, and two witnesses of each window that two documents have.

    On the last level a row is settled if its window stands in a document of a smaller id, before it if in
    any other document.
    """
    h, check, doc = rows[:3]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(h)) - 1
    group = np.cumsum(new) - 1
    two = doc[first] < doc[end]
    settled = doc > doc[first][group] if last else two[group]
    return rows[:, settled], rows[:, ~settled], rows[:, np.append(first[two], end[two])]


def _spans_of(rows: np.ndarray, length: int, window: int) -> np.ndarray:
    """Settled windows as joined spans of words, each dealt by its document."""
    back = window - length
    by = np.lexsort((rows[4], rows[3], rows[2]))
    doc, th, a, b = _joined(rows[2][by], rows[3][by], rows[4][by] - back, (rows[4] + rows[5] - 1 + window)[by])
    key = mix(doc.astype(np.uint64)).view(np.int64)
    return np.vstack([key, np.zeros_like(doc), doc, th, a, b - a, np.full(len(doc), SPAN)])


def _frame(rows: np.ndarray, last: bool) -> pd.DataFrame:
    kinds = {"h": np.int64, "check": np.int64, "doc": np.int64, "th": np.int32, "pos": np.int32, "n": np.int32, "kind": np.int8}
    return pd.DataFrame({c: rows[i].astype(t) for i, (c, t) in enumerate(kinds.items()) if last or c != "check"})


def _decide(length: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spans that are settled among all rows of a window, which come sorted by window and document.

        Between batches one window is held: before the last level the rows of its one document, or two
        witnesses; on the last level its smallest document.
        """
        last = length == window
        held = np.empty((7, 0), np.int64)
        for pdf in batches:
            if "check" not in pdf:
                pdf = pdf.assign(check=0)
            rows = pdf[["h", "check", "doc", "th", "pos", "n", "kind"]].to_numpy(np.int64).T
            done = rows[:, rows[6] == SPAN]
            rows = np.hstack([held, rows[:, rows[6] != SPAN]])
            settled, waiting, witnesses = _meet(rows, last) if rows.shape[1] else (rows, rows, rows)
            if rows.shape[1]:
                tail = (rows[:2] == rows[:2, -1:]).all(axis=0)
                own = rows[:, tail]
                if last:
                    held = own[:, :1].copy()
                    held[6] = WITNESS
                elif own[2, 0] < own[2, -1]:
                    held = own[:, [0, -1]].copy()
                    held[6] = WITNESS
                else:
                    held = own.copy()
            settled = _spans_of(settled[:, settled[6] == OPEN], length, window)
            both = np.hstack([done[2:6], settled[2:6]])
            yield pd.DataFrame({"doc": both[0], "th": both[1].astype(np.int32), "from_": both[2].astype(np.int32), "to_": (both[2] + both[3]).astype(np.int32)})

    return run


def _joined(doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans sorted by (doc, th, a) with overlapping or touching ones of a document joined."""
    if not len(doc):
        return doc, th, a, b
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    group = np.cumsum(fresh)
    far = 1 << 40  # a document's words are fewer: later documents' ends always exceed earlier ones'
    reach = np.maximum.accumulate(b + group * far) - group * far
    fresh[1:] |= a[1:] > reach[:-1]
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(doc)) - 1
    return doc[start], th[start], a[start], reach[end]


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (doc, th, from_, to_) with overlapping or touching spans of a document joined."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        doc, th, a, b = _joined(*(pdf[c].to_numpy(np.int64) for c in ("doc", "th", "from_", "to_")))
        out = pd.DataFrame({"doc": doc, "th": th.astype(np.int32), "from_": a.astype(np.int32), "to_": b.astype(np.int32)})
        held = out.iloc[-1:]
        yield out.iloc[:-1]
    if held is not None:
        yield held


def _spans(rows: DataFrame) -> DataFrame:
    """(doc, th, from_, to_) rows as one row for each document with its joined spans in order."""
    rows = rows.repartition("doc", "th").sortWithinPartitions("doc", "th", "from_")
    rows = rows.mapInPandas(_merge, "doc long, th int, from_ int, to_ int")
    return save(rows.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("from_", "to_"))).alias("spans")), "spans")


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """docs with their spans, which are broadcast only if their measured bytes are few."""
    s = sized(spans.withColumnsRenamed({"doc": "doc_id"}), F.size("spans") * 32 + 96)
    return docs.join(s, ["doc_id", "th"], how)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts, gone, digests, kept_texts = [], [], [], []
        for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
            words = text.encode().split()
            n = len(words)
            if spans is not None and len(spans):
                kept, at = [], 0
                for s in spans:
                    kept += words[at : s["from_"]]
                    at = s["to_"]
                words = kept + words[at:]
            kept_text = b" ".join(words)
            counts.append(n)
            gone.append(n - len(words))
            digests.append(hashlib.sha256(kept_text).hexdigest())
            kept_texts.append(kept_text.decode())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": counts, "n_removed": gone, "kept_sha256": digests, "kept_text": kept_texts})


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc, th, spans): the words of each document in windows that a document of a smaller id has too.

    Lengths double, from less than LEAST_LENGTH words, until the window's is reached or no candidate survives.
    At each length only the windows are compared that are the least, by hash, of some full window which may
    still be shared: a full window that two documents share has the same least part in both. Those that two
    documents have are extended to the next length; the last one is the window itself, where the later
    documents' windows are the result. For 13 words the lengths are 7 and 13. Full windows are equal if the
    128 bits of a hash over keyed digests of their words are.
    Texts are read once a level. Their windows meet by hash, after those of one Arrow batch have met: a
    passage that very many documents share is a few rows of each batch. Only hashes and places are shuffled,
    never texts, unless the spans exceed what may be broadcast.
    """
    texts = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text")).withColumn("th", F.hash("text"))
    spans = None
    for length in lengths(window):
        last = length == window
        live = texts.select("doc_id", "th", "text") if spans is None else _with_spans(texts, spans, "inner").select("doc_id", "th", "text", "spans")
        check = ["check"] if last else []
        level = live.mapInPandas(_level(length, window), f"h long, {'check long, ' if last else ''}doc long, th int, pos int, n int, kind byte")
        met = level.repartition("h").sortWithinPartitions("h", *check, "doc")
        spans = _spans(met.mapInPandas(_decide(length, window), "doc long, th int, from_ int, to_ int"))
        if spans.isEmpty():
            break
    return spans


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs (doc_id, text) without the words of windows that also start in a document of a smaller id.

    Words are runs of characters other than blanks and tabs to carriage returns. Windows are judged on
    the input. A null text has no words; a row with a null id keeps all its words and removes none; rows
    that share an id do not remove each other's words. An empty table gives an empty result; other
    columns are ignored; of equal rows of one id all stay. A text of any length is handled whole, by one task.

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).
    """
    spans = repeated_spans(docs, window)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.hash("text"))
    return _with_spans(texts, spans, "left").select("doc_id", "text", "spans").mapInPandas(
        _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
