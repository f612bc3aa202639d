"""Hashes of words and of runs of words: keyed, 128 bits in two lanes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEY = b"threadlake words"
#: Digests that a worker remembers, of words of at most so many characters.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48
_FACTORS = ((0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD), (0xD1B54A32D192ED03, 0xA24BAED4963EE407))
_digests: dict[str, bytes] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _digest(word: str) -> bytes:
    """A keyed cryptographic digest of 16 bytes."""
    found = _digests.get(word)
    if found is None:
        found = hashlib.blake2b(word.encode(), digest_size=16, key=KEY).digest()
        if len(word) <= REMEMBERED_LENGTH:
            if len(_digests) >= REMEMBERED:
                _digests.clear()
            _digests[word] = found
    return found


def word_hashes(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, (words, 2): runs of characters other than blanks and tabs to carriage returns.

    The words of all texts are split and numbered at once, and each distinct one is digested once.
    """
    lists = pc.ascii_split_whitespace(pa.array(list(texts), pa.large_string()))
    flat = lists.flatten()
    is_word = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(is_word.to_numpy(zero_copy_only=False))])
    cuts = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else [0]
    coded = flat.filter(is_word).dictionary_encode()
    digests = np.frombuffer(b"".join(map(_digest, coded.dictionary.to_pylist())), "<u8").reshape(-1, 2)
    hashes = digests[coded.indices.to_numpy()]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield hashes[a:b]


def grams(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all n consecutive word hashes of one lane; empty if there are fewer.

    Hashes of 1, 2, 4 ... words are put together pairwise, and every step mixes: no polynomial, so that
    no arrangement of words cancels another.
    """
    if len(words) < n:
        return np.empty(0, np.uint64)
    p, q = map(np.uint64, _FACTORS[lane])

    def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = x * p + y
        h ^= h >> np.uint64(31)
        return h * q

    m = len(words) - n + 1
    size, part, parts = 1, words, {}
    while True:
        parts[size] = part
        if 2 * size > n:
            break
        part = pair(part[:-size], part[size:])
        size *= 2
    h, done = parts[size][:m], size
    for s in reversed(parts):
        if s < size and n & s:
            h = pair(h, parts[s][done : done + m])
            done += s
    return mix(h)


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal where both lanes are, in the order of the lanes."""
    by = np.argsort(a, kind="stable")
    same = a[by][1:] == a[by][:-1]
    if (same & (b[by][1:] != b[by][:-1])).any():  # two hashes of one first lane: the second one decides
        by = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    out = np.empty(len(a), np.int64)
    out[by] = np.cumsum(new) - 1
    return out


def shingles(texts: Iterable[str], n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-grams of words, (n-grams, 2); none for fewer than n words."""
    for w in word_hashes(texts):
        a, b = (grams(np.ascontiguousarray(w[:, lane]), n, lane) for lane in (0, 1))
        first = np.unique(numbered(a, b), return_index=True)[1]
        yield np.column_stack([a[first], b[first]])
