"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer T = normaliser o pieces o byte fallback maps a text to piece ids. An input is composed
with the normaliser as one array, cut into units where no piece crosses, and composed with the pieces unit
by unit; the best path in the tropical semiring (min, +) is the encoding. Arcs of a unigram model weigh
minus their piece's score. Arcs of a BPE model weigh 0, and are composed with an acceptor of piece pairs
that weighs a pair 0 if merging alone leaves the two apart, infinity if not; exactly one path of the
composition has a finite weight, the one that merging by rank gives.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .shared import text_or_empty

SPACE = "▁"
#: Starts of units whose best path a worker keeps, and judged pairs, before it starts anew.
CACHE_STARTS = 500_000
CACHE_PAIRS = 400_000
#: Starts of up to so many characters are kept.
SHARED_START = 32
# Fixed values of the model file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How much worse than the worst piece an unknown character is (a fixed value of the format).
UNKNOWN_PENALTY = 10.0
#: A state where no path ends: weight, last piece, ids.
NO_PATH = float("inf")
NEVER = (NO_PATH, "", b"")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffers message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            if tag & 7 == 2:
                n, at = varint(at)
            else:
                n = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Normaliser:
    """The first transducer: a text's code points to those of the normalised text.

    Its states are before the first word, in a word and in a gap. A space leads to a gap and gives nothing;
    any other character leads into a word, and gives the escaped space before itself if it comes from a gap,
    or from the start if the model puts a space there. A gap at the end gives nothing. The state at each
    place follows from the character before it, so a whole text runs through as one array. Without squeezing
    every space stands for itself.
    """

    def __init__(self, prefix: bool, squeeze: bool, escape: str):
        self.prefix, self.squeeze, self.escape = prefix, squeeze, ord(escape)

    def run(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        space = codes == 0x20
        if not self.squeeze:
            out = np.where(space, np.uint32(self.escape), codes)
            return np.concatenate([np.full(int(self.prefix), self.escape, "<u4"), out]) if len(out) else out
        at = np.flatnonzero(~space)
        gap = np.empty(len(at), np.int64)
        if len(at):
            gap[0] = self.prefix
            gap[1:] = at[1:] - at[:-1] > 1
        place = np.arange(len(at)) + np.cumsum(gap)
        out = np.full(len(at) + int(gap.sum()), self.escape, "<u4")
        out[place] = codes[at]
        return out


class Transducer:
    """A compiled model; encode and decode single texts."""

    def __init__(self, model: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))  # type: ignore[arg-type]
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))  # type: ignore[arg-type]
            elif number == 3:
                normalizer = dict(_fields(value))  # type: ignore[arg-type]
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0) or USER_DEFINED in self.kinds:
            raise ValueError("only unigram and BPE models without own symbols are supported")
        if normalizer.get(2):
            raise ValueError("normalisers with a character map are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.normaliser = Normaliser(self.prefix, bool(normalizer.get(4, 1)), SPACE if normalizer.get(5, 1) else " ")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (NORMAL, UNUSED)}
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.surface = [self._surface(i) for i in range(len(self.texts))]
        #: The ids that the arcs of a piece, or of a character's bytes, give.
        self.given: dict[str, bytes] = {t: struct.pack("<i", i) for t, i in self.ids.items()}
        #: Pieces by their characters from the last to the first; "" leads to the piece itself.
        self.backwards: dict = {}
        for t in self.ids:
            node = self.backwards
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[""] = t
        # Two characters that stand together in no piece part a text: no arc crosses between them.
        together = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self._class = np.zeros(0x110000, np.int32)
        letters = sorted({c for pair in together for c in pair})
        self._class[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self._crossed = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x, y in together:
            self._crossed[self._class[ord(x)], self._class[ord(y)]] = True
        self._states: dict[str, tuple[float, str, bytes]] = {"": (0.0, "", b"")}
        self._units: dict[str, bytes] = {}
        self._judged: dict[tuple[str, str], bool] = {}
        self._spines: dict[tuple[str, bool], list[tuple[str, float, float]] | None] = {}
        ranks = {x: i for i, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {t: ranks[self.scores[i]] for t, i in self.ids.items()}

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.texts[i][1:-1], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.texts[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[tuple[str, str]]:
        """The merges that text goes through, best score first, leftmost first: what defines a BPE model."""
        parts, done = list(text), []
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return done

    def spine(self, piece: str, right: bool) -> list[tuple[str, float, float]] | None:
        """The symbols at one end of a piece over its merges: symbol, rank it came by, rank it went by.

        None if merging does not give the piece.
        """
        key = (piece, right)
        if key not in self._spines:
            out: list[tuple[str, float, float]] | None = []
            symbol, gone = piece, float("inf")
            while True:
                if len(symbol) == 1:
                    out.append((symbol, -1, gone))
                    break
                merges = self.merged(symbol)
                if not merges or merges[-1][0] + merges[-1][1] != symbol:
                    out = None
                    break
                came = self.rank[symbol]
                out.append((symbol, came, gone))
                symbol, gone = merges[-1][right], came
            self._spines[key] = out
        return self._spines[key]

    def apart(self, left: str, right: str) -> bool:
        """Whether the pair's weight is 0: merging left + right alone ends in these two.

        It does if no merge across the border comes before the merge that takes one of its symbols away;
        at equal rank the left one of two merges comes first.
        """
        b = self.spine(right, False)
        if b is None or not left:
            return b is not None
        rank = self.rank
        for s, came, gone in self.spine(left, True) or ():
            for p, p_came, p_gone in b:
                r = rank.get(s + p)
                if r is not None and r < gone and r <= p_gone and came < p_gone and p_came < gone:
                    return False
        return True

    def _arcs(self, unit: str, j: int) -> list[tuple[int, str]]:
        """Where the arcs that end at place j of a unit start, and their pieces, the longest first.

        A character that is no piece has an arc of its own.
        """
        found, node, i = [], self.backwards, j
        while i:
            node = node.get(unit[i - 1])
            if node is None:
                break
            i -= 1
            if (piece := node.get("")) is not None:
                found.append((i, piece))
        if not found or found[0][0] < j - 1:
            found.insert(0, (j - 1, unit[j - 1]))
        found.reverse()
        return found

    def _ids(self, piece: str) -> bytes:
        """The ids that an arc gives; a character that is no piece falls back to its bytes."""
        if (ids := self.given.get(piece)) is None:
            each = [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.fallback else [self.unknown]
            ids = struct.pack(f"<{len(each)}i", *each)
        return ids

    def _best(self, unit: str, j: int, state) -> tuple[float, int, str]:
        """The best path to place j of a unit: its weight, and where its last arc starts, and that arc's piece."""
        if self.kind == BPE:
            judged = self._judged
            for i, piece in self._arcs(unit, j):
                so_far, before, _ = state(i)
                if so_far == NO_PATH:
                    continue
                ok = judged.get(pair := (before, piece))
                if ok is None:
                    ok = judged[pair] = self.apart(before, piece)
                if ok:  # the one path of finite weight that ends here
                    return 0.0, i, piece
            return NO_PATH, 0, ""
        best = (NO_PATH, 0, "")
        for i, piece in self._arcs(unit, j):
            weight = state(i)[0] - (self.scores[self.ids[piece]] if piece in self.ids else self.worst)
            if weight < best[0]:
                best = (weight, i, piece)
        return best

    def _walk(self, unit: str):
        """Compose a unit with pieces and pairs; returns what gives the state at each place.

        The path to a place depends only on what is before it, so units share the states of their common
        starts of up to SHARED_START characters.
        """
        known = self._states
        if len(known) > CACHE_STARTS:
            known.clear()
            known[""] = (0.0, "", b"")
        if len(self._judged) > CACHE_PAIRS:
            self._judged.clear()
        # With a start, all of its own starts are known: the longest known one is found by bisection.
        j, high = 0, min(len(unit), SHARED_START)
        while j < high:
            mid = (j + high + 1) // 2
            if unit[:mid] in known:
                j = mid
            else:
                high = mid - 1
        late: list[tuple[float, str, bytes]] = []

        def state(i: int) -> tuple[float, str, bytes]:
            return known[unit[:i]] if i <= SHARED_START else late[i - SHARED_START - 1]

        while j < len(unit):
            j += 1
            weight, i, piece = self._best(unit, j, state)
            if j > SHARED_START:
                late.append((weight, piece, b""))
            else:
                known[unit[:j]] = (weight, piece, state(i)[2] + self._ids(piece)) if piece else NEVER
        return state

    def path(self, unit: str) -> list[str]:
        """The pieces of the best path of a unit."""
        state, out, j = self._walk(unit), [], len(unit)
        while j:
            out.append(state(j)[1])
            j -= len(out[-1])
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        """The ids of the best path of a unit."""
        state, out, j = self._walk(unit), [], len(unit)
        while j > SHARED_START:  # a start that is kept has its ids
            piece = state(j)[1]
            out.append(self._ids(piece))
            j -= len(piece)
        return b"".join([state(j)[2], *reversed(out)])

    def normalise(self, text: str) -> str:
        return self.normaliser.run(text).tobytes().decode("utf-32-le", "surrogatepass")

    def units(self, codes: np.ndarray) -> list[str]:
        """A normalised text cut wherever no piece crosses."""
        if not len(codes):
            return []
        kind = self._class[codes]
        cuts = (np.flatnonzero(~self._crossed[kind[:-1], kind[1:]]) + 1).tolist()
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as int32."""
        units = self.units(self.normaliser.run(text))
        known = self._units
        if len(known) > CACHE_STARTS:
            known.clear()
        out = list(map(known.get, units))
        if None in out:
            for i, b in enumerate(out):
                if b is None:
                    u = units[i]
                    if (b := known.get(u)) is None:
                        b = known[u] = self._unit(u)
                    out[i] = b
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, the dummy prefix goes."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """One transducer for each worker, not for each task."""
    return Transducer(model)


def _runner(model: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compiled(model)
        fallback = np.zeros(len(t.texts), bool)
        fallback[list(t.bytes.values())] = True
        for pdf in batches:
            ids = [t.encode(x) for x in pdf["text"]]
            back = [t.decode(x) for x in ids]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_ids": [len(x) for x in ids],
                    "n_byte_ids": [int(fallback[x].sum()) for x in ids],
                    "ids": ids,
                    "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back],
                    "round_trip": [x == y for x, y in zip(back, pdf["text"], strict=True)],
                },
            )

    return run


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """Encode and decode again every whole text of docs (doc_id, text) with a model file's bytes.

    One pass without a shuffle; the model, well under 1 MB, travels in the closure. A null text counts
    as empty and gives no ids. Rows with null or repeated doc_id are rows like any other; an empty
    table gives an empty result; other columns are ignored.

    Returns doc_id, n_ids, n_byte_ids (ids of single bytes), ids, decoded_sha256 (of the decoded text)
    and round_trip (whether that is the text).
    """
    schema = "doc_id long, n_ids long, n_byte_ids long, ids array<int>, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(_runner(model), schema)
