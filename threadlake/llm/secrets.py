"""Secret scans: assignments, access keys, hex strings and strings of high entropy, all in Spark SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

# The three base kinds, their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]
#: A candidate string: a whole run of these characters, long enough, with a letter.
RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{RUN})(?=[0-9+/_=-]*[A-Za-z]){RUN}{{20,}}+"
#: Characters of a sliding window, and the fewest that a value needs once words and signs are taken out.
WINDOW, LEAST_VALUE = 20, 16
HEX_CLASS = r"^([0-9a-f]+|[0-9A-F]+)$"
#: Classes of values with the sizes of their alphabets; the first that fits counts. All others are mixed.
CLASSES = [(HEX_CLASS, 16), (r"^([a-z]+|[A-Z]+)$", 26), (r"^[A-Z2-7]+$", 32), (r"^([a-z0-9]+|[A-Z0-9]+)$", 36)]
MIXED = 62
#: A class's threshold lies so many standard deviations below the mean of a random window.
DEVIATIONS = 2.5
#: Runs of which no part has both letters and digits but perhaps the first: all others of so many bits count whole.
SLUG = r"^[A-Za-z]*[0-9]{0,4}([-_/+=]+([A-Za-z]+|[0-9]{1,4}))*[-_/+=]*$"
WHOLE_BITS = 3.9
# Parts of a run, from sign to sign, that are no secrets. Words of eight letters and more can be spoken.
_FROM, _TO = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
_UNSPOKEN = "[bcdfghjklmnpqrstvwxz]{4}|[aeiouy]{4}|j[bcdfghjklmnpqrstvwxz]|q[a-tv-z]|v[bcdfgjkmnpqtvwxz]"
_WORD = rf"(?!(?=[A-Za-z]{{8}})[A-Za-z]*?(?:{_UNSPOKEN}|{_UNSPOKEN.upper()}))(?:[A-Z]?[a-z]++(?:[A-Z][a-z]{{2,}}+){{0,12}}+|[A-Z]++)"
_FILLER = "(?i:example|sample|dummy|placeholder|changeme|redacted|x{4,}+)"
#: Taken out of a run: counting and repeated characters, UUIDs, words, small numbers, fillers.
ALLOWED = [
    r"(?i)abcdefghijklmnopqrstuvwxyz|abcdefghijklmnop|abcdefgh|0123456789abcdef|0?123456789?0?|01234567|(.)\1{7,}+",
    rf"{_FROM}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{_TO}",
    rf"^{_WORD}[0-9]{{1,4}}{_TO}|{_FROM}(?:{_WORD}|[0-9]{{1,4}}|{_FILLER}{{1,4}}[0-9]*){_TO}",
]
#: What stands in a text for what redact() takes out.
MASK = "[REDACTED]"

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _chunks(values: Column, then: Callable[[Column], Column]) -> Column:
    """then(chunks) of an array cut in pieces of the cube root of its length, or of 16 if that is more.

    Appending to an array copies it; over pieces, and over one entry for each piece, n appends copy
    about n ** (4 / 3) entries instead of n ** 2.
    """

    def cut(v: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(v))).cast("int"))
        last = F.greatest(F.floor((F.size(v) - 1) / size).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(v, c * size + 1, size))

    return _with(_with(values, cut), then)


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of an array's whole numbers, op over those before it, from 0."""
    zero = F.lit(0)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def scan(v: Column, first: Column) -> Column:
        return F.aggregate(v, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def over(chunks: Column) -> Column:
        starts = scan(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero)
        return F.flatten(F.zip_with(chunks, starts, scan))

    return _chunks(values, over)


def _find(text: Column, pattern: str, rank: Column | int, least_group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their strings; what stands between them, split off, gives their places."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_group else whole
    sizes = F.transform(
        F.arrays_zip(between.alias("between"), whole.alias("whole"), value.alias("value")),
        lambda p: F.struct(
            F.length(p["between"]).alias("before"), F.coalesce(F.length(p["whole"]), F.lit(0)).alias("own"),
            (F.coalesce(F.length(p["value"]), F.lit(0)) >= max(1, least_group)).alias("kept"), p["whole"].alias("string"),
        ),
    )

    def placed(parts: Column) -> Column:
        at = running(F.transform(parts, lambda p: p["before"] + p["own"]))
        spans = F.zip_with(
            parts, at,
            lambda p, a: F.struct((a + p["before"]).alias("start"), F.lit(rank).alias("rank"), (a + p["before"] + p["own"]).alias("end"), p["string"].alias("string"), p["kept"].alias("kept")),
        )
        return F.filter(spans, lambda x: x["kept"])

    return _with(sizes, placed)


def _places(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def window_bits(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the ASCII text's windows.

    With counts c of the characters in a window of w, it is log2 w - sum(c log2 c) / w. Moving on by one
    character changes two counts, and so two terms of the sum. The counts are kept in a string, one
    character each, of which a step replaces two.
    """
    w = F.least(F.lit(window), F.length(text))
    f = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    more = F.array(*[F.lit(f[c + 1] - f[c]) for c in range(window + 1)])
    state = F.struct(F.repeat(F.lit("0"), 128).alias("count"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

    def codes(v: Column) -> Column:
        return F.transform(F.slice(F.split(v, ""), F.lit(1), F.length(v)), F.ascii)

    def moves(c: Column) -> Column:
        old = F.slice(F.concat(F.array_repeat(F.lit(-1), window), c), F.lit(1), F.size(c))
        return F.transform(F.arrays_zip(c.alias("new"), old.alias("old")), lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), (i + 1).alias("n")))

    def count(held: Column, code: Column) -> Column:
        return F.ascii(F.substring(held, code + 1, F.lit(1))) - ord("0")

    def put(held: Column, code: Column, c: Column) -> Column:
        return F.overlay(held, F.char(c + ord("0")), code + 1, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        def added(k: Column) -> Column:
            return F.struct(put(acc["count"], x["new"], k + 1).alias("count"), (acc["sum"] + F.get(more, k)).alias("sum"))

        def dropped(m: Column) -> Column:
            fewer = _with(count(m["count"], x["old"]) - 1, lambda k: F.struct(put(m["count"], x["old"], k).alias("count"), (m["sum"] - F.get(more, k)).alias("sum")))
            return F.when(x["old"] < 0, m).otherwise(fewer)

        def judged(m: Column) -> Column:
            least = F.when(x["n"] >= w, F.least(acc["least"], m["sum"])).otherwise(acc["least"])
            return F.struct(m["count"].alias("count"), m["sum"].alias("sum"), least.alias("least"))

        return _with(_with(_with(count(acc["count"], x["new"]), added), dropped), judged)

    return F.aggregate(_with(codes(text), moves), state, step, lambda a: F.log2(w.cast("double")) - a["least"] / w)


def least_bits(alphabet: int, window: int) -> float:
    """The bits a character that a random window over an alphabet hardly ever falls below.

    The window's entropy is log2 w - sum(c log2 c) / w over the counts c of its characters, whose mean and
    variance follow from one and two cells of the multinomial distribution.
    """
    w, p = window, 1 / alphabet
    f = [c * math.log2(c) if c else 0.0 for c in range(w + 1)]
    one = [math.comb(w, c) * p**c * (1 - p) ** (w - c) for c in range(w + 1)]
    mean = alphabet * sum(q * x for q, x in zip(one, f))
    square = alphabet * sum(q * x * x for q, x in zip(one, f))
    for c in range(w + 1):
        for d in range(w + 1 - c):
            square += alphabet * (alphabet - 1) * math.comb(w, c) * math.comb(w - c, d) * p ** (c + d) * (1 - 2 * p) ** (w - c - d) * f[c] * f[d]
    return math.log2(w) - mean / w - DEVIATIONS * math.sqrt(max(square - mean * mean, 0.0)) / w


def _needed(value: Column) -> Column:
    """The bits that a value of at least LEAST_VALUE characters needs, by its class and length."""

    def of(alphabet: int) -> Column:
        bits = F.array(*[F.lit(least_bits(alphabet, w)) for w in range(LEAST_VALUE, WINDOW + 1)])
        return F.get(bits, F.least(F.length(value), F.lit(WINDOW)) - LEAST_VALUE)

    out = None
    for pattern, alphabet in CLASSES:
        out = F.when(value.rlike(pattern), of(alphabet)) if out is None else out.when(value.rlike(pattern), of(alphabet))
    return out.otherwise(of(MIXED))


def _entropy(text: Column) -> Column:
    """Candidate strings with a value, words and other harmless parts taken out, that reaches its class's bits."""
    found = _find(text, CANDIDATE, KINDS.index("entropy_mixed"))

    def parted(s: Column) -> Column:
        string = value = s["string"]
        for pattern in ALLOWED:
            value = F.regexp_replace(value, F.lit(pattern), F.lit("-"))
        value = F.regexp_replace(value, F.lit("[-_/+=]"), F.lit(""))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), string.alias("string"), value.alias("value"))

    def judged(s: Column) -> Column:
        value, string = s["value"], s["string"]
        long = (F.length(value) >= LEAST_VALUE) & value.rlike("[A-Za-z]")
        own = F.when(long, window_bits(value) >= _needed(value)).otherwise(F.lit(False))
        # A run in groups ("AB12-CD3E-...") counts as one value if its parts are not words and numbers alone.
        grouped = (F.length(value) > 0) & string.rlike("[-_/+=]") & ~string.rlike(SLUG)
        whole = F.when(grouped, window_bits(string) >= WHOLE_BITS).otherwise(F.lit(False))
        rank = F.when(value.rlike(HEX_CLASS), KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_mixed"))
        return F.struct(s["start"].alias("start"), F.when(own | whole, rank).otherwise(-1).alias("rank"), s["end"].alias("end"))

    return F.filter(F.transform(F.transform(found, parted), judged), lambda s: s["rank"] >= 0)


def spans(text: Column) -> Column:
    """All spans of a text, by start and then kind; kinds by their place in KINDS, offsets in code points."""
    none = F.array().cast(_SPAN)
    found = [
        F.when(text.rlike(ASSIGN), _places(_find(text, ASSIGN, 0, least_group=ASSIGN_LEAST))).otherwise(none),
        F.when(text.contains("AKIA"), _places(_find(text, ACCESS, 1))).otherwise(none),
        F.when(text.rlike(HEX), _places(_find(text, HEX, 2))).otherwise(none),
        F.when(text.rlike(CANDIDATE), _entropy(text)).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def _joined(s: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def _same(k: int):
    """x where it is k, else null."""
    return lambda x: F.when(x == k, x)


def scan(docs: DataFrame) -> DataFrame:
    """Find the secrets in every whole text of docs (doc_id, text); a null text counts as empty.

    One pass of built-in functions, no shuffle, no Python; rows with null or repeated doc_id are rows like
    any other, an empty table gives an empty result, other columns are ignored.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", spans(F.col("text")).alias("s"))
    ranks = F.transform("s", lambda x: x["rank"])
    counts = [F.size(F.array_compact(F.transform(ranks, _same(k)))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = F.sha2(_joined(F.filter("s", lambda x: x["rank"] < 3)).cast("binary"), 256)
    return rows.select("doc_id", *counts, base.alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every one of its spans, overlapping ones together, replaced by MASK."""

    def clean(s: Column) -> Column:
        past = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        # What stands before each span that does not overlap the ones before it, and the rest of the text.
        before = F.filter(F.zip_with(s, past, lambda x, p: F.struct(p.alias("from_"), x["start"].alias("to_"))), lambda g: g["to_"] >= g["from_"])
        rest = F.struct(F.array_max(F.transform(s, lambda x: x["end"])).alias("from_"), F.length(text).alias("to_"))
        return _chunks(F.array_append(before, rest), lambda chunks: F.array_join(F.flatten(F.transform(chunks, cut)), MASK))

    def cut(chunk: Column) -> Column:
        first = F.get(chunk, 0)["from_"]
        own = F.substring(text, first + 1, F.element_at(chunk, -1)["to_"] - first)
        return _with(own, lambda t: F.transform(chunk, lambda g: F.substring(t, g["from_"] - first + 1, g["to_"] - g["from_"])))

    return F.when(F.size(found) == 0, text).otherwise(clean(found))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by MASK and n_chars, where there is one, counted again.

    Rows and columns stay as they are, repeated rows too; a null text stays null. An empty table gives an
    empty result. Work grows with n ** (4 / 3) for n secrets of a text.
    """
    spare = "__secret_spans"
    while spare in docs.columns:
        spare += "_"
    out = docs.withColumn(spare, spans(text_or_empty()))
    out = out.withColumn("text", F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(redacted(F.col("text"), F.col(spare))))
    if "n_chars" in docs.columns:
        changed = F.size(spare) > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
