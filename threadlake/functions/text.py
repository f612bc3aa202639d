"""Text expressions that ranking, summaries and redaction share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that relaxed matching and topics pass over.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have",
    "how", "if", "in", "into", "is", "it", "its", "just", "kind", "make", "me", "my", "of", "on", "or", "out", "so", "than", "that",
    "the", "then", "there", "this", "to", "was", "we", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you",
]
# Token patterns in the order they are applied, with what replaces them.
# A border of words in ASCII stands for \b, which differs between dialects.
_BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TOKEN_PATTERNS = [
    # A scheme is read from its last part that starts with a letter on: what stands before stays as it is anyway.
    (r"(?i)(?<![A-Za-z0-9_])([a-z][a-z0-9]*+(?:[+.-]++[0-9][a-z0-9]*+)*+[+.-]*+://[^:\s/@]*+:)(?!\[REDACTED:secret\])([^@\s/]++)(@)", "$1[REDACTED:secret]$3"),
    (r"(?i)Authorization:\s*Bearer\s+(?!\[REDACTED:token\])[^\s\"']+", "Authorization: Bearer [REDACTED:token]"),
    (r"(?<![A-Za-z0-9_])Bearer\s+(?!\[REDACTED:token\])[^\s\"']+", "Bearer [REDACTED:token]"),
    (r"(?<![A-Za-z0-9_])(sk-[A-Za-z0-9]+)[-_][A-Za-z0-9_-]{6,}" + _BORDER, "$1_[REDACTED:token]"),
    (r"(?<![A-Za-z0-9_])ghp_[A-Za-z0-9_]{20,}(?![A-Za-z0-9_])", "ghp_[REDACTED:token]"),
    (r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{20,}(?![A-Za-z0-9_])", "github_pat_[REDACTED:token]"),
    (r"(?<![A-Za-z0-9_])xox[baprs]-[A-Za-z0-9-]{16,}" + _BORDER, "xox[REDACTED:token]"),
    (r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])", "AKIA[REDACTED:token]"),
]
KEY_END = r"-----END [A-Z ]*PRIVATE KEY-----"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?" + KEY_END


def compact(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; a run that is one space already is no match, which most are."""
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def trimmed(c: Column) -> Column:
    """c without outer white space of any kind; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def beginning(c: Column, least: int) -> Column:
    """A compacted text, of a long one only a first part of more than `least` characters: for headings and cuts that show no more than that."""
    first = F.array(compact(F.substring(c, 1, 3 * least)))
    return F.get(F.transform(first, lambda t: F.when(F.length(t) > least, t).otherwise(compact(c))), 0)


def truncated(c: Column, most: int) -> Column:
    """Compacted text, cut one short of `most` with three dots if longer."""
    t = compact(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"\s+$", ""), F.lit("...")))


def title(c: Column) -> Column:
    """A text's heading: without a polite opening, 88 characters, never empty."""
    t = F.regexp_replace(compact(c), r"(?i)^please\s+", "")
    t = F.regexp_replace(t, r"(?i)^(can you|could you|do you|does this)\s+", "")
    return F.coalesce(F.nullif(truncated(t, 88), F.lit("")), F.lit("Session"))


def token_estimate(c: Column) -> Column:
    """A quarter of the compacted characters, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(compact(c)) / 4)).cast("long")


def signal_terms(c: Column, most: int, unique: bool) -> Column:
    """Lower-cased words of a text that say something, the first `most` of them.

    The first characters, then the first words are looked at alone if they have that many; a long text is looked at whole only if not.
    """
    def words(t: Column) -> Column:  # without dashes at their ends
        return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"), F.lit(0))

    def says(w: Column) -> Column:
        return (F.length(w) >= 2) & ~w.isin(STOP_WORDS) & ((F.length(w) >= 3) | w.rlike("[-0-9]"))

    def kept(some: Column) -> Column:
        out = F.filter(some, says)
        return F.slice(F.array_distinct(out) if unique else out, 1, most)

    def chosen(w: Column) -> Column:
        first = kept(F.slice(w, 1, 5 * most))
        return F.when((F.size(w) <= 5 * most) | (F.size(first) >= most), first).otherwise(kept(w))

    # The last word may be cut off, and what follows a word may tell how its last letter is lower-cased.
    def early(w: Column) -> Column:
        return kept(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))

    whole = F.get(F.transform(F.array(words(c)), chosen), 0)
    first = F.transform(F.array(words(F.substring(c, 1, 16 * most))), early)
    return F.get(F.transform(first, lambda w: F.when(F.size(w) >= most, w).otherwise(whole)), 0)


def query_terms(query: str, most: int = 12) -> list[str]:
    """signal_terms of a query string, unique, on the driver."""
    out: list[str] = []
    for w in re.split(r"[^\w-]+", query.lower()):
        w = w.strip("-")
        if len(w) >= 2 and w not in STOP_WORDS and (re.search(r"[-\d]", w) or len(w) >= 3) and w not in out:
            out.append(w)
    return out[:most]


def contains_term(low: Column, term: str) -> Column:
    """Whether lower-cased text has a term; numbers only whole, dashes and underscores also as spaces."""
    if term.isdigit():
        return low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])")
    found = low.contains(term)
    if re.search("[-_]", term):
        found = found | F.regexp_replace(low, "[-_]+", " ").contains(re.sub("[-_]+", " ", term))
    return found


def has_term(low: Column, term: Column) -> Column:
    """contains_term for a term that is a column."""
    plain = F.contains(low, term) | F.contains(F.regexp_replace(low, "[-_]+", " "), F.regexp_replace(term, "[-_]+", " "))
    whole = F.rlike(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), term, F.lit(r"(?![\p{L}\p{N}_])")))
    return F.when(term.rlike("^[0-9]+$"), whole).when(term.rlike("[-_]"), plain).otherwise(F.contains(low, term))


def term_hits(c: Column, terms: list[str]) -> Column:
    """How many of the terms a text has."""
    low, out = F.lower(c), F.lit(0)
    for t in terms:
        out = out + contains_term(low, t).cast("int")
    return out.cast("long")


def has_query(c: Column, query: str) -> Column:
    """Whether a text has the whole query or one of its terms; an empty query is in every text."""
    whole = query.strip().lower()
    if not whole:
        return F.lit(True)
    low = F.lower(c)
    out = low.contains(whole)
    for t in query_terms(whole):
        out = out | contains_term(low, t)
    return out


def occurrences(low: Column, needle: str) -> Column:
    """How often a string stands in a text, without overlaps."""
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def term_count(low: Column, term: str) -> Column:
    """How often lower-cased text has a term, by the rules of contains_term."""
    if term.isdigit():
        return F.regexp_count(low, F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_]){term}(?=$|[^\p{{L}}\p{{N}}_])")).cast("long")
    found = occurrences(low, term)
    if re.search("[-_]", term):
        found = F.when(found > 0, found).otherwise(occurrences(F.regexp_replace(low, "[-_]+", " "), re.sub("[-_]+", " ", term)))
    return found


def directness(c: Column, terms: list[str], weight: float) -> Column:
    """Points for each of the terms that a text has, less one for each repetition, six at most."""
    low, unique, total = F.lower(c), F.lit(0), F.lit(0)
    for t in terms:
        n = term_count(low, t)
        unique, total = unique + (n > 0).cast("long"), total + n
    return unique * weight - F.least(F.greatest(total - unique, F.lit(0)), F.lit(6))


def lines_of(c: Column) -> Column:
    return F.split(c, "\r?\n")


def node_title(c: Column) -> Column:
    """A summary's heading: its first bullet with a name in capitals or digits, else what it is about, else all."""
    bullet = F.get(F.filter(lines_of(c), lambda x: F.startswith(x, F.lit("- ")) & x.rlike("[A-Z0-9][A-Z0-9_-]{3,}")), 0)
    focus = F.get(F.filter(lines_of(c), lambda x: F.startswith(x, F.lit("Focus:"))), 0)
    return title(F.coalesce(F.regexp_replace(bullet, r"^-\s*", ""), F.regexp_replace(focus, r"^Focus:\s*", ""), c))


def snippet_cut(c: Column, most: int) -> Column:
    """Compacted text, cut three short of `most` with three dots if longer."""
    t = compact(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r"(?U)\s+$", ""), F.lit("...")))


def snippet(c: Column, query: str, most: int = 220) -> Column:
    """A text's best line for a query: that with most terms, topics last, cut around the query's own words."""
    terms = query_terms(query)
    lines = F.filter(F.transform(lines_of(c), compact), lambda x: x != "")
    scored = F.transform(lines, lambda x, i: F.struct((-term_hits(x, terms)).alias("k"), i.alias("i"), x.alias("line")))
    said = F.filter(scored, lambda x: (x["k"] < 0) & ~F.startswith(x["line"], F.lit("Topics:")))
    best = F.coalesce(F.array_min(said)["line"], F.array_min(scored)["line"], F.lit(""))
    phrase = re.sub(r"\s+", " ", query).strip().lower()
    body = most - 6
    place = F.locate(phrase, F.lower(best)) - 1
    start = F.greatest(F.lit(0), F.least(place - body // 3, F.length(best) - body))
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(best, start + 1, F.lit(body)), F.when(start + body < F.length(best), "...").otherwise(""))
    return F.when(F.length(best) <= most, best).when(place < 0, snippet_cut(best, most)).otherwise(around)


def excerpt(c: Column, query: str, most: int) -> Column:
    """`most` characters of a text from the first place on where one of the query's words stands."""
    words = [w for w in re.split("[^a-z0-9_-]+", query.lower()) if w]
    places = F.filter(F.array(*[F.locate(w, F.lower(c)) - 1 for w in words]) if words else F.array().cast("array<int>"), lambda p: p >= 0)
    hit = F.coalesce(F.array_min(places), F.lit(0))
    before, after = F.when(hit > 0, "...").otherwise(""), F.when(hit + most < F.length(c), "...").otherwise("")
    body = F.greatest(F.lit(0), F.lit(most) - F.length(before) - F.length(after))
    start = F.greatest(F.lit(0), F.least(hit, F.length(c) - body))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(before, F.substring(c, start + 1, body), after))


def quoted(c: Column, indent: str = "") -> Column:
    """A text as quotation, line by line."""
    return F.array_join(F.transform(lines_of(c), lambda x: F.concat(F.lit(f"{indent}> "), x)), "\n")


def strings_of(c: Column) -> Column:
    """The strings of a JSON array; of anything else, none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def iso(c: Column) -> Column:
    """A time text as ISO-8601 in UTC with milliseconds; null if it is none."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def redact_tokens(c: Column) -> Column:
    """Private keys and known token shapes replaced."""
    # Up to the last end every beginning has an end: none is looked for in vain.
    closed = F.coalesce(F.length(F.regexp_extract(c, rf"(?s)^.*{KEY_END}", 0)), F.lit(0))
    c = F.concat(F.regexp_replace(F.substring(c, F.lit(1), closed), PRIVATE_KEY, "[REDACTED:secret]"), F.substring(c, closed + 1, F.length(c)))
    for pattern, by in TOKEN_PATTERNS:
        c = F.regexp_replace(c, pattern, by)
    return c


def utf8_prefix(c: Column, most: int | Column) -> Column:
    """The longest prefix of whole characters in at most `most` UTF-8 bytes."""
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), F.lit(1), (F.lit(most) if isinstance(most, int) else most).cast("int")).cast("string"))
    whole = (F.octet_length(cut) <= most) & F.startswith(c, cut)
    return F.when(F.octet_length(c) <= most, c).when(whole, cut).otherwise(F.substring(cut, F.lit(1), F.length(cut) - 1))


def head_tail(c: Column, most: int, head: int) -> Column:
    """The first `head` and the last `most - head` elements of longer arrays."""
    return F.when(F.size(c) <= most, c).otherwise(F.concat(F.slice(c, 1, head), F.slice(c, -(most - head), most - head)))
