"""Full-text search: tokens, phrase tiers, and BM25 by one scan; operators/postings.py has the stored index."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadlake.functions.text import query_terms

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _plain_letters() -> tuple[str, str]:
    """Latin letters with one mark, and the letters without it."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) == 2 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, PLAIN = _plain_letters()
_TABLE, _MARKS = str.maketrans(MARKED, PLAIN), r"[̀-ͯ]"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.when(_ascii(text), low).otherwise(F.regexp_replace(F.translate(low, MARKED, PLAIN), _MARKS, ""))
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def marked_tokens(text: Column) -> Column:
    """tokens() whose letters still have the one mark that without_marks() takes off, as that is quicker for each word once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.when(_ascii(text), low).otherwise(F.regexp_replace(low, _MARKS, ""))
    return F.array_remove(F.split(bare, r"[^\p{L}\p{N}]+"), "")


def without_marks(token: str) -> str:
    return token if token.isascii() else token.translate(_TABLE)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def field_tokens(fields: Column) -> Column:
    """The tokens of each of some texts in turn, with an empty one after each text, so that no phrase leaves it."""
    return F.flatten(F.transform(fields, lambda t: F.concat(tokens(t), F.array(F.lit("")))))


def words(text: str) -> list[str]:
    """tokens() of a string on the driver."""
    bare = re.sub(_MARKS, "", without_marks(text.lower()))
    return re.findall(r"[^\W_]+", bare)


def strict_phrases(query: str) -> list[list[str]]:
    """Each word of a query as the tokens of a phrase, all of which are wanted."""
    return [p for w in query.split() if (p := words(w))]


def relaxed_phrases(query: str) -> list[list[str]]:
    """A query's terms that say something, any of which will do; none if that is no other search than the strict one."""
    terms = [p for t in query_terms(query) if (p := words(t))]
    return terms if len(terms) > 1 else []


def postings(docs: DataFrame, key: str = "event_id") -> DataFrame:
    """(doc, term, pos) of every token of text."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def _count(hits: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a text's hits (p, t): places of its first token that the others follow."""

    def places(t: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h["t"] == t), lambda h: h["p"])

    def followed(first: Column, k: int, t: str) -> Column:
        after = places(t)
        return F.filter(first, lambda p: F.array_contains(after, p + k))

    first = places(phrase[0])
    for k, t in enumerate(phrase[1:], 1):
        first = followed(first, k, t)
    return F.size(first).cast("long")


def matched(docs: DataFrame, phrases: list[list[str]], seen: Observation | None = None) -> DataFrame:
    """docs whose text, or one of whose fields, has one of the phrases, with dl, the number of tokens, and f, each phrase's count.

    Nothing is shuffled: a text's tokens are cut down to the query's where it is read. seen observes n, all
    documents that were read, and total, all their tokens.
    """
    wanted = sorted({t for p in phrases for t in p})
    fielded = "fields" in docs.columns
    rows = docs.withColumn("__tokens", field_tokens(F.col("fields")) if fielded else tokens(F.col("text")))
    rows = rows.withColumn("dl", (F.size("__tokens") - (F.size("fields") if fielded else 0)).cast("long"))
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    hits = F.filter(F.transform("__tokens", lambda t, i: F.struct(i.alias("p"), t.alias("t"))), lambda h: h["t"].isin(wanted) if wanted else F.lit(False))
    rows = rows.withColumn("__hits", hits).where(F.size("__hits") > 0)
    f = F.array(*[_count(F.col("__hits"), p) for p in phrases]) if phrases else F.array().cast("array<long>")
    return rows.withColumn("f", f).drop("__tokens", "__hits").where(F.exists("f", lambda n: n > 0))


def scored(rows: DataFrame, size: tuple[int, int], which: list[int], every: bool) -> DataFrame:
    """matched() rows that have every one, or any, of the phrases `which`, with their BM25 score: smaller is better.

    The number of documents that have a phrase is one row of counts on the driver.
    """
    if not which:
        return rows.where("false").withColumn("score", F.lit(0.0))
    n, total = size
    own = [F.get("f", i) for i in which]
    df = rows.agg(*[F.count_if(F.get("f", i) > 0) for i in which]).first()
    score = F.lit(0.0)
    for f, d in zip(own, df, strict=True):
        idf = F.log((F.lit(n) - d + 0.5) / (F.lit(d) + 0.5))
        part = F.when(idf <= 0, LEAST_IDF).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(max(total, 1) / max(n, 1))))
        score = score - F.when(f > 0, part).otherwise(0.0)
    has = [f > 0 for f in own]
    keep = has[0]
    for h in has[1:]:
        keep = keep & h if every else keep | h
    return rows.where(keep).withColumn("score", score)
