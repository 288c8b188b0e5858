"""Tokens, keywords, stems and the size of a reply."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that carry no meaning in a task's description.
STOP_WORDS = (
    "a", "an", "the", "to", "from", "in", "on", "at", "by", "for", "with", "of", "and", "or", "is", "it", "that", "this", "be", "as", "are", "was",
    "add", "remove", "update", "fix", "change", "modify", "create", "delete", "field", "method", "class", "file", "when", "if", "not", "all", "new",
    "where", "what", "which", "why", "who", "whom", "whose", "how", "does", "do", "did", "were",
    "been", "can", "could", "should", "would", "will", "happen", "happens", "happening",
)

# Endings that a stem loses, the longest first.
SUFFIXES = ("ations", "ation", "ments", "ment", "ings", "ing", "ions", "ion", "ers", "er", "ies", "ied", "ed", "es", "s")
LEAST_STEM = 4


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keywords(text: Column | str) -> Column:
    """The distinct meaningful words of a text in order: over two letters or digits, no stop word."""
    words = F.transform(F.split(F.lower(_c(text)), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def stem(word: Column | str) -> Column:
    """The word without the first ending that leaves four letters or more; a doubled letter at the new end goes too."""
    w = _c(word)
    cut = None
    for s in SUFFIXES:
        fits = w.endswith(s) & (F.length(w) - len(s) >= LEAST_STEM)
        if s == "s":
            fits &= ~(w.endswith("ss") | w.endswith("us") | w.endswith("is"))
        shorter = F.substring(w, F.lit(1), F.length(w) - len(s))
        cut = F.when(fits, shorter) if cut is None else cut.when(fits, shorter)
    # at the end of what is left: a letter twice, none of aeious, and five letters or more
    undoubled = F.regexp_replace(cut, r"^(?=.{5})(.*)([a-z&&[^aeious]])\2$", "$1$2")
    return F.coalesce(undoubled, w)


#: Marks that stand after their letter.
MARKS = "\u0300-\u036f"


def accented_letters() -> dict[str, str]:
    """The lower-case letters that are one of a to z with marks, and that one, by Unicode's decompositions."""
    out = {}
    for n in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(n))
        if marks and "a" <= base <= "z" and all(unicodedata.category(m) == "Mn" for m in marks):
            out[chr(n)] = base
    return out


ACCENTED = accented_letters()


def folded(lower: Column | str) -> Column:
    """A lower-case text without the accents of a to z."""
    return F.regexp_replace(F.translate(_c(lower), "".join(ACCENTED), "".join(ACCENTED.values())), f"[{MARKS}]+", "")


def _plain(text: Column) -> Column:
    """Whether a text is ASCII alone, so that there is nothing to fold."""
    return F.length(text) == F.octet_length(text)


def folded_word(lower: Column | str) -> Column:
    """As ``folded``, of short texts most of which have no accents: those are passed through."""
    return F.when(_plain(_c(lower)), _c(lower)).otherwise(folded(lower))


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, with their accents, in order; as many as ``tokens``."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), rf"[^\p{{L}}\p{{N}}{MARKS}]+"), lambda t: F.when(_plain(t), t != "").otherwise(F.regexp_replace(t, f"[{MARKS}]+", "") != ""))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, without accents, in order."""
    return F.filter(F.split(folded(F.lower(F.coalesce(_c(text), F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def plain_tokens(text: str) -> list[str]:
    """As ``tokens``, of a query."""
    kept = [ACCENTED.get(c, c) for c in text.lower() if not "\u0300" <= c <= "\u036f"]
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in kept).split()


def fts_terms(query: str) -> list[tuple[list[str], bool]]:
    """The phrases of a query and whether the last word of each is a prefix: only that of the last phrase is."""
    found = [f for f in (plain_tokens(part) for part in query.rstrip("*").split()) if f]
    return [(f, n == len(found) - 1) for n, f in enumerate(found)]


def keyword_stems(spark: SparkSession, task: str) -> list[tuple[str, str]]:
    """(word, stem) of a task's keywords; the task is one text."""
    rows = spark.createDataFrame([(task,)], "t string").select(F.explode(keywords("t")).alias("word")).select("word", stem("word").alias("stem"))
    return [(r.word, r.stem) for r in rows.collect()]


def fts_matches(columns: list[Column], query: str) -> Column:
    """All phrases occur, each within one of the columns (arrays of tokens); without a phrase nothing matches."""
    terms = fts_terms(query)
    if not terms:
        return F.lit(False)
    out = F.lit(True)
    for words, prefix in terms:
        out &= _any([_phrase(c, words, prefix) for c in columns])
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out |= c
    return out


def _phrase(c: Column, words: list[str], prefix: bool) -> Column:
    if len(words) == 1:
        return F.exists(c, lambda t: t.startswith(words[0])) if prefix else F.array_contains(c, words[0])
    # tokens have no blanks, so that a phrase is a substring of the joined tokens
    joined = F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return joined.contains(" " + " ".join(words) + ("" if prefix else " "))


def like_pattern(column: Column | str, query: str) -> Column:
    return _c(column).ilike(f"%{query}%")


def token_estimate(text: Column | str) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(_c(text)) / 4).cast("bigint")


def saved_percent(without: Column, with_tool: Column) -> Column:
    return F.when(without == 0, F.lit(0.0)).otherwise(F.round((1 - with_tool / without) * 1000) / 10)
