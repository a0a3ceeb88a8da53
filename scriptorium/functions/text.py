"""Units of a text as Column functions: words, paragraphs, sentences, shingles, n-grams.

Null text has null units; an empty text has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import Profile
from .regex import B, S, let, quick, trimmed


def words(text: Column, profile: Profile) -> Column:
    """Lower-cased tokens: each begins with a letter; elision or contraction by profile."""
    return F.regexp_extract_all(F.lower(text), F.lit(profile.word), F.lit(0))


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(text, F.lit(quick(f"[^{S[1:-1]}]+"))).cast("long")


def display(tokens: Column) -> Column:
    """Tokens joined by a space, but none after an elided word."""
    return F.replace(F.array_join(tokens, " "), F.lit("' "), F.lit("'"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def filled(parts: Column) -> Column:
    """Trimmed, without blank ones."""
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return filled(F.split(text, r"\n[ \t]*\n", -1))


def sentence_cut(profile: Profile) -> str:
    """Where a line is cut: after a terminator before white space, but for abbreviations."""
    short = "|".join([*profile.abbreviations, r"\p{L}"])
    return quick(rf"(?iu)(?<=[.!?])(?<!(?:^|[^\p{{L}}])(?:{short})\.)(?={S})")


def sentences(text: Column, profile: Profile) -> Column:
    """Sentences inside lines, those that hold a word.

    Cuts become ends of lines, so the pattern is compiled once and not for every line.
    """
    cut = lines(F.regexp_replace(text, sentence_cut(profile), "\n"))
    return F.filter(F.transform(cut, trimmed), lambda x: F.regexp_like(F.lower(x), F.lit(profile.word)))


def grams(tokens: Column, size: int) -> Column:
    """Runs of ``size`` neighbouring tokens, as arrays."""
    count = F.greatest(F.size(tokens) - (size - 1), F.lit(0))
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(2), count), lambda i: F.slice(tokens, i, size))


def shingles(text: Column, size: int = 4) -> Column:
    """Distinct runs of ``size`` words of letters, joined by a space."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return let(tokens, lambda t: F.array_distinct(F.transform(grams(t, size), lambda g: F.array_join(g, " "))))


def bounded(pattern: str) -> str:
    """A pattern with @ for an ASCII word boundary, case folded."""
    return quick("(?iu)" + pattern.replace("@", B).replace(r"\s", S))
