"""Building blocks that keep the text semantics of the measures on the JVM.

White space here includes no-break and zero-width no-break spaces, word boundaries are
ASCII, and case is folded with accents. Rounding is half up on the double itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for use inside a character class.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
S = f"[{SPACE}]"
NOT_S = f"[^{SPACE}]"
#: The same where one test fails for what stands below them: a class of many ranges is a chain
#: of as many tests for each character.
_QUICK = r"\t\n\x0B\f\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
#: An ASCII word boundary.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def quick(pattern: str) -> str:
    """``pattern`` for the JVM, its white space in a form that is soon tested."""
    return pattern.replace(SPACE, _QUICK)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, quick(rf"\A{S}+|(?<!{S}){S}+\z"), "")


def absent(text: Column) -> Column:
    """Null for what is null or blank, else the trimmed text."""
    return F.nullif(trimmed(text), F.lit(""))


def rounded(value: Column, decimals: int) -> Column:
    """Half-up rounding of a double, as floor(x * 10**d + 1/2) / 10**d."""
    factor = float(10**decimals)
    return F.floor(value * factor + 0.5) / F.lit(factor)


def rate(count: Column, base: Column, per: float, decimals: int = 2) -> Column:
    """count / base * per, rounded; 0 where the base is 0."""
    exact = count.cast("double") / F.nullif(base, F.lit(0)).cast("double") * float(per)
    return F.coalesce(rounded(exact, decimals), F.lit(0.0))


def share(count: Column, base: Column) -> Column:
    return rate(count, base, 100.0, 1)


def count_of(text: Column, character: str) -> Column:
    """How often one character occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(quick(pattern))).cast("long")


def alternatives(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` has lambdas that
    refer to it (an outer expression inside a lambda is computed again for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def led(pattern: str, first: str) -> str:
    """``pattern`` tried only where a character of the class ``first`` stands, with which all
    its matches begin: one test at most places instead of all its branches."""
    flags, rest = pattern[: pattern.index(")") + 1] if pattern.startswith("(?i") else "", pattern
    return f"{flags}(?={first}){rest[len(flags) :]}"


def each_match(text: Column, pattern: str, step) -> Column:
    """``text`` with every match of ``pattern``, which is never empty, put through ``step``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), step)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda between, x: F.concat(between, F.coalesce(x, F.lit("")))), "")
