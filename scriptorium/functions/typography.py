"""The typography table, normalisation and counts of the characters it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASHES = (0x2013, 0x2014, 0x2015)
#: Class -> code points. Ranges (a dash between two digits) come before Dashes.
TABLE: dict[str, tuple[int, ...]] = {
    "Hyphens": (0x2010, 0x2011, 0x2012, 0x2212, 0xFE58, 0xFE63, 0xFF0D),
    "Ranges": DASHES,
    "Apostrophes": (0x02BC, 0x2018, 0x2019, 0x201A, 0x201B, 0x2032, 0xFF07),
    "Double quotes": (0x201C, 0x201D, 0x201E, 0x201F),
    "Double primes": (0x2033,),
    "Spaces": (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000),
    "Invisibles": (0x00AD, 0x200B, *range(0x2060, 0x2065), 0xFEFF),
    "Ellipsis": (0x2026,),
    "Ligatures": tuple(range(0xFB00, 0xFB07)),
    "Fraction slashes": (0x2044, 0x2215),
    "Dashes": DASHES,
}
LIGATURES = ("ff", "fi", "fl", "ffi", "ffl", "st", "st")
PRESERVED = (0x00AB, 0x00B7, 0x00BB, 0x00D7, 0x00E6, 0x0153, 0x200C, 0x200D, 0x200E, 0x200F, 0x2022, 0x2192, 0xFE0E, 0xFE0F)
#: The class that a count of a point is filed under: the last that names it.
CLASS_OF = {point: name for name, points in TABLE.items() for point in points}


def chars(points) -> str:
    return "".join(map(chr, points))


def label(point: int) -> str:
    return f"U+{point:04X}"


def labelled(points: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    digits = F.hex(points)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


_BETWEEN = "(?<=[0-9])[" + chars(DASHES) + "](?=[0-9])"


def normalize(text: Column, lang: str, typography: dict[str, str] | None = None) -> Column:
    """The text with each class rewritten, unless ``typography`` keeps it.

    Dashes outside ranges are only reported, unless it asks to replace them. A byte order
    mark at the beginning stays. Digits beside a dash are read from the original text,
    which no earlier class changes.
    """
    asked = typography or {}
    out = text

    def on(name: str) -> bool:
        return asked.get(name) != "keep"

    def swap(name: str, to: str) -> None:
        nonlocal out
        if on(name):
            out = F.regexp_replace(out, "[" + chars(TABLE[name]) + "]", to)

    # Dashes first: what a range is must be seen before other classes make digits' neighbours.
    if on("Ranges"):
        out = F.regexp_replace(out, _BETWEEN, "-")
    if asked.get("Dashes") == "replace":
        rest = "[" + chars(DASHES) + "]"
        if not on("Ranges"):
            rest = f"(?:(?<![0-9]){rest}|{rest}(?![0-9]))"
        out = F.regexp_replace(out, rest, "-")
    swap("Hyphens", "-")
    swap("Apostrophes", "'")
    if on("Double quotes"):
        if lang == "fr":
            out = F.regexp_replace(out, "[\u201c\u201e\u201f]", "« ")
            out = F.regexp_replace(out, "\u201d", " »")
        else:
            swap("Double quotes", '"')
    swap("Double primes", '"')
    swap("Spaces", " ")
    if on("Invisibles"):
        out = F.regexp_replace(out, "(?!\\A\ufeff)[" + chars(TABLE["Invisibles"]) + "]", "")
    swap("Ellipsis", "...")
    if on("Ligatures"):
        for point, plain in zip(TABLE["Ligatures"], LIGATURES):
            out = F.replace(out, F.lit(chr(point)), F.lit(plain))
    swap("Fraction slashes", "/")
    return out


def points_of(text: Column) -> Column:
    """The characters of a text that the table names, in order; a leading mark left out."""
    named = "".join(chr(p) for p in CLASS_OF)
    return F.regexp_extract_all(F.regexp_replace(text, "\\A\ufeff", ""), F.lit("[" + named + "]"), F.lit(0))


def class_of(character: Column) -> Column:
    by_class: dict[str, list[int]] = {}
    for point, name in CLASS_OF.items():
        by_class.setdefault(name, []).append(point)
    found = F.lit(None).cast("string")
    for name, points in by_class.items():
        found = F.when(character.isin([chr(p) for p in points]), name).otherwise(found)
    return found


def code_point(character: Column) -> Column:
    """The number of a single character, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(character, "UTF-32")), 16, 10).cast("long")


def asides(text: Column) -> Column:
    """Dashes that are no range: what is reported and not rewritten."""
    rest = "[" + chars(DASHES) + "]"
    return F.regexp_count(text, F.lit(f"(?<![0-9]){rest}|{rest}(?![0-9])")).cast("long")
