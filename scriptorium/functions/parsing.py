"""Parsing of messages, HTML, TeX and letters with expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import S, matches, quick, trimmed
from .text import filled, lines, word_count

#: Control characters and U+FFFD: what a wrong charset leaves behind.
UNDECODED = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]"

_CP1252 = (
    "€\ufffd‚ƒ„…†‡ˆ‰Š‹Œ\ufffdŽ\ufffd\ufffd‘’“”•–—˜™š›œ\ufffdžŸ"
)
_C1 = "".join(map(chr, range(0x80, 0xA0)))


def from_cp1252(text: Column) -> Column:
    """Characters 0x80 to 0x9F as that code page has them; undefined ones are U+FFFD."""
    return F.translate(text, _C1, _CP1252)


def undecoded(text: Column) -> Column:
    return F.regexp_like(text, F.lit(UNDECODED))


def split_message(raw: Column) -> Column:
    """STRUCT<headers MAP, body>: names in lower case, folded lines joined, repeats by ', '."""
    text = F.regexp_replace(raw, "\r\n", "\n")
    bare = F.startswith(text, F.lit("\n"))
    parts = F.split(text, "\n\n", 2)
    head = F.when(bare, F.lit("")).otherwise(F.element_at(parts, 1))
    body = F.when(bare, F.substring(text, 2, 1 << 30)).otherwise(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    entries = F.filter(lines(F.regexp_replace(head, "\n[ \t]+", " ")), lambda x: F.regexp_like(x, F.lit(r"\A[!-9;-~]+:")))
    named = F.transform(entries, lambda x: F.struct(F.lower(F.regexp_extract(x, r"\A([!-9;-~]+):[ \t]*(.*)\z", 1)).alias("k"), F.regexp_extract(x, r"\A([!-9;-~]+):[ \t]*(.*)\z", 2).alias("v")))
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    headers = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(named, lambda e: e["k"] == k), lambda e: e["v"]), ", ")))
    return F.struct(headers.alias("headers"), body.alias("body"))


def split_mbox(text: Column) -> Column:
    """Messages of a mailbox; an envelope line counts at the beginning or after a blank line."""
    plain = F.regexp_replace(text, "\r\n", "\n")
    envelope = r"(?m)(?:\A|(?<=\n\n))From [^\s]+ +\w{3} \w{3} [ \d]\d .*(?:\n|\z)"
    parts = F.split(plain, envelope, -1)
    whole = F.transform(F.slice(parts, 2, 1 << 30), lambda m: F.regexp_replace(m, r"(?m)^>(>*From )", "$1"))
    return F.filter(whole, lambda m: m != "")


def content_type(value: Column) -> Column:
    """STRUCT<type, charset, boundary>; text/plain without a value."""
    kind = F.lower(trimmed(F.element_at(F.split(F.coalesce(value, F.lit("")), ";"), 1)))

    def parameter(name: str) -> Column:
        quoted = F.regexp_extract(value, rf'(?i);\s*{name}\s*=\s*"([^"]*)"', 1)
        plain = F.regexp_extract(value, rf"(?i);\s*{name}\s*=\s*([^\s;\"]+)", 1)
        return F.nullif(F.coalesce(F.nullif(quoted, F.lit("")), plain), F.lit(""))

    return F.struct(F.when(kind == "", "text/plain").otherwise(kind).alias("type"), F.lower(parameter("charset")).alias("charset"), parameter("boundary").alias("boundary"))


_NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}


def _numeric(text: Column) -> Column:
    """Numeric character references: piece by piece, digits then the text after them."""
    parts = F.split(text, r"(?i)(?=&#(?:[0-9]+|x[0-9a-f]+);)", -1)

    def one(part: Column) -> Column:
        decimal = F.regexp_extract(part, r"\A&#0*([0-9]+);", 1)
        hexed = F.regexp_extract(part, r"(?i)\A&#x0*([0-9a-f]+);", 1)
        code = F.coalesce(
            F.when(decimal != "", F.coalesce(F.try_to_number(F.substring(decimal, 1, 9), F.lit("999999999")).cast("long") + F.when(F.length(decimal) > 9, 1 << 40).otherwise(0), F.lit(1 << 40))),
            F.when(hexed != "", F.when(F.length(hexed) > 8, F.lit(1 << 40)).otherwise(F.conv(hexed, 16, 10).cast("long"))),
        )
        layout = code.isin(9, 10, 13)
        wrong = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (~layout & ((code < 0x20) | (code == 0x7F)))
        spelled = F.when(wrong, " ").otherwise(from_cp1252(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        rest = F.regexp_replace(part, r"(?i)\A&#(?:[0-9]+|x[0-9a-f]+);", "")
        return F.when(code.isNull(), part).otherwise(F.concat(spelled, rest))

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def html_to_text(html: Column, numeric: bool = True) -> Column:
    """Tags out, blocks to lines, items to dashes; six named references, others verbatim."""
    out = F.regexp_replace(html, r"(?is)<(style|script).*?</\1>", "")
    out = F.regexp_replace(out, rf"(?i)<br{S}*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>", "- ")
    out = F.regexp_replace(out, r"(?i)</(?:blockquote|div|h[1-6]|li|p|tr)>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    if numeric:
        out = _numeric(out)
    # One pass: what a reference spells is never read again (&amp;lt; is &lt;).
    out = F.regexp_replace(out, r"(?i)&amp;", "\ue000")
    for name, plain in _NAMED.items():
        if name != "amp":
            out = F.regexp_replace(out, rf"(?i)&{name};", plain)
    out = F.replace(out, F.lit("\ue000"), F.lit("&"))
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return trimmed(out)


def tex_to_text(text: Column) -> Column:
    """Comments, environments and preambles out; a command keeps the text it wraps."""
    out = F.regexp_replace(text, r"(?m)(^|[^\\])%[^\n]*", "$1")
    out = F.regexp_replace(out, r"\\(?:end|begin)\{[^}]*\}(?:\[[^\]]*\])?", "")
    out = F.regexp_replace(out, r"\\(?:usepackage|renewcommand|newcommand|documentclass)(?:\[[^\]]*\])?\{[^}]*\}(?:\{[^}]*\})?", "")
    out = F.regexp_replace(out, r"\\[A-Za-z]+(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\[A-Za-z]+\*?", "")
    out = F.regexp_replace(out, r"[{}]", "")
    return trimmed(F.regexp_replace(out, "\n{3,}", "\n\n"))


_ADDRESS = r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def address_of(value: Column) -> Column:
    """The last address in angle brackets, else the first bare one; lower case or null."""
    angled = F.regexp_extract_all(value, F.lit(rf"<{S}*([^<>{S[1:-1]}]+@[^<>{S[1:-1]}]+){S}*>"), F.lit(1))
    bare = F.regexp_extract_all(value, F.lit(_ADDRESS), F.lit(0))
    return F.lower(F.coalesce(F.try_element_at(angled, F.lit(-1)), F.try_element_at(bare, F.lit(1))))


def addresses_in(value: Column) -> Column:
    """The address of each entry of a list."""
    return F.array_compact(F.transform(F.split(F.coalesce(value, F.lit("")), ","), address_of))


def first_other(recipients: Column, mine: Column) -> Column:
    """The first recipient that is not one of the user's own addresses."""
    return F.try_element_at(F.filter(recipients, lambda r: ~F.array_contains(mine, r)), F.lit(1))


def domain_of(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, r"@([^@]+)\z", 1), F.lit(""))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def date_of(value: Column) -> Column:
    """YYYY-MM-DD of a date header as written, without any shift of zone; else null."""
    rx = r"(?i)(?:^|[^0-9])([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+([0-9]{4})"
    day, month, year = (F.regexp_extract(value, rx, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(month))
    parsed = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    fallback = F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd")
    return F.when((day != "") & (number > 0), parsed).otherwise(fallback)


def stamp_of(name: Column) -> Column:
    """The date in a file's name, to the day or the month."""
    return F.nullif(F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)", 1), F.lit(""))


OPENERS = r"(?iu)\A(?:bonjour|bonsoir|chère|chères|cher|chers|coucou|dear|good (?:afternoon|evening|morning)|hello|hey|hi|madame|mesdames|messieurs|monsieur|salut)(?![A-Za-z0-9_])"


def salutation_of(text: Column) -> Column:
    """The greeting among the first three lines that are not blank; empty if none."""
    head = F.slice(filled(lines(text)), 1, 3)

    def greets(line: Column) -> Column:
        n = word_count(line)
        return (n <= 8) & (F.regexp_like(line, F.lit(OPENERS)) | (F.regexp_like(line, F.lit(r"[,:]\z")) & (n <= 4)))

    return F.coalesce(F.try_element_at(F.filter(head, greets), F.lit(1)), F.lit(""))


def _first(parts: Column, wanted) -> Column:
    """1-based place of the first element for which ``wanted`` holds; 0 if none."""
    return F.coalesce(F.array_position(F.transform(parts, wanted), F.lit(True)), F.lit(0)).cast("int")


def letter_body(text: Column) -> Column:
    """From the greeting in the head of the page, else from below the object line."""
    all_lines = lines(text)
    head = F.slice(all_lines, 1, 30)
    greeting = _first(head, lambda x: F.regexp_like(x, F.lit(quick(rf",{S}*\z"))) & (word_count(x) <= 8) & F.regexp_like(trimmed(x), F.lit(OPENERS)))
    subject = _first(head, lambda x: F.regexp_like(x, F.lit(quick(rf"(?iu)\A{S}*(?:concerne|objet|re|subject){S}*:"))))
    below = F.slice(all_lines, F.greatest(subject + 1, F.lit(1)), 1 << 30)
    gap = _first(below, lambda x: trimmed(x) == "")
    rest = F.when(gap > 0, trimmed(F.array_join(F.slice(below, F.greatest(gap, F.lit(1)), 1 << 30), "\n"))).otherwise(F.lit(""))
    return (
        F.when(greeting > 0, F.array_join(F.slice(all_lines, F.greatest(greeting, F.lit(1)), 1 << 30), "\n"))
        .when(subject == 0, text)
        .otherwise(F.coalesce(F.nullif(rest, F.lit("")), text))
    )


def mailbox_name(path: Column) -> Column:
    """The innermost .mbox folder of a path."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?:.*/)?([^/]+)\.mbox(?:/.*)?\z", 1), F.lit("")), F.lit("Mail"))


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset in characters."""
    return matches(F.substring(text, F.lit(1), offset), "\n") + 1


def emlx_message(content: Column) -> Column:
    """The message of an emlx file: the bytes its first line counts, else all that follow."""
    text = F.decode(content, "ISO-8859-1")
    first = F.regexp_extract(text, r"(?s)\A([^\n]*)\n", 1)
    length = F.try_to_number(F.nullif(F.regexp_extract(first, r"\A\s*([0-9]{1,9})\s*\z", 1), F.lit("")), F.lit("999999999")).cast("int")
    rest = F.regexp_extract(text, r"(?s)\A[^\n]*\n(.*)\z", 1)
    return F.when(length.isNotNull() & (length <= F.length(rest)), F.substring(rest, F.lit(1), length)).otherwise(rest)
