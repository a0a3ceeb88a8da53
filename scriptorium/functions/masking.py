"""Personal data out of a text: addresses, accounts, references, amounts, phones, names.

All are expressions of the JVM. The functions of one text (``mask_iban_text``,
``mask_names_text`` and others) say the same in Python; tests hold the columns against them.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import Profile
from .regex import B, S, each_match, let, quick
from .text import words

_IBAN = re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?:\s?[A-Za-z0-9]{4}){2,7}(?:\s?[A-Za-z0-9]{1,3})?\b", re.A)
_IBAN_SPACE = re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]{4}){2,7}(?:[ ]?[A-Za-z0-9]{1,3})?\b", re.A)
_LAST_LETTERS = re.compile(r"\s+[A-Za-z]+\Z")


def iban_head(found: str) -> str:
    """A match without the words after the account number."""
    while (tail := _LAST_LETTERS.search(found)) and tail.start() > 0:
        found = found[: tail.start()]
    return found


def mask_iban_text(text: str, mask: str = "[iban]", any_space: bool = False) -> str:
    def swap(m: re.Match) -> str:
        head = iban_head(m[0])
        return mask + m[0][len(head) :] if sum(c in "0123456789" for c in head) >= 8 else m[0]

    return (_IBAN if any_space else _IBAN_SPACE).sub(swap, text)


def mask_ibans(text: Column, mask: str = "[iban]", any_space: bool = False) -> Column:
    """``mask_iban_text`` in expressions of the JVM."""
    space = r"[\t\n\x0B\f\r ]" if any_space else "[ ]"
    shape = rf"(?<![A-Za-z0-9_])[A-Za-z]{{2}}[0-9]{{2}}(?:{space}?[A-Za-z0-9]{{4}}){{2,7}}(?:{space}?[A-Za-z0-9]{{1,3}})?(?![A-Za-z0-9_])"

    def swap(m: Column) -> Column:
        head = F.regexp_replace(m, r"(?:[\t\n\x0B\f\r ]+[A-Za-z]+)+\z", "")
        return F.when(F.regexp_count(head, F.lit("[0-9]")) >= 8, F.concat(F.lit(mask), F.substring(m, F.length(head) + 1, F.length(m)))).otherwise(m)

    return _where(text, rf"[A-Za-z]{{2}}[0-9]{{2}}{space}?[A-Za-z0-9]{{4}}", lambda t: each_match(t, shape, swap))


CASE = rf"(?iu){B}(case|contract|contrat|dossier|facture|file|invoice|référence|reference|ref){B}({S}*(?:n[°o]?{S}*)?[:.]?{S}*)([A-Za-z]{{0,4}}[-/.]?[0-9][A-Za-z0-9./-]{{2,}})"
AMOUNT = rf"(?iu)[0-9][0-9 .,]*{S}?(?:[€£$]|(?:EUR|GBP|USD|euros?){B})"
#: A boundary before a digit or letter.
_START = r"(?<![A-Za-z0-9_])"
STREET = (
    rf"(?iu){_START}[0-9]{{1,4}}(?:[ \t]?(?:[A-Za-z]|bis|ter){B})?(?:-[0-9]{{1,4}})?,?[ \t]+"
    r"(?:all[ée]e|avenue|av|boulevard|bd|chemin|drive|impasse|lane|parvis|parv|place|quai|road|rue|street)\.?"
    rf"(?:[ \t]+[^{S[1:-1]},]+){{1,4}}"
)
IDENTIFIER = rf"{_START}(?=[A-Za-z0-9]*[A-Za-z])(?=(?:[A-Za-z]*[0-9]){{5}})[A-Za-z0-9]{{6,}}{B}"
PHONE = "|".join(
    [
        rf"\+[0-9]{{1,3}}(?:[{S[1:-1]}.-]?[0-9]){{6,14}}",
        rf"{_START}0[0-9](?:[{S[1:-1]}.-]?[0-9]{{2}}){{4}}{B}",
        rf"\([0-9]{{3}}\)[{S[1:-1]}.-]?[0-9]{{3}}[{S[1:-1]}.-]?[0-9]{{4}}{B}",
        rf"{_START}[0-9]{{3}}[{S[1:-1]}.-][0-9]{{3}}[{S[1:-1]}.-][0-9]{{4}}{B}",
        rf"{_START}[0-9]{{2,3}}(?:[{S[1:-1]}.-][0-9]{{2,3}}){{3,5}}{B}",
    ]
)


def _where(text: Column, gate: str, step) -> Column:
    """``step`` of a text that holds what every match of its rule holds, and that is cheap to
    look for; others as they are. The text is computed once."""
    return let(text, lambda t: F.when(F.regexp_like(t, F.lit(gate)), step(t)).otherwise(t))


_CASE_WORDS = "(?iu)case|contra|dossier|facture|file|invoice|r[ée]f"


def _cases(text: Column) -> Column:
    """Case references, and the amounts of a text that has one."""
    cased = F.regexp_replace(text, quick(CASE), "$1$2[reference]")
    return let(cased, lambda c: F.when(c != text, F.regexp_replace(c, quick(AMOUNT), "[amount]")).otherwise(c))


def mask(text: Column, ibans: bool = True) -> Column:
    """The masks of collection; amounts go only where a case reference was found."""
    out = _where(text, "@", lambda t: F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"))
    if ibans:
        out = mask_ibans(out)
    out = _where(out, _CASE_WORDS, _cases)
    out = _where(out, "[0-9]", lambda t: F.regexp_replace(t, quick(STREET), "[address]"))
    out = _where(out, "[0-9](?:[A-Za-z]*[0-9]){4}", lambda t: F.regexp_replace(t, quick(IDENTIFIER), "[reference]"))
    return _where(out, "[0-9](?:[^A-Za-z0-9]{0,2}[0-9]){6}", lambda t: F.regexp_replace(t, quick(PHONE), "[phone]"))


def mask_personal_data(text: Column, profile: Profile, ibans: bool = True) -> Column:
    """The masks of measuring, with the profile's placeholders."""
    m = profile.masks
    gap = quick(f"[{S[1:-1]}.-]")
    out = _where(text, "@", lambda t: F.regexp_replace(t, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", m["email"]))
    out = _where(out, "://", lambda t: F.regexp_replace(t, quick(rf"{B}https?://[^{S[1:-1]}]+"), m["url"]))
    if ibans:
        out = mask_ibans(out, m["iban"], any_space=True)

    def numbers(t: Column) -> Column:
        t = F.regexp_replace(t, rf"\([0-9]{{3}}\){gap}?[0-9]{{3}}{gap}?[0-9]{{4}}|{_START}[0-9]{{3}}{gap}[0-9]{{3}}{gap}[0-9]{{4}}{B}", m["phone"])
        t = F.regexp_replace(t, r"\+?[0-9][0-9 .-]{7,}[0-9]", m["phone"])
        return F.regexp_replace(t, rf"{_START}[0-9]{{5,}}{B}", m["number"])

    return _where(out, "[0-9][0-9 .-]", numbers)


# -- names -----------------------------------------------------------------------------

_FOLD = str.maketrans("éèêàâ", "eeeaa")


@functools.lru_cache(maxsize=16)
def _keeper(profile: Profile):
    keep = profile.kept()

    def kept(word: str) -> bool:
        plain = word.lower().translate(_FOLD)
        return plain in keep or ("'" in plain and plain[plain.rindex("'") + 1 :] in keep)

    return kept


def mask_names_text(line: str, profile: Profile) -> str:
    """On a greeting or closing line every word that is not one of the language's goes."""
    import regex

    kept, name = _keeper(profile), profile.masks["name"]

    def after_comma(m) -> str:
        return m[1] + m[2] + name if kept(m[1]) and not kept(m[3]) else m[0]

    out = regex.sub(r"(?m)(\p{L}[\p{L}'-]*)(\s*,\s*)(\p{Ll}[\p{L}'-]*)[ \t]*$", after_comma, line)
    holders = profile.placeholders()
    scan = "|".join(map(re.escape, holders)) + r"|\p{L}[\p{L}'-]*"
    return regex.sub(scan, lambda m: m[0] if m[0] in holders or kept(m[0]) else name, out)


def _kept(word: Column, profile: Profile) -> Column:
    keep = sorted(profile.kept())
    plain = F.translate(F.lower(word), "éèêàâ", "eeeaa")
    return let(plain, lambda p: p.isin(keep) | F.substring_index(p, "'", -1).isin(keep))


#: White space as Python has it.
_PY_SPACE = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def mask_names(line: Column, profile: Profile) -> Column:
    """``mask_names_text`` in expressions of the JVM."""
    name, holders = profile.masks["name"], profile.placeholders()
    ending = rf"(\p{{L}}[\p{{L}}'-]*)({_PY_SPACE}*,{_PY_SPACE}*)(\p{{Ll}}[\p{{L}}'-]*)[ \t]*(?=\n|\z)"

    def after_comma(m: Column) -> Column:
        one, two, three = (F.regexp_extract(m, ending, k) for k in (1, 2, 3))
        return F.when(_kept(one, profile) & ~_kept(three, profile), F.concat(one, two, F.lit(name))).otherwise(m)

    out = _where(line, ending, lambda t: each_match(t, ending, after_comma))
    scan = "|".join(h.replace("[", r"\[").replace("]", r"\]") for h in holders) + r"|\p{L}[\p{L}'-]*"
    return let(out, lambda t: each_match(t, scan, lambda m: F.when(m.isin(*holders) | _kept(m, profile), m).otherwise(F.lit(name))))


def mask_body_text(text: str, profile: Profile, known) -> str:
    """In a body a capitalised word goes unless it is kept or ``known`` vouches for it."""
    import regex

    kept, name = _keeper(profile), profile.masks["name"]
    token = regex.compile(profile.word)

    def vouched(word: str) -> bool:
        parts = token.findall(word.lower())
        return bool(parts) and all(p in known for p in parts)

    return regex.sub(r"\p{Lu}[\p{L}'-]*", lambda m: m[0] if kept(m[0]) or vouched(m[0]) else name, text)


def mask_body(text: Column, known: Column, profile: Profile) -> Column:
    """``known``: array of the corpus words among this text's own capitalised ones."""
    vouchers = F.coalesce(known, F.array().cast("array<string>"))

    def vouched(word: Column) -> Column:
        return let(words(word, profile), lambda parts: (F.size(parts) > 0) & (F.size(F.array_except(parts, vouchers)) == 0))

    return each_match(text, r"\p{Lu}[\p{L}'-]*", lambda m: F.when(_kept(m, profile) | vouched(m), m).otherwise(F.lit(profile.masks["name"])))


def mask_extract_text(blocks, greeted: bool, closed: bool, profile: Profile, known) -> list[str]:
    """Paragraphs, personal data masked: names off the first line if the text is ``greeted``
    and off the last paragraph if it is ``closed``; elsewhere as in a body."""
    out = []
    for k, block in enumerate(blocks):
        if closed and k and k == len(blocks) - 1:
            out.append(mask_names_text(block, profile))
        elif greeted and not k:
            first, _, rest = block.partition("\n")
            out.append("\n".join(filter(None, [mask_names_text(first, profile), mask_body_text(rest, profile, known)])))
        else:
            out.append(mask_body_text(block, profile, known))
    return out


def mask_extract(blocks: Column, greeted: Column, closed: Column, known: Column, profile: Profile) -> Column:
    """``mask_extract_text`` in expressions of the JVM; ``known`` as in ``mask_body``."""
    blank = F.lit("")
    facts = F.struct(F.coalesce(greeted, F.lit(False)).alias("greeted"), F.coalesce(closed, F.lit(False)).alias("closed"), F.size(blocks).alias("n"), known.alias("known"))

    def opened(block: Column, of: Column) -> Column:
        first = F.substring_index(block, "\n", 1)
        rest = F.substring(block, F.length(first) + 2, F.length(block))
        return F.concat_ws("\n", F.nullif(mask_names(first, profile), blank), F.nullif(mask_body(rest, of["known"], profile), blank))

    def masked(block: Column, k: Column, of: Column) -> Column:
        last = of["closed"] & (k > 0) & (k == of["n"] - 1)
        return F.when(last, mask_names(block, profile)).when(of["greeted"] & (k == 0), opened(block, of)).otherwise(mask_body(block, of["known"], profile))

    return let(facts, lambda of: F.transform(blocks, lambda block, k: masked(block, k, of)))
