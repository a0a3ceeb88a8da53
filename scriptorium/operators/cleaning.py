"""What belongs to the writer: quotations, sign-offs, signatures, and reasons to drop.

Column functions over whole texts; ``recurring_tail_lines`` and ``cut_recurring_tails``
look at the collection as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import undecoded
from ..functions.profiles import FUNCTION_WORDS
from ..functions.regex import B, S, let, matches, quick, trimmed
from ..functions.text import filled, lines, word_count

ATTRIBUTION = rf"(?iu)\A{S}*(?:on|le){B}[\s\S]{{0,300}}?(?:wrote|a écrit|a ecrit){S}*:{S}*\z"
SEPARATOR = rf"(?iu)\A{S}*[-_]{{2,}}{S}*(?:begin forwarded message|forwarded message|message d['’]origine|message transféré|original message)"
FORWARD = rf"(?iu)\A{S}*(?:-+{S}*message transféré|-+{S}*forwarded message|begin forwarded message{S}*:)"
HEADER = rf"(?iu)\A{S}*(?:cc|copie|date|de|envoye|envoyé|expéditeur|from|objet|sent|subject|to|à){S}*:"
QUOTED = rf"\A{S}*>"
SIGNOFF = (
    rf"(?iu)\A{S}*(?:adieu|amicalement|amitiés|best|bien cordialement|bien à (?:toi|vous)|bises|bisous|bonne (?:journée|réception|soirée)"
    r"|cheers|cordialement|dans l['’]attente|je t['’]embrasse|je vous prie d['’]agréer|(?:best|kind|warm) regards"
    r"|merci (?:beaucoup|d['’]avance|encore)|mille (?:amitiés|baisers|choses|tendresses)|regards|respectueusement"
    r"|salutations(?: distinguées)?|sincerely|sincères salutations|talk soon|tendrement|thank you|thanks(?: again)?"
    rf"|tout à (?:toi|vous)|très cordialement|veuillez agréer|yours(?: faithfully| sincerely| truly)?|à (?:bientôt|demain|tout à l['’]heure)){B}"
)
CONTINUES = r"(?iu)expression|distingu|dévoué|consid[ée]ration|agréer|salutations|sentiments"


def _like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(quick(pattern)))


def strip_quoted(text: Column) -> Column:
    """STRUCT<text, quoted, forwarded>: the writer's own lines.

    All from an attribution (over one to three lines), a separator, a forward mark or two
    header lines in a row goes; quoted lines before it go one by one.
    """
    return let(lines(text), _own_lines)


def _own_lines(parts: Column) -> Column:
    n = F.size(parts)

    def at(i: Column) -> Column:
        return F.coalesce(F.get(parts, i), F.lit(""))

    def stops(x: Column, i: Column) -> Column:
        joined = [F.array_join(F.slice(parts, i + 1, F.lit(k)), " ") for k in (1, 2, 3)]
        attribution = _like(joined[0], ATTRIBUTION)
        for k in (2, 3):
            attribution = attribution | ((i + k <= n) & _like(joined[k - 1], ATTRIBUTION))
        block = _like(x, HEADER) & _like(at(i + 1), HEADER)
        return F.when(_like(x, FORWARD), 2).when(attribution | _like(x, SEPARATOR) | block, 1).otherwise(0)

    return let(F.transform(parts, stops), lambda marks: _kept_lines(parts, marks, n))


def _kept_lines(parts: Column, marks: Column, n: Column) -> Column:
    first = F.coalesce(F.try_element_at(F.filter(F.transform(marks, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull()), F.lit(1)), n)
    own = F.slice(parts, F.lit(1), first)
    forwarded = F.coalesce(F.get(marks, first), F.lit(0)) == 2
    kept = F.filter(own, lambda x: ~_like(x, QUOTED))
    return F.struct(trimmed(F.array_join(kept, "\n")).alias("text"), ((first < n) | (F.size(kept) < F.size(own))).alias("quoted"), forwarded.alias("forwarded"))


def split_signature(text: Column) -> Column:
    """STRUCT<body, signoff, signature>: the last sign-off among the last twelve lines, what
    continues its formula, and what stands under it or under a delimiter of two dashes."""
    return let(lines(text), _parted)


def _parted(parts: Column) -> Column:
    dashes = F.array_position(F.transform(parts, lambda x: _like(x, rf"\A--{S}*\z")), F.lit(True)).cast("int")
    upper = F.when(dashes > 0, F.slice(parts, F.lit(1), F.greatest(dashes - 1, F.lit(0)))).otherwise(parts)
    under = F.when(dashes > 0, F.slice(parts, F.greatest(dashes + 1, F.lit(1)), F.size(parts))).otherwise(F.array().cast("array<string>"))
    return let(F.struct(upper.alias("upper"), under.alias("under")), lambda p: _closed(p["upper"], p["under"]))


def _closed(upper: Column, under: Column) -> Column:
    n = F.size(upper)
    places = F.filter(F.transform(upper, lambda x, i: F.when((i >= n - 12) & _like(x, SIGNOFF), i + 1)), lambda i: i.isNotNull())
    at = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(0)).cast("int")
    tail = F.slice(upper, F.greatest(at + 1, F.lit(1)), n)
    stop = F.array_position(F.transform(tail, lambda x: ~_like(x, CONTINUES)), F.lit(True)).cast("int")
    more = F.when(stop > 0, stop - 1).otherwise(F.size(tail))
    signoff = F.when(at > 0, F.slice(upper, F.greatest(at, F.lit(1)), more + 1)).otherwise(F.array().cast("array<string>"))
    beneath = F.when(at > 0, F.concat(F.slice(tail, more + 1, n), under)).otherwise(under)
    body = F.when(at > 0, F.slice(upper, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(upper)
    return F.struct(
        trimmed(F.array_join(body, "\n")).alias("body"),
        trimmed(F.array_join(signoff, " ")).alias("signoff"),
        trimmed(F.array_join(beneath, "\n")).alias("signature"),
    )


MACHINE = (
    "(?iu)automated +(?:email|message|notification|reply)|automatically +generated|do +not +reply +to +this|d[eé]sinscription"
    "|envoy[eé]+(?:e|s)* +automatiquement|g[eé]n[eé]r[eé]+(?:e|s)* +automatiquement|mail +automatique|message +automatique"
    "|ne +pas +r[eé]pondre +[aà] +ce|notification +automatique|se +d[eé]sinscrire|sent +automatically|unsubscribe"
    "|vous +recevez +ce +(?:courriel|e-?mail|mail|message)|you +are +receiving +this"
)


def written_by_a_machine(text: Column, extra: tuple[str, ...] = ()) -> Column:
    found = _like(text, MACHINE)
    for wording in extra:
        found = found | F.contains(F.lower(text), F.lit(wording))
    return found


def function_words(text: Column, lang: str) -> Column:
    """How many words of a text are function words of a language."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.size(F.filter(tokens, lambda t: t.isin(*FUNCTION_WORDS[lang]))).cast("long")


def in_another_language(text: Column, lang: str, floor: int = 5) -> Column:
    if lang not in FUNCTION_WORDS:
        return F.lit(False)
    own, found = function_words(text, lang), F.lit(False)
    for other in FUNCTION_WORDS:
        if other != lang:
            n = function_words(text, other)
            found = found | ((n >= floor) & (n > own * 2))
    return found


BLANK_FIELDS = 2
BLANK_FIELD = r"<\p{Lu}[^<>@\n]{0,40}>|\.{5,}|…{3,}|_{5,}"


def blank_fields(text: Column) -> Column:
    """Fields of a form that nobody filled in; two make a template."""
    return matches(text, BLANK_FIELD)


def signed_by(text: Column, author: str) -> Column:
    """Whether the author stands among the last twelve lines that are not blank."""
    last = F.slice(F.reverse(filled(lines(text))), F.lit(1), F.lit(12))
    return F.exists(last, lambda x: F.contains(F.lower(x), F.lit(author.lower())))


ROBOTS = (
    r"(?iu)\A(?:alerts?|auto-?(?:mated|reply)|bounces?|do-?not-?reply|mailer-daemon|mailing|newsletter|news|no-?reply|notifications?|postmaster)"
    rf"{B}|[+.](?:noreply|bounce)[@.]"
)


def robot(address: Column) -> Column:
    return _like(address, ROBOTS)


def senders(rows: DataFrame, least: int = 3, most: int = 40) -> DataFrame:
    """(address, n): the commonest senders that are no robots, ``least`` messages each."""
    people = rows.where(F.col("address").isNotNull() & ~robot(F.col("address")))
    counts = people.groupBy("address").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "address").limit(most)


def since(date: Column, start: str) -> Column:
    """In the window: a date at or after its start; rows without a date are kept."""
    return date.isNull() | (date >= start)


def since_stamp(stamp: Column, start: str) -> Column:
    """In the window at the precision of the stamp (a month against a month)."""
    return stamp.isNull() | (stamp >= F.left(F.lit(start), F.length(stamp)))


# -- over a collection -------------------------------------------------------------------

TAIL_LINES, RECURRING, TAIL_RUN = 15, 10, 3


def recurring_tail_lines(df: DataFrame, text: str = "body") -> DataFrame:
    """(line, messages): lines that end at least ten messages and are no sign-off.

    One shuffle of distinct lines with partial counts; lines need no order.
    """
    body = filled(lines(F.col(text)))
    tail = F.array_distinct(F.slice(F.reverse(body), F.lit(1), F.lit(TAIL_LINES)))
    counts = df.select(F.explode(tail).alias("line")).groupBy("line").agg(F.count("*").alias("messages"))
    return counts.where((F.col("messages") >= RECURRING) & ~_like(F.col("line"), SIGNOFF))


def cut_recurring_tails(df: DataFrame, recurring: DataFrame, key: list[str], text: str = "body") -> DataFrame:
    """``df`` with body, signoff and signature after a recurring tail of three lines or more.

    The lines of each tail meet the recurring ones in a join, since nothing bounds how many
    recur; only the last lines of each text are exploded.
    """
    all_lines = lines(F.col(text))
    numbered = df.select(*key, F.explode(F.transform(F.reverse(all_lines), lambda x, i: F.struct(i.alias("i"), trimmed(x).alias("line")))).alias("e")).select(*key, "e.*")
    known = recurring.select("line", F.lit(True).alias("known"))
    marked = numbered.join(known, "line", "left").withColumn("ends", ~(F.coalesce("known", F.lit(False)) | (F.col("line") == "")))
    stop = marked.where("ends").groupBy(*key).agg(F.min("i").alias("run"))
    cut = marked.join(stop, key, "left").where((F.col("line") != "") & (F.col("i") < F.coalesce("run", F.lit(1 << 30))))
    cut = cut.groupBy(*key).agg(F.count("*").alias("cut"))
    both = df.join(stop, key, "left").join(cut, key, "left")
    n = F.size(all_lines) - F.coalesce("run", F.size(all_lines))
    parted = split_signature(F.array_join(F.slice(all_lines, F.lit(1), n), "\n"))
    under = trimmed(F.array_join(F.slice(all_lines, n + 1, F.size(all_lines)), "\n"))
    long = F.coalesce("cut", F.lit(0)) >= TAIL_RUN
    made = both.withColumn("_p", parted).withColumn("_u", under).withColumn("_l", long)
    return made.select(
        *[c for c in df.columns if c not in (text, "signoff", "signature")],
        F.when(F.col("_l"), F.col("_p.body")).otherwise(F.col(text)).alias(text),
        F.when(F.col("_l"), F.col("_p.signoff")).otherwise(F.lit("")).alias("signoff"),
        F.when(F.col("_l"), F.array_join(F.filter(F.array("_p.signature", "_u"), lambda x: x != ""), "\n")).otherwise(F.lit("")).alias("signature"),
    )


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; null for a row that is kept."""
    found = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        found = F.when(condition, F.lit(name)).otherwise(found)
    return found


def funnel(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """(reason, n): how many rows each reason dropped; 'kept' and 'read' beside them."""
    counted = df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counted.union(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).select(F.lit("read").alias("reason"), F.col("coalesce(sum(n), 0)").cast("long").alias("n")))
