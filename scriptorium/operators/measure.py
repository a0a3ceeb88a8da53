"""Measures of a collection of samples, overall and by register and surface.

``records`` works sample by sample on the JVM. Scalar measures of all groups come from one
pass over GROUPING SETS; forms, tics and n-grams are counted per sample first, so only
counts are spread over the groups. The corpus-wide vocabulary is a distinct frame that is
joined, never collected: it grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import masking, typography
from ..functions.profiles import Profile, Tic
from ..functions.regex import B, S, absent, count_of, led, let, matches, quick, rate, rounded, share, trimmed
from ..functions.text import bounded, display, filled, lines, paragraphs, sentences, words
from .tables import written

SALUTATION_WORDS, SALUTATION_LINES, SIGNOFF_WORDS, SIGNOFF_WINDOW = 8, 3, 10, 30
LIST_LINE = rf"\A{S}*(?:[-*•]|[0-9]+[.)]){S}+[^{S[1:-1]}]"
#: Pictographs by explicit ranges, since the engine's classes have no such property.
EMOJI = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}"
    r"\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}"
    r"\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}"
    r"\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}"
    r"\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}"
    r"\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}"
    r"\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}]"
)
#: The same, tried only beyond the characters that come before all of them.
_PICTURE = led(EMOJI, r"[^\x{00}-\x{A8}]")
BUCKETS = (("le_10", None, 10), ("11_20", 11, 20), ("21_30", 21, 30), ("31_45", 31, 45), ("gt_45", 46, None))


# -- openings, closings, body --------------------------------------------------------------


def header_line(line: Column, profile: Profile) -> Column:
    name = F.regexp_extract(line, rf"\A([A-Za-z][A-Za-z0-9_-]*){S}*:", 1)
    return (name != "") & ~F.lower(name).isin(*profile.openers)


def greets(line: Column, profile: Profile) -> Column:
    tokens = words(line, profile)
    n = F.size(tokens)
    opens = F.coalesce(F.get(tokens, F.lit(0)).isin(*profile.openers), F.lit(False))
    return (n > 0) & (n <= SALUTATION_WORDS) & (opens | (F.regexp_like(line, F.lit(r"[,:]\z")) & (n <= 4)))


def salutation_of(text: Column, supplied: Column | None, profile: Profile) -> Column:
    """The greeting: the supplied one unless it is a header line, else the first line that
    greets among three that are no header lines, none before it being long."""
    look = F.slice(F.filter(filled(lines(text)), lambda x: ~header_line(x, profile)), 1, SALUTATION_LINES)
    ends = F.filter(look, lambda x: greets(x, profile) | (F.size(words(x, profile)) > SALUTATION_WORDS))
    found = let(F.try_element_at(ends, F.lit(1)), lambda first: F.when(greets(first, profile), first))
    if supplied is None:
        return found
    given = absent(supplied)
    return F.when(given.isNotNull() & ~header_line(given, profile), given).otherwise(found)


def signoff_of(text: Column, supplied: Column | None, profile: Profile) -> Column:
    """The closing: the supplied one, else a last paragraph of at most ten words."""
    last = let(paragraphs(text), lambda blocks: F.when(F.size(blocks) >= 2, F.try_element_at(blocks, F.lit(-1))))
    found = let(last, lambda x: F.when(F.size(words(x, profile)) <= SIGNOFF_WORDS, x))
    return found if supplied is None else F.coalesce(absent(supplied), found)


def cut_tail(text: Column, block: Column) -> Column:
    """The text without a block that ends it."""
    bare = F.regexp_replace(text, quick(rf"(?<!{S}){S}+\z"), "")
    return F.when(F.coalesce(F.endswith(bare, block), F.lit(False)), F.left(bare, F.length(bare) - F.length(block))).otherwise(text)


def body_of(text: Column, salutation: Column, signoff: Column, signature: Column) -> Column:
    """The text without greeting, closing and signature; never empty unless the text is."""

    def greeted(out: Column) -> Column:
        at = F.instr(out, salutation)
        before = F.left(out, F.greatest(at - 1, F.lit(0)))
        few = F.size(F.filter(lines(before), lambda x: trimmed(x) != "")) < SALUTATION_LINES
        cut = F.concat(before, F.substring(out, at + F.length(salutation), F.length(out)))
        return F.when(F.coalesce((at > 0) & few, F.lit(False)), cut).otherwise(out)

    out = let(let(cut_tail(text, signature), lambda t: cut_tail(t, signoff)), greeted)
    return F.coalesce(F.nullif(trimmed(out), F.lit("")), trimmed(text))


def records(samples: DataFrame, profile: Profile, supplied: bool = False) -> DataFrame:
    """Samples (text; with ``supplied`` also salutation, signoff, signature) with their parts:
    salutation, signoff, signature, body, tokens, sentence_words, block_words."""

    def given(name: str) -> Column | None:
        return F.col(name) if supplied and name in samples.columns else None

    found = samples.withColumns({"salutation": salutation_of(F.col("text"), given("salutation"), profile), "signoff": signoff_of(F.col("text"), given("signoff"), profile), "signature": absent(F.col("signature")) if given("signature") is not None else F.lit(None).cast("string")})
    with_body = found.withColumn("body", body_of(F.col("text"), F.col("salutation"), F.col("signoff"), F.col("signature")))
    return with_body.withColumns({
        "tokens": words(F.col("body"), profile),
        "sentences": sentences(F.col("body"), profile),
        "block_words": lengths(paragraphs(F.col("body")), profile),
    }).withColumn("sentence_words", lengths(F.col("sentences"), profile))


# -- groups --------------------------------------------------------------------------------


def groups_of(register: Column, surface: Column) -> Column:
    """The three groups of a sample: overall, its register, its surface."""
    blank = F.lit("unclassified")
    return F.array(
        F.struct(F.lit("overall").alias("kind"), F.lit("").alias("key")),
        F.struct(F.lit("register").alias("kind"), F.coalesce(F.nullif(register, F.lit("")), blank).alias("key")),
        F.struct(F.lit("surface").alias("kind"), F.coalesce(F.nullif(surface, F.lit("")), blank).alias("key")),
    )


def _sets(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over everything, each register and each surface, as (kind, key, ...)."""
    blank = F.lit("unclassified")
    keyed = df.withColumns({"register": F.coalesce(F.nullif("register", F.lit("")), blank), "surface": F.coalesce(F.nullif("surface", F.lit("")), blank)})
    rows = keyed.groupingSets([[], ["register"], ["surface"]], "register", "surface").agg(F.grouping_id().alias("_g"), *aggregates)
    kind = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "register").otherwise("surface")
    key = F.when(F.col("_g") == 3, "").when(F.col("_g") == 1, F.col("register")).otherwise(F.col("surface"))
    return rows.withColumns({"kind": kind, "key": key}).drop("_g", "register", "surface")


def percentile(values: Column, fraction: float) -> Column:
    """Exact, interpolated, to two places; 0 without values."""
    return F.coalesce(rounded(F.percentile(values, F.lit(fraction)), 2), F.lit(0.0))


PUNCTUATION = ((",", "comma"), (";", "semicolon"), (":", "colon"), ("(", "parenthesis"))
PUNCTUATED = (*[name for _, name in PUNCTUATION], "quotation")


def punctuation(body: Column) -> list[Column]:
    """How often each mark of ``PUNCTUATED`` occurs."""
    return [*[count_of(body, c).alias(name) for c, name in PUNCTUATION], (count_of(body, '"') + count_of(body, "«")).alias("quotation")]


def is_list(body: Column) -> Column:
    return F.size(F.filter(lines(body), lambda x: F.regexp_like(x, F.lit(quick(LIST_LINE))))) >= 2


def doubled(body: Column) -> Column:
    return F.regexp_like(body, F.lit(quick(rf"!{S}*!")))


def lengths(units: Column, profile: Profile) -> Column:
    """The number of words of each unit of an array."""
    return F.transform(units, lambda u: F.size(words(u, profile)))


def times(tokens: Column, chosen: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*chosen))) if chosen else F.lit(0)


def length_summary(n: Column) -> list[Column]:
    """total, median, mean, p25, p75, min and max of a number per row."""
    return [
        F.sum(n).cast("long").alias("total"),
        percentile(n, 0.5).alias("median"),
        rounded(F.sum(n) / F.count("*"), 1).alias("mean"),
        percentile(n, 0.25).alias("p25"),
        percentile(n, 0.75).alias("p75"),
        F.min(n).cast("long").alias("min"),
        F.max(n).cast("long").alias("max"),
    ]


def person_summary() -> list[Column]:
    """Of rows with fam and form (marks of either address) and n words."""
    fam, form = F.col("fam"), F.col("form")
    return [
        F.count_if(fam > form).alias("familiar_messages"),
        F.count_if(fam < form).alias("formal_messages"),
        F.count_if((fam == form) & (fam > 0)).alias("mixed_messages"),
        F.count_if((fam == 0) & (form == 0)).alias("no_marker_messages"),
        share(F.count_if(fam > form), F.count("*")).alias("familiar_pct"),
        rate(F.sum("fam"), F.sum("n"), 1000).alias("familiar_per_1000"),
        rate(F.sum("form"), F.sum("n"), 1000).alias("formal_per_1000"),
    ]


def emphasis_summary() -> list[Column]:
    """Of rows with ex and qu (exclamation and question marks) and n words."""
    return [
        rate(F.sum("ex"), F.sum("n"), 1000).alias("exclamations_per_1000"),
        share(F.count_if(F.col("ex") > 0), F.count("*")).alias("exclamation_pct"),
        F.count_if("doubled").alias("doubled_messages"),
        rate(F.sum("qu"), F.sum("n"), 1000).alias("questions_per_1000"),
        share(F.count_if(F.col("qu") > 0), F.count("*")).alias("question_pct"),
    ]


def list_summary() -> list[Column]:
    return [F.count_if("lst").alias("list_messages"), share(F.count_if("lst"), F.count("*")).alias("list_pct")]


def punctuation_summary() -> list[Column]:
    return [rate(F.sum(c), F.sum("n"), 1000).alias(f"{c}_per_1000") for c in PUNCTUATED]


def bucket_shares(length: Column) -> list[Column]:
    """The share of sentences of each class of length."""
    return [share(F.count_if((length >= (a or 0)) & (length <= (b or 1 << 30))), F.count("*")).alias(f"sentence_{name}_pct") for name, a, b in BUCKETS]


def unrolled(df: DataFrame, values: Column, name: str, *kept: str) -> DataFrame:
    """``kept`` and a row for each of ``values``, none of them null. For a plain explode Spark
    adds a filter on the size, which computes the array a second time."""
    return df.select(*kept, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def measures(found: DataFrame, profile: Profile) -> DataFrame:
    """(kind, key) with every scalar measure of the group."""
    body, tokens = F.col("body"), F.col("tokens")
    per = found.select(
        "register",
        "surface",
        F.size(tokens).alias("n"),
        F.size("sentence_words").alias("s"),
        F.size("block_words").alias("p"),
        times(tokens, profile.familiar).alias("fam"),
        times(tokens, profile.formal).alias("form"),
        F.col("salutation").isNotNull().alias("has_sal"),
        F.col("signoff").isNotNull().alias("has_off"),
        F.col("signature").isNotNull().alias("has_sig"),
        count_of(body, "!").alias("ex"),
        doubled(body).alias("doubled"),
        count_of(body, "?").alias("qu"),
        matches(body, _PICTURE).alias("em"),
        is_list(body).alias("lst"),
        *punctuation(body),
        F.col("date") if "date" in found.columns else F.lit(None).cast("string").alias("date"),
    )
    n = F.count("*")
    total, sent = F.sum("n"), F.sum("s")
    yes = F.count_if
    scalar = _sets(
        per,
        n.alias("messages"),
        F.min(F.nullif("date", F.lit(""))).alias("date_first"),
        F.max(F.nullif("date", F.lit(""))).alias("date_last"),
        *[c.alias(f"words_{name}") for c, name in zip(length_summary(F.col("n")), ("total", "median", "mean", "p25", "p75", "min", "max"))],
        sent.cast("long").alias("sentences_total"),
        percentile(F.col("s"), 0.5).alias("sentences_median_per_message"),
        percentile(F.col("p"), 0.5).alias("paragraphs_median_per_message"),
        *person_summary(),
        share(yes(F.col("has_sal")), n).alias("salutation_pct"),
        share(yes(~F.col("has_sal")), n).alias("no_salutation_pct"),
        share(yes(F.col("has_off")), n).alias("signoff_pct"),
        share(yes(F.col("has_sig")), n).alias("signature_pct"),
        *emphasis_summary(),
        rate(F.sum("ex"), sent, 100, 1).alias("exclamations_per_100_sentences"),
        rate(F.sum("qu"), sent, 100, 1).alias("questions_per_100_sentences"),
        rate(F.sum("em"), total, 1000).alias("emoji_per_1000"),
        share(yes(F.col("em") > 0), n).alias("emoji_pct"),
        *list_summary(),
        *punctuation_summary(),
    )
    units = found.select("register", "surface", F.explode("sentence_words").alias("w"))
    length = F.col("w")
    by_sentence = _sets(
        units,
        percentile(length, 0.5).alias("sentence_median_words"),
        rounded(F.sum("w") / F.count("*"), 1).alias("sentence_mean_words"),
        percentile(length, 0.9).alias("sentence_p90_words"),
        F.max("w").cast("long").alias("sentence_max_words"),
        *bucket_shares(length),
    )
    by_block = _sets(found.select("register", "surface", F.explode("block_words").alias("w")), percentile(F.col("w"), 0.5).alias("paragraph_median_words"))
    return scalar.join(by_sentence, ["kind", "key"], "left").join(by_block, ["kind", "key"], "left")


def word_totals(found: DataFrame) -> DataFrame:
    """(kind, key, words_total) of ``measures`` alone, from register, surface and tokens."""
    return _sets(found.select("register", "surface", F.size("tokens").alias("n")), F.sum("n").cast("long").alias("words_total"))


KINDS = ("overall", "register", "surface")


def grouped(df: DataFrame, *keys: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows (register, surface, *keys, count) summed for every group of the sample."""
    if kinds == ("overall",):
        counted = df.groupBy(*keys).agg(F.sum("count").alias("count"))
        return counted.select(F.lit("overall").alias("kind"), F.lit("").alias("key"), *keys, "count")
    counted = df.groupBy("register", "surface", *keys).agg(F.sum("count").alias("count"))
    spread = counted.withColumn("_g", F.explode(groups_of(F.col("register"), F.col("surface"))))
    return spread.groupBy(F.col("_g.kind").alias("kind"), F.col("_g.key").alias("key"), *keys).agg(F.sum("count").alias("count"))


def top(counts: DataFrame, form: str, k: int | None) -> DataFrame:
    """The ``k`` commonest forms of each group, with rank; ties in language order.

    Spark cuts each partition to ``k`` before the shuffle, as the rank is compared with a
    constant. Without ``k`` all forms stay and none is ranked, as that would sort a group's
    whole vocabulary in one task.
    """
    if k is None:
        return counts.withColumn("rank", F.lit(None).cast("int"))
    order = W.partitionBy("kind", "key").orderBy(F.desc("count"), F.collate(F.col(form), "UNICODE"), form)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def forms(found: DataFrame, column: str, profile: Profile, k: int | None = 8, masked: bool = True) -> DataFrame:
    """Commonest greetings or closings, names masked, on one line."""
    line = F.regexp_replace(F.col(column), quick(rf"{S}*\n{S}*"), " ")
    form = masking.mask_names(line, profile) if masked else line
    rows = found.where(F.col(column).isNotNull()).select("register", "surface", form.alias("form"), F.lit(1).alias("count"))
    return top(grouped(rows, "form"), "form", k)


def families(text: Column, profile: Profile) -> Column:
    """Names of the closing families in the last words of the whole text."""

    def last(tokens: Column) -> Column:
        n = F.least(F.size(tokens), F.lit(SIGNOFF_WINDOW))
        return display(F.slice(tokens, F.size(tokens) - n + 1, F.greatest(n, F.lit(0))))

    tail = let(words(text, profile), last)
    found = lambda t: F.array_compact(F.array(*[F.when(F.regexp_like(t, F.lit(bounded(rx))), F.lit(name)) for name, rx in profile.families]))
    return let(tail, found) if profile.families else F.array().cast("array<string>")


def family_counts(found: DataFrame, profile: Profile) -> DataFrame:
    """(kind, key, family, count): in how many texts of each group a closing family stands."""
    rows = unrolled(found, families(F.col("text"), profile), "family", "register", "surface")
    return grouped(rows.withColumn("count", F.lit(1)), "family")


def emojis(found: DataFrame, k: int | None = 8) -> DataFrame:
    rows = unrolled(found, F.regexp_extract_all("body", F.lit(_PICTURE), F.lit(0)), "emoji", "register", "surface")
    return top(grouped(rows.withColumn("count", F.lit(1)), "emoji"), "emoji", k)


def tic_count(tic: Tic, body: Column, heads: Column, profile: Profile) -> Column:
    """``heads``: the first two words of each sentence."""
    if tic.kind == "character":
        return count_of(body, tic.arg)
    if tic.kind == "pattern":
        return matches(body, tic.arg.replace("@", B).replace(r"\S", f"[^{S[1:-1]}]").replace(r"\s", S))
    if tic.kind == "quotation":
        return count_of(body, "«") + F.floor(count_of(body, '"') / 2)
    if tic.kind == "shout":
        return matches(body, led(rf"{B}\p{{Lu}}{{3,}}{B}", r"\p{Lu}{3}"))
    if tic.kind == "one_word":
        return F.size(F.filter(heads, lambda t: F.size(t) == 1)).cast("long")
    chosen = {"starts": tuple(tic.arg.split()), "interjection": profile.interjections, "connective": profile.connectives}[tic.kind]
    return F.size(F.filter(heads, lambda t: F.get(t, F.lit(0)).isin(*chosen))).cast("long")


def tics(found: DataFrame, profile: Profile, k: int | None = 20) -> DataFrame:
    """(kind, key, rank, tic, count, messages) of the tics that occur."""
    heads = F.transform("sentences", lambda s: F.slice(words(s, profile), 1, 2))
    of = F.struct(F.col("body").alias("body"), heads.alias("heads"))
    made = let(of, lambda of: F.array(*[F.struct(F.lit(t.name).alias("tic"), tic_count(t, of["body"], of["heads"], profile).alias("n")) for t in profile.tics]))
    rows = unrolled(found, made, "t", "register", "surface").where("t.n > 0").select("register", "surface", "t.tic", "t.n")
    per = rows.groupBy("register", "surface", "tic").agg(F.sum("n").alias("count"), F.count("*").alias("messages"))
    spread = per.withColumn("_g", F.explode(groups_of(F.col("register"), F.col("surface"))))
    summed = spread.groupBy(F.col("_g.kind").alias("kind"), F.col("_g.key").alias("key"), "tic").agg(F.sum("count").alias("count"), F.sum("messages").alias("messages"))
    return top(summed, "tic", k)


# -- vocabulary, masked runs, n-grams -----------------------------------------------------------


def vocabulary(found: DataFrame, profile: Profile) -> DataFrame:
    """(word): every word that some body, personal data masked, writes in lower case."""
    masked = masking.mask_personal_data(F.col("body"), profile)
    return unrolled(found, lower_words(masked, profile), "word").distinct()


def lower_words(text: Column, profile: Profile) -> Column:
    """The different words that a text begins with a lower-case letter."""
    raw = F.regexp_extract_all(text, F.lit(profile.word), F.lit(0))
    lower = F.filter(raw, lambda w: F.left(w, F.lit(1)) == F.lower(F.left(w, F.lit(1))))
    return F.array_distinct(F.transform(lower, F.lower))


def vouched(masked: DataFrame, known: DataFrame, profile: Profile, key: str) -> DataFrame:
    """``masked`` (key, masked) with known: the words of ``known`` among a text's capitalised ones.

    The capitalised words meet the vocabulary in a join; each text then carries only its own
    words that the corpus vouches for. The texts are read twice, so they are written first.
    """
    masked = written(masked, "masked")
    capital = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"\p{Lu}[\p{L}'-]*"), F.lit(0))), lambda w: words(w, profile))))
    asked = unrolled(masked, capital, "word", key).join(known, "word").groupBy(key).agg(F.collect_list("word").alias("known"))
    return masked.join(asked, key, "left")


def masked_runs(found: DataFrame, known: DataFrame, profile: Profile, key: str) -> DataFrame:
    """``key`` and runs (array of arrays of tokens): the masked body, cut at placeholders."""
    masked = found.select(key, masking.mask_personal_data(F.col("body"), profile).alias("masked"))
    rest = vouched(masked, known, profile, key).select(key, masking.mask_body(F.col("masked"), F.col("known"), profile).alias("masked"))
    holders = "|".join(h.replace("[", r"\[").replace("]", r"\]") for h in profile.placeholders())
    return rest.select(key, F.filter(F.transform(F.split("masked", holders, -1), lambda p: words(p, profile)), lambda r: F.size(r) > 0).alias("runs"))


NGRAM_LEAST = {2: 4, 3: 3}


def ngrams(runs: DataFrame, totals: DataFrame, size: int, reference: dict[str, int], k: int | None = 15, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, key, rank, ngram, count, per_10k, reference_per_10k, times_the_reference).

    ``runs``: (register, surface, runs); ``totals``: (kind, key, words_total) of the bodies.
    """
    # Places, not arrays of arrays: these steps are one loop of generated code.
    tokens = unrolled(runs, F.col("runs"), "_t", "register", "surface").where(F.size("_t") >= size)
    placed = tokens.select("register", "surface", "_t", F.explode(F.sequence(F.lit(0), F.size("_t") - size)).alias("_i"))
    gram = F.replace(F.concat_ws(" ", *[F.get("_t", F.col("_i") + k) for k in range(size)]), F.lit("' "), F.lit("'"))
    rows = placed.select("register", "surface", gram.alias("ngram"), F.lit(1).alias("count"))
    least = NGRAM_LEAST[size]
    if kinds != ("overall",):
        # What is too rare over everything is so in each group, and goes before it is spread.
        rows = rows.groupBy("register", "surface", "ngram").agg(F.sum("count").alias("count"))
        rows = rows.withColumn("_all", F.sum("count").over(W.partitionBy("ngram"))).where(F.col("_all") >= least).drop("_all")
    counts = grouped(rows, "ngram", kinds=kinds).where(F.col("count") >= least)
    known = F.lit(None).cast("int")
    if reference:
        known = F.try_element_at(F.create_map(*[x for g, r in reference.items() for x in (F.lit(g), F.lit(r))]), F.col("ngram"))
    rows = counts.join(totals.select("kind", "key", "words_total"), ["kind", "key"]).withColumn("reference_per_10k", F.coalesce(known, F.lit(0)).cast("double"))
    rows = rows.withColumn("per_10k", rate(F.col("count"), F.col("words_total"), 10000))
    rows = rows.where((F.col("reference_per_10k") == 0) | (F.col("per_10k") >= F.col("reference_per_10k") * 2))
    rows = rows.withColumn("times_the_reference", F.when(F.col("reference_per_10k") > 0, rounded(F.col("per_10k") / F.col("reference_per_10k"), 1)))
    return top(rows, "ngram", k).drop("words_total")


# -- typography -----------------------------------------------------------------------------------


def typographic_counts(samples: DataFrame) -> DataFrame:
    """(label, class, count) of the characters of raw texts that the table names."""
    rows = samples.select(F.explode(typography.points_of(F.col("text"))).alias("c"))
    counts = rows.groupBy("c").agg(F.count("*").alias("count"))
    return counts.select(typography.labelled(typography.code_point(F.col("c"))).alias("label"), typography.class_of(F.col("c")).alias("class"), "count")


def untouched_counts(samples: DataFrame) -> DataFrame:
    """(label, count) of the characters that normalisation preserves by name."""
    named = "[" + "".join(map(chr, typography.PRESERVED)) + "]"
    rows = samples.select(F.explode(F.regexp_extract_all("text", F.lit(named), F.lit(0))).alias("c")).groupBy("c").agg(F.count("*").alias("count"))
    return rows.select(typography.labelled(typography.code_point(F.col("c"))).alias("label"), "count")


# -- the corpus -----------------------------------------------------------------------------------


def corpus(samples: DataFrame) -> DataFrame:
    """(mailbox, samples, langs, domains, first_date, last_date): what each mailbox gave."""
    blank = F.lit("")
    domain = F.nullif("recipient_domain", blank) if "recipient_domain" in samples.columns else F.lit(None).cast("string")
    rows = samples.select(F.coalesce(F.nullif("mailbox", blank), F.lit("unknown")).alias("mailbox"), "lang", domain.alias("domain"), F.nullif("date", blank).alias("date"))
    return rows.groupBy("mailbox").agg(F.count("*").alias("samples"), F.countDistinct("lang").alias("langs"), F.countDistinct("domain").alias("domains"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def sources(samples: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, source, mailbox, adapter, reviewed, samples) of each document, those that
    gave no sample too; mailbox and adapter are what all samples agree on, else the document's."""

    def agreed(name: str) -> Column:
        value = F.nullif(name, F.lit(""))
        return F.when(F.min(value) == F.max(value), F.min(value)).alias("_" + name)

    found = samples.groupBy("document").agg(agreed("mailbox"), agreed("adapter"), F.count("*").alias("_n"))
    rows = documents.join(found, "document", "left").select("document", "source", F.coalesce("_mailbox", "tag").alias("mailbox"), F.coalesce("_adapter", "adapter").alias("adapter"), F.coalesce("_n", F.lit(0)).alias("samples"))
    return rows.select("document", "source", "mailbox", "adapter", F.coalesce(F.col("adapter") == "folder", F.lit(False)).alias("reviewed"), "samples")


# -- extracts -------------------------------------------------------------------------------------


def exemplars(found: DataFrame, order: str, k: int = 5, adapter: str = "adapter") -> DataFrame:
    """(kind, key, rank, order, body_words): the most typical samples of each group.

    Nearest to the median length first; a reviewed one (from a folder) of the middle half
    counts as at the median; the reviewed one nearest the median has the first place.
    Medians are aggregates joined back, and a group's samples are cut to the candidates
    per register and surface before groups are ranked, so no group is ranked whole.
    """
    n = F.size("tokens")
    base = found.select(F.col(order).alias("_o"), "register", "surface", n.alias("n"), (F.col(adapter) == "folder").alias("reviewed"))
    middle = _sets(base, F.percentile("n", F.lit(0.5)).alias("med"), F.percentile("n", F.lit(0.25)).alias("lo"), F.percentile("n", F.lit(0.75)).alias("hi"))
    rows = base.withColumn("_g", F.explode(groups_of(F.col("register"), F.col("surface")))).select("_o", "n", "reviewed", "_g.kind", "_g.key")
    rows = rows.join(middle, ["kind", "key"])
    inside = F.col("reviewed") & F.col("n").between(F.col("lo"), F.col("hi"))
    gap = F.abs(F.col("n") - F.col("med"))
    sort = F.struct(F.when(inside, 0.0).otherwise(gap).alias("a"), F.when(inside, 0).otherwise(1).alias("b"), gap.alias("c"), (-F.col("n")).alias("d"), F.col("_o").alias("e"))
    near = F.struct(gap.alias("gap"), sort.alias("sort"))
    keyed = rows.withColumns({"sort": sort, "near": near})
    # Ranked in salted parts first: a row outside the first k of its part is outside the first k.
    part = W.partitionBy("kind", "key", F.pmod(F.xxhash64("_o"), F.lit(64)), "reviewed")
    few = keyed.withColumn("r1", F.row_number().over(part.orderBy("sort"))).withColumn("r2", F.row_number().over(part.orderBy("near"))).where((F.col("r1") <= k) | (F.col("reviewed") & (F.col("r2") == 1)))
    whole = W.partitionBy("kind", "key")
    first = F.min(F.when(F.col("reviewed"), F.col("near"))).over(whole)["sort"]
    chosen = few.withColumn("lead", F.when(F.col("reviewed") & (F.col("sort") == first), 0).otherwise(1))
    ranked = chosen.withColumn("rank", F.row_number().over(whole.orderBy("lead", "sort"))).where(F.col("rank") <= k)
    return ranked.select("kind", "key", "rank", F.col("_o").alias(order), "reviewed", F.col("n").alias("body_words"))


def extract_of(text: Column, profile: Profile, most: int = 120) -> Column:
    """``cut_extract`` of a text as it stands; ``extracts`` masks first."""
    return cut_extract(paragraphs(text), profile, most)


def extracts(samples: DataFrame, known: DataFrame, profile: Profile, key: str, most: int = 120) -> DataFrame:
    """``key`` and extract (STRUCT<text, words, cut>) of samples (text): personal data, then
    names masked, then cut. ``known`` is the vocabulary of the whole corpus."""
    masked = samples.select(key, masking.mask_personal_data(F.col("text"), profile).alias("masked"))
    split = vouched(masked, known, profile, key).withColumn("blocks", paragraphs(F.col("masked")))
    greeted = greets(trimmed(F.get(lines(F.get("blocks", F.lit(0))), F.lit(0))), profile)
    closed = F.size(words(F.try_element_at("blocks", F.lit(-1)), profile)) <= SIGNOFF_WORDS
    # The names are masked in a step of its own, so that the cut below reads their result once.
    named = split.select(key, masking.mask_extract(F.col("blocks"), greeted, closed, F.col("known"), profile).alias("blocks"))
    return named.select(key, cut_extract(F.col("blocks"), profile, most).alias("extract"))


def cut_extract(paragraphs_of: Column, profile: Profile, most: int = 120) -> Column:
    """STRUCT<text, words, cut>: whole paragraphs until ``most`` words; the first always."""
    blocks = F.transform(paragraphs_of, lambda b: F.struct(b.alias("b"), F.size(words(b, profile)).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(state: Column, block: Column) -> Column:
        over = (F.size(state["kept"]) > 0) & (state["n"] + block["n"] > most)
        take = ~state["stop"] & ~over
        return F.struct(
            F.when(take, F.array_append(state["kept"], block["b"])).otherwise(state["kept"]).alias("kept"),
            F.when(take, state["n"] + block["n"]).otherwise(state["n"]).alias("n"),
            (state["stop"] | over | (take & (state["n"] + block["n"] >= most))).alias("stop"),
        )

    folded = F.aggregate(blocks, start, step)
    return F.struct(F.array_join(folded["kept"], "\n\n").alias("text"), folded["n"].alias("words"), (F.size(folded["kept"]) < F.size(blocks)).alias("cut"))


def evenly(df: DataFrame, order: str, n: int) -> DataFrame:
    """At most ``n`` rows evenly spaced by ``order``, both ends included; halves to even."""
    from .classify import running_number

    total = df.count()
    if n >= total:
        return df
    places = sorted({round(i * (total - 1) / (n - 1)) if n > 1 else 0 for i in range(n)})
    return running_number(df, order, "_place").where((F.col("_place") - 1).isin(places)).drop("_place")
