"""Queries over the test tables, one per operator, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, parsing, typography
from ..functions.profiles import ENGLISH, FRENCH, FUNCTION_WORDS
from ..functions.regex import count_of
from ..functions.text import paragraphs, sentences, word_count, words
from ..operators import classify, cleaning, dedupe, measure
from ..operators.tables import written
from . import pipelines, reports
from . import stimulus as st

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, text: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if text is None else df.withColumn("text", F.expr(text.replace("''", "\\'")))


def docs(spark, sf_dir, text=None):
    return table(spark, sf_dir, "documents", text)


def _q(text: str) -> str:
    return text.replace("'", "''")


EN, FR = _q(ENGLISH.word), _q(FRENCH.word)


def d_words(text: str, rx: str = EN) -> str:
    return f"regexp_extract_all(lower({text}), '{rx}')"


def d_round(x: str, d: int = 2) -> str:
    f = 10**d
    return f"(floor(({x})::DOUBLE * {f}.0 + 0.5) / {f}.0)"


def d_rate(count: str, base: str, per: float, d: int = 2) -> str:
    inner = d_round(f"({count})::DOUBLE / nullif({base}, 0)::DOUBLE * {float(per)}", d)
    return f"coalesce({inner}, 0.0)"


def d_pct(x: str, f: float) -> str:
    return "coalesce(" + d_round(f"quantile_cont({x}, {f})") + ", 0.0)"


def d_count(text: str, ch: str) -> str:
    return f"(length({text}) - length(replace({text}, '{_q(ch)}', '')))"


def d_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{A0}}\x{{FEFF}}]+|[\s\x{{A0}}\x{{FEFF}}]+$', '', 'g')"


def d_paragraphs(text: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({text}, '\n[ \t]*\n'), lambda x: {d_trim('x')}), lambda x: x <> '')"


def d_sentences(source: str, text: str, keep: str, profile=ENGLISH) -> str:
    """A query of one row per sentence: ``keep`` columns and sentence."""
    short = "|".join([*profile.abbreviations, r"\p{L}"])
    guard = rf"'(?i)(^|[^\p{{L}}])({short})\.(\s|$)', '\1\2' || chr(57344) || '\3', 'g'"
    rx = _q(profile.word)
    return rf"""
SELECT {keep}, sentence FROM (
  SELECT {keep}, {d_trim("replace(unnest(string_split(cut, chr(57345))), chr(57344), '.')")} AS sentence FROM (
    SELECT {keep}, regexp_replace(regexp_replace(regexp_replace(line, {guard}), {guard}), '([.!?])(\s)', '\1' || chr(57345) || '\2', 'g') AS cut
    FROM (SELECT {keep}, unnest(string_split({text}, chr(10))) AS line FROM {source})
  )
) WHERE regexp_matches(lower(sentence), '{rx}')"""


D = "documents"


def view(text: str, source: str = D) -> str:
    return f"(SELECT * REPLACE ({text} AS text) FROM {source})"


# -- words, paragraphs, sentences --------------------------------------------------------------


def d_stats(n: str) -> str:
    return f"sum({n})::BIGINT AS total, {d_pct(n, 0.5)} AS median, {d_round(f'sum({n})::DOUBLE / count(*)', 1)} AS mean, {d_pct(n, 0.25)} AS p25, {d_pct(n, 0.75)} AS p75, min({n})::BIGINT AS min, max({n})::BIGINT AS max"


@query("q01_word_stats_by_lang", f"SELECT lang, {d_stats('n')} FROM (SELECT lang, len({d_words('text')}) AS n FROM documents) GROUP BY lang")
def q01(spark, sf_dir):
    return docs(spark, sf_dir).select("lang", F.size(words(F.col("text"), ENGLISH)).alias("n")).groupBy("lang").agg(*measure.length_summary(F.col("n")))


_ELIDED = "CASE WHEN lang = 'fr' THEN replace(text, ' le ', ' l''') ELSE text END"


@query("q02_token_counts_fr_elision", f"SELECT token, count(*) AS n FROM (SELECT unnest({d_words('text', FR)}) AS token FROM {view(_ELIDED)} WHERE lang = 'fr') GROUP BY token")
def q02(spark, sf_dir):
    rows = docs(spark, sf_dir, _ELIDED).where("lang = 'fr'")
    return rows.select(F.explode(words(F.col("text"), FRENCH)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(
    "q03_paragraph_stats",
    f"SELECT lang, {d_stats('n')}, sum(p)::BIGINT AS paragraphs FROM (SELECT lang, len({d_words('b')}) AS n, 1 AS p FROM (SELECT lang, unnest({d_paragraphs('text')}) AS b FROM {view(st.LETTER)})) GROUP BY lang",
)
def q03(spark, sf_dir):
    rows = docs(spark, sf_dir, st.LETTER).select("lang", F.explode(measure.lengths(paragraphs(F.col("text")), ENGLISH)).alias("n"))
    return rows.groupBy("lang").agg(*measure.length_summary(F.col("n")), F.count("*").alias("paragraphs"))


@query("q04_sentence_stats", f"SELECT lang, {d_stats('n')}, count(*) AS sentences FROM (SELECT lang, len({d_words('sentence')}) AS n FROM ({d_sentences(D, 'text', 'lang')})) GROUP BY lang")
def q04(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", F.explode(measure.lengths(sentences(F.col("text"), ENGLISH), ENGLISH)).alias("n"))
    return rows.groupBy("lang").agg(*measure.length_summary(F.col("n")), F.count("*").alias("sentences"))


_BUCKETS = [(name, a or 0, b or 1 << 30) for name, a, b in measure.BUCKETS]


@query(
    "q05_sentence_length_histogram",
    "SELECT source, " + ", ".join(d_rate(f"count(*) FILTER (WHERE n BETWEEN {a} AND {b})", "count(*)", 100, 1) + f" AS sentence_{name}_pct" for name, a, b in _BUCKETS) + f" FROM (SELECT source, len({d_words('sentence')}) AS n FROM ({d_sentences(D, 'text', 'source')})) GROUP BY source",
)
def q05(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", F.explode(measure.lengths(sentences(F.col("text"), ENGLISH), ENGLISH)).alias("n"))
    return rows.groupBy("source").agg(*measure.bucket_shares(F.col("n")))


@query(
    "q06_punctuation_rates",
    "SELECT lang, " + ", ".join(d_rate(f"sum({d_count('text', c)})", "sum(n)", 1000) + f" AS {a}_per_1000" for c, a in measure.PUNCTUATION) + f""", {d_rate(f"sum({d_count('text', chr(34))} + {d_count('text', '«')})", "sum(n)", 1000)} AS quotation_per_1000 FROM (SELECT *, len({d_words('text')}) AS n FROM {view(st.MARKS)}) GROUP BY lang""",
)
def q06(spark, sf_dir):
    t = F.col("text")
    rows = docs(spark, sf_dir, st.MARKS).select("lang", F.size(words(t, ENGLISH)).alias("n"), *measure.punctuation(t))
    return rows.groupBy("lang").agg(*measure.punctuation_summary())


@query(
    "q07_exclamation_question",
    rf"""SELECT source, {d_rate("sum(e)", "sum(n)", 1000)} AS exclamations_per_1000, {d_rate("sum(q)", "sum(n)", 1000)} AS questions_per_1000,
{d_rate("count_if(e > 0)", "count(*)", 100, 1)} AS exclamation_pct, {d_rate("count_if(q > 0)", "count(*)", 100, 1)} AS question_pct, count_if(regexp_matches(text, '!\s*!'))::BIGINT AS doubled_messages
FROM (SELECT source, text, len({d_words("text")}) AS n, {d_count("text", "!")} AS e, {d_count("text", "?")} AS q FROM {view(st.MARKS)}) GROUP BY source""",
)
def q07(spark, sf_dir):
    t = F.col("text")
    rows = docs(spark, sf_dir, st.MARKS).select("source", F.size(words(t, ENGLISH)).alias("n"), count_of(t, "!").alias("ex"), count_of(t, "?").alias("qu"), measure.doubled(t).alias("doubled"))
    return rows.groupBy("source").agg(*measure.emphasis_summary())


def d_in(words_) -> str:
    return ", ".join(f"'{_q(w)}'" for w in words_)


@query(
    "q08_second_person_fr",
    f"""SELECT source, count_if(f > v)::BIGINT AS familiar_messages, count_if(f < v)::BIGINT AS formal_messages, count_if(f = v AND f > 0)::BIGINT AS mixed_messages, count_if(f = 0 AND v = 0)::BIGINT AS no_marker_messages,
  {d_rate("count_if(f > v)", "count(*)", 100, 1)} AS familiar_pct, {d_rate("sum(f)", "sum(n)", 1000)} AS familiar_per_1000, {d_rate("sum(v)", "sum(n)", 1000)} AS formal_per_1000
FROM (SELECT source, len(t) AS n, len(list_filter(t, lambda x: x IN ({d_in(FRENCH.familiar)}))) AS f, len(list_filter(t, lambda x: x IN ({d_in(FRENCH.formal)}))) AS v FROM (SELECT source, {d_words("text", FR)} AS t FROM {view(st.LETTER)})) GROUP BY source""",
)
def q08(spark, sf_dir):
    rows = docs(spark, sf_dir, st.LETTER).select("source", words(F.col("text"), FRENCH).alias("t"))
    rows = rows.select("source", F.size("t").alias("n"), measure.times(F.col("t"), FRENCH.familiar).alias("fam"), measure.times(F.col("t"), FRENCH.formal).alias("form"))
    return rows.groupBy("source").agg(*measure.person_summary())


# -- openings and closings --------------------------------------------------------------------------

_D_LOOK = rf"list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_trim('x')}), lambda x: x <> ''), lambda x: NOT (regexp_matches(x, '^[A-Za-z][A-Za-z0-9_-]*\s*:') AND lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9_-]*)\s*:', 1)) NOT IN ({d_in(ENGLISH.openers)})))[1:3]"
_D_GREETS = rf"(len({d_words('x')}) BETWEEN 1 AND 8 AND ({d_words('x')}[1] IN ({d_in(ENGLISH.openers)}) OR (regexp_matches(x, '[,:]$') AND len({d_words('x')}) <= 4)))"
_D_FIRST = f"list_filter({_D_LOOK}, lambda x: {_D_GREETS} OR len({d_words('x')}) > 8)[1]"
_D_SALUTATION = f"CASE WHEN len({d_words('first')}) <= 8 THEN first END"
_D_SIGNOFF = f"CASE WHEN len(blocks) >= 2 AND len({d_words('blocks[-1]')}) <= 10 THEN blocks[-1] END"
_D_GROUPS = "(VALUES ('overall'), ('register'), ('surface')) k(kind)"
_D_KEY = "CASE kind WHEN 'overall' THEN '' WHEN 'register' THEN lang ELSE source END"
_D_PARTS = f"(SELECT *, {_D_SALUTATION} AS salutation, {_D_SIGNOFF} AS signoff FROM (SELECT *, {_D_FIRST} AS first, {d_paragraphs('text')} AS blocks FROM {view(st.LETTER)}))"


def _letters(spark, sf_dir):
    t = F.col("text")
    rows = docs(spark, sf_dir, st.LETTER)
    return rows.withColumns({"register": F.col("lang"), "surface": F.col("source"), "salutation": measure.salutation_of(t, None, ENGLISH), "signoff": measure.signoff_of(t, None, ENGLISH)})


def d_forms(column: str) -> str:
    return rf"""SELECT kind, {_D_KEY} AS key, regexp_replace({column}, '\s*\n\s*', ' ', 'g') AS form, count(*) AS n FROM {_D_PARTS}, {_D_GROUPS} WHERE {column} IS NOT NULL GROUP BY ALL"""


def _forms(spark, sf_dir, column):
    return measure.forms(_letters(spark, sf_dir), column, ENGLISH, k=None, masked=False).select("kind", "key", "form", F.col("count").alias("n"))


@query("q09_salutation_forms", d_forms("salutation"))
def q09(spark, sf_dir):
    return _forms(spark, sf_dir, "salutation")


@query("q10_signoff_forms", d_forms("signoff"))
def q10(spark, sf_dir):
    return _forms(spark, sf_dir, "signoff")


def d_bounded(rx: str) -> str:
    return "(?i)" + _q(rx.replace("@", r"\b"))


_D_TAIL = f"array_to_string(list_reverse(list_slice(list_reverse({d_words('text')}), 1, 30)), ' ')"


@query(
    "q11_signoff_families",
    f"SELECT kind, {_D_KEY} AS key, family, count(*) AS n FROM (SELECT lang, source, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(tail, '{d_bounded(rx)}') THEN '{_q(name)}' END" for name, rx in ENGLISH.families) + f"], lambda x: x IS NOT NULL)) AS family FROM (SELECT lang, source, {_D_TAIL} AS tail FROM {view(st.LETTER)})), {_D_GROUPS} GROUP BY ALL",
)
def q11(spark, sf_dir):
    return measure.family_counts(_letters(spark, sf_dir), ENGLISH).select("kind", "key", "family", F.col("count").alias("n"))


_D_BODY = rf"""(SELECT *, CASE WHEN signoff IS NOT NULL AND ends_with(rtext, signoff) THEN left(rtext, length(rtext) - length(signoff)) ELSE text END AS cut FROM (SELECT *, regexp_replace(text, '[\s\x{{A0}}\x{{FEFF}}]+$', '') AS rtext FROM {_D_PARTS}))"""


@query(
    "q12_body_extraction",
    rf"""SELECT doc_id, coalesce(nullif({d_trim("CASE WHEN instr(cut, salutation) > 0 AND len(list_filter(string_split(left(cut, instr(cut, salutation) - 1), chr(10)), lambda x: trim(x) <> '')) < 3 THEN left(cut, instr(cut, salutation) - 1) || substr(cut, instr(cut, salutation) + length(salutation)) ELSE cut END")}, ''), {d_trim("text")}) AS body FROM {_D_BODY}""",
)
def q12(spark, sf_dir):
    rows = _letters(spark, sf_dir)
    return rows.select("doc_id", measure.body_of(F.col("text"), F.col("salutation"), F.col("signoff"), F.lit(None).cast("string")).alias("body"))


@query(
    "q13_list_messages",
    rf"SELECT source, count_if(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*•]|[0-9]+[.)])\s+\S'))) >= 2)::BIGINT AS list_messages, floor(count_if(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*•]|[0-9]+[.)])\s+\S'))) >= 2)::DOUBLE / count(*) * 100.0 * 10.0 + 0.5) / 10.0 AS list_pct FROM {view(st.MARKS)} GROUP BY source",
)
def q13(spark, sf_dir):
    return docs(spark, sf_dir, st.MARKS).select("source", measure.is_list(F.col("text")).alias("lst")).groupBy("source").agg(*measure.list_summary())


@query("q14_emoji_counts", f"SELECT kind, {_D_KEY} AS key, emoji, count(*) AS n FROM (SELECT lang, source, unnest(regexp_extract_all(text, '{measure.EMOJI}')) AS emoji FROM {view(st.MARKS)}), {_D_GROUPS} GROUP BY ALL")
def q14(spark, sf_dir):
    found = docs(spark, sf_dir, st.MARKS).select(F.col("lang").alias("register"), F.col("source").alias("surface"), F.col("text").alias("body"))
    return measure.emojis(found, None).select("kind", "key", "emoji", F.col("count").alias("n"))


def _d_tic(t) -> str:
    if t.kind == "character":
        return d_count("text", t.arg)
    if t.kind == "quotation":
        return f"{d_count('text', '«')} + {d_count('text', chr(34))} // 2"
    if t.kind == "shout":
        return r"len(regexp_extract_all(text, '\b\p{Lu}{3,}\b'))"
    return f"len(regexp_extract_all(text, '{_q(t.arg.replace('(?iu)', '(?i)').replace('@', chr(92) + 'b'))}'))"


_PLAIN_TICS = [t for t in ENGLISH.tics if t.kind in ("character", "quotation", "pattern", "shout")]
_HEAD_TICS = [t for t in ENGLISH.tics if t.kind in ("starts", "interjection", "connective", "one_word")]
_D_HEADS = {"starts": "tok[1] IN ('i')", "interjection": f"tok[1] IN ({d_in(ENGLISH.interjections)})", "connective": f"tok[1] IN ({d_in(ENGLISH.connectives)})", "one_word": "len(tok) = 1"}


@query(
    "q15_tics",
    f"SELECT kind, {_D_KEY} AS key, tic, sum(n)::BIGINT AS n, count(*) AS messages FROM ("
    + "\nUNION ALL ".join(f"SELECT lang, source, '{_q(t.name)}' AS tic, {_d_tic(t)} AS n FROM {view(st.MARKS)}" for t in _PLAIN_TICS)
    + "\nUNION ALL "
    + "\nUNION ALL ".join(f"SELECT lang, source, '{_q(t.name)}', count_if({_D_HEADS[t.kind]}) FROM (SELECT doc_id, lang, source, {d_words('sentence')} AS tok FROM ({d_sentences(view(st.MARKS), 'text', 'doc_id, lang, source')})) GROUP BY doc_id, lang, source" for t in _HEAD_TICS)
    + f"), {_D_GROUPS} WHERE n > 0 GROUP BY ALL",
)
def q15(spark, sf_dir):
    rows = docs(spark, sf_dir, st.MARKS).select(F.col("lang").alias("register"), F.col("source").alias("surface"), F.col("text").alias("body"), sentences(F.col("text"), ENGLISH).alias("sentences"))
    return measure.tics(rows, ENGLISH, None).select("kind", "key", "tic", F.col("count").alias("n"), "messages")


def _d_grams(size: int, ref: dict, least: int) -> str:
    join = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(size))
    known = "CASE ngram " + " ".join(f"WHEN '{_q(g)}' THEN {r}" for g, r in ref.items()) + " ELSE 0 END"
    return f"""
WITH t AS (SELECT {d_words("text")} AS t FROM documents),
w AS (SELECT sum(len(t)) AS total FROM t),
g AS (SELECT replace({join}, ''' ', '''') AS ngram FROM (SELECT t, unnest(range(1, len(t) - {size - 2})) AS i FROM t)),
c AS (SELECT ngram, count(*) AS n FROM g GROUP BY ngram HAVING count(*) >= {least}),
r AS (SELECT ngram, n, {d_rate("n", "total", 10000)} AS per_10k, ({known})::DOUBLE AS reference FROM c, w)
SELECT * FROM r WHERE reference = 0 OR per_10k >= 2 * reference"""


def _grams(spark, sf_dir, size, ref):
    rows = docs(spark, sf_dir).select(F.col("lang").alias("register"), F.col("source").alias("surface"), F.array(words(F.col("text"), ENGLISH)).alias("runs"))
    totals = rows.agg(F.sum(F.size(F.col("runs")[0])).alias("words_total")).select(F.lit("overall").alias("kind"), F.lit("").alias("key"), "words_total")
    found = measure.ngrams(rows, totals, size, ref, k=None, kinds=("overall",))
    return found.select("ngram", F.col("count").cast("long").alias("n"), "per_10k", F.col("reference_per_10k").alias("reference"))


@query("q16_bigrams", _d_grams(2, ENGLISH.bigrams, 4))
def q16(spark, sf_dir):
    return _grams(spark, sf_dir, 2, ENGLISH.bigrams)


@query("q17_trigrams", _d_grams(3, ENGLISH.trigrams, 3))
def q17(spark, sf_dir):
    return _grams(spark, sf_dir, 3, ENGLISH.trigrams)


def _samples(spark, sf_dir, text=None):
    rows = docs(spark, sf_dir, text)
    return rows.select("doc_id", "text", F.col("lang").alias("register"), F.col("source").alias("surface"), F.when(F.col("doc_id") % 7 == 0, "folder").otherwise("mbox").alias("adapter"))


@query("q18_ngrams_masked")
def q18(spark, sf_dir):
    found = written(measure.records(_samples(spark, sf_dir, st.LETTER), ENGLISH).select("doc_id", "register", "surface", "body", "tokens"), "records")
    runs = found.select("doc_id", "register", "surface").join(measure.masked_runs(found, measure.vocabulary(found, ENGLISH), ENGLISH, "doc_id"), "doc_id")
    return measure.ngrams(runs, measure.word_totals(found), 2, ENGLISH.bigrams)


@query(
    "q19_vocabulary",
    f"SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(raw) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EN}')) AS raw FROM documents) WHERE raw[1] = lower(raw[1])) GROUP BY word",
)
def q19(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(measure.lower_words(F.col("text"), ENGLISH)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "q20_measure_grouping_sets",
    f"""WITH r AS (SELECT lang AS register, source AS surface, text, len({d_words("text")}) AS n FROM {view(st.MARKS)})
SELECT CASE grouping_id(register, surface) WHEN 3 THEN 'overall' WHEN 1 THEN 'register' ELSE 'surface' END AS kind,
  CASE grouping_id(register, surface) WHEN 3 THEN '' WHEN 1 THEN register ELSE surface END AS key,
  count(*) AS messages, sum(n)::BIGINT AS words_total, {d_pct("n", 0.5)} AS words_median, {d_round("sum(n)::DOUBLE / count(*)", 1)} AS words_mean, {d_pct("n", 0.25)} AS words_p25, {d_pct("n", 0.75)} AS words_p75,
  {d_rate(f"sum({d_count('text', ',')})", "sum(n)", 1000)} AS comma_per_1000, {d_rate(f"sum({d_count('text', '!')})", "sum(n)", 1000)} AS exclamations_per_1000,
  {d_rate(f"count_if({d_count('text', '?')} > 0)", "count(*)", 100, 1)} AS question_pct
FROM r GROUP BY GROUPING SETS ((), (register), (surface))""",
)
def q20(spark, sf_dir):
    rows = _samples(spark, sf_dir, st.MARKS)
    t = F.col("text")
    none = F.lit(None).cast("string")
    found = rows.withColumns({"salutation": none, "signoff": none, "signature": none, "body": t, "tokens": words(t, ENGLISH), "sentence_words": F.array().cast("array<int>"), "block_words": F.array().cast("array<int>")})
    made = measure.measures(found, ENGLISH)
    return made.select("kind", "key", "messages", "words_total", "words_median", "words_mean", "words_p25", "words_p75", "comma_per_1000", "exclamations_per_1000", "question_pct")


# -- typography -----------------------------------------------------------------------------------------


def _d_chars(points) -> str:
    return "".join(map(chr, points))


_D_NAMED = "[" + _d_chars(typography.CLASS_OF) + "]"
_D_CLASS = "CASE " + " ".join(f"WHEN c IN ({d_in(map(chr, [p for p, n in typography.CLASS_OF.items() if n == name]))}) THEN '{name}'" for name in dict.fromkeys(typography.CLASS_OF.values())) + " END"


@query(
    "q21_typographic_base",
    f"SELECT 'U+' || lpad(printf('%X', unicode(c)), greatest(4, length(printf('%X', unicode(c))))::INTEGER, '0') AS label, {_D_CLASS} AS class, n AS \"count\" FROM (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '^﻿', ''), '{_D_NAMED}')) AS c FROM {view(st.GLYPHS)}) GROUP BY c)",
)
def q21(spark, sf_dir):
    return measure.typographic_counts(docs(spark, sf_dir, st.GLYPHS))


def _d_normalize(text: str, lang: str) -> str:
    """Ranges between digits (twice, since a match takes both digits), then class by class."""
    dash = "[" + _d_chars(typography.DASHES) + "]"
    out = f"regexp_replace(regexp_replace({text}, '([0-9]){dash}([0-9])', '\\1-\\2', 'g'), '([0-9]){dash}([0-9])', '\\1-\\2', 'g')"

    def swap(points, to):
        nonlocal out
        out = f"regexp_replace({out}, '[{_d_chars(points)}]', '{_q(to)}', 'g')"

    t = typography.TABLE
    swap(t["Hyphens"], "-")
    swap(t["Apostrophes"], "'")
    if lang == "fr":
        swap((0x201C, 0x201E, 0x201F), "« ")
        swap((0x201D,), " »")
    else:
        swap(t["Double quotes"], '"')
    swap(t["Double primes"], '"')
    swap(t["Spaces"], " ")
    out = f"CASE WHEN starts_with({text}, '﻿') THEN '﻿' ELSE '' END || regexp_replace({out}, '[{_d_chars(t['Invisibles'])}]', '', 'g')"
    swap(t["Ellipsis"], "...")
    for point, plain in zip(t["Ligatures"], typography.LIGATURES):
        swap((point,), plain)
    swap(t["Fraction slashes"], "/")
    return out


for _lang in ("en", "fr"):

    @query(f"q2{2 if _lang == 'en' else 3}_normalize_{_lang}", f"SELECT doc_id, md5({_d_normalize('text', _lang)}) AS normal, length({_d_normalize('text', _lang)})::BIGINT AS n FROM {view(st.GLYPHS)}")
    def q22(spark, sf_dir, lang=_lang):
        out = typography.normalize(F.col("text"), lang)
        return docs(spark, sf_dir, st.GLYPHS).select("doc_id", F.md5(out.cast("binary")).alias("normal"), F.length(out).cast("long").alias("n"))


_D_DASH = "[" + _d_chars(typography.DASHES) + "]"


@query("q24_dash_constructions", f"SELECT doc_id, (len(regexp_extract_all(text, '{_D_DASH}')) - len(regexp_extract_all(text, '[0-9]{_D_DASH}[0-9]')))::BIGINT AS asides FROM {view(st.GLYPHS)}")
def q24(spark, sf_dir):
    return docs(spark, sf_dir, st.GLYPHS).select("doc_id", typography.asides(F.col("text")).alias("asides"))


# -- masking ------------------------------------------------------------------------------------------------


def _d_rx(pattern: str) -> str:
    from ..functions.regex import SPACE, B, S

    return _q(pattern.replace(B, r"\b").replace(masking._START, r"\b").replace("(?iu)", "(?i)").replace(f"[^{SPACE},]", r"[^\s,]").replace(f"[^{SPACE}]", r"\S").replace(S, r"\s").replace(SPACE, r"\s"))


_D_CASED = f"regexp_matches(m1, '{_d_rx(masking.CASE)}')"
_D_MASK = rf"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[email]', 'g') AS m1 FROM {view(st.PERSONAL)}),
b AS (SELECT doc_id, CASE WHEN {_D_CASED} THEN regexp_replace(regexp_replace(m1, '{_d_rx(masking.CASE)}', '\1\2[reference]', 'g'), '{_d_rx(masking.AMOUNT)}', '[amount]', 'g') ELSE m1 END AS m2 FROM a),
c AS (SELECT doc_id, regexp_replace(m2, '{_d_rx(masking.STREET)}', '[address]', 'g') AS m3 FROM b),
k AS (SELECT doc_id, m3, list_distinct(list_filter(regexp_extract_all(m3, '\b[A-Za-z0-9]{{6,}}\b'), lambda x: regexp_matches(x, '[A-Za-z]') AND len(regexp_extract_all(x, '[0-9]')) >= 5)) AS ids FROM c),
e AS (SELECT doc_id, CASE WHEN len(ids) = 0 THEN m3 ELSE regexp_replace(m3, '\b(?:' || array_to_string(ids, '|') || ')\b', '[reference]', 'g') END AS m4 FROM k)
SELECT doc_id, md5(regexp_replace(m4, '{_d_rx(masking.PHONE)}', '[phone]', 'g')) AS masked FROM e"""


@query("q25_mask_collect", _D_MASK)
def q25(spark, sf_dir):
    return docs(spark, sf_dir, st.PERSONAL).select("doc_id", F.md5(masking.mask(F.col("text"), ibans=False).cast("binary")).alias("masked"))


@query(
    "q26_mask_measure",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+', '[email]', 'g'), '\bhttps?://\S+', '[url]', 'g'),
  '\([0-9]{{3}}\)[\s.-]?[0-9]{{3}}[\s.-]?[0-9]{{4}}|\b[0-9]{{3}}[\s.-][0-9]{{3}}[\s.-][0-9]{{4}}\b', '[phone]', 'g'),
  '\+?[0-9][0-9 .-]{{7,}}[0-9]', '[phone]', 'g'), '\b[0-9]{{5,}}\b', '[number]', 'g')) AS masked FROM {view(st.PERSONAL)}""",
)
def q26(spark, sf_dir):
    return docs(spark, sf_dir, st.PERSONAL).select("doc_id", F.md5(masking.mask_personal_data(F.col("text"), ENGLISH, ibans=False).cast("binary")).alias("masked"))


_IBANS = "CASE doc_id % 3 WHEN 0 THEN 'Le compte BE68 5390 0754 7034 chez la banque.' WHEN 1 THEN 'le compte est gb29 nwbk 6016 1331 9268 19 depuis mars' ELSE 'il 12 ans sans rien dire du tout' END"


@query(
    "q27_mask_iban",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Le compte [iban] chez la banque.' WHEN 1 THEN 'le compte est [iban] depuis mars' ELSE 'il 12 ans sans rien dire du tout' END AS masked FROM documents",
)
def q27(spark, sf_dir):
    return docs(spark, sf_dir, _IBANS).select("doc_id", masking.mask_ibans(F.col("text")).alias("masked"))


# -- cleaning -------------------------------------------------------------------------------------------------


@query(
    "q28_strip_quoted",
    rf"""WITH t AS (SELECT doc_id, text AS t0, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, md5({d_trim("t0 || CASE doc_id % 6 WHEN 5 THEN chr(10) || 'Subject: one line is prose' WHEN 0 THEN chr(10) || 'z' || chr(10) || 'z' ELSE '' END")}) AS own, doc_id % 6 <> 5 AS quoted, doc_id % 6 IN (2, 4) AS forwarded FROM t""",
)
def q28(spark, sf_dir):
    rows = docs(spark, sf_dir, st.REPLY).withColumn("q", cleaning.strip_quoted(F.col("text")))
    return rows.select("doc_id", F.md5(F.col("q.text").cast("binary")).alias("own"), "q.quoted", "q.forwarded")


@query(
    "q29_split_signature",
    rf"""SELECT doc_id, md5({d_trim("text")}) AS body,
CASE doc_id % 5 WHEN 0 THEN 'Best regards,' WHEN 2 THEN 'Je vous prie d''agréer mes salutations distinguées' WHEN 3 THEN 'Cheers' ELSE '' END AS signoff,
CASE doc_id % 5 WHEN 0 THEN 'The Writer' || chr(10) || 'Direction' WHEN 1 THEN 'Marc' WHEN 2 THEN 'Camille' WHEN 3 THEN 'Sig' ELSE '' END AS signature FROM documents""",
)
def q29(spark, sf_dir):
    rows = docs(spark, sf_dir, st.SIGNED).withColumn("p", cleaning.split_signature(F.col("text")))
    return rows.select("doc_id", F.md5(F.col("p.body").cast("binary")).alias("body"), "p.signoff", "p.signature")


_D_TAILS = rf"list_distinct(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_trim('x')}), lambda x: x <> ''), -15, -1))"
_FOOTER = f"CASE WHEN doc_id % 9 = 0 THEN text || {st.NL} || 'ACME Ltd' || {st.NL} || '12 Long Lane' || {st.NL} || 'acme.example' ELSE text END"


@query("q30_recurring_tail_lines", f"SELECT line, count(*) AS messages FROM (SELECT unnest({_D_TAILS}) AS line FROM {view(_FOOTER)}) GROUP BY line HAVING count(*) >= 10 AND NOT regexp_matches(line, '{_d_rx(cleaning.SIGNOFF).replace(chr(92) + 'A', '^')}')")
def q30(spark, sf_dir):
    return cleaning.recurring_tail_lines(docs(spark, sf_dir, _FOOTER), "text")


_D_LINES = f"list_transform(string_split(text, chr(10)), lambda x: {d_trim('x')})"
_D_CUT = rf"""WITH r AS (SELECT list(line) AS lines FROM (SELECT line FROM (SELECT unnest({_D_TAILS}) AS line FROM {view(_FOOTER)}) GROUP BY line HAVING count(*) >= 10 AND NOT regexp_matches(line, '{_d_rx(cleaning.SIGNOFF).replace(chr(92) + "A", "^")}'))),
t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, list_reverse({_D_LINES}) AS back FROM {view(_FOOTER)}),
u AS (SELECT *, coalesce(list_position(list_transform(back, lambda x: x <> '' AND NOT list_contains(lines, x)), true) - 1, len(back)) AS run FROM t, r),
c AS (SELECT *, len(list_filter(back[1:run], lambda x: x <> '')) >= 3 AS long FROM u)
SELECT doc_id, md5(CASE WHEN long THEN {d_trim("array_to_string(l[1:len(l) - run], chr(10))")} ELSE text END) AS body, '' AS signoff,
  CASE WHEN long THEN {d_trim("array_to_string(l[len(l) - run + 1:], chr(10))")} ELSE '' END AS signature FROM c"""


@query("q31_tail_cut", _D_CUT)
def q31(spark, sf_dir):
    rows = docs(spark, sf_dir, _FOOTER).select("doc_id", F.col("text").alias("body"))
    cut = cleaning.cut_recurring_tails(rows, cleaning.recurring_tail_lines(rows), ["doc_id"])
    return cut.select("doc_id", F.md5(F.col("body").cast("binary")).alias("body"), "signoff", "signature")


@query("q32_machine_written", f"SELECT doc_id, regexp_matches(text, '{_d_rx(cleaning.MACHINE)}') AS machine FROM {view(st.MACHINE)}")
def q32(spark, sf_dir):
    return docs(spark, sf_dir, st.MACHINE).select("doc_id", cleaning.written_by_a_machine(F.col("text")).alias("machine"))


def _d_function(lang: str) -> str:
    return rf"len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: x IN ({d_in(FUNCTION_WORDS[lang])})))"


@query("q33_other_language", f"SELECT doc_id, (o >= 5 AND o > 2 * e) AS other FROM (SELECT doc_id, {_d_function('en')} AS e, {_d_function('fr')} AS o FROM documents)")
def q33(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cleaning.in_another_language(F.col("text"), "en").alias("other"))


@query("q34_blank_template", f"SELECT doc_id, len(regexp_extract_all(text, '{cleaning.BLANK_FIELD}'))::BIGINT AS fields, len(regexp_extract_all(text, '{cleaning.BLANK_FIELD}')) >= 2 AS template FROM {view(st.MACHINE)}")
def q34(spark, sf_dir):
    n = cleaning.blank_fields(F.col("text"))
    return docs(spark, sf_dir, st.MACHINE).select("doc_id", n.alias("fields"), (n >= 2).alias("template"))


@query(
    "q35_drop_funnel",
    rf"""WITH r AS (SELECT CASE WHEN lang = 'de' THEN 'not_from_the_user' WHEN regexp_matches(text, '{_d_rx(cleaning.MACHINE)}') THEN 'written_by_a_machine' WHEN len(regexp_extract_all(text, '{cleaning.BLANK_FIELD}')) >= 2 THEN 'a_blank_template'
  WHEN o >= 5 AND o > 2 * e THEN 'in_another_language' ELSE 'kept' END AS reason FROM (SELECT *, {_d_function("en")} AS e, {_d_function("fr")} AS o FROM {view(st.MACHINE)}))
SELECT reason, count(*) AS n FROM r GROUP BY reason UNION ALL SELECT 'read', count(*) FROM r""",
)
def q35(spark, sf_dir):
    t = F.col("text")
    reason = cleaning.first_reason(
        ("not_from_the_user", F.col("lang") == "de"),
        ("written_by_a_machine", cleaning.written_by_a_machine(t)),
        ("a_blank_template", cleaning.blank_fields(t) >= 2),
        ("in_another_language", cleaning.in_another_language(t, "en")),
    )
    return cleaning.funnel(docs(spark, sf_dir, st.MACHINE).withColumn("drop_reason", reason))


@query("q36_since_window", "SELECT event_type, count(*) AS n FROM events WHERE ts IS NULL OR strftime(ts, '%Y-%m-%d') >= (SELECT strftime(max(ts), '%Y-%m-01') FROM events) GROUP BY event_type")
def q36(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    start = events.agg(F.date_format(F.max("ts"), "yyyy-MM-01")).first()[0]
    return events.where(cleaning.since(F.date_format("ts", "yyyy-MM-dd"), start)).groupBy("event_type").agg(F.count("*").alias("n"))


# -- dedupe --------------------------------------------------------------------------------------------------------


@query("q37_exact_dedupe", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS filed_twice FROM documents")
def q37(spark, sf_dir):
    return dedupe.first_of_key(docs(spark, sf_dir), F.sha2(F.col("text").cast("binary"), 256), "doc_id").select("doc_id", "filed_twice")


_D_MESSAGE = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'm' || (doc_id * 7919 % 300) END"


@query("q61_mail_dedupe", f"SELECT doc_id, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY source, seq, doc_id) > 1 AS filed_twice FROM (SELECT doc_id, source, doc_id % 50 AS seq, {_D_MESSAGE} AS key FROM documents)")
def q61(spark, sf_dir):
    """Copies of a message in several files, whose places in their files are often equal."""
    rows = docs(spark, sf_dir).select("doc_id", "source", (F.col("doc_id") % 50).alias("seq"), F.expr(_D_MESSAGE).alias("key"))
    return dedupe.first_of_key(rows, F.col("key"), ["source", "seq", "doc_id"]).select("doc_id", "filed_twice")


_D_PAIRS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 2)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(run, '|' ORDER BY run)) AS name FROM s GROUP BY doc_id),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY name) AS first FROM n),
u AS (SELECT s.* FROM s JOIN f USING (doc_id) WHERE f.first = f.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM u x JOIN u y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY 1, 2),
q AS (SELECT a, b, shared, least(na.n, nb.n) AS smaller FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared::DOUBLE / least(na.n, nb.n) >= 0.8)"""


@query("q38_near_dup_pairs", f"{_D_PAIRS} SELECT * FROM q")
def q38(spark, sf_dir):
    """Pairs of the first letters of each set of runs; q62 has the sets."""
    return dedupe.similar_letters(*dedupe.letter_classes(docs(spark, sf_dir), "text", "doc_id"))


@query("q62_near_dup_members", f"{_D_PAIRS} SELECT doc_id AS id, coalesce(first, doc_id) AS first FROM documents LEFT JOIN f USING (doc_id)")
def q62(spark, sf_dir):
    return dedupe.letter_classes(docs(spark, sf_dir), "text", "doc_id")[0]


# Letters in order: one goes if any pair of it that came before did not.
_D_KEPT = f"""{_D_PAIRS}, o AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM q GROUP BY b),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT o.k, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, b) ELSE gone END FROM g JOIN o ON o.k = g.k + 1),
z AS (SELECT arg_max(gone, k) AS gone FROM g)
SELECT doc_id, coalesce(first, doc_id) = doc_id AND NOT list_contains(gone, doc_id) AS kept FROM documents LEFT JOIN f USING (doc_id), z"""


@query("q39_near_dup_kept", _D_KEPT)
def q39(spark, sf_dir):
    return dedupe.kept_letters(docs(spark, sf_dir), "text", "doc_id")


@query(
    "q64_collect_letters",
    rf"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 <> 0 THEN 'not_from_the_user' WHEN regexp_matches(text, '{_d_rx(cleaning.MACHINE)}') THEN 'written_by_a_machine'
  WHEN len(regexp_extract_all(text, '{cleaning.BLANK_FIELD}')) >= 2 THEN 'a_blank_template' WHEN doc_id % 5 = 0 AND doc_id % 10 < 5 THEN 'outside_the_window' WHEN o >= 5 AND o > 2 * e THEN 'in_another_language' ELSE 'kept' END AS reason
  FROM (SELECT *, {_d_function("en")} AS e, {_d_function("fr")} AS o FROM {view(st.MACHINE)})) GROUP BY reason UNION ALL SELECT 'read', count(*) FROM documents""",
)
def q64(spark, sf_dir):
    """A folder of letters, without the search for near copies (q39) that SQL would repeat."""
    rows = docs(spark, sf_dir, st.MACHINE)
    signed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nMarc Lee"))).otherwise(F.col("text"))
    month = F.when(F.col("doc_id") % 10 < 5, "2023-12").otherwise("2024-02")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a/"), month, F.lit(" devis.txt"))).otherwise("a/devis.txt")
    letters = rows.select(F.concat("doc_id", F.lit("/"), name).alias("path"), F.lit(".txt").alias("extension"), signed.cast("binary").alias("content"))
    return pipelines.collect_letters(letters, ["marc lee", "camille"], "x", "en", "2024-01-15", dedupe=False)[1]


# -- pages and classes -----------------------------------------------------------------------------------------------

_D_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)<li[^>]*>', '- ', 'g'), '(?i)</(?:blockquote|div|h[1-6]|li|p|tr)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '(?i)&amp;', chr(57344), 'g'), '(?i)&quot;', '"', 'g')"""
_D_HTML = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_D_HTML}, '(?i)&apos;', '''', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&nbsp;', ' ', 'g')"
_D_HTML = d_trim(rf"regexp_replace(regexp_replace(replace({_D_HTML}, chr(57344), '&'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query("q40_html_to_text", f"SELECT page_id, md5({_D_HTML}) AS plain, length({_D_HTML})::BIGINT AS n FROM pages")
def q40(spark, sf_dir):
    out = parsing.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("plain"), F.length("t").cast("long").alias("n"))


_HOST = "regexp_extract(url, 'https?://([^/?#:]+)', 1)"
_WHO = f"CASE page_id % 5 WHEN 0 THEN 'tribunal.example.fr' WHEN 1 THEN 'impots.gouv.fr' WHEN 2 THEN 'agency.gov.uk' ELSE {_HOST} END"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_WHO).alias("recipient_domain"), F.concat(F.lit("page-"), "page_id").alias("id"))


@query("q41_recipient_domain", f"SELECT recipient_domain, count(*) AS n FROM (SELECT {_WHO} AS recipient_domain FROM pages) GROUP BY 1")
def q41(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("recipient_domain").agg(F.count("*").alias("n"))


_D_PUBLIC = "(" + " OR ".join(f"d = '{z}' OR ends_with(d, '.{z}')" for z in classify.ZONES) + f" OR list_has_any(string_split(d, '.'), [{d_in(classify.LABELS)}]))"


@query("q42_public_body", f"SELECT page_id, {_D_PUBLIC} AS public FROM (SELECT page_id, lower({_WHO}) AS d FROM pages)")
def q42(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", classify.public_body(F.col("recipient_domain")).alias("public"))


RULES = {"page-3": "personal", "*.gouv.fr": "administrative", "tribunal.example.fr": "administrative", "*.example.com": "professional", "page-4": "personal", "*.nowhere.test": "none"}
_D_RULE = "CASE " + " ".join(
    (f"WHEN id = '{p}' THEN {k}" if "." not in p else f"WHEN d = '{p[2:]}' OR ends_with(d, '{p[1:]}') THEN {k}" if p.startswith("*.") else f"WHEN d = '{p}' THEN {k}") for k, p in enumerate(RULES, 1)
) + " END"
_D_RULED = f"(SELECT page_id, {_D_RULE} AS rule FROM (SELECT page_id, 'page-' || page_id AS id, lower({_WHO}) AS d FROM pages))"
_D_REGISTER = "CASE rule " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(RULES.values(), 1)) + " END"


@query("q43_register_table", f"SELECT page_id, rule::INTEGER AS rule, {_D_REGISTER} AS register FROM {_D_RULED}")
def q43(spark, sf_dir):
    return classify.assign_registers(_pages(spark, sf_dir), RULES).select("page_id", "rule", "register")


@query(
    "q44_register_report",
    "SELECT r.seq::INTEGER AS seq, r.pattern, r.kind, r.register, count(p.page_id) AS samples FROM (VALUES " + ", ".join(f"({k}, '{p}', '{'domain' if '.' in p else 'id'}', '{r}')" for k, (p, r) in enumerate(RULES.items(), 1)) + f") r(seq, pattern, kind, register) LEFT JOIN {_D_RULED} p ON p.rule = r.seq GROUP BY ALL",
)
def q44(spark, sf_dir):
    return classify.register_report(classify.assign_registers(_pages(spark, sf_dir), RULES), RULES)


_EXT = "CASE doc_id % 3 WHEN 0 THEN '.tex' WHEN 1 THEN '.txt' ELSE '' END"


@query(
    "q45_guess_surface",
    rf"SELECT doc_id, CASE WHEN n < 25 THEN 'message' WHEN e IN ('.tex', '.pdf') OR doc_id % 7 = 0 THEN 'letter' ELSE 'email' END AS surface FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\s\x{{A0}}]+')) AS n, {_EXT} AS e FROM documents)",
)
def q45(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return rows.select("doc_id", classify.guess_surface(F.when(F.col("doc_id") % 7 == 0, "folder").otherwise("mbox"), F.expr(_EXT), word_count(F.col("text"))).alias("surface"))


_FORMAL = (
    f"CASE doc_id % 6 WHEN 0 THEN 'Madame, Monsieur' || {st.NL} || text || {st.NL} || 'veuillez agréer' WHEN 1 THEN text || ' tu viens, toi et ta soeur, vous' "
    f"WHEN 2 THEN 'dossier n° 12345 ' || text || ' Yours faithfully' WHEN 3 THEN text || ' votre lettre, vous et tu' ELSE text END"
)


@query(
    "q46_guess_register",
    rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '{_d_rx(classify.OFFICIAL_OPENING).replace("(?imu)", "(?im)")}')::INT + regexp_matches(text, '{_d_rx(classify.OFFICIAL_CLOSING)}')::INT + regexp_matches(text, '{_d_rx(classify.CASE_NUMBER)}')::INT >= 2 THEN 'administrative'
WHEN len(regexp_extract_all(text, '{_d_rx(classify.FAMILIAR)}')) > len(regexp_extract_all(text, '{_d_rx(classify.FORMAL)}')) THEN 'personal' ELSE 'professional' END AS register FROM {view(_FORMAL)}""",
)
def q46(spark, sf_dir):
    return docs(spark, sf_dir, _FORMAL).select("doc_id", classify.guess_register(F.lit("example.fr"), F.col("text")).alias("register"))


@query(
    "q47_sample_ids",
    "SELECT conv_id, turn, 'mail-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS id FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 1000 + turn) AS k FROM conversations WHERE role = 'user')",
)
def q47(spark, sf_dir):
    mine = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    numbered = classify.running_number(mine, "seq", "k")
    digits = F.col("k").cast("string")
    return numbered.select("conv_id", "turn", F.concat(F.lit("mail-"), F.when(F.col("k") < 10000, F.lpad(digits, 4, "0")).otherwise(digits)).alias("id"))


@query(
    "q48_exemplar_rank",
    f"""WITH b AS (SELECT doc_id, lang, source, len({d_words("text")}) AS n, doc_id % 7 = 0 AS reviewed FROM documents),
g AS (SELECT 'overall' AS kind, '' AS key, * FROM b UNION ALL SELECT 'register', lang, * FROM b UNION ALL SELECT 'surface', source, * FROM b),
m AS (SELECT kind, key, quantile_cont(n, 0.5) AS med, quantile_cont(n, 0.25) AS lo, quantile_cont(n, 0.75) AS hi FROM g GROUP BY ALL),
r AS (SELECT g.*, abs(n - med) AS gap, reviewed AND n BETWEEN lo AND hi AS inside FROM g JOIN m USING (kind, key)),
w AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY CASE WHEN inside THEN 0.0 ELSE gap END, NOT inside, gap, n DESC, doc_id) AS r1,
  row_number() OVER (PARTITION BY kind, key, reviewed ORDER BY gap, CASE WHEN inside THEN 0.0 ELSE gap END, NOT inside, n DESC, doc_id) AS r2 FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY NOT (reviewed AND r2 = 1), r1) AS rank FROM w)
SELECT kind, key, rank::INTEGER AS rank, doc_id, reviewed, n::INTEGER AS body_words FROM f WHERE rank <= 5""",
)
def q48(spark, sf_dir):
    found = _samples(spark, sf_dir).withColumn("tokens", words(F.col("text"), ENGLISH))
    return measure.exemplars(found, "doc_id")


_D_BLOCKS = f"(SELECT doc_id, b, k, len({d_words('b')}) AS n FROM (SELECT doc_id, unnest(p) AS b, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, {d_paragraphs('text')} AS p FROM {view(st.LETTER)})))"


@query(
    "q49_extract_paragraphs",
    f"""WITH x AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto, count(*) OVER (PARTITION BY doc_id) AS blocks FROM {_D_BLOCKS}),
y AS (SELECT *, k = 1 OR (upto <= 120 AND upto - n < 120) AS fits FROM x),
z AS (SELECT *, min(CASE WHEN NOT fits THEN k END) OVER (PARTITION BY doc_id) AS stop FROM y)
SELECT doc_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY k)) AS extract, sum(n)::INTEGER AS words, count(*) < max(blocks) AS cut FROM z WHERE stop IS NULL OR k < stop GROUP BY doc_id""",
)
def q49(spark, sf_dir):
    rows = docs(spark, sf_dir, st.LETTER).select("doc_id", measure.extract_of(F.col("text"), ENGLISH).alias("x"))
    return rows.select("doc_id", F.md5(F.col("x.text").cast("binary")).alias("extract"), "x.words", "x.cut")


@query(
    "q50_corpus_block",
    "SELECT coalesce(nullif(source, ''), 'unknown') AS mailbox, count(*) AS samples, count(DISTINCT lang) AS langs, count(DISTINCT doc_id % 7) AS domains, min(nullif(date, '')) AS first_date, max(nullif(date, '')) AS last_date FROM (SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN '' ELSE '2026-0' || (doc_id % 9 + 1) END AS date FROM documents) GROUP BY 1",
)
def q50(spark, sf_dir):
    date = F.expr("CASE doc_id % 3 WHEN 0 THEN '' ELSE '2026-0' || (doc_id % 9 + 1) END")
    return measure.corpus(docs(spark, sf_dir).withColumns({"date": date, "mailbox": F.col("source"), "recipient_domain": F.concat(F.lit("d"), F.col("doc_id") % 7)}))


_D_SOURCES = "SELECT lang AS document, source, lang AS tag, 'mbox' AS adapter FROM (SELECT DISTINCT lang, 'in-' || lang AS source FROM documents UNION ALL SELECT 'none', 'in-none')"


@query(
    "q63_corpus_sources",
    f"""SELECT d.document, d.source, coalesce(CASE WHEN min(m) = max(m) THEN min(m) END, any_value(d.tag)) AS mailbox, coalesce(CASE WHEN min(a) = max(a) THEN min(a) END, any_value(d.adapter)) AS adapter,
coalesce(coalesce(CASE WHEN min(a) = max(a) THEN min(a) END, any_value(d.adapter)) = 'folder', false) AS reviewed, count(s.document) AS samples
FROM ({_D_SOURCES}) d LEFT JOIN (SELECT lang AS document, nullif(CASE WHEN lang = 'fr' THEN source ELSE '' END, '') AS m, CASE WHEN lang = 'de' THEN 'folder' END AS a FROM documents) s ON s.document = d.document GROUP BY d.document, d.source""",
)
def q63(spark, sf_dir):
    """Sources of a corpus, one of them without a sample."""
    rows = docs(spark, sf_dir)
    samples = rows.select(F.col("lang").alias("document"), F.when(F.col("lang") == "fr", F.col("source")).otherwise("").alias("mailbox"), F.when(F.col("lang") == "de", "folder").alias("adapter"))
    none = spark.createDataFrame([("none",)], "lang string")
    documents = rows.select("lang").distinct().union(none).select(F.col("lang").alias("document"), F.concat(F.lit("in-"), "lang").alias("source"), F.col("lang").alias("tag"), F.lit("mbox").alias("adapter"))
    return measure.sources(samples, documents)


@query(
    "q51_sender_top",
    f"SELECT address, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'sam.s@example.org' WHEN 1 THEN 'no-reply@shop.example.com' WHEN 2 THEN 'ann@tribunal.example.fr' END AS address FROM documents) WHERE address IS NOT NULL AND NOT starts_with(address, 'no-reply') GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, address LIMIT 40",
)
def q51(spark, sf_dir):
    return cleaning.senders(docs(spark, sf_dir).select(parsing.address_of(F.expr(st.ADDRESS)).alias("address")))


@query("q52_mime_decode", "SELECT doc_id, md5(trim(text, chr(10) || chr(13) || ' ')) AS decoded, false AS refused FROM documents")
def q52(spark, sf_dir):
    from ..functions import decoding

    rows = docs(spark, sf_dir)
    raw = decoding.wrapped(F.col("text"), F.col("doc_id"))
    return rows.select("doc_id", decoding.part_text(raw).alias("p")).select("doc_id", F.md5(F.trim(F.col("p.text"), F.lit("\n\r ")).cast("binary")).alias("decoded"), "p.refused")


@query("q53_charset_mixed", "SELECT doc_id, md5(text) AS decoded FROM documents")
def q53(spark, sf_dir):
    from ..functions import decoding

    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    rows = docs(spark, sf_dir).select("doc_id", decoding.decode_charset(raw, F.lit("iso-8859-1")).alias("p"))
    return rows.select("doc_id", F.md5(F.col("p.text").cast("binary")).alias("decoded"))


@query(
    "q54_typo_report",
    f"SELECT coalesce(source, 'all') AS file, coalesce(label, 'all') AS label, count(*) AS n FROM (SELECT source, 'U+' || lpad(printf('%X', unicode(c)), greatest(4, length(printf('%X', unicode(c))))::INTEGER, '0') AS label FROM (SELECT source, unnest(regexp_extract_all(regexp_replace(text, '^﻿', ''), '{_D_NAMED}')) AS c FROM {view(st.GLYPHS)})) GROUP BY ROLLUP (source, label)",
)
def q54(spark, sf_dir):
    report = reports.typo_report(docs(spark, sf_dir, st.GLYPHS).select(F.col("source").alias("path"), "text"))
    return reports.typo_totals(report).where("path is not null or label is null").select(F.coalesce("path", F.lit("all")).alias("file"), F.coalesce("label", F.lit("all")).alias("label"), "n")


_LETTERS_ONLY = r"[^\p{L}\p{N} ]"


@query("q55_tex_to_text", r"SELECT doc_id, md5('x' || chr(10) || trim(regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g')) || chr(10) || 'done') AS plain FROM documents")
def q55(spark, sf_dir):
    plain = F.trim(F.regexp_replace("text", _LETTERS_ONLY, ""))
    tex = F.concat(F.lit("\\documentclass[a4]{letter}\n\\begin{letter}{x}% note 5\\% off\n\\textbf{"), plain, F.lit("}\n\\today* done"))
    return docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(parsing.tex_to_text(tex), "\n +", "\n").cast("binary")).alias("plain"))


@query(
    "q56_evenly",
    "WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT DISTINCT round_even(i * (n - 1) / 19.0, 0)::BIGINT AS place FROM n, range(20) r(i)), k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) SELECT doc_id FROM k JOIN p USING (place)",
)
def q56(spark, sf_dir):
    return measure.evenly(docs(spark, sf_dir).select("doc_id"), "doc_id", 20)


# -- whole jobs that SQL cannot follow -----------------------------------------------------------


@query("q57_masked_extracts")
def q57(spark, sf_dir):
    found = written(measure.records(_samples(spark, sf_dir, st.LETTER_PERSONAL), ENGLISH).select("doc_id", "text", "body"), "records")
    known = written(measure.vocabulary(found, ENGLISH), "vocabulary")
    rows = measure.extracts(found, known, ENGLISH, "doc_id")
    return rows.select("doc_id", F.md5(F.col("extract.text").cast("binary")).alias("extract"), "extract.words", "extract.cut")


@query("q58_mask_collect_ibans")
def q58(spark, sf_dir):
    return docs(spark, sf_dir, st.ACCOUNTS).select("doc_id", F.md5(masking.mask(F.col("text")).cast("binary")).alias("masked"))


@query("q59_mask_measure_ibans")
def q59(spark, sf_dir):
    return docs(spark, sf_dir, st.ACCOUNTS).select("doc_id", F.md5(masking.mask_personal_data(F.col("text"), ENGLISH).cast("binary")).alias("masked"))


@query("q60_mask_iban_texts")
def q60(spark, sf_dir):
    return docs(spark, sf_dir, st.ACCOUNTS).select("doc_id", F.md5(masking.mask_ibans(F.col("text")).cast("binary")).alias("masked"))
