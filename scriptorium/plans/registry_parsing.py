"""Queries over parts of messages, letters and their names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decoding, parsing
from ..operators import classify, cleaning
from . import stimulus as st
from .registry import _d_rx, d_trim, docs, query, view

NL = "chr(10)"
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"


def _expr(text: str):
    return F.expr(text.replace("''", "\\'"))


_BOX = f"'From a@x Mon Jan  1 10:00' || {NL} || 'Subject: a' || {NL} || {NL} || text || {NL} || 'From here on' || {NL} || {NL} || 'From b@x Tue Feb 12 11:00' || {NL} || '>From there' || {NL} || text"


@query(
    "q65_split_mbox",
    rf"""SELECT doc_id, k::INTEGER AS k, md5(CASE WHEN k < n - 1 THEN m || {NL} || {NL} ELSE m END) AS message FROM (
SELECT doc_id, unnest(parts[2:]) AS m, unnest(range(0, len(parts) - 1)) AS k, len(parts) - 1 AS n
FROM (SELECT doc_id, list_transform(regexp_split_to_array({_BOX}, '(?:^|\n\n)From [^\s]+ +\w{{3}} \w{{3}} [ \d]\d [^\n]*\n'), lambda x: regexp_replace(x, '(^|\n)>(>*From )', '\1\2', 'g')) AS parts FROM documents))""",
)
def q65(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(parsing.split_mbox(_expr(_BOX))).alias("k", "m"))
    return rows.select("doc_id", "k", F.md5(F.col("m").cast("binary")).alias("message"))


_RAW = f"'Subject: a' || {NL} || '  folded' || {NL} || 'X-Tag: ' || lang || {NL} || 'no header' || {NL} || 'x-tag:' || source || {NL} || {NL} || text"


@query(
    "q66_split_message",
    rf"""SELECT doc_id, regexp_extract(head, '(?i)(?:^|\n)subject:[ \t]*([^\n]*)', 1) AS subject, array_to_string(regexp_extract_all(head, '(?i)(?:^|\n)x-tag:[ \t]*([^\n]*)', 1), ', ') AS tags, md5(substr(raw, cut + 2)) AS body
FROM (SELECT doc_id, raw, cut, regexp_replace(left(raw, cut - 1), '\n[ \t]+', ' ', 'g') AS head FROM (SELECT doc_id, {_RAW} AS raw, instr({_RAW}, {NL} || {NL}) AS cut FROM documents))""",
)
def q66(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", parsing.split_message(_expr(_RAW)).alias("m"))
    return rows.select("doc_id", F.col("m.headers")["subject"].alias("subject"), F.col("m.headers")["x-tag"].alias("tags"), F.md5(F.col("m.body").cast("binary")).alias("body"))


_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'Text/HTML; Charset=\"ISO-8859-1\"' WHEN 1 THEN 'multipart/mixed; boundary=b' || doc_id || '; charset=UTF-8' WHEN 2 THEN ' text/plain ;charset=Utf-8' WHEN 3 THEN NULL ELSE '; boundary=\"a b\"' END"


@query(
    "q67_content_type",
    rf"""SELECT doc_id, coalesce(nullif(lower(trim(string_split(coalesce(v, ''), ';')[1])), ''), 'text/plain') AS type,
  lower(nullif(coalesce(nullif(regexp_extract(v, '(?i);\s*charset\s*=\s*"([^"]*)"', 1), ''), regexp_extract(v, '(?i);\s*charset\s*=\s*([^\s;"]+)', 1)), '')) AS charset,
  nullif(coalesce(nullif(regexp_extract(v, '(?i);\s*boundary\s*=\s*"([^"]*)"', 1), ''), regexp_extract(v, '(?i);\s*boundary\s*=\s*([^\s;"]+)', 1)), '') AS boundary
FROM (SELECT doc_id, {_TYPE} AS v FROM documents)""",
)
def q67(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", parsing.content_type(_expr(_TYPE)).alias("t")).select("doc_id", "t.*")


_C1_TEXT = "replace(replace(text, ' ', chr((128 + doc_id % 32)::INTEGER)), '.', chr(146))"


def _q68_sql() -> str:
    points = [*range(0x80, 0xA0)]
    plain = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
    return f"SELECT doc_id, md5(translate({_C1_TEXT}, {' || '.join(f'chr({p})' for p in points)}, '{plain}')) AS plain FROM documents"


@query("q68_from_cp1252", _q68_sql())
def q68(spark, sf_dir):
    spaced = F.replace("text", F.lit(" "), F.decode(F.unhex(F.lpad(F.hex(128 + F.col("doc_id") % 32), 8, "0")), "UTF-32"))
    raw = F.replace(spaced, F.lit("."), F.lit("\x92"))
    return docs(spark, sf_dir).select("doc_id", F.md5(parsing.from_cp1252(raw).cast("binary")).alias("plain"))


_BROKEN = "CASE doc_id % 6 WHEN 0 THEN text || chr(7) WHEN 1 THEN chr(65533) || text WHEN 2 THEN text || chr(9) || chr(13) WHEN 3 THEN replace(text, ' ', chr(160)) ELSE text END"


@query("q69_undecoded", rf"SELECT doc_id, regexp_matches({_BROKEN}, '[\x{{01}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{FFFD}}]') AS wrong FROM documents")
def q69(spark, sf_dir):
    text = F.expr(_BROKEN.replace("chr(65533)", "'�'").replace("chr(160)", "' '"))
    return docs(spark, sf_dir).select("doc_id", parsing.undecoded(text).alias("wrong"))


_PAGE = f"CASE doc_id % 4 WHEN 0 THEN 'Marc Lee' || {NL} || '12 Long Lane' || {NL} || 'Dear Ann,' || {NL} || text WHEN 1 THEN 'Marc Lee' || {NL} || 'Objet : devis' || {NL} || 'rest' || {NL} || {NL} || text WHEN 2 THEN 'Subject: x' || {NL} || text ELSE text END"


@query(
    "q70_letter_body",
    rf"""WITH a AS (SELECT doc_id, {_PAGE} AS t, string_split({_PAGE}, {NL}) AS l FROM documents),
b AS (SELECT *, coalesce(list_position(list_transform(l[1:30], lambda x: regexp_matches(x, ',\s*$') AND len(regexp_extract_all(x, '\S+')) <= 8 AND regexp_matches({d_trim("x")}, '{_d_rx(parsing.OPENERS).replace("(?![A-Za-z0-9_])", chr(92) + "b").replace(chr(92) + "A", "^")}')), true), 0) AS g,
  coalesce(list_position(list_transform(l[1:30], lambda x: regexp_matches(x, '(?i)^\s*(?:concerne|objet|re|subject)\s*:')), true), 0) AS s FROM a),
c AS (SELECT *, l[s + 1:] AS below, coalesce(list_position(list_transform(l[s + 1:], lambda x: {d_trim("x")} = ''), true), 0) AS gap FROM b)
SELECT doc_id, md5(CASE WHEN g > 0 THEN array_to_string(l[g:], {NL}) WHEN s = 0 THEN t ELSE coalesce(nullif(CASE WHEN gap > 0 THEN {d_trim(f"array_to_string(below[gap:], {NL})")} ELSE '' END, ''), t) END) AS body FROM c""",
)
def q70(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(parsing.letter_body(_expr(_PAGE)).cast("binary")).alias("body"))


_NAME = "CASE doc_id % 4 WHEN 0 THEN 'devis 2024-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) || '.txt' WHEN 1 THEN '2023-1' || (doc_id % 3) || ' lettre.tex' WHEN 2 THEN 'lettre 20-1.txt' ELSE '12024-051.txt' END"


@query("q71_stamp_window", rf"SELECT doc_id, stamp, coalesce(stamp >= left('2024-03-10', length(stamp)), true) AS inside FROM (SELECT doc_id, nullif(regexp_extract({_NAME}, '([0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?)', 1), '') AS stamp FROM documents)")
def q71(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", parsing.stamp_of(F.expr(_NAME)).alias("stamp"))
    return rows.withColumn("inside", cleaning.since_stamp(F.col("stamp"), "2024-03-10"))


@query(
    "q72_collected_salutation",
    rf"""SELECT doc_id, coalesce(list_filter(list_filter(list_transform(string_split(text, {NL}), lambda x: {d_trim("x")}), lambda x: x <> '')[1:3],
  lambda x: len(regexp_extract_all(x, '\S+')) <= 8 AND (regexp_matches(x, '{_d_rx(parsing.OPENERS).replace("(?![A-Za-z0-9_])", chr(92) + "b").replace(chr(92) + "A", "^")}') OR (regexp_matches(x, '[,:]$') AND len(regexp_extract_all(x, '\S+')) <= 4)))[1], '') AS salutation FROM {view(st.LETTER)}""",
)
def q72(spark, sf_dir):
    return docs(spark, sf_dir, st.LETTER).select("doc_id", parsing.salutation_of(F.col("text")).alias("salutation"))


@query("q73_line_number", f"SELECT doc_id, (length(left(text, place)) - length(replace(left(text, place), {NL}, '')) + 1)::BIGINT AS line FROM (SELECT *, (doc_id * 37 % (length(text) + 1))::INTEGER AS place FROM documents)")
def q73(spark, sf_dir):
    at = (F.col("doc_id") * 37 % (F.length("text") + 1)).cast("int")
    return docs(spark, sf_dir).select("doc_id", parsing.line_number(F.col("text"), at).alias("line"))


_SIGNED = f"CASE doc_id % 3 WHEN 0 THEN text || {NL} || 'MARC lee' WHEN 1 THEN 'Marc Lee' || {NL} || text ELSE text END"


@query("q74_signed_by", f"SELECT doc_id, len(list_filter(list_reverse(list_filter(string_split(text, {NL}), lambda x: {d_trim('x')} <> ''))[1:12], lambda x: contains(lower(x), 'marc lee'))) > 0 AS signed FROM {view(_SIGNED)}")
def q74(spark, sf_dir):
    return docs(spark, sf_dir, _SIGNED).select("doc_id", cleaning.signed_by(F.col("text"), "Marc Lee").alias("signed"))


_LIST = "CASE doc_id % 4 WHEN 0 THEN 'Me <me@x.org>, Ann <Ann@' || source || '.org>' WHEN 1 THEN 'me@x.org' WHEN 2 THEN '\"Lee, Bob\" <bob@y.org>, me@x.org' ELSE '' END"


@query(
    "q75_first_recipient",
    rf"""SELECT doc_id, nullif(regexp_extract(r, '@([^@]+)$', 1), '') AS domain FROM (SELECT doc_id, list_filter(list_transform(list_filter(string_split({_LIST}, ','), lambda x: contains(x, '@')), lambda x: lower(coalesce(nullif(regexp_extract(x, '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1), ''), regexp_extract(x, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')))), lambda x: x <> 'me@x.org')[1] AS r FROM documents)""",
)
def q75(spark, sf_dir):
    found = parsing.first_other(parsing.addresses_in(F.expr(_LIST)), F.array(F.lit("me@x.org")))
    return docs(spark, sf_dir).select("doc_id", parsing.domain_of(found).alias("domain"))


_PATH = "CASE doc_id % 3 WHEN 0 THEN '/m/Work.mbox/' || source || '.mbox/Data/Messages/' || doc_id || '.emlx' WHEN 1 THEN '/m/' || lang || '.mbox/' || doc_id || '.emlx' ELSE '/m/' || doc_id || '.emlx' END"


@query("q76_mailbox_name", rf"SELECT doc_id, coalesce(regexp_extract_all({_PATH}, '([^/]+)\.mbox/', 1)[-1], 'Mail') AS mailbox FROM documents")
def q76(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", parsing.mailbox_name(F.expr(_PATH)).alias("mailbox"))


_DATE = "CASE doc_id % 4 WHEN 0 THEN 'Wed, ' || (doc_id % 28 + 1) || ' Mar 2026 23:59:00 -0800' WHEN 1 THEN (doc_id % 28 + 1) || ' december 2019' WHEN 2 THEN 'Mon,  07 Feb. 2022 01:00 +0900' ELSE 'soon' END"


@query(
    "q77_date_of",
    rf"""SELECT doc_id, CASE WHEN m[1] <> '' AND list_position({_MONTHS}, lower(m[2])) > 0 THEN m[3] || '-' || lpad(list_position({_MONTHS}, lower(m[2]))::VARCHAR, 2, '0') || '-' || lpad(m[1], 2, '0') END AS date
FROM (SELECT doc_id, [regexp_extract(v, rx, 1), regexp_extract(v, rx, 2), regexp_extract(v, rx, 3)] AS m FROM (SELECT doc_id, {_DATE} AS v, '(?i)(?:^|[^0-9])([0-9]{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?\s+([0-9]{{4}})' AS rx FROM documents))""",
)
def q77(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", parsing.date_of(F.expr(_DATE)).alias("date"))


@query(
    "q78_make_samples",
    rf"""SELECT doc_id, 'x-' || lpad(row_number() OVER (ORDER BY source, doc_id % 50, doc_id)::VARCHAR, 4, '0') AS id, md5(text || CASE doc_id % 2 WHEN 0 THEN {NL} || {NL} || 'Cheers' ELSE '' END) AS text,
  len(regexp_extract_all(text, '[^\s\x{{A0}}]+')) + (doc_id % 2 = 0)::INTEGER AS words, CASE WHEN doc_id % 7 = 0 THEN 'letter' WHEN len(regexp_extract_all(text, '[^\s\x{{A0}}]+')) + (doc_id % 2 = 0)::INTEGER < 25 THEN 'message' ELSE 'email' END AS surface_or_short FROM documents
WHERE NOT (doc_id % 7 = 0 AND len(regexp_extract_all(text, '[^\s\x{{A0}}]+')) < 25)""",
)
def q78(spark, sf_dir):
    """Texts with their closings, words, surface and a running id over all sources. Sources hold
    equal places here, so the place is made of two numbers."""
    rows = docs(spark, sf_dir)
    none = F.lit(None).cast("string")
    entries = rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "folder").otherwise("mbox").alias("adapter"), "source", (F.col("doc_id") % 50 * 10_000_000 + F.col("doc_id")).alias("seq"), none.alias("date"), none.alias("recipient_domain"), F.lit("").alias("extension"), F.col("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, "Cheers").otherwise("").alias("signoff"), F.lit("").alias("signature"))
    made = classify.make_samples(entries.where(~((F.col("adapter") == "folder") & (classify.word_count(F.col("body")) < 25))), "x")
    return made.select("doc_id", "id", F.md5(F.col("text").cast("binary")).alias("text"), "words", F.col("surface").alias("surface_or_short"))


_REFERENCE = "text || '&#' || (160 + doc_id % 500) || ';&#x' || CASE doc_id % 3 WHEN 0 THEN '41' WHEN 1 THEN '92' ELSE '7' END || ';z'"


@query("q79_numeric_references", f"SELECT doc_id, md5({d_trim(chr(39) + 'x' + chr(39) + ' || text')} || chr((160 + doc_id % 500)::INTEGER) || CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN '’' ELSE ' ' END || 'z') AS plain FROM documents WHERE NOT regexp_matches(text, '[<&]|[ \\t]\\n|\\n{{3}}')")
def q79(spark, sf_dir):
    rows = docs(spark, sf_dir).where(~F.regexp_like("text", F.lit(r"[<&]|[ \t]\n|\n{3}")))  # what other rules of html would change
    return rows.select("doc_id", F.md5(parsing.html_to_text(F.concat(F.lit("x"), F.expr(_REFERENCE))).cast("binary")).alias("plain"))


@query("q80_emlx_message", f"SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '<plist/>' ELSE text || '<plist/>' END) AS message FROM documents")
def q80(spark, sf_dir):
    size = F.when(F.col("doc_id") % 3 == 0, F.octet_length("text").cast("string")).when(F.col("doc_id") % 3 == 1, "x").otherwise("99999999")
    content = F.concat(size, F.lit("\n"), "text", F.lit("<plist/>")).cast("binary")
    return docs(spark, sf_dir).select("doc_id", F.md5(F.encode(parsing.emlx_message(content), "ISO-8859-1")).alias("message"))


@query("q81_encoded_words", "SELECT doc_id, 'Re: ' || left(text, 20) || ' ' || left(text, 10) || ' x' AS value FROM documents WHERE regexp_matches(left(text, 20), '^[\\x21-\\x7E \\p{L}]+$')")
def q81(spark, sf_dir):
    def word(charset: str, n: int):
        return F.concat(F.lit(f"=?{charset}?b?"), F.base64(F.encode(F.left("text", F.lit(n)), charset)), F.lit("?="))

    rows = docs(spark, sf_dir).where(F.regexp_like(F.left("text", F.lit(20)), F.lit(r"\A[\x21-\x7E \p{L}]+\z")))
    return rows.select("doc_id", decoding.decode_words(F.concat(F.lit("Re: "), word("UTF-8", 20), F.lit(" "), word("ISO-8859-1", 10), F.lit(" x"))).alias("value"))


@query("q82_decoding_report", "SELECT lang, sum(CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END)::BIGINT AS doubtful, sum(CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END)::BIGINT AS refused, 'utf-32, x-none' AS charsets FROM documents GROUP BY lang")
def q82(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("utf-8", "x-none", "utf-32", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.encode(F.concat(F.lit("a"), "text"), "UTF-8")
    rows = docs(spark, sf_dir).select("lang", decoding.decode_charset(raw, label).alias("d"))
    return rows.groupBy("lang").agg(*decoding.decoding_report(F.col("d")))
