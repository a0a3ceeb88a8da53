"""Inputs for the queries: the test tables in the shape of letters and mail.

The tables hold no blank lines, greetings, glyphs or quotations, so views add them by the
number of the row. Each view is one SQL expression that both engines read alike.
"""

NL = "chr(10)"

GREETING = "CASE doc_id % 4 WHEN 0 THEN 'Dear Sam,' WHEN 1 THEN 'Hello team' WHEN 2 THEN 'Subject: devis' ELSE 'Bonjour Camille,' END"
CLOSING = f"CASE doc_id % 5 WHEN 0 THEN 'Best regards' WHEN 1 THEN 'Thanks again,' || {NL} || 'Marc' WHEN 2 THEN 'Tu vois, je te dis merci à toi' WHEN 3 THEN 'Cordialement' ELSE 'See you soon' END"
PARAGRAPHS = f"replace(text, {NL}, {NL} || {NL})"
#: A letter: greeting, paragraphs, closing.
LETTER = f"{GREETING} || {NL} || {NL} || {PARAGRAPHS} || {NL} || {NL} || {CLOSING}"
#: Typographic characters by row.
GLYPHS = (
    "CASE doc_id % 5 WHEN 0 THEN replace(text, ', ', '’ ') WHEN 1 THEN replace(text, '. ', '… ') "
    "WHEN 2 THEN '1914–1918 — ' || replace(text, 'th', '“th”') WHEN 3 THEN '﻿' || replace(text, ' ', ' ') "
    "ELSE replace(replace(text, 'fi', 'ﬁ'), 'on', 'o​n') || ' 3—4 œ • ″' END"
)
#: Marks that prose rarely has: lists, emoji, questions, quotations, shouts.
MARKS = (
    f"CASE doc_id % 6 WHEN 0 THEN '- one' || {NL} || '2. two' || {NL} || text WHEN 1 THEN text || ' ☀ 🎉🎉 !! Really ?' "
    f"WHEN 2 THEN 'So (well) \"quoted\" ; I go. ' || text WHEN 3 THEN 'WHAT - a thing: it''s done ! ! ' || text WHEN 4 THEN 'I see. ' || text ELSE text END"
)
#: Replies, forwards and header blocks around the text.
REPLY = (
    f"CASE doc_id % 6 WHEN 0 THEN text || {NL} || 'z' || {NL} || 'z' || {NL} || 'On Monday Sam wrote:' || {NL} || '> quoted' WHEN 1 THEN '> old' || {NL} || text "
    f"WHEN 2 THEN text || {NL} || '-- forwarded message' || {NL} || text WHEN 3 THEN text || {NL} || 'From: Sam' || {NL} || 'To: Ann' || {NL} || text "
    f"WHEN 4 THEN text || {NL} || 'Begin forwarded message:' || {NL} || text ELSE text || {NL} || 'Subject: one line is prose' END"
)
SIGNED = (
    f"CASE doc_id % 5 WHEN 0 THEN text || {NL} || 'Best regards,' || {NL} || 'The Writer' || {NL} || 'Direction' "
    f"WHEN 1 THEN text || {NL} || '-- ' || {NL} || 'Marc' WHEN 2 THEN text || {NL} || 'Je vous prie d''agréer' || {NL} || 'mes salutations distinguées' || {NL} || 'Camille' "
    f"WHEN 3 THEN text || {NL} || 'Cheers' || {NL} || '--' || {NL} || 'Sig' ELSE text END"
)
MACHINE = "CASE doc_id % 7 WHEN 0 THEN text || ' To leave, UNSUBSCRIBE here.' WHEN 1 THEN 'Message automatique. ' || text WHEN 2 THEN text || ' <Nom> ..... <Société>' ELSE text END"
PERSONAL = (
    "CASE doc_id % 8 WHEN 0 THEN text || ' write a.b+c@sub.example.com or call +33 6 12 34 56 78 now' WHEN 1 THEN 'facture 2026-0031 de 480 euros. ' || text "
    "WHEN 2 THEN 'Envoyez au 52 rue des Lilas, 75011 Paris. ' || text WHEN 3 THEN text || ' compte 1234567X890 clos' WHEN 4 THEN text || ' (415) 555-2671 or 415-555-2671' "
    "WHEN 5 THEN text || ' see https://x.test/a and 1234567' WHEN 6 THEN 'Le 03.03.2026 tout est parti a 12 EUR. ' || text ELSE text END"
)
#: Account numbers beside the whole text with its personal data.
ACCOUNTS = (
    f"CASE doc_id % 3 WHEN 0 THEN 'Le compte BE68 5390 0754 7034 chez la banque. ' || ({PERSONAL}) WHEN 1 THEN ({PERSONAL}) || {NL} || 'le compte est gb29 nwbk 6016 1331 9268 19 depuis mars' "
    f"ELSE ({PERSONAL}) || ' il 12 ans sans rien dire du tout' END"
)
#: A letter around a text with personal data.
LETTER_PERSONAL = f"{GREETING} || {NL} || {NL} || replace({PERSONAL}, {NL}, {NL} || {NL}) || {NL} || {NL} || {CLOSING}"
ADDRESS = "CASE doc_id % 4 WHEN 0 THEN 'Sam <Sam.S@Example.org>, ann@gouv.fr' WHEN 1 THEN 'no-reply@shop.example.com' WHEN 2 THEN 'Ann Lee <ann@tribunal.example.fr>' ELSE 'undisclosed' END"
TEX = "'\\\\begin{letter}{x} % note' || chr(10) || '\\\\textbf{' || text || '} \\\\today*'"
