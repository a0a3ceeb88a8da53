"""Units and a golden block of four messages worked out by hand."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import decoding, masking, parsing, typography
from scriptorium.functions.profiles import ENGLISH, FRENCH
from scriptorium.functions.text import display, paragraphs, sentences, words
from scriptorium.operators import classify, cleaning, measure


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


GOLDEN = [
    ("pro", "2026-03-04", "email", "professional", "Bonjour,\n\nLe devis est parti hier. Je relance le fournisseur demain.\n\nCordialement"),
    ("pro", "2026-03-06", "email", "professional", "Bonjour,\n\nTrois points ce matin :\n\n1. le devis\n2. la relance\n3. la facture\n\nJe m'en occupe aujourd'hui. Rien d'autre ?\n\nCordialement"),
    ("perso", "2026-03-07", "message", "personal", "Salut,\n\nTu passes ce soir ? Je rentre tard !\n\nBises"),
    ("perso", "2026-03-08", "email", "personal", "Coucou,\n\nOn a bien reçu ton message. Je te rappelle demain matin, promis !\n\nBises"),
]


@pytest.fixture(scope="module")
def golden(spark):
    return measure.records(spark.createDataFrame(GOLDEN, "mailbox string, date string, surface string, register string, text string"), FRENCH).cache()


def test_golden_measures(golden):
    rows = {(r["kind"], r["key"]): r for r in measure.measures(golden, FRENCH).collect()}
    r = rows["overall", ""]
    want = dict(
        messages=4, words_total=48, words_median=11.0, words_mean=12.0, words_p25=9.25, words_p75=13.75, words_min=7, words_max=19, sentences_total=12,
        sentences_median_per_message=2.0, sentence_median_words=4.0, sentence_mean_words=4.0, sentence_p90_words=6.0, sentence_max_words=6, sentence_le_10_pct=100.0,
        paragraphs_median_per_message=1.0, paragraph_median_words=8.0, familiar_messages=2, formal_messages=0, mixed_messages=0, no_marker_messages=2, familiar_pct=50.0,
        familiar_per_1000=62.5, salutation_pct=100.0, signoff_pct=100.0, exclamations_per_1000=41.67, exclamations_per_100_sentences=16.7, exclamation_pct=50.0,
        doubled_messages=0, questions_per_1000=41.67, list_messages=1, list_pct=25.0, comma_per_1000=20.83, colon_per_1000=20.83, date_first="2026-03-04", date_last="2026-03-08",
    )
    assert {k: r[k] for k in want} == want
    assert rows["register", "personal"]["words_total"] == 19 and rows["register", "professional"]["words_total"] == 29
    assert rows["surface", "email"]["messages"] == 3 and rows["surface", "message"]["messages"] == 1
    for r in rows.values():
        assert r["familiar_messages"] + r["formal_messages"] + r["mixed_messages"] + r["no_marker_messages"] == r["messages"]


def test_golden_forms_and_tics(golden):
    overall = F.col("kind") == "overall"
    forms = [(r["form"], r["count"]) for r in measure.forms(golden, "salutation", FRENCH).where(overall).orderBy("rank").collect()]
    assert forms == [("Bonjour,", 2), ("Coucou,", 1), ("Salut,", 1)]
    assert [(r["form"], r["count"]) for r in measure.forms(golden, "signoff", FRENCH).where(overall).orderBy("rank").collect()] == [("Bises", 2), ("Cordialement", 2)]
    assert [(r["tic"], r["count"], r["messages"]) for r in measure.tics(golden, FRENCH).where(overall).collect()] == [("je en tete de phrase", 4, 4)]


def test_units(spark):
    assert one(spark, "I don't like l'art", lambda t: words(t, ENGLISH)) == ["i", "don't", "like", "l'art"]
    assert one(spark, "I don't like l'art", lambda t: words(t, FRENCH)) == ["i", "don'", "t", "like", "l'", "art"]
    assert one(spark, "3 devis, 2 relances et 1. la facture", lambda t: words(t, FRENCH)) == ["devis", "relances", "et", "la", "facture"]
    assert one(spark, "je t'aime", lambda t: display(words(t, FRENCH))) == "je t'aime"
    assert len(one(spark, "M. Dupont est venu. J. Verne aussi ! Et vous ?", lambda t: sentences(t, FRENCH))) == 3
    assert one(spark, "Trois points :\n\n1. le devis\n2. la relance", lambda t: sentences(t, FRENCH)) == ["Trois points :", "le devis", "la relance"]
    assert one(spark, "a\n \nb\n\n\nc", paragraphs) == ["a", "b", "c"]
    assert one(spark, "Paris, le 3 mars\nMon cher ami,\nx", lambda t: measure.salutation_of(t, None, FRENCH)) == "Mon cher ami,"
    values = spark.createDataFrame([(v,) for v in (7, 10, 12, 19)], "v int")
    assert values.select(measure.percentile(F.col("v"), 0.25)).first()[0] == 9.25


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ecris a jean.dupont@example.fr ou a moi.", "Ecris a [email] ou a moi."),
        ("06 12 34 56 78", "[phone]"),
        ("(415) 555-2671", "[phone]"),
        ("Le 03.03.2026 tout est parti.", "Le 03.03.2026 tout est parti."),
        ("le compte est gb29 nwbk 6016 1331 9268 19 depuis mars", "le compte est [iban] depuis mars"),
        ("Le compte BE68 5390 0754 7034 chez la banque.", "Le compte [iban] chez la banque."),
        ("la facture 2026-0031 porte sur 480 euros, 1 250 EUR, 12 euro, 300 USD et 20 GBP", "la facture [reference] porte sur [amount], [amount], [amount], [amount] et [amount]"),
        ("Le menu est a 12 EUR.", "Le menu est a 12 EUR."),
        ("Envoyez-le au 52 rue des Lilas, 75011 Paris.", "Envoyez-le au [address], 75011 Paris."),
        ("Le compte 1234567X890 est clos.", "Le compte [reference] est clos."),
        ("Du B2B en V10 avec 2FA.", "Du B2B en V10 avec 2FA."),
    ],
)
def test_mask(spark, text, want):
    assert one(spark, text, masking.mask) == want


def test_mask_for_measures(spark):
    text = "ecris a a.b+c@sub.example.com ou appelle le +33 6 12 34 56 78, dossier 1234567, voir https://x.test/a"
    assert one(spark, text, lambda t: masking.mask_personal_data(t, FRENCH)) == "ecris a [email] ou appelle le [telephone], dossier [numero], voir [url]"
    assert masking.mask_names_text("bises, marc", FRENCH) == "bises, [nom]"
    assert masking.mask_body_text("Marie a vu L'affaire et Il part", FRENCH, {"l'", "affaire"}) == "[nom] a vu L'affaire et Il part"


def test_cleaning(spark):
    reply = "Oui.\n> cite\nNon.\nLe 3 mars, Sam a écrit :\n> tout"
    assert one(spark, reply, cleaning.strip_quoted).asDict() == {"text": "Oui.\nNon.", "quoted": True, "forwarded": False}
    assert one(spark, "Objet : le devis\nsuite", cleaning.strip_quoted)["quoted"] is False
    signed = "Bonjour,\n\nLe devis part demain.\n\nCordialement,\nThe Writer\nDirection\n06 12 34 56 78"
    assert one(spark, signed, cleaning.split_signature).asDict() == {"body": "Bonjour,\n\nLe devis part demain.", "signoff": "Cordialement,", "signature": "The Writer\nDirection\n06 12 34 56 78"}
    assert one(spark, "This message was automatically generated by the service.", cleaning.written_by_a_machine) is True
    assert one(spark, "Le devis a été généré hier soir.", cleaning.written_by_a_machine) is False
    assert one(spark, "impots.gouv.fr", classify.public_body) is True and one(spark, "governance-partners.com", classify.public_body) is False
    assert one(spark, "no-reply@x.y", cleaning.robot) is True and one(spark, "sam@x.y", cleaning.robot) is False


def test_parsing(spark):
    assert one(spark, "Sun, 1 Mar 2026 00:30:00 +0200", parsing.date_of) == "2026-03-01"
    assert one(spark, "&#146;&#150;&#133;", parsing.html_to_text) == "’–…"
    assert one(spark, "mot&#1114112;suite &copy; &amp;lt;", parsing.html_to_text) == "mot suite &copy; &lt;"
    assert one(spark, "mot&#9;suite", parsing.html_to_text) == "mot\tsuite"
    assert one(spark, "Sam <Sam.S@Example.org>", parsing.address_of) == "sam.s@example.org"
    assert one(spark, "From: a@b.c\nTo: x@y.z,\n  u@v.w\nTo: q@r.s\n\nbody\n\nmore", lambda t: parsing.split_message(t)["headers"]["to"]) == "x@y.z, u@v.w, q@r.s"
    assert one(spark, "/a/INBOX.mbox/Sent.mbox/Messages/1.emlx", parsing.mailbox_name) == "Sent"
    assert decoding.encoded_words("=?utf-8?B?w6k=?= =?iso-8859-1?Q?=E9_x?=") == "é é x"
    assert decoding.charset_text("é’".encode() + b"\xe9", "latin1") == "é’é"


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("a‐b‑c−d－e", "en", "a-b-c-d-e"),
        ("1914–1918, p. 3—4, 1–2–3", "en", "1914-1918, p. 3-4, 1-2-3"),
        ("a — b", "en", "a — b"),
        ("x  y z", "en", "x  y z"),
        ("﻿a﻿b​c", "en", "﻿abc"),
        ("…ﬃ⁄∕ﬆ", "en", "...ffi//st"),
        ("“oui”", "fr", "« oui »"),
        ("“yes” 5′10″", "en", "\"yes\" 5'10\""),
    ],
)
def test_normalize(spark, text, lang, want):
    assert one(spark, text, lambda t: typography.normalize(t, lang)) == want


def test_table_is_complete():
    points = [p for name, ps in typography.TABLE.items() for p in ps if name != "Ranges"]
    assert len(points) == len(set(points)) and not set(points) & set(typography.PRESERVED)
