"""Jobs that SQL cannot follow, against versions written out in Python."""

import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from scriptorium.functions import masking
from scriptorium.functions.profiles import ENGLISH
from scriptorium.operators import measure
from scriptorium.plans import pipelines, registry, reports
from scriptorium.plans import stimulus as st

SF = "/root/testdata/sf0.001"
S = r"[\s\ufeff]"


def plain_words(text):
    return regex.findall(ENGLISH.word, text.lower())


def plain_personal(text):
    text = re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]", text, flags=re.A)
    text = re.sub(rf"(?a:\b)https?://[^\s\ufeff]+", "[url]", text)
    text = masking.mask_iban_text(text, "[iban]", any_space=True)
    text = re.sub(rf"\([0-9]{{3}}\)(?:{S}|[.-])?[0-9]{{3}}(?:{S}|[.-])?[0-9]{{4}}|(?a:\b)[0-9]{{3}}(?:{S}|[.-])[0-9]{{3}}(?:{S}|[.-])[0-9]{{4}}(?a:\b)", "[phone]", text)
    text = re.sub(r"\+?[0-9][0-9 .-]{7,}[0-9]", "[phone]", text)
    return re.sub(r"\b[0-9]{5,}\b", "[number]", text, flags=re.A)


def plain_extract(text, known, most=120):
    blocks = [b for b in (regex.sub(rf"\A{S}+|{S}+\Z", "", b) for b in re.split(r"\n[ \t]*\n", plain_personal(text))) if b]
    out, kept, n = [], [], 0
    for k, b in enumerate(blocks):
        first, _, rest = b.partition("\n")
        w = plain_words(first.strip())
        greets = 0 < len(w) <= 8 and (w[0] in ENGLISH.openers or first.strip()[-1:] in (",", ":") and len(w) <= 4)
        if k and k == len(blocks) - 1 and len(plain_words(b)) <= 10:
            out.append(masking.mask_names_text(b, ENGLISH))
        elif k == 0 and greets:
            out.append("\n".join(filter(None, [masking.mask_names_text(first, ENGLISH), masking.mask_body_text(rest, ENGLISH, known)])))
        else:
            out.append(masking.mask_body_text(b, ENGLISH, known))
    for b in out:
        size = len(plain_words(b))
        if kept and n + size > most:
            break
        kept.append(b)
        n += size
        if n >= most:
            break
    return "\n\n".join(kept), n, len(kept) < len(out)


def test_extracts_are_masked_before_the_cut(spark):
    text = "Dear Sam,\nMary met us.\n\nI write from a.b@x.org, call 1234567. The Orbanet office is here.\n\nBest, Marc"
    rows = spark.createDataFrame([("a", text), ("b", "A line with Sam and the end"), ("c", ""), ("d", None)], "id string, text string")
    known = spark.createDataFrame([("the",)], "word string")
    found = {r["id"]: r["extract"] for r in measure.extracts(rows, known, ENGLISH, "id").collect()}
    want = "Dear [name],\n[name] met us.\n\nI write from [email], call [number]. The [name] office is here.\n\nBest, [name]"
    assert found["a"]["text"] == want and found["a"]["words"] == len(plain_words(want)) and found["a"]["cut"] is False
    assert found["b"]["text"] == "A line with [name] and the end" and found["c"].asDict() == {"text": "", "words": 0, "cut": False}


def test_q57_is_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in registry.docs(spark, SF, st.LETTER_PERSONAL).collect()}
    known = {r["word"] for r in measure.vocabulary(measure.records(registry._samples(spark, SF, st.LETTER_PERSONAL), ENGLISH), ENGLISH).collect()}
    want = {k: plain_extract(t, known) for k, t in texts.items()}
    found = {r["doc_id"]: (r["extract"], r["words"], r["cut"]) for r in registry.QUERIES["q57_masked_extracts"](spark, SF).collect()}
    assert found == {k: (hashlib.md5(t.encode()).hexdigest(), n, cut) for k, (t, n, cut) in want.items()}
    assert sum("[name]" in t for t, _, _ in want.values()) > 50 and any("[email]" in t for t, _, _ in want.values())


def test_analyse_has_extracts(spark):
    rows = [(k, f"Dear Sam,\n\nI met Mary at a.b@x.org {k} times.\n\nBest, Marc", "r", "email", "2026-01", "folder" if k == 2 else "mbox") for k in range(3)]
    samples = spark.createDataFrame(rows, "sample_seq long, text string, register string, surface string, date string, adapter string")
    groups = pipelines.assembled(pipelines.analyse(samples, "en"))["groups"]
    first = groups[0]["exemplars"][0]
    assert first["text"] == "Dear [name],\n\nI met [name] at [email] 2 times.\n\nBest, [name]" and first["quoted_words"] == len(plain_words(first["text"]))
    assert (first["date"], first["surface"], first["register"], first["reviewed"], first["cut"]) == ("2026-01", "email", "r", True, False)
    assert "> I met [name] at [email] 2 times.\n" in reports.exemplars_markdown(groups)


def plain_iban(text, space=" "):
    """Every place in turn: the longest match there, less the words at its end."""
    out, at = [], 0
    shape = regex.compile(rf"(?<![A-Za-z0-9_])[A-Za-z]{{2}}[0-9]{{2}}(?:{space}?[A-Za-z0-9]{{4}}){{2,7}}(?:{space}?[A-Za-z0-9]{{1,3}})?(?![A-Za-z0-9_])")
    while at < len(text):
        m = shape.match(text, at)
        if not m:
            out.append(text[at])
            at += 1
            continue
        parts = re.split(r"(\s+)", m[0])
        while len(parts) > 1 and parts[-1].isalpha():
            parts = parts[:-2]
        head = "".join(parts)
        out.append("[iban]" + m[0][len(head) :] if len(re.findall("[0-9]", head)) >= 8 else m[0])
        at = m.end()
    return "".join(out)


def plain_collect(text):
    def java(rx):
        return regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", rx).replace("(?iu)", "(?i)").replace(r"\z", r"\Z"))

    text = plain_iban(re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]", text))
    if java(masking.CASE).search(text):
        text = java(masking.AMOUNT).sub("[amount]", java(masking.CASE).sub(r"\1\2[reference]", text))
    text = java(masking.STREET).sub("[address]", text)
    text = java(masking.IDENTIFIER).sub("[reference]", text)
    return java(masking.PHONE).sub("[phone]", text)


@pytest.mark.parametrize(
    "name, plain",
    [("q58_mask_collect_ibans", plain_collect), ("q59_mask_measure_ibans", plain_personal), ("q60_mask_iban_texts", plain_iban)],
)
def test_ibans_go_from_whole_texts(spark, name, plain):
    texts = {r["doc_id"]: r["text"] for r in registry.docs(spark, SF, st.ACCOUNTS).collect()}
    want = {k: plain(t) for k, t in texts.items()}
    found = {r["doc_id"]: r["masked"] for r in registry.QUERIES[name](spark, SF).collect()}
    assert found == {k: hashlib.md5(t.encode()).hexdigest() for k, t in want.items()}
    assert all(("[iban]" in t) for k, t in want.items() if k % 3 < 2) and sum(len(t) for t in want.values()) > 100 * len(want)
