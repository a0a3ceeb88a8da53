"""What must not grow: Python in the masks, patterns computed again, pairs and rows spread."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import masking
from scriptorium.functions.profiles import ENGLISH, FRENCH
from scriptorium.functions.regex import SPACE, quick
from scriptorium.operators import measure
from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q57_masked_extracts", "q58_mask_collect_ibans", "q59_mask_measure_ibans", "q60_mask_iban_texts"])
def test_masks_need_no_python(spark, name):
    found = plan(registry.QUERIES[name](spark, SF))
    assert "ArrowEvalPython" not in found and "PythonUDF" not in found and "run(" not in found


LINES = [
    "", "Dear Sam, marc", "bises, marc \nBien cordialement,Luc\nL'Ami, paul\t", "Hello team\x85, x", "[name] Sam [email]Bob's O'Neil-Smith", "À bientôt, ÉLODIE", "Best, ann", "thanks,\n  zoe",
    "gb29 nwbk 6016 1331 9268 19 depuis mars et BE68 5390 0754 7034", "xbe68539007547034 BE68\t5390\t0754\t7034 ab de fr", "FR76 abcd efgh ijkl mnop", "de12 abcd efgh 1234 5678 ijkl le mot\nBE68539007547034 a",
    "Straße İstanbul ΣΑΣ d'Orsay L'affaire Jean-Paul",
]


@pytest.mark.parametrize("profile", [ENGLISH, FRENCH])
def test_masks_in_columns_are_those_of_one_text(spark, profile):
    known = ["affaire", "l'", "hello", "l'affaire", "best"]
    rows = spark.createDataFrame([(k, t, known) for k, t in enumerate([*LINES, None])], "k int, t string, known array<string>")
    t = F.col("t")
    columns = {
        "names": masking.mask_names(t, profile), "body": masking.mask_body(t, F.col("known"), profile), "none": masking.mask_body(t, F.lit(None).cast("array<string>"), profile),
        "iban": masking.mask_ibans(t), "space": masking.mask_ibans(t, "[i]", any_space=True),
        "extract": masking.mask_extract(F.when(t.isNotNull(), F.array(t, t, t)), F.lit(True), F.col("k") % 2 == 0, F.col("known"), profile),
    }
    found = [r.asDict() for r in rows.select("k", *[c.alias(n) for n, c in columns.items()]).orderBy("k").collect()]
    for k, text in enumerate(LINES):
        assert found[k] == {
            "k": k, "names": masking.mask_names_text(text, profile), "body": masking.mask_body_text(text, profile, set(known)), "none": masking.mask_body_text(text, profile, ()),
            "iban": masking.mask_iban_text(text), "space": masking.mask_iban_text(text, "[i]", any_space=True),
            "extract": masking.mask_extract_text([text] * 3, True, k % 2 == 0, profile, set(known)),
        }
    assert set(found[-1].values()) == {None, len(LINES)}


@pytest.mark.parametrize(
    "name, call, most",
    [("q11_signoff_families", "regexp_extract_all(", 1), ("q14_emoji_counts", "regexp_extract_all(", 1), ("q15_tics", "regexp_extract_all(lower(", 1), ("q17_trigrams", "regexp_extract_all(", 2)],
)
def test_patterns_are_computed_once(spark, name, call, most):
    assert plan(registry.QUERIES[name](spark, SF)).count(call) <= most


def test_sentence_cut_is_not_compiled_for_every_line(spark):
    assert "lambdafunction(split(" not in plan(registry.QUERIES["q04_sentence_stats"](spark, SF))


def test_pictures_and_grams_take_short_ways(spark):
    assert "(?=[^" in plan(registry.QUERIES["q14_emoji_counts"](spark, SF))
    assert "(?=[jsvy])" in plan(registry.QUERIES["q46_guess_register"](spark, SF))
    assert "lambdafunction(" not in plan(registry.QUERIES["q17_trigrams"](spark, SF))


def test_white_space_is_soon_tested(spark):
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(0x10000).where("id not between 55296 and 57343").select(c.alias("c"))
    assert quick(f"[{SPACE}]") != f"[{SPACE}]"
    assert points.where(F.regexp_like("c", F.lit(f"[^{SPACE}]")) != F.regexp_like("c", F.lit(quick(f"[^{SPACE}]")))).count() == 0


def test_rare_ngrams_go_before_they_are_spread(spark):
    runs = spark.createDataFrame([("a", "x", [["of", "it", "of"], ["it"]]), ("b", "x", [["of", "it"] * 3]), ("b", "", [["l'", "of"]])], "register string, surface string, runs array<array<string>>")
    totals = spark.createDataFrame([("overall", "", 100), ("register", "a", 50), ("register", "b", 50), ("surface", "x", 80), ("surface", "unclassified", 20)], "kind string, key string, words_total long")
    found = measure.ngrams(runs, totals, 2, {}, k=None)
    rows = {(r["kind"], r["key"], r["ngram"]): r["count"] for r in found.collect()}
    assert rows == {("overall", "", "of it"): 4, ("surface", "x", "of it"): 4}
    assert "Window" in plan(found)


def test_pairs_are_verified_by_arrays_in_blocks(spark, monkeypatch):
    """All pairs, over several blocks; runs do not meet pair by pair."""
    import random

    from scriptorium.operators import dedupe

    monkeypatch.setattr(dedupe, "BLOCK", 3)
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    texts = ["", None, "one two three", *[" ".join(b) for b in base], " ".join(base[0])]
    for b in base:
        texts += [" ".join([*b[: rng.randint(3, len(b))], *rng.choices("xyz", k=rng.randint(0, 3))]) for _ in range(9)]
    rows = list(enumerate(texts))
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, t in rows for w in [(t or "").split()]}
    first = {k: min(j for j in sets if sets[j] == s) if s else k for k, s in sets.items()}
    own = [k for k in sets if first[k] == k and sets[k]]
    want = {(a, b, len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))) for a in own for b in own if a < b and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.8}
    members, runs = dedupe.letter_classes(spark.createDataFrame(rows, "id long, text string"), "text", "id")
    pairs = dedupe.similar_letters(members, runs)
    assert {tuple(r) for r in pairs.collect()} == want and len(want) > 20
    assert "array_intersect" in plan(pairs) and "run#" not in plan(pairs)


def test_texts_leave_the_decoder_in_pieces(spark):
    import pyarrow as pa

    from scriptorium.functions import decoding

    raws = [None if k % 7 == 0 else b"" if k % 7 == 1 else b"\xe9\xc3\xa9%d" % k for k in range(600)]
    parts = list(decoding._decoded(pa.array(raws, pa.binary()), lambda r, report, i: (str(i), decoding.charset_text(r, "latin1", report))))
    assert [len(p) for p in parts] == [256, 256, 88]
    rows = spark.createDataFrame(list(enumerate(raws)), "k int, raw binary").repartition(3)
    found = {r["k"]: r["text"] for r in rows.select("k", decoding.decode_charset(F.col("raw"), F.lit("latin1"))["text"].alias("text")).collect()}
    assert found == {k: None if r is None else decoding.charset_text(r, "latin1") for k, r in enumerate(raws)}
    assert [x["text"] for p in parts for x in p.to_pylist()] == [found[k] for k in range(600)] and parts[1][0]["type"].as_py() in (None, "256")
