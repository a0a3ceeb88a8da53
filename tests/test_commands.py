"""The commands from arguments to files and exit codes, and mail in two steps."""

import json

from scriptorium.__main__ import run
from scriptorium.operators import dedupe
from scriptorium.plans import pipelines
from scriptorium.sources import mail
from pyspark.sql import functions as F

BODY = "Hello Ann,\n\nThe {0} part of the plan went out yesterday and the {0} rest will follow on Monday as we agreed here.\n\nBest regards\nMarc Lee"


def said(spark, *arguments):
    out, err = [], []
    return run(list(arguments), spark, out.append, err.append), out, err


def test_folder_to_analysis(spark, tmp_path):
    letters = tmp_path / "letters"
    (letters / ".old").mkdir(parents=True)
    for k, word in enumerate(["first", "second", "third"]):
        (letters / f"{k} 2025-0{k + 1}-02.txt").write_bytes(BODY.format(word + " " + word * 2).encode("cp1252"))
    (letters / "3 copy.txt").write_text(BODY.format("first firstfirst"))
    (letters / "4 other.txt").write_text(BODY.format("x").replace("Marc Lee", "Ann Roe"))
    (letters / "5 form.txt").write_text("Dear <Name>,\n\nthe sum is ..... euros\n\nMarc Lee")
    (letters / ".old" / "6.txt").write_text(BODY.format("hidden"))
    out = str(tmp_path / "s.json")
    code, lines, _ = said(spark, "collect", "folder", str(letters), "--out", out, "--author", "marc lee", "--lang", "en")
    made = json.loads((tmp_path / "s.json").read_text())
    assert code == 0 and made["counts"]["read"] == 6 and made["counts"]["kept"] == len(made["samples"]) == 3
    assert {k: n for k, n in made["counts"]["dropped"].items() if n} == {"not_from_the_user": 1, "a_blank_template": 1, "filed_twice": 1}
    assert [s["id"] for s in made["samples"]] == ["letters-0001", "letters-0002", "letters-0003"] and made["samples"][0]["date"] == "2025-01-02"
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps([{"text": "Hello Bob,\n\nI think that we met here. It is done.\n\nBest", "adapter": "note"}, {"text": " "}]))
    empty = tmp_path / "empty.json"
    empty.write_text(json.dumps({"source": "nobody", "lang": "fr", "tag": "none", "samples": []}))
    code, lines, err = said(spark, "stylometry", out, str(bare), str(empty), "--out", str(tmp_path / "a"))
    found = json.loads((tmp_path / "a" / "analysis.json").read_text())
    overall = next(g for g in found["groups"] if g["kind"] == "overall")
    assert code == 0 and overall["messages"] == 4 and found["lang"] == "en" and lines[0].startswith("4 samples, ")
    assert sorted((s["mailbox"], s["samples"], s["reviewed"]) for s in found["sources"] if s["mailbox"]) == [("letters", 3, True), ("none", 0, False)]
    assert sum(s["samples"] for s in found["sources"]) == 4
    assert "Marc" not in (tmp_path / "a" / "exemplars.md").read_text()


def test_refusals(spark, tmp_path):
    out = str(tmp_path / "o.json")
    (tmp_path / "m.mbox").write_text("From - Wed Mar  4 10:00:00 2026\nFrom: a@b.c\n\nhello there\n")
    box = str(tmp_path / "m.mbox")
    for arguments in (["mbox", box, "--out", out], ["web", box, "--out", out, "--me", "x"], ["mbox", box, "--me", "x"], ["mbox", box, "--me", "x", "--out", out, "--since", "soon"], ["mbox", box, "--me", "x@y.z", "--out", out], ["mbox", box, "--nothing"]):
        assert said(spark, "collect", *arguments)[0] == 1
    assert not (tmp_path / "o.json").exists()
    assert said(spark, "stylometry", str(tmp_path / "none.json"))[0] == 1


def test_typo_checks_and_fixes(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / ".claude" / "worktrees").mkdir(parents=True)
    (tree / "a.txt").write_text("a…b c")
    (tree / ".claude" / "worktrees" / "b.txt").write_text("…")
    assert said(spark, "typo", str(tree))[0] == 2
    code, lines, _ = said(spark, "typo", str(tree), "--lang", "en")
    assert code == 1 and "  U+2026 1" in lines
    assert said(spark, "typo", str(tree), "--lang", "en", "--fix")[0] == 0 and (tree / "a.txt").read_text() == "a...b c"
    assert said(spark, "typo", str(tree), "--lang", "en")[0] == 0
    (tree / "PROFILE.md").write_text("---\nlang: fr\n---\n")
    assert said(spark, "typo", str(tree))[0] == 0


def emlx(sender, name, text):
    message = f"From: {sender}\nTo: ann@x.org\nDate: Wed, 4 Mar 2026 10:00:00 +0100\nMessage-Id: <{name}>\n\n{text}\n"
    return f"{len(message)}\n{message}<plist/>"


def test_mail_files_in_two_steps(spark, tmp_path):
    for box in ("Sent.mbox", "All.mbox", "Junk.mbox"):
        (tmp_path / box).mkdir()
    long = "The plan went out yesterday and the rest will follow on Monday as we agreed. " * 200
    (tmp_path / "Sent.mbox" / "1.emlx").write_text(emlx("me@x.org", "one", long))
    (tmp_path / "All.mbox" / "1.emlx").write_text(emlx("me@x.org", "one", long))
    (tmp_path / "All.mbox" / "2.emlx").write_text(emlx("you@x.org", "two", "Hello to you."))
    (tmp_path / "Junk.mbox" / "3.emlx").write_text(emlx("me@x.org", "three", "Hello again to you."))
    assert len(long) > pipelines.HEAD
    samples, funnel = pipelines.collect_emlx(mail.emlx_files(spark, f"file://{tmp_path}"), ["me@x.org"], "m")
    assert {r["reason"]: r["n"] for r in funnel.collect()} == {"read": 3, "kept": 1, "not_from_the_user": 1, "filed_twice": 1}
    kept = samples.collect()
    assert [r["source"] for r in kept] == ["All"] and kept[0]["text"] == long.strip()


def test_repeats_across_files(spark):
    """Equal places in different files: one copy of each message stays."""
    rows = spark.createDataFrame([("a", 0, "k"), ("b", 0, "k"), ("b", 900, "k"), ("b", 5, None), ("c", 5, None)], "source string, seq long, key string")
    found = dedupe.first_of_key(rows, F.col("key"), ["source", "seq"]).where("not filed_twice").collect()
    assert sorted((r["source"], r["seq"]) for r in found) == [("a", 0), ("b", 5), ("c", 5)]
