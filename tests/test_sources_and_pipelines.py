"""Reading mail at any split, and the pipelines end to end."""

import json

from scriptorium.plans import pipelines
from scriptorium.sources import mail

ENVELOPE = "From - Wed Mar  4 10:00:00 2026\n"


def message(n, sender="me@example.org", body="Bonjour,\n\nLe devis est parti hier pour vous et la suite est dans le dossier.\n\nCordialement"):
    return f"{ENVELOPE}From: {sender}\nTo: Ann <ann@impots.gouv.fr>\nDate: Wed, {n} Mar 2026 10:00:00 +0100\nMessage-Id: <{n}@x>\n\n{body}\nFrom here on\n>From there\n\n"


BOX = message(4) + message(5, "other@example.org") + message(6, body="Unsubscribe here") + message(7, body="Mes notes pour vous.") + message(1, body="vieux mot")


def test_cut_messages_at_any_chunk():
    data = BOX.encode()
    whole = list(mail.cut_messages([data]))
    assert len(whole) == 5 and b"\nFrom there\n" in whole[0][1]
    for size in (1, 3, 7, 64, 1000):
        assert list(mail.cut_messages([data[i : i + size] for i in range(0, len(data), size)])) == whole


def test_mbox_source_at_any_split(spark, tmp_path):
    (tmp_path / "box.mbox").write_text(BOX)
    want = {(r["seq"], bytes(r["raw"])) for r in mail.read_mbox(spark, f"file://{tmp_path}/box.mbox").collect()}
    assert len(want) == 5
    for split in (50, 137, 400):
        rows = mail.read_mbox(spark, f"file://{tmp_path}/box.mbox", split).collect()
        assert {(r["seq"], bytes(r["raw"])) for r in rows} == want and len(rows) == 5


def test_collect(spark, tmp_path):
    (tmp_path / "box.mbox").write_text(BOX)
    samples, funnel = pipelines.collect_mail(mail.read_mbox(spark, f"file://{tmp_path}/box.mbox"), ["me@example.org"], "pro", "fr", since="2026-03-02")
    counts = {r["reason"]: r["n"] for r in funnel.collect()}
    assert counts == {"read": 5, "kept": 2, "not_from_the_user": 1, "written_by_a_machine": 1, "outside_the_window": 1}
    rows = samples.orderBy("id").collect()
    assert [r["id"] for r in rows] == ["pro-0001", "pro-0002"]
    assert rows[0]["recipient_domain"] == "impots.gouv.fr" and rows[0]["register"] == "administrative" and rows[0]["date"] == "2026-03-04"


def test_analyse(spark, tmp_path):
    samples = [{"id": f"s{k}", "text": f"Dear Sam,\n\nI think that we met here {k} times. It is done.\n\nBest regards", "register": "r", "surface": "email", "date": "2026-01"} for k in range(6)]
    (tmp_path / "s.json").write_text(json.dumps({"tool": "t", "lang": "en", "adapter": "folder", "tag": "x", "samples": samples + [{"id": "b", "text": " "}]}))
    found = mail.read_samples(spark, f"file://{tmp_path}/s.json")
    assert found.count() == 6
    made = pipelines.assembled(pipelines.analyse(found, "en", {"s1": "other", "*.none": "x"}))
    overall = next(g for g in made["groups"] if g["kind"] == "overall")
    assert overall["messages"] == 6 and overall["salutations"][0]["form"] == "Dear [name]," and len(overall["exemplars"]) == 5
    assert {r["pattern"]: r["samples"] for r in made["register_table"]} == {"s1": 1, "*.none": 0}
    assert any(b["ngram"] == "i think" for b in overall["bigrams"])


def test_typo(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a…b c — d")
    (tmp_path / "b.bin").write_bytes(b"\0x")
    fixed, report = pipelines.typo(mail.read_tree(spark, f"file://{tmp_path}"))
    assert [r["fixed"] for r in fixed.collect()] == ["a...b c — d"]
    assert {(r["label"], r["n"]) for r in report.collect()} == {("U+2026", 1), ("U+00A0", 1), ("U+2014", 1)}
