"""The three commands: ``collect``, ``stylometry`` and ``typo``.

Each returns its exit code: 0 done, 1 refused or nothing found (and, for a check of
typography, something found), 2 no profile to go by. Samples are streamed into their
document row by row; what a terminal shows is bounded by groups, reasons and the report.
"""

from __future__ import annotations

import datetime
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typography
from ..operators import cleaning, measure
from ..sources import mail
from . import pipelines, reports

ADAPTERS = ("mbox", "applemail", "folder")
COLUMNS = ("id", "mailbox", "adapter", "source", "date", "recipient_domain", "surface", "register", "words", "text", "salutation", "signoff", "signature")
REASONS = ("not_from_the_user", "outside_the_window", "no_body", "unreadable", "written_by_a_machine", "a_blank_template", "nothing_of_their_own", "in_another_language", "filed_twice")


def uri(path: str) -> str:
    return path if re.match(r"[a-z][a-z0-9+.-]*://", path) else "file://" + os.path.abspath(path)


def window(value: str | None, today: datetime.date) -> str | None:
    """A date, or a number of years back (``3y``); ValueError otherwise."""
    if not value:
        return None
    years = re.fullmatch(r"([0-9]+)y", value.strip())
    if years:
        year = today.year - int(years[1])
        day = 28 if (today.month, today.day) == (2, 29) and year % 4 else today.day
        return f"{year:04}-{today.month:02}-{day:02}"
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value.strip()):
        raise ValueError(f"a window is a date such as 2024-01-31 or years such as 3y, not {value}")
    return value.strip()


def write_document(samples: DataFrame, funnel: DataFrame, path: str, adapter: str, tag: str, lang: str | None, today: datetime.date) -> dict[str, int]:
    """One JSON document of the samples in order of their ids, with the counts of the funnel."""
    found = {r["reason"]: r["n"] for r in funnel.collect()}
    counts = {"read": found.get("read", 0), "kept": found.get("kept", 0), "dropped": {name: found.get(name, 0) for name in REASONS}}
    named = {"mbox": "a mailbox", "applemail": "the mail of this machine", "folder": "a folder"}[adapter]
    head = {"tool": "scriptorium collect", "lang": lang, "adapter": adapter, "tag": tag, "source": f"{named}, tagged {tag}", "collected": today.isoformat(), "counts": counts}
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, ensure_ascii=False, indent=2)[:-2] + ',\n  "samples": [')
        rows = samples.select(*COLUMNS).orderBy(F.length("id"), "id").toLocalIterator()  # a partition at a time
        for k, row in enumerate(rows):
            out.write((",\n    " if k else "\n    ") + json.dumps(row.asDict(), ensure_ascii=False))
        out.write("\n  ]\n}\n")
    return found


def collect(spark: SparkSession, options, say, complain) -> int:
    if options.adapter == "detect":
        for line in detected(spark, options.source):
            say(line)
        return 0
    if options.adapter not in ADAPTERS:
        complain(f"no such adapter: {options.adapter}")
        return 1
    me = [a.strip().lower() for a in options.me if a.strip()]
    if options.adapter != "folder" and not me:
        complain(f"{options.adapter} needs --me, the addresses that the user sends from")
        return 1
    try:
        since = window(options.since, datetime.date.today())
    except ValueError as error:
        complain(str(error))
        return 1
    if not options.out:
        complain("--out names the file that samples are written to")
        return 1
    tag = options.tag or ("letters" if options.adapter == "folder" else "mail")
    unlike = tuple(w.strip().lower() for w in options.unlike if w.strip())
    common = {"lang": options.lang or "", "since": since, "unlike": unlike, "surface": options.surface}
    try:
        if options.adapter == "folder":
            samples, funnel = pipelines.collect_letters(mail.read_letters(spark, uri(options.source)), [a.strip() for a in options.author if a.strip()], tag, **common)
        elif options.adapter == "mbox":
            samples, funnel = pipelines.collect_mail(mail.read_mbox(spark, uri(options.source)), me, tag, **common)
        else:
            samples, funnel = pipelines.collect_emlx(mail.emlx_files(spark, uri(options.source or os.path.expanduser("~/Library/Mail"))), me, tag, **common)
        found = write_document(samples, funnel, options.out, options.adapter, tag, options.lang, datetime.date.today())
    except OSError as error:
        complain(f"{options.out}: {error}")
        return 1
    if not found.get("kept"):
        os.remove(options.out)
        complain(f"{options.source}: none of {found.get('read', 0)} kept ({', '.join(f'{k} {n}' for k, n in sorted(found.items()) if k not in ('read', 'kept'))})")
        return 1
    dropped = "".join(f"; {found[name]} {name.replace('_', ' ')}" for name in REASONS if found.get(name))
    say(f"{found['kept']} of {found['read']} kept in {options.out}{dropped}")
    return 0


def detected(spark: SparkSession, source: str | None) -> list[str]:
    """The kinds of mail below a path and who sends most of it."""
    root = uri(source or os.path.expanduser("~/Library/Mail"))
    lines = []
    messages = mail.emlx_files(spark, root)
    boxes = messages.groupBy("mailbox").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mailbox").limit(40).collect()
    lines += [f"{r['n']:>8}  {r['mailbox']}" for r in boxes]
    raw = mail.read_emlx(spark, root) if boxes else mail.read_mbox(spark, root)
    senders = pipelines.heads(raw.select("source", "seq", "raw")).select(pipelines.parsing.address_of(F.col("_from")).alias("address"))
    return lines + [f"{r['n']:>8}  {r['address']}" for r in cleaning.senders(senders).collect()]


def stylometry(spark: SparkSession, options, say, complain) -> int:
    inputs = [uri(p) for p in options.inputs]
    table = None
    try:
        for path in [*options.inputs, *([options.registers] if options.registers else [])]:
            with open(path, encoding="utf-8") as f:
                f.read(1)
        if options.registers:
            with open(options.registers, encoding="utf-8") as f:
                table = json.load(f)
            if not isinstance(table, dict) or not all(isinstance(v, str) for v in table.values()):
                raise ValueError("a table maps patterns to names")
    except (OSError, ValueError) as error:
        complain(f"cannot be read: {error}")
        return 1
    samples = mail.read_samples(spark, inputs)
    if not samples.limit(1).count():
        complain("no sample holds any text")
        return 1
    langs = sorted(r["lang"] for r in samples.where("lang is not null").select("lang").distinct().limit(50).collect())
    lang = options.lang or (langs[0] if langs else "en")
    if langs and (len(langs) > 1 and not options.lang or options.lang and langs != [options.lang]):
        complain(f"samples say {', '.join(langs)}; measured as {lang}")
    frames = pipelines.analyse(samples, lang, table)
    frames["sources"] = measure.sources(samples, mail.read_documents(spark, inputs))
    made = pipelines.assembled(frames)
    overall = next(g for g in made["groups"] if g["kind"] == "overall")
    out = options.out or os.path.dirname(os.path.abspath(options.inputs[0]))
    os.makedirs(out, exist_ok=True)
    analysis, exemplars = os.path.join(out, "analysis.json"), os.path.join(out, "exemplars.md")
    with open(analysis, "w", encoding="utf-8") as f:
        json.dump({"lang": lang, **made}, f, ensure_ascii=False, indent=2, default=str)
        f.write("\n")
    with open(exemplars, "w", encoding="utf-8") as f:
        f.write(reports.exemplars_markdown(made["groups"]))
    say(f"{overall['messages']} samples, {overall['words_total']} words, {lang}")
    say(analysis)
    say(exemplars)
    return 0


def typo(spark: SparkSession, options, say, complain) -> int:
    """Reports the characters of a tree, or with ``fix`` writes the files that change back."""
    missing = [t for t in options.targets if not os.path.exists(t)]
    for target in missing:
        complain(f"{target}: cannot be read")
    targets = [t for t in options.targets if t not in missing]
    if not targets:
        return 1 if missing else 0
    files = mail.read_tree(spark, uri(targets[0]))
    for target in targets[1:]:
        files = files.unionByName(mail.read_tree(spark, uri(target)))
    profile = {"lang": options.lang, "typography": {}}
    if options.profile:
        try:
            with open(options.profile, encoding="utf-8") as f:
                profile = reports.parse_profile(f.read())
        except OSError:
            complain(f"{options.profile}: cannot be read")
            return 2
    elif not options.lang:
        found = reports.nearest_profile(os.path.abspath(targets[0]), options.profile_name)
        if found is None:
            complain(f"no profile above {targets[0]}; name one with --profile, or a language with --lang")
            return 2
        profile = found
    lang = options.lang or profile["lang"]
    fixed = files.withColumn("fixed", typography.normalize(F.col("text"), lang, profile["typography"]))
    changed = fixed.where(~F.col("text").eqNullSafe(F.col("fixed")))
    report, rewrite = reports.typo_report(files), reports.dash_sentences(files)
    for row in reports.typo_lines(report).toLocalIterator():
        say(row["line"])
    sentences = 0
    for row in rewrite.orderBy("path", "line").toLocalIterator():
        sentences += 1
        say(f"{row['path']}:{row['line']}  {row['points']}  {row['sentence']}")
    if options.fix:
        done = reports.write_back(changed.select("path", "fixed"))
        say(f"{done} files written")
        return 0
    return int(sentences > 0 or changed.limit(1).count() > 0)
