"""The three pipelines: collect mail, analyse samples, report typography."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decoding, masking, parsing, typography
from ..functions.profiles import profile_for
from ..functions.text import word_count
from ..operators import classify, cleaning, measure
from ..operators.tables import written
from . import reports


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: Bytes of a message file that are read to judge its sender and date.
HEAD = 8192


def heads(messages: DataFrame) -> DataFrame:
    """``messages`` (source, seq, raw, ...) with the decoded headers that decide what is read
    further."""
    schema = T.StructType([*messages.schema.fields, *T._parse_datatype_string("_from string, _to string, _cc string, _date string, _id string").fields])
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            rows = [decoding.headers_and_body(bytes(r or b""))[0] for r in batch.column("raw").to_pylist()]
            words = [[decoding.encoded_words(h.get(n)) for h in rows] for n in ("from", "to", "cc")]
            plain = [[h.get(n) for h in rows] for n in ("date", "message-id")]
            columns = [*batch.columns, *words, *plain]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return messages.mapInArrow(run, schema)


def bodies(judged: DataFrame, load=None) -> DataFrame:
    """``judged`` without raw, with the text of the messages that nothing dropped so far, read
    by ``load(source)`` where raw is only the head of a message."""
    base = judged.drop("raw")
    schema = T.StructType([*base.schema.fields, *T._parse_datatype_string("_text string, _refused boolean, _blank boolean").fields])
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            texts, refused, blank = [], [], []
            for raw, early, source in zip(*(batch.column(c).to_pylist() for c in ("raw", "_early", "source"))):
                report = decoding.Report()
                text, empty = None, False
                if early is None and raw is not None:
                    whole = bytes(raw) if load is None else load(source)
                    text, empty = decoding.readable(whole, report)[1], not decoding.headers_and_body(whole)[1].strip()
                texts.append(text)
                refused.append(report.refused > 0)
                blank.append(empty)
            more = {"_text": pa.array(texts, pa.string()), "_refused": pa.array(refused, pa.bool_()), "_blank": pa.array(blank, pa.bool_())}
            yield pa.RecordBatch.from_arrays([more[n] if n in more else batch.column(n) for n in arrow.names], schema=arrow)

    return judged.mapInArrow(run, schema)


def collect_mail(
    messages: DataFrame, me: list[str], tag: str, lang: str = "", since: str | None = None, unlike: tuple[str, ...] = (), dedupe: bool = False, adapter: str = "mbox", load=None, surface: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(samples, funnel) of messages (source, seq, raw; where there is a mailbox, samples name
    it as their source).

    Sender, window and repeats are judged from the head alone, so bodies of other rows are
    never decoded, and with ``load`` never read; each row is charged to the first reason that
    drops it.
    """
    mine = F.array(*[F.lit(m.lower()) for m in me])
    box = F.col("mailbox") if "mailbox" in messages.columns else F.col("source")
    parsed = heads(messages.select("source", "seq", "raw", box.alias("_box"))).withColumns({"_from": parsing.address_of(F.col("_from")), "date": parsing.date_of(F.col("_date"))})
    early = cleaning.first_reason(
        ("not_from_the_user", ~F.coalesce(F.array_contains(mine, F.col("_from")), F.lit(False))),
        ("outside_the_window", ~cleaning.since(F.col("date"), since) if since else F.lit(False)),
    )
    judged = parsed.withColumn("_early", early)
    if dedupe:
        from ..operators.dedupe import first_of_key

        judged = written(judged, "heads")
        kept = judged.where("_early is null")
        again = first_of_key(kept, F.nullif(F.trim("_id"), F.lit("")), ["source", "seq"])
        judged = judged.where("_early is not null").unionByName(again.withColumn("_early", F.when(F.col("filed_twice"), F.lit("filed_twice"))).drop("filed_twice"))
    read = bodies(judged, load)
    stripped = read.withColumn("_s", cleaning.split_signature(cleaning.strip_quoted(F.col("_text"))["text"]))
    late = cleaning.first_reason(
        ("no_body", F.col("_blank")),
        ("unreadable", F.col("_refused") | parsing.undecoded(F.col("_text"))),
        ("written_by_a_machine", cleaning.written_by_a_machine(F.col("_text"), unlike)),
        ("nothing_of_their_own", word_count(F.col("_s.body")) == 0),
    )
    addresses = [parsing.addresses_in(F.col(h)) for h in ("_to", "_cc")]
    entries = stripped.select(
        "source",
        "seq",
        F.coalesce("_early", late).alias("drop_reason"),
        "date",
        parsing.domain_of(parsing.first_other(F.concat(*addresses), mine)).alias("recipient_domain"),
        F.lit(adapter).alias("adapter"),
        F.lit("").alias("extension"),
        F.col("_s.body").alias("body"),
        F.col("_s.signoff").alias("signoff"),
        F.col("_s.signature").alias("signature"),
        F.col("_box").alias("box"),
    )
    return finish(entries, tag, lang, surface)


def load_emlx(source: str) -> bytes:
    """The whole message of a message file."""
    from ..sources.mail import message_bytes, open_file

    with open_file(source) as f:
        return message_bytes(f.read())


def collect_emlx(files: DataFrame, me: list[str], tag: str, **options) -> tuple[DataFrame, DataFrame]:
    """``collect_mail`` of message files (source, mailbox, seq), in two steps: ``HEAD`` bytes of
    each tell whether the user wrote it, and only those files are read whole. A message filed
    in several mailboxes counts once."""
    schema = T.StructType([*files.select("source", "mailbox", "seq").schema.fields, T.StructField("raw", T.BinaryType())])
    arrow = _arrow(schema)

    def run(batches):
        from ..sources.mail import message_bytes, open_file

        for batch in batches:
            raws = []
            for source in batch.column("source").to_pylist():
                with open_file(source) as f:
                    raws.append(message_bytes(f.read(HEAD)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("source", "mailbox", "seq")), pa.array(raws, pa.binary())], schema=arrow)

    return collect_mail(files.select("source", "mailbox", "seq").mapInArrow(run, schema), me, tag, dedupe=True, adapter="applemail", load=load_emlx, **options)


def collect_letters(letters: DataFrame, author: list[str], tag: str, lang: str = "", since: str | None = None, unlike: tuple[str, ...] = (), dedupe: bool = True, surface: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, funnel) of letters (path, extension, content) of a folder.

    The reasons in the order in which they are looked for: not decoded, not signed by the
    author (where one is given), written by a machine, a blank template, nothing but
    quotation, before the window (by the date in the file's name), near one kept before it
    in the order of paths.
    """
    text = F.replace(decoding.decode_charset(F.col("content"), F.lit(""))["text"], F.lit("\r\n"), F.lit("\n"))
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    read = letters.select(F.col("path").alias("source"), F.lit(0).cast("long").alias("seq"), "extension", parsing.stamp_of(name).alias("date"), F.coalesce(text, F.lit("")).alias("_text"))
    own = parsing.letter_body(F.when(F.col("extension") == ".tex", parsing.tex_to_text(F.col("_text"))).otherwise(F.col("_text")))
    parted = written(read.withColumn("_s", cleaning.split_signature(cleaning.strip_quoted(own)["text"])), "letters")
    signed = F.lit(not author)
    for a in author:
        signed = signed | cleaning.signed_by(F.col("_text"), a)
    reason = cleaning.first_reason(
        ("unreadable", parsing.undecoded(F.col("_text"))),
        ("not_from_the_user", ~signed),
        ("written_by_a_machine", cleaning.written_by_a_machine(F.col("_text"), unlike)),
        ("a_blank_template", cleaning.blank_fields(F.col("_text")) >= cleaning.BLANK_FIELDS),
        ("nothing_of_their_own", word_count(F.col("_s.body")) == 0),
        ("outside_the_window", ~cleaning.since_stamp(F.col("date"), since) if since else F.lit(False)),
    )
    judged = parted.select("source", "seq", reason.alias("drop_reason"), "date", F.lit(None).cast("string").alias("recipient_domain"), F.lit("folder").alias("adapter"), "extension", "_s.body", "_s.signoff", "_s.signature")
    if dedupe:
        from ..operators.dedupe import kept_letters

        judged = written(judged, "judged")
        told = kept_letters(judged.where("drop_reason is null"), "body", "source")
        again = judged.join(told, "source", "left").withColumn("drop_reason", F.coalesce("drop_reason", F.when(~F.col("kept"), F.lit("filed_twice"))))
        judged = again.select(*judged.columns)
    return finish(judged, tag, lang, surface)


def finish(entries: DataFrame, tag: str, lang: str = "", surface: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, funnel) of entries with a ``drop_reason`` so far: recurring tails off, other
    languages out, what stays masked, classified and numbered."""
    open_rows, shut = entries.where("drop_reason is null"), entries.where("drop_reason is not null")
    bare = open_rows.where((F.col("signoff") == "") & (F.col("signature") == ""))
    signed = open_rows.where((F.col("signoff") != "") | (F.col("signature") != ""))
    cut = cleaning.cut_recurring_tails(bare, cleaning.recurring_tail_lines(bare), ["source", "seq"])
    whole = signed.unionByName(cut)
    reason = cleaning.first_reason(
        ("nothing_of_their_own", word_count(F.col("body")) == 0),
        ("in_another_language", cleaning.in_another_language(F.concat_ws("\n", "body", "signoff"), lang)),
    )
    whole = whole.withColumn("drop_reason", reason)
    masked = whole.where("drop_reason is null").withColumns({c: masking.mask(F.col(c)) for c in ("body", "signoff", "signature")})
    samples = classify.make_samples(masked.drop("drop_reason"), tag)
    if surface:
        samples = samples.withColumn("surface", F.lit(surface))
    if "box" in samples.columns:
        samples = samples.withColumn("source", F.col("box")).drop("box")
    return samples, cleaning.funnel(shut.select("drop_reason").union(whole.select("drop_reason")))


def analyse(samples: DataFrame, lang: str = "en", registers: dict[str, str] | None = None, key: str = "sample_seq") -> dict[str, DataFrame]:
    """The frames of an analysis of samples (text, register, surface, date, adapter, ...).

    Every frame has a row or a few per group; ``assembled`` makes one document of them.
    """
    profile = profile_for(lang)
    report = None
    if registers:
        samples = classify.assign_registers(samples, registers)
        report = classify.register_report(samples, registers)
    plain = samples.withColumns({c: typography.normalize(F.col(c), lang, {"Dashes": "replace"}) for c in ("text", "salutation", "signoff") if c in samples.columns})
    found = written(measure.records(plain, profile, supplied=True), "records")
    scalar = measure.measures(found, profile)
    known = written(measure.vocabulary(found, profile), "vocabulary")
    runs = found.select(key, "register", "surface").join(measure.masked_runs(found, known, profile, key), key)
    totals = scalar.select("kind", "key", "words_total")
    frames = {
        "measures": scalar,
        "families": measure.family_counts(found, profile),
        "salutations": measure.forms(found, "salutation", profile),
        "signoffs": measure.forms(found, "signoff", profile),
        "emojis": measure.emojis(found),
        "tics": measure.tics(found, profile),
        "bigrams": measure.ngrams(runs, totals, 2, profile.bigrams),
        "trigrams": measure.ngrams(runs, totals, 3, profile.trigrams),
        "exemplars": with_extracts(measure.exemplars(found, key), found, known, profile, key),
        "typography": measure.typographic_counts(samples),
        "untouched": measure.untouched_counts(samples),
    }
    if {"mailbox", "lang", "date"} <= set(samples.columns):
        frames["corpus"] = measure.corpus(samples)
    if report is not None:
        frames["register_table"] = report
    return frames


def with_extracts(chosen: DataFrame, found: DataFrame, known: DataFrame, profile, key: str) -> DataFrame:
    """Exemplars with what a reader sees of each: date, surface, register, quoted_words, cut
    and the masked text. Only the chosen samples are masked."""
    chosen = written(chosen, "exemplars")
    picked = found.join(chosen.select(key).distinct(), key, "left_semi")
    facts = picked.select(key, *[c for c in ("date", "surface", "register") if c in found.columns])
    shown = measure.extracts(picked, known, profile, key).select(key, F.col("extract.words").alias("quoted_words"), "extract.cut", "extract.text")
    return chosen.join(facts, key).join(shown, key)


def assembled(frames: dict[str, DataFrame]) -> dict:
    """One document per group of the frames that have groups, and the rest beside them."""
    groups: dict[tuple[str, str], dict] = {}
    rest: dict[str, list] = {}
    for name, frame in frames.items():
        for row in frame.collect():  # each frame is bounded by groups and limits
            values = row.asDict(recursive=True)
            if "kind" in values and "key" in values:
                group = groups.setdefault((values.pop("kind"), values.pop("key")), {})
                if name == "measures":
                    group.update(values)
                else:
                    group.setdefault(name, []).append(values)
            else:
                rest.setdefault(name, []).append(values)
    for group in groups.values():
        for value in group.values():
            if isinstance(value, list):
                value.sort(key=lambda v: v.get("rank", 0))
    return {"groups": [{"kind": k, "key": n, **g} for (k, n), g in sorted(groups.items())], **rest}


def typo(files: DataFrame, lang: str = "en", settings: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with ``fixed`` text, report of (path, label, n)) of a tree of texts."""
    fixed = files.withColumn("fixed", typography.normalize(F.col("text"), lang, settings))
    return fixed, reports.typo_report(files)
