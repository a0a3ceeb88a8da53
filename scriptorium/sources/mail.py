"""Sources: mailboxes, mail folders, letters, sample documents, file trees."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.parsing import emlx_message, mailbox_name

ENVELOPE = re.compile(rb"From [^\s]+ +\w{3} \w{3} [ \d]\d ")


def cut_messages(chunks, start: int = 0, stop: int | None = None, lead: bool = True):
    """(offset, message) of the messages that begin at ``start`` or later and before ``stop``.

    ``chunks`` are the bytes from ``start`` on, of any sizes. An envelope counts at the
    beginning of the file (``lead``) or after a blank line; it is left out, and a quoted
    one loses one mark.
    """
    rest, at, blank, begun, lines = b"", start, lead, None, []

    def finished():
        return begun, b"".join(lines)

    def handle(line: bytes):
        nonlocal blank, begun, lines
        done = None
        if blank and ENVELOPE.match(line):
            done = finished() if begun is not None else None
            begun, lines = at, []
        elif begun is not None:
            lines.append(line[1:] if re.match(rb">+From ", line) else line)
        blank = line.strip(b"\r\n") == b""
        return done

    for chunk in chunks:
        rest += chunk
        whole = rest.split(b"\n")
        rest = whole.pop()
        for part in whole:
            line = part + b"\n"
            done = handle(line)
            if done:
                yield done
            if done is not None or begun is None:
                if stop is not None and (begun if begun is not None else at) >= stop:
                    return
            at += len(line)
    if rest:
        done = handle(rest)
        if done:
            yield done
            if stop is not None and begun >= stop:
                return
    if begun is not None and (stop is None or begun < stop):
        yield finished()


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class MboxReader(DataSourceReader):
    CHUNK = 1 << 20

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(inner)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
        found = []
        for f in sorted(files, key=lambda f: f.path):
            for start in range(0, max(f.size, 1), self.split):
                found.append(Range(f.path, start, min(start + self.split, f.size)))
        return found

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as source:
            # Begin a little early, so that the blank line before an envelope is seen.
            start = max(0, partition.start - 4)
            source.seek(start)
            lead = start == 0

            def chunks():
                while data := source.read(self.CHUNK):
                    yield data

            for offset, message in cut_messages(chunks(), start, partition.stop, lead):
                if offset >= partition.start:
                    yield partition.path, offset, message


class MboxSource(DataSource):
    """Messages of mailbox files: spark.read.format("mbox").load(uri).

    Files are read in byte ranges; a message belongs to the range that its envelope is in.
    """

    @classmethod
    def name(cls):
        return "mbox"

    def schema(self):
        return "source string, seq long, raw binary"

    def reader(self, schema):
        return MboxReader(self.options)


def read_mbox(spark: SparkSession, uri: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(source, seq, raw): every message below ``uri``; seq is its place in the file."""
    spark.dataSource.register(MboxSource)
    return spark.read.format("mbox").option("splitBytes", str(split_bytes)).load(uri)


SKIPPED_MAILBOXES = (
    r"(?iu)^(?:bo.te d.envoi|brouillons?|conversation history|corbeille|courrier ind|deleted|drafts?|historique des conversations|import|journal|junk|notes"
    r"|outbox|probl.mes de synchronisation|recovered messages|sendlater|spam|sync issues|t.ches|tasks|todo|trash|.l.ments supprim)"
)


def emlx_files(spark: SparkSession, root: str) -> DataFrame:
    """(source, mailbox, seq) of a tree of single-message files, skipped mailboxes out. Names
    only: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.emlx").load(root).select("path")
    kept = files.where(~F.endswith("path", F.lit(".partial.emlx"))).withColumn("mailbox", _composed(mailbox_name(F.col("path"))))
    kept = kept.where(~F.regexp_like("mailbox", F.lit(SKIPPED_MAILBOXES)))
    number = F.coalesce(F.try_to_number(F.regexp_extract("path", r"([0-9]{1,12})[^/0-9]*\z", 1), F.lit("999999999999")).cast("long"), F.lit(0))
    return kept.select(F.col("path").alias("source"), "mailbox", number.alias("seq"))


def _composed(name: Column) -> Column:
    """Letters with their accents as one character; file systems may hand them over apart."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFC")

    return run(name)


def open_file(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def message_bytes(data: bytes) -> bytes:
    """The message in the bytes of a message file, or in the first of them: as many as its
    first line says, else all that follow."""
    first, _, rest = data.partition(b"\n")
    return rest[: int(first)] if re.fullmatch(rb"\s*[0-9]{1,9}\s*", first) else rest


def read_emlx(spark: SparkSession, root: str) -> DataFrame:
    """(source, mailbox, seq, raw) of a tree of single-message files, read whole."""
    names = emlx_files(spark, root)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.emlx").load(root).select(F.col("path").alias("source"), "content")
    raw = F.encode(emlx_message(F.col("content")), "ISO-8859-1")
    return names.join(content, "source").select("source", "mailbox", "seq", raw.alias("raw"))


def _hidden(path: Column) -> Column:
    """Whether a file or a folder above it is hidden."""
    return F.regexp_like(path, F.lit(r"/\.[^/]"))


def read_letters(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".md", ".tex", ".txt")) -> DataFrame:
    """(path, extension, content) of the letters of a folder, hidden files and folders out.
    Paths are relative to the folder and pruned before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(re.sub(r"^file:/*", "file:/", folder).rstrip("/") + "/")
    inside = F.when(F.startswith("path", root), F.substring("path", F.length(root) + 1, F.length("path"))).otherwise(F.col("path"))
    named = files.withColumn("inside", inside).where(~_hidden(F.concat(F.lit("/"), "inside"))).withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)\z", 1)))
    return named.where(F.col("extension").isin(*extensions)).select(F.col("inside").alias("path"), "extension", "content")


_SAMPLE = "id string, mailbox string, adapter string, source string, date string, recipient_domain string, surface string, register string, words int, text string, salutation string, signoff string, signature string"
_DOCUMENT = "tool string, lang string, adapter string, tag string, source string, collected string"


def _read_json(spark: SparkSession, path) -> DataFrame:
    """One row per document; a bare array of samples gives a row for each of them. ``document``
    numbers the rows in the order in which they are read."""
    mine = ", ".join(f for f in _SAMPLE.split(", ") if f.split()[0] not in ("adapter", "source"))
    found = spark.read.option("multiLine", "true").schema(f"{_DOCUMENT}, samples array<struct<{_SAMPLE}>>, {mine}").json(path)
    return found.withColumn("document", F.monotonically_increasing_id())


def read_documents(spark: SparkSession, path) -> DataFrame:
    """(document, source, lang, adapter, tag) of collected documents, empty ones too; bare
    samples are one document without a name (-1)."""
    found = _read_json(spark, path)
    named = found.where("samples is not null").select("document", "source", "lang", "adapter", "tag")
    none = F.lit(None).cast("string")
    bare = found.where("samples is null and length(trim(text)) > 0").limit(1).select(F.lit(-1).cast("long").alias("document"), none.alias("source"), none.alias("lang"), none.alias("adapter"), none.alias("tag"))
    return named.unionByName(bare)


def read_samples(spark: SparkSession, path) -> DataFrame:
    """Samples of collected documents (JSON) and of bare arrays of samples: one row each, blank
    texts out; a sample takes mailbox and adapter from its document where it has none.
    ``sample_seq`` orders the samples of all documents."""
    found = _read_json(spark, path)
    inner = found.where("samples is not null").select("document", "lang", F.col("tag"), F.col("adapter").alias("a"), F.posexplode("samples").alias("k", "s"))
    listed = inner.select("document", F.col("k").cast("long").alias("k"), "lang", "tag", "a", "s.*")
    alone = found.where("samples is null").select(F.lit(-1).cast("long").alias("document"), F.col("document").alias("k"), "lang", "tag", F.col("adapter").alias("a"), *[f.split()[0] for f in _SAMPLE.split(", ")])
    flat = listed.unionByName(alone).where(F.length(F.trim("text")) > 0)
    return flat.withColumns({"mailbox": F.coalesce("mailbox", "tag"), "adapter": F.coalesce("adapter", "a"), "sample_seq": F.concat_ws(":", F.lpad((F.col("document") + 1).cast("string"), 19, "0"), F.lpad(F.col("k").cast("string"), 19, "0"))}).drop("a", "tag", "k")


SKIPPED_FOLDERS = (".cache", ".git", ".next", ".pnpm-store", ".turbo", ".venv", ".yarn", "__pycache__", "build", "coverage", "dist", "node_modules", "vendor")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the text files of a tree; a NUL byte makes a file binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED_FOLDERS)) | F.contains("path", F.lit("/.claude/worktrees/"))
    return files.where(~inside & ~has_nul(F.col("content"))).select("path", F.decode("content", "UTF-8").alias("text"))


def has_nul(content: Column) -> Column:
    return F.contains(F.decode(content, "ISO-8859-1"), F.lit("\0"))
