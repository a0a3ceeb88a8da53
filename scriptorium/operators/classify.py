"""Surface, register, register tables, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import salutation_of
from ..functions.regex import B, S, led, matches, quick
from ..functions.text import word_count
from .tables import written

ZONES = ("admin.ch", "europa.eu", "gc.ca", "go.jp", "gob.es", "gouv.fr", "gov", "gov.uk", "govt.nz")
LABELS = ("ameli", "caf", "gouv", "gov", "greffe", "impots", "justice", "mairie", "prefecture", "service-public", "tribunal", "urssaf", "ville")


def public_body(domain: Column) -> Column:
    name = F.lower(domain)
    zone = F.lit(False)
    for z in ZONES:
        zone = zone | (name == z) | F.endswith(name, F.lit("." + z))
    labels = F.arrays_overlap(F.split(name, r"\."), F.array(*map(F.lit, LABELS)))
    return F.coalesce((F.length(name) > 0) & (zone | labels), F.lit(False))


def guess_surface(adapter: Column, extension: Column, n: Column) -> Column:
    letter = extension.isin(".pdf", ".tex") | (adapter == "folder")
    return F.when(n < 25, "message").when(F.coalesce(letter, F.lit(False)), "letter").otherwise("email")


OFFICIAL_OPENING = rf"(?imu)^{S}*(?:dear sir or madam|madame la |madame,?{S}*monsieur|messieurs|monsieur le |to whom it may concern)"
OFFICIAL_CLOSING = r"(?iu)je vous prie d['’]agréer|salutations distinguées|sentiments (?:distingués|respectueux)|veuillez agréer|yours (?:sincerely|faithfully)"
CASE_NUMBER = rf"(?iu){B}(?:case|dossier|file|reference|référence){B}{S}*(?:n[°o]?{S}*)?[:.]?{S}*(?:\[reference\]|[A-Za-z]*[0-9][A-Za-z0-9./-]{{2,}})"
FAMILIAR = rf"(?iu){B}(?:ta|tes|tiens|toi|ton|tu|t['’](?:ai|embrasse|en)){B}"
FORMAL = rf"(?iu){B}(?:vos|votre|vous){B}"


def guess_register(domain: Column, text: Column) -> Column:
    marks = sum((F.regexp_like(text, F.lit(quick(p))).cast("int") for p in (OFFICIAL_OPENING, led(OFFICIAL_CLOSING, "[jsvy]"), led(CASE_NUMBER, "[cdfr]"))), F.lit(0))
    return F.when(public_body(domain) | (marks >= 2), "administrative").when(matches(text, led(FAMILIAR, "t")) > matches(text, led(FORMAL, "v")), "personal").otherwise("professional")


def make_samples(df: DataFrame, tag: str) -> DataFrame:
    """Samples from entries (adapter, source, date, recipient_domain, extension, body,
    signoff, signature and ``seq``): text, words, surface, register, greeting, id.

    Ids are a running number over the order of reading: by source, and in it by ``seq``.
    """
    text = F.concat_ws("\n\n", F.nullif("body", F.lit("")), F.nullif("signoff", F.lit("")))
    made = df.withColumn("text", text).withColumn("words", word_count(F.col("text")).cast("int"))
    made = made.withColumn("surface", guess_surface(F.col("adapter"), F.col("extension"), F.col("words")))
    made = made.withColumn("register", guess_register(F.col("recipient_domain"), F.col("text"))).withColumn("salutation", salutation_of(F.col("body")))
    numbered = running_number(made, ["source", "seq"], "number")
    digits = F.col("number").cast("string")
    name = F.concat(F.lit(tag + "-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    return numbered.withColumn("id", name).withColumn("mailbox", F.lit(tag)).drop("number", "extension", "body")


def running_number(df: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """``df`` with the row's 1-based place by ``order`` (ties share no place).

    Rows are range-partitioned and sorted, and written with their place in the partition;
    the sizes of the partitions, a row for each, are then summed.
    """
    keys = [order] if isinstance(order, str) else order
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_low") + 1).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")


def rule_condition(pattern: str, sample_id: Column, domain: Column) -> Column:
    """Whether a rule matches: an id, a domain, or a domain and all below it (``*.x``)."""
    if "." not in pattern and "*" not in pattern:
        return F.coalesce(sample_id == pattern, F.lit(False))
    value, wanted = F.lower(F.coalesce(domain, F.lit(""))), pattern.lower()
    if wanted.startswith("*."):
        return (value != "") & ((value == wanted[2:]) | F.endswith(value, F.lit(wanted[1:])))
    return (value != "") & (value == wanted)


def assign_registers(df: DataFrame, table: dict[str, str], sample_id: str = "id", domain: str = "recipient_domain") -> DataFrame:
    """``df`` with the number of the first rule that matches (``rule``) and its register."""
    rule, register = F.lit(None).cast("int"), F.col("register") if "register" in df.columns else F.lit(None).cast("string")
    for k, (pattern, name) in reversed(list(enumerate(table.items(), 1))):
        holds = rule_condition(pattern, F.col(sample_id), F.col(domain))
        rule, register = F.when(holds, k).otherwise(rule), F.when(holds, F.lit(name)).otherwise(register)
    return df.withColumn("rule", rule).withColumn("register", register)


def register_report(assigned: DataFrame, table: dict[str, str]) -> DataFrame:
    """(seq, pattern, kind, register, samples) for each rule, those without a sample too."""
    spark = assigned.sparkSession
    rows = [(k, p, "domain" if "." in p or "*" in p else "id", r) for k, (p, r) in enumerate(table.items(), 1)]
    rules = spark.createDataFrame(rows, "seq int, pattern string, kind string, register string")
    counts = assigned.where("rule is not null").groupBy(F.col("rule").alias("seq")).agg(F.count("*").alias("n"))
    return rules.join(counts, "seq", "left").select("seq", "pattern", "kind", "register", F.coalesce("n", F.lit(0)).cast("long").alias("samples"))
