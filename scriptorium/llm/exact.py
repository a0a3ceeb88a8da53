"""Exact dedup by deterministic block naming.

Texts are equal when they are identical after each run of white space became one space.
A text is cut into blocks of a fixed size, the blocks are sorted into integer names, and
adjacent names are named in pairs until the text has a single name. Two texts share a name
only if every block of them is equal; no hash says that two texts are equal.

Scale: texts are named bucket by bucket. A bucket, about ``BUCKET`` bytes of text, is chosen
by a hash of the text, which only sees to it that equal texts meet; within a bucket all
texts are named, and the identity of a text is its bucket and its name. A task holds one
text of each name of the bucket it is at, and names the rest in pieces beside them, so a
bucket may hold any number of copies. A sample of ``SAMPLE`` rows shows the texts that make
up more than one in ``HOT`` of all rows; these are split by salt, one row of each name and
salt is named again across the salts, and only the names come back. Which rows are in the
sample changes where work is done and never a result.

Defined cases: null text counts as empty; empty texts are equal to one another; a null
doc_id orders after every other; rows that repeat a doc_id are rows of their own, and of
equal rows one stays; an empty table gives an empty result; further columns are carried
whatever their names (columns are numbered inside).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of a block; eight, so that a block is one machine word.
BLOCK = 8
#: Bytes of text in a bucket, about; and in the pieces that are named together.
BUCKET = PIECE = 8 << 20
#: Texts above one in so many rows are split by salt, as far as a sample of so many rows tells.
HOT, SAMPLE = 1000, 100_000
#: Copies in the sample that a text has at least before it is split.
HOT_LEAST = 20


def block_names(texts: list[bytes]) -> np.ndarray:
    """One integer per text; equal exactly for equal texts.

    The first block of a text is its length, so that padding cannot make unequal texts
    equal. All texts are named level by level together; those with fewer blocks are done
    earlier, and the level belongs to the name.
    """
    parts = [x for t in texts for x in (len(t).to_bytes(BLOCK, "little"), t, bytes(-len(t) % BLOCK))]
    counts = np.array([1 - -len(t) // BLOCK for t in texts], np.int64)
    names = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_inverse=True)[1].astype(np.int64) + 1
    result, rows, level = np.zeros(len(texts), np.int64), np.arange(len(texts)), 0
    while len(rows):
        ends = np.cumsum(counts)
        done = counts == 1
        result[rows[done]] = level << 40 | names[ends[done] - 1]
        left = np.repeat(~done, counts)
        names, counts, rows = names[left], counts[~done], rows[~done]
        if not len(rows):
            break
        ends = np.cumsum(counts)
        within = np.arange(len(names)) - np.repeat(ends - counts, counts)
        first = np.flatnonzero(within % 2 == 0)
        alone = np.zeros(len(names), bool)
        alone[ends[counts % 2 == 1] - 1] = True  # the last of an odd number is paired with nothing: 0
        second = np.where(alone[first], 0, names[np.minimum(first + 1, len(names) - 1)])
        pairs = names[first] * (names.max() + 1) + second
        names = np.unique(pairs, return_inverse=True)[1].astype(np.int64) + 1
        counts = (counts + 1) // 2
        level += 1
    return result


def _name_stream(batches, key: list[str], text: str, finish):
    """Rows sorted by ``key`` and order of preference get their class within the key.

    ``finish(batch, class numbers, whether the row leads its class)`` makes the result. One
    text of each class of the current key is held, and pieces are named beside them.
    """
    held_key, held = None, []
    for whole in batches:
        for batch in common.pieces(whole, text, PIECE):
            n = batch.num_rows
            keys = np.stack([np.asarray(batch.column(k)) for k in key], 1)
            texts = [t.encode() for t in batch.column(text).to_pylist()]
            local, lead = np.zeros(n, np.int32), np.zeros(n, bool)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(keys[a].tolist())
                if now != held_key:
                    held_key, held = now, []
                names = block_names(held + texts[a:b]).tolist()
                known = {name: c for c, name in enumerate(names[: len(held)])}
                for r, name in enumerate(names[len(held) :], a):
                    if name not in known:
                        known[name] = len(held)
                        held.append(texts[r])
                        lead[r] = True
                    local[r] = known[name]
            yield finish(batch, local, lead)
    common.relax()


def _hot(texts: DataFrame, rows: int, n: int) -> DataFrame:
    """(h, parts): hashes of the texts that a sample shows to be hot, fewer than 2 * HOT."""
    some = texts.sample(min(1.0, SAMPLE / max(1, rows)), 7).select(_text_hash(F.col("norm")).alias("h"))
    counts = some.groupBy("h").agg(F.count("*").alias("c"))
    least = max(HOT_LEAST, min(rows, SAMPLE) // HOT)
    found = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(2 * HOT).collect()
    parts = [(r["h"], 1 + int(2 * n * r["c"] / max(1, min(rows, SAMPLE)))) for r in found]
    return texts.sparkSession.createDataFrame(parts, "h long, parts int")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _prepared(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text, ...) with norm, its bucket and salt, moved there and sorted.

    Texts that are split have as many ``parts`` as they need; a salt is a row's id and
    where it was read, so it splits rows that repeat an id too.
    """
    spark = df.sparkSession
    n = common.shuffle_partitions(spark)
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(1, n, -(-(size or 0) // BUCKET))
    norm = df.withColumn("norm", common.normalised(F.col("text")))
    hot = _hot(norm.select("norm"), rows, n)
    named = norm.withColumn("h", _text_hash(F.col("norm"))).join(F.broadcast(hot), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salted = named.withColumn("bucket", F.pmod("h", F.lit(buckets))).withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("parts")).cast("int")).otherwise(0))
    # Buckets are dealt out one after the other, which is more even than their hashes would be.
    dealt = salted.drop("h").repartitionById(n, F.pmod(F.col("bucket") + F.col("salt") * 7919, F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("bucket", "salt", F.col("doc_id").asc_nulls_last())


def _across(leaders: DataFrame) -> DataFrame:
    """Leaders (bucket, salt, local, doc_id, norm) of salted texts, named again without the salt.

    Returns bucket, salt, local with ``class`` and whether the leader leads that.
    """
    ordered = leaders.select("bucket", "salt", "local", "doc_id", "norm").repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "salt")

    def finish(batch, local, lead):
        return pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("salt"), batch.column("local"), pa.array(local), pa.array(lead)], ["bucket", "salt", "local", "class", "first"])

    return ordered.mapInArrow(lambda it: _name_stream(it, ["bucket"], "norm", finish), "bucket long, salt int, local int, class int, first boolean")


def exact_classes(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): its class of equal texts and who stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    ready = _prepared(df.select("doc_id", "text")).select("doc_id", "norm", "bucket", "salt", "parts", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    out = T.StructType([ready.schema["doc_id"], *T._parse_datatype_string("bucket long, salt int, parts int, sha string, local int, lead boolean, norm string").fields])
    arrow = common.arrow_schema(out)

    def finish(batch, local, lead):
        again = lead & (np.asarray(batch.column("parts")) > 1)  # only these are named again, and need their text
        texts = pa.array([batch.column("norm")[k].as_py() if x else None for k, x in enumerate(again.tolist())], pa.string())
        return common.carried(batch, arrow, {"local": pa.array(local), "lead": pa.array(lead), "norm": texts})

    named = common.written(ready.mapInArrow(lambda it: _name_stream(it, ["bucket", "salt"], "norm", finish), out), "exact")
    part = ["bucket", "salt", "local"]
    sizes = named.groupBy(*part).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = _across(named.where("lead and parts > 1"))
    # Names of hot texts only: fewer than 2 * HOT texts, and with the salts 4 * HOT + 2 * partitions.
    hot = sizes.join(F.broadcast(again), part)
    total = hot.groupBy("bucket", "class").agg(F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
    total = again.select(*part, "class", "first").join(total, ["bucket", "class"]).drop("class")
    merged = sizes.join(F.broadcast(total), part, "left").select(*part, F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"), F.coalesce("first", F.lit(True)).alias("first"))
    return named.drop("norm").join(merged, part).select("doc_id", "keep_id", "group_size", (F.col("lead") & F.col("first")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (all its columns) that stay: one of each class of equal texts."""
    inner = common.numbered(df, "doc_id", "text")
    ready = _prepared(inner)
    out = T.StructType([*ready.schema.fields, *T._parse_datatype_string("local int").fields])
    arrow = common.arrow_schema(out)

    def finish(batch, local, lead):
        return common.carried(batch, arrow, {"local": pa.array(local)}).filter(pa.array(lead))

    leads = ready.mapInArrow(lambda it: _name_stream(it, ["bucket", "salt"], "norm", finish), out)
    leads = common.written(leads.withColumn("norm", F.when(F.col("parts") > 1, F.col("norm"))), "exact-leads")
    again = _across(leads.where("parts > 1")).where("not first").select("bucket", "salt", "local")
    left = leads.join(F.broadcast(again), ["bucket", "salt", "local"], "left_anti")
    return left.select(*inner.columns).toDF(*df.columns)


def query(spark, sf_dir):
    return exact_classes(common.documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
