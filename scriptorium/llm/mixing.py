"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, the source's target
over its size. Documents stand in a fixed order within their source; the prefix sum of
expected copies plus one random offset of the source crosses some integers at each
document, and the document is taken once for each. The order is by size, so what a
crossing takes differs little from what it might have taken, and the words taken come
within about one document of the target.

Scale: only sizes are shuffled, never texts. A source is cut into cells: by two leading
digits of the size, and where these hold more than ``CELL_ROWS`` rows, by a hash into cells
of about so many. Cells are counted, the counts are summed along the source, and rows are
ranked inside their cell only; a source or one size of it that holds a third of all rows is
thereby many cells. A source has one cell for each ``CELL_ROWS`` rows and a few hundred
more, which is what the sums along it sort; the list of cut sizes that is broadcast has at
most one row for each ``CELL_ROWS`` rows of the table. Targets are one sort of the sources.

Defined cases: null text has size 0; a null source is a source of its own, last; empty
sources get target 0; repeated rows and ids are rows of their own (their order does not
matter, they are the same size); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and targets as a multiple of a source's size.
MOST = 3
#: Rows of a cell, about, where one size of one source has more.
CELL_ROWS = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _u32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n_rows, source_size) with target added: water filling under caps.

    A source is full at ``most`` times its size; the rest share by weight. Ordered by cap
    per weight, the sources that are full come first, so one pass of running sums finds
    the level. There is one row per source here, not per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_sc_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by = W.orderBy((F.col("source_size").cast("double") / F.col("_sc_w")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    level = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("_sc_all"),
        F.coalesce(F.sum(F.col("source_size") * most).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_sc_full"),
        F.sum("_sc_w").over(by.rowsBetween(0, W.unboundedFollowing)).alias("_sc_rest"),
    )
    share = (F.col("_sc_all") - F.col("_sc_full")).cast("double") / F.col("_sc_rest").cast("double")
    level = level.withColumn("_sc_share", share).withColumn("_sc_open", F.col("_sc_share") * F.col("_sc_w") <= F.col("source_size") * most)
    level = level.withColumn("_sc_level", F.min(F.when(F.col("_sc_open"), F.struct(by_rank(by).alias("r"), F.col("_sc_share").alias("s")))).over(everything)["s"])
    target = F.least(F.col("_sc_level") * F.col("_sc_w"), (F.col("source_size") * most).cast("double"))
    return level.select("source", "n_rows", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def by_rank(by) -> Column:
    return F.row_number().over(by)


def mix(df: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``df`` (text, source, doc_id) with size, source_size, target and copies for each row."""
    slim = df.select("doc_id", "source", words(F.col("text")).alias("size"))
    return _mixed(slim, df.count(), weights, most, seed)


def _mixed(slim: DataFrame, n: int, weights, most: int, seed: str) -> DataFrame:
    digits = F.col("size").cast("string")
    cells = slim.select("*", (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).alias("_sc_bin"))
    cells = common.written(cells, "mix-cells")
    bucket = F.lit(0)
    if n > CELL_ROWS:
        large = cells.groupBy("source", "_sc_bin").agg(F.ceil(F.count("*") / CELL_ROWS).alias("parts")).where("parts > 1").alias("l")
        cells = cells.alias("c").join(F.broadcast(large), F.col("c.source").eqNullSafe(F.col("l.source")) & (F.col("c._sc_bin") == F.col("l._sc_bin")), "left").select("c.*", F.coalesce("l.parts", F.lit(1)).alias("_sc_parts"))
        bucket = F.pmod(_u32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("_sc_parts")).cast("int")
    cells = cells.withColumn("_sc_bucket", bucket)
    cell = ["_sc_bin", "_sc_bucket"]
    counts = cells.groupBy("source", *cell).agg(F.count("*").alias("_sc_n"), F.sum("size").alias("_sc_size"))
    before = W.partitionBy("source").orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_sc_before", F.coalesce(F.sum("_sc_n").over(before), F.lit(0)))
    sources = targets(counts.groupBy("source").agg(F.sum("_sc_n").alias("n_rows"), F.sum("_sc_size").alias("source_size")), weights, most)
    starts = starts.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", *cell, "_sc_before", "source_size", "target")
    inside = W.partitionBy("source", *cell).orderBy("size", F.col("doc_id").asc_nulls_last())
    ranked = cells.withColumn("_sc_rank", F.row_number().over(inside)).alias("c")
    joined = ranked.join(
        starts.alias("s"),
        F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c._sc_bin") == F.col("s._sc_bin")) & (F.col("c._sc_bucket") == F.col("s._sc_bucket")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _u32(F.concat(F.lit(seed + ":"), F.coalesce(F.col("c.source"), F.lit("")))).cast("double") / F.lit(4294967296.0)
    place = F.col("_sc_before") + F.col("_sc_rank")
    copies = F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset)
    return joined.select("c.doc_id", "c.source", "c.size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mixed_rows(df: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of ``df`` (all its columns), each as often as the mix takes it.

    Rows alike in doc_id, source and size share what they are taken together.
    """
    same = ["doc_id", "source", "_sc_words"]
    inner = common.numbered(df, "doc_id", "text", "source")
    taken = mix(inner, weights, most, seed).withColumnRenamed("size", "_sc_words").groupBy(*same).agg(F.sum("copies").alias("_sc_copies"), F.count("*").alias("_sc_alike"))
    rows = inner.withColumn("_sc_words", words(F.col("text"))).alias("d")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in same]
    joined = rows.join(taken.where("_sc_copies > 0").alias("t"), on[0] & on[1] & on[2]).select("d.*", "_sc_copies", "_sc_alike")
    k = F.row_number().over(W.partitionBy(*same).orderBy("doc_id"))
    numbered = joined.withColumn("_sc_k", k)
    share = F.floor(F.col("_sc_copies") * F.col("_sc_k") / F.col("_sc_alike")) - F.floor(F.col("_sc_copies") * (F.col("_sc_k") - 1) / F.col("_sc_alike"))
    often = numbered.withColumn("_sc_often", share.cast("int")).where("_sc_often > 0")
    return often.withColumn("_sc_copy", F.explode(F.sequence(F.lit(1), F.col("_sc_often")))).select(*inner.columns).toDF(*df.columns)


def query(spark, sf_dir):
    mixed = mix(common.documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle(seed: str = "mix") -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0
), s2 AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(source_size * 3) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
    sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
    row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS r
  FROM s1
), s3 AS (SELECT *, (total - full_before)::DOUBLE / rest::DOUBLE AS share FROM s2),
lv AS (SELECT arg_min(share, r) AS level FROM s3 WHERE share * w <= source_size * 3),
s AS (SELECT source, source_size, coalesce(least(level * w, (source_size * 3)::DOUBLE), 0.0) AS target FROM s3, lv),
b AS (SELECT *, length(size::VARCHAR) * 100 + left(size::VARCHAR, 2)::INT AS bin FROM d),
c AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
    % ceil(count(*) OVER (PARTITION BY source, bin) / {CELL_ROWS}.0)::BIGINT AS bucket FROM b
), k AS (
  SELECT c.doc_id, c.source, c.size, row_number() OVER (PARTITION BY c.source ORDER BY bin, bucket, size, doc_id NULLS LAST) AS place FROM c
), t AS (
  SELECT k.doc_id, k.size, s.source_size, s.target, k.place,
    CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{seed}:' || coalesce(k.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
  (size * least(floor(rate * place + u) - floor(rate * (place - 1) + u), 3))::BIGINT AS taken
FROM t
"""


ORACLE = oracle()
