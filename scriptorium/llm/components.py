"""Connected components of links, without bringing links or labels to the driver.

Alternating stars: every node points its larger neighbours at its smallest neighbour, then
its smaller ones; both steps keep the components and flatten them, until each is a star.
All steps are aggregations with partial sums and joins by node, so a node with very many
links is split like any other skewed key. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the smallest of its component.

    Null ends, loops, repeated and reversed links are harmless. An empty table gives none.
    """
    ordered = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.written(ordered, "links")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = common.written(after, "links")
        # A star: every node points at one other, and what it points at points nowhere.
        roots = after.select(F.col("v").alias("u")).distinct()
        moving = after.join(roots, "u", "left_semi").limit(1).count() or after.groupBy("u").count().where("count > 1").limit(1).count()
        common.forget(edges)
        edges = after
        if not moving:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
