"""Connected components of a graph of document pairs, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import spool, unspool


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b): root is the smallest node that it is linked to, directly or not.

    Large-star and small-star rounds by turns until the edges stay the same;
    each round is a grouping on one node with a map-side minimum, and its
    result is written to the shared folder.
    """
    now = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    last = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b")
        made = spool(small.distinct(), "edges")
        mark = made.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        unspool(now)
        now = made
        if last == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
