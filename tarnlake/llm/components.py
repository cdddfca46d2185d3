"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_stage, release, stage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Tie the neighbours of each node to the least of them (and itself); ``both``: the greater ones only, else the lesser."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        pairs = pairs.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if both:
        made = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return made.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long): the root is the least node of its component.

    Each round is written to the shared folder; only a count and a checksum reach the driver. The hub of a star is the
    key of one row of minima, and pre-aggregated, so no group is ever held as a list.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:  # the number of rounds grows with the logarithm of the nodes
        after = stage(_star(_star(now, True), False), name)
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_stage(now)
        release(spark)
        now = after
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
