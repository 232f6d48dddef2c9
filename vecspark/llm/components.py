"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import drop_table, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Large: each node's greater neighbours move to its least one. Small: its lesser ones and itself do."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u bigint, v bigint): root is the least node that can be reached, itself included.

    The edge table is written to the shared folder after each round; the driver sees only its count and checksum.
    """
    spark = edges.sparkSession
    now = table(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = table(spark, _star(_star(now, True), False), "edges")
        seen = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        drop_table(spark, now)
        now = new
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
