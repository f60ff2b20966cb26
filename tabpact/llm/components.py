"""Connected components of an edge table, labelled by the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import new_folder, remove, stage_at


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of distinct edges (but for a collision of 64-bit sums)."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of an edge ``(a, b)`` of two longs.

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are hung to
    its smallest neighbour, until only stars are left. The number of rounds grows with the logarithm of
    the nodes. Groups are only reduced to a minimum, never gathered, so a hub is no burden; each round
    is a written table. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark, "component-edges")
        return stage_at(df, path)[0], path

    now, path = write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (after := _signature(now)) != before:
        before = after
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.where("a > b")
        lowest = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        later, new_path = write(small.where("a <> b").distinct())
        remove(spark, path)
        now, path = later, new_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
