"""Connected components over equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with a link, component being the smallest node reachable.

    ``edges`` has longs u and v, neither null. Alternating large-star and small-star rounds; each is a partial aggregate and an
    equi-join on the node, so a hub is split by adaptive execution. Rounds end when the links no longer change.
    """
    def swept(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")).alias("h")).first()
        return row["n"], row["h"]

    now = scratch.keep(swept(edges.select("u", "v")))
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = scratch.keep(swept(both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(swept(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))))
        scratch.drop(now, large)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
