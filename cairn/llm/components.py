"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialise

MOST_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether (u, v) are stars: each u has one v, and no v is a u."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return twice.union(chained).isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of the pairs (a, b) of longs; component is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour, then every
    node and its smaller neighbours likewise, and is written to the shared folder, where the round
    before it is deleted. The rounds end when only stars are left; their number grows with the
    logarithm of the graph, and a graph that MOST_ROUNDS don't settle raises.
    """
    spark = edges.sparkSession
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, materialise(small.select("e.*").where("u <> v").distinct(), label)
        drop(spark, before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
