"""Set operations over keys, arrays and layered maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_sets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key once, as created, deleted or common."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.subtract(a).withColumn("side", F.lit("created")).union(a.subtract(b).withColumn("side", F.lit("deleted"))).union(a.intersect(b).withColumn("side", F.lit("common")))


def evidence(found: Column, gold: Column) -> Column:
    """covered, missing and unsupported items, sorted."""
    return F.struct(F.array_sort(F.array_intersect(found, gold)).alias("covered"), F.array_sort(F.array_except(gold, found)).alias("missing"),
                    F.array_sort(F.array_except(found, gold)).alias("unsupported"))


def tombstones(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return previous.join(current.select(key), key, "left_anti")


def new_events(previous: DataFrame, current: DataFrame, keys: list[str], key_id: str) -> DataFrame:
    """Rows of ``current`` whose identity, the id or else the other keys, is not in ``previous``."""
    name = F.coalesce(F.col(key_id).cast("string"), F.concat_ws("|", *keys))
    return current.withColumn("identity", name).join(previous.select(name.alias("identity")).distinct(), "identity", "left_anti")


def first_wins(frames: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Union by name; of rows with one key the first in order stays."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("r = 1").drop("r")


def overlay(base: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """(path, content) of ``base`` under the last unexpired change of each path: an exemption removes it, others set it."""
    live = changes.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    last = live.groupBy("path").agg(F.max_by(F.struct("kind", "content"), "seq").alias("c"))
    return base.select("path", F.col("content").alias("old")).join(last, "path", "full_outer").where(
        F.coalesce(F.col("c.kind") != "exemption", F.lit(True))).select("path", F.when(F.col("c").isNotNull(), F.col("c.content")).otherwise(F.col("old")).alias("content"))


def layered(profile: Column, override: Column) -> Column:
    """Keys of both maps: the override's value where it has one, and which layer gave it."""
    return F.map_zip_with(profile, override, lambda k, a, b: F.struct(F.coalesce(b, a).alias("value"), F.when(b.isNotNull(), "project").otherwise("global").alias("layer")))
