"""Sync batches that are stored once, however often and in whatever epochs they are delivered.

A batch is named by a digest of its project and content, so the same content is the same batch. An epoch is written to a folder of its own and counts
once the ledger has a file with its number: an epoch that is delivered again is either in the ledger, and adds nothing, or is written
anew in place of what a lost attempt left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .generations import _fs

#: Fixed limits of a batch.
MOST_ITEMS, MOST_BYTES = 500, 8 << 20
STORED = "project string, batch_id string, items int, bytes long, payload string"


def relative_path(path: Column) -> Column:
    """With forward slashes; null where it isn't a relative path that stays below its root."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.exists(F.split(plain, "/"), lambda p: p.isin("", ".", "..") | F.endswith(p, F.lit(" ")) | F.endswith(p, F.lit(".")))
    return F.when(~(F.contains(path, F.lit(":")) | path.rlike("[\\x00-\\x1f]") | bad), plain)


def batches(items: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each batch of ``items`` (project, batch, path, content, sha256, bytes, tombstone): project, batch, items, bytes, payload, batch_id, reason.

    The payload is the JSON text of the batch's snapshots and tombstones by path. ``reason`` says why a batch can't be taken,
    the first that holds: too many items, a path that isn't relative, paths that are there twice, content that is missing or not as long as it says
    or not what its digest says, a payload of too many bytes. Else it is null and batch_id names the batch.
    """
    at = items.withColumn("clean", relative_path(F.col("path")))
    text = F.col("content").cast("binary")
    right = F.col("tombstone") | (F.col("content").isNotNull() & (F.octet_length("content") == F.col("bytes")))
    told = F.col("tombstone") | (F.lower("sha256") == F.sha2(text, 256))
    one = F.struct(F.col("bytes"), F.col("content"), F.col("clean").alias("path"), F.lower("sha256").alias("sha256"))
    by_path = lambda x: F.array_sort(F.collect_list(x), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    counted = at.groupBy("project", "batch").agg(F.count(F.lit(1)).alias("items"), F.bool_and(F.col("clean").isNotNull()).alias("relative"), F.countDistinct("clean").alias("paths"),
                                                 F.bool_and(F.coalesce(right, F.lit(False))).alias("right"), F.bool_and(F.coalesce(told, F.lit(False))).alias("told"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("size"))
    # only batches within the limits are put together, so no group is larger than a batch may be
    small = counted.where((F.col("items") <= most_items) & (F.col("size") <= most_bytes)).select("project", "batch")
    same = F.col("project").eqNullSafe(F.col("p")) & F.col("batch").eqNullSafe(F.col("b"))
    whole = at.join(small.select(F.col("project").alias("p"), F.col("batch").alias("b")), same, "left_semi").groupBy("project", "batch").agg(
        by_path(F.when(~F.col("tombstone"), one)).alias("snapshots"), F.array_sort(F.collect_list(F.when(F.col("tombstone"), F.col("clean")))).alias("tombstones"))
    payload = whole.select(F.col("project").alias("p"), F.col("batch").alias("b"), F.to_json(F.struct("snapshots", "tombstones")).alias("payload"))
    every = counted.join(payload, same, "left").withColumn("bytes", F.coalesce(F.octet_length("payload").cast("long"), F.col("size")))
    reason = (F.when(F.col("items") > most_items, "too many items").when(~F.col("relative"), "path is not relative").when(F.col("paths") < F.col("items"), "conflicting path")
              .when(~F.col("right"), "content is not as long as it says").when(~F.col("told"), "content does not match its digest").when(F.col("bytes") > most_bytes, "too many bytes"))
    named = F.sha2(F.concat(F.coalesce("project", F.lit("")), F.lit("\n"), "payload").cast("binary"), 256)
    return every.withColumn("reason", reason).select("project", "batch", F.col("items").cast("int").alias("items"), "bytes", F.when(F.col("reason").isNull(), F.col("payload")).alias("payload"),
                                                     F.when(F.col("reason").isNull(), named).alias("batch_id"), "reason")


class Store:
    """The stored batches below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def epochs(self) -> list[int]:
        """Numbers in the ledger."""
        fs, p, _ = _fs(self.spark, f"{self.root}/ledger")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def read(self) -> DataFrame:
        """The batches of all epochs in the ledger, with their ``epoch``."""
        done = [f"{self.root}/batches/epoch={e}" for e in self.epochs()]
        if not done:
            return self.spark.createDataFrame([], f"{STORED}, epoch int")
        return self.spark.read.schema(f"{STORED}, epoch int").option("basePath", f"{self.root}/batches").parquet(*done)

    def insert(self, accepted: DataFrame, epoch: int) -> None:
        """Store those of ``accepted`` (batches() without a reason) that no epoch has; an epoch in the ledger adds nothing. Writers of one store take turns, as the epochs of a stream do."""
        if epoch in self.epochs():
            return
        stored = self.read().select(F.col("project").alias("p"), F.col("batch_id").alias("i"))
        new = accepted.where("reason IS NULL").dropDuplicates(["project", "batch_id"]).select("project", "batch_id", "items", "bytes", "payload")
        fresh = new.join(stored, F.col("project").eqNullSafe(F.col("p")) & (F.col("batch_id") == F.col("i")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.root}/batches/epoch={epoch}")
        fs, p, _ = _fs(self.spark, f"{self.root}/ledger/{epoch}")
        fs.mkdirs(p.getParent())
        if not fs.createNewFile(p):
            raise RuntimeError(f"another writer has stored epoch {epoch}")


def sink(root: str, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES):
    """A foreachBatch function for a stream of items whose batches arrive whole."""
    def write(items: DataFrame, epoch: int) -> None:
        Store(items.sparkSession, root).insert(batches(items, most_items, most_bytes), epoch)
    return write
