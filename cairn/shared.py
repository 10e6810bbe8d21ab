"""The folder that the driver and all executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``. A fresh local folder is set where a session on this machine alone has none; a cluster must name its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders made by this process; results read them until they are written, so only a caller knows when they may go.
_made: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    _made.append(path := f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return path


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_made(spark: SparkSession) -> int:
    """Delete all folders made so far, once the results that read them have been written; returns how many."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


def drop(spark: SparkSession, *made: DataFrame | str) -> None:
    """Delete folders of fresh_dir and tables of materialise that nothing reads any more."""
    for x in made:
        uri = x if isinstance(x, str) else getattr(x, "made_at", None)
        if uri in _made:
            _made.remove(uri)
            _delete(spark, uri)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and losing executors costs nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.made_at = path
    return out
