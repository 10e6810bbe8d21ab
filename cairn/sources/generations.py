"""Generations of a graph: written whole, then published by one more manifest.

Manifests are numbered and never replaced. A writer creates the next number, which only one can, and then fills it; readers take the
greatest that is filled and keep to its generation. A writer that dies leaves at most an empty manifest, which nobody
takes and which the next writer passes over, so the generation before stays published at every moment. Everything goes through
Spark's Hadoop file system, so any store that creates files exclusively will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a filled manifest ends with.
FILLED = "\n"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, the greatest first."""
    fs, p, _ = _fs(spark, f"{root}/manifests")
    return sorted((int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()), reverse=True) if fs.exists(p) else []


def _content(spark: SparkSession, root: str, number: int) -> str:
    fs, p, jvm = _fs(spark, f"{root}/manifests/{number}")
    content = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(content)).decode()
    finally:
        content.close()


def _published(spark: SparkSession, root: str) -> tuple[int, str] | None:
    for number in _numbers(spark, root):
        if (text := _content(spark, root, number)).endswith(FILLED):
            return number, text.strip()
    return None


def current(spark: SparkSession, root: str) -> str | None:
    """What is published, if anything: the id of a generation, or what commit() was given."""
    found = _published(spark, root)
    return found[1] if found else None


def _claim(spark: SparkSession, root: str) -> int:
    """The next number, which from now on no other writer gets."""
    numbers = _numbers(spark, root)
    number = numbers[0] + 1 if numbers else 1
    fs, p, _ = _fs(spark, f"{root}/manifests/{number}")
    fs.mkdirs(p.getParent())
    if not fs.createNewFile(p):
        raise RuntimeError("another writer is publishing")
    return number


def _fill(spark: SparkSession, root: str, number: int, generation: str) -> None:
    fs, p, _ = _fs(spark, f"{root}/manifests/{number}")
    out = fs.create(p, True)
    out.write(bytearray((generation + FILLED).encode()))
    out.close()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: str | None, options: dict[str, str] | None = None) -> str:
    """Write all tables as a new generation and publish it, if ``expected`` still is the current one; returns its id.

    What was written is read back before it is published.
    """
    new = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.options(**(options or {})).parquet(f"{root}/{new}/{name}")
    for name, df in tables.items():
        if spark.read.parquet(f"{root}/{new}/{name}").schema.names != df.schema.names:
            raise RuntimeError(f"{name} was not written whole")
    commit(spark, root, new, expected)
    return new


def commit(spark: SparkSession, root: str, content: str, expected: str | None) -> None:
    """Publish ``content``, one line, if ``expected`` is what is published now. Of writers that began from one state one wins; the others raise."""
    if current(spark, root) != expected:
        raise RuntimeError("the generation changed while this one was written")
    number = _claim(spark, root)
    before = _published(spark, root)
    if (before[1] if before else None) != expected:
        raise RuntimeError("the generation changed while this one was written")
    _fill(spark, root, number, content)
    if _numbers(spark, root)[0] != number:
        raise RuntimeError("another writer published at the same time")


def read(spark: SparkSession, root: str, name: str, generation: str | None = None, schema=None) -> DataFrame:
    generation = generation or current(spark, root)
    if generation is None:
        raise FileNotFoundError(f"{root} has no published generation")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{generation}/{name}")


def promote(spark: SparkSession, source: str, target: str, names: list[str], drop_source: bool = False) -> str:
    """Rebuild ``target`` from the current generation of ``source``, check that both hold as many rows of each table, then delete the source if wanted."""
    at = current(spark, source)
    new = publish(spark, target, {n: read(spark, source, n, at) for n in names}, current(spark, target))
    for n in names:
        if read(spark, target, n, new).count() != read(spark, source, n, at).count():
            raise RuntimeError(f"{n} differs from its source")
    if drop_source:
        fs, p, _ = _fs(spark, source)
        fs.delete(p, True)
    return new
