"""The folder that the driver and all executors share, and files of any store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..shared import drop, drop_made, fresh_dir, materialise, shared_dir

__all__ = ["drop", "drop_made", "fresh_dir", "get", "materialise", "open_uri", "partitions", "put", "shared_dir"]


def open_uri(uri: str):
    """(pyarrow filesystem, path) of a URI, on an executor or the driver; works for every store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def partitions(df: DataFrame, part_bytes: int = 256 << 20, most: int = 1 << 16) -> int:
    """Partitions for a shuffle of ``df``: as many as the session says, more where the plan's estimate exceeds ``part_bytes`` for each."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if size >= 1 << 60 else max(n, min(most, -(-size // part_bytes)))  # plans that know no size say a very large one


def put(uri: str, content: bytes) -> None:
    """Write a file whole."""
    fs, path = open_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(content)


def get(uri: str) -> bytes:
    fs, path = open_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()
