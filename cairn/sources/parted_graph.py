"""A graph in parts that are never changed: a deletion writes anew only the parts that hold something to delete.

Every table is dealt into parts by its owner's file; a manifest (generations.commit) names the folder of each part. A cascade
from files takes their symbols, these symbols' variables and every edge at one of them; parts without such a row keep their folders in the
next manifest. Readers of a manifest are not disturbed by the next one, and a writer that dies changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph_model import KEYS, RELATIONS
from ..shared import drop, materialise
from . import generations


def closure(tables, files: DataFrame) -> dict[str, DataFrame]:
    """What goes with ``files`` (path): (gone) keys of files, symbols and variables. A variable goes with its file or with its scope."""
    path = files.select(F.col("path").alias("gone")).distinct()
    symbols = tables["symbol"].join(path, F.col("file_path") == F.col("gone"), "left_semi").select(F.col("qualified_name").alias("gone")).distinct()
    own = tables["variable"]
    variables = own.join(path, F.col("file_path") == F.col("gone"), "left_semi").union(own.join(symbols, F.col("scope_qname") == F.col("gone"), "left_semi"))
    return {"file": path, "symbol": symbols, "variable": variables.select(F.col("qualified_name").alias("gone")).distinct()}


def _ends(name: str) -> list[tuple[str, str]]:
    """Columns of a table that name a node, with its label."""
    if name in RELATIONS:
        return [("src", RELATIONS[name].source), ("dst", RELATIONS[name].target)]
    return [(KEYS[name], name)]


def without(rows: DataFrame, name: str, gone: dict[str, DataFrame]) -> DataFrame:
    """Rows of the table ``name`` at none of the nodes that are gone."""
    for column, label in _ends(name):
        if label in gone:
            rows = rows.join(gone[label], F.col(column) == F.col("gone"), "left_anti")
    return rows


class PartedGraph:
    """The graph that the manifest below ``root`` shows when the object is made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.text = generations.current(spark, self.root)
        if self.text is None:
            raise FileNotFoundError(f"{root} has no graph")
        self.manifest = json.loads(self.text)

    def folders(self, name: str) -> dict[str, str]:
        return self.manifest["parts"][name]

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """A table with ``part``, or some parts of it."""
        schema = f"{self.manifest['schemas'][name]}, part INT"
        at = [f"{self.root}/{name}/{folder}" for p, folder in self.folders(name).items() if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def __getitem__(self, name: str) -> DataFrame:
        return self.read(name).drop("part")

    def delete_files(self, files: DataFrame) -> dict[str, list[str]]:
        """Delete ``files`` (path) with all that hangs on them; returns the parts of each table that were written anew."""
        gone = {label: materialise(keys, "cascade") for label, keys in closure(self, files).items()}
        made, touched = {name: dict(at) for name, at in self.manifest["parts"].items()}, {}
        for name in made:
            rows = self.read(name)
            kept = without(rows, name, gone)
            left = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
            parts = sorted(str(r["part"]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect() if left.get(r["part"], 0) < r["n"])
            touched[name] = parts
            if parts:
                some = without(self.read(name, parts), name, gone)
                written = _write(some, f"{self.root}/{name}")
                for p in parts:
                    made[name].pop(p)
                made[name] |= {p: f"{written}/p={p}" for p in parts if left.get(int(p))}
        generations.commit(self.spark, self.root, json.dumps(self.manifest | {"parts": made}), self.text)
        drop(self.spark, *gone.values())
        return touched


def _write(rows: DataFrame, at: str) -> str:
    """Writes rows with ``part`` below a new folder, whose name it returns."""
    name = uuid.uuid4().hex
    # the part is kept in the files too, so a part's folder can be read by itself
    rows.withColumn("p", F.col("part")).repartition("p").write.partitionBy("p").parquet(f"{at}/{name}")
    return name


def create(spark: SparkSession, root: str, tables, parts: int = 16) -> PartedGraph:
    """A new graph of all node and edge tables, dealt by the node that owns a row: a node by its own file or key, an edge by its source."""
    def dealt(df: DataFrame, key: Column) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))

    made, schemas = {}, {}
    for name in [*KEYS, *RELATIONS]:
        df = tables[name]
        key = F.col("file_path") if name in ("symbol", "variable") else F.col(_ends(name)[0][0])
        written = _write(dealt(df, key), f"{root}/{name}")
        schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        found = sorted(r["part"] for r in dealt(df, key).select("part").distinct().collect())  # at most ``parts``
        made[name] = {str(p): f"{written}/p={p}" for p in found}
    generations.commit(spark, root, json.dumps({"parts": made, "schemas": schemas}), generations.current(spark, root))
    return PartedGraph(spark, root)
