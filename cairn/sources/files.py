"""Sources and sinks: trees of files, JSON lines, case sets, change lists, markdown and reports."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..extract.patterns import SPECS
from ..operators.lookup import has_credential
from ..operators.windows import latest
from ..shared import materialise

#: Fixed value: folders that no scan enters.
PRUNED = (".git", ".venv", "venv", "env", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", "dist", "build", ".next", "coverage")


def discover(spark: SparkSession, root: str, disabled: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """(path, text, language) of source files below ``root`` whose language isn't disabled; paths are relative.

    Pruned folders, files of more than ``most_bytes`` if that is given, and files with a NUL or that aren't UTF-8 are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.removeprefix("file://").rstrip("/")) + "/", "")
    rows = (raw if most_bytes is None else raw.where(F.col("length") <= most_bytes)).select(relative.alias("path"), "content").where(wanted(F.col("path"), disabled))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("text")).where(F.col("text").isNotNull() & ~F.contains("text", F.lit("\0"))).withColumn("language", language(F.col("path")))


def wanted(path: Column, disabled: tuple[str, ...] = ()) -> Column:
    """Whether a relative path is in no pruned folder and has a language that isn't disabled."""
    suffixes = [x for s in SPECS.values() if s.language not in disabled for x in s.suffixes] + ([".py", ".pyi"] if "python" not in disabled else [])
    inside = r"(^|/)(" + "|".join(map(re.escape, PRUNED)) + ")/"
    return path.rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$") & ~path.rlike(inside)


def language(path: Column) -> Column:
    """Language of a path by the catalogue: a whole name counts before a suffix."""
    name = F.substring_index(path, "/", -1)
    out = F.when(name == "CMakeLists.txt", "cmake").when(name.rlike(r"\.pyi?$"), "python")
    for s in SPECS.values():
        for x in s.suffixes:
            out = out.when(name.endswith(x) if x.startswith(".") else name == x, s.language)
    return out


def tree_changes(previous: DataFrame, current: DataFrame, exclude: str | None = None) -> DataFrame:
    """(path, change): changed or new files, and tombstones of those that are gone or now excluded."""
    now = current.where(~F.col("path").rlike(exclude)) if exclude else current
    a, b = previous.select(F.col("path").alias("p"), F.col("content_hash").alias("h")), now.select("path", "content_hash")
    return a.join(b, F.col("p") == F.col("path"), "full_outer").where("NOT (h <=> content_hash)").select(
        F.coalesce("path", "p").alias("path"), F.when(F.col("path").isNull(), "tombstone").otherwise("changed").alias("change"))


def status_changes(lines: DataFrame) -> DataFrame:
    """(path, change, pos) of porcelain status lines (value, pos): deletions and old names first, each path once."""
    code, rest = F.substring("value", 1, 2), F.trim(F.expr("substring(value, 4)"))
    renamed = code.contains("R") & rest.contains(" -> ")
    both = F.when(renamed, F.array(F.struct(F.substring_index(rest, " -> ", 1).alias("path"), F.lit("destructive").alias("change")), F.struct(F.substring_index(rest, " -> ", -1).alias("path"), F.lit("changed").alias("change"))))
    one = both.otherwise(F.array(F.struct(rest.alias("path"), F.when(code.contains("D"), "destructive").otherwise("changed").alias("change"))))
    every = lines.where(F.length(F.trim("value")) > 0).select("pos", F.explode(one).alias("x")).select("pos", "x.path", "x.change")
    first = latest(every, ["path", "change"], [F.col("pos").asc()])
    return first.orderBy(F.col("change").desc(), "pos")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): the lines of text files with their numbers from 0 in each file.

    A file is read in splits, by as many tasks; lines count from the first of their split, to which the lines of the file's splits before are
    added. Only these counts, a row for each split, meet in a window. The files must not change between the scan for counts and that for lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    counts = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(counts.withColumn("before", before), ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "value")


def query_batch(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON-lines batch: (line, tool, arguments, valid). Blank lines don't count; a bad line is an invalid item.

    ``query`` alone asks find_symbol for 5; ``__line`` overrides the line's number.
    """
    return query_items(numbered_lines(spark, path).select(F.col("pos").cast("int").alias("pos"), "value"))


def query_items(lines: DataFrame) -> DataFrame:
    """The same of lines (pos, value)."""
    parsed = lines.where(F.trim("value") != "").withColumn("x", F.from_json("value", "tool string, arguments map<string,string>, query string, `__line` int, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    valid = F.coalesce(F.col("x").isNotNull() & F.col("x._bad").isNull() & (F.col("x.tool").isNotNull() | F.col("x.query").isNotNull()), F.lit(False))
    return parsed.select(F.coalesce("x.__line", F.col("pos") + 1).alias("line"), F.when(valid, F.coalesce("x.tool", F.lit("find_symbol"))).alias("tool"),
                         F.when(valid, F.coalesce("x.arguments", F.create_map(F.lit("name"), F.col("x.query"), F.lit("limit"), F.lit("5")))).alias("arguments"), valid.alias("valid"))


def case_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a JSON-lines file without blank lines and comments."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def freeze(cases: DataFrame, path: str, overwrite: bool = False) -> str:
    """Write a case set once as lines of JSON with sorted keys, in the order of the rows; the returned digest is the SHA-256 of the file.

    A case set is a file under version control; its rows pass the driver one after the other and none is held.
    """
    spark = cases.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"{path} exists; a case set is written once")
    digest, out = hashlib.sha256(), fs.create(target, True)
    try:
        for row in cases.toLocalIterator():
            line = json.dumps(row.asDict(True), sort_keys=True, ensure_ascii=True).encode() + b"\n"
            digest.update(line)
            out.write(bytearray(line))
    finally:
        out.close()
    return digest.hexdigest()


def markdown_notes(files: DataFrame, most: int = 400) -> DataFrame:
    """(path, title, summary, reason) of markdown (path, text): first heading and first paragraph of prose; reason says why a file gives no note."""
    body = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"^---[ \t]*\n(?s:.*?)\n---[ \t]*\n", "")
    prose = F.regexp_replace(body, r"(?sm)^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", "\n")
    title = F.nullif(F.trim(F.regexp_extract(prose, r"(?m)^[ \t]*#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), F.lit(""))
    blocks = F.split(F.regexp_replace(prose, r"(?m)^[ \t]*(#|\||-|\*|\+|>|<!--|\d+[.)][ \t])[^\n]*$", "\n"), r"\n[ \t]*\n")
    first = F.get(F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != ""), 0)
    cut = F.when(F.length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most - 3)), F.lit("..."))).otherwise(first)
    rows = files.select("path", F.coalesce(title, F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)).alias("title"), cut.alias("summary"))
    return rows.withColumn("reason", F.when(F.col("summary").isNull(), "no summary paragraph").when(has_credential(F.col("summary")) | has_credential(F.col("title")), "possible credential in summary"))


def csv_safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run as formulas get an apostrophe in front."""
    return df.select(*[F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_safe(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def mermaid(edges: DataFrame) -> DataFrame:
    """Lines of a flow chart, in order."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return edges.select(F.concat(F.lit("  "), clean("src"), F.lit(" --> "), clean("dst")).alias("line")).distinct().orderBy("line")


def batch_rejects(items: DataFrame, most_items: int = 500, most_bytes: int = 8 << 20) -> DataFrame:
    """(batch_id, reason) of sync batches (batch_id, path, content, sha256, bytes, tombstone) that can't be taken."""
    bad = items.withColumn("ok", F.col("tombstone") | ((F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")) & (F.octet_length("content") == F.col("bytes"))))
    paths = items.groupBy("batch_id", "path").agg(F.count(F.lit(1)).alias("k")).groupBy("batch_id").agg(F.max("k").alias("same_path"))
    sums = bad.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("size"), F.bool_and("ok").alias("ok"))
    reason = F.when(F.col("n") > most_items, "too many items").when(F.col("size") > most_bytes, "too many bytes").when(~F.col("ok"), "content does not match its digest").when(F.col("same_path") > 1, "conflicting path")
    return sums.join(paths, "batch_id").select("batch_id", reason.alias("reason")).where("reason IS NOT NULL")


def plan_batches(items: DataFrame, most_items: int = 500, most_bytes: int = 8 << 20) -> DataFrame:
    """Greedy batches of (project, path, bytes, tombstone): snapshots by path, then tombstones; adds ``batch``. One project's list is a fold of its own."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, batch, n, size, out = rows.sort_values(["tombstone", "path"]), 0, 0, 0, []
        for b in rows["bytes"].fillna(0).astype(int):
            if n and (n + 1 > most_items or size + b > most_bytes):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + b
            out.append(batch)
        return rows.assign(batch=out)

    from pyspark.sql.types import IntegerType, StructField, StructType

    return items.groupBy("project").applyInPandas(fold, StructType([*items.schema.fields, StructField("batch", IntegerType())]))




SNAPSHOT = ["path", "length", "modificationTime", "digest"]


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modificationTime, digest, content) of files, or of all below folders, as they are now. Missing ones give no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return reader.load(paths).select("path", "length", "modificationTime", F.sha2("content", 256).alias("digest"), "content")


def torn(first: DataFrame, again: DataFrame) -> DataFrame:
    """(path, reason) of files that two reads (SNAPSHOT) show differently: changed, gone or new, or not as long as they were listed."""
    a = first.select(F.col("path").alias("p"), *(F.col(c).alias(f"a_{c}") for c in SNAPSHOT[1:]), F.octet_length("content").alias("read"))
    both = a.join(again.select(*SNAPSHOT), F.col("p") == F.col("path"), "full_outer")
    same = (F.col("a_length") == F.col("length")) & (F.col("a_modificationTime") == F.col("modificationTime")) & (F.col("a_digest") == F.col("digest"))
    reason = F.when(F.col("path").isNull(), "gone").when(F.col("p").isNull(), "new").when(~same, "changed").when(F.col("read") != F.col("a_length"), "read in part")
    return both.select(F.coalesce("path", "p").alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def snapshot(spark: SparkSession, paths: list[str], tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): the files (SNAPSHOT and content) that did not change while they were read, and (path, reason) of the others.

    What is read is written to the shared folder at once, so nothing that parses it later reads a source again. Then the sources are read a second time: lengths, times
    and digests must be the same. Files that were torn are read anew, all sources being
    looked through again for them, up to ``tries`` times in all.
    """
    kept, bad = None, None
    for attempt in range(tries):
        now = lambda: read_files(spark, paths) if bad is None else read_files(spark, paths).join(bad.select("path"), "path", "left_semi")  # noqa: B023, E731  called at once
        first = materialise(now().select(*SNAPSHOT, "content"), "files")
        torn_now = materialise(torn(first, now()), "torn")
        good = first.join(torn_now.select("path"), "path", "left_anti")
        kept, bad = good if kept is None else kept.union(good), torn_now
        if bad.isEmpty():
            break
    return kept, bad
