"""Counts, roll-ups, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols, files, variables, calls and flows in one row."""
    many = lambda k: F.count(F.when(F.col("kind") == k, 1))
    a = nodes.agg(many("Symbol").alias("symbols"), many("File").alias("files"), many("Variable").alias("variables"))
    return a.join(edges.agg(many("CALLS").alias("calls"), many("FLOWS_TO").alias("flows")))


def live_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals as the admin page shows them: imports don't count among the edges."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.when(F.col("kind") != "IMPORTS", 1)).alias("edges")))


def file_stats(files: DataFrame, defines: DataFrame, calls: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Per file: symbols, distinct outside callers of its symbols, and its symbols that call.

    ``strict_reference`` counts callers of the file node itself, of which the schema has none.
    """
    owner = defines.select(F.col("src").alias("path"), F.col("dst").alias("symbol"))
    symbols = owner.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    caller = owner.select(F.col("path").alias("caller_path"), F.col("symbol").alias("src"))
    into = calls.join(owner, F.col("dst") == F.col("symbol")).join(caller, "src").where("path <> caller_path").groupBy("path").agg(F.countDistinct("src").alias("incoming"))
    out = owner.join(calls.select(F.col("src").alias("symbol")).distinct(), "symbol", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("calling"))
    got = files.select("path", "language").join(symbols, "path", "left").join(into, "path", "left").join(out, "path", "left").fillna(0, ["symbols", "incoming", "calling"])
    return got.withColumn("incoming", F.lit(0).cast("long")) if strict_reference else got


def key_modules(files: DataFrame, defines: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """Files by 0.3 * symbols + 0.7 * incoming callers."""
    return file_stats(files, defines, calls).withColumn("score", F.col("symbols") * 0.3 + F.col("incoming") * 0.7).orderBy(F.desc("score"), "path").limit(limit)


def architecture(files: DataFrame, defines: DataFrame, calls: DataFrame) -> DataFrame:
    return file_stats(files, defines, calls).agg(
        F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.countDistinct("language").alias("languages"),
        F.count(F.when(F.col("incoming") > 0, 1)).alias("files_called"), F.round(F.avg("symbols"), 2).alias("avg_symbols"), F.round(F.avg("incoming"), 2).alias("avg_callers"))


def import_surface(files: DataFrame, imports: DataFrame, limit: int = 15) -> DataFrame:
    out = imports.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("imports_out"))
    into = imports.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("imports_in"))
    return files.select("path").join(out, "path", "left").join(into, "path", "left").fillna(0, ["imports_out", "imports_in"]).orderBy(
        F.desc("imports_out"), F.desc("imports_in"), "path").limit(limit)


def fan(edges: DataFrame) -> DataFrame:
    """Distinct callers and callees of every symbol that has an edge."""
    ends = edges.select(F.col("dst").alias("symbol"), F.col("src").alias("caller"), F.lit(None).cast("string").alias("callee")).unionByName(
        edges.select(F.col("src").alias("symbol"), F.lit(None).cast("string").alias("caller"), F.col("dst").alias("callee")))
    return ends.groupBy("symbol").agg(F.countDistinct("caller").alias("fan_in"), F.countDistinct("callee").alias("fan_out"))


def neighbours(edges: DataFrame, symbol: str, incoming: bool) -> DataFrame:
    here, there = ("dst", "src") if incoming else ("src", "dst")
    return edges.where(F.col(here) == symbol).select(F.col(there).alias("neighbour")).distinct()


def _with_most(edges: DataFrame) -> DataFrame:
    """Fans with the greatest of each (at least 1), a single row that is broadcast: no window gathers all symbols in a task."""
    fans = fan(edges)
    most = fans.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"most_{c}") for c in ("fan_in", "fan_out")])
    return fans.crossJoin(F.broadcast(most))


def critical(edges: DataFrame, limit: int = 10) -> DataFrame:
    """0.6 * fan_in + 0.4 * fan_out / greatest fan_out, as rounded percent."""
    score = F.round((F.col("fan_in") * 0.6 + F.col("fan_out") / F.col("most_fan_out") * 0.4) * 100).cast("long")
    return _with_most(edges).select("symbol", "fan_in", "fan_out", score.alias("score")).orderBy(F.desc("score"), "symbol").limit(limit)


def critical_normalised(edges: DataFrame, limit: int = 10) -> DataFrame:
    """Both fans over their greatest, the second at half weight; percent cut to a whole number."""
    raw = F.col("fan_in") / F.col("most_fan_in") * 0.6 + F.col("fan_out") / F.col("most_fan_out") * 0.5 * 0.4
    top = _with_most(edges).select("symbol", raw.alias("raw"))
    return top.select("symbol", "raw", F.floor(F.round(F.col("raw") * 100, 9)).cast("long").alias("score")).orderBy(F.desc("raw"), "symbol").limit(limit).drop("raw")


def metrics(edges: DataFrame, cycles: DataFrame, depths: DataFrame) -> DataFrame:
    """One row: totals, mean and greatest fans (means rounded to 2), symbols on cycles, greatest depth."""
    a = fan(edges).agg(F.count(F.lit(1)).alias("symbols"), F.sum("fan_out").alias("calls"), F.round(F.avg("fan_in"), 2).alias("avg_fan_in"),
                       F.round(F.avg("fan_out"), 2).alias("avg_fan_out"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"))
    return a.join(cycles.agg(F.count(F.lit(1)).alias("in_cycles"))).join(depths.agg(F.max("depth").alias("max_depth")))


def briefing(activity: DataFrame) -> DataFrame:
    """Counts by event type, status that is set, and project in one pass: (facet, value, n)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("event_type", "event_type"), ("status", "status"), ("project", "project_id"))])
    return activity.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def scenarios(activity: DataFrame, tags: Column) -> DataFrame:
    """Per event type: activities, the latest time, counts of statuses, and the five most frequent tags."""
    base = activity.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("occurred_at").alias("latest"),
                                              F.count(F.when(F.col("status") == "open", 1)).alias("open"), F.count(F.when(F.col("status") == "done", 1)).alias("done"),
                                              F.count(F.when(F.col("status") == "blocked", 1)).alias("blocked"))
    counted = activity.select("event_type", F.explode(tags).alias("tag")).groupBy("event_type", "tag").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("event_type").orderBy(F.desc("k"), "tag")
    top = counted.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("event_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("top_tags"))
    return base.join(top, "event_type", "left").orderBy(F.desc("n"), "event_type")


def report_counts(activity: DataFrame) -> DataFrame:
    """Events by type, status, project and UTC day by grouping sets: (facet, value, n)."""
    base = activity.select("event_type", F.coalesce("status", F.lit("unspecified")).alias("status"), "project_id", F.to_date("occurred_at").cast("string").alias("day"))
    sets = base.groupingSets([["event_type"], ["status"], ["project_id"], ["day"]], "event_type", "status", "project_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 7, "type").when(F.col("g") == 11, "status").when(F.col("g") == 13, "project").otherwise("day").alias("facet"),
                       F.coalesce("event_type", "status", "project_id", "day").alias("value"), "n")


def dense_days(activity: DataFrame) -> DataFrame:
    """Events of each day from the first to the last, days without any included."""
    days = activity.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    axis = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return axis.join(days, "day", "left").fillna(0, ["n"])


def weekly(activity: DataFrame) -> DataFrame:
    """Events by project, type and status in weeks from Thursday to Thursday (UTC)."""
    return activity.groupBy(F.window("occurred_at", "7 days").alias("w"), "project_id", "event_type", F.coalesce("status", F.lit("unspecified")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week"), "project_id", "event_type", "status", "n")


def plain(text: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def suspected_duplicates(activity: DataFrame) -> DataFrame:
    """Groups of the same project, type, title and day with several source items or payloads."""
    return activity.groupBy("project_id", "event_type", plain(F.col("title")).alias("title"), F.to_date("occurred_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_item_id").alias("sources"), F.countDistinct("content_hash").alias("hashes")).where(
        "n >= 2 AND NOT (sources < 2 AND hashes < 2)")


def bucket_totals(rows: DataFrame, by: str, bucket: str, names: list[str]) -> DataFrame:
    """Rows of each bucket by ``by``, one column a bucket, and in total."""
    return rows.groupBy(by).agg(*[F.count(F.when(F.col(bucket) == n, 1)).alias(n) for n in names], F.count(F.lit(1)).alias("total"))


SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(column: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)]), column), F.lit(-1))


def worst(rows: DataFrame, by: str, severity: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.col(severity), severity_rank(F.col(severity))).alias("worst"))


def inconsistent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value that isn't null."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def average_duration(jobs: DataFrame) -> DataFrame:
    """Mean seconds of done jobs of more than 0 and less than 7200, cut to a whole number; 30 if there are none."""
    some = F.when((F.col("state") == "done") & (F.col("seconds") > 0) & (F.col("seconds") < 7200), F.col("seconds"))
    return jobs.agg(F.floor(F.coalesce(F.avg(some), F.lit(30.0))).cast("long").alias("seconds"))


def precision_at(hits: DataFrame, k: int = 5) -> DataFrame:
    """Per case (case_id, rank, hit, expected): hits among the first k over min(k, max(1, expected))."""
    return hits.where(F.col("rank") <= k).groupBy("case_id", "expected").agg(F.sum(F.col("hit").cast("int")).alias("hits")).select(
        "case_id", "hits", (F.col("hits") / F.least(F.lit(k), F.greatest(F.lit(1), F.col("expected")))).alias("precision"))


def odd_percentile(rows: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The value at place max(0, floor(n p / 100) - 1) of the sorted values.

    Values are counted before they are ordered, so a group's window runs over its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(by, value, F.sum("k").over(upto).alias("last"), F.sum("k").over(Window.partitionBy(by)).alias("n"))
    at = lambda p: F.greatest(F.lit(1), F.floor(F.col("n") * p / 100))
    return placed.groupBy(by).agg(*[F.min(F.when(F.col("last") >= at(p), F.col(value))).alias(f"p{p}") for p in percents])


def means(rows: DataFrame, by: list[str], columns: list[str], places: int = 2) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.round(F.avg(c), places).alias(f"avg_{c}") for c in columns], F.count(F.lit(1)).alias("n"))


#: Level of detail of a node kind without regard to its degree; other kinds have 1.
BASE_TIERS = {"Repository": 4, "Symbol": 3, "File": 2}


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node (kind, id), each edge counted at both ends, and its level of detail by kind and degree."""
    n = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE_TIERS.items() for x in kv]), F.col("kind")), F.lit(1))
    floor = F.when(F.col("degree") >= 24, 4).when(F.col("degree") >= 10, 3).when(F.col("degree") >= 4, 2).otherwise(1)
    return nodes.select("kind", "id").join(n, "id", "left").fillna(0, ["degree"]).select("kind", "id", "degree", F.greatest(base, floor).alias("tier"))


def points(status: Column) -> Column:
    return F.when(status == "ok", 100.0).when(status == "warn", 50.0).when(status == "fail", 0.0)


def band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 80, "ok").when(score >= 50, "warn").otherwise("fail")


def readiness(signals: DataFrame) -> DataFrame:
    """Mean points of the known signals of each dimension, rounded half to even, and its band."""
    return signals.groupBy("dimension").agg(F.bround(F.avg(points(F.col("status")))).cast("long").alias("score")).withColumn("status", band(F.col("score")))


def next_actions(signals: DataFrame, most: int = 8) -> DataFrame:
    """The first distinct recommendations of signals that aren't ok, in order."""
    return signals.where("status <> 'ok' AND recommendation IS NOT NULL AND recommendation <> ''").groupBy("recommendation").agg(F.min("pos").alias("pos")).orderBy("pos").limit(most)


def gate(rows: DataFrame, by: str) -> DataFrame:
    """fail over warn over ok."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return rows.groupBy(by).agg(F.max_by("status", rank).alias("status"))


def folder_counts(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(F.substring_index(path, "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def run_summary(rows: DataFrame, seconds: float) -> DataFrame:
    """ok, failed and retried items, and items a second (rounded to 3)."""
    return rows.agg(F.count(F.when(F.col("ok"), 1)).alias("ok"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.sum("retries").alias("retries"),
                    F.round(F.count(F.lit(1)) / F.lit(float(seconds)), 3).alias("qps"))
