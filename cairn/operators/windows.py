"""Windowed operators, ordering, limits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_duplicates(activity: DataFrame) -> DataFrame:
    """Activities after the newest of their (plugin, project, type, content): the ones that a clean-up removes."""
    own = Window.partitionBy("plugin_id", "project_id", "source_type", "content_hash")
    order = own.orderBy(F.desc("synced_at"), F.desc("occurred_at"), F.desc("id"))
    return activity.select("*", F.row_number().over(order).alias("rn"), F.count(F.lit(1)).over(own).alias("copies")).where("rn > 1")


def cleaned(activity: DataFrame) -> DataFrame:
    """The newest activity of each (plugin, project, type, content)."""
    return latest(activity, ["plugin_id", "project_id", "source_type", "content_hash"], [F.desc("synced_at"), F.desc("occurred_at"), F.desc("id")])


def budget_prefix(rows: DataFrame, by: str, order: list[str], tokens: Column, budget: int) -> DataFrame:
    """Rows in order while their tokens (1 or more each) fit the budget; the first that doesn't ends the list."""
    running = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(tokens).over(running)).where(F.col("used") <= budget)


def queue_positions(jobs: DataFrame, seconds: int = 30, base: int = 0) -> DataFrame:
    """Place of each pending job in its project's queue and the wait it implies."""
    order = Window.partitionBy("project").orderBy("created_at", "job_id")
    return jobs.where("state = 'pending'").withColumn("position", F.row_number().over(order) - 1 + base).withColumn("eta", (F.col("position") - base) * seconds)


def latest(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep).drop("nth")


def even_sample(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group spread evenly over its order (all rows of smaller groups): places round(i (n-1) / (k-1)), halves to the even.

    In groups of more than k rows two such places are more than one apart, so no two meet.
    """
    own = Window.partitionBy(by)
    numbered = rows.withColumn("at", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    if k == 1:
        return numbered.where("at = 0").drop("at", "n")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (k - 1)).cast("long"))
    return numbered.where((F.col("n") <= k) | F.array_contains(places, F.col("at").cast("long"))).drop("at", "n")


def parameter_positions(variables: DataFrame) -> DataFrame:
    """Running place of each parameter among its scope's variables, from 0."""
    order = Window.partitionBy("scope_qname").orderBy("line_number", "qualified_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return variables.withColumn("position", F.sum((F.col("role") == "parameter").cast("int")).over(order) - 1).where("role = 'parameter'")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``repeated``: whether an earlier row has the same keys."""
    return rows.withColumn("repeated", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def recent(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first; the limit is held within 1 to 5000."""
    return rows.orderBy(F.desc("occurred_at"), F.desc("synced_at"), F.desc("source_item_id"), F.desc("id")).limit(max(1, min(int(limit), 5000)))


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """Up to size + 1 rows after a key: the extra row tells that there are more."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size + 1)


def page_at(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def by_severity(rows: DataFrame, rank: Column, *then: str) -> DataFrame:
    return rows.orderBy(rank.desc(), *then)


def versions(rows: DataFrame, column: str) -> DataFrame:
    """Newest semantic version first."""
    part = F.split(column, r"\.")
    return rows.orderBy(*[F.get(part, i).cast("int").desc() for i in range(3)], F.desc(column))


def due(tasks: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Enabled tasks whose time has come, and when they run next."""
    return tasks.where(F.col("enabled") & (F.col("next_run") <= F.lit(now).cast("timestamp"))).orderBy("next_run", "task_id").limit(min(limit, 50)).withColumn(
        "then", F.lit(now).cast("timestamp") + F.make_dt_interval(mins=F.col("minutes")))


def key_intermediates(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """Local variables with flows both ways, by their sum."""
    return metrics.where("role = 'local' AND flows_in > 0 AND flows_out > 0").withColumn("score", F.col("flows_in") + F.col("flows_out")).orderBy(
        F.desc("score"), "qualified_name").limit(limit)


def unused_parameters(metrics: DataFrame) -> DataFrame:
    return metrics.where("role = 'parameter' AND flows_out = 0")
