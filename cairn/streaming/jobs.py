"""Job and trace streams on Structured Streaming.

Delivery, ownership and replay are the engine's (checkpointed offsets); what is kept
here is what users of the streams can see: idempotent publication, conflicts, states,
retries with growing pauses, dead letters, quarantine and trace evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB = "job_id string, job_type string, repo_path string, project_name string, max_attempts int, created_at timestamp"
EVENT = "job_id string, ok boolean, at timestamp"
TRACE = "trace_id string, tool string, results array<string>, latency_ms double, ts timestamp"
STATES = ("pending", "processing", "retrying", "done", "failed")


def decoded(raw: DataFrame, schema: str, required: str) -> DataFrame:
    """``value`` as a struct ``x``, and ``bad`` where it can't be read or lacks ``required``."""
    got = raw.withColumn("x", F.from_json("value", schema))
    return got.withColumn("bad", F.col("x").isNull() | F.col(f"x.{required}").isNull())


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where("bad").select("value")


def published(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Jobs of a decoded stream, each id with its payload once; the same id with another payload is another row and so a conflict downstream."""
    jobs = rows.where("NOT bad").select("x.*").withColumn("digest", F.sha2(F.to_json(F.struct("job_id", "job_type", "repo_path", "project_name", "max_attempts")), 256))
    return jobs.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["job_id", "digest"]) if jobs.isStreaming else jobs.dropDuplicates(["job_id", "digest"])


def conflicts(jobs: DataFrame) -> DataFrame:
    """Ids that were published with more than one payload."""
    return jobs.groupBy("job_id").agg(F.countDistinct("digest").alias("payloads")).where("payloads > 1")


def pause(failures: Column) -> Column:
    """Seconds before the next attempt: 2^(n-1), at most 30."""
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), failures - 1))


def follow(job_id: str, attempts: int, done: bool, oks: list[bool], most: int) -> tuple[list[tuple], int, bool]:
    """States that a job passes on outcomes of its attempts, from ``attempts`` failures so far."""
    out = []
    for ok in oks:
        if done:
            break
        if ok:
            done = True
            out.append((job_id, attempts + 1, "done", 0.0))
        else:
            attempts += 1
            done = attempts >= most
            out.append((job_id, attempts, "failed" if done else "retrying", 0.0 if done else min(30.0, 2.0 ** (attempts - 1))))
    return out, attempts, done


def state_machine(events: DataFrame, most: int = 3) -> DataFrame:
    """(job_id, attempt, state, pause_s) of a stream of outcomes (job_id, ok, at); a failed job is a dead letter."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("at")
        out, attempts, done = follow(key[0], attempts, done, rows["ok"].tolist(), most)
        state.update((attempts, done))
        yield pd.DataFrame(out, columns=["job_id", "attempt", "state", "pause_s"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, attempt int, state string, pause_s double", "attempts int, done boolean", "append", "NoTimeout")


def states(events: DataFrame, most: int = 3) -> DataFrame:
    """The same of a whole table, by windows: failures so far decide state and pause."""
    from pyspark.sql import Window

    order = Window.partitionBy("job_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("job_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.sum((~F.col("ok")).cast("int"))
    rows = events.select("*", fails.over(order).alias("f"), F.coalesce(fails.over(before), F.lit(0)).alias("fb"), F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0)).alias("won"))
    live = rows.where((F.col("won") == 0) & (F.col("fb") < most))
    state = F.when(F.col("ok"), "done").when(F.col("f") >= most, "failed").otherwise("retrying")
    return live.select("job_id", F.when(F.col("ok"), F.col("f") + 1).otherwise(F.col("f")).cast("int").alias("attempt"), state.alias("state"), F.when(state == "retrying", pause(F.col("f"))).otherwise(0.0).alias("pause_s"))


def evaluate_traces(traces: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per trace: returned names, those that no symbol has, and their share."""
    from ..operators.joins import missing_share

    return missing_share(traces.select(F.col("trace_id").alias("key"), F.explode("results").alias("name")), symbols)


def trace_sink(symbols: DataFrame, path: str):
    """A foreachBatch function that appends evaluations of a batch of traces; a repeated epoch overwrites its own folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        evaluate_traces(batch, symbols).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def event_windows(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """An extension: counts by event-time windows, late rows up to ``delay``."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = events.withWatermark("ts", delay) if events.isStreaming else events
    return at.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
