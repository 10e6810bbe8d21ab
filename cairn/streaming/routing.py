"""Publication and attempts of jobs with side outputs: one keyed state for each job, one output column that says where a row goes.

Entries (job_id, seq, payload, ok, value, at) are publications, which have a payload, and outcomes of attempts, which have ``ok``; ``seq`` orders the
entries of a job. Rows of the result leave to the table that ``output`` names:

published    the first payload of a job
existing     the same payload again
conflict     another payload under a job's id
done         the attempt that worked, with its number
retrying     a failed attempt with its number and the pause before the next
quarantine   an entry that can't be read, an attempt of a job that was never published, or the failed attempt that was the last allowed
ignored      an outcome after the job ended
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import pause

ENTRY = "job_id string, seq long, payload string, ok boolean, value string, at timestamp"
ROUTED = "job_id string, seq long, output string, attempt int, pause_s double, reason string, value string"
MOST_ATTEMPTS = 3
UNREADABLE, UNKNOWN, SPENT = "unreadable entry", "job was never published", "attempts are spent"


def readable(raw: DataFrame) -> DataFrame:
    """ENTRY rows of JSON texts (value, at); an entry that can't be read or has neither payload nor outcome keeps only its text, and is keyed by it."""
    x = F.from_json("value", "job_id string, seq long, payload string, ok boolean")
    got = raw.select("value", "at", x.alias("x"))
    bad = F.col("x").isNull() | F.col("x.job_id").isNull() | F.col("x.seq").isNull() | (F.col("x.payload").isNull() & F.col("x.ok").isNull())
    return got.select(F.when(bad, F.concat(F.lit("unreadable-"), F.md5(F.col("value").cast("binary")))).otherwise(F.col("x.job_id")).alias("job_id"), *(F.when(~bad, F.col(f"x.{c}")).alias(c) for c in ("seq", "payload", "ok")),
                      "value", "at")


def routed(entries: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """ROUTED rows of a whole table of entries. A job's entries are ordered by ``seq``, ties by payload and text; its windows hold one job's entries."""
    order = Window.partitionBy("job_id").orderBy(F.col("seq").asc_nulls_first(), F.col("payload").asc_nulls_last(), F.col("value").asc_nulls_first(), F.col("ok").asc_nulls_first())
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    readable_ = F.col("seq").isNotNull()
    first = entries.withColumn("payload_first", F.first("payload", ignorenulls=True).over(so_far)).withColumn("publications", F.count("payload").over(so_far))
    tried = first.withColumn("counts", readable_ & F.col("payload").isNull() & F.col("payload_first").isNotNull()).withColumns({
        "failures": F.sum(F.when(F.col("counts") & ~F.col("ok"), 1).otherwise(0)).over(so_far),
        "failures_before": F.coalesce(F.sum(F.when(F.col("counts") & ~F.col("ok"), 1).otherwise(0)).over(before), F.lit(0)),
        "won_before": F.coalesce(F.max(F.when(F.col("counts"), F.col("ok"))).over(before), F.lit(False))})
    ended = F.col("won_before") | (F.col("failures_before") >= most)
    output = (F.when(~readable_, "quarantine").when(F.col("payload").isNotNull(), F.when(F.col("publications") == 1, "published").when(F.col("payload") == F.col("payload_first"), "existing").otherwise("conflict"))
              .when(F.col("payload_first").isNull(), "quarantine").when(ended, "ignored").when(F.col("ok"), "done").when(F.col("failures") >= most, "quarantine").otherwise("retrying"))
    out = tried.withColumn("output", output)
    live = F.col("counts") & F.col("output").isin("done", "retrying", "quarantine")
    reason = F.when(F.col("output") == "quarantine", F.when(~readable_, UNREADABLE).when(F.col("payload_first").isNull(), UNKNOWN).otherwise(SPENT))
    return out.select("job_id", "seq", "output", F.when(live, F.when(F.col("ok"), F.col("failures") + 1).otherwise(F.col("failures"))).cast("int").alias("attempt"),
                      F.when(F.col("output") == "retrying", pause(F.col("failures"))).alias("pause_s"), reason.alias("reason"), F.when(F.col("output") == "quarantine", F.col("value")).alias("value"))


class _Job(StatefulProcessor):
    """A job's payload, its failures and whether it ended; with ``forget_s``, a job that has had no entry for so long is forgotten by a timer."""

    def __init__(self, most: int, forget_s: int | None):
        self.most, self.forget_s = most, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "payload string, failures int, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        payload, failures, ended = self.job.get() if self.job.exists() else (None, 0, False)
        entries = pd.concat(list(rows)).sort_values(["seq", "payload", "value", "ok"], na_position="first", kind="stable")
        entries = pd.concat([entries[entries["seq"].isna()], entries[entries["seq"].notna()].sort_values(["seq", "payload", "value", "ok"], na_position="last", kind="stable")])
        out = []
        for seq, new, ok, value in entries[["seq", "payload", "ok", "value"]].itertuples(index=False):
            attempt = pause_s = reason = None
            if pd.isna(seq):
                seq, output, reason = None, "quarantine", UNREADABLE
            elif not pd.isna(new):
                output = "published" if payload is None else "existing" if payload == new else "conflict"
                payload = new if payload is None else payload
            elif payload is None:
                output, reason = "quarantine", UNKNOWN
            elif ended:
                output = "ignored"
            elif ok:
                output, attempt, ended = "done", failures + 1, True
            else:
                failures += 1
                attempt, ended = failures, failures >= self.most
                output, reason = ("quarantine", SPENT) if ended else ("retrying", None)
                pause_s = None if ended else min(30.0, 2.0 ** (failures - 1))
            out.append((key[0], None if seq is None else int(seq), output, attempt, pause_s, reason, value if output == "quarantine" else None))
        self.job.update((payload, failures, ended))
        if self.forget_s is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.forget_s)
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate((("job_id", "object"), ("seq", "Int64"), ("output", "object"), ("attempt", "Int32"), ("pause_s", "Float64"), ("reason", "object"), ("value", "object")))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter([])

    def close(self) -> None:
        pass


def route(entries: DataFrame, most: int = MOST_ATTEMPTS, forget_s: int | None = None) -> DataFrame:
    """The same of a stream of entries, whose session must keep state in RocksDB; the entries of a job come in the order of ``seq`` or in one batch."""
    return entries.groupBy("job_id").transformWithStateInPandas(_Job(most, forget_s), ROUTED, "Append", "None" if forget_s is None else "ProcessingTime")


def by_output(path: str):
    """A foreachBatch function that writes each output to its own folder below ``path``; a repeated epoch replaces what it wrote."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("output", "epoch").parquet(path)
    return write
