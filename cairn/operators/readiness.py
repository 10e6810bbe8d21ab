"""Readiness dimensions and policy gates of projects.

``facts`` has a row for each project: project_id, repo_path, repo_exists, adc_present, adc_required, graph_available, files,
symbols, index_status, has_tests, ci_workflows, activity_count, active_tokens, profile, level and evidence_pack (its id). ``signals``
(project_id, kind, status, created_at, id) are recorded results of the kinds ci, pr and benchmark, of which the newest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import band, points
from .windows import latest

#: Statuses of recorded signals; any other status is a warning.
OK = ("ok", "pass", "passed", "success", "succeeded", "green", "merged", "approved", "ready")
FAIL = ("fail", "failed", "failure", "error", "red", "blocked", "rejected")
KINDS = ("ci", "pr", "benchmark")


def signal_status(status: Column) -> Column:
    """ok, fail or warn; a signal without a status is a warning."""
    word = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(word.isin(*OK), "ok").when(word.isin(*FAIL), "fail").otherwise("warn")


def with_signals(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """Facts with the status of the newest signal of each kind; null where there is none."""
    newest = latest(signals.where(F.col("kind").isin(*KINDS)), ["project_id", "kind"], [F.desc("created_at"), F.desc("id")])
    wide = newest.groupBy("project_id").agg(*[F.max(F.when(F.col("kind") == k, signal_status(F.col("status")))).alias(k) for k in KINDS])
    return facts.join(wide, "project_id", "left")


def _yes(holds: Column, no: Column | str = "warn") -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), "ok").otherwise(F.lit(no) if isinstance(no, str) else no)


def _one_of(value: Column, **statuses: tuple) -> Column:
    out = F.lit("unknown")
    for status, words in statuses.items():
        out = F.when(value.isin(*words), status).otherwise(out)
    return out


def _checks() -> list[tuple[str, str, Column]]:
    """(dimension, key, status) of each readiness check, in order of report."""
    c = F.col
    there = F.coalesce(c("repo_exists"), F.lit(False))
    unless_there = F.when(there, "warn").otherwise("unknown")
    files, symbols = (F.coalesce(c(n), F.lit(0)) for n in ("files", "symbols"))
    graph = F.when(~F.coalesce(c("graph_available"), F.lit(False)), "unknown").when((files > 0) & (symbols > 0), "ok").when(files > 0, "warn").otherwise("fail")
    present, required = (F.coalesce(c(n), F.lit(0)) for n in ("adc_present", "adc_required"))
    return [
        ("context", "repo_path", _yes(there, F.when(F.coalesce(c("repo_path"), F.lit("")) != "", "fail").otherwise("unknown"))),
        ("context", "adc_core_files", F.when(required <= 0, "unknown").when(present == required, "ok").when(present > 0, "warn").otherwise("fail")),
        ("context", "graph_index", graph),
        ("context", "index_job", _one_of(F.lower(F.coalesce(c("index_status"), F.lit(""))), ok=("done",), warn=("pending", "processing"), fail=("failed", "stale"))),
        ("verification", "test_surface", _yes(c("has_tests"), unless_there)),
        ("verification", "ci_workflows", _yes(c("ci_workflows") > 0, unless_there)),
        ("verification", "ci_signal", F.coalesce(c("ci"), F.lit("unknown"))),
        ("workflow", "work_briefing", _yes(c("activity_count") > 0)),
        ("workflow", "learn_prepare_execute", F.lit("unknown")),
        ("workflow", "pr_signal", F.coalesce(c("pr"), F.lit("unknown"))),
        ("governance", "mcp_token", _yes(c("active_tokens") > 0)),
        ("governance", "policy_profile", F.when(c("profile") == "observe-only", "warn").otherwise("ok")),
        ("roi", "context_efficiency", F.coalesce(c("benchmark"), F.when(graph == "ok", "warn").otherwise("unknown"))),
        ("roi", "outcome_metrics", F.when(c("ci").isNotNull() | c("pr").isNotNull(), "warn").otherwise("unknown"))]


def _long(rows: DataFrame, of: list[Column], carried: list[str]) -> DataFrame:
    return rows.select(*carried, F.inline(F.array(*of)))


def checks(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """(project_id, dimension, key, status): 14 checks of each project."""
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key"), s.alias("status")) for d, k, s in _checks()]
    return _long(with_signals(facts, signals), rows, ["project_id"])


def dimensions(checked: DataFrame) -> DataFrame:
    """Score and status of the five dimensions of each project, and the project's ``overall`` score: means of what is known, halves to the even."""
    mean = lambda c: F.bround(F.avg(c)).cast("long")
    each = checked.groupBy("project_id", "dimension").agg(mean(points(F.col("status"))).alias("score"))
    whole = each.groupBy("project_id").agg(mean(F.col("score")).alias("overall"))
    return each.join(whole, "project_id").select("project_id", "dimension", "score", band(F.col("score")).alias("status"), "overall")


def gates(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """(project_id, key, status, severity): gates of each project whose profile enforces anything; a missing signal is a warning."""
    strict = F.when(F.col("level").isin("L3", "L4"), "required").otherwise("warning")
    known = lambda k: F.coalesce(F.col(k), F.lit("warn"))
    warning = F.lit("warning")
    of = (("saved_evidence_pack", _yes(F.col("evidence_pack").isNotNull()), strict), ("ci_signal", known("ci"), strict), ("pr_signal", known("pr"), strict),
          ("benchmark_signal", known("benchmark"), warning), ("work_briefing_activity", _yes(F.col("activity_count") > 0), warning))
    rows = [F.struct(F.lit(k).alias("key"), s.alias("status"), v.alias("severity")) for k, s, v in of]
    return _long(with_signals(facts, signals).where(F.coalesce("level", F.lit("L0")) != "L0"), rows, ["project_id"])


def gate_summary(facts: DataFrame, gated: DataFrame) -> DataFrame:
    """(project_id, mode, overall_status): fail over warn over ok; a project without gates is observed and ok."""
    worst = F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "warn"), "warn").otherwise("ok")
    found = gated.groupBy("project_id").agg(worst.alias("worst"))
    return facts.select("project_id").join(found, "project_id", "left").select(
        "project_id", F.when(F.col("worst").isNull(), "observe").otherwise("warning_gates").alias("mode"), F.coalesce("worst", F.lit("ok")).alias("overall_status"))
