"""Lookups, filters and predicates over nodes and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes whose name is ``text`` or whose qualified name contains it, in order of qualified name."""
    return nodes.where((F.col("name") == text) | F.col("qualified_name").contains(text)).orderBy("qualified_name").limit(limit)


def by_key(nodes: DataFrame, key: str, value) -> DataFrame:
    return nodes.where(F.col(key) == value)


def context(symbols: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """Symbols whose name or qualified name contains ``text`` and whose file is known."""
    hit = symbols.where(F.col("name").contains(text) | F.col("qualified_name").contains(text))
    return hit.join(files.select(F.col("path").alias("file_path"), "language"), "file_path")


def viewer_search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose id or name contains ``text``, in any case."""
    needle = text.lower()
    return nodes.where(F.lower(F.coalesce("id", F.lit(""))).contains(needle) | F.lower(F.coalesce("name", F.lit(""))).contains(needle))


def optional_filter(df: DataFrame, equal: dict | None = None, like: dict | None = None) -> DataFrame:
    """Only the predicates that are supplied: equality, and substrings in any case."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, v in (like or {}).items():
        if v is not None:
            df = df.where(F.lower(F.col(c)).contains(v.lower()))
    return df


MAX_WINDOW_DAYS = 366


def report_filter(activity: DataFrame, start: str, end: str, projects: list[str] | None = None, event_type: str | None = None,
                  status: str | None = None, text: str | None = None) -> DataFrame:
    """Activities in [start, end) that pass all supplied filters; the window is more than 0 and at most 366 days."""
    import datetime as dt

    a, b = (dt.datetime.fromisoformat(x) for x in (start, end))
    if not dt.timedelta(0) < b - a <= dt.timedelta(days=MAX_WINDOW_DAYS):
        raise ValueError("the window must be more than 0 and at most 366 days long")
    out = activity.where((F.col("occurred_at") >= F.lit(start).cast("timestamp")) & (F.col("occurred_at") < F.lit(end).cast("timestamp")))
    if projects is not None:
        out = out.where(F.col("project_id").isin(projects))
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if status:
        out = out.where(F.coalesce("status", F.lit("unspecified")) == status)
    if text:
        out = out.where(F.instr(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))), text.lower()) > 0)
    return out


def masked(df: DataFrame, keep: Column, heavy: list[str]) -> DataFrame:
    """Heavy columns are empty except in rows where ``keep`` holds."""
    return df.select(*[F.when(keep, F.col(c)).otherwise(F.lit("")).alias(c) if c in heavy else F.col(c) for c in df.columns])


def correlated(df: DataFrame, values: Column, keys: dict[str, str]) -> DataFrame:
    """Rows some of whose scalar ``values`` contains each supplied key, in any case."""
    for needle in keys.values():
        text = F.lit(needle.lower())
        df = df.where(F.exists(values, lambda v: F.contains(F.lower(v), text)))  # noqa: B023  read at once
    return df


def of_kinds(edges: DataFrame, kinds: list[str], known: set[str]) -> DataFrame:
    """Edges of the kinds asked for (all, if none); an unknown kind is an error."""
    if unknown := sorted(set(kinds) - known):
        raise ValueError(f"unknown kinds: {unknown}")
    return edges.where(F.col("kind").isin(kinds)) if kinds else edges


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are an end of an edge; all nodes if no edge is left."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes if edges.isEmpty() else nodes.join(ends, "id", "left_semi")


#: Fixed value: what a credential looks like.
CREDENTIAL = (r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\s*[:=]\s*\S{4,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
              r"|\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,})\b")


def has_credential(text: Column) -> Column:
    return F.coalesce(text.rlike(CREDENTIAL), F.lit(False))


#: Parts of a path that protect a row, and the paths that clients poll.
PROTECTED_PARTS = ("login", "logout", "users", "tokens", "runtime-config", "updates", "audit-retention")
POLLED = ("/api/auth/projects/index-status", "/api/auth/audit", "/api/auth/audit/paged", "/api/admin/schedules")


def retention_category(path: Column, method: Column, status_code: Column) -> Column:
    """protected (failures, changes and accounts), polling or request."""
    protected = (status_code >= 400) | ~method.isin("GET", "HEAD") | path.rlike("/(" + "|".join(PROTECTED_PARTS) + ")(/|$)")
    return F.when(protected, "protected").when(path.isin(*POLLED), "polling").otherwise("request")


def expired(audit: DataFrame, now: str, days: dict[str, int]) -> DataFrame:
    """Rows older than their category allows, with the category; a time that can't be read never expires."""
    named_rows = audit.withColumn("category", retention_category(F.col("path"), F.col("method"), F.col("status_code")))
    at = F.try_to_timestamp(F.col("created_at").cast("string"))
    old = F.lit(False)
    for category, n in days.items():
        old = old | ((F.col("category") == category) & (at < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(n)} DAYS")))
    return named_rows.where(F.coalesce(old, F.lit(False)))


def visible(rows: DataFrame, grants: DataFrame | None) -> DataFrame:
    """Rows of projects that ``grants`` (project_id) names; without access control (None) all."""
    return rows if grants is None else rows.join(grants.select("project_id").distinct(), "project_id", "left_semi")


def safe_learning(rows: DataFrame, categories: tuple[str, ...] = ("lesson", "decision", "pattern", "warning"), most: int = 4000) -> DataFrame:
    """Learning rows (category, title, lesson, confidence) that are valid and hold no credential; others are left out silently."""
    text = F.concat_ws(" ", "title", "lesson")
    ok = (F.col("category").isin(*categories) & F.col("title").isNotNull() & (F.trim("title") != "") & F.col("lesson").isNotNull() & (F.trim("lesson") != "")
          & (F.length("lesson") <= most) & F.col("confidence").between(0.0, 1.0) & ~has_credential(text))
    return rows.where(F.coalesce(ok, F.lit(False)))
