"""Typed query routing, byte budgets and the ontology's listing."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import snippet
from ..graph_model import KEYS, RELATIONS, VERSION, checked
from ..operators import joins
from ..operators.lookup import context
from ..operators.scoring import bundle_score, item_score
from ..operators.windows import budget_prefix

MODES = ("auto", "lightweight_first", "evidence_first")
INTENTS = ("lookup", "impact", "audit")
LIGHT = {("calls", "outgoing"): "callees", ("calls", "incoming"): "callers", ("imports", "outgoing"): "file_imports", ("imports", "incoming"): "file_dependents"}

#: The last decisions, newest first.
recent: deque = deque(maxlen=100)


def choose(mode: str, relation: str, direction: str, intent: str, needs_evidence: bool) -> tuple[str, str]:
    """Plan and reason: evidence is given where it is asked for or due, else the lightest equal plan."""
    if mode not in MODES or intent not in INTENTS or not isinstance(needs_evidence, bool):
        raise ValueError("mode, intent or evidence flag is not valid")
    due = (("audit_requires_full_evidence", intent == "audit"), ("caller_requires_evidence", needs_evidence), ("admin_evidence_first", mode == "evidence_first"),
           ("auto_impact_requires_evidence", mode == "auto" and intent == "impact"))
    for reason, holds in due:
        if holds:
            return "relation", reason
    light = LIGHT.get((relation, direction))
    return (light, "auto_simple_lookup" if mode == "auto" else "admin_lightweight_first") if light else ("relation", "no_equivalent_lightweight_tool")


def plan(tables, relation: str, identity: str, direction: str, limit: int, mode: str = "auto", intent: str = "lookup", needs_evidence: bool = False) -> tuple[DataFrame, dict]:
    checked(relation, identity, direction, limit)
    name, reason = choose(mode, relation, direction, intent, needs_evidence)
    recent.appendleft(decision := {"plan": name, "reason": reason, "relation": relation, "direction": direction})
    if name == "relation":
        return joins.relation(tables, relation, identity, direction, limit), decision
    if relation == "calls":
        return getattr(joins, name)(tables["calls"], tables["symbol"], identity, limit + 1), decision
    return joins.file_imports(tables["imports"], tables["file"], identity, limit + 1, direction == "incoming"), decision


def size_of(payload: dict) -> int:
    return len(json.dumps(payload, ensure_ascii=False, separators=(",", ":"), allow_nan=False, default=str).encode())


def fitted(rows: list[dict], limit: int, budget: int, decision: dict) -> dict:
    """The result of up to ``limit`` rows that encodes within ``budget`` bytes, its own size included; rows are given up from the end."""
    kept = rows[:limit]
    for omitted in range(len(kept) + 1):
        part = kept[: len(kept) - omitted]
        out = {"result": part, "decision": decision | {"has_more": len(rows) > limit or omitted > 0, "omitted": omitted, "returned": len(part), "bytes": 0}}
        while (n := size_of(out)) != out["decision"]["bytes"]:
            out["decision"]["bytes"] = n
        if n <= budget:
            return out
    raise ValueError("the budget is less than an empty result takes")


def ontology(spark: SparkSession) -> DataFrame:
    """The closed contract: one row a relation."""
    rows = [(VERSION, r.name.upper(), r.source, KEYS[r.source], r.target, KEYS[r.target], list(r.evidence)) for r in RELATIONS.values()]
    return spark.createDataFrame(rows, "version string, relation string, source string, source_key string, target string, target_key string, evidence array<string>")


def strategy(symbols: DataFrame, files: DataFrame, calls: DataFrame, query: str, budget: int, limit: int = 20) -> DataFrame:
    """Hits of a query with their relations and scores, as many in order as the token budget holds."""
    terms = sorted(set(query.lower().split()))
    hits = context(symbols, files, query).orderBy("name", "qualified_name").limit(limit)
    full = hits.join(joins.relation_summary(hits, calls), "qualified_name")
    matched = sum((F.contains(F.lower("qualified_name"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    scored = full.withColumn("score", item_score(matched, F.lit(len(terms)), F.lit(False), F.size("callers") + F.size("callees"), F.coalesce(F.col("symbol_type") != "", F.lit(False))))
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.to_json(F.struct("qualified_name", "symbol_type", "file_path", "callers", "callees"))) / 4)).cast("long")
    return budget_prefix(scored.withColumn("all", F.lit(1)), "all", ["name", "qualified_name"], tokens, budget).drop("all")


def snippets(hits: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Code of the first ``most`` hits (qualified_name, name, file_path, line_start, line_end) whose file is in ``texts`` (path, text)."""
    first = hits.orderBy("name", "qualified_name").limit(most)
    cut = first.join(texts.select(F.col("path").alias("file_path"), "text"), "file_path").withColumn("snippet", snippet(F.col("text"), F.coalesce("line_start", F.lit(1)), F.coalesce("line_end", F.lit(1))))
    order = Window.orderBy("name", "qualified_name")  # at most ``most`` rows
    return cut.where("snippet <> ''").select(F.lit("symbol-snippet").alias("source"), F.row_number().over(order).alias("place"), "file_path", F.col("line_start").cast("int"), F.col("line_end").cast("int"), "snippet")


def keyword_snippets(texts: DataFrame, query: str, most: int) -> DataFrame:
    """Twenty lines from the first place of the query, in any case, in the first ``most`` files by path that have it."""
    needle = query.strip().lower()
    if not needle:
        return texts.where("false").selectExpr("'' AS source", "0 AS place", "path AS file_path", "0 AS line_start", "0 AS line_end", "text AS snippet")
    at = F.instr(F.lower("text"), needle)
    found = texts.where(at > 0).orderBy("path").limit(most)
    lines = lambda c: F.size(F.split(c, "\n")) - 1
    start = lines(F.substring("text", F.lit(1), at - 1)) + 1
    placed = found.withColumn("line_start", start.cast("int")).withColumn(
        "line_end", F.least(F.col("line_start") + 20, F.col("line_start") + lines(F.substring("text", at, F.length("text")))).cast("int"))
    cut = placed.withColumn("snippet", snippet(F.col("text"), F.col("line_start"), F.col("line_end"))).where("snippet <> ''")
    return cut.select(F.lit("keyword-fallback").alias("source"), F.row_number().over(Window.orderBy("path")).alias("place"), F.col("path").alias("file_path"), "line_start", "line_end", "snippet")


def strategy_bundle(symbols: DataFrame, files: DataFrame, calls: DataFrame, texts: DataFrame, query: str, budget: int, limit: int = 20, most: int = 3, least_items: int = 3) -> tuple[DataFrame, dict]:
    """Context of a query within a token budget, and what was decided about it.

    Graph hits come first. If they are fewer than ``least_items`` or their quality is low, code follows in what the budget
    leaves: that of the hits, or without any, of files that have the query's text. Only the decision's one row reaches the driver.
    """
    hits = strategy(symbols, files, calls, query, budget, limit)
    order = Window.orderBy("name", "qualified_name")  # at most ``limit`` rows
    graph = hits.select(F.lit("graph").alias("source"), F.row_number().over(order).alias("place"), "qualified_name", "file_path", F.col("line_start").cast("int"), F.col("line_end").cast("int"),
                        "score", F.lit(None).cast("string").alias("snippet"), F.col("used").cast("long"))
    scored = bundle_score(hits.select(F.lit(1).alias("all"), "score", F.lit(False).alias("has_snippet")), "all").first()
    spent = hits.agg(F.max("used")).first()[0] or 0
    quality, items = (scored["quality"], scored["items"]) if scored else (0.0, 0)
    reason = "insufficient_graph_hits" if items < least_items else "low_graph_quality" if quality < 0.55 else "graph_context_sufficient"
    decision = {"quality": quality, "items": items, "matched": scored["matched"] if scored else 0, "reason": reason, "fallback": reason != "graph_context_sufficient"}
    if decision["fallback"]:
        more = snippets(context(symbols, files, query).orderBy("name", "qualified_name").limit(limit), texts, most)
        if more.isEmpty():
            more = keyword_snippets(texts, query, most)
        tokens = F.greatest(F.lit(1), F.floor(F.length("snippet") / 4)).cast("long")
        kept = budget_prefix(more.withColumn("all", F.lit(1)), "all", ["place"], tokens, max(0, budget - spent))
        graph = graph.unionByName(kept.select("source", "place", F.lit(None).cast("string").alias("qualified_name"), "file_path", "line_start", "line_end", F.lit(None).cast("double").alias("score"),
                                              "snippet", (F.col("used") + spent).cast("long").alias("used")))
    return graph, decision


def bundle_rows(bundle: tuple[DataFrame, dict]) -> DataFrame:
    """The bundle's items, each with the reason and quality."""
    rows, decision = bundle
    return rows.withColumn("reason", F.lit(decision["reason"])).withColumn("quality", F.lit(float(decision["quality"])))
