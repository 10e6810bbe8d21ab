"""Context and answer quality, token savings and readiness scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import plain, tokens_simple
from ..shared import materialise

WEIGHTS = {"missing": 0.45, "noise": 0.35, "redundancy": 0.10, "ambiguity": 0.10}


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a over b within 0 to 1; ``empty`` where b isn't positive."""
    return F.when(b > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b))).otherwise(F.lit(empty))


def simple_name(name: Column) -> Column:
    """The last part after ``::``, ``:`` or ``.``."""
    return F.substring_index(F.substring_index(F.replace(name, F.lit("::"), F.lit(".")), ":", -1), ".", -1)


def pressure(chunks: DataFrame, gold: DataFrame, targets: DataFrame, weights: dict[str, float] | None = None, tokens=None) -> DataFrame:
    """Pressure score of each (case_id, mode).

    chunks: case_id, mode, pos, text, useful, evidence and syms (arrays). gold: case_id, gold
    (array). targets: case_id, targets (array of symbol names). Tokens of repeated chunks are
    redundant, those of chunks without use are noise.
    """
    w = weights or WEIGHTS
    w = {k: round(v / sum(w.values()), 4) for k, v in w.items()}
    same = Window.partitionBy("case_id", "mode", "digest").orderBy("pos")
    rows = chunks.withColumn("digest", F.sha2(plain(F.col("text")), 256)).withColumn("again", (F.row_number().over(same) > 1) & (plain(F.col("text")) != "")).join(
        gold, "case_id").join(targets, "case_id")
    t = (tokens or tokens_simple)(F.col("text"))
    helps = F.col("useful") | F.arrays_overlap("evidence", "gold")
    hit = F.size(F.filter("syms", lambda s: F.array_contains(F.transform("targets", simple_name), simple_name(s))))
    unsure = F.size(F.filter("syms", lambda s: F.array_contains(F.transform("targets", simple_name), simple_name(s)) & ~F.array_contains("targets", s)))
    sums = rows.groupBy("case_id", "mode").agg(
        F.sum(t).alias("tokens"), F.sum(F.when(helps, t).otherwise(0)).alias("useful_tokens"), F.sum(F.when(F.col("again"), t).otherwise(0)).alias("duplicate_tokens"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("evidence", "gold"))))).alias("covered"), F.first("gold").alias("gold"),
        F.sum(hit).alias("symbol_hits"), F.sum(unsure).alias("ambiguous_hits"))
    got = sums.withColumns({
        "coverage": ratio(F.size("covered"), F.size(F.array_distinct("gold"))), "precision": ratio(F.col("useful_tokens"), F.col("tokens")),
        "noise": ratio(F.col("tokens") - F.col("useful_tokens"), F.col("tokens")), "redundancy": ratio(F.col("duplicate_tokens"), F.col("tokens")),
        "ambiguity": ratio(F.col("ambiguous_hits"), F.col("symbol_hits"))})
    score = 100.0 * (w["missing"] * (1.0 - F.col("coverage")) + w["noise"] * F.col("noise") + w["redundancy"] * F.col("redundancy") + w["ambiguity"] * F.col("ambiguity"))
    return got.select("case_id", "mode", "tokens", "useful_tokens", "duplicate_tokens", "symbol_hits", "ambiguous_hits", F.round(score, 2).alias("score"),
                      *[F.round(c, 4).alias(c) for c in ("coverage", "precision", "noise", "redundancy", "ambiguity")])


def reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(F.lit(0.0))


def compared(scores: DataFrame) -> DataFrame:
    """Baseline against scoped, case by case."""
    a, b = (scores.where(F.col("mode") == m).select("case_id", *[F.col(c).alias(f"{c}_{i}") for c in ("tokens", "score", "coverage", "precision")]) for i, m in ((1, "baseline"), (2, "scoped")))
    return a.join(b, "case_id").select("case_id", reduction(F.col("tokens_1"), F.col("tokens_2")).alias("token_reduction"), reduction(F.col("score_1"), F.col("score_2")).alias("score_reduction"),
                                       F.round(F.col("coverage_2") - F.col("coverage_1"), 4).alias("coverage_delta"), F.round(F.col("precision_2") - F.col("precision_1"), 4).alias("precision_delta"))


#: Facts that match in any inflection.
INFLECTED = {"call": "call(?:s|ed|ing)?", "flow": "(?:flow(?:s|ed|ing)?|flows_to)", "import": "import(?:s|ed|ing)?", "return": "return(?:s|ed|ing)?"}


def has_fact(answer: Column, fact: Column) -> Column:
    """Whether the normalised answer has the fact as a word of its own."""
    normal = lambda c: plain(F.replace(c, F.lit("\\"), F.lit("/")))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in INFLECTED.items() for x in kv]), normal(fact))
    escaped = F.regexp_replace(normal(fact), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(normal(answer), F.concat(F.lit("(?:^|[^a-z0-9_])(?:"), F.coalesce(known, escaped), F.lit(")(?:[^a-z0-9_]|$)")))


def answers(rows: DataFrame) -> DataFrame:
    """Fact and citation scores of (id, answer, facts, citations, gold, evidence), the last four arrays; a ratio over nothing is 1."""
    part = lambda a, b: F.when(F.size(b) > 0, F.size(a) / F.size(b)).otherwise(F.lit(1.0))
    cited, gold = F.array_distinct("citations"), F.array_distinct("gold")
    grounded = F.array_intersect(cited, F.col("evidence"))
    covered = F.array_intersect(F.array_intersect(gold, cited), F.col("evidence"))
    got = rows.withColumns({
        "fact_coverage": part(F.filter("facts", lambda f: has_fact(F.col("answer"), f)), F.col("facts")), "citation_coverage": part(covered, gold),
        "citation_precision": part(covered, cited), "citation_grounding": part(grounded, cited), "evidence_coverage": part(F.array_intersect(gold, F.col("evidence")), gold)})
    passed = (F.trim("answer") != "") & (F.col("fact_coverage") == 1) & (F.col("citation_coverage") == 1) & (F.col("citation_grounding") == 1)
    return got.select("id", passed.alias("passed"), *[F.round(c, 4).alias(c) for c in ("fact_coverage", "citation_coverage", "citation_precision", "citation_grounding", "evidence_coverage")])


def calibrate(samples: DataFrame) -> DataFrame:
    """The threshold of (score, passed) with the greatest balanced accuracy, the smallest of equals.

    Candidates are the least score - 0.01 and every distinct score; rows without a score or an outcome don't count. Counts at or
    below each come from running sums within ranges of scores, to which the ranges below are added: no task holds
    all scores, and no candidate is joined with samples.
    """
    by_score = samples.where("score IS NOT NULL AND passed IS NOT NULL").groupBy("score").agg(F.count(F.when(F.col("passed"), 1)).alias("p"), F.count(F.when(~F.col("passed"), 1)).alias("f"))
    ranged = materialise(by_score.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "calibrate")
    # a row for each range
    below, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = ranged.groupBy("range").agg(F.sum("p").alias("p"), F.sum("f").alias("f")).select(
        "range", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in "pf"], F.sum("p").over(every).alias("passes"), F.sum("f").over(every).alias("fails"))
    upto = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumns({c: F.sum(c).over(upto) for c in "pf"}).join(sums, "range").select(
        "score", (F.col("p") + F.col("p_below")).alias("pass_kept"), (F.col("f") + F.col("f_below")).alias("fail_kept"), "passes", "fails")
    least = rows.agg(F.min("score").alias("s"), F.max("passes").alias("passes"), F.max("fails").alias("fails")).where("s is not null").select(
        (F.col("s") - 0.01).alias("score"), F.lit(0).cast("long").alias("pass_kept"), F.lit(0).cast("long").alias("fail_kept"), "passes", "fails")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    accuracy = (share(F.col("fails") - F.col("fail_kept"), F.col("fails")) + share(F.col("pass_kept"), F.col("passes"))) / 2
    return rows.union(least).withColumn("accuracy", accuracy).orderBy(F.desc("accuracy"), "score").limit(1).select(
        F.round("score", 2).alias("threshold"), F.round("accuracy", 4).alias("accuracy"), (F.col("fails") - F.col("fail_kept")).alias("caught"), F.col("pass_kept").alias("kept"))


def item_score(matched: Column, terms: Column, has_snippet: Column, neighbours: Column, typed: Column) -> Column:
    """min(1, 0.5 * share of terms + 0.2 * snippet + min(0.2, 0.05 * neighbours) + 0.1 * type); 0 without terms."""
    return F.when(terms > 0, F.least(F.lit(1.0), matched / terms * 0.5 + F.when(has_snippet, 0.2).otherwise(0.0)
                                     + F.least(F.lit(0.2), neighbours * 0.05) + F.when(typed, 0.1).otherwise(0.0))).otherwise(F.lit(0.0))


def bundle_score(items: DataFrame, by: str) -> DataFrame:
    """Quality of bundles of (score, has_snippet) items, and the fall-back decision for at least 3 hits and quality 0.55."""
    got = items.groupBy(by).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("score") >= 0.45, 1)).alias("matched"), F.bool_or("has_snippet").alias("snippets"))
    quality = F.round(F.least(F.lit(1.0), F.col("mean") + F.least(F.lit(0.15), F.col("items") * 0.03) + F.when(F.col("snippets"), 0.1).otherwise(0.0)), 3)
    return got.select(by, "items", "matched", "snippets", F.round("mean", 3).alias("mean"), quality.alias("quality")).withColumn("decision", fallback(F.col("items"), F.col("quality")))


def fallback(items: Column, quality: Column, least_items: int = 3, least_quality: float = 0.55) -> Column:
    return F.when(items < least_items, "insufficient_graph_hits").when(quality < least_quality, "low_graph_quality").otherwise("graph_context_sufficient")


def expansion(score: Column, coverage: Column, threshold: Column, passed: Column, depth: Column, most: int = 2) -> Column:
    """Reasons to go a hop further, and whether to."""
    over = threshold.isNotNull() & (score > threshold)
    reasons = F.array_compact(F.array(F.when(coverage < 1, "missing_evidence"), F.when(over, "hps_above_calibrated_threshold"), F.when(passed == F.lit(False), "answer_failed"),
                                      F.when((passed == F.lit(False)) & threshold.isNotNull() & (score <= threshold), "hps_outcome_gap")))
    return F.struct(((F.size(reasons) > 0) & (depth < most)).alias("expand"), reasons.alias("reasons"))


def failure_class(passed: Column, coverage: Column, baseline_passed: Column) -> Column:
    return F.when(passed, F.lit(None)).when(coverage < 1, "missing_retrieval_evidence").when(baseline_passed, "model_variance_or_reasoning").otherwise("task_or_model_failure")


def savings(before: Column, after: Column) -> Column:
    return F.struct((before - after).alias("saved"), F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(0.0).alias("percent"),
                    F.when(after > 0, F.round(before / after, 3)).alias("ratio"))
