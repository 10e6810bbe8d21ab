"""Greedy expansion of a case's context under budgets, with a trace of every candidate, and what became of the runs.

A case's candidates go by (depth, pos); one is taken if it fits what is left of both budgets. Rounds go over all cases at once: of the candidates
that still fit alone, the first few of each case are folded in order by an expression, and what doesn't fit alone any more will
not fit later. Every round takes at least one candidate of each case that has one, so there are at most as many rounds as
chunks in the budget; no round holds more than BLOCK candidates of a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop, materialise

#: Candidates of a case that a round folds.
BLOCK = 64
ACCEPTED, TOKENS, CHUNKS, LATER = "accepted", "token_budget_exhausted", "chunk_budget_exhausted", "not_attempted"
#: Why an expansion stopped.
PASSED, NOT_TRIGGERED, NO_CANDIDATES, DEEPEST, POOL = "answer_passed", "not_triggered", "no_expansion_candidates", "max_depth_reached", "candidate_pool_exhausted"


def accepted(candidates: DataFrame, most_chunks: int, most_tokens: int) -> DataFrame:
    """(case_id, depth, pos, tokens, step, used) of the candidates (case_id, depth, pos, tokens) that are taken: the n-th of its case, and tokens used with it.

    Null tokens count as 0. Equal (depth, pos) go by tokens. Null case ids are a case.
    """
    spark = candidates.sparkSession
    key = F.struct("depth", "pos", "tokens")
    rows = candidates.select("case_id", "depth", "pos", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "depth", "pos").orderBy("tokens")))
    key = F.struct("depth", "pos", "tokens", "nth")
    state, taken = None, []
    for _ in range(max(0, most_chunks)):
        if state is None:
            fits = rows.where(F.col("tokens") <= most_tokens).select("*", F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))
        else:
            before = state.select(F.col("case_id").alias("c"), F.col("used"), F.col("n"), F.col("last"))
            fits = rows.join(before, F.col("case_id").eqNullSafe(F.col("c"))).where((F.col("n") < most_chunks) & (F.col("used") + F.col("tokens") <= most_tokens) & (key > F.col("last"))).drop("c", "last")
        first = fits.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("depth", "pos", "tokens", "nth"))).where(F.col("r") <= BLOCK)
        lists = first.groupBy("case_id").agg(F.array_sort(F.collect_list(key)).alias("items"), F.first("used").alias("used"), F.first("n").alias("n"))
        start = F.struct(F.col("used").cast("long").alias("used"), F.col("n").cast("int").alias("n"), F.expr("CAST(array() AS array<struct<item: struct<depth: %s, pos: %s, tokens: bigint, nth: int>, step: int, used: bigint>>)" % (
            candidates.schema["depth"].dataType.simpleString(), candidates.schema["pos"].dataType.simpleString())).alias("taken"))

        def go(s, x):
            fit = (s["n"] < most_chunks) & (s["used"] + x["tokens"] <= most_tokens)
            used, n = s["used"] + x["tokens"], (s["n"] + 1).cast("int")
            return F.when(fit, F.struct(used.alias("used"), n.alias("n"), F.concat(s["taken"], F.array(F.struct(x.alias("item"), n.alias("step"), used.alias("used")))).alias("taken"))).otherwise(s)

        folded = materialise(lists.select("case_id", F.aggregate("items", start, go).alias("s"), F.element_at("items", -1).alias("last")).select("case_id", "s.*", "last"), "expansion")
        if folded.isEmpty():
            drop(spark, folded)
            break
        taken.append(folded)
        state = folded
    if not taken:
        return rows.limit(0).select("case_id", "depth", "pos", "tokens", F.lit(0).alias("step"), F.lit(0).cast("long").alias("used"))
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out.select("case_id", F.explode("taken").alias("t")).select("case_id", "t.item.depth", "t.item.pos", "t.item.tokens", "t.step", "t.used")


def trace(candidates: DataFrame, most_chunks: int, most_tokens: int) -> DataFrame:
    """Every candidate with its outcome: accepted, with step and used, or the budget that was spent; chunks are asked for first."""
    took = materialise(accepted(candidates, most_chunks, most_tokens), "expansion-taken")
    place = lambda d: F.struct(F.col(f"{d}depth").alias("depth"), F.col(f"{d}pos").alias("pos"), F.col(f"{d}tokens").alias("tokens"))
    ends = took.groupBy("case_id").agg(F.max("step").alias("steps"), F.max(place("")).alias("end")).select(F.col("case_id").alias("c"), "steps", "end")
    rows = candidates.select("case_id", "depth", "pos", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "depth", "pos", "tokens").orderBy(F.lit(1))))
    one = took.withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "depth", "pos", "tokens").orderBy("step"))).select(
        F.col("case_id").alias("tc"), F.col("depth").alias("td"), F.col("pos").alias("tp"), F.col("tokens").alias("tt"), F.col("nth").alias("tn"), "step", "used")
    same = F.col("case_id").eqNullSafe(F.col("tc")) & (F.col("depth") == F.col("td")) & (F.col("pos") == F.col("tp")) & (F.col("tokens") == F.col("tt")) & (F.col("nth") == F.col("tn"))
    spent = F.lit(most_chunks <= 0) | F.coalesce((F.col("steps") >= most_chunks) & (place("") >= F.col("end")), F.lit(False))
    outcome = F.when(F.col("step").isNotNull(), ACCEPTED).when(spent, CHUNKS).otherwise(TOKENS)
    return rows.join(one, same, "left").join(ends, F.col("case_id").eqNullSafe(F.col("c")), "left").select("case_id", "depth", "pos", "tokens", "step", "used", outcome.alias("outcome"))


def runs(cases: DataFrame, traced: DataFrame, outcomes: DataFrame, most_chunks: int, most_depth: int) -> DataFrame:
    """What became of each case of ``cases`` (case_id, passed, triggered): attempts, added, final_depth, stop_reason and passed_after.

    A case is run again after each depth that added a chunk; ``outcomes`` (case_id, depth, passed) has the answers of these runs. It stops with the first that passes
    or that spent the chunks; else the reason is what its candidates met: tokens, chunks, the greatest depth, or their end.
    """
    level = traced.where(F.col("outcome") == ACCEPTED).groupBy("case_id", "depth").agg(F.count(F.lit(1)).alias("added"), F.max("step").alias("steps"))
    ran = level.join(outcomes.select("case_id", "depth", F.col("passed").alias("ok")), ["case_id", "depth"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    ran = ran.withColumn("ended", F.col("ok") | (F.col("steps") >= most_chunks))
    stop = ran.where("ended").groupBy("case_id").agg(F.min("depth").alias("stop"))
    done = ran.join(stop, "case_id", "left").where(F.col("stop").isNull() | (F.col("depth") <= F.col("stop"))).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("added").alias("added"), F.max("depth").alias("final_depth"), F.bool_or("ok").alias("ok"), F.bool_or("ended").alias("ended"))
    some = traced.groupBy("case_id").agg(F.bool_or(F.col("outcome") == CHUNKS).alias("chunks"), F.bool_or(F.col("outcome") == TOKENS).alias("tokens"), F.max("depth").alias("deepest"))
    reason = (F.when(~F.col("triggered"), NOT_TRIGGERED).when(F.col("deepest").isNull(), NO_CANDIDATES).when(F.col("ok"), PASSED).when(F.col("ended"), CHUNKS)
              .when(F.col("tokens") & ~F.col("chunks"), TOKENS).when(F.col("chunks"), CHUNKS).when(F.col("deepest") >= most_depth, DEEPEST).otherwise(POOL))
    every = cases.join(done, "case_id", "left").join(some, "case_id", "left")
    live = lambda c: F.when(F.col("triggered"), F.coalesce(c, F.lit(0))).otherwise(0)
    return every.select("case_id", "passed", "triggered", live("attempts").cast("long").alias("attempts"), live("added").cast("long").alias("added"), live("final_depth").alias("final_depth"),
                        reason.alias("stop_reason"), (F.col("passed") | (F.col("triggered") & F.coalesce("ok", F.lit(False)))).alias("passed_after"))


def summary(ran: DataFrame) -> DataFrame:
    """One row: cases, triggered, recovered, still_failing, reruns, model_calls (two a case and one a rerun) and stop_reasons by name."""
    flag = lambda c: F.count(F.when(c, 1))
    reasons = ran.groupBy("stop_reason").agg(F.count(F.lit(1)).alias("k"), flag(F.col("triggered")).alias("t"), flag(~F.col("passed") & F.col("passed_after")).alias("r"), flag(~F.col("passed_after")).alias("f"), F.sum("attempts").alias("a"))
    return reasons.agg(F.sum("k").alias("cases"), F.sum("t").alias("triggered"), F.sum("r").alias("recovered"), F.sum("f").alias("still_failing"), F.sum("a").alias("reruns"),
                       (2 * F.sum("k") + F.sum("a")).alias("model_calls"), F.array_sort(F.collect_list(F.struct("stop_reason", "k"))).alias("stop_reasons"))
