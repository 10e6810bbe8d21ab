"""Queries of the greedy expansion: its choice, its trace, and the summary of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import expansion as K
from .registry import query

CHUNKS, TOKENS = 12, 4000


def _candidates(g) -> DataFrame:
    return g.chunk.select("case_id", (F.col("pos") % 3).alias("depth"), "pos", X.tokens_simple(F.col("text")).alias("tokens"))


def _ran(g) -> DataFrame:
    cases = g.chunk.select("case_id").distinct().select("case_id", (F.col("case_id") % 5 == 0).alias("passed"), (F.col("case_id") % 4 != 0).alias("triggered"))
    pool = _candidates(g).where("case_id % 7 <> 6")  # some cases have no candidates
    outcomes = cases.select("case_id", F.explode(F.expr("array(0L, 1L, 2L)")).alias("depth")).withColumn("passed", (F.col("case_id") + F.col("depth")) % 3 == 0)
    return K.runs(cases, K.trace(pool, CHUNKS, TOKENS), outcomes, CHUNKS, 3)


_FOLD = f"""o AS (SELECT case_id, pos % 3 AS depth, pos, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, row_number() OVER (PARTITION BY case_id ORDER BY pos % 3, pos) AS r FROM {{chunk}}),
    f AS (SELECT case_id, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS pos, NULL::BIGINT AS depth, NULL::BIGINT AS tokens, false AS kept FROM o WHERE r = 1 UNION ALL
    SELECT o.case_id, o.r, CASE WHEN f.n < {CHUNKS} AND f.used + o.tokens <= {TOKENS} THEN f.used + o.tokens ELSE f.used END, CASE WHEN f.n < {CHUNKS} AND f.used + o.tokens <= {TOKENS} THEN f.n + 1 ELSE f.n END, o.pos, o.depth, o.tokens,
    f.n < {CHUNKS} AND f.used + o.tokens <= {TOKENS} FROM f JOIN o ON o.case_id = f.case_id AND o.r = f.r + 1),
    t AS (SELECT *, CASE WHEN kept THEN 'accepted' WHEN n >= {CHUNKS} THEN 'chunk_budget_exhausted' ELSE 'token_budget_exhausted' END AS outcome FROM f WHERE r > 0)"""
query("e09_greedy_expansion", f"WITH RECURSIVE {_FOLD} SELECT case_id, depth, pos, tokens FROM t WHERE kept")(lambda g: K.accepted(_candidates(g), CHUNKS, TOKENS).select("case_id", "depth", "pos", "tokens"))
query("e09_trace", f"WITH RECURSIVE {_FOLD} SELECT case_id, depth, pos, tokens, CASE WHEN kept THEN n END AS step, CASE WHEN kept THEN used END AS used, outcome FROM t")(lambda g: K.trace(_candidates(g), CHUNKS, TOKENS))
_RUNS = f"""{_FOLD}, l AS (SELECT case_id, depth, count(*) AS added, max(n) AS steps, (case_id + depth) % 3 = 0 AS ok FROM t WHERE kept AND case_id % 7 <> 6 GROUP BY case_id, depth),
    e AS (SELECT *, ok OR steps >= {CHUNKS} AS ended FROM l), st AS (SELECT case_id, min(depth) FILTER (ended) AS stop FROM e GROUP BY 1),
    d AS (SELECT case_id, count(*) AS attempts, sum(added)::BIGINT AS added, max(depth) AS final_depth, bool_or(ok) AS ok, bool_or(ended) AS ended FROM e JOIN st USING (case_id) WHERE stop IS NULL OR depth <= stop GROUP BY 1),
    c AS (SELECT DISTINCT case_id, case_id % 5 = 0 AS passed, case_id % 4 <> 0 AS triggered FROM {{chunk}}),
    x AS (SELECT c.*, CASE WHEN triggered THEN coalesce(attempts, 0) ELSE 0 END::BIGINT AS attempts, CASE WHEN triggered THEN coalesce(added, 0) ELSE 0 END::BIGINT AS added, CASE WHEN triggered THEN coalesce(final_depth, 0) ELSE 0 END AS final_depth,
    CASE WHEN NOT triggered THEN 'not_triggered' WHEN case_id % 7 = 6 THEN 'no_expansion_candidates' WHEN ok THEN 'answer_passed' WHEN ended THEN 'chunk_budget_exhausted' WHEN bad THEN 'token_budget_exhausted' ELSE 'candidate_pool_exhausted' END AS stop_reason,
    passed OR (triggered AND coalesce(ok, false)) AS passed_after FROM c LEFT JOIN d USING (case_id) LEFT JOIN (SELECT case_id, bool_or(NOT kept) AS bad FROM t GROUP BY 1) USING (case_id))"""
query("e09_runs", f"WITH RECURSIVE {_RUNS} SELECT * FROM x")(_ran)
query("a28_expansion_summary", f"""WITH RECURSIVE {_RUNS}, h AS (SELECT stop_reason, count(*) AS k FROM x GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (triggered) AS triggered, count(*) FILTER (NOT passed AND passed_after) AS recovered,
    count(*) FILTER (NOT passed_after) AS still_failing, sum(attempts)::BIGINT AS reruns, (2 * count(*) + sum(attempts))::BIGINT AS model_calls, (SELECT string_agg(stop_reason || '=' || k, ',' ORDER BY stop_reason) FROM h) AS stop_reasons FROM x""")(
    lambda g: K.summary(_ran(g)).withColumn("stop_reasons", F.array_join(F.transform("stop_reasons", lambda r: F.concat(r["stop_reason"], F.lit("="), r["k"].cast("string"))), ",")))
