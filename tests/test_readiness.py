from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import readiness as D

FACTS = ("project_id int, repo_path string, repo_exists boolean, adc_present int, adc_required int, graph_available boolean, files int, symbols int, index_status string, "
         "has_tests boolean, ci_workflows int, activity_count int, active_tokens int, profile string, level string, evidence_pack string")
SIGNALS = "id int, project_id int, kind string, status string, created_at string"


def facts(spark):
    return spark.createDataFrame([(1, "/r", True, 4, 4, True, 3, 9, "Done", True, 1, 2, 1, "regulated", "L3", "ev"),
                                  (2, None, None, None, None, None, None, None, None, None, None, None, None, "observe-only", "L0", None),
                                  (3, "/r", True, 0, 4, True, 0, 0, "failed", False, 0, 0, 0, "team", "L1", None)], FACTS)


def test_newest_signal_of_each_kind_decides(spark):
    signals = spark.createDataFrame([(1, 1, "ci", "failed", "2024-01-01"), (2, 1, "ci", " GREEN ", "2024-01-02"), (3, 1, "pr", "odd", "2024-01-01"), (4, 1, "pr", "merged", "2024-01-01"),
                                     (5, 3, "benchmark", None, "2024-01-01"), (6, 3, "ci", "red", "2024-01-01"), (7, 3, "other", "ok", "2024-01-01")], SIGNALS)
    got = {(r["project_id"], r["ci"], r["pr"], r["benchmark"]) for r in D.with_signals(facts(spark), signals).collect()}
    assert got == {(1, "ok", "ok", None), (2, None, None, None), (3, "fail", None, "warn")}
    dims = {(r["project_id"], r["dimension"]): (r["score"], r["status"], r["overall"]) for r in D.dimensions(D.checks(facts(spark), signals)).collect()}
    assert len(dims) == 15 and dims[1, "context"] == (100, "ok", 90) and dims[1, "roi"] == (50, "warn", 90)
    assert dims[2, "context"][:2] == (None, "unknown") and dims[2, "roi"][:2] == (None, "unknown") and dims[2, "workflow"][:2] == (50, "warn")
    assert dims[3, "context"][:2] == (25, "fail") and dims[3, "verification"][:2] == (33, "fail")
    gated = D.gates(facts(spark), signals)
    assert {(r["key"], r["status"], r["severity"]) for r in gated.where("project_id = 1").collect()} == {
        ("saved_evidence_pack", "ok", "required"), ("ci_signal", "ok", "required"), ("pr_signal", "ok", "required"), ("benchmark_signal", "warn", "warning"), ("work_briefing_activity", "ok", "warning")}
    assert {tuple(r) for r in D.gate_summary(facts(spark), gated).collect()} == {(1, "warning_gates", "warn"), (2, "observe", "ok"), (3, "warning_gates", "fail")}


def test_no_projects_and_no_signals(spark):
    none, silent = facts(spark).where("false"), spark.createDataFrame([], SIGNALS)
    assert D.checks(none, silent).count() == 0 and D.gates(none, silent).count() == 0 and D.gate_summary(none, D.gates(none, silent)).count() == 0
    assert D.checks(facts(spark), silent).where(F.col("key") == "ci_signal").select("status").distinct().collect()[0][0] == "unknown"


def test_flows_within_a_symbol_are_neighbours(spark):
    edges = "src string, dst string"
    symbols = spark.createDataFrame([("s", "f")], "qualified_name string, file_path string")
    flows = spark.createDataFrame([("a", "b", "s"), ("a", "b", "s"), ("c", "d", "s"), ("a", "e", "other")], "src string, dst string, scope_qname string")
    got = G.neighbourhood(spark.createDataFrame([("t", "s")], edges), spark.createDataFrame([], edges), symbols, "s", uses=spark.createDataFrame([("s", "a"), ("x", "c")], edges), flows=flows)
    assert {tuple(r) for r in got.collect()} == {("CALLS", "t", 1), ("FLOWS_TO", "b", 1)}
