"""Queries over whole inputs against brute force: nothing is left out by ids, limits or rounds."""

import datetime

from cairn.operators import aggregates as A
from cairn.operators import graph as G
from cairn.plans import catalog
from cairn.views import Graph

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def whole_graph(spark):
    """Nodes that each node reaches, over all calls."""
    out = {}
    for r in Graph(spark, SF).raw_call.select("src", "dst").collect():
        out.setdefault(r["src"], set()).add(r["dst"])
        out.setdefault(r["dst"], set())
    reached = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reached[a] = seen
    return out, reached


def test_cycles_of_all_calls(spark):
    _, reached = whole_graph(spark)
    want = {a for a in reached if a in reached[a]}
    got = [r["symbol"] for r in run(spark, "g05_on_cycles")]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
    sizes = {}
    for a in want:
        top = max(b for b in reached[a] if a in reached[b])
        sizes[top] = sizes.get(top, 0) + 1
    assert {r["component"]: r["n"] for r in run(spark, "g06_cycle_sizes")} == sizes


def test_depths_and_metrics_of_all_calls(spark):
    out, reached = whole_graph(spark)
    entered = {b for to in out.values() for b in to}
    depth, front, d = {}, set(out) - entered, 0
    while front:
        depth |= dict.fromkeys(front, d)
        front, d = {b for a in front for b in out[a]} - set(depth), d + 1
    rows = run(spark, "g07_call_depth")
    assert len(rows) == len(out) and {r["symbol"]: r["depth"] for r in rows} == {a: depth.get(a, 0) for a in out}
    got = run(spark, "a10_metrics")[0]
    assert (got["symbols"], got["calls"]) == (len(out), sum(map(len, out.values())))
    assert got["in_cycles"] == sum(a in reached[a] for a in out) > 100 and got["max_depth"] == max(depth.values())
    assert got["max_fan_out"] == max(map(len, out.values()))


def test_sorts_give_all_rows_in_order(spark):
    g = Graph(spark, SF)
    rank = {"critical": 4, "medium": 2, "info": 0}
    worst = {r["event_id"]: "critical" if (v := r["value"] or 0) > 300 else "medium" if v > 100 else "info" for r in g.events.collect()}
    got = [(r["id"], r["worst"]) for r in run(spark, "l06_severity_order")]
    assert len(got) > 100 and got == sorted(worst.items(), key=lambda x: (-rank[x[1]], x[0]))
    versions = {(r["p_size"] % 4, r["p_size"], r["p_partkey"] % 12) for r in g.part.collect()}
    got = [tuple(map(int, r["v"].split("."))) for r in run(spark, "l07_versions")]
    assert len(got) > 30 and got == sorted(versions, reverse=True)


def test_days_of_all_activity(spark):
    assert sum(r["n"] for r in run(spark, "a16_dense_days")) == Graph(spark, SF).events.count()
    at = [datetime.datetime(2024, 1, d, 12, tzinfo=datetime.UTC) for d in (1, 1, 4)]
    got = A.dense_days(spark.createDataFrame([(x,) for x in at], "occurred_at timestamp")).orderBy("day").collect()
    assert [(r["day"].day, r["n"]) for r in got] == [(1, 2), (2, 0), (3, 0), (4, 1)]


def test_paths_of_any_length(spark):
    names = ["p", *(f"x{i}" for i in range(18)), "r"]
    variables = spark.createDataFrame([(f"s:{n}", "s", {"p": "parameter", "r": "return"}.get(n, "local")) for n in names], "qualified_name string, scope_qname string, role string")
    flows = spark.createDataFrame([(f"s:{a}", f"s:{b}") for a, b in zip(names, names[1:])], "src string, dst string")
    got = G.return_influence(variables, flows).collect()
    assert [(r["hops"], r["path"]) for r in got] == [(19, [f"s:{n}" for n in names])]
    assert G.return_influence(variables, flows.limit(0)).count() == 0
