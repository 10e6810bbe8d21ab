import pytest
from pyspark.sql import functions as F

from cairn.graph_model import checked
from cairn.operators import aggregates as A
from cairn.operators import graph as G
from cairn.operators import joins as J


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_cycle_members(spark):
    assert pairs(G.on_cycles(edges(spark, "a>b b>c c>a c>d")), "symbol") == {("a",), ("b",), ("c",)}
    assert pairs(G.on_cycles(edges(spark, "main>foo foo>bar bar>baz")), "symbol") == set()
    assert pairs(G.on_cycles(edges(spark, "a>b b>a x>x c>d d>e e>c b>c")), "symbol") == {(x,) for x in "abxcde"}


def test_components_of_cycles_are_apart(spark):
    got = dict(pairs(G.on_cycles(edges(spark, "a>b b>a b>c c>d d>c")), "symbol", "component"))
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_fans(spark):
    got = {r["symbol"]: (r["fan_in"], r["fan_out"]) for r in A.fan(edges(spark, "main>util foo>util bar>util util>helper")).collect()}
    assert got["util"] == (3, 1) and got["main"] == (0, 1) and got["helper"] == (1, 0)


def test_depths(spark):
    got = dict(pairs(G.depths(edges(spark, "root>a root>b a>m b>m m>leaf x>y y>x")), "symbol", "depth"))
    assert got == {"root": 0, "a": 1, "b": 1, "m": 2, "leaf": 3, "x": 0, "y": 0}


def test_hub_is_critical(spark):
    e = edges(spark, "main>hub a>hub b>hub c>hub hub>u1 hub>u2 u1>core u2>core")
    assert "hub" in [r["symbol"] for r in A.critical(e, 3).collect()]
    assert A.critical_normalised(e, 1).first()["symbol"] == "hub"


def test_metrics(spark):
    e = edges(spark, "a>b b>c c>a d>e e>f")
    got = A.metrics(e, G.on_cycles(e), G.depths(e)).first().asDict()
    assert got["symbols"] == 6 and got["calls"] == 5 and got["in_cycles"] == 3 and got["max_depth"] == 2


def test_empty_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert G.on_cycles(none).count() == 0 and G.depths(none).count() == 0 and A.fan(none).count() == 0


def test_return_influence_stays_simple(spark):
    variables = spark.createDataFrame([("s:p", "s", "parameter"), ("s:x", "s", "local"), ("t:y", "t", "local"), ("s:__return__", "s", "return")], "qualified_name string, scope_qname string, role string")
    flows = spark.createDataFrame([("s:p", "s:x"), ("s:x", "t:y"), ("t:y", "s:x"), ("t:y", "s:__return__"), ("s:x", "s:__return__")], "src string, dst string")
    got = sorted(r["path"] for r in G.return_influence(variables, flows).collect())
    assert got == [["s:p", "s:x", "s:__return__"], ["s:p", "s:x", "t:y", "s:__return__"]]


@pytest.mark.parametrize("bad", [("none", "x", "outgoing", 5), ("calls", "", "outgoing", 5), ("calls", "x", "up", 5), ("calls", "x", "outgoing", 0), ("calls", "x", "outgoing", True)])
def test_arguments_are_checked_first(bad):
    with pytest.raises(ValueError):
        checked(*bad)


def test_diff_treats_nulls_as_equal(spark):
    old = spark.createDataFrame([("a", None), ("b", "1"), ("c", "1")], "id string, content_hash string")
    new = spark.createDataFrame([("a", None), ("b", "2"), ("d", "1")], "id string, content_hash string")
    assert pairs(J.diff(old, new), "id", "change") == {("b", "modified"), ("c", "deleted"), ("d", "created")}


def test_resolution_order(spark):
    symbols = spark.createDataFrame([("f.x", "x", "f"), ("g.x", "x", "g"), ("h.y", "y", "h"), ("g.z", "z", "g"), ("h.z", "z", "h")], "qualified_name string, name string, file_path string")
    raw = spark.createDataFrame([(1, "f", "x"), (2, "k", "x"), (3, "k", "y"), (4, "k", "z")], "call_id long, file_path string, callee_name string")
    imports = spark.createDataFrame([("k", "g")], "src string, dst string")
    assert pairs(J.resolve_calls(raw, symbols, imports), "call_id", "target", "tier") == {(1, "f.x", 1), (2, "g.x", 2), (3, "h.y", 3), (4, "g.z", 2)}


def test_scope_parameters_in_order(spark):
    noise = spark.range(10_000).select(F.concat(F.lit("n"), "id").alias("scope_qname"), F.lit(0).alias("parameter_index"), F.lit(1).alias("line_number"), F.lit("v").alias("name"), F.lit("local").alias("role"))
    own = spark.range(200).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("scope_qname"), (F.col("id") % 2).cast("int").alias("parameter_index"), F.lit(1).alias("line_number"), F.concat(F.lit("p"), F.col("id") % 2).alias("name"), F.lit("parameter").alias("role"))
    asked = spark.range(50).select(F.concat(F.lit("s"), "id").alias("scope_qname")).union(spark.createDataFrame([("gone",)], "scope_qname string"))
    got = J.scope_parameters(noise.union(own), asked).collect()
    assert len(got) == 100 and [r["name"] for r in got[:2]] == ["p0", "p1"]


def test_spread_takes_the_best_value_along_any_way(spark):
    e = edges(spark, "a>b b>c c>a c>d x>d y>y " + " ".join(f"n{i}>n{i + 1}" for i in range(40)))
    start = spark.createDataFrame([("a", 5), ("x", 9), ("n0", 1), ("alone", 3)], "node string, value int")
    got = dict(pairs(G.spread(e, start), "node", "value"))
    assert got == {"a": 5, "b": 5, "c": 5, "d": 9, "x": 9, "alone": 3, **{f"n{i}": 1 for i in range(41)}}
    far = dict(pairs(G.spread(e, start.where("node = 'n0'"), F.min, 2), "node", "value"))
    assert far == {f"n{i}": 1 + 2 * i for i in range(41)}


def test_long_ways(spark):
    """Depths and cycles of a path and a ring of 60 nodes; names don't follow the order."""
    name = lambda i: f"n{(i * 37) % 101}"
    path = [(name(i), name(i + 1)) for i in range(60)]
    df = spark.createDataFrame(path, "src string, dst string")
    assert dict(pairs(G.depths(df), "symbol", "depth")) == {name(i): i for i in range(61)} and G.on_cycles(df).count() == 0
    ring = spark.createDataFrame([*path, (name(60), name(0)), ("tail", name(3)), (name(5), "end")], df.schema)
    assert pairs(G.on_cycles(ring), "symbol") == {(name(i),) for i in range(61)}


def test_return_influence_of_a_dense_scope(spark):
    """Twelve variables that all flow to each other, in a scope without a way to its return, and one way beside them."""
    names = [f"s:v{i}" for i in range(12)]
    flows = [(a, b) for a in names for b in names if a != b] + [("s:p", "s:v0"), ("s:p", "s:q"), ("s:q", "s:r")]
    variables = spark.createDataFrame([("s:p", "s", "parameter"), ("s:r", "s", "return"), ("s:q", "s", "local"), *((n, "s", "local") for n in names)], "qualified_name string, scope_qname string, role string")
    got = G.return_influence(variables, spark.createDataFrame(flows, "src string, dst string")).collect()
    assert [(r["path"], r["hops"]) for r in got] == [(["s:p", "s:q", "s:r"], 2)]
