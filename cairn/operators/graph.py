"""Paths, reachability, cycles and depth over edge tables (src, dst).

Loops go by frontiers; what a round leaves is written to the shared folder, so that
plans stay short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, materialise
from .joins import callees, callers

#: Steps of a loop between two tables in the shared folder.
SPREAD_STEPS = 6


def spread(edges: DataFrame, start: DataFrame, best=F.max, grow: int = 0) -> DataFrame:
    """(node, value): the best of the values of ``start`` (node, value; one row a node) that reach a node along ``edges`` (src, dst), each edge adding ``grow``.

    A step is a join with the edges, one aggregation, and a join with what nodes had before the round, partitioned alike; only values
    that got better are sent on, each once. Nodes are linked to themselves, which keeps what a round found while its plan is one
    chain. A round is written to the shared folder and the one before it deleted. Nodes that no value reaches have no row.
    """
    spark = edges.sparkSession
    pairs = edges.select("src", "dst", F.lit(False).alias("own"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ways = materialise(pairs.union(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("own"))), "ways")
    first = start.select("node", "value").union(nodes.select("node", F.lit(None).alias("value"))).groupBy("node").agg(best("value").alias("value"))
    settled = materialise(first.select("node", "value", F.col("value").isNotNull().alias("moved")), "spread")
    better = F.col("value") < F.col("had") if best is F.min else F.col("value") > F.col("had")
    value = F.when(F.col("own"), F.col("value")).otherwise(F.col("value") + grow) if grow else F.col("value")
    while True:
        sent = settled.where("moved").select("node", "value", F.lit(True).alias("fresh"))
        old = settled.select(F.col("node").alias("at"), F.col("value").alias("had"))
        for _ in range(SPREAD_STEPS):
            came = ways.join(sent, F.col("src") == F.col("node")).where("own OR fresh").groupBy("dst").agg(best(value).alias("value"), best(F.when(F.col("own"), F.col("value"))).alias("was"))
            sent = came.join(old, F.col("dst") == F.col("at")).where(F.col("was").isNotNull() | F.col("had").isNull() | better).select(
                F.col("dst").alias("node"), "value", (F.col("was").isNull() | (F.col("value") != F.col("was"))).alias("fresh"))
        new = old.join(sent, F.col("at") == F.col("node"), "left").select(F.col("at").alias("node"), F.coalesce("value", "had").alias("value"), F.coalesce("fresh", F.lit(False)).alias("moved"))
        before, settled = settled, materialise(new, "spread")
        drop(spark, before)
        if settled.where("moved").isEmpty():
            drop(spark, ways)
            out = settled.where("value IS NOT NULL").select("node", "value")
            out.made_at = settled.made_at
            return out


def call_graph(calls: DataFrame, symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """One hop each way."""
    return callers(calls, symbols, name, limit).withColumn("way", F.lit("caller")).union(callees(calls, symbols, name, limit).withColumn("way", F.lit("callee")))


def dependency_chain(defines: DataFrame, calls: DataFrame, source: str, target: str) -> DataFrame:
    """Call paths of 1 to 3 hops between the symbols of two files by length; no path uses an edge twice."""
    start = defines.where(F.col("src") == source).select(F.col("dst").alias("n0"))
    end = defines.where(F.col("src") == target).select(F.col("dst").alias("end"))
    edge = lambda i: calls.select(F.col("src").alias(f"n{i - 1}"), F.col("dst").alias(f"n{i}"))
    one = start.join(edge(1), "n0")
    two = one.join(edge(2), "n1")
    three = two.join(edge(3), "n2").where("NOT (n0 = n2 AND n1 = n3)")
    paths = [p.join(end, F.col(f"n{i}") == F.col("end")).select(F.lit(i).alias("hops")) for i, p in ((1, one), (2, two), (3, three))]
    return paths[0].union(paths[1]).union(paths[2]).groupBy("hops").agg(F.count(F.lit(1)).alias("paths")).orderBy("hops")


def return_influence(variables: DataFrame, flows: DataFrame) -> DataFrame:
    """Node-simple flow paths from each parameter to its scope's return: (scope_qname, parameter, path, hops).

    Parallel flows count once. First the nodes are marked from which a return can be reached; paths grow among these alone, and those that can't go on
    are dropped at each hop, until none goes on.
    """
    edges = materialise(flows.select("src", "dst").distinct(), "flows")
    returns = variables.where("role = 'return'").select(F.col("qualified_name").alias("node")).distinct().withColumn("value", F.lit(1))
    alive = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), returns).select(F.col("node").alias("dst"))
    edges = materialise(edges.join(alive, "dst", "left_semi").select("src", "dst"), "flows")
    ends = variables.where("role = 'return'").select(F.col("qualified_name").alias("end"), F.col("scope_qname").alias("end_scope"))
    now = variables.where("role = 'parameter'").select("scope_qname", F.col("qualified_name").alias("parameter"), F.col("qualified_name").alias("at"), F.array("qualified_name").alias("path"))
    found = None
    for hop in count(1):  # simple paths end
        now = materialise(now.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(
            "scope_qname", "parameter", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")), "paths")
        if found is not None and now.isEmpty():
            return found
        hits = now.join(ends, (F.col("at") == F.col("end")) & (F.col("scope_qname") == F.col("end_scope"))).select("scope_qname", "parameter", "path", F.lit(hop).alias("hops"))
        found = hits if found is None else found.union(hits)


def flow_narrative(variables: DataFrame, flows: DataFrame, metrics: DataFrame) -> DataFrame:
    """A sentence for each scope: its variables, flows, and parameters that go nowhere."""
    a = variables.groupBy("scope_qname").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("role") == "parameter", 1)).alias("p"))
    b = flows.groupBy("scope_qname").agg(F.count(F.lit(1)).alias("f"))
    c = metrics.where("role = 'parameter' AND flows_out = 0").groupBy("scope_qname").agg(F.count(F.lit(1)).alias("u"))
    return a.join(b, "scope_qname", "left").join(c, "scope_qname", "left").fillna(0, ["f", "u"]).select(
        "scope_qname", F.concat(F.col("scope_qname"), F.lit(" has "), "n", F.lit(" variables ("), "p", F.lit(" parameters) and "), "f", F.lit(" flows; "), "u", F.lit(" parameters are unused.")).alias("narrative"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(symbol, component) of every node on a cycle, a self-loop included; component is the greatest node of its strongly connected component.

    Nodes with ways in and out get numbers, greater ones for more ways. Each learns the greatest number that reaches it and the
    greatest that it reaches, in the same steps, as two copies of the node with edges turned round between the second ones. Where both are
    one number, the node lies in its component. All others of a component agree in both, so only edges between such nodes are sought anew.
    """
    spark = edges.sparkSession
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    loops = edges.where("src = dst").select(F.col("src").alias("symbol"), F.col("src").alias("component"))
    pairs = edges.where("src <> dst")
    end = lambda c, out: F.struct(F.col(c).alias("symbol"), F.lit(out).alias("out"))
    ways = pairs.select(F.explode(F.array(end("src", 1), end("dst", 0))).alias("e")).groupBy("e.symbol").agg(F.sum("e.out").alias("outs"), F.sum(1 - F.col("e.out")).alias("ins"))
    names = materialise(ways.where("outs > 0 AND ins > 0").orderBy(F.col("outs").cast("double") * F.col("ins")).select("symbol", F.monotonically_increasing_id().alias("id")), "names")
    now = materialise(pairs.join(names.select(F.col("symbol").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("symbol").alias("dst"), F.col("id").alias("b")), "dst").select(
        F.col("a").alias("src"), F.col("b").alias("dst")), "numbered")
    found = None
    while not now.isEmpty():
        both = now.select(F.explode(F.array(F.struct((2 * F.col("src")).alias("src"), (2 * F.col("dst")).alias("dst")), F.struct((2 * F.col("dst") + 1).alias("src"), (2 * F.col("src") + 1).alias("dst")))).alias("e")).select("e.*")
        best = spread(both, both.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.shiftright("node", 1).alias("value")))
        half = lambda bit: F.max(F.when(F.col("node") % 2 == bit, F.col("value")))
        marks = materialise(best.groupBy(F.shiftright("node", 1).alias("id")).agg(half(0).alias("before"), half(1).alias("after")), "marks")
        drop(spark, best)
        others = marks.where("before = after AND id <> before").select("id", F.col("before").alias("top"))
        part = materialise(others.union(others.select(F.col("top").alias("id"), "top").distinct()), "cycles")
        found = part if found is None else found.union(part)
        left = lambda c: marks.where("before <> after").select(F.col("id").alias(c), F.struct("before", "after").alias(f"{c}_marks"))
        same = now.join(left("src"), "src").join(left("dst"), "dst").where("src_marks = dst_marks").select("src", "dst")
        last, now = now, materialise(same.join(same.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(same.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "numbered")
        drop(spark, last, marks)
    if found is None:
        return loops
    named = materialise(found.join(names, "id").select("symbol", "top"), "cycles")
    tops = named.groupBy("top").agg(F.max("symbol").alias("component"))
    return named.join(tops, "top").select("symbol", "component").union(loops.join(named.select("symbol"), "symbol", "left_anti").select("symbol", "component"))


def depths(edges: DataFrame) -> DataFrame:
    """Steps of the shortest way to each node from any node without a way in; 0 for those that none reaches. Goes level by level, however many there are.
    """
    pairs = materialise(edges.select("src", "dst").distinct(), "depths")
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("symbol")).distinct()
    roots = nodes.join(pairs.select(F.col("dst").alias("symbol")).distinct(), "symbol", "left_anti").select(F.col("symbol").alias("node"), F.lit(0).alias("value"))
    found = spread(pairs, roots, F.min, 1).select(F.col("node").alias("symbol"), F.col("value").alias("depth"))
    return nodes.join(found, "symbol", "left").fillna(0, ["depth"])


def reach(edges: DataFrame, start: str, hops: int, undirected: bool = False) -> DataFrame:
    """(node, depth) of what is within ``hops`` of a node, the node itself at 0."""
    pairs = edges.select("src", "dst")
    if undirected:
        pairs = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    for d in range(1, hops + 1):
        front = front.join(pairs, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen


def focus(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Edges among the nodes within ``hops`` outgoing steps."""
    near = reach(edges, start, hops).select("node")
    return edges.select("src", "dst").join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def neighbourhood(calls: DataFrame, imports: DataFrame, symbols: DataFrame, start: str, hops: int = 2, uses: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """What is near a symbol, at the least depth: symbols by calls either way, files near its file by imports either way, and variables
    that those it uses flow to within it (depth 1)."""
    path = symbols.where(F.col("qualified_name") == start).select("file_path").first()
    near = reach(calls, start, hops, True).withColumn("relation", F.lit("CALLS"))
    if path is not None:
        near = near.union(reach(imports, path[0], hops, True).withColumn("relation", F.lit("IMPORTS")))
    near = near.where("depth > 0")
    if uses is not None and flows is not None:
        used = uses.where(F.col("src") == start).select(F.col("dst").alias("src"))
        into = flows.where(F.col("scope_qname") == start).join(used, "src", "left_semi")
        near = near.union(into.select(F.col("dst").alias("node"), F.lit(1).alias("depth"), F.lit("FLOWS_TO").alias("relation")))
    return near.groupBy("relation", "node").agg(F.min("depth").alias("depth"))


def scope_flows(flows: DataFrame, scope: str, limit: int = 50) -> DataFrame:
    return flows.where(F.col("scope_qname") == scope).orderBy("line_number", "src", "dst").limit(limit)
