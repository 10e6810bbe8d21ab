"""Steps whose cost must grow no faster than their input."""

from cairn.operators import joins as J


def test_accessible_pairs_are_not_shuffled(spark):
    members = spark.createDataFrame([(u, g) for u in range(600) for g in {u % 3, u % 2 + 3, 9}] + [(0, 0), (None, 1), (7, None)], "user long, group_id long")
    groups = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 1), (4, 1), (1, 1), (None, 1)], "group_id long, active int")
    grants = spark.createDataFrame([(g, p) for g in range(10) for p in range(g * 5, g * 5 + 8)] * 2 + [(3, None)], "group_id long, project_id long")
    df = J.accessible(members, groups, grants)
    live = {0, 1, 3, 4}
    held = {(u, g) for u in range(600) for g in {u % 3, u % 2 + 3, 9}} | {(None, 1)}
    want = {(u, p) for u, g in held if g in live for p in [*range(g * 5, g * 5 + 8), *([None] if g == 3 else [])]}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert df._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"


def test_layout_moves_all_nodes(spark, monkeypatch):
    import random

    from cairn.operators import layout as Y
    from cairn.plans import layout as plans  # noqa: F401  registers g14_iteration

    rng = random.Random(5)
    nodes = spark.createDataFrame([(f"id{i}", rng.choice(Y.KINDS)) for i in range(90)], "id string, kind string")
    links = spark.createDataFrame([(f"id{rng.randrange(90)}", f"id{rng.randrange(90)}") for _ in range(120)], "src string, dst string")
    rows = lambda s: {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in Y.layout(nodes, links, s).collect()}
    bounded = rows(Y.Settings(iterations=1, most_points=90))
    assert rows(Y.Settings(iterations=1, most_points=None)) == bounded != rows(Y.Settings(iterations=1, most_points=89))
    monkeypatch.setattr(Y, "MOST_SENT", 5)  # deeper levels are joined by shuffles
    assert rows(Y.Settings(iterations=1, most_points=None)) == bounded
    # neither registered query has a bound
    seen = []
    monkeypatch.setattr(Y, "layout", lambda node, edge, s: seen.append(s.most_points) or nodes.selectExpr("id", "kind", "0d AS x", "0d AS y", "0d AS z"))
    from cairn.plans.registry import queries
    for name in ("g14_iteration", "g14_layout"):
        queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [None, None]


def test_cycles_take_one_spread_for_both_ways(spark, monkeypatch):
    import random

    from cairn.operators import graph as G

    rng = random.Random(7)
    made = sorted({(f"{copy}.{a}", f"{copy}.{b}") for copy in range(3) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(360))})
    out, back = {}, {}
    for a, b in made:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    want = {}
    for start in sorted(out, reverse=True):  # the greatest node of a component names it
        if start not in want:
            sides = []
            for ways in (out, back):
                seen, todo = set(), [start]
                while todo:
                    new = set(ways.get(todo.pop(), ())) - seen
                    seen |= new
                    todo += new
                sides.append(seen)
            want |= dict.fromkeys(sides[0] & sides[1], start)
    spreads, kept = [], G.spread
    monkeypatch.setattr(G, "spread", lambda *a: spreads.append(a) or kept(*a))
    got = G.on_cycles(spark.createDataFrame(made, "src string, dst string")).collect()
    assert len(got) == len(want) and {r["symbol"]: r["component"] for r in got} == want and len(set(want.values())) >= 3
    spreads.clear()
    ring = G.on_cycles(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string"))
    assert {r["symbol"]: r["component"] for r in ring.collect()} == dict.fromkeys("abc", "c") and len(spreads) == 1


def test_a_spread_that_settles_in_a_round_takes_no_more(spark, monkeypatch):
    from cairn.operators import graph as G

    made, kept = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, label: made.append(label) or kept(df, label))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = G.spread(edges, spark.createDataFrame([("a", 1)], "node string, value int"), G.F.min, 1)
    assert {r["node"]: r["value"] for r in got.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert made.count("spread") == 2  # the start and one round


def _crowd(spark, n):
    """Points as they come before an iteration, so dense that each touches hundreds, and no links."""
    import random

    rng = random.Random(3)
    points = spark.createDataFrame([(i, f"p{i}", "Node", rng.random() * 500, rng.random() * 500, 0.0, 0.0, 1.0, 40.0) for i in range(n)],
                                   "n long, id string, kind string, x double, y double, z double, degree double, mass double, radius double")
    return points, spark.createDataFrame([], "src string, dst string")


def test_an_iteration_shuffles_in_proportion_to_points(spark, monkeypatch):
    from cairn.operators import layout as Y

    monkeypatch.setattr(Y, "MOST_SENT", 600)
    points, links = _crowd(spark, 3000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {(s.stageId(), s.attemptId()) for s in stages()}
    assert len(Y.step(points, links).collect()) == 3000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    # walks down the tree and pairs that touch are no rows (29.1 records a point where they were, 10.7 now)
    assert sum(s.shuffleWriteRecords() for s in stages() if (s.stageId(), s.attemptId()) not in before) < 15 * 3000


def test_blocks_change_no_place(spark, monkeypatch):
    from cairn.operators import layout as Y

    points, links = _crowd(spark, 300)
    points = points.unionByName(points.selectExpr("n + 300 AS n", "concat(id, 'b') AS id", "kind", "CASE WHEN n < 20 THEN 7d ELSE x * 40 END AS x", "CASE WHEN n < 20 THEN 7d ELSE y END AS y", "z", "degree", "mass", "CASE n % 9 WHEN 0 THEN 200d ELSE 40d END AS radius"))
    rows = lambda: {r["n"]: (round(r["x"], 6), round(r["y"], 6)) for r in Y.step(points, links).collect()}
    whole = rows()
    for most in (1, 30):
        monkeypatch.setattr(Y, "MOST_SENT", most)
        assert rows() == whole


def test_layout_of_odd_graphs_equals_its_sql(spark):
    import duckdb

    from cairn.operators import layout as Y
    from cairn.plans import layout as plans
    from compare import same

    nodes = [(f"n{i % 37}", Y.KINDS[i % 3]) for i in range(50)] + [("n1", "File"), ("n1", "File"), ("", None), (None, "Symbol")]  # ids of several nodes, and none
    links = [(f"n{i * 7 % 40}", f"n{i * i % 37}") for i in range(90)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), (None, "n3"), ("n4", None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE node (id VARCHAR, kind VARCHAR); CREATE TABLE edge (src VARCHAR, dst VARCHAR)")
    c.executemany("INSERT INTO node VALUES (?, ?)", [x for x in nodes if x[0] is not None])
    c.executemany("INSERT INTO edge VALUES (?, ?)", links)
    sql = "WITH RECURSIVE " + plans._STEP.format(node="node", edge="edge")
    got = plans._rounded(Y.layout(spark.createDataFrame(nodes, "id string, kind string").where("id IS NOT NULL"), spark.createDataFrame(links, "src string, dst string"), Y.Settings(iterations=1)))
    same(got, c, sql)
    more = Y.layout(spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(links, "src string, dst string"), Y.Settings(iterations=1))
    assert more.count() == len(nodes) and more.where("id IS NULL AND x IS NULL").count() == 1


def test_layout_leaves_its_last_iteration_only(spark):
    from cairn import shared
    from cairn.operators import layout as Y

    points, _ = _crowd(spark, 40)
    before = set(shared._made)
    got = Y.layout(points.select("id", "kind"), spark.createDataFrame([("p1", "p2"), ("p2", "p3")], "src string, dst string"))
    assert len(set(shared._made) - before) == 1 and got.count() == 40
