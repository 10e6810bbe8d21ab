"""The layout against a tree that is built node by node."""

import math
import random

import pytest

from cairn.operators import layout as Y


def direction(dx, dy, number):
    d = math.hypot(dx, dy)
    return (dx / d, dy / d, d) if d > 0.0001 else (math.cos(number * Y.GOLDEN_ANGLE), math.sin(number * Y.GOLDEN_ANGLE), 0.0001)


class Cell:
    def __init__(self, x, y, w, h, level):
        self.box, self.level, self.points, self.children = (x, y, w, h), level, [], None

    def add(self, p, most):
        self.points.append(p)
        if self.level == most:
            return
        if self.children is None and len(self.points) > 1:
            x, y, w, h = self.box
            self.children = [Cell(x + a * w / 2, y + b * h / 2, w / 2, h / 2, self.level + 1) for b in (0, 1) for a in (0, 1)]
            for q in self.points:
                self.child(q).add(q, most)
        elif self.children:
            self.child(p).add(p, most)

    def child(self, p):
        x, y, w, h = self.box
        return self.children[(2 if p["y"] >= y + h / 2 else 0) + (1 if p["x"] >= x + w / 2 else 0)]


def one_step(points, links, s):
    force = {p["n"]: [0.0, 0.0] for p in points}
    by_id = {p["id"]: p for p in points}

    def push(n, x, y):
        force[n][0] += x
        force[n][1] += y

    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    margin = max(max(xs) - min(xs), max(ys) - min(ys), 1.0) * 0.05 + 1
    root = Cell(min(xs) - margin, min(ys) - margin, max(xs) - min(xs) + 2 * margin, max(ys) - min(ys) + 2 * margin, 0)
    for p in sorted(points, key=lambda p: p["n"]):
        root.add(p, s.max_depth)

    def act(cell, p):
        if not cell.points or cell.children is None and cell.points[0]["n"] == p["n"]:
            return
        m = sum(q["mass"] for q in cell.points)
        ux, uy, d = direction(p["x"] - sum(q["x"] * q["mass"] for q in cell.points) / m, p["y"] - sum(q["y"] * q["mass"] for q in cell.points) / m, p["n"])
        if cell.children is None or cell.box[2] / max(d, 1) < s.theta:
            f = s.repulsion * p["mass"] * m / max(d * d, 64)
            push(p["n"], ux * f, uy * f)
        else:
            for c in cell.children:
                act(c, p)

    for p in points:
        act(root, p)
    for a, b in links:
        if a != b and a in by_id and b in by_id:
            p, q = by_id[a], by_id[b]
            ux, uy, d = direction(q["x"] - p["x"], q["y"] - p["y"], p["n"] + q["n"])
            least = max(1, min(p["degree"], q["degree"]))
            pull = (d - (s.link_distance + math.log2(least + 1) * 18)) * s.link_strength / least
            t = p["mass"] + q["mass"]
            push(p["n"], ux * pull * q["mass"] / t, uy * pull * q["mass"] / t)
            push(q["n"], -ux * pull * p["mass"] / t, -uy * pull * p["mass"] / t)
    for p in points:
        for q in points:
            near = all(abs(math.floor(p[c] / s.collision_cell) - math.floor(q[c] / s.collision_cell)) <= 1 for c in "xy")
            d = math.hypot(p["x"] - q["x"], p["y"] - q["y"])
            if p["n"] < q["n"] and near and d < p["radius"] + q["radius"]:
                ux, uy, _ = direction(p["x"] - q["x"], p["y"] - q["y"], p["n"] + q["n"])
                f = (p["radius"] + q["radius"] - d) * 0.58
                push(p["n"], ux * f, uy * f)
                push(q["n"], -ux * f, -uy * f)
    for p in points:
        x, y = force[p["n"]]
        scale = min(1.0, s.max_step / (math.hypot(x, y) or 1))
        p["x"] += x * scale
        p["y"] += y * scale


def test_layout_equals_a_tree_built_node_by_node(spark):
    rng = random.Random(4)
    nodes = [(f"id{i}", rng.choice([*Y.KINDS, "other"])) for i in range(70)]
    links = [(f"id{rng.randrange(72)}", f"id{min(rng.randrange(70), rng.randrange(70))}") for _ in range(150)]
    node, link, s = spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(links, "src string, dst string"), Y.Settings(iterations=2)
    first = [r.asDict() for r in Y.weighed(Y.placed(node), link, s).collect()]
    assert sorted(p["n"] for p in first) == list(range(70)) and [p["id"] for p in sorted(first, key=lambda p: p["n"])] == sorted(i for i, _ in nodes)
    points = [dict(p) for p in first]
    for _ in range(s.iterations):
        one_step(points, links, s)
    got = {r["id"]: r for r in Y.layout(node, link, s).collect()}
    for p in points:
        assert got[p["id"]]["x"] == pytest.approx(p["x"], abs=1e-6) and got[p["id"]]["y"] == pytest.approx(p["y"], abs=1e-6) and got[p["id"]]["z"] == p["z"]
    still = {r["id"]: (r["x"], r["y"]) for r in Y.layout(node, link, Y.Settings(most_points=69)).collect()}
    assert still == {p["id"]: (p["x"], p["y"]) for p in first}


def test_small_and_coincident_layouts(spark):
    none = spark.createDataFrame([], "id string, kind string")
    links = spark.createDataFrame([], "src string, dst string")
    assert Y.layout(none, links).count() == 0 and Y.layout(spark.createDataFrame([("a", None)], none.schema), links).count() == 1
    same = spark.createDataFrame([(i, f"p{i}", "Node", 5.0, 5.0, 0.0, 0.0, 1.0, 40.0) for i in range(12)], "n long, id string, kind string, x double, y double, z double, degree double, mass double, radius double")
    points = [r.asDict() for r in same.collect()]
    one_step(points, [], Y.Settings())
    got = {r["n"]: r for r in Y.step(same, links).collect()}
    assert all(got[p["n"]]["x"] == pytest.approx(p["x"]) and got[p["n"]]["y"] == pytest.approx(p["y"]) for p in points) and len({(p["x"], p["y"]) for p in points}) == 12
    with pytest.raises(ValueError):
        Y.layout(none, links, Y.Settings(most_points=60_000))
