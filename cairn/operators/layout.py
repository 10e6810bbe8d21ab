"""Force-directed layout of a graph: repulsion over a quadtree, attraction along links, collisions of near nodes.

A cell of level d is the first d bits of both coordinates' numbers in the root square. Points are dealt over tasks by blocks, cells of some thousand
points; each block walks down the tree with its own points (``layout_blocks.py``): a cell that is far for its width, or has no children, acts on the node as a
whole, the others give way to their four children. So neither steps of walks nor pairs of near nodes are rows that Spark shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fnv1a
from ..shared import drop, materialise
from . import layout_blocks as B

#: Fixed values of the picture: kinds from the innermost ring outwards, the angle between neighbours, depth of the noise.
KINDS = ("Repository", "File", "Symbol", "Variable", "Node")
GOLDEN_ANGLE, DEPTH = B.GOLDEN_ANGLE, 900
#: The greatest bound that a setting may name; without a bound all nodes are moved.
MOST_POINTS = 50_000
#: Points of a block that are sent to one task, if the tree parts them; and the tasks that blocks are dealt to at least.
MOST_SENT, LEAST_PARTS = 16_384, 32


@dataclass(frozen=True)
class Settings:
    """Fixed defaults; beyond ``most_points`` nodes keep their first places, and None is no bound."""
    iterations: int = 3
    most_points: int | None = 10_000
    theta: float = 0.72
    repulsion: float = 1500.0
    link_distance: float = 210.0
    link_strength: float = 0.035
    collision_padding: float = 22.0
    collision_cell: float = 260.0
    max_step: float = 95.0
    max_depth: int = 16


def numbered(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (id, kind) with ``n``, 0 for the first, in order of id, and the table that this reads: parts are ranges of ids, and the window over parts has a row for each."""
    spark = nodes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = materialise(nodes.select("id", "kind").repartitionByRange(parts, "id", "kind").withColumn("part", F.spark_partition_id()), "layout-parts")
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("m")).select("part", before.alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("id", "kind")) - 1
    return parted.withColumn("own", own).join(F.broadcast(starts), "part").select("id", "kind", (F.col("start") + F.col("own")).alias("n")), parted


def placed(nodes: DataFrame) -> DataFrame:
    """First places: a spiral by number, wider for outer kinds, with x, y and z."""
    return _placed(nodes)[0]


def _placed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_number, made = numbered(nodes)
    kind = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)), F.lit(len(KINDS) - 1))
    h = fnv1a(F.col("id"))
    angle = F.col("n") * GOLDEN_ANGLE + h.bitwiseAND(F.lit(0xFFFF)) / 65535.0 * (2 * pi)
    step = F.when(F.col("n") > 250_000, 2.9).when(F.col("n") > 100_000, 3.6).otherwise(5.4)
    radius = F.sqrt(F.col("n") + 1.0) * step + kind * 240.0
    noise = (F.shiftright(h, 16).bitwiseAND(F.lit(0xFFFF)) / 65535.0 - 0.5) * DEPTH
    at = by_number.select("id", "kind", "n", angle.alias("angle"), radius.alias("radius"), ((kind - (len(KINDS) - 1) / 2) * 260.0 + noise).alias("z"))
    return at.select("id", "kind", "n", (F.cos("angle") * F.col("radius")).alias("x"), (F.sin("angle") * F.col("radius")).alias("y"), "z"), made


def linked(points: DataFrame, links: DataFrame) -> DataFrame:
    """(s, t, s_first, t_first, same): ``links`` (src, dst) by the numbers of their ends, without links to nodes that aren't there. An id that several points bear
    stands for each of them, and its first point is marked."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("n")) == 1
    at = points.select("id", "n", first.alias("first"))
    end = lambda a, name: at.select(F.col("id").alias(name), F.col("n").alias(a), F.col("first").alias(f"{a}_first"))
    return links.select("src", "dst").join(end("s", "src"), "src").join(end("t", "dst"), "dst").select("s", "t", "s_first", "t_first", (F.col("src") == F.col("dst")).alias("same"))


def weighed(points: DataFrame, links: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds degree, mass and radius; links to nodes that aren't there don't count."""
    return _weighed(points, linked(points, links), s)


def _weighed(points: DataFrame, ends: DataFrame, s: Settings) -> DataFrame:
    """A link counts once at each point of its ends, however many points bear the other end's id."""
    counted = F.explode(F.array(F.when(F.col("t_first"), F.col("s")), F.when(F.col("s_first"), F.col("t"))))
    degrees = ends.select(counted.alias("n")).where("n IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("degree"))
    degree = F.coalesce("degree", F.lit(0)).cast("double")
    return points.join(degrees, "n", "left").withColumn("degree", degree).withColumns({
        "mass": 1 + F.log2(F.col("degree") + 1) * 1.7, "radius": 18 + F.log2(F.col("degree") + 1) * 8 + s.collision_padding})


def _towards(dx: Column, dy: Column, number: Column) -> tuple[Column, Column, Column]:
    """Unit vector and length; points on one place are parted in a direction of their own."""
    length = F.sqrt(dx * dx + dy * dy)
    apart = length > 0.0001
    return (F.when(apart, dx / length).otherwise(F.cos(number * GOLDEN_ANGLE)), F.when(apart, dy / length).otherwise(F.sin(number * GOLDEN_ANGLE)),
            F.when(apart, length).otherwise(0.0001))


def square(points: DataFrame) -> DataFrame:
    """One row: corner and sides of the root, with a margin."""
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    margin = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0)) * 0.05 + 1
    return box.select((F.col("x0") - margin).alias("left"), (F.col("y0") - margin).alias("bottom"), (F.col("x1") - F.col("x0") + 2 * margin).alias("width"), (F.col("y1") - F.col("y0") + 2 * margin).alias("height"))


def parted(cells: DataFrame, depth: int) -> list[tuple[int, int, int]]:
    """(level, cx, cy) of the blocks of ``cells`` (cx, cy; a deepest cell for each point): the coarsest cells of at most MOST_SENT points. Six levels are counted first, then two
    more within the cells that hold too many, so a count is asked for at most 16 times for each of these; a deepest cell is a block however many points it holds."""
    blocks, top, crowded, level = [], 0, None, 0
    while crowded is None or crowded:
        level = min(level + (2 if level else 6), depth)
        at = lambda to: [F.call_function("shiftright", c, F.lit(depth - to)).alias(c) for c in ("cx", "cy")]  # noqa: E731, B023
        some = cells
        if crowded:
            few = cells.sparkSession.createDataFrame(crowded, "tx long, ty long")
            some = cells.join(F.broadcast(few), (at(top)[0] == F.col("tx")) & (at(top)[1] == F.col("ty")), "left_semi")
        counts = {level: {(r["cx"], r["cy"]): r["points"] for r in some.groupBy(*at(level)).agg(F.count(F.lit(1)).alias("points")).collect()}}
        for upper in range(level - 1, top - 1, -1):
            counts[upper] = {}
            for (x, y), points in counts[upper + 1].items():
                counts[upper][x >> 1, y >> 1] = counts[upper].get((x >> 1, y >> 1), 0) + points
        crowded = sorted(counts[top])
        for here in range(top, level + 1):
            inside = set(crowded)
            found = [c for c in sorted(counts[here]) if here == top or (c[0] >> 1, c[1] >> 1) in inside]
            blocks += [(here, *c) for c in found if counts[here][c] <= MOST_SENT or here == depth]
            crowded = [c for c in found if counts[here][c] > MOST_SENT and here < depth]
        top = level
    return blocks


def among_points(points: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, list[DataFrame]]:
    """(n, fx, fy): what cells of the tree and touching points do to each point of ``points`` (n, x, y, mass, radius), and the tables that this reads.

    Points are dealt by blocks. A block shows the others the cells and points that they may need, then each block's forces are one group's work.
    """
    spark = points.sparkSession
    root = square(points).first()
    if root["left"] is None:
        return spark.createDataFrame([], "n long, fx double, fy double"), []
    q = B.Square(*root, s.max_depth)
    grid = 1 << s.max_depth
    cell = lambda c, low, side: F.least(F.floor((F.col(c) - low) / side * float(grid)), F.lit(grid - 1)).cast("long")
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select("n", "x", "y", *(F.col(c).cast("double").alias(c) for c in ("mass", "radius")), cell("x", q.left, q.width).alias("cx"), cell("y", q.bottom, q.height).alias("cy"))
    cells = parted(at.select("cx", "cy"), s.max_depth)
    up = lambda c, level: F.call_function("shiftright", c, F.lit(s.max_depth - level))
    places = F.array(*(F.struct(F.lit(level).alias("level"), up("cx", level).alias("cx"), up("cy", level).alias("cy")) for level in sorted({c[0] for c in cells})))
    names = spark.createDataFrame([(b, *c) for b, c in enumerate(cells)], "to long, level int, cx long, cy long")
    dealt = at.select("n", "x", "y", "mass", "radius", F.explode(places).alias("p")).select("n", "x", "y", "mass", "radius", "p.*").join(F.broadcast(names), ["level", "cx", "cy"])
    dealt = materialise(dealt.select("to", "n", "x", "y", "mass", "radius"), "layout-points")
    sums = dealt.groupBy("to").agg(F.count(F.lit(1)), F.sum("mass"), F.sum(F.col("x") * F.col("mass")) / F.sum("mass"), F.sum(F.col("y") * F.col("mass")) / F.sum("mass"), F.min("n"),
                                   F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.max("radius")).collect()
    level, cx, cy = (np.array(c, np.int64) for c in zip(*cells))
    blocks = B.Blocks(level, B.interleaved(cx, cy, s.max_depth), *(np.array(c) for c in list(zip(*sorted(tuple(r) for r in sums)))[1:]))
    over = B.above(blocks, q)
    theta, strength, collision_cell = s.theta, s.repulsion, s.collision_cell
    arrays = lambda table: {c: table.column(c).to_numpy() for c in table.column_names}

    def show(table):
        import pyarrow as pa

        rows = arrays(table)
        return pa.table(B.shown(int(rows.pop("to")[0]), blocks, q, theta, **rows))

    def push(table):
        import pyarrow as pa

        rows = arrays(table)
        return pa.table(dict(zip(("n", "fx", "fy"), B.forces(int(rows["to"][0]), rows, blocks, over, q, theta, strength, collision_cell))))

    parts = max(len(cells), LEAST_PARTS)
    shape = "to long, kind int, level int, leaf boolean, code long, n long, x double, y double, mass double, radius double"
    others = dealt.repartition(parts, "to").groupBy("to").applyInArrow(show, shape)
    own = dealt.select("to", F.lit(B.OWN).alias("kind"), F.lit(0).alias("level"), F.lit(False).alias("leaf"), F.lit(0).cast("long").alias("code"), "n", "x", "y", "mass", "radius")
    return own.unionByName(others).repartition(parts, "to").groupBy("to").applyInArrow(push, "n long, fx double, fy double"), [dealt]


def attraction(points: DataFrame, ends: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(n, fx, fy) of the links between different points, a row for each end of a link of ``ends``: springs, weaker at nodes of many links, whose heavier end moves less."""
    end = lambda a: points.select(F.col("n").alias(a), *(F.col(c).alias(f"{a}_{c}") for c in ("x", "y", "mass", "degree")))
    both = ends.where("NOT same").select("s", "t").join(end("t"), "t").join(end("s"), "s")
    ux, uy, far = _towards(F.col("t_x") - F.col("s_x"), F.col("t_y") - F.col("s_y"), F.col("s") + F.col("t"))
    least = F.greatest(F.lit(1.0), F.least("s_degree", "t_degree"))
    pull = (F.col("far") - (s.link_distance + F.log2(least + 1) * 18)) * (s.link_strength / least)
    pulled = both.select("*", ux.alias("ux"), uy.alias("uy"), far.alias("far")).select("*", pull.alias("pull"))
    total = F.col("s_mass") + F.col("t_mass")
    far_ends = F.explode(F.array(*(F.struct(F.col(a).alias("n"), (sign * F.col("pull") * F.col(f"{b}_mass") / total).alias("f")) for a, b, sign in (("s", "t", 1.0), ("t", "s", -1.0)))))
    return pulled.select("ux", "uy", far_ends.alias("e")).select("e.n", (F.col("ux") * F.col("e.f")).alias("fx"), (F.col("uy") * F.col("e.f")).alias("fy"))


def _moved(points: DataFrame, ends: DataFrame, s: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """``points`` after one iteration, and the tables that this reads."""
    among, made = among_points(points, s)
    forces = among.unionByName(attraction(points, ends, s)).groupBy("n").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    moved = points.join(forces, "n", "left").fillna(0.0, ["fx", "fy"]).withColumn("far", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))
    scale = F.when(F.col("far") > s.max_step, s.max_step / F.col("far")).otherwise(1.0)
    return moved.select("id", "kind", "n", (F.col("x") + F.col("fx") * scale).alias("x"), (F.col("y") + F.col("fy") * scale).alias("y"), "z", "degree", "mass", "radius"), made


def step(points: DataFrame, links: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``points`` after one iteration; no coordinate pair moves by more than ``max_step``."""
    return _moved(points, linked(points, links), s)[0]


def layout(nodes: DataFrame, links: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id, kind, x, y, z) of ``nodes`` (id, kind; ids are unique) under ``links`` (src, dst).

    Each iteration is written to the shared folder, and the one before it is deleted with all that it read; only the last one stays. Fewer than two nodes, and more than ``most_points`` where that is set, keep their first places. Links that are listed twice pull twice.
    """
    if s.most_points is not None and s.most_points > MOST_POINTS:
        raise ValueError(f"a bound is at most {MOST_POINTS} nodes")
    at, made = _placed(nodes)
    first = materialise(at, "layout-first")
    drop(nodes.sparkSession, made)
    ends = materialise(linked(first, links), "layout-links")
    points = materialise(_weighed(first, ends, s), "layout")
    drop(nodes.sparkSession, first)
    n = points.count()
    if n >= 2 and (s.most_points is None or n <= s.most_points):
        for _ in range(s.iterations):
            moved, made = _moved(points, ends, s)
            before, points = points, materialise(moved, "layout")
            drop(nodes.sparkSession, before, *made)
    drop(nodes.sparkSession, ends)
    return points.select("id", "kind", "x", "y", "z")
