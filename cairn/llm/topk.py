"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Vectors are dealt to shards, whose trees are built once, and queries to blocks. A block
visits all trees, those with the highest bound first, and takes each query's current
k-th score from tree to tree. A node's upper bound for a query is q . centre + |q| radius;
each query opens its own best leaves first, then what its k-th score still leaves.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir, get, materialise, put
from .workers import releasing_group

SCALE = 1024
LEAF, SHARD_ROWS, QUERY_BLOCK = 128, 16_384, 4_096
#: Leaves of a tree that each query opens by its own order, before nodes are opened for all queries that still reach them.
FIRST = 4


class BallTree:
    """Nodes as arrays: centre, radius, and the rows (start, stop of ``order``) below; children of i are kids[i]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.x, self.span, self.kids, centres, radii = x, [], [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = x[self.order[a:b]]
            centre = own.mean(axis=0)
            gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(self.span)
            self.span.append((a, b))
            self.kids.append([])
            centres.append(centre)
            radii.append(float(gap.max()))
            if parent >= 0:
                self.kids[parent].append(me)
            if b - a > leaf and gap.max() > 0:
                # split halfway along the line between two far points
                p = own[gap.argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                mid = (b - a) // 2
                part = np.argpartition(own @ (q - p), mid)
                self.order[a:b] = self.order[a:b][part]
                stack += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)


def merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: high scores first, ties to the smaller id."""
    scores, ids = np.concatenate((scores, more), axis=1), np.concatenate((ids, more_ids), axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = -math.inf
FAR = (1 << 63) - 1


class Search:
    """The k best candidates of a block of queries, as trees are visited one after the other.

    ``floor`` is each query's current k-th score, shared by all trees: it only rises, and nodes whose bound is
    below it are never opened. Float products of whole numbers are exact below 2^53; where they could be larger,
    every candidate that rounding leaves possible is kept and scored in whole numbers at the end.
    """

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        n = len(queries)
        self.best, self.who, self.floor = np.full((n, k), NONE), np.full((n, k), FAR), np.full(n, NONE)
        self.norm = np.sqrt((queries ** 2).sum(axis=1))
        self.possible: list[list] = [[] for _ in range(n)]  # (id, vector) where products are rounded
        self.rounded = False

    def bounds(self, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """q . centre + |q| radius, with a margin for rounding, for queries (rows) and balls."""
        upper = self.queries @ centres.T + self.norm[:, None] * radii[None, :]
        size = self.norm[:, None] * (np.sqrt((centres ** 2).sum(axis=1)) + radii)[None, :]
        return upper + size * 1e-9 + 1

    def visit(self, tree: BallTree, ids: np.ndarray) -> None:
        """Each query opens the nodes of a tree that reach its floor, its own best leaves first."""
        upper = self.bounds(tree.centres, tree.radii)
        for node, kids in enumerate(tree.kids):  # parents come before their children
            for kid in kids:
                np.minimum(upper[:, kid], upper[:, node], out=upper[:, kid])
        width = max(1, self.queries.shape[1])
        most = float(np.abs(tree.x).max(initial=0)) * float(np.abs(self.queries).max(initial=0)) * width
        self.rounded |= most >= 2 ** 53
        error = self.norm * np.sqrt((tree.x ** 2).sum(axis=1).max(initial=0)) * width * 2.0 ** -50 if self.rounded else np.zeros(len(self.queries))
        leaves = np.array([n for n, kids in enumerate(tree.kids) if not kids])
        scored = np.zeros(upper.shape, bool)
        # each query's own best leaves first: they lift its floor
        wanted = leaves[np.argsort(-upper[:, leaves], axis=1, kind="stable")[:, :FIRST]]
        for turn in wanted.T:
            go = upper[np.arange(len(turn)), turn] >= self.floor
            for leaf in np.unique(turn[go]).tolist():
                which = np.flatnonzero(go & (turn == leaf))
                scored[which, leaf] = True
                self._leaf(which, tree.order[slice(*tree.span[leaf])], tree.x, ids, error)
        # then what their floors leave, from the root down, a node at once for all queries that reach it
        stack = [(0, np.arange(len(self.queries)))]
        while stack:
            node, which = stack.pop()
            which = which[(upper[which, node] >= self.floor[which]) & ~scored[which, node]]
            if not len(which):
                continue
            if tree.kids[node]:
                stack += [(kid, which) for kid in sorted(tree.kids[node], key=lambda kid: upper[which, kid].mean())]  # noqa: B023  read at once
            else:
                self._leaf(which, tree.order[slice(*tree.span[node])], tree.x, ids, error)

    def _leaf(self, which: np.ndarray, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, error: np.ndarray) -> None:
        got = self.queries[which] @ x[rows].T
        named = np.broadcast_to(ids[rows], got.shape)
        other = named != self.own[which][:, None]
        slack = error[which][:, None]
        near = other & (got + 2 * slack >= self.floor[which][:, None])
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        which, got, near, named, other, slack = which[some], got[some], near[some], named[some], other[some], slack[some]
        if self.rounded:
            for q, r in zip(*np.nonzero(near), strict=True):
                self.possible[which[q]].append((int(ids[rows[r]]), x[rows[r]]))
        self.best[which], self.who[which] = merge(self.best[which], self.who[which], np.where(other, got - slack, NONE), np.where(other, named, FAR), self.k)
        self.floor[which] = np.maximum(self.floor[which], self.best[which, self.k - 1])

    def answers(self) -> list[tuple[int, int, int, int]]:
        """(query, rank, id, score) of all queries."""
        out = []
        for q, me in enumerate(self.own.tolist()):
            if self.rounded:
                vector = [int(v) for v in self.queries[q]]
                found = sorted((-sum(a * int(b) for a, b in zip(vector, x, strict=True)), i) for i, x in self.possible[q])[: self.k]
                out += [(me, n, i, max(-FAR - 1, min(FAR, -s))) for n, (s, i) in enumerate(found, 1)]
            else:
                out += [(me, n, int(i), int(s)) for n, (s, i) in enumerate(zip(self.best[q], self.who[q], strict=True), 1) if s > NONE]
        return out


def scaled(column: Column) -> Column:
    """floor(SCALE * x) of each component as a double; null for a vector that is null or has a null or non-finite component."""
    sound = column.isNotNull() & F.coalesce(F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return F.when(sound, F.transform(column, lambda v: F.floor(v.cast("double") * SCALE).cast("double")))


def planted(ids: np.ndarray, x: np.ndarray, where: str) -> tuple[str, BallTree]:
    """Writes a shard's tree, with its vectors and ids, to a file."""
    tree, out = BallTree(x), io.BytesIO()
    np.savez(out, x=x, ids=ids, order=tree.order, span=np.array(tree.span), kids=np.array([k or [0, 0] for k in tree.kids]), centres=tree.centres, radii=tree.radii)
    put(uri := f"{where}/{uuid.uuid4().hex}.tree", out.getvalue())
    return uri, tree


def grown(content: bytes) -> tuple[BallTree, np.ndarray]:
    """The tree and the ids of a file."""
    got, tree = np.load(io.BytesIO(content)), BallTree.__new__(BallTree)
    tree.x, tree.order, tree.centres, tree.radii = (got[c] for c in ("x", "order", "centres", "radii"))
    tree.span, tree.kids = got["span"].tolist(), [[] if k == [0, 0] else k for k in got["kids"].tolist()]
    return tree, got["ids"]


def _matrix(table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column.flatten()) else np.zeros((len(column), 0))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score of each query's k best; queries are the ids divisible by ``every``.

    Vectors that are null or hold a null or non-finite component take no part, nor does a null id; vectors of
    different lengths never meet, however long they are; empty vectors score 0. Equal scores go to the smaller id. Rows repeating
    an id are candidates of their own but none for a query of their id; repeated query rows count once (the first by
    value). Scores are exact; one that no long holds is cut to the nearest long. An empty table gives an empty result;
    other columns play no part.

    Each shard's tree is built once and written to a file. A task has a block of queries and visits the trees in order of
    their balls' bounds, carrying each query's k-th score from tree to tree; no vector is copied for a block. The shards
    times blocks are the work that any exact search of a share of all rows needs.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vec_col)).alias("v")).where("id is not null and v is not null")
    rows = materialise(rows.withColumn("dim", F.size("v")), "topk-vectors")
    is_query = F.pmod("id", F.lit(every)) == 0
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("asked")).agg(F.max("n").alias("n"), F.max("asked").alias("asked")).first()
    if not counts["n"]:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score")).where("false")
    shards = max(1, -(-counts["n"] // shard_rows))
    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-counts["asked"] // query_block), min(parallel, counts["asked"] // 64))
    where = fresh_dir(spark, "topk-trees")

    def plant(table: pa.Table) -> pa.Table:
        uri, tree = planted(table.column("id").to_numpy(), _matrix(table, "v"), where)
        return pa.table({"dim": table.column("dim").slice(0, 1), "uri": [uri], "centre": pa.array([tree.centres[0].tolist()], pa.list_(pa.float64())), "radius": [float(tree.radii[0])]})

    # rows that repeat an id are dealt apart too
    shard = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    trees = materialise(rows.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(releasing_group(plant), "dim int, uri string, centre array<double>, radius double"), "topk-shards")
    queries = rows.where(is_query).groupBy("id", "dim").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), (id_col, pa.int64()), ("score", pa.int64())])

    def ask(asked: pa.Table, shown: pa.Table) -> pa.Table:
        if not asked.num_rows or not shown.num_rows:
            return schema.empty_table()
        search = Search(_matrix(asked, "v"), asked.column("id").to_numpy(), k)
        bounds = search.bounds(_matrix(shown, "centre"), shown.column("radius").to_numpy())
        uris = shown.column("uri").to_pylist()
        for at in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
            if (bounds[:, at] >= search.floor).any():
                search.visit(*grown(get(uris[at])))
        found = search.answers()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else schema.empty_table()

    # a row for each block of each tree: its ball and where it lies, no vectors
    shown = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n = max(parallel, min(1 << 16, blocks))  # few rows are much work: small partitions aren't put together
    return queries.repartition(n, "dim", "block").groupBy("dim", "block").cogroup(shown.repartition(n, "dim", "block").groupBy("dim", "block")).applyInArrow(releasing_group(ask), f"query_id long, rank int, `{id_col}` long, score long")
