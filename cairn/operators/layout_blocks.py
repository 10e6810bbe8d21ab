"""Forces on the points of one block, a cell of the layout's quadtree, in numpy: from its own points and from what other blocks show it.

A block needs little of the others: cells that one of its points may come to on its walk down the tree, which get coarser
with their distance, and points near enough to touch one of its own. So what blocks exchange grows with the points.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

GOLDEN_ANGLE = 2.399963229728653
#: Kinds of rows that a block gets: its points, points of others that may touch them, and cells of others.
OWN, NEAR, CELL = range(3)
#: Points that walk at once, those that look for neighbours at once, and pairs that are compared at once.
WALKERS, TILE, PAIRS = 1024, 64, 131_072


class Cells(NamedTuple):
    """Cells of one level in order of code, the interleaved bits of their place; ``first`` is the smallest point of a leaf."""
    code: np.ndarray
    mass: np.ndarray
    x: np.ndarray
    y: np.ndarray
    first: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(*parts: Cells) -> Cells:
        whole = [np.concatenate(c) for c in zip(*parts)]
        order = np.argsort(whole[0])
        return Cells(*(c[order] for c in whole))


class Square(NamedTuple):
    """The root and the depth of the tree."""
    left: float
    bottom: float
    width: float
    height: float
    depth: int


class Blocks(NamedTuple):
    """All blocks: their cells, and the box, number, mass, centre, smallest number and largest radius of their points."""
    level: np.ndarray
    code: np.ndarray
    points: np.ndarray
    mass: np.ndarray
    x: np.ndarray
    y: np.ndarray
    first: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    y0: np.ndarray
    y1: np.ndarray
    radius: np.ndarray

    def gap(self, b, x, y):
        """Distance of places from the box of block ``b``."""
        return np.hypot(np.maximum(np.maximum(self.x0[b] - x, x - self.x1[b]), 0), np.maximum(np.maximum(self.y0[b] - y, y - self.y1[b]), 0))


def interleaved(cx: np.ndarray, cy: np.ndarray, depth: int) -> np.ndarray:
    code = np.zeros(len(cx), np.int64)
    for bit in range(depth):
        code |= ((cx >> bit) & 1) << (2 * bit + 1) | ((cy >> bit) & 1) << (2 * bit)
    return code


def codes(x: np.ndarray, y: np.ndarray, q: Square) -> np.ndarray:
    """Codes of the deepest cells."""
    cell = lambda c, low, side: np.minimum(np.floor((c - low) / side * (1 << q.depth)), (1 << q.depth) - 1).astype(np.int64)
    return interleaved(cell(x, q.left, q.width), cell(y, q.bottom, q.height), q.depth)


def below(level: int, q: Square, n, x, y, mass) -> dict[int, Cells]:
    """The cells under a block of ``level``, by level; cells of one point are parted no more."""
    code = codes(x, y, q)
    order = np.argsort(code, kind="stable")
    code, n, x, y, mass = (c[order] for c in (code, n, x, y, mass))
    out = {}
    for deeper in range(level + 1, q.depth + 1) if len(n) > 1 else ():
        at = code >> 2 * (q.depth - deeper)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        points = np.diff(np.r_[starts, len(at)])
        total = np.add.reduceat(mass, starts)
        out[deeper] = Cells(at[starts], total, np.add.reduceat(x * mass, starts) / total, np.add.reduceat(y * mass, starts) / total, np.minimum.reduceat(n, starts), (points == 1) | (deeper == q.depth))
        more = np.repeat(points > 1, points)
        if not more.any():
            break
        code, n, x, y, mass = (c[more] for c in (code, n, x, y, mass))
    return out


def above(blocks: Blocks, q: Square) -> dict[int, Cells]:
    """The cells of all blocks and those over them, by level."""
    out, under = {}, None
    for level in range(int(blocks.level.max()), -1, -1):
        here = blocks.level == level
        cells = Cells(*(c[here] for c in (blocks.code, blocks.mass, blocks.x, blocks.y, blocks.first)), (blocks.points[here] == 1) | (level == q.depth))
        if under is not None:
            at, group = np.unique(under.code >> 2, return_inverse=True)
            total = np.bincount(group, under.mass)
            parents = Cells(at, total, np.bincount(group, under.x * under.mass) / total, np.bincount(group, under.y * under.mass) / total, np.full(len(at), -1), np.zeros(len(at), bool))
            cells = Cells.of(cells, parents)
        out[level] = under = Cells.of(cells)
    return out


def _opens(q: Square, level, far, theta: float):
    """Whether cells of ``level`` at distance ``far`` give way to their children."""
    return ~(q.width / 2.0 ** level / np.maximum(far, 1.0) < theta)


def shown(b: int, blocks: Blocks, q: Square, theta: float, n, x, y, mass, radius) -> dict[str, np.ndarray]:
    """Rows of block ``b`` for other blocks. Distances from their boxes, which no point is nearer than, decide, so rows may be more than are used but never fewer."""
    rows = []
    level = int(blocks.level[b])
    slack = 1 - 1e-9
    others = np.arange(len(blocks.level)) != b
    tree = below(level, q, n, x, y, mass)
    if tree:
        for to in np.flatnonzero(others & _opens(q, level, blocks.gap(slice(None), blocks.x[b], blocks.y[b]) * slack, theta)):
            parents = blocks.code[b:b + 1]
            for deeper, cells in tree.items():
                at = np.flatnonzero(np.isin(cells.code >> 2, parents))
                if not len(at):
                    break
                rows.append((to, CELL, deeper, cells.leaf[at], cells.code[at], np.full(len(at), -1), cells.x[at], cells.y[at], cells.mass[at], np.zeros(len(at))))
                opened = ~cells.leaf[at] & _opens(q, deeper, blocks.gap(to, cells.x[at], cells.y[at]) * slack, theta)
                parents = cells.code[at][opened]
    apart = np.hypot(np.maximum(np.maximum(blocks.x0 - blocks.x1[b], blocks.x0[b] - blocks.x1), 0), np.maximum(np.maximum(blocks.y0 - blocks.y1[b], blocks.y0[b] - blocks.y1), 0))
    for to in np.flatnonzero(others & (apart * slack < blocks.radius + blocks.radius[b])):
        at = np.flatnonzero(blocks.gap(to, x, y) * slack < blocks.radius[to] + radius)
        rows.append((to, NEAR, 0, np.zeros(len(at), bool), np.zeros(len(at), np.int64), n[at], x[at], y[at], mass[at], radius[at]))
    names = ("to", "kind", "level", "leaf", "code", "n", "x", "y", "mass", "radius")
    types = (np.int64, np.int32, np.int32, bool, np.int64, np.int64, *[np.float64] * 4)
    return {name: np.concatenate([np.broadcast_to(r[k], len(r[3])) for r in rows]).astype(t) if rows else np.zeros(0, t) for k, (name, t) in enumerate(zip(names, types))}


def repelled(n, x, y, mass, tree: dict[int, Cells], q: Square, theta: float, strength: float):
    """What the cells of ``tree`` do to each point."""
    fx, fy = np.zeros(len(n)), np.zeros(len(n))
    levels = [tree[k] for k in sorted(tree)]
    ways = [(np.searchsorted(b.code, a.code << 2), np.searchsorted(b.code, (a.code + 1) << 2)) for a, b in zip(levels, levels[1:])]
    for start in range(0, len(n), WALKERS):
        own = slice(start, start + WALKERS)
        pn, px, py, pm = n[own], x[own], y[own], mass[own] * strength
        p, c = np.arange(len(pn)), np.zeros(len(pn), np.int64)
        for level, cells in enumerate(levels):
            dx, dy = px[p] - cells.x[c], py[p] - cells.y[c]
            far = np.sqrt(dx * dx + dy * dy)
            leaf = cells.leaf[c]
            opened = ~leaf & _opens(q, level, far, theta)
            met = ~opened & ~(leaf & (cells.first[c] == pn[p]))
            at, to, dx, dy, far = p[met], c[met], dx[met], dy[met], far[met]
            force = pm[at] * cells.mass[to] / np.maximum(far * far, 64.0)
            close = np.flatnonzero(~(far > 0.0001))
            if len(close):  # these have a direction of their own
                dx[close], dy[close], far[close] = np.cos(pn[at[close]] * GOLDEN_ANGLE), np.sin(pn[at[close]] * GOLDEN_ANGLE), 1.0
            force /= far
            fx[own] += np.bincount(at, dx * force, len(pn))
            fy[own] += np.bincount(at, dy * force, len(pn))
            p, c = p[opened], c[opened]
            if not len(p):
                break
            if level == len(ways):
                raise ValueError("a cell that gives way has no children")
            low, high = ways[level][0][c], ways[level][1][c]
            children = high - low
            if not children.all():
                raise ValueError("a cell that gives way has no children")
            p = np.repeat(p, children)
            c = np.repeat(low - np.cumsum(children) + children, children) + np.arange(len(p))
    return fx, fy


def collided(own: tuple, all_: tuple, cell: float):
    """What touching points among ``all_`` (n, x, y, radius; they include ``own``) do to each point of ``own``; points touch in neighbouring cells of the grid only.

    A pair pushes by 0.58 * (reach / far - 1) times its difference of places. That factor is kept at 0 or more, so no pair needs a mask, and the sum over a point's pairs is a product of matrices.
    """
    n, x, y, radius = own
    fx, fy = np.zeros(len(n)), np.zeros(len(n))
    strip = np.empty(len(n), np.int64)
    strip[np.argsort(x, kind="stable")] = np.arange(len(n)) // max(TILE, int((len(n) * TILE) ** 0.5))
    order = np.lexsort((y, strip))
    room = [np.empty(0) for _ in range(3)]
    for start in range(0, len(n), TILE):
        tile = order[start:start + TILE]
        x0, x1, y0, y1, most = x[tile].min(), x[tile].max(), y[tile].min(), y[tile].max(), radius[tile].max()
        gap_x, gap_y = np.maximum(np.maximum(x0 - all_[1], all_[1] - x1), 0), np.maximum(np.maximum(y0 - all_[2], all_[2] - y1), 0)
        m, ox, oy, oradius = (c[(gap_x * gap_x + gap_y * gap_y) * (1 - 1e-9) < (all_[3] + most) ** 2] for c in all_)
        places = np.stack([np.ones(len(m)), ox - x0, oy - y0], 1)
        rows = max(1, min(len(tile), PAIRS // max(1, len(m))))
        for k in range(0, len(tile), rows):
            at = tile[k:k + rows]
            size = len(at) * len(m)
            if len(room[0]) < size:
                room = [np.empty(size) for _ in range(3)]
            far, other, reach = (c[:size].reshape(len(at), len(m)) for c in room)
            np.subtract(x[at, None], ox, out=far)
            np.multiply(far, far, out=far)
            np.subtract(y[at, None], oy, out=other)
            np.multiply(other, other, out=other)
            np.add(far, other, out=far)
            np.sqrt(far, out=far)
            np.add(radius[at, None], oradius, out=reach)
            if most + oradius.max() > cell:
                for mine, others in ((x[at], ox), (y[at], oy)):
                    reach[np.abs(np.floor(mine / cell)[:, None] - np.floor(others / cell)) > 1] = 0
            close = np.flatnonzero(~(far.ravel() > 0.0001))  # a point and itself, and points that have a direction of their own
            i, j = np.divmod(close, len(m))
            push = 0.58 * np.maximum(reach.ravel()[close] - far.ravel()[close], 0) * np.sign(m[j] - n[at][i])
            angle = (n[at][i] + m[j]) * GOLDEN_ANGLE
            far.ravel()[close] = reach.ravel()[close] = 1.0
            np.maximum(reach, far, out=reach)
            np.divide(reach, far, out=reach)
            held, to_x, to_y = (reach @ places - places.sum(0)).T
            fx[at] = 0.58 * ((x[at] - x0) * held - to_x) + np.bincount(i, np.cos(angle) * push, len(at))
            fy[at] = 0.58 * ((y[at] - y0) * held - to_y) + np.bincount(i, np.sin(angle) * push, len(at))
    return fx, fy


def forces(b: int, rows: dict[str, np.ndarray], blocks: Blocks, over: dict[int, Cells], q: Square, theta: float, strength: float, cell: float):
    """(n, fx, fy) of the points of block ``b`` by ``rows``: its points and what others show it."""
    of = lambda kind, *names: tuple(rows[name][rows["kind"] == kind] for name in names)
    n, x, y, mass, radius = of(OWN, "n", "x", "y", "mass", "radius")
    parts = {level: [cells] for level, cells in over.items()}
    for level, cells in below(int(blocks.level[b]), q, n, x, y, mass).items():
        parts.setdefault(level, []).append(cells)
    levels, *theirs = of(CELL, "level", "code", "mass", "x", "y", "n", "leaf")
    for level in np.unique(levels):
        parts.setdefault(int(level), []).append(Cells(*(c[levels == level] for c in theirs)))
    order = np.argsort(codes(x, y, q))  # neighbours walk together
    n, x, y, mass, radius = (c[order] for c in (n, x, y, mass, radius))
    rx, ry = repelled(n, x, y, mass, {level: Cells.of(*cells) for level, cells in parts.items()}, q, theta, strength)
    cx, cy = collided((n, x, y, radius), tuple(np.concatenate(c) for c in zip((n, x, y, radius), of(NEAR, "n", "x", "y", "radius"))), cell)
    return n, rx + cx, ry + cy
