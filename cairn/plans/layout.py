"""Queries of the force-directed layout; the SQL of one iteration walks the tree by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as Y
from .registry import query

_PLACES = """u AS (SELECT id, kind, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, length(id)), lambda i: ascii(substr(id, i + 1, 1))::UBIGINT)),
    lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS h, coalesce(list_position(['Repository', 'File', 'Symbol', 'Variable'], kind), 5) - 1 AS k FROM {node}),
  o AS (SELECT *, row_number() OVER (ORDER BY id, kind) - 1 AS n FROM u),
  a AS (SELECT *, n * 2.399963229728653::DOUBLE + (h & 65535) / 65535.0::DOUBLE * (2 * pi()) AS angle, sqrt(n + 1.0::DOUBLE) * CASE WHEN n > 250000 THEN 2.9::DOUBLE WHEN n > 100000 THEN 3.6::DOUBLE ELSE 5.4::DOUBLE END + k * 240.0::DOUBLE AS r FROM o),
  p0 AS (SELECT id, kind, n, cos(angle) * r AS x, sin(angle) * r AS y, (k - 2.0::DOUBLE) * 260.0::DOUBLE + (((h >> 16) & 65535) / 65535.0::DOUBLE - 0.5::DOUBLE) * 900 AS z FROM a)"""


def _toward(dx: str, dy: str, number: str) -> str:
    far = f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"
    return (f"CASE WHEN {far} > 0.0001 THEN ({dx}) / {far} ELSE cos(({number}) * 2.399963229728653::DOUBLE) END AS ux, CASE WHEN {far} > 0.0001 THEN ({dy}) / {far} ELSE sin(({number}) * 2.399963229728653::DOUBLE) END AS uy, "
            f"CASE WHEN {far} > 0.0001 THEN {far} ELSE 0.0001::DOUBLE END AS far")


_STEP = f"""{_PLACES}, links AS (SELECT src, dst FROM {{edge}} WHERE src IN (SELECT id FROM p0) AND dst IN (SELECT id FROM p0)),
  deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id),
  p AS (SELECT p0.*, coalesce(degree, 0)::DOUBLE AS degree, 1 + log2(coalesce(degree, 0)::DOUBLE + 1) * 1.7::DOUBLE AS mass, 18 + log2(coalesce(degree, 0)::DOUBLE + 1) * 8 + 22.0::DOUBLE AS radius FROM p0 LEFT JOIN deg ON p0.id = deg.id),
  b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h, greatest(max(x) - min(x), max(y) - min(y), 1.0::DOUBLE) * 0.05::DOUBLE + 1 AS m FROM p),
  c AS (SELECT n, x, y, mass, w + 2 * m AS width, least(floor((x - (x0 - m)) / (w + 2 * m) * 65536), 65535)::BIGINT AS cx, least(floor((y - (y0 - m)) / (h + 2 * m) * 65536), 65535)::BIGINT AS cy FROM p, b),
  t AS (SELECT level, cx >> (16 - level) AS tx, cy >> (16 - level) AS ty, count(*) = 1 OR level = 16 AS leaf, sum(mass) AS cell_mass, sum(x * mass) / sum(mass) AS gx, sum(y * mass) / sum(mass) AS gy, min(n) AS first
    FROM c, (SELECT unnest(range(0, 17))::INT AS level) GROUP BY level, cx >> (16 - level), cy >> (16 - level)),
  v AS (SELECT c.n, c.x, c.y, c.mass, c.width, t.level, t.tx, t.ty, t.leaf, t.cell_mass, t.first, {_toward("c.x - t.gx", "c.y - t.gy", "c.n")} FROM c JOIN t ON t.level = 0
    UNION ALL SELECT v.n, v.x, v.y, v.mass, v.width, t.level, t.tx, t.ty, t.leaf, t.cell_mass, t.first, {_toward("v.x - t.gx", "v.y - t.gy", "v.n")}
    FROM v JOIN t ON t.level = v.level + 1 AND t.tx // 2 = v.tx AND t.ty // 2 = v.ty WHERE NOT v.leaf AND NOT v.width / pow(2, v.level) / greatest(v.far, 1) < 0.72::DOUBLE),
  f1 AS (SELECT n, ux * (1500.0::DOUBLE * mass * cell_mass / greatest(far * far, 64.0::DOUBLE)) AS fx, uy * (1500.0::DOUBLE * mass * cell_mass / greatest(far * far, 64.0::DOUBLE)) AS fy FROM v
    WHERE NOT (leaf AND first = n) AND (leaf OR width / pow(2, level) / greatest(far, 1) < 0.72::DOUBLE)),
  l AS (SELECT s.n AS sn, t.n AS tn, s.mass AS sm, t.mass AS tm, greatest(1.0::DOUBLE, least(s.degree, t.degree)) AS least, {_toward("t.x - s.x", "t.y - s.y", "s.n + t.n")} FROM links JOIN p s ON src = s.id JOIN p t ON dst = t.id WHERE src <> dst),
  q AS (SELECT *, (far - (210.0::DOUBLE + log2(least + 1) * 18)) * (0.035::DOUBLE / least) AS pull FROM l),
  f2 AS (SELECT sn AS n, ux * pull * tm / (sm + tm) AS fx, uy * pull * tm / (sm + tm) AS fy FROM q UNION ALL SELECT tn, -ux * pull * sm / (sm + tm), -uy * pull * sm / (sm + tm) FROM q),
  k AS (SELECT i.n AS n, j.n AS m, i.radius + j.radius AS reach, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS d, {_toward("i.x - j.x", "i.y - j.y", "i.n + j.n")} FROM p i JOIN p j
    ON j.n > i.n AND (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) < (i.radius + j.radius) * (i.radius + j.radius) AND abs(floor(i.x / 260) - floor(j.x / 260)) <= 1 AND abs(floor(i.y / 260) - floor(j.y / 260)) <= 1),
  f3 AS (SELECT n, ux * (reach - d) * 0.58::DOUBLE AS fx, uy * (reach - d) * 0.58::DOUBLE AS fy FROM k UNION ALL SELECT m, -ux * (reach - d) * 0.58::DOUBLE, -uy * (reach - d) * 0.58::DOUBLE FROM k),
  f AS (SELECT n, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY n),
  g AS (SELECT p.*, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, sqrt(coalesce(fx, 0) * coalesce(fx, 0) + coalesce(fy, 0) * coalesce(fy, 0)) AS far FROM p LEFT JOIN f USING (n))
  SELECT id, kind, round(x + fx * CASE WHEN far > 95 THEN 95 / far ELSE 1 END, 3) AS x, round(y + fy * CASE WHEN far > 95 THEN 95 / far ELSE 1 END, 3) AS y, round(z, 3) AS z FROM g"""

_rounded = lambda df: df.select("id", "kind", *(F.round(c, 3).alias(c) for c in "xyz"))
query("g14_first_places", f"WITH {_PLACES} SELECT id, kind, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM p0")(lambda g: _rounded(Y.placed(g.node)))
query("g14_iteration", f"WITH RECURSIVE {_STEP}")(lambda g: _rounded(Y.layout(g.node, g.edge, Y.Settings(iterations=1, most_points=None))))
query("g14_layout", None)(lambda g: _rounded(Y.layout(g.node, g.edge, Y.Settings(most_points=None))))
