"""Queries on edges, region growing, circle and line votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import votes
from ..operators import raster as ops
from . import fixtures as fx
from .pixels import NEAR_SQL, R, f6

BRIGHT = 150

def _double(spark, d):
    return fx.raster(spark, d).withColumn("v", F.col("v").cast("double"))


def gradient(spark, d):
    g = votes.gradient(_double(spark, d), 1.0, 1.0)
    return g.withColumn("v", fixed("v")).withColumn("orient", fixed("orient"))


def thin_edges(spark, d):
    g = votes.gradient(_double(spark, d), 1.0, 1.0)
    return votes.thin(g).drop("w", "h").withColumn("v", fixed("v"))


def region_grow(spark, d):
    return votes.grow_regions(fx.raster(spark, d), 220, 160).select("image_id", "y", "x")


def _edges(spark, d):
    return ops.sized(fx.raster(spark, d)).where(F.col("v") > BRIGHT)


def _circle_votes(spark, d):
    sizes = ops.image_sizes(fx.raster(spark, d))
    radii = sizes.select("image_id", F.lit(2).alias("base"),
                         (F.col("image_id") % 3 + 2).cast("int").alias("planes"))
    return votes.circle_votes(_edges(spark, d), radii)


def circle_votes(spark, d):
    return _circle_votes(spark, d)


def circle_best(spark, d):
    return votes.best_circle(_circle_votes(spark, d))


def _line_votes(spark, d):
    return votes.line_votes(_edges(spark, d))


def line_votes(spark, d):
    return _line_votes(spark, d).withColumn("mass", fixed("mass"))


def line_best(spark, d):
    lines = votes.strongest_lines(_line_votes(spark, d), ops.image_sizes(fx.raster(spark, d)), 5)
    for c in "abc":
        lines = lines.withColumn(c, fixed(c))
    return lines


def line_extents(spark, d):
    sizes = ops.image_sizes(fx.raster(spark, d))
    lines = votes.strongest_lines(_line_votes(spark, d), sizes, 5)
    origins = sizes.select("image_id", F.lit(3).alias("ox"), F.col("image_id").alias("oy"))
    return votes.line_extents(lines, origins)


# ------------------------------------------------------------------------ SQL

_G = "coalesce({0}, 0)::DOUBLE".format
GRADIENT_SQL = f"""{R}, {NEAR_SQL},
diffs AS (
  SELECT image_id, y, x, {_G('e0')} - {_G('w0')} AS h, {_G('s0')} - {_G('n0')} AS g, {_G('se')} - {_G('nw')} AS d1,
    {_G('ne')} - {_G('sw')} AS d2 FROM ring),
xy AS (SELECT image_id, y, x, (h + (d1 + d2) / 2) AS gx, (g + (d1 - d2) / 2) AS gy FROM diffs),
gradient AS (
  SELECT image_id, y, x, sqrt(gx * gx + gy * gy) AS v,
    CASE WHEN gy = 0 THEN 0e0 WHEN atan2(-gy, gx) < 0 THEN atan2(-gy, gx) + 3.14159265358979::DOUBLE ELSE atan2(-gy, gx) END
      / 3.14159265358979::DOUBLE * 180 AS orient FROM xy)"""

TAPS_SQL = """angles AS (
  SELECT d::INTEGER AS degree, 1.5e0 * cos(d * 3.14159265358979::DOUBLE / 180) AS xo, 1.5e0 * sin(d * 3.14159265358979::DOUBLE / 180) AS yo
  FROM range(181) t(d)),
tap_aims(degree, fx, fy, dx, dy, side) AS (
  SELECT degree, xo - floor(xo), yo - floor(yo), s * CASE WHEN degree = 90 THEN 0 ELSE xo END,
    -s * CASE WHEN degree = 180 THEN 0 ELSE yo END, s FROM angles, (VALUES (1), (-1)) t(s)),
taps AS (
  SELECT degree, side, fx, fy, k, (CASE WHEN k % 2 = 0 THEN floor(dx) ELSE ceil(dx) END)::INTEGER AS dx,
    (CASE WHEN k < 2 THEN floor(dy) ELSE ceil(dy) END)::INTEGER AS dy FROM tap_aims, range(4) q(k))"""

EDGES_SQL = f"""{R}, edges AS (SELECT image_id, y, x FROM raster WHERE v > {BRIGHT})"""
CIRCLE_VOTES_SQL = f"""{EDGES_SQL},
arcs AS (SELECT rad, i, trunc(rad * sqrt(1 - i * i / (rad * rad)::DOUBLE) + 0.5)::BIGINT AS j
  FROM range(3, 7) a(rad), range(0, 8) b(i) WHERE i <= trunc(rad / 1.4142::DOUBLE)),
offs AS (SELECT DISTINCT rad, dy, dx FROM (
  SELECT rad, s * i AS dy, t * j AS dx FROM arcs, (VALUES (1), (-1)) p(s), (VALUES (1), (-1)) q(t)
  UNION ALL SELECT rad, s * j, t * i FROM arcs, (VALUES (1), (-1)) p(s), (VALUES (1), (-1)) q(t))),
votes AS (
  SELECT e.image_id, (o.rad - 3)::INTEGER AS plane, (e.y + o.dy)::INTEGER AS y, (e.x + o.dx)::INTEGER AS x, count(*) AS votes
  FROM edges e JOIN sizes s USING (image_id) JOIN offs o ON o.rad - 3 < e.image_id % 3 + 2
  WHERE e.y + o.dy BETWEEN 0 AND s.h - 1 AND e.x + o.dx BETWEEN 0 AND s.w - 1 GROUP BY ALL)"""
LINE_VOTES_SQL = f"""{EDGES_SQL},
frame AS (SELECT image_id, w, h, (w - 1) // 2 AS xo, (h - 1) // 2 AS yo FROM sizes),
quarter AS (
  SELECT e.image_id, e.x - xo + sx * 0.25::DOUBLE AS px, (h - 1 - e.y) - yo + sy * 0.25::DOUBLE AS py, k AS angle,
    ceil(sqrt(((h - 1 - yo) * (h - 1 - yo) + (w - 1 - xo) * (w - 1 - xo))::DOUBLE)) + 1 AS last
  FROM edges e JOIN frame USING (image_id), (VALUES (-1), (1)) a(sx), (VALUES (-1), (1)) b(sy), range(180) c(k)),
spot AS (SELECT *, px * cos(angle * (3.14159265358979::DOUBLE / 180)) + last + py * sin(angle * (3.14159265358979::DOUBLE / 180)) AS p FROM quarter),
halves AS (
  SELECT image_id, angle, last, floor(p) AS b, 0.25::DOUBLE * (1 - p + floor(p)) AS m FROM spot
  UNION ALL SELECT image_id, angle, last, floor(p) + 1, 0.25::DOUBLE - 0.25::DOUBLE * (1 - p + floor(p)) FROM spot),
line_mass AS (SELECT image_id, angle::INTEGER AS angle, (b - last)::INTEGER AS r, {f6('sum(m)', 9)} AS mass FROM halves
  GROUP BY image_id, angle, b - last HAVING {f6('sum(m)', 9)} > 0),
tops AS (SELECT image_id, max(mass) AS top FROM line_mass GROUP BY ALL),
lines AS (
  SELECT l.image_id, (row_number() OVER (PARTITION BY l.image_id ORDER BY r, angle) - 1)::INTEGER AS n, angle, r, w, h,
    cos(-angle * 3.14159265358979::DOUBLE / 180) AS a, sin(-angle * 3.14159265358979::DOUBLE / 180) AS b
  FROM line_mass l JOIN tops t ON t.image_id = l.image_id AND t.top = l.mass AND t.top > 5 JOIN sizes s ON s.image_id = l.image_id),
full_lines AS (SELECT *, -r - a * (w / 2 - 1) - b * (h / 2 - 1) AS c FROM lines)"""

QUERIES = {f.__name__: f for f in (
    gradient, thin_edges, region_grow, circle_votes, circle_best, line_votes, line_best,
    line_extents)}

ORACLES = {
    "gradient": f"WITH {GRADIENT_SQL} SELECT image_id, y, x, {f6('v')} AS v, {f6('orient')} AS orient FROM gradient",
    "thin_edges": f"""WITH {GRADIENT_SQL}, {TAPS_SQL},
looks AS (
  SELECT g.image_id, g.y, g.x, side, any_value(g.v) AS v, any_value(fx) AS fx, any_value(fy) AS fy, max(q.v) FILTER (k = 0) AS tl,
    max(q.v) FILTER (k = 1) AS tr, max(q.v) FILTER (k = 2) AS bl, max(q.v) FILTER (k = 3) AS br
  FROM gradient g JOIN taps t ON t.degree = trunc(g.orient + 5e-13)::INTEGER
  LEFT JOIN gradient q ON q.image_id = g.image_id AND q.x = g.x + t.dx AND q.y = g.y + t.dy GROUP BY g.image_id, g.y, g.x, side),
tops AS (
  SELECT image_id, y, x, any_value(v) AS v, bool_and(v > (tl + fx * (tr - tl)) + fy * ((bl + fx * (br - bl)) - (tl + fx * (tr - tl)))) AS top
  FROM looks GROUP BY image_id, y, x)
SELECT s.image_id, s.y, s.x, {f6("CASE WHEN s.x BETWEEN 2 AND z.w - 3 AND s.y BETWEEN 2 AND z.h - 3 AND top THEN s.v ELSE 0 END")} AS v
FROM tops s JOIN sizes z USING (image_id)""",
    "region_grow": f"""WITH RECURSIVE {R},
strong AS (SELECT r.image_id, y, x, v, y * w + x AS i, w, w * h AS n FROM raster r JOIN sizes USING (image_id) WHERE v > 160),
grown AS (
  SELECT image_id, y, x FROM strong WHERE v > 220
  UNION
  SELECT s.image_id, s.y, s.x FROM grown g
  JOIN strong f ON f.image_id = g.image_id AND f.y = g.y AND f.x = g.x AND f.i > f.w AND f.i < f.n - f.w - 1
  JOIN strong s ON s.image_id = g.image_id AND abs(s.y - g.y) <= 1 AND abs(s.x - g.x) <= 1)
SELECT * FROM grown""",
    "circle_votes": f"WITH {CIRCLE_VOTES_SQL} SELECT * FROM votes",
    "circle_best": f"""WITH {CIRCLE_VOTES_SQL} SELECT image_id, votes, plane, y, x FROM votes
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, plane, x, y) = 1""",
    "line_votes": f"WITH {LINE_VOTES_SQL} SELECT image_id, angle, r, {f6('mass')} AS mass FROM line_mass",
    "line_best": f"""WITH {LINE_VOTES_SQL} SELECT image_id, n, angle, r, {f6('a')} AS a, {f6('b')} AS b, {f6('c')} AS c, w, h FROM full_lines""",
    "line_extents": f"""WITH {LINE_VOTES_SQL},
heights AS (
  SELECT image_id, trunc(least(greatest((-c - a * i) / b, 1), h) + 5e-13)::INTEGER AS y FROM full_lines, range(1, 65) t(i) WHERE n = 0),
spans AS (SELECT image_id, min(y) AS low, max(y) AS high FROM heights GROUP BY ALL)
SELECT s.image_id, 3 AS ox, s.image_id AS oy, low + s.image_id AS low, high + s.image_id AS high
FROM sizes s LEFT JOIN spans p USING (image_id)""",
}
