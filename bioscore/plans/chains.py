"""Queries on whole chains of operators, and SQL twins of these chains.

The twins search edges, circles and lines step by step: windows for smoothing and gradients,
a stepping recursion for resizing, neighbour joins for thinning, a recursion over pixels for
region growing, and group-bys for votes.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import build, jobs, masks, votes
from . import fixtures as fx
from .encoding import (
    ANGULAR,
    BAND_SQL,
    FIXED_BITS_SQL,
    RADIAL,
    RANKED_SQL,
    SMALL,
    WAVELENGTH,
    _grid_sql,
    _pack_sql,
    _response_sql,
    _words,
)
from .pixels import R, f6
from .segmentation import CIRCLE_SQL, _anchor_sql, _lim
from .voting import TAPS_SQL

PI_SQL = "3.14159265358979::DOUBLE"
IRIS = {"r_low": 20, "r_high": 32, "scaling": 0.5, "high": 0.3, "low": 0.25, "vert": 1.0, "horz": 0.0}
PUPIL = {"r_low": 6, "r_high": 12, "scaling": 0.8, "high": 0.35, "low": 0.3, "vert": 1.0, "horz": 1.0}
LINES = {"least": 5.0, "high": 0.2, "low": 0.15}


def _double(raster):
    return raster.withColumn("v", F.col("v").cast("double"))


def find_circle(spark, d):
    r = _double(fx.raster(spark, d))
    limits = r.select("image_id", F.lit(8).alias("r_low"), F.lit(15).alias("r_high")).distinct()
    return votes.find_circle(r, limits, 0.8, 0.25, 0.2, 1.0, 0.0)


def find_circle_by_sensor(spark, d):
    """Images of several sensors, each with its own scaling and radii, in one search."""
    parameters = jobs.sensor_parameters(fx.eye_sensors(spark, d))
    limits = parameters.select("image_id", F.lit(15).alias("r_low"), F.col("iris_max").alias("r_high"), "scaling")
    return votes.find_circle(_double(fx.eyes(spark, d)), limits, None, 0.3, 0.25, 1.0, 0.0)


def find_lines(spark, d):
    lines = votes.find_lines(_double(fx.raster(spark, d)), **LINES)
    for c in "abc":
        lines = lines.withColumn(c, fixed(c))
    return lines


def segmentation(spark, d):
    circles, noisy = votes.segment(_double(fx.eyes(spark, d)), IRIS, PUPIL, highlight=200, **LINES)
    return circles.join(noisy.groupBy("image_id").agg(
        F.count("*").alias("pixels"), F.sum(F.col("noise").cast("int")).alias("noisy")), "image_id")


def eyelid_search(spark, d):
    found = votes.eyelid_search(_double(fx.raster(spark, d)), fx.circles(spark, d), **LINES)
    return masks.eyelid_anchors(found)


def locate_eyes_by_sensor(spark, d):
    """Pupils and irises of images of several sensors in one plan."""
    return jobs.locate_eyes(_double(fx.eyes(spark, d)), fx.eye_candidates(spark, d),
                            jobs.sensor_parameters(fx.eye_sensors(spark, d)), 0.3, 0.25)


def build_by_sensor(spark, d):
    """The automatic build over a table with several sensors, on a small polar grid."""
    return _words(jobs.build_automatic(
        _double(fx.eyes(spark, d)), fx.eye_candidates(spark, d), fx.eye_sensors(spark, d),
        search={"high": 0.3, "low": 0.25}, lines=LINES, sigma=0.55, **SMALL))


def build_by_source(spark, d):
    """Templates with the boundary source and the masks of each image; reasons for the rest."""
    templates, dropped = jobs.build_chosen(_double(fx.eyes(spark, d)), *fx.eye_sources(spark, d), IRIS, PUPIL, LINES, **SMALL)
    return _words(templates).unionByName(dropped.drop("mode"), allowMissingColumns=True)


# ------------------------------------------------------------------------ SQL

def _weights(sigma: float) -> list[str]:
    reach = int(6 * sigma + 1) // 2
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(raw)
    return [f"{w / total!r}" + ("" if "e" in repr(w / total) else "e0") for w in raw]


def _smoothed(over: str) -> str:
    w = _weights(2.0)
    reach = len(w) // 2
    terms = [f"coalesce({'lag' if k < reach else 'lead'}(v, {abs(k - reach)}) OVER {over}, 0) * {c}" if k != reach
             else f"v * {c}" for k, c in enumerate(w)]
    return "0e0 + " + " + ".join(terms)


def edge_sql(p: str, source: str, scaling: str, vert: float, horz: float, high: float, low: float) -> str:
    """`{p}_edge(image_id, y, x, w, h)` of the raster `source`; `scaling` may name a column of
    `{p}_given(image_id, scaling)`, then that table must exist."""
    given = f"JOIN {p}_given USING (image_id)" if scaling == "scaling" else ""
    return f"""{p}_size AS (SELECT image_id, w, h, {scaling}::DOUBLE AS scaling FROM (
    SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY image_id) {given}),
{p}_sx AS (SELECT s.image_id, y, x, {_smoothed('q')} AS v FROM {source} s SEMI JOIN {p}_size USING (image_id)
  WINDOW q AS (PARTITION BY s.image_id, y ORDER BY x)),
{p}_sy AS (SELECT image_id, y, x, {_smoothed('q')} AS v FROM {p}_sx WINDOW q AS (PARTITION BY image_id, x ORDER BY y)),
{p}_axis AS (
  SELECT DISTINCT old, scaling, floor(greatest((old * scaling + 5e-13)::DOUBLE, 1))::INTEGER AS new
  FROM (SELECT w AS old, scaling FROM {p}_size UNION SELECT h, scaling FROM {p}_size)),
{p}_plan AS (
  SELECT old, scaling, CASE WHEN new > old // 2 + 1 THEN old - new ELSE new END AS take, new > old // 2 + 1 AS turned FROM {p}_axis),
{p}_walk(old, scaling, take, turned, i, kept, hit) AS (
  SELECT old, scaling, take, turned, 0, CASE WHEN 2 * take > old THEN 1 ELSE 0 END, 2 * take > old FROM {p}_plan
  UNION ALL
  SELECT old, scaling, take, turned, i + 1, kept + CASE WHEN 2 * ((i + 2) * take - kept * old) > old THEN 1 ELSE 0 END,
    2 * ((i + 2) * take - kept * old) > old FROM {p}_walk WHERE i + 1 < old),
{p}_kept AS (
  SELECT old, scaling, i, (row_number() OVER (PARTITION BY old, scaling ORDER BY i) - 1)::INTEGER AS pos,
    count(*) OVER (PARTITION BY old, scaling)::INTEGER AS n FROM (
    SELECT old, scaling, i FROM {p}_walk WHERE NOT turned AND hit
    UNION ALL SELECT old, scaling, old - 1 - i FROM {p}_walk WHERE turned AND NOT hit)),
{p}_small AS (
  SELECT r.image_id, b.pos AS y, a.pos AS x, a.n AS w, b.n AS h, r.v FROM {p}_sy r JOIN {p}_size s USING (image_id)
  JOIN {p}_kept a ON a.old = s.w AND a.scaling = s.scaling AND a.i = r.x
  JOIN {p}_kept b ON b.old = s.h AND b.scaling = s.scaling AND b.i = r.y),
{p}_near AS (
  SELECT *, lag(v) OVER r AS w0, lead(v) OVER r AS e0 FROM {p}_small WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
{p}_ring AS (
  SELECT image_id, y, x, w, h, coalesce(w0, 0) AS w0, coalesce(e0, 0) AS e0, coalesce(lag(v) OVER c, 0) AS n0, coalesce(lead(v) OVER c, 0) AS s0,
    coalesce(lag(w0) OVER c, 0) AS nw, coalesce(lead(w0) OVER c, 0) AS sw, coalesce(lag(e0) OVER c, 0) AS ne, coalesce(lead(e0) OVER c, 0) AS se
  FROM {p}_near WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
{p}_xy AS (
  SELECT image_id, y, x, w, h, ((e0 - w0) + ((se - nw) + (ne - sw)) / 2) * {vert}e0 AS gx, ((s0 - n0) + ((se - nw) - (ne - sw)) / 2) * {horz}e0 AS gy FROM {p}_ring),
{p}_grad AS (
  SELECT image_id, y, x, w, h, sqrt(gx * gx + gy * gy) AS v, CASE WHEN gy = 0 THEN 0e0 WHEN atan2(-gy, gx) < 0 THEN atan2(-gy, gx) + {PI_SQL}
    ELSE atan2(-gy, gx) END / {PI_SQL} * 180 AS orient FROM {p}_xy),
{p}_ends AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM {p}_grad GROUP BY image_id),
{p}_bent AS MATERIALIZED (
  SELECT image_id, y, x, w, h, orient, pow((v - lo) / (hi - lo), 1 / 1.9e0) AS v FROM {p}_grad JOIN {p}_ends USING (image_id) WHERE hi > lo),
{p}_sides AS (
  SELECT c.image_id, c.y, c.x, side, any_value(c.v) AS v, any_value(fx) AS fx, any_value(fy) AS fy, any_value(c.w) AS w, any_value(c.h) AS h,
    max(q.v) FILTER (k = 0) AS tl, max(q.v) FILTER (k = 1) AS tr, max(q.v) FILTER (k = 2) AS bl, max(q.v) FILTER (k = 3) AS br
  FROM {p}_bent c JOIN taps t ON t.degree = trunc(c.orient + 5e-13)::INTEGER
  JOIN {p}_bent q ON q.image_id = c.image_id AND q.x = c.x + t.dx AND q.y = c.y + t.dy
  WHERE c.v > {low}e0 AND c.x BETWEEN 2 AND c.w - 3 AND c.y BETWEEN 2 AND c.h - 3 GROUP BY c.image_id, c.y, c.x, side),
{p}_strong AS MATERIALIZED (
  SELECT image_id, y, x, any_value(v) AS v, any_value(w) AS w, any_value(h) AS h FROM {p}_sides GROUP BY image_id, y, x
  HAVING bool_and(v > (tl + fx * (tr - tl)) + fy * ((bl + fx * (br - bl)) - (tl + fx * (tr - tl))))),
{p}_edge(image_id, y, x, w, h) AS (
  SELECT image_id, y, x, w, h FROM {p}_strong WHERE v > {high}e0
  UNION
  SELECT s.image_id, s.y, s.x, s.w, s.h FROM {p}_edge g, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), {p}_strong s
  WHERE g.y * g.w + g.x > g.w AND g.y * g.w + g.x < g.w * g.h - g.w - 1
    AND s.image_id = g.image_id AND s.y = g.y + dy AND s.x = g.x + dx)"""


OFFSETS_SQL = """arcs AS (SELECT rad, i, trunc(rad * sqrt(1 - i * i / (rad * rad)::DOUBLE) + 0.5)::BIGINT AS j
  FROM range(1, 100) a(rad), range(0, 72) b(i) WHERE i <= trunc(rad / 1.4142::DOUBLE)),
offs AS (SELECT DISTINCT rad, dy, dx FROM (
  SELECT rad, s * i AS dy, t * j AS dx FROM arcs, (VALUES (1), (-1)) p(s), (VALUES (1), (-1)) q(t)
  UNION ALL SELECT rad, s * j, t * i FROM arcs, (VALUES (1), (-1)) p(s), (VALUES (1), (-1)) q(t)))"""


def circle_sql(p: str, source: str, limits: str, scaling: str, high: float, low: float, vert: float, horz: float) -> str:
    """`{p}_circle(image_id, "row", col, r)`; `limits` selects (image_id, r_low, r_high, scaling)."""
    return f"""{p}_limits AS ({limits}),
{p}_given AS (SELECT image_id, scaling FROM {p}_limits),
{edge_sql(p, source, scaling, vert, horz, high, low)},
{p}_radii AS (
  SELECT image_id, scaling::DOUBLE AS scaling, trunc(r_low * scaling::DOUBLE + 0.5::DOUBLE)::INTEGER AS base,
    trunc(r_high * scaling::DOUBLE - r_low * scaling::DOUBLE + 0.5::DOUBLE)::INTEGER AS planes FROM {p}_limits),
{p}_votes AS (
  SELECT e.image_id, o.rad - base - 1 AS plane, e.y + o.dy AS y, e.x + o.dx AS x, count(*) AS votes
  FROM {p}_edge e JOIN {p}_radii r USING (image_id) JOIN offs o ON o.rad > base AND o.rad <= base + planes
  WHERE e.y + o.dy BETWEEN 0 AND e.h - 1 AND e.x + o.dx BETWEEN 0 AND e.w - 1 GROUP BY ALL),
{p}_top AS (
  SELECT * FROM {p}_votes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, plane, x, y) = 1),
{p}_circle AS (
  SELECT r.image_id, trunc((coalesce(y, 0) + 1) / scaling + 5e-13)::INTEGER AS "row", trunc((coalesce(x, 0) + 1) / scaling + 5e-13)::INTEGER AS col,
    trunc((base + coalesce(plane, 0) + 1) / scaling + 5e-13)::INTEGER AS r
  FROM {p}_radii r LEFT JOIN {p}_top t USING (image_id))"""


def line_sql(p: str, source: str, least: float, high: float, low: float) -> str:
    """`{p}_line(image_id, n, angle, r, a, b, c, w, h)` of the raster `source`."""
    return f"""{edge_sql(p, source, '1e0', 0.0, 1.0, high, low)},
{p}_quarter AS (
  SELECT e.image_id, e.x - (w - 1) // 2 + sx * 0.25::DOUBLE AS px, (h - 1 - e.y) - (h - 1) // 2 + sy * 0.25::DOUBLE AS py, k AS angle,
    ceil(sqrt(((h - 1 - (h - 1) // 2) * (h - 1 - (h - 1) // 2) + (w - 1 - (w - 1) // 2) * (w - 1 - (w - 1) // 2))::DOUBLE)) + 1 AS last
  FROM {p}_edge e, (VALUES (-1), (1)) a(sx), (VALUES (-1), (1)) b(sy), range(180) c(k)),
{p}_spot AS (SELECT *, px * cos(angle * ({PI_SQL} / 180)) + last + py * sin(angle * ({PI_SQL} / 180)) AS p FROM {p}_quarter),
{p}_halves AS (
  SELECT image_id, angle, last, floor(p) AS b, 0.25::DOUBLE * (1 - p + floor(p)) AS m FROM {p}_spot
  UNION ALL SELECT image_id, angle, last, floor(p) + 1, 0.25::DOUBLE - 0.25::DOUBLE * (1 - p + floor(p)) FROM {p}_spot),
{p}_mass AS (SELECT image_id, angle::INTEGER AS angle, (b - last)::INTEGER AS r, {f6('sum(m)', 9)} AS mass FROM {p}_halves GROUP BY image_id, angle, b - last),
{p}_high AS (SELECT image_id, max(mass) AS top FROM {p}_mass GROUP BY image_id HAVING max(mass) > {least}),
{p}_turned AS (
  SELECT l.image_id, (row_number() OVER (PARTITION BY l.image_id ORDER BY r, angle) - 1)::INTEGER AS n, angle, r, w, h,
    cos(-angle * {PI_SQL} / 180) AS a, sin(-angle * {PI_SQL} / 180) AS b
  FROM {p}_mass l JOIN {p}_high t ON t.image_id = l.image_id AND t.top = l.mass JOIN {p}_size s ON s.image_id = l.image_id),
{p}_line AS (SELECT *, -r - a * (w / 2 - 1) - b * (h / 2 - 1) AS c FROM {p}_turned),
{p}_span AS (
  SELECT image_id, min(y) AS low, max(y) AS high FROM (
    SELECT image_id, trunc(CASE WHEN b = 0 THEN CASE WHEN -c - a * i > 0 THEN 1 ELSE h END
      ELSE least(greatest((-c - a * i) / b, 1), h) END + 5e-13)::INTEGER AS y
    FROM {p}_line, range(1, 1000) t(i) WHERE n = 0 AND i <= w) GROUP BY image_id)"""


def lid_sql(p: str, source: str, circles: str, lines: dict) -> str:
    """`{p}_lids(image_id, x1, x2, top, bottom)`: straight eyelids above and below the pupil."""
    return f"""{p}_box AS (
  SELECT c.*, greatest(xi - ri, 1) AS x1, greatest(yi - ri, 1) AS y1, least(xi + ri, w) AS x2, least(yi + ri, h) AS y2
  FROM {circles} c JOIN frames USING (image_id)),
{p}_strips AS (
  SELECT image_id, 'top' AS part, x1, x2, y1, yp - rp - 1 AS y2 FROM {p}_box
  UNION ALL SELECT image_id, 'bottom', x1, x2, yp + rp - 1, y2 FROM {p}_box),
{p}_cut AS (
  SELECT s.image_id || '|' || part AS image_id, (y + 1 - y1)::INTEGER AS y, (x + 1 - x1)::INTEGER AS x, v
  FROM {source} r JOIN {p}_strips s USING (image_id) WHERE x + 1 BETWEEN x1 AND x2 AND y + 1 BETWEEN y1 AND y2),
{line_sql(p + 'l', p + '_cut', **lines)},
{p}_lids AS (
  SELECT s.image_id, any_value(x1) AS x1, any_value(x2) AS x2, max(high + y1 - 1) FILTER (part = 'top') AS top,
    max(low + y1 - 1) FILTER (part = 'bottom') AS bottom
  FROM {p}_strips s LEFT JOIN {p}l_span p ON p.image_id = s.image_id || '|' || part GROUP BY s.image_id)"""


def segment_sql(p: str, source: str, iris: dict, pupil: dict) -> str:
    """`{p}_found(image_id, xp, yp, rp, xi, yi, ri)`: iris, and the pupil inside it; needs `frames`."""
    search = lambda s: {k: s[k] for k in ("high", "low", "vert", "horz")}
    limits = lambda s, f: f"SELECT image_id, {s['r_low']} AS r_low, {s['r_high']} AS r_high, {s['scaling']}::DOUBLE AS scaling FROM {f}"
    return f"""{circle_sql(p + 'o', source, limits(iris, f'(SELECT DISTINCT image_id FROM {source})'), f"{iris['scaling']}", **search(iris))},
{p}_outer AS (
  SELECT image_id, "row", col, r, greatest(col - r, 1) AS x1, greatest("row" - r, 1) AS y1, least(col + r, w) AS x2, least("row" + r, h) AS y2
  FROM {p}o_circle JOIN frames USING (image_id)),
{p}_part AS (
  SELECT image_id, (y + 1 - y1)::INTEGER AS y, (x + 1 - x1)::INTEGER AS x, v FROM {source} JOIN {p}_outer USING (image_id)
  WHERE x + 1 BETWEEN x1 AND x2 AND y + 1 BETWEEN y1 AND y2),
{circle_sql(p + 'i', p + '_part', limits(pupil, p + '_outer'), f"{pupil['scaling']}", **search(pupil))},
{p}_found AS (
  SELECT o.image_id, x1 + i.col AS xp, y1 + i."row" AS yp, i.r AS rp, o.col AS xi, o."row" AS yi, o.r AS ri
  FROM {p}_outer o JOIN {p}i_circle i USING (image_id))"""


def patches_sql(p: str, source: str, circles: str, lines: dict) -> str:
    """`extents`: line extents of the six eyelid patches round each iris; needs `frames`."""
    lim = _lim
    return f"""{p}_eye AS (
  SELECT c.*, w, h, ri // 2 AS extra, {lim('xi - ri - ri // 2', 'w - 1')} AS l, {lim('yi - ri', 'h - 1')} AS t, {lim('yp + rp', 'h - 1')} AS b,
    greatest(yi + ri - {lim('yp + rp', 'h - 1')}, 0) AS tall, {lim('xi + ri // 2', 'w - 1')} AS rr, {lim('xi - ri // 2', 'w - 1')} AS m
  FROM {circles} c JOIN frames USING (image_id)),
{p}_rects AS (
  SELECT image_id, w, h, 'lt' AS patch, l AS x0, t AS y0, ri AS wd, ri AS ht FROM {p}_eye
  UNION ALL SELECT image_id, w, h, 'rt', rr, t, ri, ri FROM {p}_eye UNION ALL SELECT image_id, w, h, 'lb', l, b, ri, tall FROM {p}_eye
  UNION ALL SELECT image_id, w, h, 'rb', rr, b, ri, tall FROM {p}_eye UNION ALL SELECT image_id, w, h, 'ct', m, t, extra * 2, tall FROM {p}_eye
  UNION ALL SELECT image_id, w, h, 'cb', m, b, extra * 2, tall FROM {p}_eye),
{p}_placed AS (
  SELECT *, greatest({lim('x0 - wd', 'w')}, x0) AS sx, greatest({lim('y0 - ht', 'h')}, y0) AS sy FROM {p}_rects),
{p}_crop AS (
  SELECT image_id || '|' || patch AS image_id, (y - sy + 1)::INTEGER AS y, (x - sx + 1)::INTEGER AS x, v
  FROM {source} JOIN {p}_placed p USING (image_id)
  WHERE x - sx + 1 BETWEEN 0 AND least(wd, w - sx) - 1 AND y - sy + 1 BETWEEN 0 AND least(ht, h - sy) - 1),
{p}_cut AS (SELECT * FROM {p}_crop WHERE image_id IN (
  SELECT image_id FROM {p}_crop GROUP BY image_id HAVING max(x) > 0 AND max(y) > 0)),
{line_sql(p + 'l', p + '_cut', **lines)},
extents AS (
  SELECT e.image_id, any_value(e.w) AS w, any_value(e.h) AS h, any_value(e.xi) AS xi, any_value(e.yi) AS yi, any_value(e.ri) AS ri, """ + ", ".join(
        f"max({c} + y0) FILTER (patch = '{patch}') AS {patch}_{k}" for patch in ("lt", "rt", "lb", "rb", "ct", "cb")
        for c, k in (("low", "min"), ("high", "max"))) + f""", NULL::INTEGER AS t_max
  FROM {p}_rects r JOIN {p}_eye e USING (image_id) LEFT JOIN {p}l_span s ON s.image_id = r.image_id || '|' || patch GROUP BY e.image_id)"""


FRAMES = "frames AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {0} GROUP BY image_id)".format
DOUBLES = "dots AS (SELECT image_id, y, x, v::DOUBLE AS v FROM {0})".format
ANCHOR_SQL = f"anchors AS (SELECT * EXCLUDE (curved) FROM ({_anchor_sql(True)}))"

PRESETS_SQL = f"""presets(code, n_scale, circle_ratio, scaling) AS (VALUES
  (88, 2.0, 0.90, 0.4), (99, 1.0, 0.65, 0.45), (1, 2.0, 0.92, 0.25), (2, 2.0, 0.92, 0.2), (3, 1.0, 0.65, 0.45),
  (4, 2.0, 0.92, 0.3), (5, 2.0, 0.92, 0.2), (6, 2.0, 0.92, 0.2), (7, 2.0, 0.92, 0.4)),
{fx.EYE_SENSORS_SQL},
chosen AS (
  SELECT image_id, s.code, coalesce(n_scale, 1)::DOUBLE AS n_scale, coalesce(circle_ratio, 1)::DOUBLE AS circle_ratio,
    coalesce(scaling, 0.4)::DOUBLE AS scaling, (42 * coalesce(n_scale, 1))::INTEGER AS pupil_max, (82 * coalesce(n_scale, 1))::INTEGER AS iris_max
  FROM sensors s LEFT JOIN presets p ON p.code = s.code)"""

LOCATE_SQL = f"""{fx.EYES_SQL}, {DOUBLES('eyes')}, {FRAMES('eyes')}, {TAPS_SQL}, {OFFSETS_SQL}, {PRESETS_SQL}, {fx.EYE_CANDIDATES_SQL},
steps(image_id, pass, step, ratio) AS (
  SELECT image_id, p, 1, circle_ratio FROM chosen, range(1, 3) t(p)
  UNION ALL SELECT image_id, pass, step + 1, ratio - 0.05::DOUBLE FROM steps
  WHERE ratio - 0.05::DOUBLE > CASE pass WHEN 1 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, pass, threshold ORDER BY count DESC) AS n FROM candidates),
seconds AS (SELECT *, min(count) FILTER (n <= 2) OVER (PARTITION BY image_id, pass, threshold) AS second FROM ranked),
swept AS (
  SELECT c.image_id, cx, cy, greatest(w, h) // 2 + 1 AS r FROM seconds c JOIN chosen USING (image_id)
  JOIN steps s ON s.image_id = c.image_id AND s.pass = c.pass
  WHERE count >= second AND count > trunc(16 * n_scale) AND cx > 0 AND cy > 0 AND greatest(w, h) // 2 + 1 < pupil_max
    AND least(w, h) >= trunc(greatest(w, h) * s.ratio)
    AND CASE WHEN c.pass = 1 THEN threshold BETWEEN 0 AND start ELSE threshold > start AND threshold < start + 40 END
  QUALIFY row_number() OVER (PARTITION BY c.image_id
    ORDER BY c.pass, step, abs(threshold - start), count DESC, ord, threshold, cx, cy) = 1),
pupils AS (
  SELECT image_id, w, h, scaling, iris_max AS top, CASE WHEN r IS NULL THEN w // 2 ELSE cx END AS xp, CASE WHEN r IS NULL THEN h // 2 ELSE cy END AS yp,
    coalesce(r, pupil_max // 2) AS rp FROM frames JOIN chosen USING (image_id) LEFT JOIN swept USING (image_id)),
sides AS (
  SELECT *, CASE WHEN xp < rp THEN 0 ELSE greatest(xp - top, 0) END AS sx, CASE WHEN yp < rp THEN 0 ELSE greatest(yp - top, 0) END AS sy FROM pupils),
regions AS (
  SELECT *, least(xp + top, w) - sx AS wd, least(yp + top, h) - sy AS ht, CASE WHEN xp < rp THEN xp ELSE top END AS px,
    CASE WHEN yp < rp THEN yp ELSE top END AS py FROM sides),
part AS (
  SELECT image_id, (y - sy)::INTEGER AS y, (x - sx)::INTEGER AS x, v FROM dots JOIN regions USING (image_id)
  WHERE x - sx BETWEEN 0 AND wd - 1 AND y - sy BETWEEN 0 AND ht - 1),
{circle_sql('f', 'part', 'SELECT image_id, least(rp + rp // 4, top) AS r_low, top AS r_high, scaling FROM regions', 'scaling', 0.3, 0.25, 1.0, 0.0)},
placed AS (
  SELECT image_id, xp, yp, rp, px, py, top, CASE WHEN col < 2 THEN wd // 2 ELSE col END AS xi, CASE WHEN "row" < 2 THEN ht // 2 ELSE "row" END AS yi,
    CASE WHEN r < 2 OR r > top THEN top ELSE r END AS ri FROM regions JOIN f_circle USING (image_id)),
circles AS (
  SELECT image_id, xp::INTEGER AS xp, yp::INTEGER AS yp, rp::INTEGER AS rp,
    (xp + CASE WHEN abs(xi - px) > top // 4 THEN 0 ELSE xi - px END)::INTEGER AS xi,
    (yp + CASE WHEN abs(yi - py) > top // 4 THEN 0 ELSE yi - py END)::INTEGER AS yi, ri::INTEGER AS ri FROM placed)"""

LID_CURVES_SQL = """curves AS (
  SELECT image_id, lid, i::INTEGER AS x, x2, f0, trunc((i - x1) / (x0 - x1) * ((i - x2) / (x0 - x2)) * f0 + (i - x0) / (x1 - x0) * ((i - x2) / (x1 - x2)) * f1
      + (i - x0) / (x2 - x0) * ((i - x1) / (x2 - x1)) * f2)::INTEGER AS l
  FROM (SELECT image_id, 't' AS lid, x0::DOUBLE AS x0, x1::DOUBLE AS x1, x2::DOUBLE AS x2, t0 AS f0, t1 AS f1, t2 AS f2 FROM anchors
        UNION ALL SELECT image_id, 'b', x0, x1, x2, b0, b1, b2 FROM anchors), range(0, 2000) t(i) WHERE i BETWEEN x0 AND x2),
lid_y AS (SELECT image_id, lid, x, CASE WHEN l >= 1 THEN l ELSE f0 END AS y FROM curves WHERE x < x2)"""

QUERIES = {f.__name__: f for f in (
    find_circle, find_circle_by_sensor, find_lines, segmentation, eyelid_search, locate_eyes_by_sensor,
    build_by_sensor, build_by_source)}

ORACLES = {
    "find_circle": f"""WITH RECURSIVE {R}, {DOUBLES('raster')}, {TAPS_SQL}, {OFFSETS_SQL},
{circle_sql('f', 'dots', 'SELECT image_id, 8 AS r_low, 15 AS r_high, 0.8::DOUBLE AS scaling FROM sizes', '0.8', 0.25, 0.2, 1.0, 0.0)}
SELECT * FROM f_circle""",
    "find_circle_by_sensor": f"""WITH RECURSIVE {fx.EYES_SQL}, {DOUBLES('eyes')}, {TAPS_SQL}, {OFFSETS_SQL}, {PRESETS_SQL},
{circle_sql('f', 'dots', 'SELECT image_id, 15 AS r_low, iris_max AS r_high, scaling FROM chosen', 'scaling', 0.3, 0.25, 1.0, 0.0)}
SELECT * FROM f_circle""",
    "find_lines": f"""WITH RECURSIVE {R}, {DOUBLES('raster')}, {TAPS_SQL}, {line_sql('f', 'dots', **LINES)}
SELECT image_id, n, angle, r, {f6('a')} AS a, {f6('b')} AS b, {f6('c')} AS c, w, h FROM f_line""",
    "segmentation": f"""WITH RECURSIVE {fx.EYES_SQL}, {DOUBLES('eyes')}, {FRAMES('eyes')}, {TAPS_SQL}, {OFFSETS_SQL},
{segment_sql('s', 'dots', IRIS, PUPIL)}, {lid_sql('t', 'dots', 's_found', LINES)},
marked AS (
  SELECT image_id, coalesce(x + 1 BETWEEN x1 AND x2 AND (coalesce(y + 1 <= top, false) OR coalesce(y + 1 >= bottom, false)), false) OR v > 200 AS noise
  FROM dots JOIN t_lids USING (image_id))
SELECT f.*, pixels, noisy FROM s_found f JOIN (
  SELECT image_id, count(*) AS pixels, count(*) FILTER (noise) AS noisy FROM marked GROUP BY image_id) USING (image_id)""",
    "eyelid_search": f"""WITH RECURSIVE {R}, {DOUBLES('raster')}, {FRAMES('raster')}, {TAPS_SQL}, {fx.CIRCLES_SQL},
{patches_sql('e', 'dots', 'circles', LINES)}, {ANCHOR_SQL} SELECT * FROM anchors""",
    "locate_eyes_by_sensor": f"WITH RECURSIVE {LOCATE_SQL} SELECT * FROM circles",
    "build_by_sensor": f"""WITH RECURSIVE {LOCATE_SQL}, {patches_sql('e', 'dots', 'circles', LINES)}, {ANCHOR_SQL}, {LID_CURVES_SQL},
usable AS (
  SELECT r.image_id, r.y, r.x, r.v FROM dots r LEFT JOIN lid_y t ON t.image_id = r.image_id AND t.lid = 't' AND t.x = r.x
  LEFT JOIN lid_y b ON b.image_id = r.image_id AND b.lid = 'b' AND b.x = r.x
  WHERE r.v BETWEEN 3 AND 250 AND NOT coalesce(r.y <= t.y OR r.y >= b.y, false)),
{_grid_sql(RADIAL, ANGULAR)}, {BAND_SQL}, {_response_sql(ANGULAR, WAVELENGTH, 0.55, 1, 1)},
{RANKED_SQL}, """ + _pack_sql("bits", RADIAL, ANGULAR, 1).replace(
        "SELECT image_id, 0 AS data_type", "SELECT image_id, (SELECT any_value(s.code) FROM sensors s WHERE s.image_id = padded.image_id) AS data_type"),
}

_POINT_CIRCLES = CIRCLE_SQL.replace("found AS", "point_circles AS")
ORACLES["build_by_source"] = f"""WITH RECURSIVE {fx.EYES_SQL}, {DOUBLES('eyes')}, {FRAMES('eyes')}, {TAPS_SQL}, {OFFSETS_SQL}, {fx.EYE_SOURCES_SQL},
{_POINT_CIRCLES},
routed AS (
  SELECT i.image_id, coalesce(i.mode, CASE WHEN p.ri IS NOT NULL THEN 2 WHEN g.ri IS NOT NULL THEN 3 ELSE 1 END) AS mode, eyelids, highlight,
    f.w IS NOT NULL AS seen FROM images i LEFT JOIN point_circles p USING (image_id) LEFT JOIN given g USING (image_id) LEFT JOIN frames f USING (image_id)),
searched AS (SELECT d.* FROM dots d SEMI JOIN (SELECT image_id FROM routed WHERE mode = 1) s USING (image_id)),
{segment_sql('s', 'searched', IRIS, PUPIL)},
circles AS (
  SELECT image_id, xp, yp, rp, xi, yi, ri, mode, eyelids, highlight FROM routed JOIN (
    SELECT 1 AS mode, image_id, xp, yp, rp, xi, yi, ri FROM s_found UNION ALL SELECT 2, image_id, xp, yp, rp, xi, yi, ri FROM point_circles
    UNION ALL SELECT 3, image_id, xp, yp, rp, xi, yi, ri FROM given) USING (image_id, mode) WHERE seen AND ri IS NOT NULL AND rp IS NOT NULL),
straight AS (SELECT image_id, xp, yp, rp, xi, yi, ri FROM circles WHERE eyelids AND mode <> 2),
{lid_sql('t', 'dots', 'straight', LINES)},
spots AS (
  SELECT i.image_id, i.k, i.x, i.y, l.x AS lx, l.y AS ly, l.valid AS lv FROM boundary i
  JOIN boundary l ON l.image_id = i.image_id AND l.ring = 'iris' AND l.k = (i.k + 7) % 8
  JOIN circles c ON c.image_id = i.image_id AND c.mode = 2 AND c.eyelids WHERE i.ring = 'iris' AND NOT i.valid),
hidden_lines AS (
  SELECT image_id, NULL::DOUBLE AS a, NULL::DOUBLE AS b, x::DOUBLE AS up FROM spots WHERE k % 4 = 2
  UNION ALL SELECT image_id, s, y - s * x, NULL FROM (
    SELECT *, CASE k % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.26::DOUBLE ELSE (-0.26)::DOUBLE END AS s FROM spots) WHERE k % 4 <> 2
  UNION ALL SELECT image_id, s, y - s * x, NULL FROM (SELECT *, (ly - y) / (lx - x) AS s FROM spots WHERE NOT lv AND lx <> x)),
behind AS (
  SELECT DISTINCT r.image_id, r.y, r.x FROM dots r JOIN hidden_lines l USING (image_id) JOIN circles f USING (image_id)
  WHERE CASE WHEN l.up IS NOT NULL THEN (l.up - r.x) * (l.up - f.xi) <= 0 ELSE (l.a * r.x + l.b - r.y) * (l.a * f.xi + l.b - f.yi) <= 0 END),
usable AS (
  SELECT r.image_id, r.y, r.x, r.v FROM dots r JOIN circles c USING (image_id) LEFT JOIN t_lids l USING (image_id)
  LEFT JOIN behind b ON b.image_id = r.image_id AND b.y = r.y AND b.x = r.x
  WHERE b.x IS NULL AND r.v >= 1 AND r.v <= coalesce(highlight, 255)
    AND NOT coalesce(r.x + 1 BETWEEN x1 AND x2 AND (coalesce(r.y + 1 <= top, false) OR coalesce(r.y + 1 >= bottom, false)), false)),
{_grid_sql(RADIAL, ANGULAR)}, {BAND_SQL}, {_response_sql(ANGULAR, WAVELENGTH, 0.5, 1, 1)},
{FIXED_BITS_SQL}, {_pack_sql('fixed_bits', RADIAL, ANGULAR, 1).replace('SELECT image_id, 0 AS data_type', 'SELECT image_id, NULL AS reason, 0 AS data_type')}
UNION ALL BY NAME SELECT image_id, CASE WHEN NOT seen THEN 'no image' WHEN mode NOT IN (1, 2, 3) THEN 'unknown mode' ELSE 'no boundary' END AS reason
FROM routed WHERE image_id NOT IN (SELECT image_id FROM circles)"""
