"""Queries on pixel tables: statistics, texture, filters, colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions.numeric import fixed
from ..operators import raster as ops
from . import fixtures as fx

PIXEL = ["image_id", "y", "x"]


def _rounded(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, fixed(name, digits))
    return df


def image_stats(spark, d):
    return _rounded(ops.image_stats(fx.raster(spark, d)), "mean", "sd")


def histogram(spark, d):
    return ops.histogram(fx.raster(spark, d))


def glcm(spark, d):
    return ops.glcm(fx.raster(spark, d))


def glcm_mean(spark, d):
    return _rounded(ops.glcm_mean(fx.raster(spark, d)), "p", digits=9)


def glcm_contrast(spark, d):
    return _rounded(ops.contrast(fx.raster(spark, d)), "contrast")


def edge_density(spark, d):
    return _rounded(ops.edge_density(fx.raster(spark, d)), "edge_density")


def dark_threshold(spark, d):
    return ops.dark_threshold(fx.raster(spark, d))


def binary_threshold(spark, d):
    r = fx.raster(spark, d)
    return ops.binary_threshold(r, ops.dark_threshold(r, alpha=120))


def minmax_rescale(spark, d):
    return ops.minmax_rescale(fx.raster(spark, d))


def gamma(spark, d):
    return _rounded(ops.gamma(fx.raster(spark, d)), "v")


def equalize(spark, d):
    return ops.equalize(fx.raster(spark, d))


def equalize_halves(spark, d):
    return ops.equalize_halves(fx.raster(spark, d))


def gaussian_smooth(spark, d):
    return _rounded(ops.gaussian_smooth(fx.raster(spark, d), 2.0), "v")


def bilateral(spark, d):
    return ops.bilateral(fx.raster(spark, d))


def bilateral_mix(spark, d):
    return ops.bilateral_mix(fx.raster(spark, d), 30.0)


def decimate(spark, d):
    return ops.decimate(fx.raster(spark, d), 0.4)


def decimate_slightly(spark, d):
    return ops.decimate(fx.raster(spark, d), 0.8)


def _rects(spark, d):
    sizes = ops.image_sizes(fx.raster(spark, d))
    return (sizes.withColumn("x0", (F.col("image_id") * 7 - 10).cast("int"))
            .withColumn("y0", (F.col("image_id") * 5 - 5).cast("int"))
            .withColumn("wd", F.lit(30)).withColumn("ht", F.lit(25)))


def crop(spark, d):
    r = fx.raster(spark, d)
    zero = ops.crop(r, _rects(spark, d)).withColumn("base", F.lit(0))
    return zero.unionByName(ops.crop(r, _rects(spark, d), True).withColumn("base", F.lit(1)))


def circle_region(spark, d):
    circles = fx.circles(spark, d).withColumn("xp", F.col("image_id") * 7)
    sized = circles.join(ops.image_sizes(fx.raster(spark, d)), "image_id")
    return (ops.circle_region(sized, F.lit(21), F.lit(17))
            .select("image_id", "x0", "y0", "wd", "ht", "px", "py"))


def reach_bounds(spark, d):
    sized = fx.circles(spark, d).join(ops.image_sizes(fx.raster(spark, d)), "image_id")
    reach = F.col("image_id") * 6
    return (ops.reach_bounds(sized, F.col("xi"), F.col("yi"), reach, reach + 3)
            .select("image_id", "left", "right", "top", "bottom"))


def grey(spark, d):
    return fx.rgb(spark, d).select(
        *PIXEL, colour.grey(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def rgb_hsv(spark, d):
    cells = fx.rgb(spark, d)
    full = cells.select(*PIXEL, F.lit(255).alias("hue_max"),
                        *colour.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")))
    return full.unionByName(cells.select(
        *PIXEL, F.lit(179).alias("hue_max"),
        *colour.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"), 179)))


def hsv_rgb(spark, d):
    cells = fx.rgb(spark, d)
    full = cells.select(*PIXEL, F.lit(255).alias("hue_max"),
                        *colour.hsv_to_rgb(F.col("r"), F.col("g"), F.col("b")))
    half = cells.withColumn("r", F.floor(F.col("r") * 179 / 255).cast("int"))
    return full.unionByName(half.select(
        *PIXEL, F.lit(179).alias("hue_max"),
        *colour.hsv_to_rgb(F.col("r"), F.col("g"), F.col("b"), 179)))


def yiq_rgb(spark, d):
    return fx.rgb(spark, d).select(
        *PIXEL, *colour.yiq_to_rgb(F.col("r"), F.col("g"), F.col("b")))


def alpha_blend(spark, d):
    cells = fx.rgb(spark, d)
    one = lambda c: cells.select(*PIXEL, F.col(c).alias("v"))
    mask = cells.select(*PIXEL, F.greatest(F.col("b") - 60, F.lit(0)).alias("v"))
    return ops.alpha_blend(one("r"), one("g"), mask)


def ellipse_mask(spark, d):
    return ops.elliptical_mask(fx.raster(spark, d))


# ------------------------------------------------------------------------ SQL

def f6(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


R = fx.RASTER_SQL
GLCM_SQL = f"""{R},
direction(angle, dx, dy) AS (VALUES (0, 1, 0), (45, 1, -1), (90, 0, -1), (135, -1, -1)),
cells AS (
  SELECT p.image_id, d.angle, p.v AS a, q.v AS b, count(*) AS n
  FROM raster p JOIN direction d ON true
  JOIN raster q ON q.image_id = p.image_id AND q.x = p.x + d.dx AND q.y = p.y + d.dy GROUP BY ALL),
glcm AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id, angle) AS p FROM cells),
mean_glcm AS (SELECT image_id, a, b, sum(p) / 4 AS p FROM glcm GROUP BY ALL),
contrasts AS (SELECT image_id, sum((b - a) * (b - a) * p) AS contrast FROM mean_glcm GROUP BY ALL),
lows AS (SELECT image_id, min(v) AS low FROM raster GROUP BY ALL)"""

NEAR_SQL = """near AS (
  SELECT image_id, y, x, v,
    lag(v) OVER r AS w0, lead(v) OVER r AS e0 FROM raster WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
ring AS (
  SELECT *, lag(v) OVER c AS n0, lead(v) OVER c AS s0, lag(w0) OVER c AS nw, lead(w0) OVER c AS sw,
    lag(e0) OVER c AS ne, lead(e0) OVER c AS se FROM near WINDOW c AS (PARTITION BY image_id, x ORDER BY y))"""


def _equal_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_n AS (SELECT {keys}, v, count(*) AS n FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY v)::BIGINT AS c,
  sum(n) OVER (PARTITION BY {keys})::BIGINT AS total,
  first_value(n) OVER (PARTITION BY {keys} ORDER BY v) AS head FROM {name}_n),
{name} AS (SELECT {keys}, v, CASE WHEN total = head THEN v ELSE least(greatest(round_even(
  ((c - head)::FLOAT * (255::FLOAT / (total - head)::FLOAT))::DOUBLE, 0), 0), 255)::INTEGER END AS level FROM {name}_c)"""


def _bilateral_sql(reach: int, sc: float, ss: float) -> str:
    return f"""{R},
mirrored AS (
  SELECT image_id, yy AS y, xx AS x, v FROM (
    SELECT r.image_id, v, w, h,
      unnest(list_filter([x, CASE WHEN x BETWEEN 1 AND {reach} THEN -x END,
        CASE WHEN x < w - 1 AND x >= w - 1 - {reach} THEN 2 * (w - 1) - x END], lambda e: e IS NOT NULL)) AS xx, y
    FROM raster r JOIN sizes s USING (image_id)) q,
  LATERAL (SELECT unnest(list_filter([q.y, CASE WHEN q.y BETWEEN 1 AND {reach} THEN -q.y END,
        CASE WHEN q.y < q.h - 1 AND q.y >= q.h - 1 - {reach} THEN 2 * (q.h - 1) - q.y END], lambda e: e IS NOT NULL)) AS yy)),
offs AS (SELECT dy, dx, exp(-(dx * dx + dy * dy) / (2e0 * {ss} * {ss})) AS w
  FROM range(-{reach}, {reach + 1}) a(dy), range(-{reach}, {reach + 1}) b(dx) WHERE dx * dx + dy * dy <= {reach * reach}),
smooth AS (
  SELECT r.image_id, r.y, r.x, any_value(r.v) AS src,
    round_even(sum(o.w * exp((m.v - r.v) * (m.v - r.v) * (-0.5e0 / ({sc} * {sc}))) * m.v)
      / sum(o.w * exp((m.v - r.v) * (m.v - r.v) * (-0.5e0 / ({sc} * {sc})))), 0)::INTEGER AS v
  FROM raster r JOIN offs o ON true
  JOIN mirrored m ON m.image_id = r.image_id AND m.y = r.y + o.dy AND m.x = r.x + o.dx
  GROUP BY r.image_id, r.y, r.x)"""


def _keep_sql(scaling: float) -> str:
    """Kept lines by stepping through them; `pos` is the new number."""
    return f"""WITH RECURSIVE {R},
axis AS (
  SELECT DISTINCT n AS old, greatest((n * {scaling} + 5e-13)::DOUBLE, 1) AS raw FROM
    (SELECT w AS n FROM sizes UNION SELECT h FROM sizes)),
plan AS (
  SELECT old, floor(raw)::INTEGER AS new, CASE WHEN floor(raw)::INTEGER > old // 2 + 1 THEN old - floor(raw)::INTEGER
    ELSE floor(raw)::INTEGER END AS take, floor(raw)::INTEGER > old // 2 + 1 AS turned FROM axis),
walk(old, new, take, turned, i, kept, hit) AS (
  SELECT old, new, take, turned, 0, CASE WHEN 2 * take > old THEN 1 ELSE 0 END, 2 * take > old FROM plan
  UNION ALL
  SELECT old, new, take, turned, i + 1,
    kept + CASE WHEN 2 * ((i + 2) * take - kept * old) > old THEN 1 ELSE 0 END,
    2 * ((i + 2) * take - kept * old) > old
  FROM walk WHERE i + 1 < old),
chosen AS (
  SELECT old, i, (row_number() OVER (PARTITION BY old ORDER BY i) - 1)::INTEGER AS pos FROM (
    SELECT old, i FROM walk WHERE NOT turned AND hit
    UNION ALL SELECT old, old - 1 - i FROM walk WHERE turned AND NOT hit))
SELECT r.image_id, b.pos AS y, a.pos AS x, r.v
FROM raster r JOIN sizes s USING (image_id) JOIN chosen a ON a.old = s.w AND a.i = r.x
JOIN chosen b ON b.old = s.h AND b.i = r.y"""


def _hsv_sql(hue_max: int) -> str:
    hue = "h" if hue_max == 255 else f"(h * {hue_max}) // 255"
    return f"SELECT image_id, y, x, {hue_max} AS hue_max, {hue} AS hue, sat, val FROM bytes"


def _rgb_sql(hue_max: int) -> str:
    src = "r" if hue_max == 255 else f"((r * {hue_max}) // 255 * 255) // {hue_max}"
    pick = "\n    ".join(
        f"least(greatest(trunc((CASE WHEN s = 0 THEN fv WHEN k = 0 THEN {c[0]} WHEN k = 1 THEN {c[1]} "
        f"WHEN k = 2 THEN {c[2]} WHEN k = 3 THEN {c[3]} WHEN k = 4 THEN {c[4]} ELSE {c[5]} END)::FLOAT * 255::FLOAT), 0), 255)"
        f"::INTEGER AS {n}," for n, c in (
            ("red", ("fv", "q", "p", "p", "t", "fv")), ("green", ("t", "fv", "fv", "q", "p", "p")),
            ("blue", ("p", "p", "t", "fv", "fv", "q"))))
    return f"""SELECT image_id, y, x, {hue_max} AS hue_max, {pick.rstrip(',')}
FROM (SELECT *, fv * (1::FLOAT - fs) AS p, fv * (1::FLOAT - fs * part) AS q,
        fv * (1::FLOAT - fs * (1::FLOAT - part)) AS t
      FROM (SELECT *, turn - floor(turn) AS part, trunc(turn)::INTEGER AS k
            FROM (SELECT image_id, y, x, g AS s, g::FLOAT * u AS fs, b::FLOAT * u AS fv,
                    ((CASE WHEN ({src})::FLOAT * u >= 1 THEN 0::FLOAT ELSE ({src})::FLOAT * u END)::DOUBLE * 6)::FLOAT AS turn
                  FROM rgb, (SELECT 1::FLOAT / 255::FLOAT AS u))))"""


QUERIES = {f.__name__: f for f in (
    image_stats, histogram, glcm, glcm_mean, glcm_contrast, edge_density, dark_threshold,
    binary_threshold, minmax_rescale, gamma, equalize, equalize_halves, gaussian_smooth,
    bilateral, bilateral_mix, decimate, decimate_slightly, crop, circle_region, reach_bounds,
    grey, rgb_hsv, hsv_rgb, yiq_rgb, alpha_blend, ellipse_mask)}

ORACLES = {
    "image_stats": f"""WITH {R} SELECT image_id, count(*) AS pixels, {f6('avg(v)')} AS mean,
  {f6('stddev_pop(v)')} AS sd, min(v) AS low, max(v) AS high FROM raster GROUP BY image_id""",
    "histogram": f"WITH {R} SELECT image_id, v, count(*) AS n FROM raster GROUP BY ALL",
    "glcm": f"WITH {GLCM_SQL} SELECT * FROM glcm",
    "glcm_mean": f"WITH {GLCM_SQL} SELECT image_id, a, b, {f6('p', 9)} AS p FROM mean_glcm",
    "glcm_contrast": f"WITH {GLCM_SQL} SELECT image_id, {f6('contrast')} AS contrast FROM contrasts",
    "edge_density": f"""WITH {R}, {NEAR_SQL},
grads AS (SELECT image_id, ne + 2 * e0 + se - nw - 2 * w0 - sw AS gx, nw + 2 * n0 + ne - sw - 2 * s0 - se AS gy FROM ring)
SELECT image_id, {f6('avg(sqrt(gx * gx + gy * gy))')} AS edge_density, count(gx + gy) AS pixels
FROM grads GROUP BY image_id""",
    "dark_threshold": f"""WITH {GLCM_SQL}
SELECT image_id, trunc((least(contrast, 256e0) / 256e0 + 1) * (low + 20))::INTEGER AS threshold
FROM contrasts JOIN lows USING (image_id)""",
    "binary_threshold": f"""WITH {GLCM_SQL}
SELECT image_id, y, x, CASE WHEN v > trunc((least(contrast, 256e0) / 256e0 + 1) * (low + 120)) THEN 255 ELSE 0 END AS v
FROM raster JOIN contrasts USING (image_id) JOIN lows USING (image_id)""",
    "minmax_rescale": f"""WITH {R}, ends AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM raster GROUP BY ALL)
SELECT image_id, y, x, least(greatest(round_even(v * (255e0 / (hi - lo)) - lo * 255e0 / (hi - lo), 0), 0), 255)::INTEGER AS v
FROM raster JOIN ends USING (image_id)""",
    "gamma": f"""WITH {R}, ends AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM raster GROUP BY ALL)
SELECT image_id, y, x, {f6('pow((v - lo) / (hi - lo), 1 / 1.9e0)')} AS v FROM raster JOIN ends USING (image_id)""",
    "equalize": f"""WITH {R}, {_equal_sql('eq', 'raster', 'image_id')}
SELECT r.image_id, y, x, level AS v FROM raster r JOIN eq ON eq.image_id = r.image_id AND eq.v = r.v""",
    "equalize_halves": f"""WITH {R},
sided AS (SELECT r.*, w, x >= w // 2 AS side FROM raster r JOIN sizes USING (image_id)),
{_equal_sql('eq', 'raster', 'image_id')}, {_equal_sql('half', 'sided', 'image_id, side')},
three AS (SELECT s.image_id, y, x, w, h.level AS hv, e.level AS wv,
    (x - w // 4)::FLOAT / (w::FLOAT * 0.25::FLOAT) AS f1, (x - w * 2 // 4)::FLOAT / (w::FLOAT * 0.25::FLOAT) AS f2
  FROM sided s JOIN eq e ON e.image_id = s.image_id AND e.v = s.v
  JOIN half h ON h.image_id = s.image_id AND h.side = s.side AND h.v = s.v)
SELECT image_id, y, x, CASE WHEN x < w // 4 THEN hv
  WHEN x < w * 2 // 4 THEN round_even(((1::FLOAT - f1) * hv::FLOAT + f1 * wv::FLOAT)::DOUBLE, 0)::INTEGER
  WHEN x < w * 3 // 4 THEN round_even(((1::FLOAT - f2) * wv::FLOAT + f2 * hv::FLOAT)::DOUBLE, 0)::INTEGER
  ELSE hv END AS v FROM three""",
    "gaussian_smooth": f"""WITH {R},
kern AS (SELECT dy, dx, exp(-(dx * dx + dy * dy) / 8e0) AS w FROM range(-6, 7) a(dy), range(-6, 7) b(dx)),
norm AS (SELECT dy, dx, w / (SELECT sum(w) FROM kern) AS w FROM kern)
SELECT r.image_id, r.y, r.x, {f6('sum(n.w * q.v)')} AS v
FROM raster r JOIN norm n ON true JOIN raster q ON q.image_id = r.image_id AND q.y = r.y + n.dy AND q.x = r.x + n.dx
GROUP BY r.image_id, r.y, r.x""",
    "bilateral": f"WITH {_bilateral_sql(3, 20.0, 2.0)} SELECT image_id, y, x, v FROM smooth",
    "bilateral_mix": f"""WITH {_bilateral_sql(2, 30.0, 30.0)}
SELECT image_id, y, x, least(greatest(round_even(src * 0.7::DOUBLE + v * 0.7::DOUBLE, 0), 0), 255)::INTEGER AS v FROM smooth""",
    "decimate": _keep_sql(0.4),
    "decimate_slightly": _keep_sql(0.8),
    "crop": f"""WITH {R},
rects AS (SELECT image_id, w, h, image_id * 7 - 10 AS x0, image_id * 5 - 5 AS y0, 30 AS wd, 25 AS ht FROM sizes),
placed AS (SELECT image_id, w, h, wd, ht, greatest(least(greatest(x0 - wd, 1), w), x0) AS sx,
  greatest(least(greatest(y0 - ht, 1), h), y0) AS sy FROM rects)
SELECT r.image_id, (y - sy + k)::INTEGER AS y, (x - sx + k)::INTEGER AS x, v, k::INTEGER AS base
FROM raster r JOIN placed p ON p.image_id = r.image_id, range(2) t(k)
WHERE x - sx + k BETWEEN 0 AND least(wd, w - sx) - 1 AND y - sy + k BETWEEN 0 AND least(ht, h - sy) - 1""",
    "circle_region": f"""WITH {R}, {fx.CIRCLES_SQL},
c AS (SELECT image_id, image_id * 7 AS cx, yp AS cy, rp AS r, w, h FROM circles JOIN sizes USING (image_id)),
e AS (SELECT *, CASE WHEN cx < r THEN 0 ELSE greatest(cx - 21, 0) END AS sx, CASE WHEN cy < r THEN 0 ELSE greatest(cy - 17, 0) END AS sy,
  cx <> 0 AND cy <> 0 AND r <> 0 AS found FROM c)
SELECT image_id, CASE WHEN found THEN sx ELSE 0 END::INTEGER AS x0, CASE WHEN found THEN sy ELSE 0 END::INTEGER AS y0,
  CASE WHEN found THEN least(cx + 21, w) - sx ELSE 0 END::INTEGER AS wd, CASE WHEN found THEN least(cy + 17, h) - sy ELSE 0 END::INTEGER AS ht,
  CASE WHEN NOT found THEN 0 WHEN cx < r THEN cx ELSE 21 END::INTEGER AS px,
  CASE WHEN NOT found THEN 0 WHEN cy < r THEN cy ELSE 17 END::INTEGER AS py FROM e""",
    "reach_bounds": f"""WITH {R}, {fx.CIRCLES_SQL}
SELECT image_id, least(greatest(xi - image_id * 6, 1), w) AS "left", least(greatest(xi + image_id * 6, 1), w) AS "right",
  least(greatest(yi - image_id * 6 - 3, 1), h) AS top, least(greatest(yi + image_id * 6 + 3, 1), h) AS bottom
FROM circles JOIN sizes USING (image_id)""",
    "grey": f"WITH {fx.RGB_SQL} SELECT image_id, y, x, (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 AS v FROM rgb",
    "rgb_hsv": f"""WITH {fx.RGB_SQL},
f AS (SELECT image_id, y, x, r, g, b, greatest(r, g, b) AS top, r::FLOAT * u AS fr, g::FLOAT * u AS fg, b::FLOAT * u AS fb,
  greatest(r, g, b)::FLOAT * u - least(r, g, b)::FLOAT * u AS delta, greatest(r, g, b)::FLOAT * u AS ft
  FROM rgb, (SELECT 1::FLOAT / 255::FLOAT AS u)),
hues AS (SELECT *, CASE WHEN delta = 0 THEN 0::FLOAT WHEN top = r THEN (fg - fb) * (1::FLOAT / (6::FLOAT * delta))
    WHEN top = g THEN 2::FLOAT / 6::FLOAT + (fb - fr) * (1::FLOAT / (6::FLOAT * delta))
    ELSE 4::FLOAT / 6::FLOAT + (fr - fg) * (1::FLOAT / (6::FLOAT * delta)) END AS h0 FROM f),
wrapped AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 1::FLOAT ELSE h0 END AS h1 FROM hues),
bytes AS (SELECT image_id, y, x,
  least(greatest(trunc(0.5::FLOAT + (CASE WHEN h1 >= 1 THEN h1 - 1::FLOAT ELSE h1 END) * 255::FLOAT), 0), 255)::INTEGER AS h,
  least(greatest(trunc(0.5::FLOAT + (CASE WHEN top = 0 THEN 0::FLOAT ELSE delta / ft END) * 255::FLOAT), 0), 255)::INTEGER AS sat,
  least(greatest(trunc(0.5::FLOAT + ft * 255::FLOAT), 0), 255)::INTEGER AS val FROM wrapped)
{_hsv_sql(255)} UNION ALL {_hsv_sql(179)}""",
    "hsv_rgb": f"WITH {fx.RGB_SQL} {_rgb_sql(255)} UNION ALL {_rgb_sql(179)}",
    "yiq_rgb": f"""WITH {fx.RGB_SQL},
f AS (SELECT image_id, y, x, r::FLOAT * (1::FLOAT / 255::FLOAT) AS fy,
  g::FLOAT * ((-2::FLOAT * -0.5957::FLOAT) / 255::FLOAT) + (-0.5957)::FLOAT AS fi,
  b::FLOAT * ((-2::FLOAT * -0.5226::FLOAT) / 255::FLOAT) + (-0.5226)::FLOAT AS fq FROM rgb)
SELECT image_id, y, x,
  least(greatest(trunc((fy + 0.9563::FLOAT * fi + 0.6210::FLOAT * fq) * 255::FLOAT), 0), 255)::INTEGER AS red,
  least(greatest(trunc((fy + (-0.2721)::FLOAT * fi + (-0.6474)::FLOAT * fq) * 255::FLOAT), 0), 255)::INTEGER AS green,
  least(greatest(trunc((fy + (-1.1070)::FLOAT * fi + 1.7046::FLOAT * fq) * 255::FLOAT), 0), 255)::INTEGER AS blue FROM f""",
    "alpha_blend": f"""WITH {fx.RGB_SQL}
SELECT image_id, y, x, CASE WHEN b <= 60 THEN r
  ELSE (r * (255 - (b - 60))) // 256 + (g * (b - 59)) // 256 END AS v FROM rgb""",
    "ellipse_mask": f"""WITH {R}
SELECT image_id, y, x, CASE WHEN ((x - w // 2) / round_even(w * 0.5::DOUBLE, 0)) ** 2
  + ((y - round_even(h * 0.4::DOUBLE, 0)) / round_even(h * 0.8::DOUBLE, 0)) ** 2 <= 1 THEN v ELSE 128 END AS v
FROM raster JOIN sizes USING (image_id)""",
}
