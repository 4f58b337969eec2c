"""Queries on polar bands, filter responses and template building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import build, encode, polar
from ..operators import geometry as geo
from ..session import new_folder
from ..sources import boundaries
from ..sources.boundaries import read_raster
from . import fixtures as fx
from .pixels import R, f6
from .segmentation import CIRCLE_SQL

RADIAL, ANGULAR, WAVELENGTH = 6, 16, 6
SMALL = {"radial": RADIAL, "angular": ANGULAR, "wavelength": WAVELENGTH}


def boundary_files(spark, d):
    """Boundary points written as file texts and parsed back."""
    p = fx.boundary_points(spark, d)
    line = F.concat_ws(" ", "x", "y", F.when(F.col("valid"), "+").otherwise("-"))
    ring = lambda name: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("ring") == name, F.struct("k", line.alias("t"))))),
        lambda e: e["t"]), "\n")
    texts = p.groupBy("image_id").agg(F.concat(
        F.lit("points formatted x y [+|-]\n- denotes occluder, + denotes true boundary\n"
              "pupil-iris boundary: 8 points clockwise from north\n"), ring("pupil"),
        F.lit("\niris-sclera boundary: 8 points clockwise from north\n"), ring("iris")).alias("text"))
    return boundaries.parse_points(texts)


def circle_files(spark, d):
    """Circles written as file texts and parsed back."""
    c = geo.circles_from_points(fx.boundary_points(spark, d)).where(F.col("ri").isNotNull())
    texts = c.select("image_id", F.concat_ws(" ", "yi", "xi", "ri", "yp", "xp", "rp").alias("text"))
    return boundaries.parse_circles(texts)


def polar_grid(spark, d):
    g = polar.polar_grid(fx.circles(spark, d), 10, 40)
    return g.withColumn("px", fixed("px")).withColumn("py", fixed("py"))


def _band(spark, d):
    r = fx.raster(spark, d).where((F.col("v") >= 60) & (F.col("v") <= 250))
    return polar.polar_band(r, polar.polar_grid(fx.circles(spark, d), RADIAL, ANGULAR))


def polar_band(spark, d):
    return _band(spark, d).withColumn("v", fixed("v"))


def mean_fill(spark, d):
    return polar.fill_mean(_band(spark, d)).withColumn("v", fixed("v"))


def _vector_rows(spark, d):
    """Four rows of 16 values per vector."""
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"),
                    "embedding").select("image_id", "r", F.expr(
                        "transform(slice(embedding, r * 16 + 1, 16), e -> cast(e as double))").alias("v"),
                        F.expr("transform(slice(embedding, r * 16 + 1, 16), "
                               "e -> abs(cast(e as double)) < 0.01D)").alias("noise"))


def _vector_cells(spark, d, scales=2):
    return encode.response_cells(
        encode.filter_rows(_vector_rows(spark, d), ANGULAR, WAVELENGTH, 0.55, scales, 2))


def loggabor_rows(spark, d):
    cells = _vector_cells(spark, d)
    return cells.select("image_id", "r", "scale", "a", *[fixed(c).alias(c) for c in ("re", "im", "mag")])


def magnitude_thresholds(spark, d):
    t = encode.magnitude_thresholds(_vector_cells(spark, d))
    return t.withColumn("low", fixed("low")).withColumn("high", fixed("high"))


def coefficient_thresholds(spark, d):
    t = encode.coefficient_thresholds(_vector_cells(spark, d), 0.25)
    return t.withColumn("re", fixed("re")).withColumn("im", fixed("im"))


def phase_bits(spark, d):
    cells = _vector_cells(spark, d)
    return encode.phase_bits(cells).withColumn("ranked", F.lit(True)).unionByName(
        encode.phase_bits(cells, ranked=False).withColumn("ranked", F.lit(False)))


def _words(templates):
    both = F.posexplode(F.arrays_zip("code", "mask")).alias("word", "w")
    return templates.select("image_id", "data_type", "n_rad", "n_ang", both).select(
        "image_id", "data_type", "n_rad", "n_ang", "word", F.col("w.code").alias("code"),
        F.col("w.mask").alias("mask"))


def pack_template(spark, d):
    return _words(encode.pack_templates(encode.phase_bits(_vector_cells(spark, d)), 4, ANGULAR, scales=2))


def build_templates(spark, d):
    """The tuned path on a small grid, and enough noise to fill some cells."""
    r = fx.raster(spark, d).withColumn("noise", (F.col("v") < 30) | (F.col("v") > 240))
    return _words(build.build_templates(r, fx.circles(spark, d), sigma=0.55, **SMALL))


def build_from_boundary_points(spark, d):
    points = fx.boundary_points(spark, d, per_raster=True)
    return _words(build.build_from_boundaries(fx.raster(spark, d), points, highlight=200, **SMALL))


def build_from_circles(spark, d):
    return _words(build.build_from_circles(fx.raster(spark, d), fx.circles(spark, d),
                                           highlight=None, **SMALL))


# ------------------------------------------------------------------------ SQL

PI_SQL = "3.14159265358979::DOUBLE"


def _grid_sql(radial: int, angular: int, circles: str = "circles") -> str:
    return f"""rays AS (
  SELECT c.*, a, (xp - xi)::DOUBLE AS ox, (yp - yi)::DOUBLE AS oy, a * (2 * {PI_SQL}) / {angular - 1} AS theta
  FROM {circles} c, range({angular}) t(a)),
aims AS (
  SELECT *, ox * ox + oy * oy AS d2, CASE WHEN ox > 0 OR (ox = 0 AND oy > 0) THEN 1 ELSE -1 END
    * cos({PI_SQL} - CASE WHEN ox = 0 THEN {PI_SQL} / 2 ELSE atan(oy / ox) END - theta) AS b FROM rays),
grid AS (
  SELECT image_id, r::INTEGER AS r, a::INTEGER AS a, rho * cos(theta) + xp AS px, -rho * sin(theta) + yp AS py FROM (
    SELECT *, (sqrt(d2) * b + sqrt(d2 * b * b - (d2 - ri * ri)) - rp) * (r + 1) / {radial + 1} + rp AS rho
    FROM aims, range({radial}) q(r)))"""


BAND_SQL = """near AS (
  SELECT image_id, r, a, px - floor(px) AS s, py - floor(py) AS t, dx, dy,
    floor(px)::INTEGER - 1 + dx AS x, floor(py)::INTEGER - 1 + dy AS y
  FROM grid, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) n(dx, dy)),
corner AS (
  SELECT image_id, r, a, any_value(s) AS s, any_value(t) AS t, max(v) FILTER (dx = 0 AND dy = 0) AS v00,
    max(v) FILTER (dx = 1 AND dy = 0) AS v10, max(v) FILTER (dx = 0 AND dy = 1) AS v01,
    max(v) FILTER (dx = 1 AND dy = 1) AS v11
  FROM near LEFT JOIN usable USING (image_id, x, y) GROUP BY image_id, r, a),
band AS (
  SELECT image_id, r, a, ((v00 * (1 - t) + v01 * t) * (1 - s) + (v10 * (1 - t) + v11 * t) * s) / 255 AS v FROM corner),
filled AS (SELECT image_id, r, a, coalesce(v, avg(coalesce(v, 0.5)) OVER (PARTITION BY image_id)) AS v, v IS NULL AS noise FROM band)"""


def _response_sql(n: int, wavelength: int, sigma: float, scales: int, mult: int) -> str:
    """Responses of `filled` by a (a, b) kernel table."""
    lengths = ", ".join(f"({k}, {wavelength * mult ** k})" for k in range(scales))
    return f"""lengths(scale, wl) AS (VALUES {lengths}),
gains AS (
  SELECT scale, k, exp(-(pow(ln(k / {n // 2}e0 / 2 * wl), 2)) / (2 * pow(ln({sigma}::DOUBLE), 2))) AS g
  FROM lengths, range(1, {n // 2 + 1}) t(k)),
kern AS (
  SELECT scale, p, q, sum(g * cos(2 * pi() * k * (p - q) / {n})) / {n} AS re, sum(g * sin(2 * pi() * k * (p - q) / {n})) / {n} AS im
  FROM gains, range({n}) x(p), range({n}) y(q) GROUP BY ALL),
response AS (
  SELECT f.image_id, f.r, k.scale, k.p::INTEGER AS a, {f6('sum(f.v * k.re)', 12)} AS re, {f6('sum(f.v * k.im)', 12)} AS im
  FROM filled f JOIN kern k ON k.q = f.a GROUP BY ALL),
cells AS (SELECT *, sqrt(im * im + re * re) AS mag FROM response)"""


RANKED_SQL = """ranks AS (
  SELECT image_id, scale, mag, row_number() OVER (PARTITION BY image_id, scale ORDER BY mag) AS k,
    count(*) OVER (PARTITION BY image_id, scale) AS n FROM cells),
limits AS (
  SELECT image_id, scale, max(mag) FILTER (k = greatest(floor(n * 0.02::FLOAT::DOUBLE), 1)) AS low,
    max(mag) FILTER (k = greatest(floor(n * 0.85::FLOAT::DOUBLE), 1)) AS high FROM ranks GROUP BY ALL),
bits AS (
  SELECT c.image_id, c.r, c.a, c.scale, re > 0 AS bit_re, im > 0 AS bit_im, f.noise OR mag < low OR mag > high AS masked
  FROM cells c JOIN filled f ON f.image_id = c.image_id AND f.r = c.r AND f.a = c.a
  JOIN limits l ON l.image_id = c.image_id AND l.scale = c.scale)"""

FIXED_BITS_SQL = """fixed_bits AS (
  SELECT c.image_id, c.r, c.a, c.scale, re > 0 AS bit_re, im > 0 AS bit_im, f.noise OR mag < 0.0001 AS masked
  FROM cells c JOIN filled f ON f.image_id = c.image_id AND f.r = c.r AND f.a = c.a)"""


def _pack_sql(bits: str, radial: int, angular: int, scales: int) -> str:
    n_ang = 2 * scales * angular
    total, words = radial * n_ang, (radial * n_ang + 63) // 64
    pad = (1 << 64) - (1 << (total % 64)) if total % 64 else 0
    sign = lambda c: f"CASE WHEN {c} >= 9223372036854775808::HUGEINT THEN {c} - 18446744073709551616::HUGEINT ELSE {c} END"
    return f"""flat AS (
  SELECT image_id, r * {n_ang} + a * {2 * scales} + 2 * scale + h AS i, CASE WHEN h = 0 THEN bit_re ELSE bit_im END AS b, masked
  FROM {bits}, range(2) t(h)),
packed AS (
  SELECT image_id, (i // 64)::INTEGER AS word, sum(CASE WHEN b THEN 1::HUGEINT << (i % 64)::INTEGER ELSE 0::HUGEINT END)::HUGEINT AS code,
    sum(CASE WHEN masked THEN 1::HUGEINT << (i % 64)::INTEGER ELSE 0::HUGEINT END)::HUGEINT AS mask FROM flat GROUP BY ALL),
padded AS (SELECT * REPLACE (mask + CASE WHEN word = {words - 1} THEN {pad}::HUGEINT ELSE 0::HUGEINT END AS mask) FROM packed)
SELECT image_id, 0 AS data_type, {radial} AS n_rad, {n_ang} AS n_ang, word,
  ({sign('code')})::BIGINT AS code, ({sign('mask')})::BIGINT AS mask FROM padded"""


VECTORS_SQL = """filled AS (
  SELECT vec_id AS image_id, (i // 16)::INTEGER AS r, (i % 16)::INTEGER AS a, embedding[i + 1]::DOUBLE AS v,
    abs(embedding[i + 1]::DOUBLE) < 0.01 AS noise FROM embeddings, range(64) t(i))"""
VECTOR_CELLS = f"{VECTORS_SQL}, {_response_sql(ANGULAR, WAVELENGTH, 0.55, 2, 2)}"
SMALL_BAND = f"""{R}, usable AS (SELECT image_id, y, x, v::DOUBLE AS v FROM raster WHERE v BETWEEN 60 AND 250),
{fx.CIRCLES_SQL}, {_grid_sql(RADIAL, ANGULAR)}, {BAND_SQL}"""

def image_table(spark, d):
    """Stored grey images of 8 × 8 pixels, one per vector, written and scanned as pixels."""
    folder = new_folder(spark, "images")
    pixels = F.expr("transform(embedding, e -> cast(least(greatest(floor((cast(e as double) + 0.6D) * 212), 0), 255)"
                    " as int))")
    (fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"),
                                             pixels.alias("pixels")).write.parquet(folder))
    return read_raster(spark, folder)


QUERIES = {f.__name__: f for f in (
    image_table, boundary_files, circle_files, polar_grid, polar_band, mean_fill, loggabor_rows,
    magnitude_thresholds, coefficient_thresholds, phase_bits, pack_template, build_templates,
    build_from_boundary_points, build_from_circles)}

ORACLES = {
    "image_table": """SELECT vec_id AS image_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x,
  least(greatest(floor((embedding[i + 1]::DOUBLE + 0.6::DOUBLE) * 212), 0), 255)::INTEGER AS v
FROM embeddings, range(64) t(i)""",
    "boundary_files": f"WITH {fx.boundary_sql()} SELECT image_id, ring, k, x, y, valid FROM boundary",
    "circle_files": f"WITH RECURSIVE {fx.boundary_sql()}, {CIRCLE_SQL} SELECT * FROM found WHERE ri IS NOT NULL",
    "polar_grid": f"WITH {fx.CIRCLES_SQL}, {_grid_sql(10, 40)} SELECT image_id, r, a, {f6('px')} AS px, {f6('py')} AS py FROM grid",
    "polar_band": f"WITH {SMALL_BAND} SELECT image_id, r, a, {f6('v')} AS v, v IS NULL AS noise FROM band",
    "mean_fill": f"WITH {SMALL_BAND} SELECT image_id, r, a, {f6('v')} AS v, noise FROM filled",
    "loggabor_rows": f"""WITH {VECTOR_CELLS}
SELECT image_id, r, scale, a, {f6('re')} AS re, {f6('im')} AS im, {f6('mag')} AS mag FROM cells""",
    "magnitude_thresholds": f"WITH {VECTOR_CELLS}, {RANKED_SQL} SELECT image_id, scale, {f6('low')} AS low, {f6('high')} AS high FROM limits",
    "coefficient_thresholds": f"""WITH {VECTOR_CELLS},
re_ranks AS (SELECT image_id, scale, abs(re) AS v, row_number() OVER (PARTITION BY image_id, scale ORDER BY abs(re)) - 1 AS k,
  count(*) OVER (PARTITION BY image_id, scale) AS n FROM cells),
im_ranks AS (SELECT image_id, scale, abs(im) AS v, row_number() OVER (PARTITION BY image_id, scale ORDER BY abs(im)) - 1 AS k,
  count(*) OVER (PARTITION BY image_id, scale) AS n FROM cells)
SELECT r.image_id, r.scale, {f6('r.v')} AS re, {f6('i.v')} AS im FROM re_ranks r
JOIN im_ranks i ON i.image_id = r.image_id AND i.scale = r.scale AND i.k = r.k WHERE r.k = floor(r.n * 0.25)""",
    "phase_bits": f"""WITH {VECTOR_CELLS}, {RANKED_SQL}, {FIXED_BITS_SQL}
SELECT *, true AS ranked FROM bits UNION ALL SELECT *, false FROM fixed_bits""",
    "pack_template": f"WITH {VECTOR_CELLS}, {RANKED_SQL}, {_pack_sql('bits', 4, ANGULAR, 2)}",
    "build_templates": f"""WITH {R}, usable AS (SELECT image_id, y, x, v::DOUBLE AS v FROM raster WHERE v BETWEEN 30 AND 240),
{fx.CIRCLES_SQL}, {_grid_sql(RADIAL, ANGULAR)}, {BAND_SQL}, {_response_sql(ANGULAR, WAVELENGTH, 0.55, 1, 1)},
{RANKED_SQL}, {_pack_sql('bits', RADIAL, ANGULAR, 1)}""",
    "build_from_boundary_points": None,
    "build_from_circles": f"""WITH {R}, usable AS (SELECT image_id, y, x, v::DOUBLE AS v FROM raster WHERE v >= 1),
{fx.CIRCLES_SQL}, {_grid_sql(RADIAL, ANGULAR)}, {BAND_SQL}, {_response_sql(ANGULAR, WAVELENGTH, 0.5, 1, 1)},
{FIXED_BITS_SQL}, {_pack_sql('fixed_bits', RADIAL, ANGULAR, 1)}""",
}

from .segmentation import ORACLES as _SEGMENTED  # noqa: E402

_OCCLUDED = _SEGMENTED["occlusion_noise"].rsplit("SELECT * FROM sure", 1)[0].rstrip()
ORACLES["build_from_boundary_points"] = f"""{_OCCLUDED},
usable AS (SELECT image_id, y, x, v::DOUBLE AS v FROM sure WHERE v BETWEEN 1 AND 200 AND NOT noise),
{_grid_sql(RADIAL, ANGULAR, 'found')}, {BAND_SQL}, {_response_sql(ANGULAR, WAVELENGTH, 0.5, 1, 1)},
{FIXED_BITS_SQL}, {_pack_sql('fixed_bits', RADIAL, ANGULAR, 1)}"""
