"""Queries on boundaries, masks, candidates, detections and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numeric import fixed
from ..operators import geometry as geo
from ..operators import masks
from ..operators import raster as ops
from . import fixtures as fx
from .pixels import R, f6


def highlight_noise(spark, d):
    return masks.reflection_noise(fx.raster(spark, d))


def glare_noise(spark, d):
    return masks.glare_noise(fx.raster(spark, d), 180)


def _image_anchors(spark, d):
    """Anchors of both eyelids on the raster images, from each image's height."""
    h = F.col("h")
    sizes = ops.image_sizes(fx.raster(spark, d))
    heights = {"t0": h % 7, "t1": h % 5 + 3, "t2": h % 11 - 4,
               "b0": h - h % 9, "b1": h - 6, "b2": h - h % 4 - 2}
    return sizes.select("image_id", F.lit(4).alias("x0"), F.lit(33).alias("x1"), F.lit(60).alias("x2"),
                        *[c.cast("int").alias(n) for n, c in heights.items()])


def eyelid_curve(spark, d):
    a = _image_anchors(spark, d)
    parts = [masks.eyelid_curve(masks.one_lid(a, lid), curved)
             .withColumn("lid", F.lit(lid)).withColumn("curved", F.lit(curved))
             for lid in ("t", "b") for curved in (True, False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eyelid_noise(spark, d):
    a = _image_anchors(spark, d)
    top, bottom = (masks.eyelid_curve(masks.one_lid(a, lid)) for lid in ("t", "b"))
    return masks.eyelid_noise(fx.raster(spark, d), top, bottom)


def eyelid_anchors(spark, d):
    e = fx.eyelid_extents(spark, d)
    return masks.eyelid_anchors(e).withColumn("curved", F.lit(True)).unionByName(
        masks.eyelid_anchors(e, curved=False).withColumn("curved", F.lit(False)))


def circle_from_points(spark, d):
    return geo.circles_from_points(fx.boundary_points(spark, d))


def occlusion_noise(spark, d):
    points = fx.boundary_points(spark, d, per_raster=True)
    lines = masks.occlusion_lines(points, geo.circles_from_points(points))
    return masks.occlusion_noise(fx.raster(spark, d), lines)


def circle_points(spark, d):
    """The iris circle of every boundary-point image, on a 300 × 260 frame."""
    c = geo.circles_from_points(fx.boundary_points(spark, d))
    return geo.circle_points(c.select("image_id", F.col("xi").alias("cx"), F.col("yi").alias("cy"),
                                      F.col("ri").alias("r"), F.lit(300).alias("w"),
                                      F.lit(260).alias("h")), sides=40)


def _lines(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"),
                    F.expr("cast(embedding[0] as double)").alias("a"),
                    F.expr("cast(embedding[1] as double) + 0.9D").alias("b"),
                    F.expr("-25 - 100 * cast(embedding[2] as double)").alias("c"),
                    F.lit(64).alias("w"), F.lit(50).alias("h"))


def line_points(spark, d):
    return geo.line_points(_lines(spark, d))


def centre_reconcile(spark, d):
    """Centres from order lines: a region centre, a found centre and a limit."""
    l = fx.table(spark, d, "lineitem")
    df = l.select("l_orderkey", "l_linenumber", F.lit(82).alias("px"), F.lit(82).alias("py"),
                  (F.col("l_partkey") % 164).alias("xi"), (F.col("l_suppkey") % 164).alias("yi"),
                  (F.col("l_partkey") % 640).alias("xp"), (F.col("l_suppkey") % 480).alias("yp"),
                  F.lit(20).alias("allowed"))
    return geo.reconcile_centre(df).select("l_orderkey", "l_linenumber", "xp", "yp", "xi", "yi")


def candidate_choice(spark, d):
    c = fx.candidates(spark, d)
    return geo.choose_candidate(c, ratio=0.8, max_r=30)


def pupil_fallback(spark, d):
    chosen = geo.choose_candidate(fx.candidates(spark, d), ratio=0.8, max_r=24)
    return geo.pupil_fallback(chosen.withColumn("w", F.lit(640)).withColumn("h", F.lit(480))
                              .withColumn("max_r", F.lit(24))).drop("w", "h", "max_r")


def iris_fallback(spark, d):
    l = fx.table(spark, d, "lineitem")
    df = l.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("xi"),
                  (F.col("l_suppkey") % 50).alias("yi"), (F.col("l_partkey") % 120).alias("ri"),
                  F.lit(640).alias("w"), F.lit(480).alias("h"), F.lit(82).alias("max_r"))
    return geo.iris_fallback(df).select("l_orderkey", "l_linenumber", "xi", "yi", "ri")


def threshold_sweep(spark, d):
    return geo.sweep_candidates(fx.candidates(spark, d), geo.ratio_steps(1.0), max_r=42)


def two_eye_split(spark, d):
    sided = geo.split_two_eyes(fx.candidates(spark, d), 640)
    chosen = geo.choose_candidate(sided, 0.8, 42, by=("image_id", "threshold", "side"))
    return (geo.join_two_eyes(chosen, 640).where(F.col("rp").isNotNull())
            .select("image_id", "threshold", "side", "xp", "yp", "rp"))


def eye_alignment(spark, d):
    l = fx.table(spark, d, "lineitem")
    df = l.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 300).alias("x1"),
                  (F.col("l_suppkey") % 200).alias("y1"), (F.col("l_partkey") % 300 + 320).alias("x2"),
                  (F.col("l_partkey") % 200).alias("y2"))
    return geo.align_eyes(df, 82).withColumn("angle", fixed("angle"))


def affine_resample(spark, d):
    r = fx.raster(spark, d)
    maps = geo.rotation_map(ops.image_sizes(r), F.col("image_id") * 7.0, F.lit(0.9))
    return geo.affine_resample(r, maps)


def two_eye_rasters(spark, d):
    """Both eyes of every raster image, around pupils placed by image number."""
    r, i = fx.raster(spark, d), F.col("image_id")
    place = lambda c: c.cast("int")
    pupils = r.select("image_id").distinct().select(
        "image_id", place(10 + i % 7).alias("x1"), place(9 + i % 5).alias("y1"),
        place(45 + i % 9).alias("x2"), place(8 + (i * 3) % 7).alias("y2"))
    return geo.eye_rasters(r, pupils, 8)


def area_resize(spark, d):
    return geo.area_resize(fx.raster(spark, d), 20, 13)


def _boxes(spark, d):
    return fx.detections(spark, d).select("image_id", "x", "y", "w", "h").distinct()


def point_ops(spark, d):
    b = _boxes(spark, d)
    p = (F.col("x").cast("double"), F.col("y").cast("double"))
    q = (F.col("w").cast("double"), F.col("h").cast("double"))
    named = {"sum": g.add(p, q), "diff": g.subtract(p, q), "scaled": g.scale(p, 1.5),
             "turned": g.rotate(p, 30.0), "turned_about": g.rotate_around(p, q, 30.0),
             "scaled_about": g.scale_around(p, q, 0.5),
             "mapped": g.map_rotated(p, (F.lit(640.0), F.lit(480.0)), 15.0, 0.5)}
    cols = [fixed(c).alias(f"{n}_{axis}") for n, pt in named.items() for c, axis in zip(pt, "xy")]
    return b.select("image_id", "x", "y", "w", "h", *cols,
                    fixed(g.distance(p, q)).alias("distance"),
                    fixed(g.angle_between(p, q)).alias("angle"),
                    g.scaled_value(F.col("x"), 1.5, 300, whole=True).alias("capped"),
                    fixed(g.scaled_value(p[1], 1.25, 200.0)).alias("capped_real"))


def rect_ops(spark, d):
    b = _boxes(spark, d)
    r = tuple(F.col(c) for c in ("x", "y", "w", "h"))
    named = {"scaled": g.scale_rect(r, 1.5, 0.5, 639, 479),
             "grown": g.scale_rect_in_place(r, 1.5, 1.25, 2.0, 3.0, 639, 479),
             "free": g.scale_rect_in_place(r, 0.5, 0.75),
             "moved": g.offset_rect(r, (r[2], r[3])), "cropped": g.crop_rect(r, 600, 400)}
    cols = [c.cast("int").alias(f"{n}_{a}") for n, rect in named.items() for c, a in zip(rect, "xywh")]
    return b.select("image_id", *r, *cols)


def detections_largest(spark, d):
    settled = geo.settle_detections(fx.detections(spark, d), 1.3, 640, 480)
    return geo.largest_detection(settled)


def eye_regions(spark, d):
    return geo.eye_regions(fx.detections(spark, d), 2, 100, 45, 8)


def detector_fallback(spark, d):
    det = fx.detections(spark, d).withColumn(
        "side", F.when(F.col("h") % 40 == 20, "left").otherwise("right"))
    first, second = det.where(F.col("w") > 100), det.where(F.col("w") <= 100)
    faces = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 300 + 100).cast("int").alias("w"),
        (F.col("o_custkey") % 200 + 100).cast("int").alias("h")).distinct()
    return geo.eye_centres(faces, first, second)


# ------------------------------------------------------------------------ SQL

ANCHORS_SQL = f"""{R},
anchors AS (
  SELECT image_id, 4e0 AS x0, 33e0 AS x1, 60e0 AS x2, h % 7 AS t0, h % 5 + 3 AS t1, h % 11 - 4 AS t2,
    h - h % 9 AS b0, h - 6 AS b1, h - h % 4 - 2 AS b2 FROM sizes),
lids AS (SELECT image_id, x0, x1, x2, 't' AS lid, t0 AS f0, t1 AS f1, t2 AS f2 FROM anchors
         UNION ALL SELECT image_id, x0, x1, x2, 'b', b0, b1, b2 FROM anchors),
curves AS (
  SELECT image_id, lid, i::INTEGER AS x, f0,
    trunc((i - x1) / (x0 - x1) * ((i - x2) / (x0 - x2)) * f0 + (i - x0) / (x1 - x0) * ((i - x2) / (x1 - x2)) * f1
      + (i - x0) / (x2 - x0) * ((i - x1) / (x2 - x1)) * f2)::INTEGER AS l
  FROM lids, range(4, 61) t(i)),
lid_y AS (SELECT image_id, lid, x, CASE WHEN l < 1 THEN f0 ELSE l END AS y, f0 FROM curves)"""


def _good(name):
    return f"CASE WHEN {name} BETWEEN 1 AND h - 1 THEN {name} END"


def _lim(v, top):
    return f"least(greatest({v}, 1), {top})"


def _anchor_sql(curved: bool) -> str:
    extra = "ri // 2" if curved else "0"
    edge, end = _lim(f"{_lim('yi - ri', 'h - 1')} + 1", "yi"), _lim("yi + ri - 1" if curved else "yi + ri", "h - 1")
    if curved:
        body = f"""SELECT *, coalesce(a, b, edge) AS tl, coalesce(b, a, edge) AS tr, coalesce(c, e, fin) AS bl,
      coalesce(e, c, fin) AS br,
      greatest(coalesce(p, edge), coalesce(q, edge), coalesce(ct_max, -1)) AS mt,
      least(coalesce(r, fin), coalesce(s, fin), coalesce(cb_min, h + 1)) AS mb FROM base"""
        cols = ("greatest(tl, mt)", "mt", "greatest(tr, mt)", "least(bl, mb)", "mb", "least(br, mb)")
    else:
        body = "SELECT * FROM base"
        cols = ("coalesce(t, edge)",) * 3 + ("coalesce(u, fin)",) * 3
    named = ", ".join(f"({c} {'+' if i < 3 else '-'} 2)::INTEGER AS {'t' if i < 3 else 'b'}{i % 3}"
                      for i, c in enumerate(cols))
    return f"""SELECT image_id, {_lim(f'xi - ri - {extra}', 'w - 1')}::INTEGER AS x0, xi::INTEGER AS x1,
  {_lim(f'xi + ri + {extra}', 'w')}::INTEGER AS x2, {named}, {str(curved).lower()} AS curved
FROM (WITH base AS (SELECT *, {edge} AS edge, {end} AS fin, {_good('lt_max')} AS a, {_good('rt_max')} AS b,
    {_good('lb_min')} AS c, {_good('rb_min')} AS e, {_good('lt_min')} AS p, {_good('rt_min')} AS q,
    {_good('lb_max')} AS r, {_good('rb_max')} AS s, {_good('t_max')} AS t, {_good('cb_min')} AS u FROM extents)
  {body})"""


CIRCLE_SQL = """pairs AS (
  SELECT a.image_id, a.ring, (a.x + b.x) // 2 AS mx, (a.y + b.y) // 2 AS my
  FROM boundary a JOIN boundary b ON b.image_id = a.image_id AND b.ring = a.ring AND b.k = a.k + 4
  WHERE a.valid AND b.valid),
mids AS (SELECT image_id, ring, sum(mx)::BIGINT // count(*) AS cx, sum(my)::BIGINT // count(*) AS cy FROM pairs GROUP BY ALL),
centres AS (
  SELECT p.image_id, p.cx AS xp, p.cy AS yp, coalesce(i.cx, p.cx) AS xi, coalesce(i.cy, p.cy) AS yi
  FROM mids p LEFT JOIN mids i ON i.image_id = p.image_id AND i.ring = 'iris' WHERE p.ring = 'pupil'),
ranged AS (
  SELECT b.image_id, b.ring, b.k, b.valid, CASE WHEN NOT b.valid THEN 0 WHEN b.ring = 'pupil'
    THEN sqrt(((yp - b.y)::DOUBLE * (yp - b.y) + (xp - b.x) * (xp - b.x))::DOUBLE)
    ELSE sqrt(((yi - b.y)::DOUBLE * (yi - b.y) + (xi - b.x) * (xi - b.x))::DOUBLE) END AS dist
  FROM boundary b JOIN centres USING (image_id)),
walk(image_id, ring, k, total, n) AS (
  SELECT image_id, ring, 0, trunc(dist)::INTEGER, valid::INTEGER FROM ranged WHERE k = 0
  UNION ALL
  SELECT w.image_id, w.ring, w.k + 1, trunc(w.total + r.dist)::INTEGER, w.n + r.valid::INTEGER
  FROM walk w JOIN ranged r ON r.image_id = w.image_id AND r.ring = w.ring AND r.k = w.k + 1),
radii AS (SELECT image_id, ring, CASE WHEN n > 0 THEN total // n END AS r FROM walk WHERE k = 7),
found AS (
  SELECT c.image_id, xp::INTEGER AS xp, yp::INTEGER AS yp, p.r AS rp, xi::INTEGER AS xi, yi::INTEGER AS yi, i.r AS ri
  FROM centres c JOIN radii p ON p.image_id = c.image_id AND p.ring = 'pupil'
  JOIN radii i ON i.image_id = c.image_id AND i.ring = 'iris')"""


def _choice_sql(ratio: float, max_r: int, by: str = "image_id, threshold", source: str = "candidates") -> str:
    return f"""{fx.CANDIDATES_SQL},
sided AS (
  SELECT * EXCLUDE (cx), CASE WHEN cx < 256 THEN 'right' ELSE 'left' END AS side,
    CASE WHEN cx < 256 THEN cx ELSE cx - 384 END AS cx FROM candidates WHERE cx < 256 OR cx >= 384),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY count DESC) AS n FROM {source}),
seconds AS (SELECT *, min(count) FILTER (n <= 2) OVER (PARTITION BY {by}) AS second FROM ranked),
tried AS (
  SELECT *, CASE WHEN least(w, h) >= trunc(greatest(w, h) * {ratio}::DOUBLE) THEN greatest(w, h) // 2 + 1 ELSE {max_r + 1} END AS r
  FROM seconds WHERE count >= second AND count > 16),
listed AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY count DESC, ord, cx, cy, r) AS seq FROM tried),
chosen AS (
  SELECT {by}, min_by(cx, seq) FILTER (r < {max_r}) AS xp, min_by(cy, seq) FILTER (r < {max_r}) AS yp,
    min_by(r, seq) FILTER (r < {max_r})::INTEGER AS rp, max_by(cx, seq) AS last_x, max_by(cy, seq) AS last_y,
    max_by(r, seq)::INTEGER AS last_r FROM listed GROUP BY {by})"""


STEP_SQL = """steps(pass, step, ratio) AS (
  SELECT p, 1, 1e0 FROM range(1, 3) t(p)
  UNION ALL SELECT pass, step + 1, ratio - 0.05::DOUBLE FROM steps
  WHERE ratio - 0.05::DOUBLE > CASE pass WHEN 1 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END)"""

_S15, _C15 = "sin(15e0 * (pi() / 180))", "cos(15e0 * (pi() / 180))"
_S30, _C30 = "sin(30e0 * (pi() / 180))", "cos(30e0 * (pi() / 180))"


def _in_place(n, s, border, lim):
    pos, size = n
    a, b = f"{pos} - round_even({size} * {(s - 1.0) * 0.5}::DOUBLE + {border}, 0)", f"round_even({size} * {s}::DOUBLE + {2 * border}, 0)"
    if not lim:
        return a, b
    a0, b0 = f"greatest({a}, 0)", f"(CASE WHEN {a} < 0 THEN {b} + {a} ELSE {b} END)"
    return a0, f"CASE WHEN {a0} + {b0} > {lim} THEN {lim} - {a0} ELSE {b0} END"


def _rect_sql() -> str:
    gx, gw = _in_place(("x", "w"), 1.5, 2.0, 639)
    gy, gh = _in_place(("y", "h"), 1.25, 3.0, 479)
    fx_, fw = _in_place(("x", "w"), 0.5, 0.0, 0)
    fy_, fh = _in_place(("y", "h"), 0.75, 0.0, 0)
    r = lambda c, s: f"round_even({c} * {s}::DOUBLE, 0)"
    crop = lambda p, s, n: (f"least(greatest({p}, 0), {n - 1})",
                            f"(CASE WHEN greatest(CASE WHEN {p} + {s} > {n} THEN {n} - {p} ELSE {s} END, 0) > {n} "
                            f"THEN {n} - least(greatest({p}, 0), {n - 1}) "
                            f"ELSE greatest(CASE WHEN {p} + {s} > {n} THEN {n} - {p} ELSE {s} END, 0) END)")
    cx, cw = crop("x", "w", 600)
    cy, ch = crop("y", "h", 400)
    cols = {
        "scaled_x": r("x", 1.5), "scaled_y": r("y", 0.5),
        "scaled_w": f"CASE WHEN {r('x', 1.5)} + {r('w', 1.5)} > 639 THEN 639 - {r('x', 1.5)} ELSE {r('w', 1.5)} END",
        "scaled_h": f"CASE WHEN {r('y', 0.5)} + {r('h', 0.5)} > 479 THEN 479 - {r('y', 0.5)} ELSE {r('h', 0.5)} END",
        "grown_x": gx, "grown_y": gy, "grown_w": gw, "grown_h": gh,
        "free_x": fx_, "free_y": fy_, "free_w": fw, "free_h": fh,
        "moved_x": "x + w", "moved_y": "y + h", "moved_w": "w", "moved_h": "h",
        "cropped_x": cx, "cropped_y": cy, "cropped_w": cw, "cropped_h": ch}
    return ", ".join(f"({c})::INTEGER AS {n}" for n, c in cols.items())


QUERIES = {f.__name__: f for f in (
    highlight_noise, glare_noise, eyelid_curve, eyelid_noise, eyelid_anchors, circle_from_points,
    occlusion_noise, circle_points, line_points, centre_reconcile, candidate_choice,
    pupil_fallback, iris_fallback, threshold_sweep, two_eye_split, eye_alignment,
    affine_resample, two_eye_rasters, area_resize, point_ops, rect_ops, detections_largest, eye_regions,
    detector_fallback)}

ORACLES = {
    "highlight_noise": f"WITH {R} SELECT image_id, y, x, v, v < 3 OR v > 250 AS noise FROM raster",
    "glare_noise": f"WITH {R} SELECT image_id, y, x, v, v > 180 AS noise FROM raster",
    "eyelid_curve": f"""WITH {ANCHORS_SQL}
SELECT image_id, lid, x, y, true AS curved FROM lid_y UNION ALL SELECT image_id, lid, x, f0, false FROM lid_y""",
    "eyelid_noise": f"""WITH {ANCHORS_SQL}
SELECT r.image_id, r.y, r.x, r.v, coalesce(r.y <= t.y OR r.y >= b.y, false) AS noise
FROM raster r LEFT JOIN lid_y t ON t.image_id = r.image_id AND t.lid = 't' AND t.x = r.x AND t.x < 60
LEFT JOIN lid_y b ON b.image_id = r.image_id AND b.lid = 'b' AND b.x = r.x AND b.x < 60""",
    "eyelid_anchors": f"WITH {fx.EXTENTS_SQL} {_anchor_sql(True)} UNION ALL {_anchor_sql(False)}",
    "circle_from_points": f"WITH RECURSIVE {fx.boundary_sql()}, {CIRCLE_SQL} SELECT * FROM found",
    "occlusion_noise": f"""WITH RECURSIVE {R}, {fx.boundary_sql(True)}, {CIRCLE_SQL},
spots AS (
  SELECT i.image_id, i.k, i.x, i.y, l.x AS lx, l.y AS ly, l.valid AS lv FROM boundary i
  JOIN boundary l ON l.image_id = i.image_id AND l.ring = 'iris' AND l.k = (i.k + 7) % 8
  WHERE i.ring = 'iris' AND NOT i.valid),
hidden_lines AS (
  SELECT image_id, NULL::DOUBLE AS a, NULL::DOUBLE AS b, x::DOUBLE AS up FROM spots WHERE k % 4 = 2
  UNION ALL SELECT image_id, s, y - s * x, NULL FROM (
    SELECT *, CASE k % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.26::DOUBLE ELSE (-0.26)::DOUBLE END AS s FROM spots) WHERE k % 4 <> 2
  UNION ALL SELECT image_id, s, y - s * x, NULL FROM (
    SELECT *, (ly - y) / (lx - x) AS s FROM spots WHERE NOT lv AND lx <> x)),
sure AS (
  SELECT r.image_id, r.y, r.x, any_value(r.v) AS v, coalesce(bool_or(CASE WHEN l.up IS NOT NULL
      THEN (l.up - r.x) * (l.up - f.xi) <= 0 ELSE (l.a * r.x + l.b - r.y) * (l.a * f.xi + l.b - f.yi) <= 0 END), false) AS noise
  FROM raster r JOIN found f USING (image_id) LEFT JOIN hidden_lines l ON l.image_id = r.image_id
  GROUP BY r.image_id, r.y, r.x)
SELECT * FROM sure""",
    "circle_points": f"""WITH RECURSIVE {fx.boundary_sql()}, {CIRCLE_SQL}
SELECT image_id, k::INTEGER AS k,
  least(greatest(trunc(ri * cos(k * 3.14159265358979::DOUBLE / 40) + xi + 5e-13 + 0.5), 1), 300)::INTEGER AS x,
  least(greatest(trunc(ri * sin(k * 3.14159265358979::DOUBLE / 40) + yi + 5e-13 + 0.5), 1), 260)::INTEGER AS y
FROM found, range(81) t(k)""",
    "line_points": """SELECT vec_id AS image_id, i::INTEGER AS x,
  trunc(least(greatest((-(-25 - 100 * embedding[3]::DOUBLE) - embedding[1]::DOUBLE * i) / (embedding[2]::DOUBLE + 0.9::DOUBLE), 1), 50)
    + 5e-13)::INTEGER AS y FROM embeddings, range(1, 65) t(i)""",
    "centre_reconcile": """SELECT l_orderkey, l_linenumber, l_partkey % 640 AS xp, l_suppkey % 480 AS yp,
  l_partkey % 640 + CASE WHEN abs(l_partkey % 164 - 82) > 20 THEN 0 ELSE l_partkey % 164 - 82 END AS xi,
  l_suppkey % 480 + CASE WHEN abs(l_suppkey % 164 - 82) > 20 THEN 0 ELSE l_suppkey % 164 - 82 END AS yi FROM lineitem""",
    "candidate_choice": f"WITH {_choice_sql(0.8, 30)} SELECT * FROM chosen",
    "pupil_fallback": f"""WITH {_choice_sql(0.8, 24)}
SELECT image_id, threshold,
  CASE WHEN rp IS NOT NULL THEN xp WHEN last_x < 1 OR last_x > 639 THEN 320 ELSE last_x END AS xp,
  CASE WHEN rp IS NOT NULL THEN yp WHEN last_y < 1 OR last_y > 479 THEN 240 ELSE last_y END AS yp,
  CASE WHEN rp IS NOT NULL THEN rp WHEN last_r < 1 OR last_r > 24 THEN 12 ELSE last_r END AS rp FROM chosen""",
    "iris_fallback": """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey % 50 < 2 THEN 320 ELSE l_partkey % 50 END AS xi,
  CASE WHEN l_suppkey % 50 < 2 THEN 240 ELSE l_suppkey % 50 END AS yi,
  CASE WHEN l_partkey % 120 < 2 OR l_partkey % 120 > 82 THEN 82 ELSE l_partkey % 120 END AS ri FROM lineitem""",
    "threshold_sweep": f"""WITH RECURSIVE {fx.CANDIDATES_SQL}, {STEP_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, pass, threshold ORDER BY count DESC) AS n FROM candidates),
seconds AS (SELECT *, min(count) FILTER (n <= 2) OVER (PARTITION BY image_id, pass, threshold) AS second FROM ranked),
visits AS (
  SELECT c.*, s.step, greatest(w, h) // 2 + 1 AS r FROM seconds c JOIN steps s USING (pass)
  WHERE count >= second AND count > 16 AND cx > 0 AND cy > 0 AND greatest(w, h) // 2 + 1 < 42
    AND least(w, h) >= trunc(greatest(w, h) * s.ratio)
    AND CASE WHEN pass = 1 THEN threshold BETWEEN 0 AND start ELSE threshold > start AND threshold < start + 40 END)
SELECT image_id, pass, threshold, cx AS xp, cy AS yp, r::INTEGER AS rp FROM visits
QUALIFY row_number() OVER (PARTITION BY image_id
  ORDER BY pass, step, abs(threshold - start), count DESC, ord, threshold, cx, cy, r) = 1""",
    "two_eye_split": f"""WITH {_choice_sql(0.8, 42, 'image_id, threshold, side', 'sided')}
SELECT image_id, threshold, side, CASE WHEN side = 'right' THEN xp
  WHEN least(greatest(xp + 384, 1), 639) = 1 THEN 385 ELSE least(greatest(xp + 384, 1), 639) END::INTEGER AS xp, yp, rp
FROM chosen WHERE rp IS NOT NULL""",
    "eye_alignment": f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS x1, l_suppkey % 200 AS y1,
  l_partkey % 300 + 320 AS x2, l_partkey % 200 AS y2 FROM lineitem),
t AS (SELECT *, acos(abs(x2 - x1) / sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)) * (180 / 3.14159265358979::DOUBLE) AS deg,
  round_even((y1 - y2) * 0.5::DOUBLE, 0)::BIGINT AS half FROM e)
SELECT l_orderkey, l_linenumber, x1, y1, x2, y2, {f6('CASE WHEN y1 < y2 THEN -deg ELSE deg END')} AS angle,
  x1 - 114 AS right_x, y1 - half - 90 AS right_y, x2 - 114 AS left_x, y2 + half - 90 AS left_y, 228 AS crop_w, 180 AS crop_h FROM t""",
    "affine_resample": f"""WITH {R},
maps AS (
  SELECT image_id, w, h, round_even(w * 0.9::DOUBLE, 0) AS ow, round_even(h * 0.9::DOUBLE, 0) AS oh,
    cos(image_id * 7e0 * (pi() / 180)) / 0.9::DOUBLE AS c, sin(image_id * 7e0 * (pi() / 180)) / 0.9::DOUBLE AS s FROM sizes),
grid AS (
  SELECT m.*, xx, yy, c * xx + s * yy + (w * 0.5::DOUBLE - c * ((ow - 1) * 0.5::DOUBLE) - s * ((oh - 1) * 0.5::DOUBLE)) AS sx,
    (-s) * xx + c * yy + (h * 0.5::DOUBLE + s * ((ow - 1) * 0.5::DOUBLE) - c * ((oh - 1) * 0.5::DOUBLE)) AS sy
  FROM maps m, range(200) a(xx), range(400) b(yy) WHERE xx < ow AND yy < oh),
corner AS (
  SELECT image_id, xx, yy, least(greatest(floor(sx) + dx, 0), w - 1)::INTEGER AS x, least(greatest(floor(sy) + dy, 0), h - 1)::INTEGER AS y,
    (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS wt
  FROM grid, range(2) p(dx), range(2) q(dy))
SELECT c.image_id, c.yy::INTEGER AS y, c.xx::INTEGER AS x, round_even({f6('sum(wt * v)', 9)}, 0)::INTEGER AS v
FROM corner c JOIN raster r ON r.image_id = c.image_id AND r.x = c.x AND r.y = c.y GROUP BY c.image_id, c.yy, c.xx""",
    "two_eye_rasters": f"""WITH {R},
eyes AS (SELECT image_id, w, h, 10 + image_id % 7 AS x1, 9 + image_id % 5 AS y1, 45 + image_id % 9 AS x2, 8 + (image_id * 3) % 7 AS y2 FROM sizes),
angles AS (
  SELECT *, CASE WHEN y1 < y2 THEN -1 ELSE 1 END * acos(abs(x2 - x1) / sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)) AS a,
    round_even((y1 - y2) * 0.5::DOUBLE, 0)::INTEGER AS half FROM eyes),
cuts AS (
  SELECT image_id, w, h, cos(a) AS c, sin(a) AS s, 'right' AS side, x1 - 11 AS x0, y1 - half - 8 AS y0 FROM angles
  UNION ALL SELECT image_id, w, h, cos(a), sin(a), 'left', x2 - 11, y2 + half - 8 FROM angles),
placed AS (SELECT *, greatest(least(greatest(x0 - 22, 1), w), x0) AS px, greatest(least(greatest(y0 - 16, 1), h), y0) AS py FROM cuts),
grid AS (
  SELECT p.*, xx, yy, c * (xx + px) + s * (yy + py) + (w * 0.5::DOUBLE - c * ((w - 1) * 0.5::DOUBLE) - s * ((h - 1) * 0.5::DOUBLE)) AS sx,
    (-s) * (xx + px) + c * (yy + py) + (h * 0.5::DOUBLE + s * ((w - 1) * 0.5::DOUBLE) - c * ((h - 1) * 0.5::DOUBLE)) AS sy
  FROM placed p, range(22) a(xx), range(16) b(yy) WHERE xx < w - px AND yy < h - py),
corner AS (
  SELECT image_id, side, xx, yy, least(greatest(floor(sx) + dx, 0), w - 1)::INTEGER AS x, least(greatest(floor(sy) + dy, 0), h - 1)::INTEGER AS y,
    (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS wt
  FROM grid, range(2) p(dx), range(2) q(dy))
SELECT c.image_id, c.side, c.yy::INTEGER AS y, c.xx::INTEGER AS x, round_even({f6('sum(wt * v)', 9)}, 0)::INTEGER AS v
FROM corner c JOIN raster r ON r.image_id = c.image_id AND r.x = c.x AND r.y = c.y GROUP BY c.image_id, c.side, c.yy, c.xx""",
    "area_resize": f"""WITH {R},
xs AS (
  SELECT image_id, x, tx, least(x + 1, (tx + 1) * (w / 20e0)) - greatest(x, tx * (w / 20e0)) AS sx
  FROM (SELECT image_id, w, unnest(range(w)) AS x FROM sizes) JOIN (SELECT unnest(range(20)) AS tx) ON tx * w <= x * 20 + 20 AND (tx + 1) * w >= x * 20),
ys AS (
  SELECT image_id, y, ty, least(y + 1, (ty + 1) * (h / 13e0)) - greatest(y, ty * (h / 13e0)) AS sy
  FROM (SELECT image_id, h, unnest(range(h)) AS y FROM sizes) JOIN (SELECT unnest(range(13)) AS ty) ON ty * h <= y * 13 + 13 AND (ty + 1) * h >= y * 13)
SELECT r.image_id, ty::INTEGER AS y, tx::INTEGER AS x, round_even({f6('sum(sx * sy * v) / sum(sx * sy)', 9)}, 0)::INTEGER AS v
FROM raster r JOIN xs ON xs.image_id = r.image_id AND xs.x = r.x JOIN ys ON ys.image_id = r.image_id AND ys.y = r.y
WHERE sx > 1e-9 AND sy > 1e-9 GROUP BY r.image_id, ty, tx""",
    "point_ops": f"""WITH {fx.DETECTIONS_SQL},
b AS (SELECT DISTINCT image_id, x, y, w, h FROM detections),
t AS (SELECT *, x::DOUBLE AS a, y::DOUBLE AS o, w::DOUBLE AS c, h::DOUBLE AS e FROM b)
SELECT image_id, x, y, w, h, {f6('a + c')} AS sum_x, {f6('o + e')} AS sum_y, {f6('a - c')} AS diff_x, {f6('o - e')} AS diff_y,
  {f6('a * 1.5')} AS scaled_x, {f6('o * 1.5')} AS scaled_y,
  {f6(f'a * {_C30} - o * {_S30}')} AS turned_x, {f6(f'a * {_S30} + o * {_C30}')} AS turned_y,
  {f6(f'(a - c) * {_C30} - (o - e) * {_S30} + c')} AS turned_about_x, {f6(f'(a - c) * {_S30} + (o - e) * {_C30} + e')} AS turned_about_y,
  {f6('(a - c) * 0.5 + c')} AS scaled_about_x, {f6('(o - e) * 0.5 + e')} AS scaled_about_y,
  {f6(f'((a - 320) * {_C15} - (o - 240) * {_S15}) * 0.5 + 160')} AS mapped_x,
  {f6(f'((a - 320) * {_S15} + (o - 240) * {_C15}) * 0.5 + 120')} AS mapped_y,
  {f6('sqrt((a - c) * (a - c) + (o - e) * (o - e))')} AS distance,
  {f6('atan2(e - o, CASE WHEN c = a THEN 1e-8 ELSE c - a END) * (180 / pi())')} AS angle,
  least(round_even(x * 1.5::DOUBLE, 0), 300)::INTEGER AS capped, {f6('least(o * 1.25, 200e0)')} AS capped_real FROM t""",
    "rect_ops": f"""WITH {fx.DETECTIONS_SQL}, b AS (SELECT DISTINCT image_id, x, y, w, h FROM detections)
SELECT image_id, x, y, w, h, {_rect_sql()} FROM b""",
    "detections_largest": f"""WITH {fx.DETECTIONS_SQL},
s AS (SELECT image_id, greatest(round_even(x * 1.3::DOUBLE, 0), 0) AS x, greatest(round_even(y * 1.3::DOUBLE, 0), 0) AS y,
  round_even(w * 1.3::DOUBLE, 0) AS w, round_even(h * 1.3::DOUBLE, 0) AS h FROM detections),
m AS (SELECT image_id, (CASE WHEN x + w > 640 THEN 640 - w ELSE x END)::INTEGER AS x,
  (CASE WHEN y + h > 480 THEN 480 - h ELSE y END)::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h FROM s)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, y, x, w DESC) = 1""",
    "eye_regions": f"""WITH {fx.DETECTIONS_SQL},
f AS (SELECT image_id, x * 2 AS x, y * 2 AS y, w * 2 AS w, h * 2 AS h FROM detections WHERE w > 100 AND h > 45
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ord, x, y, w, h) = 1)
SELECT image_id, x AS right_x, x + w // 2 + (w // 5) // 2 AS left_x, y + 8 AS eye_y, w // 2 - (w // 5) // 2 AS eye_w,
  h - 16 AS eye_h, x AS both_x, y AS both_y, w AS both_w, h AS both_h FROM f""",
    "detector_fallback": f"""WITH {fx.DETECTIONS_SQL},
sided AS (SELECT *, CASE WHEN h % 40 = 20 THEN 'left' ELSE 'right' END AS side, w > 100 AS main FROM detections),
best AS (SELECT * FROM sided QUALIFY row_number() OVER (
  PARTITION BY image_id, side ORDER BY main DESC, w * h DESC, y, x, w DESC) = 1),
faces AS (SELECT DISTINCT o_orderkey AS image_id, (o_custkey % 300 + 100)::INTEGER AS w, (o_custkey % 200 + 100)::INTEGER AS h FROM orders)
SELECT f.image_id, (l.x + round_even(f.w * 0.16::DOUBLE, 0) + l.w // 2)::INTEGER AS lx, (l.y + round_even(f.h * 0.26::DOUBLE, 0) + l.h // 2)::INTEGER AS ly,
  (r.x + round_even(f.w * (1 - 0.16::DOUBLE - 0.30::DOUBLE), 0) + r.w // 2)::INTEGER AS rx, (r.y + round_even(f.h * 0.26::DOUBLE, 0) + r.h // 2)::INTEGER AS ry
FROM faces f JOIN best l ON l.image_id = f.image_id AND l.side = 'left' JOIN best r ON r.image_id = f.image_id AND r.side = 'right'""",
}
