"""Circles, candidates, detections and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ADJUST, fixed, half_away, half_even
from .raster import crop_bounds, image_sizes, limit, sized

#: Value of pi used for angles, as given (15 digits).
PI = 3.14159265358979
#: Half the number of polygon corners of a rasterised circle.
CIRCLE_SIDES = 600


# ---------------------------------------------------------------------- circles

def circles_from_points(points: DataFrame) -> DataFrame:
    """Pupil and iris circle from 8 boundary points each.

    Centre: mean of the midpoints of opposite valid points, in whole numbers.
    Radius: distances of the valid points, truncated at every addition. The iris
    falls back to the pupil centre; an image without a valid pupil pair is dropped.
    """
    point = F.struct("k", "x", "y", "valid")
    ring = lambda name: F.array_sort(F.collect_list(F.when(F.col("ring") == name, point)))
    both = points.groupBy("image_id").agg(ring("pupil").alias("p"), ring("iris").alias("i"))

    def pairs(a: str) -> Column:
        return F.expr(f"filter(transform(sequence(0, 3), k -> named_struct('ok', {a}[k].valid "
                      f"AND {a}[k + 4].valid, 'x', ({a}[k].x + {a}[k + 4].x) div 2, "
                      f"'y', ({a}[k].y + {a}[k + 4].y) div 2)), q -> q.ok)")

    def centre(q: str, axis: str) -> Column:
        return F.expr(f"CASE WHEN size({q}) > 0 THEN cast(aggregate({q}, 0L, "
                      f"(s, e) -> s + e.{axis}) div size({q}) as int) END")

    def radius(a: str, x: str, y: str) -> Column:
        total = (f"aggregate({a}, 0, (s, e) -> IF(e.valid, cast(s + sqrt(cast(({y} - e.y) as double)"
                 f" * ({y} - e.y) + ({x} - e.x) * ({x} - e.x)) as int), s))")
        n = f"size(filter({a}, e -> e.valid))"
        return F.expr(f"CASE WHEN {n} > 0 THEN cast({total} div {n} as int) END")

    return (both.withColumn("pq", pairs("p")).withColumn("iq", pairs("i"))
            .withColumn("xp", centre("pq", "x")).withColumn("yp", centre("pq", "y"))
            .where(F.col("xp").isNotNull())
            .withColumn("rp", radius("p", "xp", "yp"))
            .withColumn("xi", F.coalesce(centre("iq", "x"), "xp"))
            .withColumn("yi", F.coalesce(centre("iq", "y"), "yp"))
            .withColumn("ri", radius("i", "xi", "yi"))
            .select("image_id", "xp", "yp", "rp", "xi", "yi", "ri"))


def circle_points(circles: DataFrame, sides: int = CIRCLE_SIDES) -> DataFrame:
    """Corners of the circle (cx, cy, r), rounded and limited to the w × h image."""
    angle = F.col("k") * PI / sides
    place = lambda f, c, n: limit(half_away(F.col("r") * f(angle) + F.col(c) + ADJUST), F.col(n))
    return (circles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * sides))))
            .select("image_id", "k", place(F.cos, "cx", "w").alias("x"),
                    place(F.sin, "cy", "h").alias("y")))


def line_points(lines: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Height of the line a·x + b·y + c = 0 at every column 1 … w, within 1 … h."""
    x = F.col("x").cast("double")
    rise = -F.col("c") - F.col("a") * x
    h = F.col("h").cast("double")
    # an upright line leaves the image above or below
    y = F.when(F.col("b") == 0, F.when(rise > 0, F.lit(1.0)).otherwise(h)).otherwise(
        F.least(F.greatest(F.try_divide(rise, F.col("b")), F.lit(1.0)), h))
    return (lines.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
            .select(*by, "x", (y + ADJUST).cast("int").alias("y")))


def reconcile_centre(df: DataFrame) -> DataFrame:
    """Move an iris centre found in a region back to the image.

    Offsets from the region's centre (px, py) beyond `allowed` are ignored.
    """
    def axis(c, region, pupil):
        d = F.col(c) - F.col(region)
        return F.col(pupil) + F.when(F.abs(d) > F.col("allowed"), 0).otherwise(d)
    return (df.withColumn("xi", axis("xi", "px", "xp")).withColumn("yi", axis("yi", "py", "yp")))


def pupil_fallback(df: DataFrame) -> DataFrame:
    """Without an accepted pupil take the last candidate, then half the limit and the middle."""
    missing = F.col("rp").isNull() | (F.col("rp") < 1)
    lx, ly, lr = (F.coalesce(c, F.lit(0)) for c in ("last_x", "last_y", "last_r"))
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    r = F.when((lr < 1) | (lr > F.col("max_r")), half("max_r")).otherwise(lr)
    x = F.when((lx < 1) | (lx > F.col("w") - 1), half("w")).otherwise(lx)
    y = F.when((ly < 1) | (ly > F.col("h") - 1), half("h")).otherwise(ly)
    return (df.withColumn("_m", missing)
            .withColumn("xp", F.when(F.col("_m"), x).otherwise(F.col("xp")))
            .withColumn("yp", F.when(F.col("_m"), y).otherwise(F.col("yp")))
            .withColumn("rp", F.when(F.col("_m"), r).otherwise(F.col("rp")))
            .drop("_m", "last_x", "last_y", "last_r"))


def iris_fallback(df: DataFrame) -> DataFrame:
    """Replace parts of an iris circle that were not found."""
    x, y, r = F.col("xi"), F.col("yi"), F.col("ri")
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    return (df.withColumn("xi", F.when(x < 2, half("w")).otherwise(x))
            .withColumn("yi", F.when(y < 2, half("h")).otherwise(y))
            .withColumn("ri", F.when((r < 2) | (r > F.col("max_r")), F.col("max_r")).otherwise(r)))


# -------------------------------------------------------------- pupil candidates

#: Smallest contour at scale 1.
MIN_CONTOUR = 16


def candidate_radius(ratio: Column, max_r: Column) -> Column:
    """Radius of a nearly round candidate, one above the limit for any other."""
    long, short = F.greatest("w", "h"), F.least("w", "h")
    return F.when(short >= (long * ratio).cast("int"),
                  F.floor(long / 2).cast("int") + 1).otherwise(max_r + 1)


def _two_largest(candidates: DataFrame, by: list[str], min_count: Column | int) -> DataFrame:
    """Candidates whose size equals the largest or second largest of their group."""
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count")))
    second = F.min(F.when(F.col("_rank") <= 2, F.col("count"))).over(Window.partitionBy(*by))
    return (candidates.withColumn("_rank", ranked).withColumn("_second", second)
            .where((F.col("count") >= F.col("_second")) & (F.col("count") > min_count))
            .drop("_rank", "_second"))


def choose_candidate(candidates: DataFrame, ratio: float, max_r: int, n_scale: float = 1.0,
                     by: tuple[str, ...] = ("image_id", "threshold")) -> DataFrame:
    """First accepted candidate among the largest two contours; also the last tried.

    `candidates` has count, ord (contour order), cx, cy and the ellipse axes w, h.
    """
    tried = (_two_largest(candidates, list(by), int(MIN_CONTOUR * n_scale))
             .withColumn("r", candidate_radius(F.lit(ratio), F.lit(max_r))))
    order = F.struct((-F.col("count")).alias("n"), "ord", "cx", "cy", "r")
    accepted = (F.col("r") > 0) & (F.col("r") < max_r)
    best = tried.groupBy(*by).agg(F.min(F.when(accepted, order)).alias("b"),
                                  F.max(order).alias("l"))
    return best.select(*by, F.col("b.cx").alias("xp"), F.col("b.cy").alias("yp"),
                       F.col("b.r").alias("rp"), F.col("l.cx").alias("last_x"),
                       F.col("l.cy").alias("last_y"), F.col("l.r").alias("last_r"))


#: The roundness asked for falls by this much a step, down to the last limit of the sweep.
RATIO_STEP, LAST_RATIO = 0.05, 0.2


def ratio_steps(ratio: Column | float) -> Column:
    """ratio, ratio - 0.05, … above the last limit, subtracted one after the other."""
    if not isinstance(ratio, Column):
        steps = []
        while ratio > LAST_RATIO:
            steps.append(ratio)
            ratio -= RATIO_STEP
        return F.array(*[F.lit(r) for r in steps])
    count = F.greatest(F.ceil((ratio - LAST_RATIO) / RATIO_STEP).cast("int") + 1, F.lit(1))
    start = F.struct(ratio.cast("double").alias("at"), F.array().cast("array<double>").alias("steps"))
    steps = F.aggregate(F.sequence(F.lit(1), count), start, lambda s, _: F.struct(
        (s["at"] - RATIO_STEP).alias("at"), F.concat(s["steps"], F.array(s["at"])).alias("steps")))
    return F.filter(steps["steps"], lambda r: r > LAST_RATIO)


def sweep_candidates(candidates: DataFrame, steps: Column, max_r: Column | int,
                     n_scale: Column | float = 1.0) -> DataFrame:
    """First success of the threshold sweep per image.

    Pass 1 lowers the threshold from the start value at falling roundness; pass 2,
    without closing, raises it by up to 39. `candidates` carries pass, start and
    threshold. The winner is the minimum of the visiting order, so the sweep is
    one aggregation. `steps` are the `ratio_steps` of the roundness; they, the largest radius
    and the scale may be columns of `candidates`, so that images of several sensors are swept
    together.
    """
    max_r, n_scale = (c if isinstance(c, Column) else F.lit(c) for c in (max_r, n_scale))
    tried = _two_largest(candidates, ["image_id", "pass", "threshold"],
                         (n_scale * MIN_CONTOUR).cast("int"))
    long, short = F.greatest("w", "h"), F.least("w", "h")
    floor = F.when(F.col("pass") == 1, 0.4).otherwise(LAST_RATIO)
    step = F.array_position(F.transform(
        steps, lambda r: (r > floor) & (short >= (long * r).cast("int"))), True)
    t, start = F.col("threshold"), F.col("start")
    visited = F.when(F.col("pass") == 1, (t <= start) & (t >= 0)).otherwise(
        (t > start) & (t < start + 40))
    place = F.when(F.col("pass") == 1, start - t).otherwise(t - start)
    r = F.floor(long / 2).cast("int") + 1
    return (tried.withColumn("step", step).withColumn("r", r)
            .where(visited & (F.col("step") > 0) & (F.col("r") < max_r)
                   & (F.col("cx") > 0) & (F.col("cy") > 0))
            .groupBy("image_id").agg(F.min(F.struct(
                "pass", "step", place.alias("place"), (-F.col("count")).alias("n"),
                "ord", "threshold", "cx", "cy", "r")).alias("b"))
            .select("image_id", "b.pass", "b.threshold", F.col("b.cx").alias("xp"),
                    F.col("b.cy").alias("yp"), F.col("b.r").alias("rp")))


def split_two_eyes(candidates: DataFrame, width: int) -> DataFrame:
    """Assign candidates to the right (left part) or left eye, x within that part."""
    space = (width // 5) // 2
    start = width // 2 + space
    right, left = F.col("cx") < width // 2 - space, F.col("cx") >= start
    return (candidates.withColumn("side", F.when(right, "right").when(left, "left"))
            .where(F.col("side").isNotNull())
            .withColumn("cx", F.when(left, F.col("cx") - start).otherwise(F.col("cx"))))


def join_two_eyes(chosen: DataFrame, width: int) -> DataFrame:
    """Shift the left eye's circle back to image columns."""
    start = width // 2 + (width // 5) // 2
    x = limit(F.col("xp") + start, F.lit(width - 1))
    x = F.when(x == 1, start + 1).otherwise(x)
    return chosen.withColumn("xp", F.when(F.col("side") == "left", x).otherwise(F.col("xp")))


def align_eyes(df: DataFrame, max_r: int) -> DataFrame:
    """Angle between two pupils (x1, y1), (x2, y2) and the crop around each eye."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    a, b = F.abs(x2 - x1), F.abs(y2 - y1)
    angle = F.acos(F.try_divide(a, F.sqrt((a * a + b * b).cast("double")))) * (180 / PI)
    half = half_even((y1 - y2) * 0.5)
    wide, tall = int(max_r * 1.4), int(max_r * 1.1)
    return (df.withColumn("angle", F.when(y1 < y2, -angle).otherwise(angle))
            .withColumn("right_x", x1 - wide).withColumn("right_y", y1 - half - tall)
            .withColumn("left_x", x2 - wide).withColumn("left_y", y2 + half - tall)
            .withColumn("crop_w", F.lit(2 * wide)).withColumn("crop_h", F.lit(2 * tall)))


# ------------------------------------------------------------------- resampling

def affine_resample(raster: DataFrame, maps: DataFrame, replicate: bool = True,
                    by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Bilinear resampling through one affine map per image, or per key `by` (child rasters).

    `maps` has image_id, out_w, out_h and m0 … m5: target (x, y) is read at source
    (m0·x + m1·y + m2, m3·x + m4·y + m5). Outside the image the border pixel is
    repeated, or 0 is read. Every target cell asks for its four source pixels with
    one equi-join; nothing is collected per image.
    """
    grid = (maps.join(image_sizes(raster), "image_id")
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("out_h") - 1)))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("out_w") - 1))))
    sx = F.col("m0") * F.col("x") + F.col("m1") * F.col("y") + F.col("m2")
    sy = F.col("m3") * F.col("x") + F.col("m4") * F.col("y") + F.col("m5")
    placed = grid.withColumn("sx", sx).withColumn("sy", sy)
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    corner = lambda dx, dy, w: F.struct((F.floor("sx") + dx).alias("x"),
                                        (F.floor("sy") + dy).alias("y"), w.alias("weight"))
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)),
                      corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    asked = (placed.select(*by, F.col("x").alias("tx"), F.col("y").alias("ty"), "w", "h",
                           F.explode(corners).alias("c"))
             .withColumn("x", F.col("c.x")).withColumn("y", F.col("c.y")))
    if replicate:
        inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), F.col(n) - 1)
        asked = asked.withColumn("x", inside("x", "w")).withColumn("y", inside("y", "h"))
    read = asked.join(raster, ["image_id", "y", "x"], "left")
    value = F.sum(F.col("c.weight") * F.coalesce("v", F.lit(0)))
    return (read.groupBy(*by, F.col("ty").alias("y"), F.col("tx").alias("x"))
            .agg(half_even(fixed(value, 9)).alias("v")))


def rotation_map(df: DataFrame, degrees: Column, factor: Column = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Map for rotating a w × h image about its centre and scaling it by `factor`.

    Columns named in `keep` are carried along.
    """
    factor = F.lit(1.0) if factor is None else factor
    angle = degrees * (math.pi / 180)
    c, s = F.cos(angle) / factor, F.sin(angle) / factor
    out_w, out_h = half_even(F.col("w") * factor), half_even(F.col("h") * factor)
    ox, oy = (out_w - 1) * 0.5, (out_h - 1) * 0.5
    return df.select(
        "image_id", *keep, out_w.alias("out_w"), out_h.alias("out_h"), c.alias("m0"), s.alias("m1"),
        (F.col("w") * 0.5 - c * ox - s * oy).alias("m2"), (-s).alias("m3"), c.alias("m4"),
        (F.col("h") * 0.5 + s * ox - c * oy).alias("m5"))


def eye_rasters(raster: DataFrame, pupils: DataFrame, max_r: int) -> DataFrame:
    """Level eye images (image_id, side, y, x, v) around the two pupils of each image.

    `pupils` has image_id and the right (x1, y1) and left (x2, y2) pupil. The image is turned
    until the pupils are level, then cut around each, limited to the image. Turning and
    cutting are one map per (image, side), so only pixels that land in a cut are read. Pupils
    in the same place have no angle and give no eyes, nor do images without pupils.
    """
    placed = align_eyes(pupils.join(image_sizes(raster), "image_id"), max_r).where("angle IS NOT NULL")
    corner = lambda side: F.struct(F.lit(side).alias("side"), F.col(f"{side}_x").alias("x0"),
                                   F.col(f"{side}_y").alias("y0"))
    cuts = (placed.withColumn("_c", F.explode(F.array(corner("right"), corner("left"))))
            .select("image_id", "w", "h", "angle", "_c.*", F.col("crop_w").alias("wd"), F.col("crop_h").alias("ht")))
    cuts = crop_bounds(cuts).where((F.col("_wd") > 0) & (F.col("_ht") > 0))
    maps = rotation_map(cuts, F.col("angle"), keep=("side", "_x", "_y", "_wd", "_ht"))
    moved = lambda m, a, b: F.col(m) + F.col(a) * F.col("_x") + F.col(b) * F.col("_y")
    maps = (maps.withColumn("m2", moved("m2", "m0", "m1")).withColumn("m5", moved("m5", "m3", "m4"))
            .withColumn("out_w", F.col("_wd")).withColumn("out_h", F.col("_ht"))
            .drop("_x", "_y", "_wd", "_ht"))
    return affine_resample(raster, maps, by=("image_id", "side"))


# Where the left eye goes in a normalised face.
EYE_X, EYE_Y = 0.16, 0.14


def eye_alignment_map(eyes: DataFrame, width: int) -> DataFrame:
    """Map that puts both eye centres (lx, ly), (rx, ry) at their fixed places.

    Inverse of: rotate and scale about the middle of the eyes, then move the
    middle to (width/2, EYE_Y·width). Eyes in the same place give no map.
    """
    eyes = eyes.where((F.col("lx") != F.col("rx")) | (F.col("ly") != F.col("ry")))
    dx, dy = F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")
    length = F.sqrt((dx * dx + dy * dy).cast("double"))
    factor = F.lit((1.0 - 2 * EYE_X) * width) / length
    c, s = dx / length / factor, dy / length / factor
    mx, my = (F.col("lx") + F.col("rx")) * 0.5, (F.col("ly") + F.col("ry")) * 0.5
    ox, oy = F.lit(width * 0.5), F.lit(width * EYE_Y)
    return eyes.select(
        "image_id", F.lit(width).alias("out_w"), F.lit(width).alias("out_h"),
        c.alias("m0"), (-s).alias("m1"), (mx - c * ox + s * oy).alias("m2"),
        s.alias("m3"), c.alias("m4"), (my - s * ox - c * oy).alias("m5"))


def area_resize(raster: DataFrame, out_w: int, out_h: int) -> DataFrame:
    """Shrink by averaging the source area of each target cell."""
    framed = sized(raster)

    def cells(axis: str, n: str, out: int) -> Column:
        """Target cells a source line falls in, with the shared length."""
        step = F.col(n) / F.lit(float(out))
        first = F.floor(F.col(axis) / step)
        last = F.least(F.ceil((F.col(axis) + 1) / step) - 1, F.lit(out - 1))
        share = lambda k: (F.least(F.col(axis) + 1, (k + 1) * step)
                           - F.greatest(F.col(axis), k * step))
        return F.transform(F.sequence(first, F.greatest(first, last)),
                           lambda k: F.struct(k.alias("k"), share(k).alias("s")))

    spread = (framed.withColumn("cx", F.explode(cells("x", "w", out_w)))
              .withColumn("cy", F.explode(cells("y", "h", out_h)))
              .where((F.col("cx.s") > 1e-9) & (F.col("cy.s") > 1e-9)))
    weight = F.col("cx.s") * F.col("cy.s")
    mean = F.sum(weight * F.col("v")) / F.sum(weight)
    return (spread.groupBy("image_id", F.col("cy.k").cast("int").alias("y"),
                           F.col("cx.k").cast("int").alias("x"))
            .agg(half_even(fixed(mean, 9)).alias("v")))


# -------------------------------------------------------------------- detections

# Eye search windows as shares of the face.
SEARCH_X, SEARCH_Y, SEARCH_W, SEARCH_H = 0.16, 0.26, 0.30, 0.28


def settle_detections(detections: DataFrame, scale: float, w: int, h: int) -> DataFrame:
    """Enlarge detections found on a shrunk image and move them inside it."""
    grown = [half_even(F.col(c) * scale) for c in ("x", "y", "w", "h")]
    x, y, wd, ht = grown
    x, y = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x = F.when(x + wd > w, w - wd).otherwise(x)
    y = F.when(y + ht > h, h - ht).otherwise(y)
    return (detections.withColumn("_x", x).withColumn("_y", y)
            .withColumn("_w", wd).withColumn("_h", ht)
            .drop("x", "y", "w", "h").withColumnsRenamed(
                {"_x": "x", "_y": "y", "_w": "w", "_h": "h"}))


def largest_detection(detections: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The detection of largest area; ties go to the first in reading order."""
    best = F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("y")).alias("ny"),
                          (-F.col("x")).alias("nx"), "x", "y", "w", "h")).alias("b")
    return (detections.groupBy(*by).agg(best)
            .select(*by, "b.x", "b.y", "b.w", "b.h"))


def eye_regions(detections: DataFrame, scale: int, min_w: int, min_h: int, trim: int) -> DataFrame:
    """Right, left and common eye region of the first large enough eye-pair detection."""
    big = (detections.withColumn("_d", F.struct(
        "ord", *[(F.col(c) * scale).alias(c) for c in ("x", "y", "w", "h")]))
        .where((F.col("_d.w") > min_w * scale) & (F.col("_d.h") > min_h * scale)))
    first = big.groupBy("image_id").agg(F.min("_d").alias("d"))
    x, y, w, h = (F.col(f"d.{c}") for c in ("x", "y", "w", "h"))
    gap, half = F.floor(F.floor(w / 5) / 2), F.floor(w / 2)
    named = {"right_x": x, "left_x": x + half + gap, "eye_y": y + trim, "eye_w": half - gap,
             "eye_h": h - 2 * trim, "both_x": x, "both_y": y, "both_w": w, "both_h": h}
    return first.select("image_id", *[c.cast("int").alias(n) for n, c in named.items()])


def eye_centres(faces: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Eye centres in face coordinates; per eye the second detector only fills gaps.

    Detections (image_id, side, x, y, w, h) are relative to the search window of
    their side. Faces without both eyes are dropped.
    """
    def best(df: DataFrame, n: int) -> DataFrame:
        eye = F.struct("x", "y", "w", "h")
        return largest_detection(df, ("image_id", "side")).groupBy("image_id").agg(
            F.max(F.when(F.col("side") == "left", eye)).alias(f"l{n}"),
            F.max(F.when(F.col("side") == "right", eye)).alias(f"r{n}"))

    joined = (faces.join(best(first, 1), "image_id", "left")
              .join(best(second, 2), "image_id", "left")
              .withColumn("l", F.coalesce("l1", "l2")).withColumn("r", F.coalesce("r1", "r2"))
              .where(F.col("l").isNotNull() & F.col("r").isNotNull()))
    top = half_even(F.col("h") * SEARCH_Y)
    left, right = half_even(F.col("w") * SEARCH_X), half_even(F.col("w") * (1 - SEARCH_X - SEARCH_W))
    mid = lambda e, a, n, origin: (F.col(f"{e}.{a}") + origin
                                   + F.floor(F.col(f"{e}.{n}") / 2)).cast("int")
    return joined.select("image_id", mid("l", "x", "w", left).alias("lx"),
                         mid("l", "y", "h", top).alias("ly"), mid("r", "x", "w", right).alias("rx"),
                         mid("r", "y", "h", top).alias("ry"))
