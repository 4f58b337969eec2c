"""Pixel-table operators: statistics, texture, filters, resampling.

A raster is (image_id, y, x, v), 0-based. Figures of an image come from a
group-by with map-side combine and are joined back by strips of the image.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ADJUST, clamp, half_even, ratio, real
from .common import at, attach, neighbourhood, on_strips, shifted

#: Co-occurrence directions: angle → (dx, dy).
DIRECTIONS = {0: (1, 0), 45: (1, -1), 90: (0, -1), 135: (-1, -1)}


# ------------------------------------------------------------------ statistics

def image_stats(raster: DataFrame) -> DataFrame:
    return raster.groupBy("image_id").agg(
        F.count("*").alias("pixels"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"),
        F.min("v").alias("low"), F.max("v").alias("high"))


def image_sizes(raster: DataFrame) -> DataFrame:
    return raster.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def sized(raster: DataFrame, side: int | None = None) -> DataFrame:
    """Attach the image size w, h, unless the raster already carries it.

    Chains of operators carry it along, so it is joined only once. Images known
    to be side × side need no aggregation.
    """
    if "w" in raster.columns and "h" in raster.columns:
        return raster
    if side is None:
        return attach(raster, image_sizes(raster))
    return raster.withColumn("w", F.lit(side)).withColumn("h", F.lit(side))


def carried(raster: DataFrame) -> list[str]:
    """Key columns of a pixel, with the image size and scaling if these are carried along."""
    return ["image_id", "y", "x", *[c for c in ("w", "h", "scaling") if c in raster.columns]]


def histogram(raster: DataFrame) -> DataFrame:
    return raster.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def glcm(raster: DataFrame) -> DataFrame:
    """Share of each (value, neighbour value) per direction: (image_id, angle, a, b, n, p)."""
    near = neighbourhood(raster, "v", 1, 1)
    pairs = F.array(*[F.struct(F.lit(angle).alias("angle"), at("nb", dx, dy, 1, 1).alias("b"))
                      for angle, (dx, dy) in DIRECTIONS.items()])
    cells = (near.select("image_id", F.col("v").alias("a"), F.explode(pairs).alias("q"))
             .where(F.col("q.b").isNotNull())
             .groupBy("image_id", F.col("q.angle").alias("angle"), "a", F.col("q.b").alias("b"))
             .agg(F.count("*").alias("n")))
    whole = Window.partitionBy("image_id", "angle")          # at most 256 × 256 cells
    return cells.withColumn("p", F.col("n") / F.sum("n").over(whole))


def glcm_mean(raster: DataFrame) -> DataFrame:
    """Average over the four directions."""
    return glcm(raster).groupBy("image_id", "a", "b").agg((F.sum("p") / 4).alias("p"))


def contrast(raster: DataFrame) -> DataFrame:
    """Mean squared difference to the neighbours, averaged over the four directions.

    Equals the contrast of the mean co-occurrence matrix, without building it.
    """
    near = neighbourhood(raster, "v", 1, 1)
    means = [F.coalesce(F.avg((at("nb", dx, dy, 1, 1) - F.col("v")).cast("double") ** 2), F.lit(0.0))
             for dx, dy in DIRECTIONS.values()]
    return near.groupBy("image_id").agg((sum(means[1:], means[0]) / 4).alias("contrast"))


def edge_density(raster: DataFrame) -> DataFrame:
    """Mean 3 × 3 gradient magnitude over the pixels that have all neighbours."""
    v = lambda dx, dy: at("nb", dx, dy, 1, 1)
    gx = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
    gy = v(-1, -1) + 2 * v(0, -1) + v(1, -1) - v(-1, 1) - 2 * v(0, 1) - v(1, 1)
    return (neighbourhood(raster, "v", 1, 1)
            .select("image_id", F.sqrt((gx * gx + gy * gy).cast("double")).alias("magnitude"))
            .groupBy("image_id").agg(F.avg("magnitude").alias("edge_density"),
                                     F.count("magnitude").alias("pixels")))


def dark_threshold(raster: DataFrame, alpha: int = 20, norm: float = 256.0) -> DataFrame:
    """Grey level below which a pixel may belong to the pupil, from contrast and minimum."""
    low = raster.groupBy("image_id").agg(F.min("v").alias("low"))
    share = F.least(F.col("contrast"), F.lit(norm)) / norm
    return (contrast(raster).join(low, "image_id")
            .select("image_id", ((share + 1) * (F.col("low") + alpha)).cast("int")
                    .alias("threshold")))


def binary_threshold(raster: DataFrame, thresholds: DataFrame) -> DataFrame:
    return (attach(raster, thresholds)
            .select("image_id", "y", "x",
                    F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v")))


# ------------------------------------------------------------- value transforms

def _with_range(raster: DataFrame) -> DataFrame:
    ends = raster.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"),
                                          (F.max("y") + 1).alias("h"))
    if "h" in raster.columns:
        return attach(raster.drop("h"), ends)
    return attach(raster, ends).drop("h")


def minmax_rescale(raster: DataFrame) -> DataFrame:
    """Stretch each image to 0 … 255; NaN counts as the end of the range."""
    low = F.when(F.isnan("low") | (F.col("low") < -1e30), -1e30).otherwise(F.col("low"))
    high = F.when(F.isnan("high") | (F.col("high") > 1e30), 1e30).otherwise(F.col("high"))
    high = F.when(high - low == 0, low + 0.001).otherwise(high)
    gain = F.lit(255.0) / (high - low)
    value = F.col("v") * gain - low * F.lit(255.0) / (high - low)
    doubles = raster.withColumn("v", F.col("v").cast("double"))
    return (_with_range(doubles)
            .select("image_id", "y", "x", clamp(half_even(value), 0, 255).alias("v")))


def gamma(raster: DataFrame, g: float = 1.9) -> DataFrame:
    """Scale to 0 … 1 and raise to 1/g; an image of one value has no result."""
    if g <= 0:
        return raster
    spread = F.col("high") - F.col("low")
    return (_with_range(raster)
            .withColumn("v", F.when(spread != 0, F.pow(
                (F.col("v") - F.col("low")) / spread, F.lit(1 / g)))).drop("low", "high"))


def _levels(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram equalisation of 8-bit counts (keys, v, n): (keys, v, level)."""
    upto = (Window.partitionBy(*keys).orderBy("v")          # at most 256 rows
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy(*keys)
    table = (counts.withColumn("c", F.sum("n").over(upto))
             .withColumn("total", F.sum("n").over(whole))
             .withColumn("first", F.min("c").over(whole)))
    scale = ratio(F.lit(255), F.col("total") - F.col("first"))
    level = F.when(F.col("total") == F.col("first"), F.col("v").cast("int")).otherwise(
        clamp(half_even((F.col("c") - F.col("first")).cast("float") * scale), 0, 255))
    return table.select(*keys, F.col("v").cast("int").alias("v"), level.alias("level"))


def _dense(entries: Column) -> Column:
    """Levels of the values 0 … 255 as an array, so that a pixel finds its own by position."""
    levels = F.map_from_entries(F.collect_list(entries))
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.element_at(levels, v))


def _look_up(name: str) -> Column:
    return _dense(F.struct("v", "level")).alias(name)


def equalize(raster: DataFrame) -> DataFrame:
    """Histogram equalisation per image."""
    table = _levels(histogram(raster), ["image_id"]).groupBy("image_id").agg(_look_up("m"))
    return (attach(raster, table)
            .select("image_id", "y", "x", F.get("m", F.col("v").cast("int")).alias("v")))


def equalize_halves(raster: DataFrame, side: int | None = None) -> DataFrame:
    """Equalise the whole image and both halves, and blend them by quarters of the width."""
    parts = sized(raster, side).withColumn("right", F.col("x") >= F.floor(F.col("w") / 2))
    counts = parts.groupBy("image_id", "right", "v").agg(F.count("*").alias("n"))
    halves = _levels(counts, ["image_id", "right"])
    whole = _levels(counts.groupBy("image_id", "v").agg(F.sum("n").alias("n")), ["image_id"])
    entry = F.struct("v", "level")
    half = lambda right: _dense(F.when(F.col("right") == right, entry))
    tables = (halves.groupBy("image_id").agg(half(False).alias("l"), half(True).alias("r"))
              .join(whole.groupBy("image_id").agg(_look_up("m")), "image_id"))
    both = attach(parts.drop("h"), tables)
    x, w, v = F.col("x"), F.col("w"), F.col("v").cast("int")
    quarter = lambda k: F.floor(w * k / 4)
    one, step = real(1.0), real(w * real(0.25))

    def blend(f: Column, left: Column, right: Column) -> Column:
        return half_even((one - f) * real(left) + f * real(right))

    h, a = F.when(F.col("right"), F.get("r", v)).otherwise(F.get("l", v)), F.get("m", v)
    out = (F.when(x < quarter(1), h)
           .when(x < quarter(2), blend(ratio(x - quarter(1), step), h, a))
           .when(x < quarter(3), blend(ratio(x - quarter(2), step), a, h)).otherwise(h))
    return both.select("image_id", "y", "x", out.cast("int").alias("v"))


# ---------------------------------------------------------------------- filters

def gauss_weights(sigma: float) -> list[float]:
    """Normalised weights along one axis; the two-dimensional kernel is their product."""
    size = int(6 * sigma + 1)
    raw = [math.exp(-((size // 2 - min(j, size - 1 - j)) ** 2) / (2 * sigma * sigma))
           for j in range(size)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(raster: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Zero-padded smoothing; both passes run on the same strips."""
    weights = gauss_weights(sigma)
    reach = len(weights) // 2

    def smooth(place, v):
        there = ~np.isnan(v)
        for axis in (1, 0):
            v = np.where(there & ~np.isnan(v), v, 0.0)
            total = np.zeros_like(v)
            for k, w in enumerate(weights):
                total = total + shifted(v, *((0, k - reach) if axis else (k - reach, 0))) * w
            v = total
        return {"v": v}

    keep = carried(raster)
    return on_strips(raster.select(*keep, "v"), keep, reach, smooth, "v double")


def mirrored(raster: DataFrame, reach: int, side: int | None = None) -> DataFrame:
    """Add the pixels mirrored at each border (without repeating the border)."""
    framed = sized(raster, side)

    def copies(c: str, n: str) -> Column:
        i, last = F.col(c), F.col(n) - 1
        return F.explode(F.array_compact(F.array(
            i, F.when((i >= 1) & (i <= reach), -i),
            F.when((i < last) & (i >= last - reach), 2 * last - i))))

    return framed.withColumn("x", copies("x", "w")).withColumn("y", copies("y", "h"))


def bilateral(raster: DataFrame, sigma_colour: float = 20.0, sigma_space: float = 2.0,
              reach: int | None = None, side: int | None = None,
              keep: str | None = None) -> DataFrame:
    """Edge-preserving smoothing of 8-bit pixels inside a round window.

    `keep` names a further column for the values before smoothing.
    """
    reach = round(sigma_space * 1.5) if reach is None else reach
    near = (neighbourhood(mirrored(raster, reach, side), "v", reach, reach)
            .where((F.col("x") >= 0) & (F.col("y") >= 0)
                   & (F.col("x") < F.col("w")) & (F.col("y") < F.col("h"))))
    offsets = [((dy + reach) * (2 * reach + 1) + dx + reach,
                math.exp(-(dx * dx + dy * dy) / (2 * sigma_space ** 2)))
               for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)
               if dx * dx + dy * dy <= reach * reach]
    window = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in offsets])
    fall = -0.5 / (sigma_colour * sigma_colour)

    def add(acc, o):
        value = F.get("nb", o["i"])
        w = o["w"] * F.exp((value - F.col("v")) * (value - F.col("v")) * F.lit(fall))
        return F.struct((acc["s"] + w * value).alias("s"), (acc["w"] + w).alias("w"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    value = F.aggregate(window, start, add, lambda acc: half_even(acc["s"] / acc["w"]))
    kept = [F.col("v").alias(keep)] if keep else []
    return near.select("image_id", "y", "x", value.alias("v"), *kept)


def bilateral_mix(raster: DataFrame, smoothness: float) -> DataFrame:
    """0.7 · source + 0.7 · smoothed with a 5-pixel window, saturated to 8 bits."""
    smooth = bilateral(raster, smoothness, smoothness, reach=2, keep="source")
    mixed = clamp(half_even(F.col("source") * 0.7 + F.col("v") * 0.7), 0, 255)
    return smooth.select("image_id", "y", "x", mixed.alias("v"))


# -------------------------------------------------------------- size and region

def decimate(raster: DataFrame, scaling: float | None) -> DataFrame:
    """Keep evenly spread rows and columns and renumber them.

    Without a common `scaling` each image has its own in a column of that name. Of `old` lines, line i is the k-th kept one where (i + 1)·new/old passes
    k - 1/2. When more than half are kept, the lines to drop are found in the
    same way, counted from the far end.
    """
    kept = sized(raster)
    for axis, old, new in (("x", "w", "_w"), ("y", "h", "_h")):
        i, o = F.col(axis), F.col(old)
        factor = F.col("scaling") if scaling is None else scaling
        n = F.greatest((o * factor + ADJUST).cast("int"), F.lit(1))
        kept = (kept.withColumn(new, n)
                .withColumn("_t", F.col(new) > F.floor(o / 2) + 1)
                .withColumn("_m", F.when(F.col("_t"), o - F.col(new)).otherwise(F.col(new)))
                .withColumn("_p", F.when(F.col("_t"), o - i).otherwise(i + 1) * 2 * F.col("_m") + o - 1)
                .where((F.col("_p") % (2 * o) < 2 * F.col("_m")) != F.col("_t")))
        count = F.floor(F.col("_p") / (2 * o))
        place = F.when(F.col("_t"), i - F.col("_m") + count).otherwise(count - 1)
        kept = kept.withColumn(axis, place.cast("int"))
    size = [F.col("_w").alias("w"), F.col("_h").alias("h")] if "w" in raster.columns else []
    return kept.select("image_id", "y", "x", *size, "v")


def limit(c: Column, top: Column) -> Column:
    """Clamp to 1 … top."""
    return F.least(F.greatest(c, F.lit(1)), top)


def crop_bounds(rects: DataFrame) -> DataFrame:
    """Rectangles (x0, y0, wd, ht) limited to their w × h image: _x, _y, _wd, _ht."""
    x0 = F.greatest(limit(F.col("x0") - F.col("wd"), F.col("w")), F.col("x0"))
    y0 = F.greatest(limit(F.col("y0") - F.col("ht"), F.col("h")), F.col("y0"))
    return (rects.withColumn("_x", x0).withColumn("_y", y0)
            .withColumn("_wd", F.least(F.col("wd"), F.col("w") - F.col("_x")))
            .withColumn("_ht", F.least(F.col("ht"), F.col("h") - F.col("_y"))))


def crop(raster: DataFrame, rects: DataFrame, one_based: bool = False,
         new_id: str = "image_id") -> DataFrame:
    """Cut the rectangles (x0, y0, wd, ht) of each image, limited to the image.

    `rects` also has the image size w, h. With `one_based` the origin counts
    pixels from 1. The cut images are named by the column `new_id`, which allows
    several rectangles per image.
    """
    base = 1 if one_based else 0
    placed = (crop_bounds(rects)
              .select("image_id", "h", F.col(new_id).alias("_id"), (F.col("_x") - base).alias("_x"),
                      (F.col("_y") - base).alias("_y"), "_wd", "_ht"))
    return (attach(raster, placed)
            .withColumn("x", F.col("x") - F.col("_x")).withColumn("y", F.col("y") - F.col("_y"))
            .where((F.col("x") >= 0) & (F.col("y") >= 0)
                   & (F.col("x") < F.col("_wd")) & (F.col("y") < F.col("_ht")))
            .select(F.col("_id").alias("image_id"), "y", "x", "v"))


def circle_region(circles: DataFrame, x_limit: Column, y_limit: Column) -> DataFrame:
    """Region around the circle (xp, yp, rp) of a w × h image, and its centre there."""
    cx, cy, r = F.col("xp"), F.col("yp"), F.col("rp")
    some = (cx != 0) & (cy != 0) & (r != 0)

    def axis(c, lim, size):
        start = F.when(c - r < 0, 0).otherwise(F.greatest(c - lim, F.lit(0)))
        centre = F.when(c - r < 0, c).otherwise(lim)
        return start, F.least(c + lim, size) - start, centre

    x0, wd, px = axis(cx, x_limit, F.col("w"))
    y0, ht, py = axis(cy, y_limit, F.col("h"))
    out = {"x0": x0, "y0": y0, "wd": wd, "ht": ht, "px": px, "py": py}
    for name, value in out.items():
        circles = circles.withColumn(name, F.when(some, value).otherwise(0).cast("int"))
    return circles


def reach_bounds(df: DataFrame, x: Column, y: Column, dx: Column, dy: Column) -> DataFrame:
    """Columns and rows x ± dx, y ± dy limited to 1 … w and 1 … h."""
    w, h = F.col("w"), F.col("h")
    return (df.withColumn("left", limit(x - dx, w)).withColumn("right", limit(x + dx, w))
            .withColumn("top", limit(y - dy, h)).withColumn("bottom", limit(y + dy, h)))


def elliptical_mask(raster: DataFrame, fill: int = 128, side: int | None = None) -> DataFrame:
    """Grey out the pixels outside the face ellipse of a square image."""
    w, h = F.col("w"), F.col("h")
    cx, cy = F.floor(w / 2), F.rint(h * 0.40)
    ax, ay = F.rint(w * 0.50), F.rint(h * 0.80)
    dx, dy = (F.col("x") - cx) / ax, (F.col("y") - cy) / ay
    return (sized(raster, side)
            .select("image_id", "y", "x",
                    F.when(dx * dx + dy * dy <= 1, F.col("v")).otherwise(fill).alias("v")))


def alpha_blend(first: DataFrame, second: DataFrame, alpha: DataFrame) -> DataFrame:
    """Blend two rasters by an 8-bit mask with shifts instead of divisions."""
    key = ["image_id", "y", "x"]
    joined = (first.withColumnRenamed("v", "a").join(second.withColumnRenamed("v", "b"), key)
              .join(alpha.withColumnRenamed("v", "m"), key))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    mixed = F.shiftright(a * (255 - m), 8) + F.shiftright(b * (m + 1), 8)
    return joined.select(*key, F.when(m == 0, a).otherwise(mixed).alias("v"))
