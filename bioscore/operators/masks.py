"""Noise masks: highlights, eyelids, occluding half-planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach
from .raster import limit


def reflection_noise(raster: DataFrame, low: int = 3, high: int = 250) -> DataFrame:
    """Eyelashes (darker than `low`) and reflections (brighter than `high`)."""
    return raster.withColumn("noise", (F.col("v") < low) | (F.col("v") > high))


def glare_noise(raster: DataFrame, top: int) -> DataFrame:
    return raster.withColumn("noise", F.col("v") > top)


def eyelid_curve(anchors: DataFrame, curved: bool = True) -> DataFrame:
    """Height of the eyelid per column: (image_id, x, y).

    A parabola through (x0, f0), (x1, f1), (x2, f2), truncated; below 1 the first
    height is used. With curved=False the first height is used throughout.
    """
    x = F.col("x").cast("double")
    part = lambda i, j: F.try_divide(x - F.col(f"x{j}"), F.col(f"x{i}") - F.col(f"x{j}"))
    term = lambda i, j, k: part(i, j) * part(i, k) * F.col(f"f{i}")
    first = F.col("f0").cast("int")
    value = (term(0, 1, 2) + term(1, 0, 2) + term(2, 0, 1)).cast("int")
    y = F.when(value >= 1, value).otherwise(first) if curved else first
    columns = F.sequence(F.col("x0").cast("int"), F.col("x2").cast("int"))
    return (anchors.where(F.col("x0") <= F.col("x2")).withColumn("x", F.explode(columns))
            .select("image_id", "x", y.alias("y")))


def eyelid_noise(raster: DataFrame, top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Mark the pixels on or above the top curve and on or below the bottom curve.

    The last column of a curve is not part of the masked range.
    """
    def inner(curve: DataFrame, name: str) -> DataFrame:
        ends = curve.groupBy("image_id").agg(F.max("x").alias("_end"))
        return (curve.join(ends, "image_id").where(F.col("x") < F.col("_end"))
                .select("image_id", "x", F.col("y").alias(name)))

    lids = inner(top, "_top").join(inner(bottom, "_bottom"), ["image_id", "x"])
    covered = (F.col("y") <= F.col("_top")) | (F.col("y") >= F.col("_bottom"))
    return (raster.join(lids, ["image_id", "x"], "left")
            .withColumn("noise", F.coalesce(covered, F.lit(False)))
            .select("image_id", "y", "x", "v", "noise"))


def eyelid_anchors(images: DataFrame, curved: bool = True) -> DataFrame:
    """Choose the three anchor points of both eyelids from the line extents.

    One row per image with w, h, yp, rp, xi, yi, ri and per patch the smallest and
    largest line height (lt, rt, lb, rb, ct, cb, or t and b when flat), NULL where
    no line was found. Missing heights come from the other side, then from the
    iris edge; the curve is moved two pixels inwards.
    """
    w, h, xi, yi, ri = (F.col(c) for c in ("w", "h", "xi", "yi", "ri"))
    extra = F.floor(ri / 2) if curved else F.lit(0)
    start_top = limit(yi - ri, h - 1)
    edge = limit(start_top + 1, yi)
    end = limit(yi + ri - 1 if curved else yi + ri, h - 1)

    def good(name: str) -> Column:
        c = F.col(name)
        return F.when((c >= 1) & (c <= h - 1), c)

    x0, x2 = limit(xi - ri - extra, w - 1), limit(xi + ri + extra, w)
    if curved:
        top_l, top_r = good("lt_max"), good("rt_max")
        top_l, top_r = F.coalesce(top_l, top_r, edge), F.coalesce(top_r, top_l, edge)
        low_l, low_r = good("lb_min"), good("rb_min")
        low_l, low_r = F.coalesce(low_l, low_r, end), F.coalesce(low_r, low_l, end)
        mid_t = F.greatest(F.coalesce(good("lt_min"), edge), F.coalesce(good("rt_min"), edge),
                           F.col("ct_max"))
        mid_b = F.least(F.coalesce(good("lb_max"), end), F.coalesce(good("rb_max"), end),
                        F.col("cb_min"))
        tops = [F.greatest(top_l, mid_t), mid_t, F.greatest(top_r, mid_t)]
        lows = [F.least(low_l, mid_b), mid_b, F.least(low_r, mid_b)]
    else:
        tops = [F.coalesce(good("t_max"), edge)] * 3
        lows = [F.coalesce(good("b_min"), end)] * 3
    heights = [(t + 2).cast("int").alias(f"t{i}") for i, t in enumerate(tops)]
    heights += [(b - 2).cast("int").alias(f"b{i}") for i, b in enumerate(lows)]
    return images.select("image_id", x0.cast("int").alias("x0"), xi.cast("int").alias("x1"),
                         x2.cast("int").alias("x2"), *heights)


def one_lid(anchors: DataFrame, lid: str) -> DataFrame:
    """Anchors of the top ('t') or bottom ('b') eyelid as doubles."""
    return anchors.select("image_id", *[F.col(f"x{i}").cast("double").alias(f"x{i}")
                                        for i in range(3)],
                          *[F.col(f"{lid}{i}").cast("double").alias(f"f{i}") for i in range(3)])


# Slope of the occluding line for boundary points 0, 1, 3 (mod 4).
OCCLUSION_SLOPES = {0: 0.0, 1: 0.26, 3: -0.26}


def occlusion_lines(points: DataFrame, circles: DataFrame) -> DataFrame:
    """(image_id, lines): occluding lines from the iris boundary points.

    An occluded point gives a line of fixed slope through it (vertical for points
    2 and 6), and one through its left neighbour when that is occluded too. Every
    line carries the side on which the iris centre lies.
    """
    ring = (points.where(F.col("ring") == "iris").groupBy("image_id")
            .agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "valid"))).alias("p")))
    lines = []
    for i in range(8):
        here, left = F.col("p")[i], F.col("p")[(i - 1) % 8]
        x, y = here["x"].cast("double"), here["y"].cast("double")
        none = F.lit(None).cast("double")
        if i % 4 == 2:
            a, b, upright = none, none, x
        else:
            a = F.lit(OCCLUSION_SLOPES[i % 4])
            b, upright = y - a * x, none
        lines.append(F.when(~here["valid"], F.struct(
            a.alias("a"), b.alias("b"), upright.alias("at"))))
        run = left["x"] - here["x"]
        slope = F.when(run != 0, (left["y"] - here["y"]) / run)
        lines.append(F.when(~here["valid"] & ~left["valid"] & slope.isNotNull(), F.struct(
            slope.alias("a"), (y - slope * x).alias("b"), none.alias("at"))))
    found = ring.select("image_id", F.array_compact(F.array(*lines)).alias("lines"))
    return found.join(circles.select("image_id", "xi", "yi"), "image_id")


def behind_line() -> Column:
    """True where one of the column `lines` separates the pixel from the centre (xi, yi)."""
    return F.expr(
        "exists(lines, l -> IF(l.at IS NOT NULL, (l.at - x) * (l.at - xi) <= 0, "
        "(l.a * x + l.b - y) * (l.a * xi + l.b - yi) <= 0))")


def occlusion_noise(raster: DataFrame, lines: DataFrame) -> DataFrame:
    """Mark the pixels that an occluding line separates from the iris centre."""
    return (attach(raster, lines)
            .select("image_id", "y", "x", "v", behind_line().alias("noise")))
