"""Polar normalisation: sampling grid between pupil and iris, and the polar band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import PI


def polar_grid(circles: DataFrame, radial: int, angular: int) -> DataFrame:
    """Sampling positions (image_id, r, a, px, py), 1-based pixel coordinates.

    `angular` directions span the full turn with both ends included; of
    radial + 2 rings between the pupil and the iris boundary the first and the
    last are left out. The iris radius is measured from the pupil centre.
    """
    ox, oy = F.col("xp") - F.col("xi"), F.col("yp") - F.col("yi")
    sign = F.when((ox > 0) | ((ox == 0) & (oy > 0)), 1.0).otherwise(-1.0)
    phi = F.when(ox == 0, PI / 2).otherwise(F.atan(oy / ox))
    d2 = (ox * ox + oy * oy).cast("double")
    theta = F.col("a") * (2 * PI) / (angular - 1)
    b = F.col("_sign") * F.cos(F.lit(PI) - F.col("_phi") - F.col("_theta"))
    reach = (F.sqrt("_d2") * F.col("_b")
             + F.sqrt(F.col("_d2") * F.col("_b") * F.col("_b")
                      - (F.col("_d2") - F.col("ri") * F.col("ri"))) - F.col("rp"))
    rays = (circles.withColumn("_sign", sign).withColumn("_phi", phi).withColumn("_d2", d2)
            .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(angular - 1))))
            .withColumn("_theta", theta).withColumn("_b", b).withColumn("_reach", reach)
            .withColumn("_cos", F.cos("_theta")).withColumn("_sin", F.sin("_theta")))
    rho = F.col("_reach") * (F.col("r") + 1) / (radial + 1) + F.col("rp")
    return (rays.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(radial - 1))))
            .withColumn("_rho", rho)
            .select("image_id", "r", "a", (F.col("_rho") * F.col("_cos") + F.col("xp")).alias("px"),
                    (-F.col("_rho") * F.col("_sin") + F.col("yp")).alias("py")))


def polar_band(raster: DataFrame, grid: DataFrame) -> DataFrame:
    """Bilinear values on the grid: (image_id, r, a, v, noise), v in 0 … 1.

    A cell is noise (v NULL) when one of its four pixels is outside the image or
    noise. `raster` holds the usable pixels: noise pixels are removed before.
    """
    corners = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dx in (0, 1) for dy in (0, 1)])
    asked = (grid.withColumn("_c", F.explode(corners))
             .withColumn("x", (F.floor("px") + F.col("_c.dx") - 1).cast("int"))
             .withColumn("y", (F.floor("py") + F.col("_c.dy") - 1).cast("int")))
    read = asked.join(raster.select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left")
    corner = lambda dx, dy: F.max(F.when((F.col("_c.dx") == dx) & (F.col("_c.dy") == dy),
                                         F.col("v").cast("double")))
    cells = read.groupBy("image_id", "r", "a", "px", "py").agg(
        *[corner(dx, dy).alias(f"v{dx}{dy}") for dx in (0, 1) for dy in (0, 1)])
    s, t = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    value = ((F.col("v00") * (1 - t) + F.col("v01") * t) * (1 - s)
             + (F.col("v10") * (1 - t) + F.col("v11") * t) * s)
    return (cells.withColumn("v", value / 255)
            .select("image_id", "r", "a", "v", F.col("v").isNull().alias("noise")))


def fill_mean(band: DataFrame) -> DataFrame:
    """Give noise cells the image mean, in which a noise cell counts 0.5."""
    whole = Window.partitionBy("image_id")              # radial × angular cells
    mean = F.avg(F.coalesce("v", F.lit(0.5))).over(whole)
    return band.withColumn("v", F.coalesce("v", mean))
