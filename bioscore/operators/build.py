"""Template building: usable pixels → polar band → bits → packed template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode, polar
from .geometry import circles_from_points
from .masks import glare_noise, occlusion_lines, occlusion_noise


def build_templates(raster: DataFrame, circles: DataFrame, radial: int = encode.TUNED["radial"],
                    angular: int = encode.TUNED["angular"],
                    wavelength: int = encode.TUNED["wavelength"],
                    sigma: float = encode.TUNED["sigma"], scales: int = 1, mult: int = 1,
                    ranked: bool = True, data_type: int = 0) -> DataFrame:
    """Templates of all images that have pixels and circles.

    `raster` may carry a boolean `noise`; noise pixels and pixels of value 0 are
    not used. With `ranked` unreliable responses are found by their magnitude
    rank in the image, otherwise by a constant. A column `data_type` of the circles gives
    each image its own data type, for instance its sensor code; it wins over the argument.
    """
    usable = F.col("v") >= 1
    if "noise" in raster.columns:
        usable = usable & ~F.col("noise")
    known = raster.select("image_id").distinct()
    grid = polar.polar_grid(circles.join(known, "image_id", "left_semi"), radial, angular)
    band = polar.polar_band(raster.where(usable), grid)
    rows = encode.band_rows(polar.fill_mean(band))
    cells = encode.response_cells(
        encode.filter_rows(rows, angular, wavelength, sigma, scales, mult))
    packed = encode.pack_templates(encode.phase_bits(cells, ranked), radial, angular, scales, data_type)
    if "data_type" not in circles.columns:
        return packed
    kinds = circles.select("image_id", "data_type")
    return packed.drop("data_type").join(kinds, "image_id").select(*packed.columns)


def build_from_boundaries(raster: DataFrame, points: DataFrame, highlight: int | None = 240,
                          occlusion: bool = True, **options) -> DataFrame:
    """Templates from marked boundary points; images without points get none."""
    circles = circles_from_points(points)
    marked = raster.withColumn("noise", F.lit(False))
    if occlusion:
        marked = occlusion_noise(raster, occlusion_lines(points, circles))
    if highlight is not None:
        marked = marked.withColumn("noise", F.col("noise") | (F.col("v") > highlight))
    options = {**encode.BASE, "ranked": False, **options}
    return build_templates(marked, circles, **options)


def build_from_circles(raster: DataFrame, circles: DataFrame, highlight: int | None = 240,
                       **options) -> DataFrame:
    """Templates from given circles (image_id, xp, yp, rp, xi, yi, ri)."""
    marked = raster if highlight is None else glare_noise(raster, highlight)
    return build_templates(marked, circles, **{**encode.BASE, "ranked": False, **options})
