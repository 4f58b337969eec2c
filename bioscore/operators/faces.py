"""Face normalisation: eyes → aligned warp → equalisation → smoothing → ellipse."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .geometry import affine_resample, eye_alignment_map, eye_centres
from .raster import bilateral, elliptical_mask, equalize, equalize_halves


def normalise_faces(raster: DataFrame, faces: DataFrame, first: DataFrame, second: DataFrame,
                    width: int = 70, halves: bool = True) -> DataFrame:
    """Square faces of a standard size and brightness.

    `raster` holds the grey face crops, `faces` their sizes; detections are those
    of `eye_centres`. Faces without both eyes are dropped. Warped pixels from
    outside the crop are 0.
    """
    eyes = eye_centres(faces, first, second)
    warped = affine_resample(raster, eye_alignment_map(eyes, width), replicate=False)
    level = equalize_halves(warped, side=width) if halves else equalize(warped)
    return elliptical_mask(bilateral(level, 20.0, 2.0, side=width), side=width)
