"""Sensor presets: a fixed table of nine sensor codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code → (n_scale, alpha, circle_ratio, closing, opening, scaling).
PRESETS = {
    88: (2.0, 25, 0.90, 2, 3, 0.4),
    99: (1.0, 20, 0.65, 0, 3, 0.45),
    1: (2.0, 20, 0.92, 2, 3, 0.25),
    2: (2.0, 30, 0.92, 2, 1, 0.2),
    3: (1.0, 20, 0.65, 0, 3, 0.45),
    4: (2.0, 38, 0.92, 0, 4, 0.3),
    5: (2.0, 40, 0.92, 0, 4, 0.2),
    6: (2.0, 18, 0.92, 3, 2, 0.2),
    7: (2.0, 4, 0.92, 0, 3, 0.4),
}
DEFAULTS = (1.0, 20, 1.0, 2, 3, 0.4)
NAMES = ("n_scale", "alpha", "circle_ratio", "closing", "opening", "scaling")

#: Largest pupil and iris radius at scale 1.
PUPIL_MAX, IRIS_MAX = 42, 82


def lookup_presets(images: DataFrame, code: str = "code") -> DataFrame:
    """Attach the parameters of the sensor code; unknown codes keep the defaults."""
    rows = [(k, *v) for k, v in PRESETS.items()]
    schema = (f"{code} int, n_scale double, alpha int, circle_ratio double, "
              "closing int, opening int, scaling double")
    presets = images.sparkSession.createDataFrame(rows, schema)
    joined = images.join(F.broadcast(presets), code, "left")       # nine rows
    for name, value in zip(NAMES, DEFAULTS):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(value)))
    return (joined.withColumn("pupil_max", (F.col("n_scale") * PUPIL_MAX).cast("int"))
            .withColumn("iris_max", (F.col("n_scale") * IRIS_MAX).cast("int")))
