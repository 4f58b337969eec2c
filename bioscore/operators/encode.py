"""Phase encoding of polar bands: row filter, thresholds, bits, packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the tuned and of the base path.
TUNED = {"radial": 34, "angular": 260, "wavelength": 18, "sigma": 0.55, "low": 0.02, "high": 0.85}
BASE = {"radial": 20, "angular": 240, "wavelength": 18, "sigma": 0.5}
#: Base path: responses weaker than this are unreliable.
WEAK = 0.0001


def filter_matrix(n: int, wavelength: int, sigma: float) -> np.ndarray:
    """The log-Gabor filter of a length-n row as one complex n × n matrix.

    Transform, weighting of the frequencies 0 … n/2 and inverse transform are
    linear and the same for every row, so a row is filtered by one product.
    """
    half = n // 2
    radius = np.arange(1, half + 1) / half / 2
    gain = np.zeros(n)
    gain[1: half + 1] = np.exp(-np.log(radius * wavelength) ** 2 / (2 * np.log(sigma) ** 2))
    return np.fft.ifft(gain[:, None] * np.fft.fft(np.eye(n), axis=0), axis=0).T


def band_rows(band: DataFrame) -> DataFrame:
    """One record per ring, in angular order: arrays v and noise."""
    cells = F.array_sort(F.collect_list(F.struct("a", "v", "noise")))
    rows = band.groupBy("image_id", "r").agg(cells.alias("_c"))
    return rows.select("image_id", "r", F.transform("_c", lambda c: c["v"]).alias("v"),
                       F.transform("_c", lambda c: c["noise"]).alias("noise"))


def filter_rows(rows: DataFrame, n: int, wavelength: int, sigma: float, scales: int = 1,
                mult: int = 1, digits: int = 12) -> DataFrame:
    """Complex response of every row: the other columns plus scale, re and im arrays.

    Rows arrive as Arrow batches and a batch is filtered as one matrix product.
    Responses are rounded to `digits`, so that a response that is zero up to
    rounding is zero.
    """
    keep = [c for c in rows.columns if c != "v"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "v"]
                       + ["scale int", "re array<double>", "im array<double>"])
    lengths = [wavelength * mult ** k for k in range(scales)]

    def kernel(batches):
        filters = [filter_matrix(n, length, sigma) for length in lengths]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index("v"))
            x = np.asarray(values.flatten()).reshape(batch.num_rows, n)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            ends = pa.array(np.arange(0, (batch.num_rows + 1) * n, n, dtype=np.int32))
            for k, matrix in enumerate(filters):
                y = np.round(x @ matrix, digits) + 0.0
                parts = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(p).ravel()))
                         for p in (y.real, y.imag)]
                scale = pa.array(np.full(batch.num_rows, k, np.int32))
                yield pa.RecordBatch.from_arrays([*kept, scale, *parts],
                                                 names=[*keep, "scale", "re", "im"])

    return rows.mapInArrow(kernel, schema)


def response_cells(responses: DataFrame) -> DataFrame:
    """One row per response: position a with re, im, magnitude and noise if known."""
    arrays = [c for c in ("re", "im", "noise") if c in responses.columns]
    keep = [c for c in responses.columns if c not in arrays]
    cells = responses.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("a", "_c"))
    return (cells.select(*keep, "a", *[F.col(f"_c.{c}").alias(c) for c in arrays])
            .withColumn("mag", F.sqrt(F.col("im") * F.col("im") + F.col("re") * F.col("re"))))


def _float32(rate: float) -> float:
    return float(np.float32(rate))


def with_thresholds(cells: DataFrame, low: float = TUNED["low"],
                    high: float = TUNED["high"]) -> DataFrame:
    """Attach the magnitudes at two ranks of the image and scale, as low and high.

    Rank int(n·rate) - 1, or 0; the rates are single-precision numbers.
    """
    whole = Window.partitionBy("image_id", "scale")     # radial × angular cells
    place = lambda rate: F.greatest(F.floor(F.col("_n") * _float32(rate)), F.lit(1))
    ranked = (cells.withColumn("_k", F.row_number().over(whole.orderBy("mag")))
              .withColumn("_n", F.count("*").over(whole)))
    pick = lambda rate: F.max(F.when(F.col("_k") == place(rate), F.col("mag"))).over(whole)
    return (ranked.withColumn("low", pick(low)).withColumn("high", pick(high)).drop("_k", "_n"))


def magnitude_thresholds(cells: DataFrame, low: float = TUNED["low"],
                         high: float = TUNED["high"]) -> DataFrame:
    """(image_id, scale, low, high)"""
    return (with_thresholds(cells, low, high).groupBy("image_id", "scale")
            .agg(F.max("low").alias("low"), F.max("high").alias("high")))


def coefficient_thresholds(cells: DataFrame, rate: float) -> DataFrame:
    """|re| and |im| at rank int(n·rate) per image and scale."""
    by = ["image_id", "scale"]
    out = None
    for part in ("re", "im"):
        w = Window.partitionBy(*by).orderBy(F.abs(part))
        n = F.count("*").over(Window.partitionBy(*by))
        at_rank = (cells.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", n)
                   .where(F.col("_k") == F.floor(F.col("_n") * _float32(rate))))
        found = at_rank.select(*by, F.abs(part).alias(part))
        out = found if out is None else out.join(found, by)
    return out


def phase_bits(cells: DataFrame, ranked: bool = True) -> DataFrame:
    """Two bits per response and whether they are masked.

    Masked are noise cells and unreliable responses: with `ranked` those outside
    the two magnitude ranks of the image, otherwise those weaker than a constant.
    """
    if ranked:
        cells = with_thresholds(cells)
        weak = (F.col("mag") < F.col("low")) | (F.col("mag") > F.col("high"))
    else:
        weak = F.col("mag") < WEAK
    return cells.select("image_id", "r", "a", "scale", (F.col("re") > 0).alias("bit_re"),
                        (F.col("im") > 0).alias("bit_im"), (F.col("noise") | weak).alias("masked"))


def pack_templates(bits: DataFrame, radial: int, angular: int, scales: int = 1,
                   data_type: int | Column = 0) -> DataFrame:
    """Templates (image_id, data_type, n_rad, n_ang, code, mask) from phase bits.

    Words are combined map-side with bit_or; an image contributes only its few
    hundred words to the final shuffle.
    """
    n_ang = 2 * scales * angular
    total = radial * n_ang
    words = (total + 63) // 64
    base = F.col("r") * n_ang + F.col("a") * (2 * scales) + 2 * F.col("scale")
    place = F.expr("shiftleft(1L, cast(_i % 64 as int))")
    one = lambda flag: F.when(flag, place).otherwise(F.lit(0).cast("long"))
    halves = F.array(F.struct(base.alias("i"), F.col("bit_re").alias("b")),
                     F.struct((base + 1).alias("i"), F.col("bit_im").alias("b")))
    flat = (bits.select("image_id", "masked", F.explode(halves).alias("h"))
            .select("image_id", F.col("h.i").alias("_i"), F.col("h.b").alias("_b"), "masked"))
    packed = flat.groupBy("image_id", F.floor(F.col("_i") / 64).alias("word")).agg(
        F.bit_or(one(F.col("_b"))).alias("code"), F.bit_or(one(F.col("masked"))).alias("mask"))
    used = total % 64
    if used:
        pad = -(1 << used)                              # high bits of the last word
        packed = packed.withColumn("mask", F.when(
            F.col("word") == words - 1, F.col("mask").bitwiseOR(F.lit(pad).cast("long")))
            .otherwise(F.col("mask")))
    ordered = packed.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("word", "code", "mask"))).alias("w"))
    kind = data_type if isinstance(data_type, Column) else F.lit(data_type)
    return ordered.select("image_id", kind.alias("data_type"), F.lit(radial).alias("n_rad"),
                          F.lit(n_ang).alias("n_ang"),
                          F.transform("w", lambda e: e["code"]).alias("code"),
                          F.transform("w", lambda e: e["mask"]).alias("mask"))
