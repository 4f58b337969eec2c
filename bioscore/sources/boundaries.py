"""Boundary files: marked points (two rings of eight) and given circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_points(files: DataFrame, text: str = "text") -> DataFrame:
    """(image_id, text) → (image_id, ring, k, x, y, valid), pupil ring first.

    Every point is a line "x y +" or "x y -"; files without sixteen points are
    unreadable and dropped.
    """
    marks = F.expr(f"regexp_extract_all({text}, '(-?[0-9]+)[ \\\\t]+(-?[0-9]+)[ \\\\t]+([+-])', 0)")
    rows = (files.withColumn("_m", marks).where(F.size("_m") == 16)
            .select("image_id", F.posexplode("_m").alias("_i", "_p"))
            .withColumn("_f", F.split("_p", "[ \\t]+")))
    return rows.select(
        "image_id", F.when(F.col("_i") < 8, "pupil").otherwise("iris").alias("ring"),
        (F.col("_i") % 8).alias("k"), F.col("_f")[0].cast("int").alias("x"),
        F.col("_f")[1].cast("int").alias("y"), (F.col("_f")[2] == "+").alias("valid"))


def parse_circles(files: DataFrame, text: str = "text") -> DataFrame:
    """Six numbers: iris row, column, radius, then pupil row, column, radius."""
    names = ("yi", "xi", "ri", "yp", "xp", "rp")
    parts = F.split(F.trim(F.col(text)), r"\s+")
    return (files.withColumn("_f", parts).where(F.size("_f") >= 6)
            .select("image_id", *[F.col("_f")[i].cast("int").alias(n) for i, n in enumerate(names)]))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (image_id, text); the image id is the name without extension."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(
        name.alias("image_id"), F.col("value").alias("text"))


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Grey images stored as (image_id, w, pixels array<int>, row by row) → raster."""
    images = spark.read.parquet(path)
    return images.select("image_id", "w", F.posexplode("pixels").alias("_i", "v")).select(
        "image_id", F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"),
        (F.col("_i") % F.col("w")).cast("int").alias("x"), "v")
