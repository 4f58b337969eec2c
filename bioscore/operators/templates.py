"""The template table: batches published in two phases, and what is missing.

A table is a folder with `data/<batch>-<attempt>` (Parquet) and `manifest/<batch>`, a small
file that names the attempt. A batch is first staged as data, then published by creating its
manifest, which only one attempt can do. Readers follow the manifests, so data of a job that
died between the two phases is never seen. Where two batches hold a template of one key, the
one published first counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["image_id", "data_type"]


def missing_templates(images: DataFrame, templates: DataFrame) -> DataFrame:
    """Images without a template for their data type."""
    return images.join(templates.select(*KEY), KEY, "left_anti")


def _files(spark: SparkSession, path: str):
    """File system of a path, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def published(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(data folder, time in ms) of each published batch, first published first."""
    files, place = _files(spark, f"{path}/manifest")
    if not files.exists(place) or not files.listStatus(place):
        return []
    lines = spark.read.text(f"{path}/manifest").where(F.length("value") > 0).collect()   # one a batch
    found = [line.value.split("\t") for line in lines]
    return sorted(((folder, int(at)) for folder, at in found), key=lambda b: (b[1], b[0]))


def stage(batch_rows: DataFrame, path: str, batch: str) -> str:
    """First phase: the rows as data of a new attempt, seen by no reader. Gives the folder."""
    folder = f"{path}/data/{batch}-{uuid.uuid4().hex}"
    batch_rows.write.parquet(folder)
    return folder


def publish(spark: SparkSession, path: str, batch: str, folder: str) -> bool:
    """Second phase: make a staged folder the data of its batch.

    False where another attempt was first; its data stay and the folder is removed. A manifest
    without content is the trace of an attempt that died while writing it, and is replaced.
    """
    files, place = _files(spark, f"{path}/manifest/{batch}")
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        if files.getFileStatus(place).getLen():
            files.delete(_files(spark, folder)[1], True)
            return False
        out = files.create(place, True)
    out.write(bytearray(f"{folder}\t{int(time.time() * 1000)}\n".encode()))
    out.close()
    return True


def read_templates(spark: SparkSession, path: str) -> DataFrame | None:
    """All published templates, one per key; None before the first batch.

    Which batch holds a key is found on the narrow key columns.
    """
    batches = published(spark, path)
    if not batches:
        return None
    order = F.coalesce(*[F.when(F.col("_file").contains(f"/{folder.rsplit('/', 1)[1]}/"), i)
                         for i, (folder, _) in enumerate(batches)]) if len(batches) > 1 else F.lit(0)
    rows = spark.read.parquet(*[folder for folder, _ in batches])
    if len(batches) == 1:
        return rows
    named = rows.withColumn("_file", F.input_file_name()).withColumn("_batch", order).drop("_file")
    first = named.groupBy(*KEY).agg(F.min("_batch").alias("_batch"))
    return named.join(first, [*KEY, "_batch"]).drop("_batch")


def enroll(spark: SparkSession, images: DataFrame, path: str,
           build: Callable[[DataFrame], DataFrame], batch: str | None = None) -> bool:
    """Build the missing templates and publish them as one batch of the table at `path`.

    A batch that was published before, under the same name, is not built again: a job that
    died is simply run again. False where there was nothing left to do.
    """
    batch = batch or uuid.uuid4().hex
    files, place = _files(spark, f"{path}/manifest/{batch}")
    if files.exists(place) and files.getFileStatus(place).getLen():
        return False
    known = read_templates(spark, path)
    folder = stage(build(images if known is None else missing_templates(images, known)), path, batch)
    return publish(spark, path, batch, folder)


def remove_unpublished(spark: SparkSession, path: str, older_than_ms: int) -> int:
    """Delete staged data that no manifest names and that is older; gives their number."""
    files, place = _files(spark, f"{path}/data")
    if not files.exists(place):
        return 0
    named = {folder.rsplit("/", 1)[1] for folder, _ in published(spark, path)}
    before = time.time() * 1000 - older_than_ms
    gone = [s.getPath() for s in files.listStatus(place)
            if s.getPath().getName() not in named and s.getModificationTime() < before]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)
