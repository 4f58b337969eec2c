"""Small helpers of this package: folders that the whole cluster sees, intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_ready


BATCH_ROWS = 500


def modest_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands texts to Python in smaller batches.

    Texts can be long: 10,000 of them, Spark's default, are far more than a kernel needs.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver see."""
    if not checkpoint_ready(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster sees")
    top = spark.conf.get("spark.checkpoint.dir", None)
    top = top or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: computed once, safe when executors go."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate folder that this package wrote."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
