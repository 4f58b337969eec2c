"""Enrolment from a stream of image rows."""

from bioscore.operators.templates import read_templates
from bioscore.streaming import enroll_stream
from pyspark.sql import functions as F


def test_stream_enrols_each_image_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "templates")
    rows = lambda n: spark.range(n).select(F.col("id").alias("image_id"), F.lit(1).alias("data_type"))

    def run():
        stream = spark.readStream.schema("image_id long, data_type int").parquet(source)
        writer = enroll_stream(stream, table, str(tmp_path / "progress"),
                               lambda images: images.withColumn("code", F.array(F.lit(1))))
        writer.trigger(availableNow=True).start().awaitTermination(60)

    rows(4).write.parquet(source)
    run()
    rows(7).write.mode("append").parquet(source)
    run()
    got = read_templates(spark, table)
    assert got.count() == 7 and got.select("image_id").distinct().count() == 7
