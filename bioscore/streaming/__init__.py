"""Enrolment of arriving images.

Parsing, masks, comparison and other row-wise operators accept streaming frames as
they are. Building templates groups by image, so it runs per micro-batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.templates import KEY, enroll


def enroll_stream(images: DataFrame, path: str, checkpoint: str,
                  build: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Build the templates of new images and publish them in the table at `path`.

    A micro-batch is published under its number and the name of its checkpoint, so one that is
    replayed after a failure adds nothing.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        enroll(batch.sparkSession, batch.dropDuplicates(KEY), path, build, f"{name}-{number}")

    return images.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
