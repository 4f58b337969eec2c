"""Session settings the operators are designed for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "bioscore") -> SparkSession:
    """A session with adaptive execution on; `master` is only given locally."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_ready(spark: SparkSession, fallback: str | None = None) -> bool:
    """True when reliable checkpoints can be written.

    The folder named by the cluster in ``spark.checkpoint.dir`` wins; `fallback`
    is used only where the session names none, as in tests. With neither, a session on
    one machine takes a temporary folder, and a cluster is False: its machines share none.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return True
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        folder = tempfile.mkdtemp(prefix="bioscore-")
    if folder:
        context.setCheckpointDir(folder)
        return True
    return False


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder not used before, below the one that the session's machines share."""
    if not checkpoint_ready(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster sees")
    top = spark.conf.get("spark.checkpoint.dir", None)
    top = top or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
