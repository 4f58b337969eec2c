"""Headline timings; prints one JSON line.

Every query runs once to warm up and once timed, written to the no-op sink so that
all columns of all rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bioscore.plans import registry  # noqa: E402
from bioscore.session import SETTINGS  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "genuine_pairs_self", "hamming_unshifted", "hamming_x_or_y", "impostor_scores", "verify_pairs",
    "roc", "eer", "operating_points", "glcm_contrast", "edge_density", "gaussian_smooth",
    "occlusion_noise", "threshold_sweep", "build_templates", "loggabor_rows", "phase_bits",
    "circle_votes", "line_votes", "region_grow", "find_circle", "covariance", "reconstruct")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
               .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", cpus))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    seconds = {}
    for name in chosen:
        for _ in range(2):
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
