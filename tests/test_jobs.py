"""End-to-end jobs on small input."""

import numpy as np
from bioscore.operators import jobs
from bioscore.sources import scores as files
from pyspark.sql import functions as F
from test_images import eye, to_raster


def test_automatic_templates(spark):
    r = to_raster(spark, {1: eye(200, 210, 100, 95, 20, 60), 2: eye(200, 210, 104, 98, 22, 62, seed=2)})
    candidates = spark.createDataFrame(
        [(1, 1, 30, 28, 90, 1.0, 100, 95, 40, 39), (1, 1, 30, 20, 60, 2.0, 30, 30, 40, 10)],
        "image_id int, pass int, start int, threshold int, count int, ord double, cx int, cy int, w int, h int")
    circles = {c.image_id: c for c in jobs.locate_eyes(r, candidates).collect()}
    assert (circles[1].xp, circles[1].yp, circles[1].rp) == (100, 95, 21)
    assert (circles[2].xp, circles[2].yp, circles[2].rp) == (105, 100, 21)      # fallback
    assert abs(circles[1].xi - 100) <= 4 and abs(circles[1].ri - 60) <= 5
    templates = jobs.build_automatic(r, candidates).collect()
    assert {t.image_id for t in templates} == {1, 2} and all(len(t.code) == 277 for t in templates)


def test_files_to_report(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name, mean in (("m", 0.3), ("n", 0.5)):
        lines = ["t", "", "h"] + [f"{v:10.5f}\t 1\t 1" for v in rng.normal(mean, 0.08, 300)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    results = jobs.evaluate_files(spark, str(tmp_path / "m"), str(tmp_path / "n"), experiment="e")
    assert results["roc"].count() == 300 and 0.02 < results["eer"].first().eer < 0.2
    jobs.write_evaluation(results, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "points")).count() == results["points"].count()


def test_experiments_of_one_folder(spark, tmp_path):
    """Names of experiments survive their folders; all are evaluated in one job."""
    names = ["plain", "a b", "a+b", "50%25", "x/y", "ä=1"]
    rows = [(n, k, h / 10) for n in names for k in (1, 2) for h in range(k, 8)]
    table = spark.createDataFrame(rows, "experiment string, match_type int, hd double")
    for c in ("g_subject", "p_subject", "g_name", "p_name"):
        table = table.withColumn(c, F.lit("00001"))
    table = table.withColumn("pos", F.lit(1))
    for side, kind in (("m", 1), ("n", 2)):
        files.export_scores(table.where(F.col("match_type") == kind), str(tmp_path / side))
    results = jobs.evaluate_files(spark, str(tmp_path / "m/*"), str(tmp_path / "n/*"),
                                  experiment=files.experiment_of(F.col("file")))
    assert {r.experiment for r in results["eer"].collect()} == set(names)
