"""Score and ROC report files: tab-separated text with heading lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column headings of the two formats.
SCORE_HEADING = ("  HDXorY  R/L M/NM gSubID pSubID     \t  gFName"
                 "                       pFName")
ROC_HEADING = "Matches NonMatches Thres  FRR     FAR     TRR     TAR"


def experiment_file(out: Column, index: Column, tag: Column, extension: Column) -> Column:
    """<out>_<index><tag><extension>"""
    return F.concat(out, F.lit("_"), index.cast("string"), tag, extension)


def five_digits(c: str, width: int = 10) -> Column:
    """%10.5f with ties to even, as C prints them."""
    return F.format_string(f"%{width}.5f", F.bround(c, 5))


def score_line() -> Column:
    """One report line from hd, pos, match_type, subjects and names."""
    return F.concat_ws(
        "\t", five_digits("hd"), F.format_string("%2d", "pos"),
        F.format_string("%2d", "match_type"), F.format_string("%5s", "g_subject"),
        F.format_string("%5s", "p_subject"), F.format_string("%25s", "g_name"),
        F.format_string("%25s", "p_name"))


def column(line: str, number: int) -> Column:
    """Column `number` (the first one is -1) as a double; text gives NULL."""
    return F.expr(f"try_cast(trim(get(split({line}, '\t'), {number + 1})) as double)")


def _report_rows(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Lines of report files or folders that hold data: their first column is a number.

    Headings and trailers are told by their content, so every file may have its own, or none.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw"),
                                         F.col("_metadata.file_path").alias("file"))
    return lines.where((F.size(F.split("raw", "\t")) >= columns)
                       & column("raw", -1).isNotNull() & (F.size(F.split("raw", "\t")) > 1))


def read_scores(spark: SparkSession, path: str, number: int = -1) -> DataFrame:
    """(file, hd): one score column. Lines with too few columns are dropped."""
    return _report_rows(spark, path, number + 2).select("file", column("raw", number).alias("hd"))


def experiment_of(file: Column) -> Column:
    """Experiment of a report file from its folder experiment=….

    Paths are URIs, and the writer has escaped special characters of folder names before.
    """
    name = F.regexp_extract(file, "experiment=([^/]*)", 1)
    for _ in range(2):
        name = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return name


def read_rates(spark: SparkSession, path: str, number: int = 2) -> DataFrame:
    """(file, match, nonmatch, thres, frr, far, trr, tar); the EER trailer is dropped."""
    names = ("match", "nonmatch", "thres", "frr", "far", "trr", "tar")
    at = {name: column("raw", number + k) for k, name in enumerate(names[3:])}
    at.update({name: column("raw", k - 1) for k, name in enumerate(names[:3])})
    rows = _report_rows(spark, path, number + 5)
    return rows.select("file", *[at[n].alias(n) for n in names]).where(F.col("far") != -999)


def read_eer(spark: SparkSession, path: str) -> DataFrame:
    """(file, eer): the trailers of ROC report files."""
    rows = _report_rows(spark, path, 8).where(column("raw", 0) == -999)
    return rows.select("file", column("raw", -1).alias("eer"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Score table as Parquet, one folder per experiment, eye and kind."""
    scores.write.mode("append").partitionBy("experiment", "pos", "match_type").parquet(path)


def _headed(lines: DataFrame, heading: tuple[str, ...]) -> DataFrame:
    """(experiment, line) with the heading before the first line of each file.

    The writer starts a file per task and experiment, so that is where headings go.
    """
    def run(batches):
        current = None
        for batch in batches:
            out = []
            for name, line in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if name != current or current is None:
                    out += [(name, text) for text in heading]
                    current = name
                out.append((name, line))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)],
                                  ["experiment", "line"])

    ordered = lines.select("experiment", "line").sortWithinPartitions("experiment")
    return ordered.mapInArrow(run, "experiment string, line string")


def export_scores(scores: DataFrame, path: str) -> None:
    """Score report files with their heading, one folder per experiment."""
    lines = scores.select("experiment", score_line().alias("line"))
    (_headed(lines, ("Scores", "", SCORE_HEADING))
     .write.mode("overwrite").partitionBy("experiment").text(path))


def export_roc(points: DataFrame, eer: DataFrame, path: str) -> None:
    """ROC report files with heading and EER trailer, one folder per experiment.

    `points` as from `evaluate.roc`, `eer` one row per experiment.
    """
    lines = points.select("experiment", roc_line().alias("line"))
    ends = eer.select("experiment", F.concat_ws(
        "\t", five_digits("eer", 1), *[F.lit("-999.00")] * 6, F.lit("EER")).alias("line"))
    (_headed(lines.unionByName(ends), ("ROC", "", ROC_HEADING))
     .write.mode("overwrite").partitionBy("experiment").text(path))


def roc_line() -> Column:
    return F.concat_ws("\t", *[five_digits(c, 1) for c in
                               ("match", "nonmatch", "thres", "frr", "far", "trr", "tar")])
