"""Queries on score tables: rescaling, ROC, EER, operating points, score lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, jobs
from ..session import new_folder
from ..sources import scores as files
from ..sources.presets import lookup_presets
from .fixtures import table


def score_table(spark, d):
    """Five experiments from the values of all events, in one scan.

    Nonmatch longer, match longer, equal sizes, one with -1 scores, and one of clicks.
    """
    h = F.floor(F.col("value") / 500 * 10000 + 0.5) / 10000
    mirrored = F.floor((F.lit(0.7) - F.col("value") / 500) * 10000 + 0.5) / 10000
    failing = F.when(F.col("value") < 5, F.lit(-1.0)).otherwise(h)

    def row(experiment, pos, match_type, hd):
        return F.struct(F.lit(experiment).alias("experiment"), F.lit(pos).alias("pos"),
                        F.lit(match_type).alias("match_type"), hd.alias("hd"))

    kind = F.col("event_type")
    rows = (F.when(kind == "purchase", F.array(row("nonmatch_longer", 1, 1, h),
                                               row("negative", 1, 1, failing)))
            .when(kind == "view", F.array(row("nonmatch_longer", 1, 2, h),
                                          row("match_longer", 2, 2, h),
                                          row("equal", 1, 1, h), row("equal", 1, 2, mirrored)))
            .when(kind == "signup", F.array(row("match_longer", 2, 1, h)))
            .when(kind == "error", F.array(row("negative", 1, 2, failing),
                                           row("clicks", 2, 2, h)))
            .when(kind == "click", F.array(row("clicks", 2, 1, mirrored))))
    return (table(spark, d, "events").select("event_id", F.explode(rows).alias("r"))
            .select("event_id", "r.*"))


def scores_only(spark, d):
    return score_table(spark, d).drop("event_id")


def rescale(spark, d):
    return evaluate.rescale_scores(scores_only(spark, d))


def rescale_exact(spark, d):
    """With the scores that mark failed comparisons kept, at any size."""
    return evaluate.rescale_scores(scores_only(spark, d), incomparable="keep")


def roc(spark, d):
    return evaluate.roc(scores_only(spark, d))


def roc_strided(spark, d):
    """Every third point, on request."""
    return evaluate.roc(scores_only(spark, d), stride=3)


def roc_points(spark, d):
    return evaluate.roc_points(scores_only(spark, d))


def roc_points_few(spark, d):
    """A coarse curve, on request."""
    return evaluate.roc_points(scores_only(spark, d), stride=25)


def eer(spark, d):
    return evaluate.eer(scores_only(spark, d))


def operating_points(spark, d):
    return evaluate.operating_points(evaluate.rates(scores_only(spark, d)))


def operating_points_few(spark, d):
    """A coarse curve, so that low decades are missing."""
    return evaluate.operating_points(evaluate.rates(scores_only(spark, d), stride=25))


def score_lines(spark, d):
    """Scores written as report lines and read back by column number.

    Event type and id stand in for names; the user gives the subject ids.
    """
    subject = F.lpad((F.col("user_id") % 100000).cast("string"), 5, "0")
    rows = table(spark, d, "events").select(
        "event_id", (F.col("value") / 500).alias("hd"), F.lit(1).alias("pos"),
        F.lit(2).alias("match_type"), subject.alias("g_subject"), subject.alias("p_subject"),
        F.col("event_type").alias("g_name"), F.col("event_id").cast("string").alias("p_name"))
    lines = rows.select("event_id", files.score_line().alias("line"))
    return lines.select("event_id", "line", files.column("line", -1).alias("hd"),
                        files.column("line", 1).alias("match_type"),
                        files.column("line", 4).alias("g_name"))


def _named(rows):
    """The columns of a score report line; names are not looked at here."""
    return rows.select("experiment", "pos", "match_type", "hd", *[
        F.lit(v).alias(c) for c, v in (("g_subject", "00001"), ("p_subject", "00002"),
                                       ("g_name", "g.bmp"), ("p_name", "p.bmp"))])


def score_roundtrip(spark, d):
    """All scores as report files, one folder per experiment, read back and counted."""
    folder = new_folder(spark, "scores")
    files.export_scores(_named(scores_only(spark, d)), folder)
    back = files.read_scores(spark, f"{folder}/*")
    return back.groupBy(files.experiment_of(F.col("file")).alias("experiment"), "hd").agg(F.count("*").alias("scores"))


def roc_roundtrip(spark, d):
    """ROC report files with their trailers, read back: points and EER per experiment."""
    folder = new_folder(spark, "roc")
    files.export_roc(evaluate.roc(scores_only(spark, d)), evaluate.eer(scores_only(spark, d)), folder)
    name = files.experiment_of(F.col("file")).alias("experiment")
    points = files.read_rates(spark, f"{folder}/*").groupBy(name).agg(
        F.count("*").alias("points"), F.max("thres").alias("last_thres"), F.min("frr").alias("low_frr"),
        F.max("far").alias("top_far"))
    return points.join(files.read_eer(spark, f"{folder}/*").select(name, "eer"), "experiment")


def evaluate_job(spark, d):
    """The whole job on the score files of all experiments: written, read once, evaluated."""
    folder = new_folder(spark, "job")
    rows = scores_only(spark, d)
    for side, kind in (("m", 1), ("n", 2)):
        files.export_scores(_named(rows.where(F.col("match_type") == kind)), f"{folder}/{side}")
    results = jobs.evaluate_files(spark, f"{folder}/m/*", f"{folder}/n/*", pos=2,
                                  experiment=files.experiment_of(F.col("file")))
    jobs.write_evaluation(results, f"{folder}/out")
    read = lambda name: spark.read.parquet(f"{folder}/out/{name}")
    counted = lambda name, out: read(name).groupBy("experiment").agg(F.count("*").alias(out))
    return (read("eer").select("experiment", "pos", "eer").join(counted("roc", "points"), "experiment")
            .join(counted("points", "kept"), "experiment"))


def experiment_names(spark, d):
    kinds = table(spark, d, "events").groupBy("event_type").agg(
        F.min("event_id").alias("number"))
    return kinds.select("event_type", files.experiment_file(
        F.lit("scores"), F.col("number"), F.concat(F.lit("_"), "event_type"),
        F.lit(".txt")).alias("file_name"))


def sensor_presets(spark, d):
    """Parameters per order line: the line number as sensor code, some unknown."""
    codes = table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_tax") > 0.07, F.lit(88))
        .when(F.col("l_tax") > 0.06, F.lit(99)).when(F.col("l_tax") < 0.01, F.lit(42))
        .otherwise(F.col("l_linenumber")).alias("code"))
    return lookup_presets(codes).groupBy(
        "code", "n_scale", "alpha", "circle_ratio", "closing", "opening", "scaling",
        "pupil_max", "iris_max").agg(F.count("*").alias("images"))


# ------------------------------------------------------------------------ SQL

SCORES_SQL = """valued AS (
  SELECT event_id, event_type, floor(value / 500 * 10000 + 0.5) / 10000 AS h,
    floor((0.7::DOUBLE - value / 500) * 10000 + 0.5) / 10000 AS mirrored,
    CASE WHEN value < 5 THEN -1e0 ELSE floor(value / 500 * 10000 + 0.5) / 10000 END AS failing
  FROM events),
scores AS (
  SELECT 'nonmatch_longer' AS experiment, 1 AS pos, 1 AS match_type, h AS hd FROM valued WHERE event_type = 'purchase'
  UNION ALL SELECT 'nonmatch_longer', 1, 2, h FROM valued WHERE event_type = 'view'
  UNION ALL SELECT 'match_longer', 2, 1, h FROM valued WHERE event_type = 'signup'
  UNION ALL SELECT 'match_longer', 2, 2, h FROM valued WHERE event_type = 'view'
  UNION ALL SELECT 'equal', 1, 1, h FROM valued WHERE event_type = 'view'
  UNION ALL SELECT 'equal', 1, 2, mirrored FROM valued WHERE event_type = 'view'
  UNION ALL SELECT 'negative', 1, 1, failing FROM valued WHERE event_type = 'purchase'
  UNION ALL SELECT 'negative', 1, 2, failing FROM valued WHERE event_type = 'error'
  UNION ALL SELECT 'clicks', 2, 1, mirrored FROM valued WHERE event_type = 'click'
  UNION ALL SELECT 'clicks', 2, 2, h FROM valued WHERE event_type = 'error')"""


def _rescaled_sql(keep: bool = False) -> str:
    return f"""{SCORES_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY experiment, pos, match_type ORDER BY hd) - 1 AS i FROM scores
  WHERE hd IS NOT NULL {'' if keep else 'AND hd >= 0'}),
sizes AS (
  SELECT experiment, pos, count(*) FILTER (match_type = 1) AS m, count(*) FILTER (match_type = 2) AS n
  FROM ranked GROUP BY ALL),
linked AS (
  SELECT s.experiment, s.pos, s.i AS mi, least(((s.i + 1) * z.n) // z.m, z.n - 1) AS ni
  FROM ranked s JOIN sizes z USING (experiment, pos) WHERE z.n > z.m AND s.match_type = 1
  UNION ALL
  SELECT s.experiment, s.pos, least(((s.i + 1) * z.m) // z.n, z.m - 1), s.i
  FROM ranked s JOIN sizes z USING (experiment, pos) WHERE z.m > z.n AND s.match_type = 2
  UNION ALL
  SELECT s.experiment, s.pos, s.i, s.i
  FROM ranked s JOIN sizes z USING (experiment, pos) WHERE z.m = z.n AND s.match_type = 1),
rescaled AS (
  SELECT l.experiment, l.pos, CASE WHEN z.m > z.n THEN l.ni ELSE l.mi END AS idx, a.hd AS match, b.hd AS nonmatch
  FROM linked l JOIN sizes z USING (experiment, pos)
  JOIN ranked a ON a.experiment = l.experiment AND a.pos = l.pos AND a.match_type = 1 AND a.i = l.mi
  JOIN ranked b ON b.experiment = l.experiment AND b.pos = l.pos AND b.match_type = 2 AND b.i = l.ni)"""


def _roc_sql(stride: int = 1) -> str:
    return f"""{_rescaled_sql()},
total AS (SELECT experiment, pos, count(*) AS size FROM rescaled GROUP BY ALL),
seen AS (SELECT r.*, t.size FROM rescaled r JOIN total t USING (experiment, pos) WHERE r.idx % {stride} = 0),
counted AS (
  SELECT j.experiment, j.pos, j.idx, j.match, j.nonmatch, j.size,
    max(k.idx) FILTER (k.match >= 0 AND k.match <= j.match) AS ti,
    max(k.idx) FILTER (k.nonmatch >= 0 AND k.nonmatch <= j.match) AS fi
  FROM seen j JOIN seen k USING (experiment, pos) GROUP BY ALL),
rates AS (
  SELECT experiment, pos, idx, match, nonmatch, match AS thres,
    1 - coalesce((ti + 1) / size::DOUBLE, 0e0) AS frr, coalesce((fi + 1) / size::DOUBLE, 0e0) AS far,
    1 - coalesce((fi + 1) / size::DOUBLE, 0e0) AS trr, coalesce((ti + 1) / size::DOUBLE, 0e0) AS tar
  FROM counted),
looked AS (
  SELECT *, lead(far) OVER w AS far_next, lag(frr, 1, 1e0) OVER w AS pfrr, lag(far, 1, 0e0) OVER w AS pfar
  FROM rates WINDOW w AS (PARTITION BY experiment, pos ORDER BY idx)),
points AS (
  SELECT experiment, pos, idx, thres, frr, far, trr, tar FROM looked
  WHERE far_next IS NULL OR far_next <> far)"""


def _operating_sql(stride: int = 1) -> str:
    return f"""WITH {_roc_sql(stride)},
curve AS (
  SELECT experiment, pos, thres, any_value(frr) AS frr, any_value(far) AS far, any_value(trr) AS trr,
    any_value(tar) AS tar FROM rates GROUP BY ALL),
prevs AS (
  SELECT *, row_number() OVER w AS n, lag(frr) OVER w AS pf, lag(far) OVER w AS pa,
    lag(trr) OVER w AS pt, lag(tar) OVER w AS pu
  FROM curve WINDOW w AS (PARTITION BY experiment, pos ORDER BY thres)),
decades(decade, v, top) AS (VALUES (0, 0.0001::DOUBLE, 0.001::DOUBLE), (1, 0.001::DOUBLE, 0.01::DOUBLE),
  (2, 0.01::DOUBLE, 0.1::DOUBLE), (3, 0.1::DOUBLE, 1::DOUBLE), (4, 1::DOUBLE, 10::DOUBLE)),
hits AS (
  SELECT p.*, d.decade, d.v, (d.v - pa) / nullif(far - pa, 0) AS share
  FROM prevs p JOIN decades d ON p.far >= d.v AND p.far < d.top WHERE n > 1
  QUALIFY row_number() OVER (PARTITION BY experiment, pos, decade ORDER BY thres) = 1),
groups AS (
  SELECT experiment, pos, max(thres) AS last_thres, count(*) AS c FROM curve GROUP BY ALL),
firsts AS (SELECT experiment, pos, min(decade) AS first FROM hits GROUP BY ALL)
SELECT experiment, pos, decade,
  CASE WHEN pa = v THEN pf ELSE pf + (frr - pf) * share END AS frr,
  CASE WHEN pa = v THEN pa ELSE v END AS far,
  CASE WHEN pa = v THEN pt ELSE 1 - v END AS trr,
  CASE WHEN pa = v THEN pu ELSE pu + (tar - pu) * share END AS tar
FROM hits
UNION ALL
SELECT g.experiment, g.pos, d.decade, NULL, NULL, NULL, NULL
FROM groups g JOIN decades d ON true LEFT JOIN firsts f ON f.experiment = g.experiment AND f.pos = g.pos
WHERE f.first IS NULL OR d.decade < f.first
UNION ALL
SELECT p.experiment, p.pos, 5, p.frr, p.far, p.trr, p.tar
FROM curve p JOIN groups g ON g.experiment = p.experiment AND g.pos = p.pos AND g.last_thres = p.thres
WHERE g.c > 1 AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.experiment = p.experiment AND f.pos = p.pos)"""


ROC_COLUMNS = "SELECT experiment, pos, idx, match, nonmatch, thres, frr, far, trr, tar FROM rates"

QUERIES = {
    "score_rescale": rescale,
    "score_rescale_exact": rescale_exact,
    "roc": roc,
    "roc_strided": roc_strided,
    "roc_points": roc_points,
    "roc_points_few": roc_points_few,
    "eer": eer,
    "operating_points": operating_points,
    "operating_points_few": operating_points_few,
    "score_lines": score_lines,
    "score_roundtrip": score_roundtrip,
    "roc_roundtrip": roc_roundtrip,
    "evaluate_job": evaluate_job,
    "experiment_names": experiment_names,
    "sensor_presets": sensor_presets,
}

ORACLES = {
    "score_rescale": f"WITH {_rescaled_sql()} SELECT * FROM rescaled",
    "score_rescale_exact": f"WITH {_rescaled_sql(True)} SELECT * FROM rescaled",
    "roc": f"WITH {_roc_sql()} {ROC_COLUMNS}",
    "roc_strided": f"WITH {_roc_sql(3)} {ROC_COLUMNS}",
    "roc_points": f"WITH {_roc_sql()} SELECT * FROM points",
    "roc_points_few": f"WITH {_roc_sql(25)} SELECT * FROM points",
    "eer": f"""WITH {_roc_sql()}
SELECT experiment, pos, coalesce(min_by((far - pfar) * ((pfar - pfrr) / (frr - pfrr - far + pfar)) + pfar, idx)
  FILTER (frr < far), 0e0) AS eer FROM looked GROUP BY ALL""",
    "operating_points": _operating_sql(),
    "operating_points_few": _operating_sql(25),
    "score_lines": """WITH rounded AS (
  SELECT event_id, event_type, lpad((user_id % 100000)::VARCHAR, 5, '0') AS s,
    round_even(value / 500, 5) AS hd FROM events)
SELECT event_id, hd, 2e0 AS match_type,
  NULL::DOUBLE AS g_name,
  format('{:>10.5f}', hd) || chr(9) || ' 1' || chr(9) || ' 2' || chr(9) || s || chr(9) || s || chr(9)
    || lpad(event_type, 25, ' ') || chr(9) || lpad(event_id::VARCHAR, 25, ' ') AS line
FROM rounded""",
    "score_roundtrip": f"""WITH {SCORES_SQL}
SELECT experiment, round_even(hd, 5) AS hd, count(*) AS scores FROM scores GROUP BY ALL""",
    "roc_roundtrip": f"""WITH {_roc_sql()},
crossed AS (
  SELECT experiment, coalesce(min_by((far - pfar) * ((pfar - pfrr) / (frr - pfrr - far + pfar)) + pfar, idx)
    FILTER (frr < far), 0e0) AS eer FROM looked GROUP BY experiment)
SELECT experiment, count(*) AS points, max(round_even(thres, 5)) AS last_thres, min(round_even(frr, 5)) AS low_frr,
  max(round_even(far, 5)) AS top_far, round_even(any_value(eer), 5) AS eer
FROM rates JOIN crossed USING (experiment) GROUP BY experiment""",
    "evaluate_job": f"""WITH {_roc_sql()}, kept AS (SELECT experiment, count(*) AS kept FROM points GROUP BY ALL)
SELECT experiment, 2 AS pos, coalesce(min_by((far - pfar) * ((pfar - pfrr) / (frr - pfrr - far + pfar)) + pfar, idx)
  FILTER (frr < far), 0e0) AS eer, count(*) AS points, any_value(kept) AS kept
FROM looked JOIN kept USING (experiment) GROUP BY experiment""",
    "experiment_names": """SELECT event_type,
  'scores_' || min(event_id) || '_' || event_type || '.txt' AS file_name FROM events GROUP BY event_type""",
    "sensor_presets": """WITH presets(code, n_scale, alpha, circle_ratio, closing, opening, scaling) AS (VALUES
  (88, 2.0, 25, 0.90, 2, 3, 0.4), (99, 1.0, 20, 0.65, 0, 3, 0.45), (1, 2.0, 20, 0.92, 2, 3, 0.25),
  (2, 2.0, 30, 0.92, 2, 1, 0.2), (3, 1.0, 20, 0.65, 0, 3, 0.45), (4, 2.0, 38, 0.92, 0, 4, 0.3),
  (5, 2.0, 40, 0.92, 0, 4, 0.2), (6, 2.0, 18, 0.92, 3, 2, 0.2), (7, 2.0, 4, 0.92, 0, 3, 0.4)),
codes AS (
  SELECT CASE WHEN l_tax > 0.07 THEN 88 WHEN l_tax > 0.06 THEN 99 WHEN l_tax < 0.01 THEN 42
              ELSE l_linenumber END AS code FROM lineitem)
SELECT c.code, coalesce(n_scale, 1)::DOUBLE AS n_scale, coalesce(alpha, 20) AS alpha,
  coalesce(circle_ratio, 1)::DOUBLE AS circle_ratio, coalesce(closing, 2) AS closing,
  coalesce(opening, 3) AS opening, coalesce(scaling, 0.4)::DOUBLE AS scaling,
  (42 * coalesce(n_scale, 1))::INTEGER AS pupil_max, (82 * coalesce(n_scale, 1))::INTEGER AS iris_max,
  count(*) AS images
FROM codes c LEFT JOIN presets p ON p.code = c.code GROUP BY ALL""",
}
