"""End-to-end jobs: automatic template building and evaluation of score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.presets import IRIS_MAX, PUPIL_MAX, lookup_presets
from ..sources.scores import read_scores
from . import encode, evaluate, geometry, masks, votes
from .build import build_templates
from .common import attach
from .hamming import TEMPLATE_COLUMNS, compare
from .pairs import IMPOSTOR_PROBES, genuine_pairs, impostor_pairs
from .raster import circle_region, image_sizes


def sensor_parameters(images: DataFrame, n_scale: float = 1.0, ratio: float = 1.0,
                      scaling: float = 0.4) -> DataFrame:
    """One row of search parameters per image: from its sensor code, or the same for all.

    `images` with a column `code` get the presets of their sensor (unknown codes the defaults).
    """
    if "code" in images.columns:
        found = lookup_presets(images.select("image_id", "code").distinct())
        return found.select("image_id", "code", "n_scale", "circle_ratio", "scaling", "pupil_max", "iris_max")
    return images.select("image_id").distinct().select(
        "image_id", F.lit(None).cast("int").alias("code"), F.lit(float(n_scale)).alias("n_scale"),
        F.lit(float(ratio)).alias("circle_ratio"), F.lit(float(scaling)).alias("scaling"),
        F.lit(int(PUPIL_MAX * n_scale)).alias("pupil_max"), F.lit(int(IRIS_MAX * n_scale)).alias("iris_max"))


def locate_eyes(raster: DataFrame, candidates: DataFrame, parameters: DataFrame | None = None,
                high: float = 0.19, low: float = 0.11, **common) -> DataFrame:
    """Pupil from the contour candidates, iris by circle search around it.

    Gives (image_id, xp, yp, rp, xi, yi, ri) for every image. `parameters` are the rows of
    `sensor_parameters`, one per image: roundness, radii and scaling travel as columns
    through the sweep, the resizing and the votes, so one plan serves all sensors. Without
    them `common` holds n_scale, ratio and scaling of all images. `high` and `low` are the
    edge thresholds.
    """
    sizes = image_sizes(raster)
    if parameters is None:
        parameters = sensor_parameters(sizes, **common)
    none = F.lit(None).cast("int")
    swept = geometry.sweep_candidates(
        candidates.join(parameters.select(
            "image_id", "n_scale", "pupil_max",
            geometry.ratio_steps(F.col("circle_ratio")).alias("steps")), "image_id"),
        F.col("steps"), F.col("pupil_max"), F.col("n_scale"))
    found = (sizes.join(parameters.select("image_id", "scaling", "pupil_max", "iris_max"), "image_id")
             .join(swept.select("image_id", "xp", "yp", "rp"), "image_id", "left")
             .withColumn("max_r", F.col("pupil_max")).withColumn("last_x", none)
             .withColumn("last_y", none).withColumn("last_r", none))
    pupils = geometry.pupil_fallback(found).drop("max_r")
    top = F.col("iris_max")
    regions = circle_region(pupils, top, top)
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    cut = (attach(raster.select("image_id", "y", "x", "v"),
                  regions.select("image_id", "h", "x0", "y0", "wd", "ht"))
           .where((x >= 0) & (y >= 0) & (x < F.col("wd")) & (y < F.col("ht")))
           .select("image_id", y.alias("y"), x.alias("x"), "v"))
    lowest = F.least(F.col("rp") + F.floor(F.col("rp") / 4), top).cast("int")
    limits = regions.select("image_id", lowest.alias("r_low"), top.alias("r_high"), "scaling")
    iris = votes.find_circle(cut, limits, None, high, low, 1.0, 0.0)
    placed = (regions.join(iris, "image_id")
              .select("image_id", "xp", "yp", "rp", "px", "py", F.col("wd").alias("w"),
                      F.col("ht").alias("h"), F.col("col").alias("xi"), F.col("row").alias("yi"),
                      F.col("r").alias("ri"), top.alias("max_r"),
                      F.floor(top / 4).cast("int").alias("allowed")))
    return (geometry.reconcile_centre(geometry.iris_fallback(placed))
            .select("image_id", *[F.col(c).cast("int").alias(c)
                                  for c in ("xp", "yp", "rp", "xi", "yi", "ri")]))


def extract_eyes(raster: DataFrame, candidates: DataFrame, width: int, max_r: int = IRIS_MAX,
                 ratio: float = 1.0, pupil_max: int = PUPIL_MAX, n_scale: float = 1.0) -> DataFrame:
    """Two level eye images (image_id, side, y, x, v) from pictures that show both eyes.

    Contour candidates of pictures of one `width` are dealt to the two sides, the pupil of each
    side is found by the threshold sweep under the key (image, side), and both eyes are cut
    from the turned picture. Pictures in which a side has no pupil give no eyes.
    """
    child = (geometry.split_two_eyes(candidates, width)
             .withColumn("image_id", F.struct("image_id", "side")).drop("side"))
    swept = geometry.sweep_candidates(child, geometry.ratio_steps(F.lit(float(ratio))),
                                      F.lit(int(pupil_max * n_scale)), F.lit(float(n_scale)))
    sided = swept.select("image_id.image_id", "image_id.side", "xp", "yp", "rp")
    whole = geometry.join_two_eyes(sided, width)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    pupils = (whole.groupBy("image_id").agg(
        of("right", "xp").alias("x1"), of("right", "yp").alias("y1"),
        of("left", "xp").alias("x2"), of("left", "yp").alias("y2"))
        .where(F.col("x1").isNotNull() & F.col("x2").isNotNull()))
    return geometry.eye_rasters(raster, pupils, int(max_r * n_scale))


def build_automatic(raster: DataFrame, candidates: DataFrame, images: DataFrame | None = None,
                    n_scale: float = 1.0, ratio: float = 1.0, scaling: float = 0.4,
                    search: dict | None = None, lines: dict | None = None, **options) -> DataFrame:
    """Templates from images and contour candidates, without given boundaries.

    `images` (image_id, code) names the sensor of each image: its presets are used, and the
    code becomes the data type of the template, so another sensor gets another template.
    Without it the scalar parameters hold for all images. `search` goes to `locate_eyes`,
    `lines` to the eyelid search.
    """
    common = {"n_scale": n_scale, "ratio": ratio, "scaling": scaling}
    parameters = None if images is None else sensor_parameters(images)
    circles = locate_eyes(raster, candidates, parameters, **(search or {}),
                          **({} if parameters is not None else common))
    if parameters is not None:
        kinds = parameters.select("image_id", F.coalesce("code", F.lit(0)).alias("data_type"))
        circles = circles.join(kinds, "image_id")
    circles = circles.checkpoint()
    anchors = masks.eyelid_anchors(votes.eyelid_search(raster, circles, **(lines or {}))).checkpoint()
    top, bottom = (masks.eyelid_curve(masks.one_lid(anchors, lid)) for lid in ("t", "b"))
    marked = masks.eyelid_noise(raster, top, bottom)
    bright = (F.col("v") < 3) | (F.col("v") > 250)
    return build_templates(marked.withColumn("noise", F.col("noise") | bright), circles, **options)


#: Boundary sources: searched in the image, marked points, given circles.
SEARCHED, POINTS, GIVEN = 1, 2, 3
#: Order in which the sources are tried for an image that names none.
PRECEDENCE = (POINTS, GIVEN, SEARCHED)


def choose_circles(raster: DataFrame, images: DataFrame, points: DataFrame, given: DataFrame,
                   iris: dict = votes.IRIS_SEARCH,
                   pupil: dict = votes.PUPIL_SEARCH) -> tuple[DataFrame, DataFrame]:
    """Circles of each image from its own boundary source, and the images that get none.

    `images` has (image_id, mode): 1 searches the image, 2 takes the marked `points`, 3 the
    `given` circles; NULL takes the first of points, given circles and search that the image
    has. Only images routed to the search are searched. Gives (image_id, mode, xp, yp, rp,
    xi, yi, ri) and (image_id, mode, reason).
    """
    columns = ["image_id", "mode", "xp", "yp", "rp", "xi", "yi", "ri"]
    tagged = lambda df, mode: df.withColumn("mode", F.lit(mode)).select(columns)
    marked = tagged(geometry.circles_from_points(points), POINTS).where(
        F.col("ri").isNotNull() & F.col("rp").isNotNull())
    known = marked.unionByName(tagged(given, GIVEN))
    have = known.groupBy("image_id").agg(F.collect_set("mode").alias("have"))
    wanted = (images.select("image_id", "mode").distinct().join(have, "image_id", "left")
              .join(raster.select("image_id", F.lit(True).alias("seen")).distinct(), "image_id", "left"))
    route = F.col("mode")
    for mode in PRECEDENCE[:-1]:
        route = F.coalesce(route, F.when(F.array_contains("have", mode), mode))
    routed = wanted.select("image_id", "seen", F.coalesce(route, F.lit(PRECEDENCE[-1])).alias("mode")).checkpoint()
    search = routed.where((F.col("mode") == SEARCHED) & F.col("seen"))
    found = votes.segment_circles(raster.join(search.select("image_id"), "image_id", "left_semi"), iris, pupil)
    sources = known.unionByName(tagged(found, SEARCHED))
    chosen = routed.join(sources, ["image_id", "mode"], "left")
    reason = (F.when(F.col("seen").isNull(), "no image")
              .when(~F.col("mode").isin(SEARCHED, POINTS, GIVEN), "unknown mode")
              .when(F.col("rp").isNull(), "no boundary"))
    chosen = chosen.withColumn("reason", reason).checkpoint()
    return (chosen.where("reason IS NULL").select(columns),
            chosen.where("reason IS NOT NULL").select("image_id", "mode", "reason"))


def build_chosen(raster: DataFrame, images: DataFrame, points: DataFrame, given: DataFrame,
                 iris: dict = votes.IRIS_SEARCH, pupil: dict = votes.PUPIL_SEARCH,
                 lines: dict | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Templates with the boundary source of each image, and the images without a template.

    Beside the mode `images` may switch masks row by row: `eyelids` (boolean; searched and
    given circles look for straight eyelids, marked points hide what lies behind occluded
    ones) and `highlight` (brightest usable value, NULL for no limit). Without these
    columns both are off. All masks of an image travel as one row of figures.
    """
    circles, dropped = choose_circles(raster, images, points, given, iris, pupil)
    for name, kind in (("eyelids", "boolean"), ("highlight", "int")):
        if name not in images.columns:
            images = images.withColumn(name, F.lit(None).cast(kind))
    switches = circles.join(images.select("image_id", "eyelids", "highlight").distinct(), "image_id")
    lidded = switches.where("eyelids")
    straight = lidded.where(F.col("mode") != POINTS).drop("mode", "eyelids", "highlight")
    lids = votes.straight_eyelids(raster.join(straight.select("image_id"), "image_id", "left_semi"),
                                  straight, **(lines or {}))
    behind = lidded.where(F.col("mode") == POINTS).select("image_id")
    hidden = masks.occlusion_lines(points.join(behind, "image_id", "left_semi"), switches)
    figures = (switches.select("image_id", "highlight").join(lids, "image_id", "left")
               .join(hidden, "image_id", "left"))
    marked = attach(raster.select("image_id", "y", "x", "v"), figures)
    noise = (votes.under_eyelid() | F.coalesce(masks.behind_line(), F.lit(False))
             | F.coalesce(F.col("v") > F.col("highlight"), F.lit(False)))
    marked = marked.select("image_id", "y", "x", "v", noise.alias("noise"))
    return build_templates(marked, circles.drop("mode"), **{**encode.BASE, "ranked": False, **options}), dropped


def list_templates(images: DataFrame, templates: DataFrame, image_id: Column,
                   data_type: int | None = None) -> DataFrame:
    """Templates by list position; `image_id` computes the template key from a list row."""
    if data_type is not None:
        templates = templates.where(F.col("data_type") == data_type)
    wide = templates.select(F.col("image_id").alias("_key"), *TEMPLATE_COLUMNS)
    return (images.select("list_pos", image_id.alias("_key")).join(wide, "_key")
            .select("list_pos", *TEMPLATE_COLUMNS))


def score_table(gallery: DataFrame, templates: DataFrame, image_id: Column,
                probe: DataFrame | None = None, experiment: str = "", pos: int = 1,
                data_types: tuple[int | None, int | None] = (None, None), seed: int = 0,
                n: int = IMPOSTOR_PROBES, names: bool = True, **comparison) -> DataFrame:
    """Score table of one experiment and eye, from image lists and templates.

    Genuine pairs (match_type 1) and sampled impostor pairs (2): (experiment, pos, match_type,
    hd, list positions, subjects and names of both sides). `data_types` picks the templates of
    gallery and probe; a pair without a template keeps a NULL score. `names` may be left out.
    """
    wide = [list_templates(images, templates, image_id, kind)
            for images, kind in zip((gallery, gallery if probe is None else probe), data_types)]
    same = probe is None and data_types[0] == data_types[1]
    given = {"features": wide[0], "probe_features": None if same else wide[1]}
    named = [f"{s}_{c}" for s in ("g", "p") for c in (("list_pos", "file_name") if names else ("list_pos",))]
    genuine = compare(genuine_pairs(gallery, probe, cells=True, **given), keep=["subject_id", *named],
                      **comparison).select(
        F.lit(evaluate.MATCH).alias("match_type"), "hd", F.col("subject_id").alias("g_subject"),
        F.col("subject_id").alias("p_subject"), *named)
    impostor = compare(impostor_pairs(gallery, probe, seed, n, **given), keep=["g_subject", "p_subject", *named],
                       **comparison).select(
        F.lit(evaluate.NONMATCH).alias("match_type"), "hd", "g_subject", "p_subject", *named)
    return genuine.unionByName(impostor).select(
        F.lit(experiment).alias("experiment"), F.lit(pos).alias("pos"), "*")


def evaluate_files(spark: SparkSession, match_path: str, nonmatch_path: str, number: int = -1,
                   experiment: str | Column = "", pos: int | Column = 1) -> dict[str, DataFrame]:
    """ROC, reported points, EER and operating points of two score files or folders.

    `experiment` and `pos` are names, or expressions over the column `file`: then all
    experiments of a folder are evaluated in one job. The files are read once; the scores are
    written to a checkpoint that the four results read.
    """
    tag = lambda given: given if isinstance(given, Column) else F.lit(given)

    def side(path: str, kind: int) -> DataFrame:
        return read_scores(spark, path, number).select(
            tag(experiment).alias("experiment"), tag(pos).alias("pos"),
            F.lit(kind).alias("match_type"), "hd")

    scores = side(match_path, evaluate.MATCH).unionByName(side(nonmatch_path, evaluate.NONMATCH))
    scores = scores.checkpoint()
    return {"roc": evaluate.roc(scores), "points": evaluate.roc_points(scores),
            "eer": evaluate.eer(scores),
            "operating": evaluate.operating_points(evaluate.rates(scores))}


def write_evaluation(results: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per result, partitioned by experiment and eye.

    A rerun replaces the partitions it holds and leaves the others.
    """
    for name, df in results.items():
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("experiment", "pos").parquet(f"{path}/{name}"))
