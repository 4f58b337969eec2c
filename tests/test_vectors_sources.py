"""Subspaces against NumPy; readers, writers and the template table on files."""

import numpy as np
import pytest
from bioscore.operators import evaluate, subspace, templates
from bioscore.sources import boundaries, lists, presets, scores
from pyspark.sql import functions as F

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def labelled(spark):
    x = RNG.normal(size=(90, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    y = RNG.integers(0, 4, 90)
    x[np.arange(90), y] += 4
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, "vec_id int, label int, v array<double>").repartition(7)


def test_pca(spark, labelled):
    x, _, df = labelled
    model = subspace.pca_fit(df, 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    np.testing.assert_allclose(model.values, values[:3])
    p = subspace.project(df.drop("label"), model)
    back = {r.vec_id: r.v for r in subspace.reconstruct(p, model).collect()}
    want = (x - x.mean(0)) @ model.basis @ model.basis.T + x.mean(0)
    np.testing.assert_allclose([back[i] for i in range(90)], want, atol=1e-9)
    full = subspace.pca_fit(df)
    again = subspace.reconstruct(subspace.project(df.drop("label"), full), full).collect()
    np.testing.assert_allclose([r.v for r in sorted(again, key=lambda r: r.vec_id)], x, atol=1e-9)
    assert model.table(spark).count() == 3


def test_lda(labelled):
    x, y, df = labelled
    model = subspace.lda_fit(df)
    assert model.basis.shape == (6, 3)
    within = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in range(4))
    between = sum(np.outer(d, d) for d in (x[y == c].mean(0) - x.mean(0) for c in range(4)))
    values = np.sort(np.linalg.eigvals(np.linalg.inv(within) @ between).real)[::-1]
    np.testing.assert_allclose(model.values, values[:3], rtol=1e-8)


def test_wide_vectors_without_their_matrix(spark):
    """4,900 pixels: leading values and directions of NumPy, also where a restart is needed."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((260, 4900)) * (1.0 / np.arange(1, 4901)) + rng.standard_normal((260, 1)) * 0.1 + 5
    y = rng.integers(0, 3, 260)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))],
                               "vec_id int, label int, v array<double>").repartition(6).cache()
    _, size, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    values = size ** 2 / 260
    model = subspace.pca_fit_wide(df, 12)
    np.testing.assert_allclose(model.values, values[:12], rtol=1e-8)
    np.testing.assert_allclose(np.abs((model.basis * axes[:12].T).sum(0)), 1, rtol=1e-6)
    np.testing.assert_allclose(model.mean, x.mean(0))
    kept, subspace.KEPT = subspace.KEPT, 2
    try:
        np.testing.assert_allclose(subspace.pca_fit_wide(df, 4).values, values[:4], rtol=1e-8)
    finally:
        subspace.KEPT = kept


def test_wide_fit_of_few_equal_and_no_vectors(spark, labelled):
    x, y, df = labelled
    few = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 2.0, 1.0],)], "v array<double>")
    np.testing.assert_allclose(subspace.pca_fit_wide(few, 3).values, [2.0])
    same = spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>")
    assert len(subspace.pca_fit_wide(same, 2).values) == 0
    with pytest.raises(ValueError):
        subspace.pca_fit_wide(few.limit(0), 2)
    wide, narrow = subspace.lda_fit_wide(df, 6), subspace.lda_fit(df)
    np.testing.assert_allclose(wide.values, narrow.values, rtol=1e-8)


def test_similarity(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(subspace.l2_similarity("a", "b")).collect()] == [2.5, 1e8]


def test_list_file_keeps_line_order(spark, tmp_path):
    names = [f"{i % 7:05d}_{i}.bmp" for i in range(500)]
    paths = [n if i % 3 == 0 else f"/a/b/{n}" if i % 3 == 1 else f"C:\\x\\{n}" for i, n in enumerate(names)]
    (tmp_path / "list.txt").write_text("\n".join(paths) + "\n")
    rows = lists.read_list(spark, str(tmp_path / "list.txt"), "/base/").orderBy("list_pos").collect()
    assert [r.file_name for r in rows] == names
    assert rows[0].full_path == "/base/" + names[0] and rows[1].full_path == paths[1]
    assert rows[9].subject_id == names[9][:5]


def test_score_file(spark, tmp_path):
    lines = ["Title: x", "", scores.SCORE_HEADING, "   0.25000\t 1\t 2\ta\tb\tc\td", "short",
             "   bad\t 1\t 1\ta\tb\tc\td", "  -1.00000\t 2\t 1\ta\tb\tc\td"]
    (tmp_path / "s.txt").write_text("\n".join(lines) + "\n")
    got = scores.read_scores(spark, str(tmp_path / "s.txt")).collect()
    assert sorted(r.hd for r in got) == [-1.0, 0.25]
    kind = scores.read_scores(spark, str(tmp_path / "s.txt"), 1).collect()
    assert sorted(r.hd for r in kind) == [1.0, 2.0]


def test_exported_scores_are_all_read_again(spark, tmp_path):
    df = spark.range(10).select((F.col("id") / 16).alias("hd"), F.lit(1).alias("pos"), F.lit(1).alias("match_type"),
                                *[F.lit("n").alias(c) for c in ("g_subject", "p_subject", "g_name", "p_name")],
                                F.lit("e").alias("experiment")).repartition(3)
    scores.export_scores(df, str(tmp_path / "out"))
    back = scores.read_scores(spark, str(tmp_path / "out" / "experiment=e"))
    assert sorted(r.hd for r in back.collect()) == sorted(round(i / 16 + 1e-12, 5) for i in range(10))
    files = [f.read_text() for f in (tmp_path / "out" / "experiment=e").glob("part-*")]
    assert len(files) == 3 and all(scores.SCORE_HEADING in f for f in files)


def test_roc_file_round_trip(spark, tmp_path):
    rows = [("e", 1, k, float(v)) for k, m in ((1, 0.3), (2, 0.5)) for v in np.clip(RNG.normal(m, 0.1, 80), 0, 1)]
    table = spark.createDataFrame(rows, "experiment string, pos int, match_type int, hd double")
    roc = evaluate.roc(table).orderBy("idx").collect()
    body = [r[0] for r in spark.createDataFrame(roc).orderBy("idx").select(scores.roc_line()).collect()]
    trailer = "0.10000" + "\t-999.00" * 6 + "\tEER"
    (tmp_path / "r.txt").write_text("\n".join(["a", "b", scores.ROC_HEADING, *body, trailer]) + "\n")
    back = scores.read_rates(spark, str(tmp_path / "r.txt")).orderBy("thres", "match", "tar").collect()
    assert [r.eer for r in scores.read_eer(spark, str(tmp_path / "r.txt")).collect()] == [0.1]
    np.testing.assert_allclose([(r.frr, r.far, r.trr, r.tar) for r in back],
                               [(r.frr, r.far, r.trr, r.tar) for r in roc], atol=5.1e-6)


def test_score_tables(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 1, 1, "s", "t", "g", "p", "e")],
                               "hd double, pos int, match_type int, g_subject string, p_subject string, "
                               "g_name string, p_name string, experiment string")
    scores.write_scores(df, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).where("pos = 1 and match_type = 1").count() == 1
    scores.export_scores(df, str(tmp_path / "text"))
    line = spark.read.text(str(tmp_path / "text")).where("value like '%0.50000%'").first()["value"]
    assert line.split("\t")[0] == "   0.50000" and len(line.split("\t")) == 7


def test_half_even_digits(spark):
    df = spark.createDataFrame([(0.015625,), (0.046875,), (1 / 3,)], "hd double")
    assert [r[0].strip() for r in df.select(scores.five_digits("hd")).collect()] == ["0.01562", "0.04688", "0.33333"]


def test_boundary_files(spark, tmp_path):
    marks = "".join(f"{100 + i} {200 - i} {'-' if i == 3 else '+'}\n" for i in range(8))
    text = ("points formatted x y [+|-]\n- denotes occluder, + denotes true boundary\n"
            f"pupil-iris boundary: 8 points clockwise from north\n{marks}"
            f"iris-sclera boundary: 8 points clockwise from north\n{marks}")
    (tmp_path / "eye1.gnd").write_text(text)
    (tmp_path / "eye2.gnd").write_text("nothing here")
    points = boundaries.parse_points(boundaries.read_files(spark, str(tmp_path))).collect()
    assert len(points) == 16 and {p.image_id for p in points} == {"eye1"}
    assert [(p.x, p.y) for p in points if p.ring == "iris" and not p.valid] == [(103, 197)]
    circles = spark.createDataFrame([("a", "1 2 3\n4 5 6\n"), ("b", "1 2")], "image_id string, text string")
    assert [tuple(r) for r in boundaries.parse_circles(circles).collect()] == [("a", 1, 2, 3, 4, 5, 6)]


def test_raster_source(spark, tmp_path):
    spark.createDataFrame([(1, 3, list(range(6)))], "image_id int, w int, pixels array<int>").write.parquet(
        str(tmp_path / "images"))
    rows = {(r.y, r.x): r.v for r in boundaries.read_raster(spark, str(tmp_path / "images")).collect()}
    assert rows == {(y, x): 3 * y + x for y in range(2) for x in range(3)}


def test_unknown_sensor_keeps_defaults(spark):
    row = presets.lookup_presets(spark.createDataFrame([(12345,)], "code int")).first()
    assert tuple(row[n] for n in presets.NAMES) == presets.DEFAULTS and row.pupil_max == 42


def test_enroll_builds_only_what_is_missing(spark, tmp_path):
    path, built = str(tmp_path / "templates"), []

    def make(images):
        built.append(images.count())
        return images.withColumn("code", F.array(F.lit(1)))

    first = spark.range(5).select(F.col("id").alias("image_id"), F.lit(1).alias("data_type"))
    more = spark.range(8).select(F.col("id").alias("image_id"), F.lit(1).alias("data_type"))
    templates.enroll(spark, first, path, make)
    templates.enroll(spark, more, path, make)
    assert built == [5, 3] and templates.read_templates(spark, path).count() == 8
    other = more.withColumn("data_type", F.lit(2))
    assert templates.missing_templates(other, templates.read_templates(spark, path)).count() == 8


def test_enrolment_survives_a_lost_job_and_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "templates")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("image_id"), F.lit(1).alias("data_type"))
    made = lambda mark: lambda images: images.withColumn("code", F.lit(mark))
    assert templates.read_templates(spark, path) is None

    publish = templates.publish
    monkeypatch.setattr(templates, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):                        # dies between stage and publish
        templates.enroll(spark, rows(0, 5), path, made("a"), "batch-1")
    assert templates.read_templates(spark, path) is None
    monkeypatch.setattr(templates, "publish", publish)
    assert templates.enroll(spark, rows(0, 5), path, made("b"), "batch-1")
    assert not templates.enroll(spark, rows(0, 5), path, made("c"), "batch-1")
    assert {r.code for r in templates.read_templates(spark, path).collect()} == {"b"}

    both = [templates.stage(made(m)(rows(3, 9)), path, f"batch-{m}") for m in "xy"]    # at the same time
    assert all([publish(spark, path, f"batch-{m}", folder) for m, folder in zip("xy", both)])
    assert not publish(spark, path, "batch-x", templates.stage(made("z")(rows(3, 9)), path, "batch-x"))
    got = {r.image_id: r.code for r in templates.read_templates(spark, path).collect()}
    assert got == {i: "b" if i < 5 else "x" for i in range(9)}
    assert templates.read_templates(spark, path).count() == 9

    empty = tmp_path / "templates" / "manifest" / "batch-2"  # dies while it writes the manifest
    empty.touch()
    assert templates.read_templates(spark, path).count() == 9
    assert templates.enroll(spark, rows(0, 12), path, made("d"), "batch-2")
    assert templates.read_templates(spark, path).count() == 12
    assert templates.remove_unpublished(spark, path, -1000) == 1
    assert templates.read_templates(spark, path).count() == 12


def test_wide_vectors_come_in_modest_batches(spark):
    """A batch of 10,000 wide vectors would be copied several times in each Python process."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        rows = np.random.default_rng(3).normal(size=(20, 2048))
        df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>")
        values = subspace.pca_fit_wide(df, 3).values
        assert int(spark.conf.get(key)) * 2048 * 8 <= 1 << 22
        np.testing.assert_allclose(values, np.linalg.svd(rows - rows.mean(0))[1][:3] ** 2 / 20, rtol=1e-8)
    finally:
        spark.conf.set(key, before)
