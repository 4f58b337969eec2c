"""Image operators on small synthetic eyes, against direct NumPy forms."""

import direct
import numpy as np
import pytest
from bioscore.operators import build, encode, faces, geometry, jobs, masks, polar, raster, votes
from bioscore.operators.common import neighbourhood
from pyspark.sql import functions as F

RNG = np.random.default_rng(11)


def to_raster(spark, images):
    rows = [(k, y, x, float(v)) for k, im in images.items() for (y, x), v in np.ndenumerate(im)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, v double")


def to_array(df, value="v"):
    pdf = df.toPandas()
    out = np.full((pdf.y.max() + 1, pdf.x.max() + 1), np.nan)
    out[pdf.y, pdf.x] = pdf[value].astype(float)
    return out


def eye(h=120, w=130, cx=62, cy=58, pupil=14, iris=34, seed=0):
    y, x = np.mgrid[:h, :w]
    d = np.hypot(x - cx, y - cy)
    im = np.where(d < pupil, 20, np.where(d < iris, 110, 210)).astype(float)
    return np.clip(im + np.random.default_rng(seed).normal(0, 2, im.shape), 0, 255).round()


def test_neighbourhood_crosses_strips(spark):
    im = RNG.integers(0, 256, (37, 9))
    r = to_raster(spark, {1: im})
    near = neighbourhood(r, "v", 1, 2, strip=5).orderBy("y", "x").collect()
    padded = np.pad(im.astype(float), ((2, 2), (1, 1)), constant_values=np.nan)
    for row in near:
        want = padded[row.y: row.y + 5, row.x: row.x + 3].ravel()
        got = np.array([np.nan if v is None else v for v in row.nb])
        np.testing.assert_array_equal(got, want)
    assert len(near) == im.size


def test_gaussian_equals_direct(spark):
    im = RNG.integers(0, 256, (30, 41))
    got = to_array(raster.gaussian_smooth(to_raster(spark, {1: im}), 2.0))
    np.testing.assert_allclose(got, direct.smooth(im, 2.0), atol=1e-9)


@pytest.mark.parametrize("scaling", [0.25, 0.3, 0.4, 0.6, 0.8, 1.0])
def test_decimate_equals_stepping(spark, scaling):
    im = RNG.integers(0, 256, (53, 44))
    got = to_array(raster.decimate(to_raster(spark, {1: im}), scaling))
    np.testing.assert_array_equal(got, direct.shrink(im, scaling))


def test_glcm_sums_to_one(spark):
    im = RNG.integers(0, 9, (12, 10))
    total = raster.glcm(to_raster(spark, {1: im, 2: im.T})).groupBy("image_id", "angle").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
    assert len(total) == 8 and all(abs(r.p - 1) < 1e-12 for r in total)


@pytest.mark.parametrize("high,low", [(0.7, 0.3), (0.95, 0.5), (0.99, 0.45)])
def test_regions_cross_tiles(spark, high, low):
    im = RNG.random((150, 140))
    r = to_raster(spark, {1: im, 2: im[::-1]})
    grown = votes.grow_regions(r, high, low).toPandas()
    for k, source in ((1, im), (2, im[::-1])):
        want = {tuple(p) for p in np.argwhere(direct.grow(source, high, low))}
        part = grown[grown.image_id == k]
        assert len(part) == len(want) and set(zip(part.y, part.x)) == want


def test_region_walks_along_a_spiral(spark):
    """One weak path with a single seed, through many tiles."""
    im = np.zeros((100, 100))
    for k in range(4, 96, 12):
        im[k, 4:96] = 0.4
        im[k: k + 13, 95 if (k // 12) % 2 else 4] = 0.4
    im[4, 95] = 0.9
    r = to_raster(spark, {1: im})
    grown = votes.grow_regions(r, 0.8, 0.3)
    assert grown.count() == direct.grow(im, 0.8, 0.3).sum()


SEARCH = {"scaling": 0.5, "high": 0.30, "low": 0.20, "vert": 1.0, "horz": 0.0}


def test_circle_search_equals_direct(spark):
    images = {1: eye(), 2: eye(110, 118, 70, 50, 12, 30, seed=4)}
    r = to_raster(spark, images)
    limits = raster.image_sizes(r).select("image_id", F.lit(24).alias("r_low"), F.lit(40).alias("r_high"))
    found = {c.image_id: (c["row"], c["col"], c["r"]) for c in
             votes.find_circle(r, limits, **SEARCH).collect()}
    for k, im in images.items():
        assert found[k] == direct.circle(im, 24, 40, *SEARCH.values())
    row, col, radius = found[1]
    assert abs(row - 59) <= 3 and abs(col - 63) <= 3 and abs(radius - 34) <= 3


def test_line_search_finds_an_edge(spark):
    y, x = np.mgrid[:60, :80]
    im = np.where(y > 25 + 0.1 * x, 200.0, 40.0)
    r = to_raster(spark, {5: im, 6: np.full((60, 80), 90.0)})
    line = votes.find_lines(r).where("n = 0").collect()
    by_image = {row.image_id: row for row in line}
    extents = votes.line_extents(votes.find_lines(r), raster.image_sizes(r).select(
        "image_id", F.lit(0).alias("ox"), F.lit(100).alias("oy"))).collect()
    spans = {e.image_id: (e.low, e.high) for e in extents}
    assert 5 in by_image
    low, high = spans[5]
    assert abs(low - 126) <= 4 and abs(high - 133) <= 5


def test_two_stage_segmentation(spark):
    im = eye(150, 160, 80, 75, 16, 44)
    im[:44] = 150                                            # a straight upper eyelid
    r = to_raster(spark, {1: im, 2: eye(140, 150, 75, 70, 15, 42, seed=3)})
    iris = {"r_low": 36, "r_high": 50, "scaling": 0.4, "high": 0.3, "low": 0.2, "vert": 1.0, "horz": 0.0}
    pupil = {"r_low": 10, "r_high": 24, "scaling": 0.6, "high": 0.3, "low": 0.25, "vert": 1.0, "horz": 1.0}
    circles, noisy = votes.segment(r, iris, pupil, highlight=240)
    rows = {c.image_id: c for c in circles.collect()}
    for k, (cx, cy, rp, ri) in {1: (80, 75, 16, 44), 2: (75, 70, 15, 42)}.items():
        c = rows[k]
        assert abs(c.xp - cx) <= 4 and abs(c.yp - cy) <= 4 and abs(c.rp - rp) <= 4
        assert abs(c.xi - cx) <= 4 and abs(c.yi - cy) <= 4 and abs(c.ri - ri) <= 4
    assert noisy.count() == im.size + 140 * 150
    template = build.build_from_circles(noisy.where("image_id = 1"), circles, highlight=None).collect()
    assert len(template) == 1 and len(template[0].code) == 150


def test_eyelid_search_gives_anchors(spark):
    im = eye(150, 160, 80, 75, 16, 44)
    im[:45] = 60
    r = to_raster(spark, {1: im})
    circles = spark.createDataFrame([(1, 80, 75, 16, 80, 75, 44)],
                                    "image_id int, xp int, yp int, rp int, xi int, yi int, ri int")
    for curved in (True, False):
        a = masks.eyelid_anchors(votes.eyelid_search(r, circles, curved), curved).collect()[0]
        assert a.x0 < a.x1 < a.x2 and a.t0 < a.b0
        assert 40 <= a.t1 <= 52


def direct_band(im, c, radial, angular):
    ox, oy = c["xp"] - c["xi"], c["yp"] - c["yi"]
    sgn = 1 if ox > 0 or (ox == 0 and oy > 0) else -1
    phi = np.pi / 2 if ox == 0 else np.arctan(oy / ox)
    out = np.full((radial, angular), np.nan)
    for i in range(angular):
        t = 2 * np.pi * i / (angular - 1)
        b = sgn * np.cos(np.pi - phi - t)
        a = ox * ox + oy * oy
        reach = np.sqrt(a) * b + np.sqrt(a * b * b - (a - c["ri"] ** 2)) - c["rp"]
        for j in range(1, radial + 1):
            rho = reach * j / (radial + 1) + c["rp"]
            x, y = rho * np.cos(t) + c["xp"], -rho * np.sin(t) + c["yp"]
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            if x0 < 1 or y0 < 1 or x0 >= im.shape[1] or y0 >= im.shape[0]:
                continue
            s, u = x - x0, y - y0
            p = im[y0 - 1: y0 + 1, x0 - 1: x0 + 1]
            out[j - 1, i] = ((1 - u) * ((1 - s) * p[0, 0] + s * p[0, 1])
                             + u * ((1 - s) * p[1, 0] + s * p[1, 1])) / 255
    return out


def test_full_size_template_equals_direct(spark):
    im = eye(130, 140, 70, 62, 15, 40) + RNG.integers(-15, 15, (130, 140))
    im = np.clip(im, 4, 249)
    im[:30] = 0                                              # unusable pixels
    c = {"xp": 70, "yp": 62, "rp": 15, "xi": 72, "yi": 61, "ri": 60}
    circles = spark.createDataFrame([(1, *c.values())], "image_id int, xp int, yp int, rp int, xi int, yi int, ri int")
    r = to_raster(spark, {1: im})
    t = build.build_templates(r, circles).collect()[0]
    assert (t.n_rad, t.n_ang, len(t.code)) == (34, 520, 277)
    usable = np.where(im < 1, np.nan, im)
    band = direct_band(usable, c, 34, 260)
    noise = np.isnan(band)
    assert 0 < noise.sum() < noise.size
    filled = np.where(noise, np.where(noise, 0.5, band).mean(), band)
    freq = np.arange(131) / 130 / 2
    gain = np.zeros(260)
    gain[1:131] = np.exp(-np.log(freq[1:] * 18) ** 2 / (2 * np.log(0.55) ** 2))
    response = np.fft.ifft(np.fft.fft(filled, axis=1) * gain, axis=1)
    mag = np.sort(np.abs(response).ravel())
    low, high = mag[176 - 1], mag[7514 - 1]
    bad = noise | (np.abs(response) < low - 1e-11) | (np.abs(response) > high + 1e-11)
    words = lambda a: np.unpackbits(np.array(a, np.int64).view(np.uint8), bitorder="little")[:17680]
    code, mask = words(t.code).reshape(34, 260, 2), words(t.mask).reshape(34, 260, 2)
    sure = ~bad
    np.testing.assert_array_equal(code[..., 0][sure], (response.real > 0)[sure])
    np.testing.assert_array_equal(code[..., 1][sure], (response.imag > 0)[sure])
    assert (mask[..., 0] == mask[..., 1]).all()
    assert (mask[..., 0].astype(bool) != bad).sum() <= 2
    grid = polar.polar_grid(circles, 34, 260).toPandas()
    assert len(grid) == 34 * 260


def test_filter_matrix_is_the_transform(spark):
    for n in (16, 17, 260):
        x = RNG.random((3, n))
        half = n // 2
        gain = np.zeros(n)
        gain[1: half + 1] = np.exp(-np.log(np.arange(1, half + 1) / half / 2 * 18) ** 2
                                   / (2 * np.log(0.5) ** 2))
        want = np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)
        np.testing.assert_allclose(x @ encode.filter_matrix(n, 18, 0.5), want, atol=1e-12)


def test_normalised_faces(spark):
    """Both eyes of a tilted face land on their places; a one-eyed face is dropped."""
    h = w = 80
    im = np.full((h, w), 150.0)
    im[28:34, 20:26] = 30                                    # left eye
    im[36:42, 52:58] = 30                                    # right eye
    r = to_raster(spark, {1: im, 2: im})
    sizes = raster.image_sizes(r)
    # detections are relative to the search windows at (13, 21) and (43, 21)
    det = spark.createDataFrame([(1, "left", 7, 7, 6, 6), (1, "right", 9, 15, 6, 6), (2, "left", 7, 7, 6, 6)],
                                "image_id int, side string, x int, y int, w int, h int")
    eyes = geometry.eye_centres(sizes, det, det).collect()
    assert [(e.image_id, e.lx, e.ly, e.rx, e.ry) for e in eyes] == [(1, 23, 31, 55, 39)]
    out = faces.normalise_faces(r, sizes, det, det.limit(0), width=50)
    assert out.select("image_id").distinct().count() == 1
    warped = to_array(geometry.affine_resample(r, geometry.eye_alignment_map(
        geometry.eye_centres(sizes, det, det), 50), replicate=False))
    assert warped.shape == (50, 50)
    for x in (8, 42):                                        # 0.16 and 0.84 of the width
        assert warped[7, x] < 40
    face = to_array(out)
    assert face[49, 0] == 128 and face[7, 8] < 60


def spiral(n):
    """A path one pixel wide that winds inwards, with its seed at the inner end."""
    im = np.zeros((n, n))
    y, x, dy, dx = 2, 2, 0, 1
    im[y, x] = 0.5
    free = lambda a, b: 2 <= a < n - 2 and 2 <= b < n - 2 and not im[a, b]
    while True:
        for _ in range(2):
            a, b = y + dy, x + dx
            if free(a, b) and not (0 <= a + dy < n and 0 <= b + dx < n and im[a + dy, b + dx]):
                break
            dy, dx = dx, -dy
        else:
            im[y, x] = 1.0
            return im
        y, x = a, b
        im[y, x] = 0.5


def test_spiral_over_many_tiles_settles_in_few_rounds(spark, monkeypatch):
    """The path crosses tile borders some eighty times; a walk would need a round for each."""
    monkeypatch.setattr(votes, "REGION_TILE", 8)
    im, rounds = spiral(56), []
    grown = votes.grow_regions(to_raster(spark, {1: im}), 0.8, 0.3, rounds)
    assert grown.count() == direct.grow(im, 0.8, 0.3).sum() == (im > 0).sum() > 400
    assert len(rounds) <= 9


def test_components_equal_union(spark):
    from bioscore.operators.components import components
    rng = np.random.default_rng(5)
    edges = [(k, int(a), int(b)) for k in (1, 2) for a, b in rng.integers(0, 300, (220, 2))]
    edges += [(3, 0, i) for i in range(1, 400)] + [(4, i, i + 1) for i in range(100)] + [(4, 7, 7)]
    rows = components(spark.createDataFrame(edges, "k int, u long, v long"), ["k"]).collect()
    root = {}

    def top(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n
    for k, a, b in edges:
        low, high = sorted((top((k, a)), top((k, b))))
        root[high] = low
    joined = {n for k, a, b in edges if a != b for n in ((k, a), (k, b))}
    assert {(r.k, r.node): r.root for r in rows} == {n: top(n)[1] for n in joined} and len(rows) == len(joined)


def test_votes_over_tiles_equal_direct(spark):
    rng = np.random.default_rng(2)
    spots = [(int(y), int(x)) for y, x in rng.integers(0, (150, 140), (60, 2))]
    edges = spark.createDataFrame([(1, y, x, 140, 150) for y, x in spots], "image_id int, y int, x int, w int, h int")
    radii = spark.createDataFrame([(1, 20, 3), (2, 1, 1)], "image_id int, base int, planes int")
    want = {}
    for p in range(3):
        for y, x in spots:
            for dy, dx in direct.digital_circle(21 + p):
                if 0 <= y + dy < 150 and 0 <= x + dx < 140:
                    want[p, y + dy, x + dx] = want.get((p, y + dy, x + dx), 0) + 1
    got = votes.circle_votes(edges, radii)
    assert {(r.plane, r.y, r.x): r.votes for r in got.collect()} == want
    best = votes.best_circle(votes.circle_votes(edges, radii, best=True)).first()
    assert tuple(best) == tuple(votes.best_circle(got).first())


def test_two_eyes_from_pixels(spark):
    """Split, pupil per side, rotation and cuts against turning the whole picture in NumPy."""
    picture = np.random.default_rng(2).integers(0, 256, (48, 100))
    raster = spark.createDataFrame([(i, y, x, int(picture[y, x])) for i in (1, 2, 3) for y in range(48) for x in range(100)],
                                   "image_id long, y int, x int, v int").repartition(5)
    spot = lambda i, cx, cy: (i, 1, 30, 30, 0, 100, cx, cy, 10, 10)
    columns = "image_id long, pass int, start int, threshold int, ord int, count int, cx int, cy int, w int, h int"
    candidates = spark.createDataFrame([spot(1, 20, 18), spot(1, 82, 26), spot(2, 20, 18), spot(3, 82, 26)], columns)
    cut = jobs.extract_eyes(raster, candidates, 100, max_r=10, pupil_max=20)
    got = {}
    for r in cut.collect():
        got.setdefault((r.image_id, r.side), {})[r.y, r.x] = r.v
    assert set(got) == {(1, "right"), (1, "left")}          # a picture with one pupil has no pair

    angle = -np.arccos(62 / np.hypot(62, 8))
    c, s = np.cos(angle), np.sin(angle)
    y, x = np.mgrid[:48, :100]
    sx, sy = c * (x - 49.5) + s * (y - 23.5) + 50, -s * (x - 49.5) + c * (y - 23.5) + 24
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    read = lambda yy, xx: picture[np.clip(yy, 0, 47), np.clip(xx, 0, 99)]
    fx, fy = sx - x0, sy - y0
    turned = ((1 - fx) * (1 - fy) * read(y0, x0) + fx * (1 - fy) * read(y0, x0 + 1)
              + (1 - fx) * fy * read(y0 + 1, x0) + fx * fy * read(y0 + 1, x0 + 1))
    turned = np.rint(np.round(turned, 9)).astype(int)
    for side, left, top in (("right", 20 - 14, 18 + 4 - 11), ("left", 82 - 14, 26 - 4 - 11)):
        want = turned[top:top + 22, left:left + 28]
        assert got[1, side] == {(j, i): want[j, i] for j in range(want.shape[0]) for i in range(want.shape[1])}


def test_no_eyes_without_pupils(spark):
    raster = spark.createDataFrame([(1, 0, 0, 5)], "image_id long, y int, x int, v int")
    same = spark.createDataFrame([(1, 4, 4, 4, 4)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    assert geometry.eye_rasters(raster, same, 3).count() == 0
    assert geometry.eye_rasters(raster, same.limit(0), 3).count() == 0
