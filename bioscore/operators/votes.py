"""Edges and votes: gradient, thinning, region growing, circles and lines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ADJUST, fixed, half_away
from ..session import checkpoint_ready
from .common import attach, lookup, on_strips, shifted
from .components import components
from .geometry import PI, line_points
from .raster import carried, crop, decimate, gamma, gaussian_smooth, image_sizes, limit, sized

#: Distance at which a pixel is compared with its neighbours along the gradient.
THIN_RADIUS = 1.5
#: A line needs more than this mass of edge pixels.
MIN_LINE = 25
#: Side of the tiles in which votes are counted.
TILE = 64
#: Side of the tiles in which regions are labelled.
REGION_TILE = 256


# ------------------------------------------------------------------------ edges

def gradient(raster: DataFrame, vert: float = 1.0, horz: float = 1.0) -> DataFrame:
    """Weighted gradient magnitude v and direction `orient` in degrees, 0 … 180."""
    def slopes(place, v):
        v = np.nan_to_num(v)
        p = lambda dx, dy: shifted(v, dy, dx)
        h, g = p(1, 0) - p(-1, 0), p(0, 1) - p(0, -1)
        d1, d2 = p(1, 1) - p(-1, -1), p(1, -1) - p(-1, 1)
        gx, gy = (h + (d1 + d2) / 2) * vert, (g + (d1 - d2) / 2) * horz
        turn = np.arctan2(-gy, gx)
        turn = np.where(gy == 0, 0.0, np.where(turn < 0, turn + PI, turn))
        return {"v": np.sqrt(gx * gx + gy * gy), "orient": turn / PI * 180}

    keep = carried(raster)
    return on_strips(raster.select(*keep, "v"), keep, 1, slopes, "v double, orient double")


def thinning_table(radius: float = THIN_RADIUS) -> list[tuple]:
    """Per whole degree: four cells on each side in a 5 × 5 window, and fractions."""
    rows = []
    for degree in range(181):
        angle = degree * PI / 180
        xo, yo = radius * math.cos(angle), radius * math.sin(angle)
        fractions = (xo - math.floor(xo), yo - math.floor(yo))
        xo, yo = (0.0 if degree == 90 else xo), (0.0 if degree == 180 else yo)
        cells = []
        for dx, dy in ((xo, -yo), (-xo, yo)):
            for fy in (math.floor, math.ceil):
                for fx in (math.floor, math.ceil):
                    cells.append((fy(dy) + 2) * 5 + fx(dx) + 2)
        rows.append((degree, *cells, *fractions))
    return rows


def thin(edges: DataFrame) -> DataFrame:
    """Keep v where it exceeds the interpolated values on both sides, else 0.

    `edges` carries v and orient. The two outermost pixels of an image are 0.
    """
    rows = np.array(thinning_table())
    taps, parts = rows[:, 1:9].astype(np.int64), rows[:, 9:]

    def keep_tops(place, v, orient):
        out = np.zeros_like(v)
        y, x = np.nonzero(v > 0)
        inside = ((x >= 2) & (y + place["top"] >= 2) & (x < place["w"] - 2)
                  & (y + place["top"] < place["h"] - 2) & (y >= 2) & (y < v.shape[0] - 2))
        y, x = y[inside], x[inside]
        degree = (orient[y, x] + ADJUST).astype(np.int64)
        fx, fy = parts[degree].T
        top = np.ones(len(y), bool)
        for side in (0, 4):
            tl, tr, bl, br = (v[y + taps[degree, side + k] // 5 - 2, x + taps[degree, side + k] % 5 - 2]
                              for k in range(4))
            upper, lower = tl + fx * (tr - tl), bl + fx * (br - bl)
            top &= v[y, x] > upper + fy * (lower - upper)
        out[y[top], x[top]] = v[y[top], x[top]]
        return {"v": out}

    edges = sized(edges)
    keep = carried(edges)
    return on_strips(edges.select(*keep, "v", "orient"), keep, 2, keep_tops, "v double")


def _label_tile(table: pa.Table) -> pa.Table:
    """Smallest pixel number of each connected region of one tile."""
    table = table.sort_by("pixel")
    y, x = (table.column(c).to_numpy() % REGION_TILE for c in ("y", "x"))
    grid = np.full((REGION_TILE + 1, REGION_TILE + 2), -1)
    grid[y, x + 1] = np.arange(len(y))
    inner = grid[:-1, 1:-1]
    pairs = [np.stack([inner, beside])[:, (inner >= 0) & (beside >= 0)] for beside in (
        grid[:-1, 2:], grid[1:, :-2], grid[1:, 1:-1], grid[1:, 2:])]
    a, b = np.concatenate(pairs, axis=1)
    roots = np.arange(len(y))
    while len(a):
        a, b = roots[a], roots[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(roots, a, b)
        while (deeper := roots[roots] != roots).any():
            roots[deeper] = roots[roots[deeper]]
    return table.append_column("region", pa.array(table.column("pixel").to_numpy()[roots]))


def _checkpoints(spark: SparkSession) -> None:
    """Rounds are kept in the folder that the session's machines share."""
    if not checkpoint_ready(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster sees")


def grow_regions(raster: DataFrame, high: float, low: float, rounds: list | None = None) -> DataFrame:
    """Pixels above `low` that are connected to a pixel above `high`: (image_id, y, x, w, h).

    Pixels of the first and the last row can be reached but do not pass the
    region on. Regions are first labelled inside tiles; those that touch across tiles are then
    joined by alternating minima, in a number of rounds that grows with the logarithm of the
    longest chain of tiles. Regions of a component with a seed stay.
    """
    _checkpoints(raster.sparkSession)
    above = sized(raster).where(F.col("v") > low)
    number = F.col("y").cast("long") * F.col("w") + F.col("x")
    strong = (above.withColumn("pixel", number)
              .withColumn("seed", F.col("v") > high)
              .withColumn("passes", (F.col("pixel") > F.col("w"))
                          & (F.col("pixel") < F.col("w") * F.col("h") - F.col("w") - 1))
              .select("image_id", "y", "x", "w", "h", "pixel", "seed", "passes").checkpoint())
    inner = strong.where("passes").withColumn("ty", F.floor(F.col("y") / REGION_TILE)).withColumn(
        "tx", F.floor(F.col("x") / REGION_TILE))
    kind = raster.schema["image_id"].dataType.simpleString()
    labelled = inner.groupBy("image_id", "ty", "tx").applyInArrow(
        _label_tile, f"image_id {kind}, y int, x int, w int, h int, pixel long, seed boolean, passes boolean, "
        "ty long, tx long, region long").checkpoint()

    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                       for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])

    def neighbours(df: DataFrame) -> DataFrame:
        return (df.withColumn("_o", F.explode(around))
                .withColumn("y", F.col("y") + F.col("_o.dy"))
                .withColumn("x", F.col("x") + F.col("_o.dx")).drop("_o"))

    last = REGION_TILE - 1
    rim = labelled.where((F.col("y") % REGION_TILE).isin(0, last) | (F.col("x") % REGION_TILE).isin(0, last))
    links = (neighbours(rim.select("image_id", "y", "x", F.col("region").alias("source")))
             .join(rim.select("image_id", "y", "x", "region"), ["image_id", "y", "x"])
             .where(F.col("source") != F.col("region"))
             .select("image_id", "source", "region").distinct().checkpoint())
    reached = labelled.where("seed").select("image_id", "region").distinct()
    if not links.isEmpty():
        roots = components(links.select("image_id", F.col("source").alias("u"), F.col("region").alias("v")),
                           ["image_id"], rounds).withColumnRenamed("node", "region")
        seeded = roots.join(reached, ["image_id", "region"]).select("image_id", "root").distinct()
        reached = reached.unionByName(roots.join(seeded, ["image_id", "root"]).select("image_id", "region")).distinct()
    cell = ("image_id", "y", "x", "w", "h")
    core = labelled.join(reached, ["image_id", "region"], "left_semi").select(*cell)
    leaves = strong.where(~F.col("passes"))
    touched = (leaves.join(neighbours(core.select("image_id", "y", "x")).distinct(),
                           ["image_id", "y", "x"], "left_semi")
               .unionByName(leaves.where("seed")).select(*cell).distinct())
    return core.unionByName(touched)


# ---------------------------------------------------------------------- circles

#: Edge pixels × circle cells that are counted at once.
VOTED = 1 << 20


def digital_circle(radius: int) -> np.ndarray:
    """(dy, dx) of the cells of a digital circle, each once."""
    i = np.arange(int(radius / 1.4142) + 1)
    j = (radius * np.sqrt(1 - i * i / (radius * radius)) + 0.5).astype(np.int64)
    octants = [(a * s, b * t) for a, b in ((i, j), (j, i)) for s in (1, -1) for t in (1, -1)]
    return np.unique(np.concatenate([np.stack(o, axis=1) for o in octants]), axis=0)


def _vote_tile(table: pa.Table, best: bool) -> pa.Table:
    """Votes that fall into one tile, from all edge pixels within reach of it.

    Every plane is one dense array of tile size. With `best` only the first maximum in
    plane, column, row order is returned.
    """
    first = {c: table.column(c)[0].as_py() for c in ("image_id", "ty", "tx", "w", "h", "base", "planes")}
    top, left = first["ty"] * TILE, first["tx"] * TILE
    high, wide = min(TILE, first["h"] - top), min(TILE, first["w"] - left)
    y, x = table.column("y").to_numpy() - top, table.column("x").to_numpy() - left
    found = []
    for plane in range(first["planes"]):
        cells = digital_circle(plane + 1 + first["base"])
        votes = np.zeros(high * wide, np.int64)
        step = max(1, VOTED // len(cells))
        for at in range(0, len(y), step):
            row = y[at:at + step, None] + cells[:, 0]
            column = x[at:at + step, None] + cells[:, 1]
            inside = (row >= 0) & (row < high) & (column >= 0) & (column < wide)
            votes += np.bincount(row[inside] * wide + column[inside], minlength=high * wide)
        place = np.flatnonzero(votes)
        if best and len(place):
            row, column = np.divmod(place, wide)
            place = place[np.lexsort((row, column, -votes[place]))[:1]]
        row, column = np.divmod(place, wide)
        found.append((np.full(len(place), plane), row + top, column + left, votes[place]))
    plane, row, column, votes = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    return pa.table({"image_id": pa.array([first["image_id"]] * len(plane), table.schema.field("image_id").type),
                     "plane": pa.array(plane, pa.int32()), "y": pa.array(row, pa.int32()),
                     "x": pa.array(column, pa.int32()), "votes": pa.array(votes, pa.int64())})


def circle_votes(edges: DataFrame, radii: DataFrame, best: bool = False) -> DataFrame:
    """Votes of edge pixels for circle centres: (image_id, plane, y, x, votes).

    `edges` carries the image size, `radii` has the planes 0 … planes-1 of each image, plane p of radius
    p + 1 + base. Each edge pixel travels to the tiles that its largest circle can reach, so a
    tile counts all its votes in dense arrays and no vote is a row. With `best` each tile
    returns its first maximum per plane only.
    """
    reach = F.col("planes") + F.col("base")
    tiles = lambda c, size: F.sequence(F.floor(F.greatest(F.col(c) - reach, F.lit(0)) / TILE),
                                       F.floor(F.least(F.col(c) + reach, F.col(size) - 1) / TILE))
    near = (lookup(edges, radii.select("image_id", "base", "planes").where("planes > 0"), "image_id",
                   F.floor(F.col("y") / TILE))
            .withColumn("ty", F.explode(tiles("y", "h"))).withColumn("tx", F.explode(tiles("x", "w")))
            .select("image_id", "ty", "tx", "y", "x", "w", "h", "base", "planes"))
    kind = edges.schema["image_id"].dataType.simpleString()
    return near.groupBy("image_id", "ty", "tx").applyInArrow(
        lambda table: _vote_tile(table, best), f"image_id {kind}, plane int, y int, x int, votes bigint")


def best_circle(votes: DataFrame) -> DataFrame:
    """First maximum in plane, column, row order."""
    top = F.max(F.struct("votes", (-F.col("plane")).alias("p"), (-F.col("x")).alias("c"),
                         (-F.col("y")).alias("r"))).alias("b")
    return votes.groupBy("image_id").agg(top).select(
        "image_id", "b.votes", (-F.col("b.p")).alias("plane"), (-F.col("b.r")).alias("y"),
        (-F.col("b.c")).alias("x"))


def edge_pixels(raster: DataFrame, sigma: float, scaling: float | None, vert: float,
                horz: float, high: float, low: float) -> DataFrame:
    """Thinned, hysteresis-thresholded edge pixels of the scaled images.

    Without a common `scaling` the raster carries one for each image in a column of that name.
    """
    small = gaussian_smooth(sized(raster), sigma)
    if scaling != 1:
        small = decimate(small, scaling)
    _checkpoints(raster.sparkSession)
    # kept: the range of the gradient and the gradient itself are both needed from here on
    bent = gamma(gradient(small, vert, horz).checkpoint(), 1.9)
    return grow_regions(thin(bent), high, low)


def find_circle(raster: DataFrame, limits: DataFrame, scaling: float | None, high: float, low: float,
                vert: float, horz: float, sigma: float = 2.0) -> DataFrame:
    """Strongest circle per image: (image_id, row, col, r), 1-based.

    `limits` has the radius range r_low … r_high of each image. Without a common `scaling` it
    also has a column of that name, so images of different sensors are searched together.
    """
    if scaling is None:
        figures = image_sizes(raster).join(limits.select("image_id", "scaling"), "image_id")
        raster = attach(raster.drop("w", "h"), figures)
    else:
        limits = limits.withColumn("scaling", F.lit(float(scaling)))
    edges = edge_pixels(raster, sigma, scaling, vert, horz, high, low)
    s, r_low, r_high = F.col("scaling"), F.col("r_low"), F.col("r_high")
    radii = limits.select("image_id", half_away(r_low * s).alias("base"),
                          half_away(r_high * s - r_low * s).alias("planes"), "scaling")
    found = radii.join(best_circle(circle_votes(edges, radii, best=True)), "image_id", "left")
    back = lambda c: (c / F.col("scaling") + ADJUST).cast("int")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select("image_id", back(none("y") + 1).alias("row"), back(none("x") + 1).alias("col"),
                        back(F.col("base") + none("plane") + 1).alias("r"))


# ------------------------------------------------------------------------ lines

def line_votes(edges: DataFrame) -> DataFrame:
    """Projections of edge pixels at 180 angles: (image_id, angle, r, mass).

    Every pixel is split into four quarters and each quarter over two bins.
    `edges` carries the image size.
    """
    xo, yo = F.floor((F.col("w") - 1) / 2), F.floor((F.col("h") - 1) / 2)
    corner = F.struct((F.col("h") - 1 - yo).alias("a"), (F.col("w") - 1 - xo).alias("b"))
    reach = F.ceil(F.sqrt((corner["a"] * corner["a"] + corner["b"] * corner["b"]).cast("double"))) + 1
    spread = (edges.select("image_id", "y", "x", "w", "h").withColumn("last", reach)
              .withColumn("px", F.col("x") - xo)
              .withColumn("py", (F.col("h") - 1 - F.col("y")) - yo)
              .withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(179)))))
    turn = F.col("angle") * (PI / 180)
    placed = (spread.select("image_id", "angle", "last", "px", "py", F.cos(turn).alias("_cos"),
                            F.sin(turn).alias("_sin")))
    at_quarter = [(F.col("px") + dx) * F.col("_cos") + F.col("last") + (F.col("py") + dy) * F.col("_sin")
                  for dy in (0.25, -0.25) for dx in (-0.25, 0.25)]
    placed = placed.select("image_id", "angle", "last",
                           *[q.alias(f"_q{i}") for i, q in enumerate(at_quarter)])
    quarters = [F.col(f"_q{i}") for i in range(4)]
    first = F.floor(F.least(*quarters))
    # the quarters are less than one bin apart, so three bins take all of them
    share = lambda k: sum((F.greatest(F.lit(0.0), F.lit(0.25) * (1 - F.abs(q - k))) for q in quarters),
                          F.lit(0.0))
    bins = F.array(*[F.struct((first + k).alias("b"), share(first + k).alias("m")) for k in range(3)])
    return (placed.select("image_id", "angle", "last", F.explode(bins).alias("e"))
            .where(F.col("e.m") > 0)
            .groupBy("image_id", "angle", (F.col("e.b") - F.col("last")).cast("int").alias("r"))
            .agg(fixed(F.sum("e.m"), 9).alias("mass"))
            .where(F.col("mass") > 0))


def strongest_lines(votes: DataFrame, sizes: DataFrame, least: float = MIN_LINE) -> DataFrame:
    """All lines of the largest mass above `least`: (image_id, n, angle, r, a, b, c).

    n numbers the ties, first by position and then by angle; a·x + b·y + c = 0.
    """
    top = votes.groupBy("image_id").agg(F.max("mass").alias("top")).where(F.col("top") > least)
    tied = (votes.join(top, "image_id").where(F.col("mass") == F.col("top"))
            .groupBy("image_id", "top").agg(F.array_sort(F.collect_list(
                F.struct("r", "angle"))).alias("t")))                  # bins of one image
    listed = tied.select("image_id", "top", F.posexplode("t").alias("n", "t")).join(sizes, "image_id")
    turn = -F.col("t.angle") * PI / 180
    a, b = F.cos(turn), F.sin(turn)
    c = -F.col("t.r") - a * (F.col("w") / 2.0 - 1) - b * (F.col("h") / 2.0 - 1)
    return listed.select("image_id", "n", F.col("t.angle").alias("angle"), F.col("t.r").alias("r"),
                         a.alias("a"), b.alias("b"), c.alias("c"), "w", "h")


def find_lines(raster: DataFrame, least: float = MIN_LINE, high: float = 0.20, low: float = 0.15) -> DataFrame:
    """Strongest horizontal-edge lines of every image, of more than `least` mass."""
    edges = edge_pixels(raster, 2.0, 1, 0.0, 1.0, high, low)
    return strongest_lines(line_votes(edges), image_sizes(raster), least)


def line_extents(lines: DataFrame, origins: DataFrame) -> DataFrame:
    """Smallest and largest height of each image's first line, moved to (ox, oy).

    Images of `origins` without a line keep NULL.
    """
    first = lines.where(F.col("n") == 0)
    span = line_points(first).groupBy("image_id").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return (origins.join(span, "image_id", "left")
            .withColumn("low", F.col("low") + F.col("oy")).withColumn("high", F.col("high") + F.col("oy")))


# ----------------------------------------------------------------- compositions

def eyelid_search(raster: DataFrame, circles: DataFrame, curved: bool = True, **lines) -> DataFrame:
    """Line extents of the eyelid patches round each iris, for `eyelid_anchors`.

    All patches of all images are searched together as separate small images. Further
    arguments go to `find_lines`.
    """
    eyes = circles.join(image_sizes(raster), "image_id")
    w, h, xi, yi, ri = (F.col(c) for c in ("w", "h", "xi", "yi", "ri"))
    extra = F.floor(ri / 2) if curved else F.lit(0)
    left = limit(xi - ri - extra, w - 1)
    top, bottom = limit(yi - ri, h - 1), limit(F.col("yp") + F.col("rp"), h - 1)
    tall = F.greatest(yi + ri - bottom, F.lit(0))
    if curved:
        right, middle = limit(xi + extra, w - 1), limit(xi - extra, w - 1)
        patches = {"lt": (left, top, ri, ri), "rt": (right, top, ri, ri),
                   "lb": (left, bottom, ri, tall), "rb": (right, bottom, ri, tall),
                   "ct": (middle, top, extra * 2, tall), "cb": (middle, bottom, extra * 2, tall)}
    else:
        patches = {"t": (left, top, ri * 2, ri), "b": (left, bottom, ri * 2, tall)}
    rects = F.array(*[F.struct(F.lit(name).alias("patch"),
                               *[c.cast("int").alias(n) for c, n in zip(rect, ("x0", "y0", "wd", "ht"))])
                      for name, rect in patches.items()])
    placed = (eyes.select("image_id", "w", "h", F.explode(rects).alias("p"))
              .select("image_id", "w", "h", "p.*")
              .withColumn("key", F.concat_ws("|", "image_id", "patch")))
    cut = crop(raster, placed, one_based=True, new_id="key")
    sizes = image_sizes(cut).where((F.col("w") > 1) & (F.col("h") > 1)).select("image_id")
    found = find_lines(cut.join(sizes, "image_id", "left_semi"), **lines)
    origins = placed.select(F.col("key").alias("image_id"), F.col("image_id").alias("eye"), "patch",
                            F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    spans = line_extents(found, origins)
    wide = spans.groupBy("eye").agg(*[
        F.max(F.when(F.col("patch") == name, F.col(c))).alias(f"{name}_{k}")
        for name in patches for c, k in (("low", "min"), ("high", "max"))])
    return eyes.join(wide.withColumnRenamed("eye", "image_id"), "image_id")


#: Fixed values of the two-stage search: radius range, scaling and thresholds.
IRIS_SEARCH = {"r_low": 62, "r_high": 78, "scaling": 0.4, "high": 0.20, "low": 0.19, "vert": 1.0, "horz": 0.0}
PUPIL_SEARCH = {"r_low": 14, "r_high": 42, "scaling": 0.6, "high": 0.25, "low": 0.25, "vert": 1.0, "horz": 1.0}


def _circle(raster: DataFrame, ids: DataFrame, search: dict) -> DataFrame:
    limits = ids.select("image_id", F.lit(search["r_low"]).alias("r_low"),
                        F.lit(search["r_high"]).alias("r_high"))
    rest = {k: search[k] for k in ("scaling", "high", "low", "vert", "horz")}
    return find_circle(raster, limits, **rest)


def _cut(raster: DataFrame, parts: DataFrame, new_id: str = "image_id") -> DataFrame:
    """Pixels x1 … x2, y1 … y2 (1-based) of each image, renumbered from 0."""
    wanted = parts.select("image_id", "h", F.col(new_id).alias("_id"), "x1", "y1", "x2", "y2")
    return (attach(raster, wanted)
            .where((F.col("x") + 1).between(F.col("x1"), F.col("x2"))
                   & (F.col("y") + 1).between(F.col("y1"), F.col("y2")))
            .select(F.col("_id").alias("image_id"), (F.col("y") + 1 - F.col("y1")).alias("y"),
                    (F.col("x") + 1 - F.col("x1")).alias("x"), "v"))


def _iris_box(circles: DataFrame, sizes: DataFrame) -> DataFrame:
    """`circles` with the box x1 … x2, y1 … y2 (1-based) of the iris (xi, yi, ri), and h."""
    x, y, r = F.col("xi"), F.col("yi"), F.col("ri")
    return (circles.join(sizes, "image_id")
            .withColumn("x1", F.greatest(x - r, F.lit(1))).withColumn("y1", F.greatest(y - r, F.lit(1)))
            .withColumn("x2", F.least(x + r, F.col("w"))).withColumn("y2", F.least(y + r, F.col("h"))))


def segment_circles(raster: DataFrame, iris: dict = IRIS_SEARCH, pupil: dict = PUPIL_SEARCH) -> DataFrame:
    """Iris circle and the pupil circle inside it: (image_id, xp, yp, rp, xi, yi, ri)."""
    _checkpoints(raster.sparkSession)
    sizes = image_sizes(raster).checkpoint()
    outer = _circle(raster, sizes, iris).select(
        "image_id", F.col("col").alias("xi"), F.col("row").alias("yi"), F.col("r").alias("ri")).checkpoint()
    box = _iris_box(outer, sizes)
    inner = _circle(_cut(raster, box), sizes, pupil)
    return box.join(inner, "image_id").select(
        "image_id", (F.col("x1") + F.col("col")).alias("xp"), (F.col("y1") + F.col("row")).alias("yp"),
        F.col("r").alias("rp"), "xi", "yi", "ri").checkpoint()


def straight_eyelids(raster: DataFrame, circles: DataFrame, **lines) -> DataFrame:
    """Lines above and below the pupil inside the iris box: (image_id, x1, x2, top, bottom).

    Rows to `top` and from `bottom` (1-based) of the columns x1 … x2 are eyelid; NULL where no
    line was found. Further arguments go to `find_lines`.
    """
    box = _iris_box(circles, image_sizes(raster))
    first, last = F.col("yp") - F.col("rp"), F.col("yp") + F.col("rp")
    parts = F.array(F.struct(F.lit("top").alias("part"), F.col("y1").alias("y1"), (first - 1).alias("y2")),
                    F.struct(F.lit("bottom").alias("part"), (last - 1).alias("y1"), F.col("y2").alias("y2")))
    strips = (box.select("image_id", "h", "x1", "x2", F.explode(parts).alias("s"))
              .select("image_id", "h", "x1", "x2", "s.*")
              .withColumn("key", F.concat_ws("|", "image_id", "part")))
    found = find_lines(_cut(raster, strips, "key"), **lines)
    spans = line_extents(found, strips.select(
        F.col("key").alias("image_id"), F.col("image_id").alias("eye"), "part",
        F.lit(0).alias("ox"), (F.col("y1") - 1).alias("oy")))
    edge = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    lids = spans.groupBy(F.col("eye").alias("image_id")).agg(
        edge("top", "high").alias("top"), edge("bottom", "low").alias("bottom"))
    return box.select("image_id", "x1", "x2").join(lids, "image_id", "left")


def under_eyelid() -> Column:
    """True for pixels that the columns x1, x2, top and bottom of `straight_eyelids` cover."""
    hidden = (F.coalesce(F.col("y") + 1 <= F.col("top"), F.lit(False))
              | F.coalesce(F.col("y") + 1 >= F.col("bottom"), F.lit(False)))
    return F.coalesce((F.col("x") + 1).between(F.col("x1"), F.col("x2")) & hidden, F.lit(False))


def segment(raster: DataFrame, iris: dict = IRIS_SEARCH, pupil: dict = PUPIL_SEARCH,
            eyelids: bool = True, highlight: int | None = None, **lines) -> tuple[DataFrame, DataFrame]:
    """Iris circle, pupil circle inside it, straight eyelids: (circles, raster with noise).

    Further arguments go to `find_lines`.
    """
    circles = segment_circles(raster, iris, pupil)
    noise, marked = F.lit(False), raster
    if eyelids:
        marked, noise = attach(raster, straight_eyelids(raster, circles, **lines)), under_eyelid()
    if highlight is not None:
        noise = noise | (F.col("v") > highlight)
    return circles, marked.select("image_id", "y", "x", "v", noise.alias("noise"))
