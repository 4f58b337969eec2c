"""Queries on vectors: subspaces, reconstruction, similarity, face normalisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import faces
from ..operators import raster as ops
from ..operators import subspace as sub
from . import fixtures as fx
from .pixels import f6

COMPONENTS = 8


def face_vectors(spark, d):
    """Vectors as rows of 8-bit pixels with a label."""
    return fx.table(spark, d, "embeddings").select("vec_id", "label", F.expr(
        "transform(embedding, e -> cast(least(greatest(floor((cast(e as double) + 0.6D) * 212), 0), 255)"
        " as double))").alias("v"))


def cosine_basis(mean: np.ndarray) -> sub.Subspace:
    """Eight orthonormal cosine vectors; no sign ambiguity."""
    dim, comp = np.arange(64)[:, None], np.arange(1, COMPONENTS + 1)[None, :]
    return sub.Subspace(mean, math.sqrt(2 / 64) * np.cos(np.pi * (2 * dim + 1) * comp / 128),
                        np.zeros(COMPONENTS))


def _model(spark, d):
    rows = sub.mean_vector(face_vectors(spark, d)).toLocalIterator()       # 64 rows
    means = {r["dim"]: r["mean"] for r in rows}
    return cosine_basis(np.array([means[k] for k in range(64)]))


def mean_vector(spark, d):
    return sub.mean_vector(face_vectors(spark, d)).withColumn("mean", fixed("mean"))


def covariance(spark, d):
    return sub.covariance(face_vectors(spark, d)).withColumn("cov", fixed("cov"))


def class_scatter(spark, d):
    t = sub.scatter_table(face_vectors(spark, d))
    return t.withColumn("within", fixed("within", 4)).withColumn("between", fixed("between"))


def project(spark, d):
    p = sub.project(face_vectors(spark, d).drop("label"), _model(spark, d))
    return p.select("vec_id", F.posexplode("p").alias("comp", "p")).withColumn("p", fixed("p"))


def _rebuilt(spark, d):
    model = _model(spark, d)
    p = sub.project(face_vectors(spark, d).withColumn("source", F.col("v")), model)
    return sub.reconstruct(p, model)


def reconstruct(spark, d):
    r = _rebuilt(spark, d).withColumn("v", F.transform("v", lambda e: fixed(e, 6)))
    return r.select("vec_id", F.posexplode(sub.to_bytes("v")).alias("dim", "v"))


def l2_similarity(spark, d):
    """Each vector against its own reconstruction, and against a shorter one."""
    r = _rebuilt(spark, d)
    return r.withColumn("short", F.slice("v", 1, 32)).select(
        "vec_id", fixed(sub.l2_similarity("source", "v")).alias("similarity"),
        sub.l2_similarity("source", "short").alias("unequal"))


def component_image(spark, d):
    """Class means as images."""
    m = sub.class_means(face_vectors(spark, d)).withColumn("v", F.transform("v", lambda e: fixed(e, 6)))
    return m.select("label", F.posexplode(sub.component_image("v")).alias("dim", "v"))


def pca_eigenvalues(spark, d):
    return sub.pca_fit(face_vectors(spark, d)).table(spark).select("comp", fixed("eigenvalue").alias("eigenvalue"))


def lda_eigenvalues(spark, d):
    return sub.lda_fit(face_vectors(spark, d)).table(spark).select("comp", fixed("eigenvalue").alias("eigenvalue"))


def _largest(column):
    return fixed(F.max(F.abs(column)), 4)


def pca_facts(spark, d):
    """The fitted model applied to all vectors: what holds whatever the signs are.

    Eigenvalues add up to the total variance, each is the variance of its component, and all
    components together give the vectors back.
    """
    vectors = face_vectors(spark, d)
    model = sub.pca_fit(vectors)
    p = sub.project(vectors.withColumn("source", F.col("v")).drop("label"), model)
    parts = (p.select(F.posexplode("p").alias("comp", "p")).groupBy("comp")
             .agg(F.avg(F.col("p") * F.col("p")).alias("variance"))
             .join(F.broadcast(model.table(spark)), "comp"))              # one row a component
    figures = parts.agg(fixed(F.sum("eigenvalue"), 4).alias("trace"),
                        _largest(F.col("variance") - F.col("eigenvalue")).alias("variance_gap"))
    errors = F.transform(F.arrays_zip("source", "v"), lambda e: F.abs(e["source"] - e["v"]))
    rebuilt = sub.reconstruct(p, model).agg(_largest(F.array_max(errors)).alias("rebuilt_gap"))
    return figures.crossJoin(rebuilt)                                     # one row each


ENLARGED = 16


def enlarged_vectors(spark, d):
    """Each pixel 16 times: vectors of 1,024 coordinates."""
    return face_vectors(spark, d).withColumn("v", F.flatten(F.transform(
        "v", lambda e: F.array_repeat(e, ENLARGED))))


def pca_wide_facts(spark, d):
    """All directions of the enlarged vectors, found without their 1,024 × 1,024 matrix.

    The values add up to the total variance, each is the variance of its component, and the
    components give the vectors back.
    """
    vectors = enlarged_vectors(spark, d)
    model = sub.pca_fit_wide(vectors, 64)
    p = sub.project(vectors.withColumn("source", F.col("v")).drop("label"), model)
    parts = (p.select(F.posexplode("p").alias("comp", "p")).groupBy("comp")
             .agg(F.avg(F.col("p") * F.col("p")).alias("variance"))
             .join(F.broadcast(model.table(spark)), "comp"))              # one row a component
    figures = parts.agg(F.count("*").alias("directions"), fixed(F.sum("eigenvalue"), 4).alias("trace"),
                        _largest(F.col("variance") - F.col("eigenvalue")).alias("variance_gap"))
    errors = F.transform(F.arrays_zip("source", "v"), lambda e: F.abs(e["source"] - e["v"]))
    rebuilt = sub.reconstruct(p, model).agg(_largest(F.array_max(errors)).alias("rebuilt_gap"))
    return figures.crossJoin(rebuilt)                                     # one row each


def lda_wide_facts(spark, d):
    """Between- over within-class scatter of each direction found in the leading 64 is its eigenvalue."""
    vectors = enlarged_vectors(spark, d)
    return _ratios(spark, vectors, sub.lda_fit_wide(vectors, 64))


def lda_facts(spark, d):
    """Between- over within-class scatter of each projected direction is its eigenvalue."""
    vectors = face_vectors(spark, d)
    return _ratios(spark, vectors, sub.lda_fit(vectors))


def _ratios(spark, vectors, model):
    p = sub.project(vectors, model).select("label", F.posexplode("p").alias("comp", "p"))
    classes = p.groupBy("label", "comp").agg(
        F.avg("p").alias("m"), (F.count("*") * F.var_pop("p")).alias("inner"))
    every = p.groupBy("comp").agg(F.avg("p").alias("all"))
    ratio = (classes.join(every, "comp").groupBy("comp")
             .agg((F.sum((F.col("m") - F.col("all")) ** 2) / F.sum("inner")).alias("ratio"))
             .join(F.broadcast(model.table(spark)), "comp"))
    return ratio.agg(F.count("*").alias("directions"),
                     _largest(F.col("ratio") / F.col("eigenvalue") - 1).alias("ratio_gap"))


def normalise_faces(spark, d):
    """Raster images as face crops with eye detections placed by image number."""
    r = fx.raster(spark, d)
    sizes = ops.image_sizes(r)
    i = F.col("image_id")

    def found(where, shift):
        side = F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side")
        return sizes.where(where).select(
            "image_id", side, (i % 3 + shift).cast("int").alias("x"), (i % 4).cast("int").alias("y"),
            F.lit(6).alias("w"), F.lit(5).alias("h")).where((i % 5 != 4) | (F.col("side") == "left"))

    return faces.normalise_faces(r, sizes, found(i % 2 == 0, 1), found(F.lit(True), 3), width=40)


# ------------------------------------------------------------------------ SQL

VECTORS_SQL = """vecs AS (
  SELECT vec_id, label, i::INTEGER AS dim, least(greatest(floor((embedding[i + 1]::DOUBLE + 0.6::DOUBLE) * 212), 0), 255) AS v
  FROM embeddings, range(64) t(i)),
means AS (SELECT dim, avg(v) AS mean FROM vecs GROUP BY dim)"""
PROJECT_SQL = f"""{VECTORS_SQL},
basis AS (SELECT dim, (c - 1)::INTEGER AS comp, sqrt(2 / 64e0) * cos(pi() * (2 * dim + 1) * c / 128) AS w FROM means, range(1, 9) t(c)),
proj AS (SELECT vec_id, comp, sum((v - mean) * w) AS p FROM vecs JOIN means USING (dim) JOIN basis USING (dim) GROUP BY ALL),
back AS (SELECT vec_id, b.dim, sum(p * w) + any_value(mean) AS v FROM proj JOIN basis b USING (comp) JOIN means m ON m.dim = b.dim GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (
    mean_vector, covariance, class_scatter, project, reconstruct, l2_similarity, component_image,
    pca_eigenvalues, lda_eigenvalues, pca_facts, lda_facts, pca_wide_facts, lda_wide_facts, normalise_faces)}

ORACLES = {
    "mean_vector": f"WITH {VECTORS_SQL} SELECT dim, {f6('mean')} AS mean FROM means",
    "covariance": f"""WITH {VECTORS_SQL}, n AS (SELECT count(DISTINCT vec_id) AS n FROM vecs)
SELECT a.dim AS i, b.dim AS j, {f6('sum(a.v * b.v) / any_value(n) - any_value(p.mean) * any_value(q.mean)')} AS cov
FROM vecs a JOIN vecs b USING (vec_id) JOIN means p ON p.dim = a.dim JOIN means q ON q.dim = b.dim, n GROUP BY a.dim, b.dim""",
    "class_scatter": f"""WITH {VECTORS_SQL},
cm AS (SELECT label, dim, avg(v) AS m FROM vecs GROUP BY ALL),
w AS (SELECT a.dim AS i, b.dim AS j, sum((a.v - p.m) * (b.v - q.m)) AS s FROM vecs a JOIN vecs b USING (vec_id)
  JOIN cm p ON p.dim = a.dim AND p.label = a.label JOIN cm q ON q.dim = b.dim AND q.label = b.label GROUP BY a.dim, b.dim),
b AS (SELECT p.dim AS i, q.dim AS j, sum((p.m - x.mean) * (q.m - y.mean)) AS s FROM cm p JOIN cm q USING (label)
  JOIN means x ON x.dim = p.dim JOIN means y ON y.dim = q.dim GROUP BY p.dim, q.dim)
SELECT i, j, {f6('w.s', 4)} AS within, {f6('b.s')} AS between FROM w JOIN b USING (i, j)""",
    "project": f"WITH {PROJECT_SQL} SELECT vec_id, comp, {f6('p')} AS p FROM proj",
    "reconstruct": f"""WITH {PROJECT_SQL}
SELECT vec_id, dim, least(greatest(round_even({f6('v')}, 0), 0), 255)::INTEGER AS v FROM back""",
    "l2_similarity": f"""WITH {PROJECT_SQL}
SELECT a.vec_id, {f6('sqrt(sum((a.v - b.v) * (a.v - b.v))) / 64')} AS similarity, 1e8::DOUBLE AS unequal
FROM vecs a JOIN back b ON b.vec_id = a.vec_id AND b.dim = a.dim GROUP BY a.vec_id""",
    "pca_facts": f"""WITH {VECTORS_SQL}, spread AS (SELECT dim, var_pop(v) AS s FROM vecs GROUP BY dim)
SELECT {f6('sum(s)', 4)} AS trace, 0e0 AS variance_gap, 0e0 AS rebuilt_gap FROM spread""",
    "pca_wide_facts": f"""WITH {VECTORS_SQL}, spread AS (SELECT dim, var_pop(v) AS s FROM vecs GROUP BY dim)
SELECT count(*) AS directions, {f6('16 * sum(s)', 4)} AS trace, 0e0 AS variance_gap, 0e0 AS rebuilt_gap FROM spread""",
    "lda_wide_facts": "SELECT count(DISTINCT label) - 1 AS directions, 0e0 AS ratio_gap FROM embeddings",
    "lda_facts": "SELECT count(DISTINCT label) - 1 AS directions, 0e0 AS ratio_gap FROM embeddings",
    "component_image": f"""WITH {VECTORS_SQL}, cm AS (SELECT label, dim, {f6('avg(v)')} AS m FROM vecs GROUP BY label, dim),
ends AS (SELECT label, min(m) AS lo, max(m) AS hi FROM cm GROUP BY ALL)
SELECT label, dim, least(greatest(round_even((m - lo) * (255e0 / (hi - lo)), 0), 0), 255)::INTEGER AS v FROM cm JOIN ends USING (label)""",
}
