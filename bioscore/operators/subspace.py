"""Subspace features over vectors: PCA, LDA, projection, reconstruction, similarity.

Training only needs sums of d × d matrices. Every task adds up its own rows first
and sends d rows on; the small eigenproblem is solved on the driver, whose input
depends on the vector length and not on the number of vectors.

For wide vectors (`pca_fit_wide`, `lda_fit_wide`) not even one d × d matrix exists: a block
Krylov space is grown by passes over the vectors, in each of which tasks add up d × block numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_even
from .common import modest_batches

#: Similarity of images of different size.
DIFFERENT_SIZE = 100000000.0


@dataclass
class Subspace:
    """A mean vector, basis vectors as columns, and their eigenvalues."""

    mean: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def table(self, spark) -> DataFrame:
        rows = [(c, float(self.values[c]), [float(w) for w in self.basis[:, c]])
                for c in range(self.basis.shape[1])]
        return spark.createDataFrame(rows, "comp int, eigenvalue double, v array<double>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(batch.num_rows, -1)


def mean_vector(vectors: DataFrame) -> DataFrame:
    """Mean per position: (dim, mean)."""
    return (vectors.select(F.posexplode("v").alias("dim", "v"))
            .groupBy("dim").agg(F.avg("v").alias("mean")))


def class_means(vectors: DataFrame) -> DataFrame:
    """(label, n, v): the mean vector of each label."""
    sums = (vectors.select("label", F.posexplode("v").alias("dim", "v"))
            .groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("m")))
    cells = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return sums.groupBy("label").agg(F.max("n").alias("n"),
                                     F.transform(cells, lambda c: c["m"]).alias("v"))


def gram_rows(vectors: DataFrame, weight: str | None = None) -> DataFrame:
    """Weighted sums (i, n, s, g): n = Σw, s = Σw·v_i, g = row i of Σ w·v·vᵀ."""
    columns = vectors.select("v", *([F.col(weight).cast("double").alias("w")] if weight else []))

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "v")
            w = (np.asarray(batch.column(1)) if weight else np.ones(len(x)))[:, None]
            part = (w.sum(), (w * x).sum(0), x.T @ (w * x))
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            n, s, g = total
            d = len(s)
            ends = pa.array(np.arange(0, d * d + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(s),
                 pa.ListArray.from_arrays(ends, pa.array(g.ravel()))], names=["i", "n", "s", "g"])

    def total(batches):
        """Add the rows of the tasks that share a row number, one batch at a time."""
        sums: dict[int, list] = {}
        for batch in batches:
            g = _matrix(batch, "g") if batch.num_rows else ()
            for i, n, s, row in zip(*(batch.column(k).to_pylist() for k in range(3)), g):
                if i in sums:
                    sums[i] = [sums[i][0] + n, sums[i][1] + s, sums[i][2] + row]
                else:
                    sums[i] = [n, s, row.copy()]
        if sums:
            n, s, g = zip(*sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array(n), pa.array(s),
                 pa.array(list(g), pa.list_(pa.float64()))], names=["i", "n", "s", "g"])

    schema = "i int, n double, s double, g array<double>"
    return columns.mapInArrow(partial, schema).repartition("i").mapInArrow(total, schema)


def _collect(grams: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """The d rows of a sum matrix as arrays."""
    rows = sorted(grams.toLocalIterator(), key=lambda r: r["i"])
    return rows[0]["n"], np.array([r["s"] for r in rows]), np.array([r["g"] for r in rows])


def covariance(vectors: DataFrame) -> DataFrame:
    """(i, j, cov), divided by the number of vectors."""
    rows = gram_rows(vectors)
    means = rows.select(F.col("i").alias("j"), (F.col("s") / F.col("n")).alias("mj"))
    cells = rows.select("i", "n", (F.col("s") / F.col("n")).alias("mi"), F.posexplode("g").alias("j", "c"))
    return cells.join(means, "j").select(
        "i", "j", (F.col("c") / F.col("n") - F.col("mi") * F.col("mj")).alias("cov"))


def pca_fit(vectors: DataFrame, k: int | None = None) -> Subspace:
    """Principal directions of the vectors, largest variance first."""
    n, s, g = _collect(gram_rows(vectors))
    mean = s / n
    values, basis = np.linalg.eigh(g / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:k]
    return Subspace(mean, basis[:, order], values[order])


def _spread(means: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Σ (class mean - mean)(class mean - mean)ᵀ, each class once."""
    n, s, g = _collect(gram_rows(means))
    return g - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)


def scatter(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, int]:
    """Within- and between-class scatter, n, mean and number of classes."""
    n, s, g = _collect(gram_rows(vectors))
    means = class_means(vectors)
    _, _, weighted = _collect(gram_rows(means, "n"))
    between = _spread(means, s / n)
    classes = means.count()
    return g - weighted, between, n, s / n, classes


def scatter_table(vectors: DataFrame) -> DataFrame:
    """(i, j, within, between) without leaving Spark."""
    total, means = gram_rows(vectors), class_means(vectors)
    cells = lambda df, c: df.select("i", F.posexplode("g").alias("j", c))
    once, weighted = gram_rows(means), gram_rows(means, "n")
    mean = total.select("i", (F.col("s") / F.col("n")).alias("m"))
    sums = once.select("i", F.col("s").alias("q"), F.col("n").alias("classes"))
    left = mean.join(sums, "i")
    right = left.select(F.col("i").alias("j"), F.col("m").alias("mj"), F.col("q").alias("qj"))
    joined = (cells(total, "t").join(cells(weighted, "w"), ["i", "j"])
              .join(cells(once, "o"), ["i", "j"]).join(left, "i").join(right, "j"))
    between = (F.col("o") - F.col("q") * F.col("mj") - F.col("m") * F.col("qj")
               + F.col("classes") * F.col("m") * F.col("mj"))
    return joined.select("i", "j", (F.col("t") - F.col("w")).alias("within"), between.alias("between"))


def lda_fit(vectors: DataFrame, k: int | None = None) -> Subspace:
    """Directions that separate labels: PCA to n - classes dimensions, then LDA."""
    within, between, n, mean, classes = scatter(vectors)
    pca = pca_fit(vectors, max(1, min(int(n) - classes, within.shape[0])))
    p = pca.basis
    values, basis = np.linalg.eig(np.linalg.pinv(p.T @ within @ p) @ (p.T @ between @ p))
    order = np.argsort(values.real)[::-1][: k or classes - 1]
    return Subspace(mean, p @ basis[:, order].real, values.real[order])


# ------------------------------------------------------------------ wide vectors

#: Directions per pass, blocks kept before a restart, restarts, and the residual that settles a pair.
BLOCK, KEPT, RESTARTS, SETTLED = 16, 24, 8, 1e-9
#: Coordinates of a row of partial sums.
STRETCH = 256


def _tall_sum(vectors: DataFrame, part) -> np.ndarray | None:
    """Σ part(x) over the batches x of the vectors, as a d × c matrix; None without vectors.

    Every task adds up its own batches; the sums travel in stretches of coordinates, are added
    by stretch, and only the d × c result reaches the driver.
    """
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = part(_matrix(batch, "v"))
                total = y if total is None else total + y
        if total is not None:
            for at in range(0, len(total), STRETCH):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // STRETCH], pa.int32()),
                     pa.array([total[at:at + STRETCH].ravel()], pa.list_(pa.float64()))],
                    names=["i", "y"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, y in zip(batch.column("i").to_pylist(), batch.column("y")):
                y = np.asarray(y.values)
                sums[i] = sums[i] + y if i in sums else y
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "y"])

    schema = "i int, y array<double>"
    summed = vectors.select("v").mapInArrow(partial, schema).repartition("i").mapInArrow(total, schema)
    rows = sorted(summed.toLocalIterator(), key=lambda r: r["i"])
    if not rows:
        return None
    width = part(np.zeros((0, _width(vectors)))).shape[1]
    return np.concatenate([np.asarray(r["y"]) for r in rows]).reshape(-1, width)


def _width(vectors: DataFrame) -> int:
    """Length of the vectors; 0 without vectors."""
    row = vectors.select(F.size("v").alias("d")).first()
    return row["d"] if row else 0


def _orthonormal(block: np.ndarray, space: list[np.ndarray], least: float) -> np.ndarray:
    """Orthonormal directions of a block outside a space; none if nothing over `least` is left."""
    for _ in range(2):
        for q in space:
            block = block - q @ (q.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, size > least]
    for q in space:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def pca_fit_wide(vectors: DataFrame, k: int, seed: int = 0) -> Subspace:
    """The k leading principal directions of wide vectors, without a d × d matrix anywhere.

    Block Krylov method: from a random block, each pass multiplies the last block by the
    covariance and adds the new directions to the space; the covariance inside the space gives
    the leading pairs. It ends when each pair's residual is under SETTLED of the largest
    value, or when the space is closed, and starts again from the best directions when KEPT blocks are
    held. Driver and tasks hold d × (k + KEPT · BLOCK) numbers at most. Vectors that span fewer than k
    directions give fewer; no vectors, or pairs that do not settle, raise an error. Wide vectors reach
    Python in batches of some MB, also in later steps of the session.
    """
    vectors = modest_batches(vectors, 8 * (_width(vectors) or 0))
    sums = _tall_sum(vectors, lambda x: np.column_stack([x.sum(0), np.full(x.shape[1], float(len(x)))]))
    if sums is None:
        raise ValueError("no vectors to fit")
    n, mean = sums[0, 1], sums[:, 0] / sums[0, 1]

    def times(q: np.ndarray) -> np.ndarray:
        def part(x):
            x = x - mean
            return x.T @ (x @ q)
        return _tall_sum(vectors, part) / n

    block = np.random.default_rng(seed).standard_normal((len(mean), min(BLOCK, len(mean))))
    last = _orthonormal(block, [], 0.0)
    for _ in range(RESTARTS):
        space, images = [], []
        while True:
            space.append(last)
            images.append(times(last))
            q, z = np.hstack(space), np.hstack(images)
            inner = q.T @ z
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            scale = max(values[0], 0.0)
            gaps = np.linalg.norm(z @ turn[:, :k] - (q @ turn[:, :k]) * values[:k], axis=0)
            last = _orthonormal(images[-1], space, SETTLED * scale)
            closed = not last.shape[1]
            if closed or len(values) >= k and (gaps <= SETTLED * scale).all():
                real = values[:k] > SETTLED * scale
                return Subspace(mean, q @ turn[:, :k][:, real], values[:k][real])
            if len(space) >= KEPT:
                break
        last = _orthonormal(q @ turn[:, :max(k, BLOCK)], [], 0.0)
    raise RuntimeError(f"the {k} leading directions did not settle")


def lda_fit_wide(vectors: DataFrame, dims: int, k: int | None = None, seed: int = 0) -> Subspace:
    """Directions that separate labels among the `dims` leading principal ones of wide vectors.

    With `dims` the rank of the vectors (at most their number less the classes) these are the
    directions of `lda_fit`.
    """
    pca = pca_fit_wide(vectors, dims, seed)
    within, between, _, _, classes = scatter(project(vectors.select("label", "v"), pca)
                                             .withColumnRenamed("p", "v"))
    values, basis = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(values.real)[::-1][: k or classes - 1]
    return Subspace(pca.mean, pca.basis @ basis[:, order].real, values.real[order])


def _mapped(df: DataFrame, column: str, out: str, change) -> DataFrame:
    """Replace an array column by the rows of change(matrix), batch by batch."""
    keep = [c for c in df.columns if c != column]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != column]
                       + [f"{out} array<double>"])

    def kernel(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.ascontiguousarray(change(_matrix(batch, column)))
            ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[*keep, out])

    return df.mapInArrow(kernel, schema)


def project(vectors: DataFrame, model: Subspace) -> DataFrame:
    """v → p, the coordinates in the subspace."""
    mean, basis = model.mean, model.basis
    return _mapped(vectors, "v", "p", lambda x: (x - mean) @ basis)


def reconstruct(projections: DataFrame, model: Subspace) -> DataFrame:
    """p → v, the point of the subspace in the original coordinates."""
    mean, basis = model.mean, model.basis
    return _mapped(projections, "p", "v", lambda x: x @ basis.T + mean)


def to_bytes(v: str) -> Column:
    """Round an array to whole numbers 0 … 255."""
    return F.transform(v, lambda e: clamp(half_even(e), 0, 255))


def component_image(v: str) -> Column:
    """Stretch an array to 0 … 255."""
    low, high = F.array_min(v), F.array_max(v)
    gain = F.when(high > low, F.lit(255.0) / (high - low)).otherwise(0.0)
    return F.transform(v, lambda e: clamp(half_even((e - low) * gain), 0, 255))


def l2_similarity(a: str, b: str) -> Column:
    """Euclidean distance divided by the number of pixels."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                        lambda s, e: s + e)
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, F.sqrt(total) / F.size(a)).otherwise(DIFFERENT_SIZE)
