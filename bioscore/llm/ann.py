"""Nearest neighbours by inner product with collision counting on single projections.

Index: vectors are cut into blocks of bounded size by the hash of their id. A block keeps, for
each of `PROJECTIONS` random directions, its vectors sorted by projection. Vectors get one
more coordinate that makes all norms of a block equal, so the largest inner product is the
smallest distance.

Search: a window around the query's own projection is opened in each sorted array, and every
vector counts in how many windows it lies. Virtual rehashing widens all windows by one factor
(only the new flanks are counted) until enough vectors reach the collision threshold; these
are verified with exact inner products in double precision.

Queries, a stated set, meet the index block by block: each (index block, query block) pair is
one group of bounded size, and returns the best of the block for each query.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components, rows
without id, and vectors of another length than most take no part. Of rows that repeat an id
the smallest vector counts. With fewer candidates than `nearest` all are returned. Equal
scores go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 20
PROJECTIONS = 40
THRESHOLD = 0.7               # share of the projections in which a vector must collide
ENOUGH = 0.25                  # widen until this share of a block, and 8 x nearest, collide
FIRST_HALF, WIDER = 0.9, 1.25    # half width of the first window, and its growth
BLOCK_ROWS, QUERY_ROWS = 16384, 2048
SEED = 20240131


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class BlockIndex:
    """Sorted projections of the vectors of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.norm = float(np.sqrt(norms.max()))
        scaled = np.concatenate([self.vectors / self.norm, np.sqrt(np.maximum(
            1 - norms / self.norm ** 2, 0))[:, None]], axis=1).astype(np.float32)
        self.directions = np.random.Generator(np.random.PCG64(SEED)).standard_normal(
            (scaled.shape[1], projections)).astype(np.float32)
        values = (scaled @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def windows(self, centres: np.ndarray, half: float):
        """First and end place of each query's window in each sorted array."""
        low = [np.searchsorted(v, c - half) for v, c in zip(self.sorted, centres)]
        high = [np.searchsorted(v, c + half, "right") for v, c in zip(self.sorted, centres)]
        return np.stack(low).T.tolist(), np.stack(high).T.tolist()

    def search(self, query_ids: np.ndarray, queries: np.ndarray, nearest: int = NEAREST,
               threshold: float = THRESHOLD, share: float = ENOUGH):
        """For each query the ids and scores of its best verified candidates, best first."""
        m, n = self.sorted.shape
        enough, needed = 8 * nearest + int(share * n), int(np.ceil(threshold * m))
        queries = queries.astype(np.float64)
        unit = queries / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        centres = (unit.astype(np.float32) @ self.directions[:-1]).T
        levels: list = []           # windows of all queries, one entry per widening
        for q, (query_id, query) in enumerate(zip(query_ids, queries)):
            if enough >= n:
                rows = np.arange(n)
            else:
                counts, level = np.zeros(n, np.int64), 0
                while True:
                    if level == len(levels):
                        levels.append(self.windows(centres, FIRST_HALF * WIDER ** level))
                    low, high = (x[q] for x in levels[level])
                    if level:
                        old_low, old_high = (x[q] for x in levels[level - 1])
                        flanks = [o[a:b] for o, a, b in zip(self.order, low, old_low)] \
                            + [o[a:b] for o, a, b in zip(self.order, old_high, high)]
                    else:
                        flanks = [o[a:b] for o, a, b in zip(self.order, low, high)]
                    counts += np.bincount(np.concatenate(flanks), minlength=n)
                    rows = np.flatnonzero(counts >= needed)
                    if len(rows) >= enough:
                        break
                    level += 1
            yield query_id, *self._verified(query_id, query, rows, nearest)

    def _verified(self, query_id: int, query: np.ndarray, rows: np.ndarray, nearest: int):
        rows = rows[self.ids[rows] != query_id]
        scores = self.vectors[rows] @ query
        if len(rows) > nearest:
            least = np.partition(scores, len(rows) - nearest)[len(rows) - nearest]
            kept = scores >= least
            rows, scores = rows[kept], scores[kept]
        best = np.lexsort((self.ids[rows], -scores))[:nearest]
        return self.ids[rows[best]], scores[best]


def _searched(nearest: int, threshold: float, share: float, projections: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def group(rows):
        ids = np.array([r[0] for r in rows], np.int64)
        asks = np.array([r[1] for r in rows], bool)
        vectors = np.stack([r[2] for r in rows])
        if asks.all() or not asks.any():
            return
        index = BlockIndex(ids[~asks], vectors[~asks], projections)
        for query_id, found, scores in index.search(ids[asks], vectors[asks], nearest, threshold,
                                                    share):
            if len(found):
                yield pa.record_batch([pa.array(np.full(len(found), query_id)), pa.array(found),
                                       pa.array(scores)], schema=schema)

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()))
            lists = batch.column("vector")
            values, marks = lists.values.to_numpy(), lists.offsets.to_numpy()
            ids, asks = batch.column("vec_id").to_pylist(), batch.column("asks").to_pylist()
            for i, row_key in enumerate(keys):
                if row_key != key:
                    yield from group(held) if held else ()
                    key, held = row_key, []
                held.append((ids[i], asks[i], values[marks[i]:marks[i + 1]].copy()))
        yield from group(held) if held else ()
    return run


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id",
           vector: str = "embedding", nearest: int = NEAREST, threshold: float = THRESHOLD,
           share: float = ENOUGH, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; `queries` is a condition on vec_id.

    All rows but the query's own are candidates.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"),
                          F.col(vector).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = (rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.desc("length")).first())
    if sizes is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score"))
    rows = rows.where(F.size("vector") == sizes.length)
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").take(1):
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    total, asked = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    blocks, parts = max(1, -(-total // block_rows)), max(1, -(-asked // query_rows))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.select("vec_id", "vector", F.lit(False).alias("asks"),
                       place(blocks).alias("block"), every(parts).alias("part"))
    ask = rows.where(queries).select("vec_id", "vector", F.lit(True).alias("asks"),
                                     every(blocks).alias("block"), place(parts).alias("part"))
    groups = (base.unionByName(ask).repartition("block", "part")
              .sortWithinPartitions("block", "part"))
    found = groups.mapInArrow(_searched(nearest, threshold, share, projections),
                              "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
