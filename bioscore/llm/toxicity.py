"""Severity of toxic texts by cumulative-link (proportional odds) regression.

P(grade >= k) = 1 / (1 + exp(threshold_k - w·x)): one weight per hashed word, shared by all
grades, and ordered thresholds. x holds 1 for every selected word that occurs in the text.

The model is fitted on at most `LABELLED` labelled documents, drawn by the hash of their id;
copies and most near copies of equal grade count once. Words are chosen in Spark by how much more (or less)
often they occur above a grade than below it; the chosen columns of the sample, bounded by
LABELLED × SELECTED, are fitted on the driver. Scoring is one pass without a shuffle.

Grades: any whole numbers from 0. Labels that only say toxic or not are refined before the fit
(`refine`): a toxic document gets grade 1, 2 or 3 by how many distinct words it holds that are
significantly more frequent in toxic documents (fewer than 3, 3 or 4, 5 and more).

Defined cases: NULL and empty texts have no words and get the severity of the thresholds alone.
Labels that are NULL, or of a NULL id, are left out; of several labels of one id the highest
counts. With no labels, or labels of one grade only, every severity is 0 and nothing is toxic.
Repeated rows get equal results. Extra columns are ignored or, in `keep_clean`, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, written
from .words import mix, slices, word_hashes

LABELLED = 20_000
SELECTED = 2_000
LEAST_Z, LEAST_DOCS = 5.0, 5
BUCKET_BITS = 20
SLICE_BYTES = 1 << 20
GRADE_CUTS = (3, 5)
RIDGE, STEPS, RATE = 2e-5, 800, 0.1


class OrdinalModel:
    """Shared weights (by hash bucket) and ordered thresholds."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.buckets, self.weights, self.thresholds = buckets, weights, thresholds

    def parts(self) -> tuple:
        """Plain arrays, as they travel to the tasks."""
        return self.buckets, self.weights, self.thresholds

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, …"""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -700, 700)))

    def scores(self, column) -> np.ndarray:
        out = np.zeros(len(column))
        if not len(self.buckets):
            return out
        rows, words = bucket_pairs(column)
        at = np.minimum(np.searchsorted(self.buckets, words), len(self.buckets) - 1)
        known = self.buckets[at] == words
        return np.bincount(rows[known], self.weights[at[known]], minlength=len(column))


def bucket_pairs(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word that occurs in a row, once each."""
    hashes, bounds = word_hashes(column)
    rows = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    keys = np.unique((rows << np.uint64(BUCKET_BITS)) | (hashes >> np.uint64(64 - BUCKET_BITS)))
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    return (keys >> np.uint64(BUCKET_BITS)).astype(np.int64), (keys & mask).astype(np.int64)


def _near(words: np.ndarray) -> int:
    """Equal for most near copies: the three smallest of the words' mixed numbers."""
    least = np.sort(mix(words.astype(np.uint64) + np.uint64(1)))[:3]
    return int(np.bitwise_xor.reduce(least * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)) \
        if len(least) else 0


def _bags(batches):
    schema = pa.schema([("grade", pa.int32()), ("bag", pa.int64()),
                        ("words", pa.list_(pa.int32()))])
    for piece in slices(batches, "text", SLICE_BYTES):
        rows, words = bucket_pairs(piece.column("text"))
        marks = np.searchsorted(rows, np.arange(piece.num_rows + 1))
        lists = [words[a:b] for a, b in zip(marks[:-1], marks[1:])]
        yield pa.record_batch([piece.column("grade"), pa.array(map(_near, lists), pa.int64()),
                               pa.array([w.astype(np.int32) for w in lists],
                                        pa.list_(pa.int32()))], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, doc_id: str = "doc_id",
        text: str = "text", label_id: str = "doc_id", most: int = LABELLED,
        refine: bool = False) -> OrdinalModel:
    """Fit on at most `most` labelled documents; `refine` grades labels of 0 and 1."""
    empty = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    drawn = (labels.select(F.col(label_id).alias("_id"), grade.cast("int").alias("grade"))
             .where("_id is not null and grade >= 0").groupBy("_id")
             .agg(F.max("grade").alias("grade"))
             .orderBy(F.xxhash64("_id"), "_id").limit(most))
    texts = modest_batches(docs).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    bags = (texts.join(F.broadcast(drawn), "_id").select("grade", "text")
            .mapInArrow(_bags, "grade int, bag bigint, words array<int>"))
    bags = written(bags.groupBy("bag", "grade").agg(F.min("words").alias("words")), "bags")
    sizes = {r.grade: r.n for r in bags.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return empty
    grades = np.arange(max(sizes) + 1)
    total = sum(sizes.values())

    chance = F.lit(0.0)
    for k in grades[1:]:
        high = sum(n for g, n in sizes.items() if g >= k)
        if not 0 < high < total:
            continue
        a = F.sum((F.col("grade") >= int(k)).cast("int"))
        share = F.count("*") / total
        spread = F.sqrt(share * (1 - share) * (1 / high + 1 / (total - high)))
        z = (a / high - (F.count("*") - a) / (total - high)) / F.greatest(spread, F.lit(1e-9))
        chance = F.when(F.abs(z) > F.abs(chance), z).otherwise(chance)
    strong = (bags.select("grade", F.explode("words").alias("bucket")).groupBy("bucket")
              .agg(F.count("*").alias("n"), chance.alias("z"))
              .where((F.col("n") >= LEAST_DOCS) & (F.abs("z") >= LEAST_Z))
              .orderBy(F.desc(F.abs("z")), "bucket").limit(SELECTED).collect())
    if not strong:
        return empty
    buckets = np.array(sorted(r.bucket for r in strong), np.int64)
    listed = lambda values: F.expr(f"array({', '.join(map(str, values))})")
    evidence = listed([r.bucket for r in strong if r.z > 0])
    found = F.size(F.array_intersect("words", evidence))
    grade = F.col("grade")
    if refine:
        grade = F.when(grade > 0, 1 + sum((found >= c).cast("int") for c in GRADE_CUTS)) \
            .otherwise(0)
    rows = bags.select(grade.alias("grade"),
                       F.array_intersect("words", listed(buckets)).alias("words"))
    rows = rows.toArrow()                                     # at most `most` short rows
    y = rows.column("grade").to_numpy()
    grades = np.arange(int(y.max()) + 1)
    lists = rows.column("words").combine_chunks()
    marks = lists.offsets.to_numpy()
    column = np.searchsorted(buckets, lists.values.to_numpy()[marks[0]:marks[-1]])
    row = np.repeat(np.arange(len(y)), np.diff(marks))
    # sums of equal rows in any order differ in the last digits: put rows in one order
    keys = [(int(g), tuple(column[marks[i] - marks[0]:marks[i + 1] - marks[0]].tolist()))
            for i, g in enumerate(y)]
    place = np.empty(len(y), np.int64)
    place[sorted(range(len(y)), key=keys.__getitem__)] = np.arange(len(y))
    order = np.argsort(place[row], kind="stable")
    row, column = place[row][order], column[order]
    y = y[np.argsort(place)]
    weights, thresholds = _descend(row, column, y, len(buckets), int(grades[-1]))
    return OrdinalModel(buckets, weights, thresholds)


def _descend(row, column, y, n_words: int, n_thresholds: int):
    """Minimise the penalised cumulative-link loss by Adam steps.

    Thresholds are a first value and positive gaps, so that they stay in order.
    """
    n = len(y)
    at_least = y[:, None] >= np.arange(1, n_thresholds + 1)[None, :]
    share = np.clip(at_least.mean(axis=0), 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    p = np.concatenate([np.zeros(n_words), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigma = lambda x: 1 / (1 + np.exp(np.clip(-x, -700, 700)))
    for step in range(1, STEPS + 1):
        w, first, gap = p[:n_words], p[n_words], np.exp(p[n_words + 1:])
        theta = first + np.concatenate([[0], np.cumsum(gap)])
        score = np.bincount(row, w[column], minlength=n)
        reach = sigma(score[:, None] - theta[None, :])        # P(grade >= k)
        edge = np.concatenate([np.ones((n, 1)), reach, np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        up, down = edge[rows, y], edge[rows, y + 1]
        chance = np.maximum(up - down, 1e-12)
        slope = edge * (1 - edge)
        g_up, g_down = slope[rows, y] / chance, slope[rows, y + 1] / chance
        g_score = -(g_up - g_down) / n
        g_theta = np.zeros(n_thresholds + 2)
        np.add.at(g_theta, y, g_up / n)
        np.add.at(g_theta, y + 1, -g_down / n)
        g_theta = g_theta[1:-1]
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(column, g_score[row], minlength=n_words) + RIDGE * w,
                               tail[:1], tail[1:] * gap])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    theta = p[n_words] + np.concatenate([[0], np.cumsum(np.exp(p[n_words + 1:]))])
    return p[:n_words], theta


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """doc_id, expected severity, most likely lowest grade reached, and the toxic verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        model = OrdinalModel(*shared.value)
        for piece in slices(batches, "text", SLICE_BYTES):
            chances = model.chances(model.scores(piece.column("text")))
            toxic = chances[:, 0] >= 0.5 if chances.shape[1] else np.zeros(len(chances), bool)
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(chances.sum(axis=1)),
                 pa.array((chances >= 0.5).sum(axis=1).astype(np.int32)), pa.array(toxic)],
                ["doc_id", "severity", "grade", "toxic"])

    rows = modest_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        model = OrdinalModel(*shared.value)
        for piece in slices(batches, text, SLICE_BYTES):
            chances = model.chances(model.scores(piece.column(text)))
            if chances.shape[1]:
                piece = piece.filter(pa.array(chances[:, 0] < 0.5))
            yield piece

    return modest_batches(docs).mapInArrow(run, docs.schema)
