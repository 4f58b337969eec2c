"""URL verdicts: rules on host and path, and logistic regression where no rule fits.

The regression reads hashed character n-grams (3 to 5 bytes) of host and path. It is trained on
a small labelled table: at most `LABELLED` distinct urls, drawn by hash, with verdicts given
or, as in the registered query, taken from the rules that fit. Training runs on the driver
on that bounded table; judging is one pass without a shuffle.

Defined cases: a NULL url, or one without "://", has an empty host and path; it fits no rule
and gets the verdict of the regression's constant. Without labelled urls of both kinds the
regression allows (or blocks) everything like the labels it has, and allows without any.
Repeated rows get equal verdicts and count once in training. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import hash_spans, text_bytes

LABELLED = 4_000
BITS = 18
SIZES = (3, 4, 5)
STEPS, RATE, RIDGE = 200, 0.1, 1e-4

Rule = tuple[str, str]         # verdict, host and path in one string

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), upper,
                       upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule whose host is this one or above it and whose path begins this one."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def gram_pairs(host, path) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of both columns, once each."""
    rows, buckets = [], []
    for seed, (column, before, after) in enumerate(((host, "^", "$"), (path, "", "$"))):
        marked = pa.array([f"{before}{x}{after}" for x in column.to_pylist()], pa.string())
        raw, offsets = text_bytes(marked)
        row = np.repeat(np.arange(len(marked)), np.diff(offsets))
        for size in SIZES:
            starts = np.arange(max(0, len(raw) - size + 1))
            starts = starts[row[starts] == row[starts + size - 1]]
            if not len(starts):
                continue
            codes = hash_spans(raw, starts, starts + size, fold=False)
            codes = (codes ^ np.uint64(seed * 0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            rows.append(row[starts])
            buckets.append(codes.astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.unique((np.concatenate(rows) << BITS) | np.concatenate(buckets))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def scores(host, path, weights: np.ndarray, constant: float) -> np.ndarray:
    row, bucket = gram_pairs(host, path)
    norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(host)), 1))
    return constant + np.bincount(row, weights[bucket], minlength=len(host)) / norm


def fit(labelled: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and constant from (host, path, verdict) rows; positive scores mean block."""
    rows = (labelled.where("verdict in ('block', 'allow')").select("host", "path", "verdict")
            .distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "verdict")
            .limit(most).toArrow())
    weights = np.zeros(1 << BITS, np.float64)
    y = np.array([v == "block" for v in rows.column("verdict").to_pylist()], float)
    if not len(y):
        return weights, -1.0
    if y.min() == y.max():
        return weights, 1.0 if y[0] else -1.0
    host, path = (rows.column(n).combine_chunks() for n in ("host", "path"))
    row, bucket = gram_pairs(host, path)
    used, column = np.unique(bucket, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))[row]
    w, constant = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        score = constant + np.bincount(row, w[column] * value, minlength=len(y))
        error = (1 / (1 + np.exp(-score)) - y) / len(y)
        grad = np.append(np.bincount(column, error[row] * value, minlength=len(w)) + RIDGE * w,
                         error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, constant = w - move[:-1], constant - float(move[-1])
    weights[used] = w
    return weights, constant


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None,
          page_id: str = "page_id", url: str = "url", most: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, and the score of the regression.

    `labelled` has host, path and verdict; without it the rules label the pages they fit.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    ruled = _verdict(F.col("rule"), rules)
    if labelled is None:
        labelled = rows.where("rule is not null").withColumn("verdict", ruled)
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled, most))

    def run(batches):
        weights, constant = shared.value
        for batch in batches:
            made = scores(batch.column("host"), batch.column("path"), weights, constant)
            yield pa.record_batch([*batch.columns, pa.array(made)],
                                  [*batch.schema.names, "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    judged = rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, "
                                  "score double")
    learned = F.when(F.col("score") >= 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce(ruled, learned).alias("verdict"), "score")
