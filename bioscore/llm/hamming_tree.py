"""Near duplicates by SimHash fingerprints, found with vantage-point trees.

A fingerprint has the bits that are set in over half of the XXH64 values (seed 42) of a text's
three-word shingles. Two fingerprints link when at most two bits differ.

Equal fingerprints are one point. A tree over a sample of the points gives the shards: a node
has a vantage point and a radius, points within the radius go left, the others right. A link
across the radius is never lost: by the triangle inequality its left end is less than two bits
inside, so such points also visit the right side, and visitors go on to every side that a
point within two bits of them can be in. Each shard is then cut further by trees of its own
points in the same way; only in leaves are fingerprints compared with each other. A shard
returns a forest of its links, never all pairs, and the forests join to components.

The sample only decides where the radii lie, not what is found. It has SAMPLE points for each
shard of SHARD points, and MOST_SHARDS bounds both; larger tables get larger shards.

Defined cases: a text without words (NULL, empty, only white space) has fingerprint zero and
links like any other; fewer than three words are one shingle. Rows that repeat get the same
result each. A NULL id has a fingerprint and a component, but is never the smallest id.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import lookup
from . import words
from .components import components
from .shared import modest_batches, written

SEED = 42
SHINGLE = 3
BITS = 2
SHARD = 8192
SAMPLE = 16
MOST_SHARDS = 65_536
LEAF = 256
CANDIDATES = 12
SLICE_BYTES = 1 << 19
ROUTED = 1 << 16
LONG_SHINGLE = 256

# Fixed values of XXH64.
PRIME_1 = np.uint64(11400714785074694791)
PRIME_2 = np.uint64(14029467366897019727)
PRIME_3 = np.uint64(1609587929392839161)
PRIME_4 = np.uint64(9650029242287828579)
PRIME_5 = np.uint64(2870177450012600261)

_LANES = np.uint64(0x0101010101010101)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state, lane: np.ndarray) -> np.ndarray:
    return _turn(state + lane * PRIME_2, 31) * PRIME_1


def _same_length(raw: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of spans of one length; `raw` has 8 more bytes than any span needs."""
    wide = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    half = np.ndarray((len(raw) - 3,), "<u4", buffer=raw, strides=(1,))
    seed, at = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if length >= 32:
            state = [np.full(len(starts), seed + PRIME_1 + PRIME_2), np.full(len(starts), seed + PRIME_2),
                     np.full(len(starts), seed), np.full(len(starts), seed - PRIME_1)]
            while at + 32 <= length:
                for k in range(4):
                    state[k] = _round(state[k], wide[starts + (at + 8 * k)])
                at += 32
            h = _turn(state[0], 1) + _turn(state[1], 7) + _turn(state[2], 12) + _turn(state[3], 18)
            for s in state:
                h = (h ^ _round(np.uint64(0), s)) * PRIME_1 + PRIME_4
        else:
            h = np.full(len(starts), seed + PRIME_5)
        h = h + np.uint64(length)
        while at + 8 <= length:
            h = _turn(h ^ _round(np.uint64(0), wide[starts + at]), 27) * PRIME_1 + PRIME_4
            at += 8
        if at + 4 <= length:
            h = _turn(h ^ (half[starts + at].astype(np.uint64) * PRIME_1), 23) * PRIME_2 + PRIME_3
            at += 4
        for at in range(at, length):
            h = _turn(h ^ (raw[starts + at].astype(np.uint64) * PRIME_5), 11) * PRIME_1
        h = (h ^ (h >> np.uint64(33))) * PRIME_2
        h = (h ^ (h >> np.uint64(29))) * PRIME_3
        return h ^ (h >> np.uint64(32))


def xxh64(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of `raw`, spans of equal length at a time."""
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(starts), np.uint64)
    short = np.minimum(lengths, LONG_SHINGLE).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    bounds = np.searchsorted(short[order], np.arange(LONG_SHINGLE + 1))
    for length in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[length]:bounds[length + 1]]
        out[own] = _same_length(raw, starts[own], int(length), seed)
    for i in order[bounds[LONG_SHINGLE]:]:
        span = raw[starts[i]:starts[i] + lengths[i]]
        out[i] = xxhash.xxh64_intdigest(span.tobytes(), seed)
    return out


def _joined(column):
    """Lower-cased bytes with one space after each word, word ends, words before each row."""
    raw, offsets = words.text_bytes(column)
    starts, ends = words.word_spans(raw, offsets, words.INK_BYTES)
    sizes = ends - starts + 1
    after = np.cumsum(sizes)
    if not len(starts):
        return np.zeros(0, np.uint8), after, sizes, np.searchsorted(starts, offsets)
    place = np.arange(after[-1]) + np.repeat(starts - (after - sizes), sizes)
    out = words.FOLDED.astype(np.uint8)[raw[np.minimum(place, len(raw) - 1)]]
    out[after - 1] = 32
    return out, after, sizes, np.searchsorted(starts, offsets)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row, the bits set in over half of its hashes; zero where it has none.

    Eight counters of a byte share a word, so at most 255 hashes are added before they part.
    """
    out = np.zeros(len(counts), np.uint64)
    held = np.flatnonzero(counts)
    if not len(held):
        return out
    counts = counts[held]
    parts = -(-counts // 255)
    begin = np.cumsum(counts) - counts
    first = np.cumsum(parts) - parts
    blocks = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, blocks)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            most = 2 * ones[:, byte] > counts
            out[held] |= most.astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def simhash(column, width: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text of an Arrow column."""
    raw, after, sizes, bounds = _joined(column)
    n_words = np.diff(bounds)
    per_row = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(n_words)), per_row)
    first = bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    last = np.minimum(first + width, bounds[1:][row]) - 1
    starts = (after - sizes)[first] if len(first) else np.zeros(0, np.int64)
    ends = after[last] - 1 if len(first) else starts
    return _majority(xxh64(raw, starts, ends - starts), per_row)


def _printer(batches):
    for batch in words.slices(batches, "text", SLICE_BYTES):
        prints = simhash(batch.column("text")).view(np.int64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.int64())],
                              names=["doc_id", "point"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, point): the fingerprint of every row as a signed 64-bit number."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return modest_batches(rows).mapInArrow(_printer, "doc_id bigint, point bigint")


def _distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def choose(points: np.ndarray, bits: int):
    """A vantage point and radius that part the points with few of them near the radius.

    None where no radius leaves an eighth of the points on either side.
    """
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, CANDIDATES).astype(np.int64)]:
        counts = np.bincount(_distance(points, vantage), minlength=66)
        inside = np.cumsum(counts)
        smaller = np.minimum(inside, len(points) - inside)
        near = inside[np.minimum(np.arange(66) + bits, 65)] - np.where(
            np.arange(66) >= bits, inside[np.arange(66) - bits], 0)
        share = smaller / len(points)
        gain = -(share * np.log2(np.maximum(share, 1e-9)) + (1 - share) * np.log2(1 - share))
        cost = np.where(smaller * 8 >= len(points), near / len(points) / np.maximum(gain, 1e-9), np.inf)
        radius = int(np.argmin(cost))
        if cost[radius] < np.inf and (best is None or cost[radius] < best[0]):
            best = cost[radius], vantage, radius
    return best and best[1:]


def part(points, homes, visitors, vantage, radius: int, bits: int):
    """(homes, visitors) of the inside and of the outside of a radius, as row numbers.

    Homes just inside visit the outside; the links of homes outside to them are found there.
    """
    own, other = _distance(points[homes], vantage), _distance(points[visitors], vantage)
    inside = (homes[own <= radius], visitors[other <= radius + bits])
    over = homes[(own <= radius) & (own.astype(np.int64) > radius - bits)]
    outside = (homes[own > radius],
               np.concatenate([visitors[other.astype(np.int64) > radius - bits], over]))
    return inside, outside


class ShardTree:
    """Vantage points and radii over a sample; leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, shards: int, bits: int = BITS):
        self.bits, self.nodes, self.shards = bits, [], 0
        least = max(2, len(sample) // max(shards, 1))
        waiting = [(sample, None)]
        while waiting:
            points, link = waiting.pop()
            rule = choose(points, bits) if len(points) >= 2 * least else None
            if rule is None:
                at, self.shards = -1 - self.shards, self.shards + 1
            else:
                at = len(self.nodes)
                self.nodes.append([*rule, 0, 0])
                inside = _distance(points, rule[0]) <= rule[1]
                waiting += [(points[inside], (at, 2)), (points[~inside], (at, 3))]
            if link:
                self.nodes[link[0]][link[1]] = at

    def routes(self, points: np.ndarray):
        """(shard, homes, visitors) for the shards that some of the points belong to."""
        waiting = [(0 if self.nodes else -1, np.arange(len(points)), np.zeros(0, np.int64))]
        while waiting:
            at, homes, visitors = waiting.pop()
            if not len(homes) + len(visitors):
                continue
            if at < 0:
                yield -1 - at, homes, visitors
                continue
            vantage, radius, left, right = self.nodes[at]
            inside, outside = part(points, homes, visitors, vantage, radius, self.bits)
            waiting += [(left, *inside), (right, *outside)]


def _gathered(batches):
    """Points of the batches, ROUTED of them at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column("point").to_numpy().view(np.uint64))
        size += batch.num_rows
        if size >= ROUTED:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _router(tree):
    def run(batches):
        for points in _gathered(batches):
            for shard, homes, visitors in tree.value.routes(points):
                rows = np.concatenate([homes, visitors])
                yield pa.record_batch(
                    [pa.array(np.full(len(rows), shard), pa.int32()),
                     pa.array(np.arange(len(rows)) < len(homes)),
                     pa.array(points[rows].view(np.int64))], names=["shard", "home", "point"])
    return run


def _join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs; `roots` holds the smallest member of each set."""
    while len(a):
        a, b = roots[a], roots[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(roots, a, b)
        while (deeper := roots[roots] != roots).any():
            roots[deeper] = roots[roots[deeper]]


def forest(points: np.ndarray, n_homes: int, bits: int = BITS) -> np.ndarray:
    """Smallest row linked to each row by links that have an end among the first `n_homes`."""
    roots = np.arange(len(points))
    waiting = [(np.arange(n_homes), np.arange(n_homes, len(points)))]
    while waiting:
        homes, visitors = waiting.pop()
        rule = choose(points[homes], bits) if len(homes) > LEAF else None
        if rule is not None:
            waiting += part(points, homes, visitors, *rule, bits)
            continue
        for at in range(0, len(homes), LEAF):
            own = homes[at:at + LEAF]
            for others in (homes[at:], visitors):
                for start in range(0, len(others), 16 * LEAF):
                    theirs = others[start:start + 16 * LEAF]
                    near = np.bitwise_count(points[own][:, None] ^ points[theirs]) <= bits
                    i, j = np.nonzero(near)
                    _join(roots, own[i], theirs[j])
    return roots


def _linked(bits: int):
    def run(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        points = table.column("point").to_numpy()
        points = np.concatenate([points[home], points[~home]])
        roots = forest(points.view(np.uint64), int(home.sum()), bits)
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"u": points[child], "v": points[roots[child]]})
    return run


def links(points: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(u, v) whose components are those of all pairs of points with at most `bits` apart.

    `points` holds each fingerprint once, in column `point`.
    """
    spark, n = points.sparkSession, points.count()
    shards = min(MOST_SHARDS, math.ceil(n / shard) or 1)
    share = min(1.0, shards * SAMPLE / max(n, 1))
    sample = points.where(F.abs(F.xxhash64("point", F.lit("sample")) / F.lit(2.0 ** 63)) <= share) \
        if shards > 1 else points.limit(0)
    sample = np.sort(np.array([r[0] for r in sample.collect()], np.int64)).view(np.uint64)
    tree = ShardTree(sample, shards, bits)
    rows = points.mapInArrow(_router(spark.sparkContext.broadcast(tree)),
                             "shard int, home boolean, point bigint")
    return rows.repartition(tree.shards, "shard").groupBy("shard").applyInArrow(
        _linked(bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component's smallest id."""
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    points = written(rows.groupBy("point").agg(F.min("doc_id").alias("first")), "points")
    roots = components(links(points.select("point"), bits, shard), "linked")
    members = points.join(roots.withColumnRenamed("node", "point"), "point", "left").select(
        "point", "first", F.coalesce("root", "point").alias("root"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup(members.select("point", "root"), least, "root",
                   F.pmod(F.xxhash64("point"), F.lit(64))).select("point", "component_id")
    found = lookup(rows, named, "point", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("point")), 16, "0").alias("fingerprint"),
                        "component_id")
