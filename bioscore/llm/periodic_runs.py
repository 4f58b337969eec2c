"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least max(6, 4q) long, that no neighbour
extends with period q. For every power of two 2^k the factors of that length get names: equal
names are equal factors. A name of level k is the pair of level k-1 names of its halves.

Inside a run of period q, with 2^(k-1) < q <= 2^k, the next occurrence of each level k factor
lies exactly q further on: a nearer one would give the run a smaller period. So successors at
a constant distance form an arithmetic progression, and a maximal stretch of positions whose
successor lies q further on proposes a run of period q; words before and after extend it.
Distances up to twice the length are looked at; those above 2^k come again, exactly, on the
next level, so every run is kept once.

A factor whose half occurs once in its text occurs once itself, so each level only names
positions whose halves recur. In ordinary text few are left after three levels.

Defined cases: NULL is a text of no words. Rows that repeat get equal results. Texts of any
length are handled whole: a level needs some tens of bytes a word that recurs. With
`repeat_tails` a NULL id leaves its text as it is. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import modest_batches

LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_BYTES = 1 << 20
RESULT = ("doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, "
          "period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys, and equal numbers for equal keys in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.cumsum(new) - 1


def _stretches(at: np.ndarray, gap: np.ndarray):
    """First and last of each maximal run of consecutive positions with one gap."""
    if not len(at):
        return at, at, gap
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(gap) != 0)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(at)]]) - 1
    return at[first], at[last], gap[first]


def find_runs(names: np.ndarray, bounds: np.ndarray):
    """(start, end, period) of all runs of all rows, by start, then period.

    `names` tells words apart; row i has the words bounds[i] … bounds[i+1].
    """
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][row]
    at = np.flatnonzero(np.diff(bounds)[row] >= LEAST_WORDS)
    found, size = [], 1
    with np.errstate(over="ignore"):
        keys = words.mix(names[at] + row[at].astype(np.uint64) * words.GRAM_STEP)
    dense = np.zeros(len(names), np.int64)       # name of the factor that starts here, 0: none
    kept = at[:0]
    while len(at):
        order, rank = _ranks(keys)
        place = at[order]
        same = rank[1:] == rank[:-1]
        gap = np.where(same, place[1:] - place[:-1], 0)
        near = np.flatnonzero((gap > 0) & (gap <= 2 * size))
        start, step = place[near], gap[near]
        by_place = np.argsort(start, kind="stable")
        first, last, period = _stretches(start[by_place], step[by_place])
        end = last + period + size
        long = (period <= size) & (end - first >= np.maximum(LEAST_PERIODS * period, LEAST_WORDS))
        found.append(np.stack([first[long], end[long], period[long]]))

        recurs = np.zeros(len(place), bool)
        recurs[1:] |= same
        recurs[:-1] |= same
        dense[kept] = 0
        kept = np.sort(place[recurs])
        dense[place[recurs]] = rank[recurs] + 1
        size *= 2
        ahead = kept[kept + size <= ends[kept]]
        ahead = ahead[(ends[ahead] - bounds[row[ahead]]) > 2 * size]
        at = ahead[dense[ahead + size // 2] > 0]
        keys = dense[at] * (len(place) + 1) + dense[at + size // 2]
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    if not len(start):
        return np.zeros((3, 0), np.int64)
    start, end = _extended(names, bounds, row, start, end, period)
    runs = np.unique(np.stack([start, end, period]), axis=1)
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _extended(names, bounds, row, start, end, period):
    """The stretches made as long as their period holds inside the row."""
    low, high = bounds[:-1][row[start]], bounds[1:][row[start]]
    while True:
        left = (start > low) & (names[start - 1] == names[start - 1 + period])
        inner = np.minimum(end, len(names) - 1)
        right = (end < high) & (names[inner] == names[inner - period])
        if not (left.any() or right.any()):
            return start, end
        start, end = start - left, end + right


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.add.at(edge, runs[1], -1)
    return np.cumsum(edge[:-1]) > 0


def tails(ids: list, bounds: np.ndarray) -> np.ndarray:
    """Which word stands at each place once the tails of a tenth of the texts repeat."""
    place = np.arange(bounds[-1])
    for i, doc_id in enumerate(ids):
        begin, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        if doc_id is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if not rest:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place[begin + a:begin + n] = begin + a + np.arange(n - a) % p
    return place


def _sums(raw, starts, ends, kept, bounds) -> list[str]:
    """SHA-256 of the kept words of each row, joined by one space."""
    kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    starts, sizes = starts[kept], (ends - starts)[kept] + 1
    after = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(after[-1]) + np.repeat(starts - after[:-1], sizes)
    out = raw[np.minimum(place, max(len(raw) - 1, 0))] if len(raw) else np.zeros(0, np.uint8)
    out[after[1:] - 1] = 32
    data = memoryview(out.tobytes())
    marks = after[kept_bounds]
    return [hashlib.sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in zip(marks[:-1], marks[1:])]


def _described(repeat_tails: bool):
    def run(batches):
        for batch in words.slices(batches, "text", SLICE_BYTES):
            raw, offsets = words.text_bytes(batch.column("text"))
            starts, ends = words.word_spans(raw, offsets, words.INK_BYTES)
            bounds = np.searchsorted(starts, offsets)
            ids = batch.column("doc_id").to_pylist()
            names = words.hash_spans(raw, starts, ends, fold=False)
            if repeat_tails:
                place = tails(ids, bounds)
                names, starts, ends = names[place], starts[place], ends[place]
            runs = find_runs(names, bounds)
            cuts = np.searchsorted(runs[0], bounds)
            sums = _sums(raw, starts, ends, ~_dropped(runs, len(names)), bounds)
            out = []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                n = int(bounds[i + 1] - bounds[i])
                own = runs[:, a:b] - np.array([[bounds[i]], [bounds[i]], [0]])
                lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in own.T.tolist())
                most = [None] * 4
                if b > a:
                    k = int(np.argmax(own[1] - own[0]))
                    s, e, q = own[:, k].tolist()
                    most = [s, e - s, q, 1000 * (e - s) // q]
                out.append((ids[i], n, int(b - a), *most,
                            hashlib.sha256(lines.encode()).hexdigest(), sums[i]))
            yield pa.record_batch(
                [pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in enumerate(zip(*out))]
                if out else [pa.array([], pa.string() if k > 6 else pa.int64()) for k in range(9)],
                names=[f.split()[0] for f in RESULT.split(", ")])
    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  repeat_tails: bool = False) -> DataFrame:
    """Per row: number of runs, the longest one, and digests of all runs and of the words left.

    With `repeat_tails`, the tail of every tenth text (by CRC-32 of its id) is first replaced by
    repetitions of its beginning.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return modest_batches(rows).mapInArrow(_described(repeat_tails), RESULT)
