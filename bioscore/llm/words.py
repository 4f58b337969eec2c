"""Words of Arrow text columns as NumPy arrays, without a Python loop over words.

Works on the UTF-8 bytes of a batch. Memory beside the text itself is bounded: masks take
a few bytes per byte of text, and words are hashed in groups of 256 KB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18

_mixed = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _mixed.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(int(_mixed.integers(1, 1 << 63)) | 1)
GRAM_STEP = np.uint64(int(_mixed.integers(1, 1 << 63)) | 1)

# Digits, ASCII letters and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[ord("0"):ord("9") + 1] = True
WORD_BYTES[ord("A"):ord("Z") + 1] = True
WORD_BYTES[ord("a"):ord("z") + 1] = True
WORD_BYTES[128:] = True

# Everything but ASCII white space.
INK_BYTES = np.ones(256, bool)
INK_BYTES[[9, 10, 11, 12, 13, 32]] = False

FOLDED = np.arange(256)
FOLDED[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, marks, data = column.buffers()
    offsets = np.frombuffer(marks, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Start and end byte of each maximal run of member bytes inside a row."""
    inside = member[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    joined = inside[1:] & inside[:-1]
    joined[cut - 1] = False
    first[1:] &= ~joined
    last[:-1] &= ~joined
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               fold: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; with `fold` A-Z count as a-z."""
    codes = BYTE_CODES[FOLDED] if fold else BYTE_CODES
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + GROUP_BYTES, "right")) - 1)
        size = lengths[at:to]
        begin = total[at:to] - total[at]
        place = np.arange(total[to] - total[at]) - np.repeat(begin, size)
        power = np.ones(int(size.max()), np.uint64)
        power[1:] = STEP
        power = np.cumprod(power)
        values = codes[raw[place + np.repeat(starts[at:to], size)]] * power[place]
        out[at:to] = np.add.reduceat(values, begin)
        at = to
    return mix(out + lengths.astype(np.uint64))


def word_hashes(column, member: np.ndarray = WORD_BYTES, fold: bool = True):
    """Hash of each word of a column, and where the words of each row begin."""
    raw, offsets = text_bytes(column)
    starts, ends = word_spans(raw, offsets, member)
    return hash_spans(raw, starts, ends, fold), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, bounds: np.ndarray, width: int):
    """Hash of every run of `width` words of a row, and where those of each row begin.

    A row of fewer words, but not none, has one run of all its words.
    """
    counts = np.diff(bounds)
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(counts)), per_row)
    start = bounds[:-1][row] + np.arange(first[-1]) - first[row]
    end = np.minimum(start + width, bounds[1:][row])
    out = np.zeros(len(start), np.uint64)
    for k in range(width):
        there = start + k < end
        at = np.where(there, start + k, 0)
        out = np.where(there, out * GRAM_STEP + hashes[at], out) if len(hashes) else out
    return mix(out), first


def slices(batches: Iterator[pa.RecordBatch], column: str,
           most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches joined or cut to about `most_bytes` of text; a longer row is alone."""
    held, size = [], 0
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            room = max(most_bytes - size, 0)
            to = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
            to = min(max(to, at + (not held)), batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
            if to < batch.num_rows:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
            at = to
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]
