"""Best-fit packing of tokenised documents by linear grouping.

1. Documents become pieces of at most `capacity` tokens (ids plus one end mark).
2. Large pieces (over `capacity // 4`) are ranked by length and cut into groups of equal
   cardinality; every group is rounded up to its longest piece. The few rounded sizes are
   packed as configurations with multiplicities: fill the largest size left with the one or
   two sizes that waste least, again and again.
3. Actual pieces take the slots of their group by rank, which leaves a little room.
4. Small pieces go, longest first, to the sequences with the least room that suffices; new
   sequences are opened only where none fits.

Plans are made on the driver from histograms of lengths and of free room, whose size is
bounded by the capacity, never by the number of documents. They come back as runs ("ranks a to
b go to sequences from c on"), so every piece finds its place by its rank. Ranks are counted
per (length, block of rows); a length that a third of all documents share stays spread.

Word ids are looked up by the hash of each white-space delimited chunk in a bounded cache per
worker; the tokenizer sees each new chunk once (its rules never cross white space).

Defined cases: a NULL or empty text is one piece with the end mark only. Rows that repeat an
id, or have none, are packed like any other row. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import positions_within
from .shared import modest_batches, written
from .words import INK_BYTES, hash_spans, slices, text_bytes, word_spans

CAPACITY, END_ID = 4096, 1
GROUPS = 4096
CACHED_CHUNKS = 1_000_000
SLICE_BYTES = 2 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cuts() -> np.ndarray:
    kinds = np.zeros(256, np.int8)
    for c in map(chr, range(33, 127)):
        kinds[ord(c)] = 1 if c.isalnum() else (0 if c == "'" else 2)
    return kinds


# 1 letter or digit, 2 other sign, both ASCII; the tokenizer always cuts between 1 and 2
CUT_KINDS = _cuts()


class Encoder:
    """Token ids of a text column, chunk by chunk through a bounded cache.

    Chunks are parted by white space and between ASCII letters and signs, where the rules of
    the tokenizer always cut. The cache holds sorted chunk hashes with their ids.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.table = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has."""
        words = np.array([c.isalpha() for c in chunks], bool)
        counts = np.zeros(len(chunks), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, where in ((True, np.flatnonzero(words)), (False, np.flatnonzero(~words))):
            for at in range(0, len(where), 2000):
                part = where[at:at + 2000]
                own = [chunks[i] for i in part]
                ids = None
                if kind:      # one word is one run of letters; its last token ends a word
                    made = self.tokenizer.encode_batch_fast([" ".join(own)],
                                                            add_special_tokens=False)
                    ids = np.array(made[0].ids, "<u4")
                    last = np.flatnonzero(self.ends[ids])
                    size = np.diff(last, prepend=-1)
                    ids = ids if len(size) == len(own) else None
                if ids is None:
                    made = self.tokenizer.encode_batch_fast(own, add_special_tokens=False)
                    size = np.array([len(m.ids) for m in made], np.int64)
                    ids = np.array([i for m in made for i in m.ids], "<u4")
                counts[part] = size
                parts.append((part, ids))
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        for part, ids in parts:
            out[_ranges(begin[part], counts[part])] = ids
        return out, counts

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, and where those of each row begin."""
        raw, offsets = text_bytes(column)
        starts, ends = word_spans(raw, offsets, INK_BYTES)
        special = bool(((raw[:-1] == 60) & (raw[1:] == 124)).any())      # "<|"
        if not special:
            kinds = CUT_KINDS[raw]
            cut = np.flatnonzero(kinds[:-1] + kinds[1:] == 3) + 1
            cut = cut[kinds[cut] * kinds[cut - 1] == 2]
            mark = np.zeros(len(raw) + 1, bool)
            mark[starts] = mark[cut] = True
            starts = np.flatnonzero(mark)
            mark[:] = False
            mark[ends] = mark[cut] = True
            ends = np.flatnonzero(mark)
        keys, first, inverse = np.unique(hash_spans(raw, starts, ends, fold=not special),
                                         return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(self.keys) + len(new) > CACHED_CHUNKS and len(self.keys):
            self.forget()
            new = np.arange(len(keys))
        return self._add(raw, starts, ends, keys, first, new, inverse, offsets)

    def _add(self, raw, starts, ends, keys, first, new, inverse, offsets):
        if len(new):
            chunks = [raw[a:b].tobytes().decode("utf-8", "replace")
                      for a, b in zip(starts[first[new]], ends[first[new]])]
            made, size = self.encode(chunks)
            place = np.searchsorted(self.keys, keys[new])
            self.begin = np.insert(self.begin, place, len(self.table) + np.cumsum(size) - size)
            self.keys = np.insert(self.keys, place, keys[new])
            self.counts = np.insert(self.counts, place, size)
            self.table = np.concatenate([self.table, made])
        at = np.searchsorted(self.keys, keys)[inverse]
        size = self.counts[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.table[_ranges(self.begin[at], size)], total[np.searchsorted(starts, offsets)]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … for size[0] numbers, then those of the next range."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(int(total[-1]) if len(size) else 0)


def _pieces(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        import tokenizers
        kept = vars(tokenizers).setdefault("_kept_encoders", {})   # lives as long as the worker
        encoder = kept.get(path) or kept.setdefault(path, Encoder(path))
        for part in slices(batches, "text", SLICE_BYTES):
            ids, bounds = encoder.ids(part.column("text"))
            rows = []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                for k in range(0, len(own), capacity):
                    cut = own[k:k + capacity]
                    rows.append((doc, k // capacity, k, len(cut), zlib.crc32(cut.tobytes())))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                  schema=schema)
    return run


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    rows = modest_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity), PIECES)


def plan_large(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
    """Runs (first rank, number, first sequence) for pieces ranked by falling length.

    Also returns the number of sequences. Linear grouping: ranks g·card … g·card+card-1 form
    group g, rounded up to its first (longest) piece.
    """
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    number = np.array([counts[int(x)] for x in lengths], np.int64)
    total = int(number.sum())
    if not total:
        return np.zeros((0, 3), np.int64), 0
    card = -(-total // min(groups, total))
    heads = np.arange(0, total, card)
    size = lengths[np.searchsorted(np.cumsum(number), heads, "right")]
    left = np.minimum(card, total - heads)
    used = np.zeros(len(heads), np.int64)
    runs, sequences = [], 0
    while True:
        live = np.flatnonzero(left)
        if not len(live):
            return np.array(sorted(runs), np.int64), sequences
        pattern = {int(live[0]): 1}
        room = capacity - int(size[live[0]])
        while True:
            spare = left.copy()
            for g, q in pattern.items():
                spare[g] -= q
            fit = np.flatnonzero((spare > 0) & (size <= room))[::-1]      # rising sizes
            if not len(fit):
                break
            rising = size[fit]
            partner = np.searchsorted(rising, room - rising, "right") - 1
            both = np.where(partner >= 0, rising + rising[np.maximum(partner, 0)], 0)
            same = partner == np.arange(len(fit))
            both[same & (spare[fit] < 2)] = 0
            pick = int(np.argmax(both))
            chosen = [fit[pick], fit[partner[pick]]] if both[pick] > rising[-1] else [fit[-1]]
            for g in chosen:
                pattern[int(g)] = pattern.get(int(g), 0) + 1
                room -= int(size[g])
        times = min(int(left[g]) // q for g, q in pattern.items())
        for g, q in pattern.items():
            for k in range(q):
                runs.append((int(heads[g] + used[g]) + k * times, times, sequences))
            used[g] += q * times
            left[g] -= q * times
        sequences += times


def plan_small(counts: dict[int, int], room: dict[int, int], capacity: int = CAPACITY):
    """Best fit of small pieces, by falling length, into sequences with free room.

    Sequences are named by (free room at the start, rank among equals); new ones by room -1.
    Returns runs (length, first position, number, per sequence, room, first rank) and how many
    sequences were opened. All pieces of a length are placed class by class, which gives the
    same as one by one: a sequence just used has the least room again until none fits.
    """
    free: list[list] = [[] for _ in range(capacity + 1)]
    for r, n in room.items():
        free[int(r)].append((int(r), 0, int(n)))
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        for f in [f for f in range(length, capacity + 1) if free[f]]:
            kept = []
            for origin, low, high in free[f]:
                if not left:
                    kept.append((origin, low, high))
                    continue
                per = f // length
                full = min(high - low, left // per)
                if full:
                    runs.append((length, at, full * per, per, origin, low))
                    at, left = at + full * per, left - full * per
                    free[f - per * length].append((origin, low, low + full))
                    low += full
                if left and low < high:
                    runs.append((length, at, left, left, origin, low))
                    free[f - left * length].append((origin, low, low + 1))
                    at, left, low = at + left, 0, low + 1
                if low < high:
                    kept.append((origin, low, high))
            free[f] = kept
            if not left:
                break
        if left:
            per = capacity // length
            full, rest = left // per, left % per
            if full:
                runs.append((length, at, full * per, per, -1, opened))
                free[capacity - per * length].append((-1, opened, opened + full))
                at, opened = at + full * per, opened + full
            if rest:
                runs.append((length, at, rest, rest, -1, opened))
                free[capacity - rest * length].append((-1, opened, opened + 1))
                opened += 1
    return np.array(sorted(runs), np.int64).reshape(-1, 6), opened


def _mapped(df: DataFrame, plan: tuple, place, out: str) -> DataFrame:
    """Add columns that `place(plan, batch)` computes; the plan is bounded by the capacity."""
    shared = df.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for batch in batches:
            made = place(shared.value, batch)
            yield pa.record_batch([*batch.columns, *made.values()],
                                  [*batch.schema.names, *made])

    more = ", ".join(f"{n} bigint" for n in out.split())
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, {more}")


def _sequence_of_large(plan, batch):
    before, runs = plan
    rank = before[batch.column("length").to_numpy()] + batch.column("pos").to_numpy()
    run = np.searchsorted(runs[:, 0], rank, "right") - 1
    return {"seq": pa.array(runs[run, 2] + rank - runs[run, 0])}


def _sequence_of_bins(plan, batch):
    return {"sequence_id": pa.array(plan[0][batch.column("free").to_numpy()]
                                    + batch.column("bin").to_numpy())}


def _sequence_of_small(plan, batch):
    first, runs, total = plan
    length, pos = batch.column("length").to_numpy(), batch.column("pos").to_numpy()
    width = int(max(runs[:, 1].max(initial=0), pos.max(initial=0))) + 1
    run = np.searchsorted(runs[:, 0] * width + runs[:, 1], length * width + pos, "right") - 1
    _, at, _, per, room, low = runs[run].T
    bins = low + (pos - at) // per
    return {"sequence_id": pa.array(np.where(room < 0, total, first[room]) + bins)}


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces of at most `capacity`."""
    names = pieces.columns
    rows = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    ranked = written(positions_within(rows, "length", "rid", "pos"), "ranked")
    counts = {r.length: r.n for r in
              ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}   # <= capacity
    bound = capacity // 4

    large_counts = {k: n for k, n in counts.items() if k > bound}
    runs, _ = plan_large(large_counts, capacity, groups)
    before = np.zeros(capacity + 1, np.int64)
    at = 0
    for length in sorted(large_counts, reverse=True):
        before[length], at = at, at + large_counts[length]
    large = _mapped(ranked.where(F.col("length") > bound), (before, runs), _sequence_of_large, "seq")
    large = written(large, "large")
    bins = large.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("free"))
    bins = written(positions_within(bins, "free", "seq", "bin"), "bins")
    room = {r.free: r.n for r in bins.groupBy("free").agg(F.count("*").alias("n")).collect()}

    first = np.zeros(capacity + 1, np.int64)
    at = 0
    for free in sorted(room):
        first[free], at = at, at + room[free]
    small_counts = {k: n for k, n in counts.items() if k <= bound}
    runs, _ = plan_small(small_counts, room, capacity)
    named = _mapped(bins, (first,), _sequence_of_bins, "sequence_id")
    small = _mapped(ranked.where(F.col("length") <= bound), (first, runs, at),
                    _sequence_of_small, "sequence_id")
    placed = (large.join(named.select("seq", "sequence_id"), "seq")
              .select(*names, "rid", "sequence_id")
              .unionByName(small.select(*names, "rid", "sequence_id")))
    order = (Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rid")
             .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0))
                         .cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(pieces(docs, tokenizer, doc_id, text, capacity), capacity, groups)
