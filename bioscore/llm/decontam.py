"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of bounded size and sorts the word suffixes of a
shard (prefix doubling on word numbers). Every suffix of every benchmark item is then found in
the array by binary search: all places where a whole window of the item occurs, and the
longest verbatim match. Documents are neither shuffled nor joined.

Benchmark words travel to the tasks in blocks of at most `BLOCK_WORDS` words; a benchmark with
more words takes several passes, each with one block.

Defined cases: NULL and empty texts have no words, no hits, and are not contaminated. An item
without words has no window. A NULL item_id counts as an item named "null". Rows that are
equal give equal results; items repeated under one id count once. Extra columns of either
table are ignored or, in `remove_contaminated`, kept.
"""

from __future__ import annotations

import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import modest_batches, written
from .words import slices, word_hashes

WINDOW = 13
DEPTH = 16                     # words to which suffixes are sorted at least, a power of two
SHARD_BYTES = 2 << 20
SHARD_WORDS = 1 << 20          # a longer document is cut, with overlap, into more shards
BLOCK_WORDS = 2_000_000

REPORT = ("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
          "contaminated boolean, longest_match bigint, longest_at bigint, longest_item string")


def suffix_array(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of the word suffixes, sorted by their first `depth` words.

    `ids` are whole numbers from 1; 0 parts documents and ends every comparison.
    """
    rank = ids.astype(np.int64)
    width, n = 1, len(ids)
    order = np.argsort(rank, kind="stable")
    while width < depth:
        further = np.zeros(n, np.int64)
        further[:max(n - width, 0)] = rank[width:]
        further[rank == 0] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + further
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.diff(key[order]) != 0]) if n else np.zeros(0)
        new = np.cumsum(changed).astype(np.int64) + 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        rank[ids == 0] = 0
        width *= 2
        if n and new[-1] == n:
            break
    return order


def _ranges(text: np.ndarray, order: np.ndarray, query: np.ndarray, length: np.ndarray):
    """Interval of the array whose suffixes begin with each query (rows padded by -1)."""
    n = len(order)
    padded = np.concatenate([text, np.zeros(query.shape[1], text.dtype)])

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(query), np.int64), np.full(len(query), n, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) // 2
            suffix = order[np.minimum(middle, n - 1)]
            less = np.zeros(len(query), bool)
            same = np.ones(len(query), bool)
            for k in range(query.shape[1]):
                word = padded[suffix + k]
                used = k < length
                less |= same & used & (word < query[:, k])
                same &= ~used | (word == query[:, k])
                if not same.any():
                    break
            go = (less | same) if after else less
            low = np.where(open_ & go, middle + 1, low)
            high = np.where(open_ & ~go, middle, high)

    return bound(False), bound(True)


class Block:
    """Words of some benchmark items, as broadcast: bounded by BLOCK_WORDS."""

    def __init__(self, names: list[str], texts: list[str], width: int = WINDOW):
        hashes, bounds = word_hashes(pa.array(texts, pa.string()))
        self.words, inverse = np.unique(hashes, return_inverse=True)
        self.ids = inverse.astype(np.int64) + 1
        self.names = names
        counts = np.diff(bounds)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.left = np.repeat(bounds[1:], counts) - np.arange(len(hashes))
        # windows: every place with `width` words left; the first place of a shorter item
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
        self.window = np.where(self.left >= width, width,
                               np.where(place == 0, np.minimum(self.left, width), 0))


class _Found:
    """What the shards of one document add up to."""

    def __init__(self):
        self.items, self.longest, self.hit = set(), (0, -1, -1), []


def _shard(found: dict, block: Block, hashes: np.ndarray, bounds: np.ndarray, docs: np.ndarray,
           before: np.ndarray, width: int) -> None:
    """Search one shard; `before` words of each document stand in earlier shards."""
    at = np.searchsorted(block.words, hashes)
    at = np.minimum(at, len(block.words) - 1)
    known = block.words[at] == hashes
    # unknown words cannot be part of a match: like the ends of documents they are 0
    text = np.where(known, at + 1, 0)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(docs)), counts)
    # a 0 between documents
    text = np.insert(text, bounds[1:-1], 0)
    doc = np.insert(doc, bounds[1:-1], -1)
    place = np.concatenate([np.append(np.arange(c), -1) for c in counts])[:-1] \
        if len(counts) else np.zeros(0, np.int64)
    starts = np.flatnonzero(text)
    if not len(starts):
        return
    # Only suffixes that begin with a benchmark word can match; runs keep their order.
    runs = np.flatnonzero((text != 0) | np.append(text[1:] != 0, False))
    small, doc, place = text[runs], doc[runs], place[runs]
    order = suffix_array(small, max(DEPTH, width))
    use = np.flatnonzero(block.window > 0)
    source = np.concatenate([block.ids, np.zeros(width, np.int64)])
    query = source[use[:, None] + np.arange(width)]
    low, high = _ranges(small, order, query, block.window[use])
    hits = high - low
    which = np.repeat(np.arange(len(use)), hits)
    if not len(which):
        return
    rows = order[np.repeat(low, hits) + np.arange(len(which))
                 - np.repeat(np.cumsum(hits) - hits, hits)]
    length = block.window[use][which]
    # longest verbatim match: walk on from each window while the words agree
    reach, source_at = length.copy(), use[which]
    left = block.left[source_at]
    longer = np.concatenate([small, np.zeros(1, small.dtype)])
    open_ = np.flatnonzero(reach < left)
    while len(open_):
        there = np.minimum(rows[open_] + reach[open_], len(small))
        same = longer[there] == block.ids[source_at[open_] + reach[open_]]
        reach[open_[same]] += 1
        open_ = open_[same & (reach[open_] < left[open_])]
    sort = np.argsort(doc[rows], kind="stable")
    where = doc[rows][sort]
    cuts = np.flatnonzero(np.diff(where)) + 1
    for part in np.split(sort, cuts):
        d = int(doc[rows[part[0]]])
        entry = found.setdefault(int(docs[d]), _Found())
        shift = int(before[d])
        entry.items.update(block.item[source_at[part]].tolist())
        begin = place[rows[part]] + shift
        best = part[np.lexsort((begin, -reach[part]))[0]]
        candidate = (int(reach[best]), int(place[rows[best]]) + shift, int(source_at[best]))
        if candidate[0] > entry.longest[0]:
            entry.longest = candidate
        # hits as merged spans
        order_ = np.argsort(begin, kind="stable")
        b, e = begin[order_], (begin + length[part])[order_]
        e = np.maximum.accumulate(e)
        new = np.concatenate([[True], b[1:] > e[:-1]])
        first = np.flatnonzero(new)
        entry.hit.append(np.stack([b[first], e[np.append(first[1:] - 1, len(e) - 1)]]))


def _union(spans: list[np.ndarray]) -> int:
    both = np.concatenate(spans, axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    e = np.maximum.accumulate(both[1])
    new = np.concatenate([[True], both[0][1:] > e[:-1]])
    first = np.flatnonzero(new)
    return int((e[np.append(first[1:] - 1, len(e) - 1)] - both[0][first]).sum())


def search_batch(column, block: Block, width: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                 shard_words: int = SHARD_WORDS):
    """Word counts and findings (by row) of a text column against one block."""
    batch = pa.record_batch([column], ["t"])
    n_words, found, base = [], {}, 0
    for piece in slices(iter([batch]), "t", shard_bytes):
        hashes, bounds = word_hashes(piece.column("t"))
        counts = np.diff(bounds)
        n_words.append(counts)
        if len(block.words):
            if len(hashes) <= shard_words:
                _shard(found, block, hashes, bounds, base + np.arange(len(counts)),
                       np.zeros(len(counts), np.int64), width)
            else:
                for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    for c in range(int(a), int(b), shard_words):
                        # overlap so far that the longest item match is seen whole
                        d = min(int(b), c + shard_words + int(block.left.max(initial=0)))
                        _shard(found, block, hashes[c:d], np.array([0, d - c]),
                               np.array([base + row]), np.array([c - int(a)]), width)
        base += len(counts)
    return (np.concatenate(n_words) if n_words else np.zeros(0, np.int64)), found


def _searcher(shared, text: str, width: int, shard_bytes: int, shard_words: int):
    def run(batches):
        block = SimpleNamespace(**shared.value)
        for batch in slices(batches, text, shard_bytes):
            n_words, found = search_batch(batch.column(text), block, width, shard_bytes,
                                          shard_words)
            items = [[] for _ in n_words]
            spans = [[] for _ in n_words]
            longest = [(0, None, None)] * len(n_words)
            for row, entry in found.items():
                items[row] = sorted({block.names[i] for i in entry.items})
                spans[row] = np.concatenate(entry.hit, axis=1).T.tolist()
                size, at, source = entry.longest
                longest[row] = (size, at, block.names[block.item[source]])
            yield pa.record_batch(
                [*batch.columns, pa.array(n_words, pa.int64()),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array([x[0] for x in longest], pa.int64()),
                 pa.array([x[1] for x in longest], pa.int64()),
                 pa.array([x[2] for x in longest], pa.string())], schema=out_schema(batch))

    def out_schema(batch):
        return pa.schema([*batch.schema, pa.field("_n_words", pa.int64()),
                          pa.field("_items", pa.list_(pa.string())),
                          pa.field("_spans", pa.list_(pa.list_(pa.int64()))),
                          pa.field("_size", pa.int64()), pa.field("_at", pa.int64()),
                          pa.field("_by", pa.string())])
    return run


def _blocks(benchmark: DataFrame, item: str, text: str, most: int, width: int):
    """The benchmark in blocks of at most `most` words, read one after the other."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("n"),
                            F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.distinct().orderBy("n", "t")
    names, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        if texts and size + len(row.t) // 2 > most:
            yield Block(names, texts, width)
            names, texts, size = [], [], 0
        names.append(row.n)
        texts.append(row.t)
        size += len(row.t) // 2 + 1
    yield Block(names, texts, width)


def _summary(width: int):
    def run(batches):
        for batch in batches:
            items = batch.column("_items").to_pylist()
            spans = batch.column("_spans").to_pylist()
            n_words = batch.column("_n_words").to_pylist()
            hit = [_union([np.array(s, np.int64).T]) if s else 0 for s in spans]
            names = [sorted(set(i)) for i in items]
            rest = [batch.column(i) for i, f in enumerate(batch.schema)
                    if f.name not in ("_items", "_spans", "_n_words", "_size", "_at", "_by")]
            fields = [f for f in batch.schema
                      if f.name not in ("_items", "_spans", "_n_words", "_size", "_at", "_by")]
            made = {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(n) for n in names], pa.int64()),
                "items_sha256": pa.array(
                    [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names],
                    pa.string()),
                "contaminated": pa.array([h > 0 and 20 * h >= n
                                          for h, n in zip(hit, n_words)], pa.bool_()),
                "longest_match": batch.column("_size"), "longest_at": batch.column("_at"),
                "longest_item": batch.column("_by")}
            yield pa.record_batch([*rest, *made.values()], schema=pa.schema(
                [*fields, *[pa.field(k, v.type) for k, v in made.items()]]))
    return run


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
           item_text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS,
           shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` with the counts and the longest match of each document."""
    context = modest_batches(docs).sparkSession.sparkContext
    found = "_n_words bigint, _items array<string>, _spans array<array<bigint>>, " \
            "_size bigint, _at bigint, _by string"
    searcher = lambda block: _searcher(context.broadcast(vars(block)), text, width, shard_bytes,
                                       shard_words)
    blocks = _blocks(benchmark, item, item_text, block_words, width)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        search_, summary = searcher(block), _summary(width)
        return docs.mapInArrow(lambda batches: summary(search_(batches)), _with(docs, REPORT))
    rows = docs.mapInArrow(searcher(block), _with(docs, found))
    while following is not None:
        rows = written(rows, "decontam").withColumnsRenamed(
            {n: f"{n}0" for n in ("_n_words", "_items", "_spans", "_size", "_at", "_by")})
        rows = rows.mapInArrow(searcher(following), _with(rows, found))
        longer = F.col("_size") > F.col("_size0")
        rows = rows.withColumn("_items", F.concat("_items0", "_items")) \
            .withColumn("_spans", F.concat("_spans0", "_spans")) \
            .withColumn("_at", F.when(longer, F.col("_at")).otherwise(F.col("_at0"))) \
            .withColumn("_by", F.when(longer, F.col("_by")).otherwise(F.col("_by0"))) \
            .withColumn("_size", F.greatest("_size", "_size0")) \
            .drop("_n_words0", "_items0", "_spans0", "_size0", "_at0", "_by0")
        following = next(blocks, None)
    return rows.mapInArrow(_summary(width), _with(docs, REPORT))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  text: str = "text", **how) -> DataFrame:
    """One row per document: id, word and hit counts, items, verdict, longest match."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return search(rows, benchmark, **how).drop("text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                        **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = {f"_c{i}": name for i, name in enumerate(docs.columns)}
    rows = docs.toDF(*names)
    found = search(rows, benchmark, text=f"_c{docs.columns.index(text)}", **how)
    return found.where(~F.col("contaminated")).select(*names).toDF(*names.values())
