"""Ranked lexical search, term at a time with a limited number of accumulators.

One pass over the texts leaves, for each document, its number of terms and the counts of the
terms that some query item holds. Document frequencies and totals come from that table. Every
task then ranks its share of the documents: postings of a shard are sorted by term, an item's
terms are taken rarest first, and each posting adds its gain to the document's accumulator.

The greatest gains of the terms still to come bound what a document without accumulator can
reach. Once that bound is below the score of the tenth best document so far (of the shard, or
of earlier shards of the task), no accumulator is created any more; the survivors are
updated exactly with the remaining terms, and those that cannot reach the tenth any more are
dropped. Only the best ten of each task meet, first by (item, salt), then by item.

Terms are told apart by 64-bit hashes. A score sums w * ((10^9 * tf) div (1000 * tf + 8 * m)),
with w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L.

Items are ranked in blocks of at most `block_words` words; each block reads the texts once.

Defined cases: NULL and texts without terms are no documents; items without terms return
nothing. Every row is a document and every item row an item, so rows that repeat return
repeatedly. A NULL id comes after all others among equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import modest_batches, written

BEST = 10
BLOCK_WORDS = 1_000_000
SLICE_BYTES = 1 << 20
SHARD_POSTINGS = 2_000_000
SALTS = 32


class Items:
    """A block of query items: their vocabulary, and (term, repeats) of each."""

    def __init__(self, texts: list[str]):
        hashes, bounds = words.word_hashes(pa.array(texts, pa.string()))
        self.vocabulary, place = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(place[a:b], return_counts=True)
                      for a, b in zip(bounds[:-1], bounds[1:])]


def _counter(vocabulary, row_id: str):
    """Texts to (id, n, terms, counts): the terms of the vocabulary with their occurrences."""
    def run(batches):
        known, size = vocabulary.value, len(vocabulary.value)
        for batch in words.slices(batches, "text", SLICE_BYTES):
            hashes, bounds = words.word_hashes(batch.column("text"))
            at = np.searchsorted(known, hashes)
            at[at == size] = 0
            held = known[at] == hashes if size else np.zeros(len(hashes), bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[held]
            keys, counts = np.unique(row * max(size, 1) + at[held], return_counts=True)
            row, term = np.divmod(keys, max(size, 1))
            marks = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.record_batch(
                [batch.column(row_id), pa.array(np.diff(bounds), pa.int64()),
                 pa.ListArray.from_arrays(marks, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(marks, pa.array(counts, pa.int64()))],
                names=[row_id, "n", "terms", "counts"])
    return run


class Leaders:
    """The best documents of one item so far."""

    def __init__(self, best: int):
        self.best = best
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    def least(self) -> int:
        """What a document needs at least; ties may still win by id."""
        return int(self.scores[-1]) if len(self.scores) == self.best else 1

    def add(self, scores, ids, unnamed) -> None:
        scores = np.concatenate([self.scores, scores])
        ids, unnamed = np.concatenate([self.ids, ids]), np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((ids, unnamed, -scores))[:self.best]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


class Shard:
    """Postings of some documents by term, each with its gain for weight 1."""

    def __init__(self, ids, unnamed, sizes, documents, terms, counts, n_terms, total, all_terms):
        self.ids, self.unnamed = ids, unnamed
        m = 25 + (75 * sizes * total) // all_terms
        gain = (1_000_000_000 * counts) // (1000 * counts + 8 * m[documents])
        order = np.argsort(terms, kind="stable")
        self.documents, self.gain = documents[order], gain[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gain, self.starts[held])
        self.sums = np.zeros(len(ids), np.int64)

    def postings(self, term: int):
        span = slice(self.starts[term], self.starts[term + 1])
        return self.documents[span], self.gain[span]

    def rank(self, terms, weights, leaders: Leaders) -> None:
        """Add this shard's documents to the leaders; `terms` come rarest first."""
        sums, best = self.sums, leaders.best
        rest = np.append(np.cumsum((weights * self.most[terms])[::-1])[::-1], 0)
        least, highest, at = leaders.least(), 0, 0
        while at < len(terms) and rest[at] >= least:
            documents, gain = self.postings(terms[at])
            if len(documents) and weights[at]:
                sums[documents] += weights[at] * gain
                highest = max(highest, int(sums[documents].max()))
            at += 1
            if rest[at] < highest:         # the tenth best partial score is not higher
                partial = sums[sums > 0]
                if len(partial) >= best:
                    tenth = int(np.partition(partial, len(partial) - best)[len(partial) - best])
                    least = max(least, tenth)
        alive = np.flatnonzero(sums)
        created = alive
        while at < len(terms) and len(alive):
            alive = alive[sums[alive] + rest[at] >= least]
            documents, gain = self.postings(terms[at])
            place = np.searchsorted(documents, alive)
            place[place == len(documents)] = 0
            if len(documents):
                found = documents[place] == alive
                sums[alive[found]] += weights[at] * gain[place[found]]
            at += 1
        alive = alive[sums[alive] >= least]
        if len(alive) > best:
            scores = sums[alive]
            alive = alive[scores >= np.partition(scores, len(alive) - best)[len(alive) - best]]
        leaders.add(sums[alive], self.ids[alive], self.unnamed[alive])
        sums[created] = 0


def _ranker(block, best: int, row_id: str):
    def run(batches):
        items, weights, total, all_terms = block.value
        leaders, held, size = [Leaders(best) for _ in items], [], 0

        def flush():
            shard = Shard(*[np.concatenate(c) for c in zip(*held)], len(weights), total, all_terms)
            for (terms, gains), own in zip(items, leaders):
                shard.rank(terms, gains, own)

        base = 0
        for batch in batches:
            lists = batch.column("terms")
            marks = lists.offsets.to_numpy()
            documents = np.repeat(np.arange(batch.num_rows), np.diff(marks)) + base
            counts = batch.column("counts")
            first = counts.offsets.to_numpy()
            held.append((batch.column(row_id).fill_null(0).to_numpy(),
                         batch.column(row_id).is_null().to_numpy(zero_copy_only=False),
                         batch.column("n").to_numpy(), documents,
                         lists.values.to_numpy()[marks[0]:marks[-1]],
                         counts.values.to_numpy()[first[0]:first[-1]]))
            base, size = base + batch.num_rows, size + len(documents)
            if size >= SHARD_POSTINGS:
                flush()
                held, size, base = [], 0, 0
        if held:
            flush()
        for i, own in enumerate(leaders):
            if len(own.ids):
                yield pa.record_batch(
                    [pa.array(np.full(len(own.ids), i), pa.int64()),
                     pa.array(own.ids, pa.int64(), mask=own.unnamed),
                     pa.array(own.scores, pa.int64())], names=["_item", row_id, "score"])
    return run


def _blocks(items: DataFrame, most: int):
    """The items in blocks of at most `most` words, read one after the other."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        if texts and size + len(row[1]) // 2 > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 2 + 1
    yield ids, texts


def _first(rows: DataFrame, keys: list, best: int, doc_id: str, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col(doc_id).asc_nulls_last())
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= best)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", best: int = BEST,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` highest-scoring documents of each item."""
    spark = modest_batches(docs).sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("i"),
                         F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    parts = []
    for ids, texts in _blocks(asked.orderBy("i", "t"), block_words):
        block = Items(texts)
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        postings = written(rows.mapInArrow(
            _counter(vocabulary, "doc_id"),
            "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"), "postings")
        total, all_terms = postings.where("n > 0").agg(
            F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        frequency = np.zeros(len(block.vocabulary), np.int64)
        frequency[[r[0] for r in found]] = [r[1] for r in found]
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                            for df in frequency.tolist()], np.int64)
        plans = []
        for terms, repeats in block.terms:
            order = np.lexsort((terms, frequency[terms]))
            plans.append((terms[order], (weights[terms] * repeats)[order]))
        state = spark.sparkContext.broadcast((plans, weights, total, max(all_terms, 1)))
        top = postings.where("size(terms) > 0").mapInArrow(
            _ranker(state, best, "doc_id"), "_item bigint, doc_id bigint, score bigint")
        top = top.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        top = _first(top, ["_item", "_salt"], best, "doc_id", "_part")
        top = _first(top.drop("_salt", "_part"), ["_item"], best, "doc_id", "rank")
        names = spark.createDataFrame(
            list(enumerate(ids)), f"_item bigint, item_id {asked.schema['i'].dataType.simpleString()}")
        parts.append(top.join(names, "_item").select("item_id", "rank", "doc_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
