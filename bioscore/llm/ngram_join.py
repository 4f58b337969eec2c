"""Similarity join of documents on their word n-grams: MinHash banding, then exact checks.

1. Every document becomes its set of 5-word runs (64-bit hashes), a digest of the set, and
   `bands` band hashes of `rows` minima each. Documents with equal sets are one class of
   copies; only its smallest id goes on.
2. Shuffle on band hashes. Classes that share a bucket are linked to the smallest of it
   (never to each other), and connected links make a cell: every candidate pair lies inside one.
3. Sets are computed again for the members of cells only. A cell is cut into blocks of bounded
   size; each pair of blocks is one group, in which all pairs are checked on the full sets
   with an incidence matrix. A group returns, per member, its number of links and the smallest
   member it hangs together with; pairs are never written out.
4. Links are added up, and the connected links give the near-duplicate classes.

With 40 bands of 6 rows a pair of similarity 0.8 is missed with probability 5e-6; pairs inside
a cell are all checked, so the real loss is smaller still.

Words are the runs of letters and digits (every character beyond ASCII counts as a letter) of
the lower-cased text. A document of one to four words has one run of all its words.

Defined cases: NULL, empty and wordless texts have an empty set and no links; each is its own
class. Rows with a NULL id are reported with a NULL class and no links. Rows repeated with
one id are reported once each and count as copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import lookup
from .components import components
from .shared import modest_batches, written
from .words import grams, mix, slices, word_hashes

WIDTH = 5
BANDS, ROWS = 40, 6
SIMILAR = (4, 5)               # 0.8 as a ratio of whole numbers
SLICE_BYTES = 1 << 20
BLOCK_ROWS, BLOCK_GRAMS = 512, 500_000

_draw = np.random.Generator(np.random.PCG64(77))
MULTIPLY = _draw.integers(0, 1 << 32, 4096, dtype=np.uint32) | np.uint32(1)
FLIP = _draw.integers(0, 1 << 32, 4096, dtype=np.uint32)


def gram_sets(column, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every row."""
    hashes, bounds = word_hashes(pc.utf8_lower(column))
    values, first = grams(hashes, bounds, width)
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]


def digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    begin = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((low ^ FLIP[k]) * MULTIPLY[k], begin)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out


def _signatures(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("grams", pa.int32()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for piece in slices(batches, "text", SLICE_BYTES):
            sets = gram_sets(piece.column("text"), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [None] * len(sets)
            if full:
                made = band_hashes([sets[i] for i in full], bands, rows).view(np.int64)
                for i, row in zip(full, made):
                    keys[i] = row
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))], schema=schema)
    return run


def _member_sets(width: int):
    schema = pa.schema([("member", pa.binary()), ("copies", pa.int64()), ("cell", pa.binary()),
                        ("block", pa.int32()), ("blocks", pa.int32()),
                        ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for piece in slices(batches, "text", SLICE_BYTES):
            sets = gram_sets(piece.column("text"), width)
            keep = [i for i, (s, d) in enumerate(zip(sets, piece.column("digest").to_pylist()))
                    if digest(s) == d]
            yield pa.record_batch(
                [*[piece.column(n).take(pa.array(keep, pa.int64()))
                   for n in ("member", "copies", "cell", "block", "blocks")],
                 pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                schema=schema)
    return run


def linked(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Matrix of the pairs whose Jaccard similarity reaches the ratio."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]])
        common = np.array([[0, common[0, 1]], [common[0, 1], 0]])
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True,
                                       return_counts=True)
        kept = counts[inverse] > 1
        number = np.cumsum(counts > 1) - 1
        owner, column = owner[kept], number[inverse[kept]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.float32)
        for at in range(0, int((counts > 1).sum()), 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            common += part @ part.T
        common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    out = similar[1] * common >= similar[0] * union
    out[np.arange(n), np.arange(n)] = False
    return out


def hang_together(pairs: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric matrix."""
    label = np.arange(len(pairs))
    while True:
        least = np.where(pairs, label[None, :], len(pairs)).min(axis=1, initial=len(pairs))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _check_groups(similar: tuple[int, int]):
    schema = pa.schema([("member", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def checked(rows):
        one = {r[3]: r for r in rows}              # a repeated row is one member
        rows = [one[k] for k in sorted(one)]
        if len(rows) < 2:
            return
        pairs = linked([r[6] for r in rows], similar)
        block = np.array([r[5] for r in rows])
        if rows[0][1] != rows[0][2]:               # two blocks: pairs inside one come elsewhere
            pairs &= block[:, None] != block[None, :]
        label = hang_together(pairs)
        links = pairs @ np.array([r[4] for r in rows], np.int64)
        for i in np.flatnonzero(links):
            yield rows[i][3], int(links[i]), rows[label[i]][3]

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            plain = [batch.column(n).to_pylist()
                     for n in ("cell", "low", "high", "member", "copies", "block")]
            lists = batch.column("grams")
            values = lists.values.to_numpy().view(np.uint64)
            marks = lists.offsets.to_numpy()
            for i, row in enumerate(zip(*plain)):
                if row[:3] != key:
                    out.extend(checked(held))
                    key, held = row[:3], []
                held.append((*row, values[marks[i]:marks[i + 1]].copy()))
            if len(out) > 10_000:
                yield pa.record_batch(list(map(pa.array, zip(*out))), schema=schema)
                out = []
        out.extend(checked(held))
        if out:
            yield pa.record_batch(list(map(pa.array, zip(*out))), schema=schema)
    return run


def _member_key(rep: str, digest: str) -> Column:
    """Sixteen bytes in the order of the id, then of the digest: one key for each set."""
    high = F.unhex(F.lpad(F.hex(F.col(rep).bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), 63))), 16, "0"))
    return F.concat(high, F.substring(F.col(digest), 1, 8))


def _id_of(member: Column) -> Column:
    """The id in a member key."""
    unsigned = F.conv(F.hex(F.substring(member, 1, 8)), 16, 10).cast("decimal(20,0)")
    return (unsigned - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def _classes(docs: DataFrame, doc_id: str, text: str, width: int = WIDTH, bands: int = BANDS,
             rows: int = ROWS, similar: tuple[int, int] = SIMILAR, block_rows: int = BLOCK_ROWS,
             block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, digest, copy_id, class_id, first, n_links) of every row.

    `first` is true for rows of the set that leads its class. Sets, not ids, are the members
    of classes: an id may stand for several texts.
    """
    texts = modest_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signs = written(texts.mapInArrow(
        _signatures(width, bands, rows),
        "doc_id bigint, digest binary, grams int, bands array<bigint>"), "signatures")
    known = signs.where("digest is not null and doc_id is not null")
    reps = (known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "grams", "bands")).alias("m"), F.count("*").alias("copies"))
        .select("digest", F.col("m.doc_id").alias("rep"), "copies", "m.grams", "m.bands"))
    reps = written(reps.withColumn("member", _member_key("rep", "digest")), "reps")

    placed = reps.select("member", F.posexplode("bands").alias("band", "key"))
    hubs = (placed.groupBy("band", "key").agg(F.min("member").alias("v"), F.count("*").alias("n"))
            .where("n > 1").drop("n"))
    edges = (placed.join(hubs, ["band", "key"]).where("member <> v")
             .select(F.col("member").alias("u"), "v").distinct())
    cells = written(components(edges, "cells").withColumnsRenamed(
        {"node": "member", "root": "cell"}), "cell")

    members = cells.join(reps.select("member", "rep", "digest", "copies", "grams"), "member")
    members = written(members, "members")
    large = (members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
             .select("cell", F.greatest(F.ceil(F.col("n") / block_rows),
                                        F.ceil(F.col("g") / block_grams)).cast("int").alias("blocks"))
             .where("blocks > 1"))
    members = (members.join(large, "cell", "left")
               .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
               .withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")))
    # shuffled at every size: members grow with the documents, and texts are not sorted for it
    wanted = members.drop("grams").withColumnRenamed("rep", "doc_id").hint("shuffle_hash")
    sets = (texts.join(wanted, "doc_id")
            .select("text", "digest", "member", "copies", "cell", "block", "blocks")
            .mapInArrow(_member_sets(width), "member binary, copies bigint, cell binary, block int, "
                                             "blocks int, grams array<bigint>"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    groups = (sets.withColumn("_o", other)
              .select("cell", F.least("block", "_o").alias("low"),
                      F.greatest("block", "_o").alias("high"), "member", "copies", "block", "grams")
              .repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high"))
    found = written(groups.mapInArrow(_check_groups(similar),
                                      "member binary, links bigint, root binary"), "links")

    classes = components(found.select(F.col("member").alias("u"), F.col("root").alias("v")), "classes")
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    root = F.coalesce("root", "member")
    figures = written(
        reps.select("digest", "rep", "member", "copies").join(links, "member", "left")
        .join(classes.withColumnsRenamed({"node": "member"}), "member", "left")
        .select("digest", F.col("rep").alias("copy_id"), _id_of(root).alias("class_id"),
                (root == F.col("member")).alias("first"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "figures")
    # copies share a digest: a large group is split over as many blocks as there are partitions
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lookup(signs.drop("bands"), figures, "digest", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)), "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, class_id, copy_id and n_links for every row of `docs`.

    class_id: smallest id of all documents connected by links; copy_id: smallest id with an
    equal set; n_links: how many other documents reach the similarity, copies included. Texts
    that share an id keep links of their own, so their rows may be of different classes.
    """
    return _classes(docs, doc_id, text, **how).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      **how) -> DataFrame:
    """One document of each near-duplicate class, of the smallest id, with its own columns.

    Documents without words and rows with a NULL id stay. Of rows that repeat an id, those
    stay that lead their class, and one of those with the same set (without words: the same text).
    """
    found = _classes(docs, doc_id, text, **how)
    dropped = written(found.where("not (first and doc_id = copy_id)").select(
        F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")).distinct(), "dropped")
    repeated = (docs.groupBy(F.col(doc_id).alias("_again")).agg(F.count("*").alias("_n"))
                .where("_n > 1 and _again is not null").select("_again"))
    if not repeated.take(1):
        return docs.join(dropped.select("_gone"), docs[doc_id] == dropped["_gone"], "left_anti")
    own = docs[doc_id] == repeated["_again"]
    single = docs.join(repeated, own, "left_anti")
    single = single.join(dropped.select("_gone"), docs[doc_id] == dropped["_gone"], "left_anti")
    again = docs.join(repeated, own, "left_semi").withColumn("_text", F.xxhash64(text))
    marks = again.select(F.col("_text").alias("doc_id"), F.col(text).alias("text")).distinct().mapInArrow(
        _signatures(how.get("width", WIDTH), how.get("bands", BANDS), how.get("rows", ROWS)),
        "doc_id bigint, digest binary, grams int, bands array<bigint>")
    marks = marks.select(F.col("doc_id").alias("_text"), F.col("digest").alias("_mark")).distinct()
    order = Window.partitionBy(doc_id, "_mark", F.when(F.col("_mark").isNull(), F.col("_text"))).orderBy(F.lit(1))
    again = again.join(marks, "_text", "left")
    again = (again.join(dropped, (F.col(doc_id) == F.col("_gone")) & (F.col("_mark") == F.col("_digest")), "left_anti")
             .withColumn("_row", F.row_number().over(order)).where("_row = 1"))
    return single.unionByName(again.select(*docs.columns))
