"""Ranked search, fingerprint trees and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from bioscore.llm import hamming_tree, periodic_runs, ranked_search, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " \t\n ", "one", "Two words", "É ñ ß 12", "a\x00b", "x" * 5000, "...", "ÄÖ äö",
       "a\x85b c d e f"]


def frame(spark, rows, ddl="doc_id long, text string, item_id string, score string, rank int"):
    extra = [None] * (len(ddl.split(",")) - 2)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], ddl)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, best=10):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, counts, n in docs:
            m = 25 + 75 * n * total // length
            score = sum(c * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
                        for t, c in asked.items() if counts[t])
            if score:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda r: r[:3])
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(found[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,block", [(2_000_000, 1_000_000), (60, 25)])
def test_search_equals_scoring_every_document(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    docs = list(enumerate(ODD + [text(rng.randrange(1, 60)) for _ in range(300)] + [text(20_000)]))
    docs += [(1000 + i, "tie W1 w2") for i in range(30)] + docs[20:24] + [(None, "tie w1 w2"), (None, None)]
    rng.shuffle(docs)
    items = [("a", text(12)), ("b", "tie tie W1"), ("c", None), ("d", "zzz"), (None, "w3 w4"),
             ("e", text(200)), ("a", "w1"), ("a", "w1"), ("f", "É äö 12"), ("g", "...")]
    rows = ranked_search.search(
        frame(spark, docs).repartition(3),
        spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, doc_id int"),
        block_words=block)
    assert sorted(map(tuple, rows.collect()), key=repr) == ranked(docs, items)


def test_search_of_and_in_nothing(spark):
    docs, items = frame(spark, []), spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert ranked_search.search(docs, items).collect() == []
    assert ranked_search.search(frame(spark, [(1, "x")]), items.limit(0)).collect() == []
    assert ranked_search.search(frame(spark, [(1, None)]), items).collect() == []


def test_few_accumulators_are_created():
    """A rare term decides: the postings of the frequent one create nothing."""
    n, calls = 5000, []
    documents = np.concatenate([np.arange(10), np.arange(n)])
    order = np.repeat([0, 1], [10, n])
    shard = ranked_search.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 10), documents, order,
                                np.ones(len(order), np.int64), 2, n, 10 * n)
    leaders = ranked_search.Leaders(10)
    plain = shard.sums
    shard.sums = type("Seen", (np.ndarray,), {
        "__setitem__": lambda self, k, v: (calls.append(np.size(k)), np.ndarray.__setitem__(self, k, v))})(
            plain.shape, plain.dtype, plain)
    shard.rank(np.array([0, 1]), np.array([5000, 3]), leaders)
    assert sorted(leaders.ids.tolist()) == list(range(10)) and max(calls) == 10
    assert len(set(leaders.scores.tolist())) == 1 and leaders.scores[0] == 5003 * shard.gain[0]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []


def simhash(text):
    ones, own = [0] * 64, [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    for h in own:
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(own))


def test_hashes_and_fingerprints_equal_the_library():
    rng = random.Random(2)
    texts = ODD + [" ".join("é" * rng.randrange(9) + "x" * rng.randrange(1, 30 * (k % 7 + 1))
                            for _ in range(rng.randrange(1, 900))) for k in range(60)]
    assert hamming_tree.simhash(pa.array(texts, pa.string())).tolist() == [simhash(t) for t in texts]
    raw = np.frombuffer(rng.randbytes(3000), np.uint8)
    starts = np.array([rng.randrange(300) for _ in range(400)] + [0, 5])
    sizes = np.array(list(range(400)) + [2990, 255])
    assert hamming_tree.xxh64(raw, starts, sizes).tolist() == [
        xxhash.xxh64_intdigest(raw[a:a + n].tobytes(), 42) for a, n in zip(starts, sizes)]


def linked(points, bits=2):
    """Smallest index linked to each point, by all pairs."""
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, p in enumerate(points):
        for j in range(i):
            if (p ^ points[j]).bit_count() <= bits:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(points))]


def clustered(rng, n):
    points = [rng.getrandbits(64) for _ in range(n // 4)] + [0, (1 << 64) - 1]
    while len(points) < n:
        p = rng.choice(points)
        for _ in range(rng.randrange(1, 5)):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    return sorted(set(points))


@pytest.mark.parametrize("leaf", [256, 4])
def test_tree_keeps_every_link(monkeypatch, leaf):
    """Shards of a tree, each with a tree of its own, give the components of all pairs."""
    monkeypatch.setattr(hamming_tree, "LEAF", leaf)
    rng = random.Random(leaf)
    points = clustered(rng, 1500)
    array = np.array(points, np.uint64)
    sample = np.array(sorted(rng.sample(points, 200)), np.uint64)
    tree = hamming_tree.ShardTree(sample, 20)
    assert tree.shards > 8
    roots = np.arange(len(points))
    homes_seen, work = 0, 0
    for _, homes, visitors in tree.routes(array):
        rows = np.concatenate([homes, visitors])
        found = hamming_tree.forest(array[rows], len(homes))
        hamming_tree._join(roots, rows, rows[found])
        homes_seen, work = homes_seen + len(homes), work + len(homes) * len(rows)
    assert homes_seen == len(points) and roots.tolist() == linked(points)
    assert work < len(points) ** 2 / 2


def test_equal_points_are_never_parted():
    same = np.full(50, 7, np.uint64)
    assert hamming_tree.choose(same, 2) is None
    assert hamming_tree.ShardTree(same[:0], 5).shards == 1


@pytest.mark.parametrize("shard", [8192, 12])
def test_simhash_components_equal_all_pairs(spark, shard):
    rng = random.Random(8)
    texts = list(ODD)
    for n in (40, 150, 400, 900):
        base = [f"w{rng.randrange(300)}" for _ in range(n)]
        for _ in range(30):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(n)] = f"new{rng.randrange(999)}"
            texts.append(" ".join(own))
        texts += [" ".join(base).upper()] * 3
    docs = [(i * 7 % 1000 if i else None, t) for i, t in enumerate(texts)] + [(3, texts[20]), (3, texts[20])]
    prints = [simhash(t) for _, t in docs]
    roots = linked(prints)
    least = {}
    for (i, _), r in zip(docs, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    wanted = sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(docs, prints, roots)), key=repr)
    rows = hamming_tree.near_duplicates(
        frame(spark, docs, "doc_id long, text string, point long, first long, shard int"), shard=shard)
    assert sorted(map(tuple, rows.collect()), key=repr) == wanted
    assert len(set(roots)) < len(docs) / 2
    assert hamming_tree.near_duplicates(frame(spark, [])).collect() == []


def runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q) and not any(
                    w[s:i + q - p] == w[s + p:i + q] for p in range(1, q)):
                out.append((s, i + q, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(doc_id, text, tails=True):
    w = WORD.findall(text or "")
    n = len(w)
    if tails and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a, p = h // 10 % n, 0
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, len(found), *((best[0], best[1] - best[0], best[2],
                                      1000 * (best[1] - best[0]) // best[2]) if best else [None] * 4),
            sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_trying_every_period(spark):
    rng = random.Random(4)
    texts = list(ODD) + ["a " * 500, "a b " * 7 + "a", "x y z " * 4, "x y z " * 3 + "x y"]
    for _ in range(150):
        w = []
        while len(w) < rng.randrange(1, 160):
            unit = [f"v{rng.randrange(3)}" for _ in range(rng.randrange(1, 9))]
            w += unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit))]
        texts.append(rng.choice([" ", "\n\n", " \t"]).join(w))
    docs = list(enumerate(texts)) + [(None, "a " * 9), (None, None), (3, texts[30]), (3, texts[30])]
    for tails in (True, False):
        rows = periodic_runs.periodic_runs(
            frame(spark, docs, "doc_id long, text string, start int, n_runs int"), repeat_tails=tails)
        assert rows.columns == [f.split()[0] for f in periodic_runs.RESULT.split(", ")]
        wanted = sorted((described(i, t, tails) for i, t in docs), key=repr)
        assert sorted(map(tuple, rows.collect()), key=repr) == wanted
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_runs_of_a_long_text():
    """A million words in one text: runs of all lengths, with nothing cut off."""
    rng = np.random.default_rng(1)
    names = rng.integers(1, 1 << 62, 1_000_000).astype(np.uint64)
    wanted, at = [], 100
    for q in (1, 2, 7, 64, 65, 1000, 30_000):
        n = 5 * q + 3
        names[at:at + n] = np.resize(names[at:at + q], n)
        wanted.append((at, at + n, q))
        at += n + 50
    found = periodic_runs.find_runs(names, np.array([0, len(names)]))
    assert found.T.tolist() == [list(w) for w in wanted]
