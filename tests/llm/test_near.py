"""The pipeline's near-copy stage against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inspectra.llm import near, simhash

R = random.Random(8)


def words(n):
    return [f"w{R.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(base, n):
    out = list(base)
    for _ in range(n):
        out[R.randrange(len(out))] = f"x{R.randrange(10**6)}"
    return out


def near_copies():
    """Copies on both sides of 0.8, of texts short and long; a line that all hold; odd texts."""
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    line = " ".join(words(12))
    for size in (6, 9, 20, 60, 200, 900):
        for _ in range(4):
            base = words(size)
            texts.append(line + " " + " ".join(base))
            texts += [line + " " + " ".join(edited(base, round(size * share))) for share in (0.005, 0.02, 0.02, 0.03, 0.04)]
            texts.append(" ".join(base[: size * 5 // 6]))
    order = list(enumerate(texts))
    R.shuffle(order)
    return order


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if similar(sets[a], sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


@pytest.mark.parametrize("settings", [{}, {"crowd": 2, "chunk": 7, "part": 1, "common": 60, "buffer": 300}])
def test_stage_keeps_what_brute_force_keeps(spark, settings):
    rows = near_copies()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("node", F.lit("clash"))
    kept = near.keep_one(docs, **settings) if settings else corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and len(want) < len(rows) - 40
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_simhash_says_which_thresholds_it_covers(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert simhash.group(docs, threshold=5).count() == 1
    with pytest.raises(ValueError):
        simhash.group(docs, threshold=6)


def test_bitmaps_never_differ_more_than_sets():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m in ((3, 4), (60, 70), (500, 620), (900, 1100), (30_000, 36_000)):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = np.unique(np.concatenate((base[: n * 9 // 10], rng.integers(0, 2**63, m - n * 9 // 10, dtype=np.uint64))))
        base = np.unique(base)
        apart = len(np.setxor1d(base, other))
        assert near.differing(near.bitmap(base), near.bitmap(other)) <= apart and near.differing(near.bitmap(base), near.bitmap(base)) == 0


def test_recall_on_the_given_documents(spark):
    """Every pair of different sets with a similarity of 0.8 or more, found by sizes and an index of all shingles, is linked."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        sets.setdefault(frozenset(shingles(r.text)), r.doc_id)
    index, pairs = {}, set()
    for s, i in sorted(sets.items(), key=lambda x: (len(x[0]), x[1])):
        shared = {}
        for g in s:
            for t in index.setdefault(g, []):
                shared[t] = shared.get(t, 0) + 1
            index[g].append(s)
        pairs |= {(sets[t], i) for t, n in shared.items() if 5 * n >= 4 * (len(s) + len(t) - n)}
    first = {r.doc_id: tuple(r.first) for r in near.group(spark.createDataFrame(rows)).collect()}
    assert [p for p in pairs if first[p[0]] != first[p[1]]] == []


def test_folds_lose_no_pair():
    for n in (40, 700, 5000):
        a = np.sort(np.array([R.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        b = np.sort(np.concatenate((a[: n * 9 // 10], np.array([R.getrandbits(64) for _ in range(n // 10)], dtype=np.uint64))))
        folds = [near.folded(near.bitmap(x)) for x in (a, b)]
        assert max(map(len, folds)) <= near.FOLD
        assert near.differing(*folds) <= near.differing(near.bitmap(a), near.bitmap(b)) <= 2 * (n - n * 9 // 10)
        assert near.may_differ(n, len(b), *folds)


def test_simhash_comes_first(spark):
    """The pairs of anchor points connect what chains of at most 5 bits connect, and nothing else."""
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    texts = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) text_hash", "coalesce(text, '') text")
    nodes = near.stored(near.signatures(texts).dropDuplicates(["node"]), "nodes")
    fps = {r.node: r.fp for r in nodes.collect()}
    pairs = [tuple(r) for r in near.covered(nodes).collect()]
    root = {n: n for n in fps}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in pairs:
        assert u > v
        root[find(u)] = find(v)
    bits = lambda u, v: int(np.bitwise_count(np.uint64(fps[u] & (1 << 64) - 1) ^ np.uint64(fps[v] & (1 << 64) - 1)))
    close = [(u, v) for u, v in combinations(sorted(fps), 2) if bits(u, v) <= near.COVERED]
    assert len(close) > 5 and all(find(u) == find(v) for u, v in close)
    root = {n: n for n in fps}
    for u, v in close:
        root[find(u)] = find(v)
    assert all(find(u) == find(v) for u, v in pairs)
