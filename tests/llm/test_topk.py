"""Top-k search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.llm import common, queries, topk

R = random.Random(13)
SCHEMA = "vec_id long, embedding array<float>"


def integers(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * float(np.float32(x))) for x in v]


def brute(rows, asked, k):
    good = [(i, w) for i, w in ((i, integers(v)) for i, v in rows) if i is not None and w is not None]
    out = []
    for i, q in good:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in good if j != i and len(w) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def vectors(n, width, kinds=None):
    few = [[R.gauss(0, 1) for _ in range(width)] for _ in range(kinds or n)]
    return [few[k % len(few)] if kinds else few[k] for k in range(n)]


@pytest.mark.parametrize(("lists", "block", "small"), [(2, 4096, True), (4, 7, False), (1, 50, True)])
def test_search_equals_brute_force(spark, monkeypatch, lists, block, small):
    if not small:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(topk, "SHARES", 3)
    rows = list(enumerate(vectors(150, 8)))
    rows += [(1000 + k, v) for k, v in enumerate(vectors(120, 8, kinds=2))]  # two vectors that 60 rows share
    rows += [(2000, None), (2010, [0.0] * 7 + [float("nan")]), (2020, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2030, [1.0] * 3), (2040, [2.0, 1.0, -1.0])]
    rows += [(2050, []), (2060, []), (5, rows[3][1]), (10, rows[10][1]), (10, rows[10][1])]
    rows += [(3000, rows[155][1])] * 40  # an id that repeats beyond k
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], f"{SCHEMA}, row string, cutoff int").repartition(3)
    got = topk.search(df, F.col("vec_id") % 10 == 0, k=4, lists=lists, block_rows=block)
    want = brute(rows, lambda i: i % 10 == 0, 4)
    assert found(got) == want


def test_vectors_with_a_null_component(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (1, [1.0, 2.0]), (100, [2.0, 0.5])], SCHEMA)
    assert found(topk.search(df, F.col("vec_id") % 100 == 0)) == [(100, 1, 1, 2 * 1024 * 1024 + 1024 * 1024)]
    assert found(topk.search(df.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_large_numbers_are_exact():
    n = 2**31 + 1
    a = np.array([[n, -3], [5, 7]], dtype=np.int64)
    assert topk.products(a, a).tolist() == [[n * n + 9, 5 * n - 21], [5 * n - 21, 74]]


def test_few_entries_are_collected(spark):
    """The cutoff leaves a small share of all pairs."""
    rows = list(enumerate(vectors(3000, 64)))
    df = spark.createDataFrame(rows, SCHEMA)
    ints = topk.integer_rows(df, "vec_id", "embedding").withColumn("cutoff", F.lit(4 * 8 * 1024 * 1024))
    blocks = topk.packed(ints, 1000, 2)
    pairs = topk.meet(topk.packed(ints.where("vec_id % 100 = 0"), 1000, 2), blocks)
    assert topk.entries_above(pairs, 2).count() < 0.02 * 30 * 3000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf, "embeddings").collect()]
    assert found(queries.op13_topk(spark, sf)) == brute(rows, lambda i: i % 100 == 0, 10)
