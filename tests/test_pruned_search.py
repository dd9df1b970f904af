"""Pruned nearest neighbours against brute force, and what they skip."""

from __future__ import annotations

import numpy as np
import pytest

from inspectra.operators import knn

RNG = np.random.default_rng(6)


def clustered():
    """Two classes in clusters far apart; a vector that many rows share; a class with fewer rows than k."""
    rows = []
    for cls in (0, 1):
        centres = RNG.normal(0, 20, (6, 5))
        rows += [(cls, c + RNG.normal(0, 0.5, 5)) for c in centres for _ in range(40)]
    rows += [(1, np.ones(5))] * 120 + [(2, RNG.normal(size=5)) for _ in range(2)]
    return [(k, cls, e.tolist()) for k, (cls, e) in enumerate(rows)]


@pytest.mark.parametrize(("k", "share_rows", "exclude"), [(1, 20_000, False), (3, 25, True)])
def test_pruned_equals_brute_force(spark, k, share_rows, exclude):
    rows = clustered()
    bank = spark.createDataFrame(rows, "bank_id long, cls int, emb array<double>").repartition(3)
    queries = spark.createDataFrame([r for r in rows if r[0] % 5 == 0] + [(9000, 7, [0.0] * 5)], "query_id long, cls int, emb array<double>")
    search = knn.PrunedSearch(queries, bank, k, exclude, share_rows, pivots=12)
    got = {r.query_id: r.d for r in search.nearest().collect()}
    want = {}
    for i, cls, e in rows:
        if i % 5 == 0:
            d = sorted(float(np.linalg.norm(np.array(e) - np.array(x))) for j, c, x in rows if c == cls and not (exclude and i == j))[:k]
            if d:
                want[i] = np.mean(d)
    assert set(got) == set(want) and all(abs(got[i] - d) < 1e-6 for i, d in want.items())
    seen = {r.cls: r.looked_at / r.pairs for r in search.looked_at().collect()}
    assert seen[0] < 0.5 and all(0 < x <= 1 for x in seen.values())
