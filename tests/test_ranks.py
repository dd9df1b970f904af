"""Order statistics, ranks and running sums against plain lists, with one hot group."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.operators import ranks, scores

R = random.Random(5)


def skewed():
    """Half of all rows in one group, with many ties; a group of one row, one of nulls, a null key."""
    rows = [("hot", R.choice([0.0, -0.0, 1.0, 2.5]) if k % 3 else R.gauss(0, 5)) for k in range(4000)]
    rows += [(f"g{k % 40}", R.random()) for k in range(3000)] + [("one", 7.0), ("nothing", None), ("nothing", None)]
    rows += [(None, R.expovariate(1)) for _ in range(900)] + [("same", 3.0)] * 500 + [("hot", None)] * 5
    return [(g, v, i) for i, (g, v) in enumerate(rows)]


def by_group(rows):
    out = {}
    for g, v, _ in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = skewed()
    return rows, spark.createDataFrame(rows, "g string, v double, i long").repartition(7).cache()


@pytest.mark.parametrize(("small", "accuracy"), [(100_000, 10_000), (200, 10_000), (0, 50)])
def test_quantiles_are_exact(data, small, accuracy):
    rows, df = data
    ps = {"lo": 0.0, "q": 0.1, "mid": 0.5, "high": 0.995, "top": 1.0}
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "v", ps, small, accuracy).collect()}
    want = by_group(rows)
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g].n == len(values)
        for name, p in ps.items():
            assert math.isclose(got[g][name], np.quantile(values, p), abs_tol=1e-9), (g, name)


def test_brackets_that_miss_are_widened(data, monkeypatch):
    """An approximate summary that is far off costs rounds, not exactness."""
    rows, df = data
    real = F.percentile_approx
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda v, grid, accuracy: real(F.pow(F.col("_v"), 3) + 4, grid, accuracy))
    got = {r.g: r.m for r in ranks.order_statistics(df, ["g"], "v", {"m": lambda n: F.floor(n / 3)}, 100).collect()}
    assert got == {g: sorted(v)[len(v) // 3] for g, v in by_group(rows).items()}


def test_group_scores_equal_the_array_forms(spark, data):
    rows, _ = data
    df = spark.createDataFrame([(g or "none", abs(v), i) for g, v, i in rows if v is not None], "g string, d double, i long").repartition(5)
    got = {r.g: r for r in ranks.group_scores(df, ["g"], "d", "i", 10, 99, 0.5, small=300).collect()}
    arrays = df.groupBy("g").agg(F.collect_list("d").alias("ds"))
    forms = arrays.select("g", *[f(F.col("ds")).alias(name) for name, f in scores.MODES.items()]).collect()
    assert len(forms) == len(got)
    for r in forms:
        for name in scores.MODES:
            assert math.isclose(got[r.g][name], r[name], rel_tol=1e-9, abs_tol=1e-9), (r.g, name)
    spatial = {r.g: r.score for r in scores.spatial(df, 10, "g", "i", "d").collect()}
    assert all(math.isclose(got[g].spatial, s, rel_tol=1e-9) for g, s in spatial.items())


def test_places_and_shares(data):
    rows, df = data
    order = scores.hash_order(F.col("i"), 42)
    placed = ranks.numbered(df, ["g"], order, "i", bins=16).withColumn("o", order).collect()
    seen = {}
    for r in sorted(placed, key=lambda r: (r.o, r.i)):
        assert r._place == seen.get(r.g, 0)
        seen[r.g] = r._place + 1
    assert {(r.g, r._size) for r in placed} == set(seen.items())
    target = lambda n: F.floor(n * 0.15)
    cut = ranks.first_share(df, ["g"], order, "i", target, bins=16).collect()
    assert len(cut) == len(rows)
    assert {r.i for r in cut if r._in} == {r.i for r in placed if r._place < math.floor(r._size * 0.15)}


def test_running_sums_by_block(data):
    rows, df = data
    df = df.withColumn("step", F.when(F.col("i") % 3 == 0, -1).otherwise(1))
    got = ranks.running_sums(df, ["g"], F.floor(F.col("i") / 500), ["i"], "step", "total").collect()
    so_far = {}
    for r in sorted(got, key=lambda r: r.i):
        so_far[r.g] = so_far.get(r.g, 0) + r.step
        assert r.total == so_far[r.g]
    assert len(got) == len(rows)


def test_a_hot_group_is_many_tasks(spark):
    """Of a group with all rows no task of the bracket's count reads more than its share."""
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v")).repartition(8)
    exact = ranks.quantiles(df, ["g"], "v", {"q": 0.9}, small=1000).first().q
    values = np.array([r.v for r in df.select("v").collect()])
    assert math.isclose(exact, np.quantile(values, 0.9))
