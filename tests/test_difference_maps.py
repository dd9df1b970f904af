"""Difference heat of neighbouring strips against literal loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from inspectra.operators import imagery, profiles

R = random.Random(14)


def stretched(row, n):
    """Triangle weights around pixel centres, as image libraries enlarge."""
    out = []
    for i in range(n):
        centre = (i + 0.5) * len(row) / n
        w = [max(0.0, 1 - abs(k + 0.5 - centre)) for k in range(len(row))]
        out.append(sum(a * b for a, b in zip(w, row, strict=True)) / sum(w))
    return out


def laid(h, w, areas):
    heat, count = np.zeros((h, w)), np.zeros((h, w))
    for (x0, y0, x1, y1), patch in areas:
        heat[y0:y1, x0:x1] += patch
        count[y0:y1, x0:x1] += 1
    heat[count > 0] /= count[count > 0]
    return heat / heat.max() if heat.max() > 0 else heat, count > 0


def same(df, heat, seen):
    got = {(r.y, r.x): r.v for r in df.collect()}
    assert set(got) == {tuple(map(int, k)) for k in np.argwhere(seen)}
    assert all(abs(heat[k] - v) < 1e-9 for k, v in got.items())


def test_feature_maps(spark):
    shape, boxes = (2, 3, 2), [(0, 0, 9, 5), (1, 4, 8, 11), (0, 9, 9, 14)]
    maps = [np.array([[[R.gauss(0, 1) for _ in range(2)] for _ in range(3)] for _ in range(2)]) for _ in boxes]
    areas = []
    for (a, b), (p, q) in zip(zip(boxes[:-1], boxes[1:], strict=True), zip(maps[:-1], maps[1:], strict=True), strict=True):
        area = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        rows = [stretched(r, area[2] - area[0]) for r in np.sqrt(((p - q) ** 2).sum(axis=0) + 1e-8)]
        areas.append((area, np.array([stretched(c, area[3] - area[1]) for c in zip(*rows, strict=True)]).T))
    df = spark.createDataFrame([(1, k, m.ravel().tolist(), *box) for k, (m, box) in enumerate(zip(maps, boxes, strict=True))], "image_id long, strip_idx int, profile array<double>, x0 int, y0 int, x1 int, y1 int")
    pairs = profiles.union_box(profiles.pairs(df, "profile", "x0", "y0", "x1", "y1"))
    same(imagery.difference_heat(imagery.difference_maps(pairs, shape)), *laid(14, 9, areas))


def test_curves_of_either_direction(spark):
    for vertical in (True, False):
        areas, rows = [], []
        distances = [0.5, 2.0, 1.0]
        for k, d in enumerate(distances):
            area = (0, 3 * k, 7, 3 * k + 5) if vertical else (3 * k, 0, 3 * k + 5, 7)
            curve = [R.random() for _ in range(4)]
            drawn = np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 4), np.array(curve) * (d / max(distances)) ** 2)
            areas.append((area, np.tile(drawn, (5, 1)) if vertical else np.tile(drawn[:, None], (1, 5))))
            rows.append((1, *area, vertical, d, curve))
        df = spark.createDataFrame([*rows, (2, 0, 0, 3, 3, True, 0.0, [0.0, 0.0]), (3, 5, 5, 5, 9, True, 1.0, [1.0])], "image_id long, x0 int, y0 int, x1 int, y1 int, vertical boolean, d double, curve array<double>")
        heat = imagery.difference_heat(imagery.weighted_curves(df))
        same(heat.where("image_id = 1"), *laid(*((11, 7) if vertical else (7, 11)), areas))
        assert [r.v for r in heat.where("image_id = 2").collect()] == [0.0] * 9  # no difference at all
        assert heat.where("image_id = 3").isEmpty()  # an area without a pixel


def test_profile_distances_by_loops(spark):
    a, b = [R.random() for _ in range(20)], [R.random() for _ in range(20)]
    df = spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, [0.3] * 20), (2, 0, a)], "image_id long, strip_idx int, profile array<double>")
    z = lambda v: (np.array(v) - np.mean(v)) / np.std(v)
    p = profiles.pairs(profiles.normalised(df))
    got = {r.strip_idx: r for r in profiles.lined_up_distances(profiles.shifts(p), 3).select("*", profiles.rms(F.col("a"), F.col("b")).alias("rms"), profiles.correlation_distance(F.col("a"), F.col("b")).alias("c")).collect()}
    assert set(got) == {0, 1}
    assert abs(got[0].rms - np.sqrt(np.mean((z(a) - z(b)) ** 2))) < 1e-9 and abs(got[0].c - (1 - np.corrcoef(a, b)[0, 1])) < 1e-9
    assert got[1].c == 0.0 and abs(got[1].rms - 1) < 1e-9  # a flat side
    products = {s: sum(z(a)[n + s] * z(b)[n] for n in range(20) if 0 <= n + s < 20) for s in range(-19, 20)}
    assert got[0].shift == abs(max(products, key=lambda s: (round(products[s], 9), -s)))
    s = max(range(-3, 4), key=lambda s: (round(products[s], 9), -s))
    x, y = (z(a)[: 20 - s], z(b)[s:]) if s >= 0 else (z(a)[-s:], z(b)[: 20 + s])
    assert abs(got[0].l2 - np.sqrt(np.mean((x - y) ** 2))) < 1e-9
