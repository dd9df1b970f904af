"""Small cases of what differed, or grew too fast, on larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_halves_that_sums_come_near_are_rounded_as_halves(spark):
    from inspectra.plans.boundary import steady_round

    rows = spark.createDataFrame([(62.845249999999996,), (-20.023749999999996,), (1.00004,), (None,)], "v double")
    assert [r[0] for r in rows.select(steady_round("v", 4)).collect()] == [62.8453, -20.0238, 1.0, None]


def test_filters_and_masks_are_those_of_plain_windows():
    import numpy as np

    from inspectra.functions import images as im

    rng = np.random.default_rng(3)
    for h, w in ((64, 64), (7, 12), (3, 5)):
        gray = rng.integers(0, 256, (h, w)).astype(np.uint8)
        for size in (3, 5, 11):
            k = im.gaussian_kernel(size, 1.5)
            view = np.lib.stride_tricks.sliding_window_view(np.pad(gray.astype(float), size // 2, mode="reflect"), k.shape)
            want = np.einsum("ijkl,kl->ij", view, k)
            assert np.allclose(im.filtered(gray, k), want) and np.allclose(im.smoothed(gray, im.gaussian_line(size, 1.5)), want)
        mask = gray > 128
        grown = np.lib.stride_tricks.sliding_window_view(np.pad(mask, 2), (5, 5)).any(axis=(2, 3))
        assert (im.morphology(mask, 5, True) == grown).all()
        y, x = np.nonzero(~mask)
        d = np.sqrt(((np.arange(h)[:, None, None] - y) ** 2 + (np.arange(w)[None, :, None] - x) ** 2).min(axis=2))
        assert np.allclose(im.distance_transform(mask), d)
    assert im.best_shift(im.shifted(gray, 1, 0), gray, 2) == (-1, 0) and im.best_shift(np.zeros((5, 5)), gray[:, :5].repeat(2, 0)[:5], 2) == (0, 0)


def test_polygon_area_counts_the_mask():
    import numpy as np

    from inspectra.functions import images as im

    for points in ([[2, 3], [9, 3], [9, 7], [2, 7]], [[-4, -2], [30, 5], [8, 40]], [[0, 0], [6, 6], [6, 0], [0, 6]], [[50, 50], [60, 50], [60, 60]], [[1, 1], [1, 5], [1, 9]]):
        assert im.polygon_area(np.array(points, float), 20, 25) == im.polygon_mask([points], 20, 25).sum()


def test_rows_leave_a_task_in_slices(spark):
    from inspectra.operators import imagery

    rasters = spark.range(3 * imagery.SLICE + 1).selectExpr("id AS image_id", "0 AS tile", "1 AS h", "1 AS w", "X'07' AS data").coalesce(1)
    got = imagery.per_image(rasters, lambda gray, seed: [(int(gray[0, 0]),)] * 2, "v int")
    assert got.count() == 6 * imagery.SLICE + 2 and {r.v for r in got.select("v").distinct().collect()} == {7}
    from inspectra.operators import geometry

    texts = spark.createDataFrame([(7, "abab c\U0001f600"), (8, "")], "image_id long, text string")
    assert {(r.cls, tuple(r.idx)) for r in geometry.places_by_character(texts, "image_id", "text").collect()} == {("a", (0, 2)), ("b", (1, 3)), (" ", (4,)), ("c", (5,)), ("\U0001f600", (6,))}


def test_heat_of_curves_that_overlap_in_part(spark):
    from inspectra.operators import imagery

    rows = [(1, 0, 0, 3, 2, True, [1.0, 2.0, 3.0]), (1, 4, 1, 6, 2, True, [6.0, 6.0]), (1, 2, 1, 4, 2, False, [4.0])]
    pairs = spark.createDataFrame(rows, "image_id long, x0 int, y0 int, x1 int, y1 int, vertical boolean, curve array<double>")
    got = {(r.y, r.x): round(r.v * 6, 9) for r in imagery.difference_heat(pairs).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 1, (1, 1): 2, (1, 2): 3.5, (1, 3): 4, (1, 4): 6, (1, 5): 6}


def test_distances_are_held_in_bounded_blocks(spark):
    import numpy as np
    import pandas as pd

    from inspectra.operators import knn

    y = np.random.default_rng(1).normal(size=(300, 4))
    left = pd.DataFrame({"cls": 0, "query_id": range(300), "emb": list(y)})
    right = pd.DataFrame({"bank_id": range(300), "b_emb": list(y)})
    found, block = [], knn.BLOCK
    try:
        for knn.BLOCK in (block, 700, 1):
            found.append([[p["id"] for p in r] for r in knn.best_of_shares(1, True)(left, right)["found"]])
    finally:
        knn.BLOCK = block
    assert found[0] == found[1] == found[2] and block <= 1 << 20
