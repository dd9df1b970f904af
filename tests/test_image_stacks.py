"""Helpers on a stack give what they give on each of its images."""

from __future__ import annotations

import numpy as np

from inspectra.functions import images as im


def test_stacks_as_single_images():
    rng = np.random.default_rng(5)
    for h, w in ((64, 64), (40, 30), (9, 17), (24, 6)):
        stack = (rng.integers(0, 256, (5, h, w)) * (rng.random((5, h, w)) > 0.3)).astype(np.uint8)
        stack[2] = 0
        stack[3, : h // 2] = 255
        score = im.metal_score(stack)
        limits = im.side_thresholds(score)
        left = im.left_boundaries(stack)
        profile, spread = im.column_profile(stack), im.local_std(stack, 5)
        for side in "LR":
            high, low = (x[:, None, None] for x in limits[side])
            held = im.hysteresis(score >= low, score >= high, side)
            for k in range(len(stack)):
                one = im.side_thresholds(im.metal_score(stack[k]))[side]
                assert one == tuple(x[k] for x in limits[side])
                assert (im.hysteresis(score[k] >= one[1], score[k] >= one[0], side) == held[k]).all()
        for k, image in enumerate(stack):
            assert (im.metal_score(image) == score[k]).all() and (im.left_boundary(image) == left[k]).all()
            assert (im.column_profile(image) == profile[k]).all() and (im.local_std(image, 5) == spread[k]).all()


def test_neighbours_in_a_stack_do_not_touch():
    low = np.zeros((2, 4, 9), dtype=bool)
    low[0, 3], low[1, 0] = True, True
    high = np.zeros_like(low)
    high[0, 3, 0] = True
    held = im.hysteresis(low, high, "L", border=2)
    assert held[0, 3].all() and not held[1].any()


def test_rows_of_stacks_stay_with_their_rasters(spark):
    from inspectra.operators import imagery

    n = 3 * imagery.SLICE + 5
    rasters = spark.range(n).selectExpr("id AS image_id", "0 AS tile", "1 AS h", "cast(1 + id % 3 AS int) AS w", "cast(repeat(char(65 + id % 26), cast(1 + id % 3 AS int)) AS binary) AS data")
    seen = imagery.per_stack(rasters, lambda stack: [(int(x.sum()), len(stack)) for x in stack], "total int, together int").collect()
    assert {(r.image_id, r.total) for r in seen} == {(i, (65 + i % 26) * (1 + i % 3)) for i in range(n)} and len(seen) == n
    assert max(r.together for r in seen) <= imagery.STACK
