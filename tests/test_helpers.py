"""Helpers against slow loops and known answers."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inspectra.functions import images as im
from inspectra.operators import boundary, geometry, imagery, joblog, knn, profiles, scores
from inspectra.sources import files
from inspectra.streaming import streams

RNG = np.random.default_rng(0)


def test_distance_transform_is_exact():
    mask = RNG.random((13, 17)) < 0.8
    off = np.argwhere(~mask)
    slow = np.array([[np.sqrt(((off - (y, x)) ** 2).sum(axis=1).min()) if mask[y, x] else 0.0 for x in range(17)] for y in range(13)])
    assert np.allclose(im.distance_transform(mask), slow)


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_are_the_components(diagonal):
    mask = RNG.random((20, 25)) < 0.5
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    slow, count = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if slow[y, x]:
            continue
        count += 1
        slow[y, x] = count
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < 20 and 0 <= d < 25 and mask[c, d] and not slow[c, d]:
                    slow[c, d] = count
                    queue.append((c, d))
    assert (im.labelled(mask, diagonal) == slow).all()


def test_otsu_by_trial():
    gray = np.concatenate((RNG.normal(60, 9, 500), RNG.normal(180, 12, 300))).clip(0, 255).astype(np.uint8).reshape(20, 40)
    between = []
    for t in range(256):
        a, b = gray[gray <= t].astype(float), gray[gray > t].astype(float)
        between.append(len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1)
    assert im.otsu(gray) == int(np.argmax(between))


def test_box_mean_and_std():
    g = RNG.integers(0, 255, (12, 15))
    padded = np.pad(g.astype(float), 2, mode="reflect")
    view = np.lib.stride_tricks.sliding_window_view(padded, (5, 5))
    assert np.allclose(im.box_mean(g, 5), view.mean(axis=(2, 3)))
    assert np.allclose(im.local_std(g, 5), view.std(axis=(2, 3)), atol=1e-6)


def test_morphology():
    mask = RNG.random((15, 15)) < 0.4
    assert (im.opened(im.closed(mask, 3), 3) <= im.closed(mask, 3)).all()
    assert (im.morphology(mask, 3, False) <= mask).all() and (mask <= im.morphology(mask, 3, True)).all()


def test_found_shift_and_structure():
    g = RNG.integers(0, 255, (24, 24)).astype(np.uint8)
    assert im.best_shift(im.shifted(g, 2, -1), g, 3) == (-2, 1)
    assert im.structural_score(g, g, np.ones(g.shape, bool)) == pytest.approx(0, abs=1e-9)
    assert im.structural_score(g, g, np.zeros(g.shape, bool)) == 0.0


def test_resize_keeps_constants_and_identity():
    g = RNG.integers(0, 255, (9, 11)).astype(np.uint8)
    assert (im.resize(g, 9, 11) == g).all()
    assert (im.resize(np.full((5, 7), 9, np.uint8), 12, 3) == 9).all()
    assert im.resize_padded(g, 16).shape == (16, 16)


def test_polygon_fill_counts_pixel_centres():
    assert im.polygon_mask([[[1, 1], [5, 1], [5, 4], [1, 4]]], 10, 10).sum() == 12
    assert im.polygon_mask([[[0, 0], [1, 1]]], 4, 4).sum() == 0


def test_defects_repeat_by_seed_and_keep_shares():
    g = RNG.integers(0, 255, (32, 32)).astype(np.uint8)
    kinds = [im.with_defect(g, np.random.default_rng(k))[2] for k in range(2000)]
    assert im.with_defect(g, np.random.default_rng(5))[0].tobytes() == im.with_defect(g, np.random.default_rng(5))[0].tobytes()
    assert abs(kinds.count("clean") / 2000 - 0.2) < 0.04
    assert abs(kinds.count("cutout") / 2000 - 0.24) < 0.04


def test_peaks_and_matches():
    p = np.zeros(40)
    p[[5, 7, 20]] = 3, 5, 4
    assert profiles.find_peaks(p, 1, 3).tolist() == [7, 20]
    assert profiles.match_peaks(np.array([7, 20]), np.array([9, 18, 40]), 5) == [(7, 9), (20, 18)]
    assert profiles.edge_shift(p, np.roll(p, 2)) == 2


def test_alignment_trims_the_right_ends():
    a = RNG.random(60)
    b = np.roll(a, 3)
    x, y = profiles.aligned(a, b, 6)
    assert np.allclose(x, y)
    x, y = profiles.aligned(a, b, 6, legacy_trim=True)
    assert not np.allclose(x, y)


def test_smoothing_keeps_parabolas():
    x = np.linspace(-1, 1, 41) ** 2
    assert np.allclose(boundary.savgol_weights(7, 2).sum(), 1)
    inner = np.lib.stride_tricks.sliding_window_view(x, 7) @ boundary.savgol_weights(7, 2)
    assert np.allclose(inner, x[3:-3])


def test_robust_reference_ignores_outliers():
    y = np.arange(100.0)
    x = 3 + 0.1 * y
    x[40:44] += 50
    assert np.abs(boundary.robust_reference(y, x) - (3 + 0.1 * y)).max() < 1.5


def test_nearest_against_brute_force(spark):
    x = RNG.standard_normal((60, 8))
    rows = [(int(i % 3), int(i), [float(v) for v in x[i]]) for i in range(60)]
    bank = spark.createDataFrame(rows, "cls int, bank_id long, emb array<double>")
    for k, own in ((1, False), (3, True)):
        got = {r.query_id: r.d for r in knn.self_distances(bank, exclude_self=own, k=k).collect()}
        small = {r.query_id: r.d for r in knn.nearest(bank.withColumnRenamed("bank_id", "query_id"), bank, k, own, share_rows=7).collect()}
        for i in range(60):
            d = sorted(np.linalg.norm(x[i] - x[j]) for j in range(60) if j % 3 == i % 3 and not (own and i == j))[:k]
            assert got[i] == pytest.approx(np.mean(d), abs=1e-6) and small[i] == pytest.approx(np.mean(d), abs=1e-6)


def test_samples_and_splits_have_exact_sizes(spark):
    rows = spark.range(1003).withColumn("cls", (F.col("id") % 2).cast("int"))
    assert scores.split(rows, "id", 0.15).where("split = 'val'").count() == 150
    assert scores.split(rows.limit(1), "id", 0.15).where("split = 'val'").count() == 1
    sample = scores.sample_per_group(rows, ["cls"], 10, "id")
    assert sample.groupBy("cls").count().where("count <> 10").count() == 0
    assert {r.id for r in sample.collect()} == {r.id for r in scores.sample_per_group(rows.repartition(7), ["cls"], 10, "id").collect()}
    w = {r.cls: r.weight for r in scores.class_weights(rows, "cls").collect()}
    assert w[0] == pytest.approx(1003 / (2 * 502), rel=1e-6)


def test_tiles_cover_and_end_at_the_edge(spark):
    images = spark.createDataFrame([(1, 1000, 352), (2, 100, 90), (3, 512, 353)], "image_id int, w int, h int")
    for r in geometry.tiles(images, 512, 352, 384, 352).groupBy("image_id", "w").agg(F.min("x0").alias("a"), F.max("x1").alias("b")).collect():
        assert r.a == 0 and r.b == r.w


def test_tile_function_says_the_same(spark):
    imagery.position_udtf(spark)
    for n in (1, 512, 513, 900, 2000):
        got = sorted(r.start for r in spark.sql(f"SELECT start FROM tile_positions({n}, 512, 384)").collect())
        want = sorted(spark.range(1).select(F.explode(geometry.positions(F.lit(n), 512, 384)).alias("s")).toPandas()["s"])
        assert got == want


def test_thresholds_and_names(spark):
    one = spark.range(1)
    got = one.select(joblog.threshold(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.3)).alias("a"), joblog.threshold(F.lit(0.0), F.lit(0.4), F.lit(0.3)).alias("b")).first()
    assert (got.a, got.b) == (0.3, 0.0)
    names = spark.createDataFrame([("/",), ("A",), ("",), ("\t",)], "ch string").select(geometry.safe_name(F.col("ch")).alias("n")).toPandas()["n"].tolist()
    assert names == ["slash", "A", "empty", "tab"]


def test_registry_names_unknown_algorithms():
    r = imagery.Registry()
    r.register("patch", len)
    with pytest.raises(KeyError, match="patch"):
        r.get("other")


def test_image_source_reads_bitmaps_and_drops_broken_ones(spark, tmp_path):
    h, w = 2, 4
    pixels = bytes(range(h * w * 3))
    head = b"BM" + (54 + len(pixels)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(pixels).to_bytes(4, "little") + bytes(16)
    (tmp_path / "a.bmp").write_bytes(head + info + pixels)
    (tmp_path / "b.bmp").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    rows = files.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and (rows[0].height, rows[0].width, rows[0].channels) == (2, 4, 3)
    gray = im.to_gray(np.frombuffer(rows[0].data, np.uint8).reshape(2, 4, 3))
    assert gray.shape == (2, 4)
    assert [r.path.rsplit("/", 1)[1] for r in files.list_images(spark, str(tmp_path)).collect()] == ["a.bmp", "b.bmp"]


def test_annotations_allow_a_mark_and_odd_items(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"image_name": "a.png", "items": [{"ch": "x", "cx": 5, "cy": 5, "w": 2, "h": 2, "i": 3}, {"ch": "", "w": 1, "h": 1}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"image_name": "b.png", "items": 7}')
    rows = geometry.valid_items(geometry.read_annotations(files.read_text_files(spark, str(tmp_path)))).collect()
    assert [(r.image_name, r.ch, r.idx) for r in rows] == [("a.png", "x", 3)]


def test_live_fold_equals_the_weighted_sum():
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=50, freq="s"), "job_id": range(50), "pred": ["OK", "NG", "WARN", "ERROR", "OK"] * 10, "infer_ms": RNG.random(50)})
    once = streams.fold(streams.EMPTY, rows)
    twice = streams.fold(streams.fold(streams.EMPTY, rows[20:]), rows[:20])
    x = rows["infer_ms"].to_numpy()
    weights = 0.9 ** np.arange(49, -1, -1.0) * np.where(np.arange(50) == 0, 1, 0.1)
    row = streams.live_row(once)
    assert once == twice and row[:4] == (50, 20, 10, 20) and row[4] == pytest.approx((weights * x).sum()) and row[5] == rows["ts"].iloc[-1]


def test_unpaired_images_come_out_after_the_watermark(spark, tmp_path):
    for k, rows in enumerate((["a,image,2024-01-01 00:00:00", "b,image,2024-01-01 00:00:01", "a,json,2024-01-01 00:00:05"], ["z,image,2024-01-01 01:00:00", "z,json,2024-01-01 01:00:01"])):
        (tmp_path / f"{k}.csv").write_text("\n".join(rows))
    e = lambda: spark.readStream.schema("stem string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).csv(str(tmp_path))
    out = streams.drain(streams.pairs(e().where("kind = 'image'"), e().where("kind = 'json'")), "pairs-test")
    got = {r.stem: r.json_ts is not None for r in out.collect()}
    assert got == {"a": True, "b": False, "z": True}


def test_seeds_are_high_components_at_the_border():
    low, high = np.zeros((20, 40), bool), np.zeros((20, 40), bool)
    low[2:6, 0:30] = True
    high[3, 20:25] = True  # inside a low component at the border, but not itself there
    assert not im.hysteresis(low, high, "L").any()
    high[4, 5:9] = True
    assert (im.hysteresis(low, high, "L") == low).all() and not im.hysteresis(low, high, "R").any()


def test_boundary_is_where_the_groove_ends():
    rng = np.random.default_rng(0)
    g = rng.integers(120, 255, (64, 64)).astype(np.uint8)
    g[:, 15:40] = 20
    found = im.left_boundary(g)
    assert len(found) == 8 and (abs(found - 15) <= 3).all()
    assert (im.left_boundary(np.repeat(g[..., None], 3, axis=2)) == found).all() and len(im.left_boundary(g[:5])) == 0


def test_metal_score_and_thresholds():
    rng = np.random.default_rng(1)
    g = np.full((40, 80), 30, np.uint8)
    g[:, :20] = rng.integers(0, 255, (40, 20))
    m = im.metal_score(g)
    assert m[:, :16].mean() > 0.3 > m[:, 30:50].mean() and m.min() >= 0 and m.max() <= 1
    (hi, lo), _ = (im.side_thresholds(m)[s] for s in "LR")
    assert hi > lo > 0 and im.hysteresis(m >= lo, m >= hi, "L")[:, :16].mean() > 0.5


def test_shape_score_is_the_distance_to_the_nearest_foreground():
    g = np.zeros((30, 30), np.uint8)
    g[10:20, 10:20] = 200
    mask = im.foreground(g)
    assert im.shape_score(g, mask) == 0
    g[16:20, 16:20] = 0
    near = lambda m, y, x: np.sqrt(((np.argwhere(m) - (y, x)) ** 2).sum(axis=1).min())
    slow = [abs(near(im.foreground(g), y, x) - near(mask, y, x)) for y, x in np.argwhere(im.morphology(mask, 9, True))]
    assert im.shape_score(g, mask) == pytest.approx(np.percentile(slow, 99)) and max(slow) > 1


def test_peaks_are_matched_in_turn():
    assert profiles.match_peaks(np.array([5, 8]), np.array([7, 30]), 5) == [(5, 7)]
    p = np.zeros(40)
    p[20] = 4
    assert profiles.edge_shift(np.roll(p, 3), p) == 3


def test_smoothing_follows_cubics_to_the_ends():
    x = np.linspace(-1, 1, 41) ** 3
    assert np.allclose(boundary.smoothed(x, median=1), x)
    assert boundary.smoothed(np.array([1.0, 5.0, 2.0])).shape == (3,)
