"""Active versions, timings, reports and templates against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.operators import imagery, joblog
from inspectra.sources import files

R = random.Random(10)
T0 = dt.datetime(2024, 3, 1)
at = lambda hours: T0 + dt.timedelta(hours=hours)


def test_active_version_by_loops(spark):
    names = [f"v{k:02d}" for k in range(12)]
    listing = [(R.choice("ab"), R.choice(names), R.choice(["meta.json", "x.joblib", "readme.md", "index.json", "log.txt"]), at(R.randrange(200))) for _ in range(40)]
    pins = [("a", R.choice(names), at(R.randrange(60, 200))) for _ in range(6)] + [("c", "v01", at(5))]
    jobs = [(k, R.choice("aabcd"), at(R.randrange(220))) for k in range(300)]
    want = {}
    for job, project, ts in jobs:
        mine = [(t, v) for p, v, t in pins if p == project and t <= ts]
        if mine:
            version = max(mine)[1]
            want[job] = version if any(p == project and v == version for p, v, _, _ in listing) else "none"
        else:
            good = [v for p, v, f, t in listing if p == project and t <= ts and (f in ("meta.json", "index.json") or f.endswith(".joblib"))]
            want[job] = max(good, default="none")
    got = joblog.active_version(spark.createDataFrame(jobs, "job_id long, project_id string, ts timestamp"), spark.createDataFrame(pins, "project_id string, version string, updated_at timestamp"), spark.createDataFrame(listing, "project_id string, version string, file string, ts timestamp"))
    assert {r.job_id: r.version for r in got.collect()} == want and {"none"} < set(want.values())


def test_timings_of_any_keys(spark):
    df = spark.createDataFrame([(1, '{"infer": 2.5, "odd key": 1.006, "text": "x", "total": 9}'), (2, "no json"), (3, None), (4, "{}")], "k long, body string")
    got = {r.k: r.t for r in df.select("k", joblog.merged_timing(joblog.timing_of_json(F.col("body")), F.lit(1.234), F.lit(5.0)).alias("t")).collect()}
    plain = {"wait_file": 1.23, "total": 5.0, "infer": 0.0, "post": 0.0, "save": 0.0, "read": 0.0}
    assert got[1] == plain | {"infer": 2.5, "odd key": 1.01}
    assert got[2] == got[3] == got[4] == plain


def test_reports_come_back_and_are_checked(spark, tmp_path):
    classes = spark.createDataFrame([("a", 1.5, 3, 9, 0.5, 0.9), ("b", None, 0, 0, None, None)], "cls string, thr double, n_ok long, n_patches long, score_mean double, score_max double")
    suspects = spark.createDataFrame([("a", 0.7, "train", "1.png"), ("a", 0.9, "val", "2.png")], "cls string, score double, split string, path string")
    meta = spark.createDataFrame([("patch", 42)], "algo string, seed long")
    files.write_report(classes, suspects, meta, str(tmp_path))
    index, m = files.read_report(spark, str(tmp_path))
    rows = {r.cls: r for r in index.collect()}
    assert [tuple(s) for s in rows["a"].suspects] == [(0.9, "val", "2.png"), (0.7, "train", "1.png")] and rows["b"].suspects == [] and rows["b"].thr is None
    assert m.first().asDict() == {"algo": "patch", "seed": 42}
    (tmp_path / "index" / "part-x.json").write_text('{"cls": "c", "thr": 1.0}\n')
    with pytest.raises(ValueError, match="not a row"):
        files.read_report(spark, str(tmp_path))


def test_templates_sharpen_by_alignment(spark):
    h, w, reach = 9, 7, 2
    base = {1: np.zeros((h, w)), 2: np.zeros((h, w))}
    base[1][3:6, 2:5], base[2][2:7, 3] = 10.0, 7.0
    rng = np.random.default_rng(3)
    images = [(k, c, (np.roll(base[c], (int(rng.integers(-1, 2)), int(rng.integers(-1, 2))), (0, 1)) + rng.normal(0, 0.2, (h, w)))) for k, c in enumerate([1] * 30 + [2] * 12)]
    df = spark.createDataFrame([(k, c, x.ravel().tolist()) for k, c, x in images], "image_id long, cls int, pixels array<double>").repartition(3)

    def moved(x, mean):
        held, best = np.pad(x, reach, mode="edge"), (-9, None)
        for dy in range(2 * reach + 1):
            for dx in range(2 * reach + 1):
                spot = held[dy : dy + h, dx : dx + w]
                fit = round(float(np.corrcoef(spot.ravel(), mean.ravel())[0, 1]), 9)
                best = max(best, (fit, spot), key=lambda b: b[0]) if fit > best[0] else best
        return best[1]

    want = {}
    for c in base:
        raw = [x for _, cls, x in images if cls == c]
        mean = np.mean(raw, axis=0)
        for _ in range(2):
            now = [moved(x, mean) for x in raw]
            mean = np.mean(now, axis=0)
        want[c] = (mean, np.std(now, axis=0), np.std(raw, axis=0), now)
    moments, aligned = imagery.refined_templates(df, (h, w), reach)
    got = {r.cls: r for r in moments.collect()}
    for c, (mean, std, before, _) in want.items():
        assert np.allclose(got[c].mean, mean.ravel()) and np.allclose(got[c].std, std.ravel(), atol=1e-6) and std.mean() < before.mean()
    for least, limit in ((5, 0.5), (60, 0.3)):
        for r in imagery.foreground(aligned, moments, lambda x: x > 3.5, least=least).collect():
            share = np.mean([x > 3.5 for x in want[r.cls][3]], axis=0)
            mask = share > limit
            assert r.limit == limit and r.fg_pixels == mask.sum() and np.isclose(r.fg_mean, want[r.cls][0][mask].mean()) and np.isclose(r.bg_mean, want[r.cls][0][~mask].mean())


def test_images_of_annotations_by_priority(spark):
    from inspectra.operators import geometry

    there = ["/r/a/one.png", "/r/one.png", "/x/abs.bmp", "/r/a/two.JPG", "/r/a/two.bmp", "/r/sub/a.tif", "/r/a/sub/a.tif", "/r/a/two.jpg"]
    images = spark.createDataFrame([(k, p) for k, p in enumerate(there)] + [(99, "/r/a/one.png")], "image_id long, path string")
    cases = [("/r/a/q.json", "/x/abs.bmp", 2), ("/r/a/q.json", "one.png", 0), ("/r/b/q.json", "one.png", 1), ("/r/a/two.json", "/gone.png", 7), ("/r/a/two.json", None, 7), ("/r/a/q.json", "sub/a.tif", 6), ("/r/b/q.json", "sub/a.tif", 5), ("/r/a/none.json", "", None)]
    df = spark.createDataFrame([(p, n) for p, n, _ in cases], "path string, image_path string")
    got = geometry.annotation_images(df, images, "/r", ["png", "jpg", "jpeg", "bmp", "tif"]).collect()
    assert sorted(((r.path, r.image_path, r.image_id) for r in got), key=repr) == sorted(cases, key=repr)


def test_labels_in_any_case(spark):
    from inspectra.operators import geometry

    text = '{"items": [{"label": "ok", "w": 1, "h": 1}, {"label": "NG", "w": 1, "h": 0}, {"label": "x", "w": 1, "h": 1}, {"w": 2, "h": 2}, {"label": "Ng", "w": 2, "h": 2}]}'
    rows = geometry.labelled_items(geometry.read_annotations(spark.createDataFrame([(text,)], "json string"))).collect()
    assert [r.label for r in rows] == ["OK", "NG"]
