"""Queries on maps, masks and rasters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.functions import images as im
from inspectra.operators import imagery as op
from inspectra.operators import knn, profiles, ranks, scores
from inspectra.plans import views as v
from inspectra.plans.calibration import absolute_sum
from inspectra.plans.profiles import ZPAIRS
from inspectra.plans.registry import query


SIDE = 64


def rasters(spark, sf_dir):
    """The bytes of each text as gray tiles of 64 x 64; the last one is filled up
    with zeros, a text without bytes has one of zeros."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), data.alias("data"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("data") / SIDE**2).cast("int") - 1)
    d = d.select("image_id", "data", F.explode(F.sequence(F.lit(0), last)).alias("tile"))
    part = F.substring("data", F.col("tile") * SIDE**2 + 1, F.lit(SIDE**2))
    return d.select("image_id", "tile", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.rpad(part, F.lit(SIDE**2), F.lit(b"\0")).alias("data"))


@query("SELECT image_id, round(quantile_cont(v, 0.999), 6) AS score, round(max(v), 6) AS most FROM heatmap GROUP BY image_id")
def a12_map_score(spark, sf_dir):
    h = v.heatmap(spark, sf_dir)
    return op.map_score(h).join(op.map_score(h, None).withColumnRenamed("score", "most"), "image_id").select("image_id", F.round("score", 6).alias("score"), F.round("most", 6).alias("most"))


TILES = "WITH t AS (SELECT image_id // 8 AS image_id, y + 4 * (image_id % 8) AS y, x, v FROM heatmap)"


def tile_cells(spark, sf_dir):
    """Eight maps per image, each four rows below the one before."""
    h, i = v.heatmap(spark, sf_dir), F.col("image_id")
    return h.select(F.floor(i / 8).alias("image_id"), (F.col("y") + 4 * (i % 8)).alias("y"), "x", "v")


@query(TILES + " SELECT image_id, y, x, round(max(v), 6) AS v FROM t GROUP BY ALL")
def a13_stitched(spark, sf_dir):
    return op.stitched(tile_cells(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query(TILES + ", m AS (SELECT image_id, y, x, avg(abs(v)) AS v FROM t GROUP BY ALL) SELECT image_id, y, x, round(v / max(v) OVER (PARTITION BY image_id), 6) AS v FROM m")
def a14_stitched_mean(spark, sf_dir):
    cells = tile_cells(spark, sf_dir).withColumn("v", F.abs("v"))
    return op.scaled_by_maximum(op.stitched(cells, "mean")).withColumn("v", F.round("v", 6))


_AT = "m[greatest(0, least(3, {0})) * 4 + greatest(0, least(3, {1})) + 1]"


@query(f"""WITH e AS (SELECT vec_id // 16 AS image_id, vec_id % 16 AS k, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), s AS (SELECT image_id, k, f AS a, lead(f) OVER w AS b, lead(k) OVER w AS kb FROM e WINDOW w AS (PARTITION BY image_id ORDER BY k)),
    d AS (SELECT image_id, k, kb, list_transform(range(0, 16), lambda i: sqrt(pow(a[i + 1] - b[i + 1], 2) + pow(a[i + 17] - b[i + 17], 2) + pow(a[i + 33] - b[i + 33], 2) + pow(a[i + 49] - b[i + 49], 2) + 1e-8)) AS m FROM s WHERE b IS NOT NULL),
    p AS (SELECT *, unnest(range(0, 6 * (kb - k) + 8)) AS y FROM d), g AS (SELECT *, unnest(range(0, 64)) AS x, (y + 0.5) * 4 / (6 * (kb - k) + 8) - 0.5 AS py FROM p), t AS (SELECT *, (x + 0.5) / 16 - 0.5 AS px FROM g),
    f AS (SELECT *, CAST(floor(py) AS BIGINT) AS iy, CAST(floor(px) AS BIGINT) AS ix FROM t),
    v AS (SELECT image_id, 6 * k + y AS y, x, (1 - (py - iy)) * ((1 - (px - ix)) * {_AT.format('iy', 'ix')} + (px - ix) * {_AT.format('iy', 'ix + 1')}) + (py - iy) * ((1 - (px - ix)) * {_AT.format('iy + 1', 'ix')} + (px - ix) * {_AT.format('iy + 1', 'ix + 1')}) AS v FROM f),
    h AS (SELECT image_id, y, x, avg(v) AS v FROM v GROUP BY ALL) SELECT image_id, y, x, round(v / max(v) OVER (PARTITION BY image_id), 6) AS v FROM h""")
def a14_difference_map(spark, sf_dir):
    """Strips' vectors as feature maps of 4 channels of 4 x 4 places."""
    strips = v.strip_boxes(v.profiles(spark, sf_dir))
    both = profiles.union_box(profiles.pairs(strips, "profile", "x0", "y0", "x1", "y1"))
    return op.difference_heat(op.difference_maps(both, (4, 4, 4))).withColumn("v", F.round("v", 6))


@query(ZPAIRS + """, d AS (SELECT image_id, strip_idx, list_distance(a, b) / 8 AS d, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS c FROM z), w AS (SELECT *, pow(d / max(d) OVER (PARTITION BY image_id), 2) AS w FROM d),
    g AS (SELECT image_id, strip_idx, unnest(c) * w AS v, generate_subscripts(c, 1) - 1 AS x FROM w), r AS (SELECT image_id, 6 * strip_idx + y AS y, x, v FROM (SELECT *, unnest(range(0, 14)) AS y FROM g)),
    h AS (SELECT image_id, y, x, avg(v) AS v FROM r GROUP BY ALL) SELECT image_id, y, x, round(v / max(v) OVER (PARTITION BY image_id), 6) AS v FROM h""")
def a14_weighted_curves(spark, sf_dir):
    """Difference curves of neighbouring profiles, weighted by their pairs' distances."""
    strips = profiles.normalised(v.strip_boxes(v.profiles(spark, sf_dir)))
    both = profiles.union_box(profiles.pairs(strips, "profile", "x0", "y0", "x1", "y1"))
    curves = both.select("image_id", "x0", "y0", "x1", "y1", F.lit(True).alias("vertical"), profiles.rms(F.col("a"), F.col("b")).alias("d"), profiles.difference_curve(F.col("a"), F.col("b")).alias("curve"))
    return op.difference_heat(op.weighted_curves(curves)).withColumn("v", F.round("v", 6))


@query("""WITH c AS (SELECT e.label AS cls, h.y, h.x, h.v FROM heatmap h JOIN embeddings e ON h.image_id = e.vec_id), t AS (SELECT cls, y, x, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) > 0.5 AS mask FROM c GROUP BY ALL)
    SELECT cls, count(*) FILTER (mask) AS fg_pixels, round(avg(mean) FILTER (mask), 6) AS fg_mean, round(avg(mean) FILTER (NOT mask), 6) AS bg_mean FROM t GROUP BY cls""")
def a15_templates(spark, sf_dir):
    cls = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("cls"))
    cells = v.heatmap(spark, sf_dir).join(cls, "image_id").withColumn("fg", F.col("v") > 0)
    return op.templates(cells)[1].select("cls", "fg_pixels", F.round("fg_mean", 6).alias("fg_mean"), F.round("bg_mean", 6).alias("bg_mean"))


def _round_sql(k: int) -> str:
    """The images (c0: raw) moved to fit the means of the round before, and their means."""
    return f"""p{k} AS (SELECT image_id, cls, dy, dx, spots.y, spots.x, c0.v FROM spots JOIN c0 ON spots.sy = c0.y AND spots.sx = c0.x),
    f{k} AS (SELECT image_id, dy, dx, round(coalesce(corr(p{k}.v, m{k - 1}.m), 0), 9) AS fit FROM p{k} JOIN m{k - 1} USING (cls, y, x) GROUP BY ALL),
    b{k} AS (SELECT image_id, dy, dx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fit DESC, dy, dx) AS r FROM f{k}) WHERE r = 1),
    c{k} AS (SELECT p{k}.* FROM p{k} JOIN b{k} USING (image_id, dy, dx)), m{k} AS (SELECT cls, y, x, avg(v) AS m, stddev_pop(v) AS sd FROM c{k} GROUP BY ALL)"""


@query(f"""WITH c0 AS (SELECT h.image_id, e.label AS cls, h.y, h.x, h.v FROM heatmap h JOIN embeddings e ON h.image_id = e.vec_id), m0 AS (SELECT cls, y, x, avg(v) AS m FROM c0 GROUP BY ALL),
    spots AS (SELECT a AS dy, b AS dx, c AS y, d AS x, least(7, greatest(0, c + a)) AS sy, least(7, greatest(0, d + b)) AS sx FROM range(-2, 3) t(a), range(-2, 3) u(b), range(8) v(c), range(8) w(d)),
    {_round_sql(1)}, {_round_sql(2)}, s AS (SELECT cls, y, x, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS share FROM c2 GROUP BY ALL),
    l AS (SELECT cls, CASE WHEN count(*) FILTER (share > 0.5) < 33 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS lim FROM s GROUP BY cls), k AS (SELECT cls, y, x, m, sd, share > lim AS fg, lim FROM s JOIN l USING (cls) JOIN m2 USING (cls, y, x))
    SELECT cls, lim AS "limit", count(*) FILTER (fg) AS fg_pixels, round(coalesce(avg(m) FILTER (NOT fg), 255), 6) AS bg_mean, round(coalesce(avg(m) FILTER (fg), 0), 6) AS fg_mean, round(avg(sd), 6) AS mean_std, round(sum(m * (8 * y + x)), 6) AS mixed FROM k GROUP BY cls, lim""")
def a15_refined_templates(spark, sf_dir):
    """Templates after two rounds of alignment, and masks with the looser limit where they are small."""
    pixels = F.transform("embedding", lambda x: x.cast("double"))
    images = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("cls"), pixels.alias("pixels"))
    moments, aligned = op.refined_templates(images, (8, 8), 2)
    t = op.foreground(aligned, moments, lambda x: x > 0, least=33)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mixed = total(F.transform("mean", lambda x, k: x * k))
    return t.select("cls", "limit", F.col("fg_pixels").cast("long").alias("fg_pixels"), *[F.round(c, 6).alias(c) for c in ("bg_mean", "fg_mean")], F.round(total("std") / F.size("std"), 6).alias("mean_std"), F.round(mixed, 6).alias("mixed"))


@query("""WITH m AS (SELECT a.image_id, a.v > 0 AS gt, b.v > 0 AS pred FROM heatmap a JOIN heatmap b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x)
    SELECT image_id, round(CASE WHEN count(*) FILTER (gt OR pred) = 0 THEN 1.0 ELSE count(*) FILTER (gt AND pred) / count(*) FILTER (gt OR pred) END, 6) AS iou, round((2 * count(*) FILTER (gt AND pred) + 1) / (count(*) FILTER (gt) + count(*) FILTER (pred) + 1), 6) AS dice FROM m GROUP BY image_id""")
def a20_j4_iou(spark, sf_dir):
    h = v.heatmap(spark, sf_dir)
    gt, pred = h.select("image_id", "y", "x", (F.col("v") > 0).alias("gt")), h.select((F.col("image_id") - 1).alias("image_id"), "y", "x", (F.col("v") > 0).alias("pred"))
    return op.iou(gt.join(pred, ["image_id", "y", "x"])).select("image_id", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query("""WITH s AS (SELECT image_id, avg(CASE WHEN gray > 127 THEN 1.0 ELSE 0.0 END) AS share FROM pixels GROUP BY image_id)
    SELECT image_id, round(share, 6) AS share, CASE WHEN share < 0.45 THEN 'NG' ELSE 'OK' END AS verdict, round(CASE WHEN share < 0.45 THEN 1 - share ELSE share END, 6) AS score FROM s""")
def a23_p14_coverage(spark, sf_dir):
    c = op.coverage_gate(v.pixels(spark, sf_dir), 0.45)
    return c.select("image_id", F.round("share", 6).alias("share"), "verdict", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT a.image_id, a.v > 0 AS gt, b.v > 0 AS pred FROM heatmap a JOIN heatmap b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x),
    i AS (SELECT image_id, CASE WHEN count(*) FILTER (gt OR pred) = 0 THEN 1.0 ELSE count(*) FILTER (gt AND pred) / count(*) FILTER (gt OR pred) END AS iou, (2 * count(*) FILTER (gt AND pred) + 1) / (count(*) FILTER (gt) + count(*) FILTER (pred) + 1) AS dice FROM m GROUP BY image_id)
    SELECT count(*) AS images, round(avg(iou), 6) AS mean_iou, round(avg(dice), 6) AS mean_dice FROM i""")
def a20_mean_iou(spark, sf_dir):
    h = v.heatmap(spark, sf_dir)
    gt, pred = h.select("image_id", "y", "x", (F.col("v") > 0).alias("gt")), h.select((F.col("image_id") - 1).alias("image_id"), "y", "x", (F.col("v") > 0).alias("pred"))
    return op.iou(gt.join(pred, ["image_id", "y", "x"])).agg(F.count(F.lit(1)).alias("images"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg("dice"), 6).alias("mean_dice"))


@query("""WITH h AS (SELECT image_id, gray AS bin, count(*) AS c FROM pixels GROUP BY ALL), w AS (SELECT *, sum(c) OVER o AS low, sum(c * bin) OVER o AS mass, sum(c) OVER (PARTITION BY image_id) AS n, sum(c * bin) OVER (PARTITION BY image_id) AS total FROM h WINDOW o AS (PARTITION BY image_id ORDER BY bin)),
    b AS (SELECT image_id, bin, round(coalesce(low * (n - low) * pow(mass / low - (total - mass) / nullif(n - low, 0), 2), 0), 6) AS b FROM w)
    SELECT image_id, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, bin) AS r FROM b) WHERE r = 1""")
def a24_otsu(spark, sf_dir):
    return op.otsu_threshold(v.pixels(spark, sf_dir))


@query("SELECT image_id, y, x, CAST(round(greatest(0.0, least(1.0, (v + 0.3) / 0.6)) * 65535) AS INTEGER) AS u16, v >= 0.85 * 0.2 AS masked FROM heatmap")
def m21_u16_and_mask(spark, sf_dir):
    return v.heatmap(spark, sf_dir).select("image_id", "y", "x", op.as_u16(F.col("v"), -0.3, 0.3).alias("u16"), (F.col("v") >= 0.85 * 0.2).alias("masked"))


@query("SELECT image_id, y, x, round((0.2989 * gray + 0.5870 * ((gray + 40) % 256) + 0.1140 * ((gray + 90) % 256)) / 255, 6) AS lum FROM pixels")
def m1_luminance(spark, sf_dir):
    g = F.col("gray")
    return v.pixels(spark, sf_dir).select("image_id", "y", "x", F.round((0.2989 * g + 0.5870 * ((g + 40) % 256) + 0.1140 * ((g + 90) % 256)) / 255, 6).alias("lum"))


@query("WITH p AS (SELECT image_id, y, quantile_cont(gray, 0.1) AS lo, quantile_cont(gray, 0.9) AS hi FROM pixels GROUP BY ALL) SELECT image_id, y, x, round(greatest(0, least(1, (gray - lo) / greatest(hi - lo, 1e-6))), 12) AS s FROM pixels JOIN p USING (image_id, y)")
def w18_row_stretch(spark, sf_dir):
    p = v.pixels(spark, sf_dir)
    r = p.groupBy("image_id", "y").agg(F.percentile("gray", F.lit(0.1)).alias("lo"), F.percentile("gray", F.lit(0.9)).alias("hi"))
    return p.join(r, ["image_id", "y"]).select("image_id", "y", "x", F.round(op.scaled(F.col("gray"), F.col("lo"), F.greatest(F.col("hi"), F.col("lo") + 1e-6)), 12).alias("s"))


@query("SELECT image_id, y, x, round(gray - median(gray) OVER (PARTITION BY image_id, y), 6) AS r FROM pixels")
def w18_row_median(spark, sf_dir):
    return op.less_row_median(v.pixels(spark, sf_dir), "gray").select("image_id", "y", "x", F.round("gray", 6).alias("r"))


@query("SELECT image_id, 'L' AS side, y, max(x) AS x FROM heatmap WHERE x < 4 AND v > 0.1 GROUP BY ALL UNION ALL SELECT image_id, 'R', y, min(x) FROM heatmap WHERE x >= 4 AND v > 0.1 GROUP BY ALL")
def i15_inner_boundary(spark, sf_dir):
    on = v.heatmap(spark, sf_dir).where("v > 0.1")
    left, right = op.inner_boundary(on.where("x < 4"), "L"), op.inner_boundary(on.where("x >= 4"), "R")
    sides = [d.select("image_id", F.lit(s).alias("side"), "y", "x") for d, s in ((left, "L"), (right, "R"))]
    return sides[0].unionByName(sides[1])


@query("""SELECT a.image_id, a.y, a.x, bool_or(b.v > 0.2) AS dilated, bool_and(b.v > -0.2) AS eroded FROM heatmap a JOIN heatmap b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL""")
def i8_morphology(spark, sf_dir):
    h = v.heatmap(spark, sf_dir)
    on = lambda limit: h.select("image_id", "y", "x", (F.col("v") > limit).alias("on"))
    grown = op.neighbours(on(0.2), 3, True).withColumnRenamed("on", "dilated")
    return grown.join(op.neighbours(on(-0.2), 3, False).withColumnRenamed("on", "eroded"), ["image_id", "y", "x"])


@query("SELECT image_id, x, round(avg(v), 6) AS mean FROM heatmap GROUP BY image_id, x")
def i12_column_mean(spark, sf_dir):
    return v.heatmap(spark, sf_dir).groupBy("image_id", "x").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("""WITH r AS (SELECT image_id, points[3][1] - points[1][1] AS pw, points[3][2] - points[1][2] AS ph, w, h, points[1][1] AS x0, points[1][2] AS y0 FROM polygons WHERE len(points) >= 3 AND lower(trim(label)) = 'panel')
    SELECT image_id, greatest(0, least(x0 + pw, w) - x0) * greatest(0, least(y0 + ph, h) - y0) AS area FROM r""")
def i16_polygon_area(spark, sf_dir):
    """Pixels of the scan-line filled mask of each panel; no mask is as large as its image."""
    p = v.spread(v.polygons(spark, sf_dir).where((F.size("points") >= 3) & (F.lower(F.trim("label")) == "panel")))

    def run(batches):
        for batch in batches:
            area = [im.polygon_area(np.stack(p).astype(float), h, w) for p, h, w in zip(batch["points"], batch["h"], batch["w"], strict=True)]
            yield batch[["image_id"]].assign(area=area)

    return p.mapInPandas(run, "image_id long, area long")


@query()
def i9_t1_regions(spark, sf_dir):
    def run(gray, seed):
        return [(k, r["x"], r["y"], r["w"], r["h"], r["score"], r["area_px"]) for k, r in enumerate(im.regions(gray > 110, gray.astype(float), 3))]

    return op.per_image(rasters(spark, sf_dir), run, "rank int, x int, y int, w int, h int, score double, area_px int")


@query()
def i2_i3_i11_features(spark, sf_dir):
    """Resized, equalised, edge and texture means of each raster."""

    def run(gray, seed):
        return [(float(im.resize(gray, 16, 16).mean()), float(im.resize_padded(gray, 32).mean()), float(im.equalised(gray).mean()), float(im.edges(gray).mean()), float(im.local_std(gray, 5).mean()))]

    return op.per_image(rasters(spark, sf_dir), run, "resized double, padded double, equalised double, edges double, texture double")


@query()
def i4_i7_shape(spark, sf_dir):
    """Foreground share, and the shape score against the raster's own centred mask."""

    def run(gray, seed):
        mask = im.foreground(gray)
        return [(float(mask.mean()), im.otsu(gray), im.shape_score(im.centred(gray), mask))]

    return op.per_image(rasters(spark, sf_dir), run, "share double, otsu int, shape_score double")


@query()
def i5_i6_structure(spark, sf_dir):
    """Found shift of a moved copy, and its structural score once moved back."""

    def run(gray, seed):
        moved = im.shifted(gray, 1, 2)
        dy, dx = im.best_shift(moved, gray, 3)
        return [(dy, dx, im.structural_score(im.shifted(moved, dy, dx), gray, np.ones(gray.shape, bool)))]

    return op.per_image(rasters(spark, sf_dir), run, "dy int, dx int, score double")


@query()
def i10_i13_i14_boundaries(spark, sf_dir):
    def run(stack):
        m, n = im.metal_score(stack), len(stack)
        limits = {side: [x[:, None, None] for x in pair] for side, pair in im.side_thresholds(m).items()}
        left, right = (im.hysteresis(m >= limits[s][1], m >= limits[s][0], s).sum(axis=(1, 2)) for s in "LR")
        means = m.reshape(n, -1).mean(axis=1), left, right, im.left_boundaries(stack).mean(axis=1), im.column_profile(stack).mean(axis=1)
        return list(zip(*(x.tolist() for x in means), strict=True))

    return op.per_stack(rasters(spark, sf_dir), run, "metal double, left_pixels int, right_pixels int, boundary double, profile_mean double")


@query()
def i18_i19_synthetic(spark, sf_dir):
    """Kind and mask size of a seeded defect on each raster, after augmentation."""

    def run(gray, seed):
        rng = np.random.default_rng(seed)
        a, mask = im.augmented(gray, np.zeros(gray.shape, bool), rng)
        _, mask, kind = im.with_defect(np.ascontiguousarray(a), rng)
        return [(kind, int(mask.sum()))]

    return op.per_image(rasters(spark, sf_dir), run, "kind string, mask_px int")


@query("""WITH x AS (SELECT image_id, w, unnest(CASE WHEN w > 512 THEN list_distinct(list_append(range(0, w - 511, 384), w - 512)) ELSE [0] END) AS start FROM image_index)
    SELECT image_id, CAST(start AS INTEGER) AS start, CAST(least(w, start + 512) AS INTEGER) AS stop FROM x""")
def x4_tile_function(spark, sf_dir):
    op.position_udtf(spark)
    v.image_index(spark, sf_dir).createOrReplaceTempView("image_index_rows")
    return spark.sql("SELECT image_id, t.start, t.stop FROM image_index_rows, LATERAL tile_positions(w, 512, 384) t")


@query("""WITH p AS (SELECT image_id, patch_idx, list_sum(list_transform(emb, lambda x: abs(x))) AS d FROM patches), l AS (SELECT image_id, list_reverse_sort(list(d)) AS ds, list_sort(list(d)) AS up, count(*) AS n FROM p GROUP BY image_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, patch_idx) AS rk FROM p), g AS (SELECT image_id, n, ds, up, greatest(1, CAST(round_even(sqrt(n), 0) AS BIGINT)) AS h FROM l),
    w AS (SELECT *, CASE WHEN h * h = n THEN h ELSE n // h END AS w FROM g), c AS (SELECT image_id, avg(d) AS top, sqrt(var_pop(patch_idx // w) + var_pop(patch_idx % w)) AS spread, any_value(h) AS h, any_value(w) AS w FROM k JOIN w USING (image_id) WHERE rk <= 3 GROUP BY image_id)
    SELECT image_id, n, round(ds[1], 6) AS max, round(top, 6) AS topk, round(list_avg(ds[1:greatest(1, CAST(trunc(n * (1 - 60 / 100::DOUBLE)) AS BIGINT))]), 6) AS percentile, round(0.3 * ds[1] + 0.7 * top, 6) AS hybrid,
        round(top / (up[(n + 1) // 2] + 1e-6), 6) AS contrast, round(top * (2 - least(spread / (sqrt(pow(c.h / 2, 2) + pow(c.w / 2, 2)) + 1e-6), 1.0)), 6) AS spatial
    FROM l JOIN c USING (image_id)""")
def x3_score_aggregate(spark, sf_dir):
    """All modes of a group's score from bounded summaries that tasks merge."""
    d = v.patches(spark, sf_dir).select("image_id", "patch_idx", absolute_sum("emb").alias("d"))
    s = ranks.group_scores(d, ["image_id"], "d", "patch_idx", 3, 60, 0.3)
    return s.select("image_id", "n", *[F.round(c, 6).alias(c) for c in ("max", "topk", "percentile", "hybrid", "contrast", "spatial")])


@query("""WITH p AS (SELECT image_id, list_sum(list_transform(emb, lambda x: abs(x))) AS d FROM patches), l AS (SELECT image_id, list_reverse_sort(list(d)) AS ds, list_sort(list(d)) AS up FROM p GROUP BY image_id),
    s AS (SELECT *, list_avg(ds[1:10]) AS top FROM l)
    SELECT 'max' AS algorithm, image_id, round(ds[1], 6) AS score FROM s UNION ALL SELECT 'topk', image_id, round(top, 6) FROM s
    UNION ALL SELECT 'percentile', image_id, round(list_avg(ds[1:greatest(1, CAST(trunc(len(ds) * (1 - 0.99::DOUBLE)) AS BIGINT))]), 6) FROM s
    UNION ALL SELECT 'hybrid', image_id, round(0.5 * ds[1] + 0.5 * top, 6) FROM s
    UNION ALL SELECT 'contrast', image_id, round(top / (up[(len(up) + 1) // 2] + 1e-6), 6) FROM s""")
def x1_registered_algorithm(spark, sf_dir):
    """The scores of every registered algorithm, each found by its name."""
    registry = op.Registry()
    for name, mode in scores.MODES.items():
        registry.register(name, lambda df, mode=mode: df.groupBy("image_id").agg(F.round(mode(F.collect_list("d")), 6).alias("score")))
    distances = v.patches(spark, sf_dir).select("image_id", absolute_sum("emb").alias("d"))
    found = [registry.get(name)[0](distances).select(F.lit(name).alias("algorithm"), "image_id", "score") for name in registry.names()]
    return reduce(DataFrame.unionByName, found)


@query()
def x2_patch_embedding(spark, sf_dir):
    """Default embedder: 8 x 8 pixel patches, projected and normalised."""

    def run(gray, seed):
        h, w = gray.shape[0] // 8, gray.shape[1] // 8
        p = gray[: h * 8, : w * 8].reshape(h, 8, w, 8).transpose(0, 2, 1, 3).reshape(-1, 64).astype(float) / 255
        return [(k, row) for k, row in enumerate(p)]

    patches = op.per_image(rasters(spark, sf_dir), run, "patch_idx int, emb array<double>")
    return knn.projection(patches, "emb", 16).select("image_id", "tile", "patch_idx", F.transform("emb", lambda x: F.round(x, 9)).alias("emb"))


@query()
def i1_cropped_tiles(spark, sf_dir):
    """Tiles of each raster, padded by their edges to full size."""

    def run(gray, seed):
        out = []
        for k, y in enumerate(range(0, gray.shape[0], 24)):
            tile = im.crop(gray, (40, y, 72, y + 24), (24, 32))
            out.append((k, tile.shape[0], tile.shape[1], float(tile.mean())))
        return out

    return op.per_image(rasters(spark, sf_dir), run, "part int, h int, w int, mean double")


@query()
def i17_probability_mask(spark, sf_dir):
    def run(gray, seed):
        mask = im.probability_mask(gray / 255, gray.shape[0] * 2, 128, 0.4)
        return [(int(mask.sum()), float(mask.mean()))]

    return op.per_image(rasters(spark, sf_dir), run, "pixels int, share double")
