"""Queries on boundary curves and residual signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectra.operators import boundary as op
from inspectra.plans import views as v
from inspectra.plans.registry import query

RESIDUAL = "WITH r AS (SELECT image_id, side, y, x, x - median(x) OVER (PARTITION BY image_id, side) AS r FROM signal)"
SIGMA = RESIDUAL + """, m AS (SELECT *, median(r) OVER (PARTITION BY image_id, side) AS mid FROM r),
    s AS (SELECT image_id, side, y, x, r, 1.4826 * median(abs(r - mid)) OVER (PARTITION BY image_id, side) + 1e-6 AS sigma FROM m)"""
PITCH = 10
TEETH = RESIDUAL + f""", h AS (SELECT *, max(y) OVER (PARTITION BY image_id, side) + 1 AS h, y // {PITCH} AS tooth FROM r),
    t AS (SELECT * FROM h WHERE tooth * {PITCH} + {PITCH // 2} < h - {PITCH // 2})"""


def residuals(spark, sf_dir):
    return op.residuals(v.signal(spark, sf_dir))


def steady_round(column, digits):
    """Half away from zero, after what sums in another order change is rounded off: a
    half that a double only comes near is still one."""
    return F.round(F.round(column, digits + 5), digits)


def scaled_round(column, digits):
    """Half away from zero, of the scaled number as the SQL rounds it."""
    return F.round(F.col(column) * 10.0**digits) / 10.0**digits


@query("""WITH g AS (SELECT image_id, side, y, CASE WHEN y % 4 <> 1 AND y % 7 <> 0 THEN x END AS x FROM signal),
    a AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN y END IGNORE NULLS) OVER b AS y0, first_value(x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x IS NOT NULL THEN y END IGNORE NULLS) OVER f AS y1
        FROM g WINDOW b AS (PARTITION BY image_id, side ORDER BY y ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY image_id, side ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT image_id, side, CAST(y AS INTEGER) AS y, round(coalesce(x, v0 + (v1 - v0) * (y - y0) / nullif(y1 - y0, 0), v0, v1), 6) AS x FROM a""")
def w7_filled(spark, sf_dir):
    s = v.signal(spark, sf_dir).withColumn("x", F.when((F.col("y") % 4 != 1) & (F.col("y") % 7 != 0), F.col("x")))
    return op.filled(s).select("image_id", "side", "y", F.round("x", 6).alias("x"))


@query(SIGMA + " SELECT image_id, side, round(max(sigma), 6) AS sigma FROM s GROUP BY ALL")
def w8_robust_sigma(spark, sf_dir):
    return op.robust_sigma(residuals(spark, sf_dir)).groupBy("image_id", "side").agg(F.round(F.max("sigma"), 6).alias("sigma"))


@query(RESIDUAL + """, f AS (SELECT *, CASE WHEN coalesce(y - lag(y) OVER (PARTITION BY image_id, side ORDER BY y) > 3, true) THEN 1 ELSE 0 END AS new FROM r WHERE r > 60),
    g AS (SELECT *, sum(new) OVER (PARTITION BY image_id, side ORDER BY y) AS run FROM f) SELECT image_id, side, CAST(run AS BIGINT) AS run, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1, count(*) AS n FROM g GROUP BY ALL""")
def w6_runs(spark, sf_dir):
    return op.runs(residuals(spark, sf_dir).where("r > 60"), 2).groupBy("image_id", "side", "run").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


def _events(sign: int) -> str:
    return f"""SELECT image_id, side, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1, round(max(v), 6) AS peak, round(sum(v), 4) AS area, CAST(max(y) - min(y) + 1 AS INTEGER) AS height FROM (
        SELECT *, sum(new) OVER (PARTITION BY image_id, side ORDER BY y) AS run FROM (
        SELECT image_id, side, y, {sign} * r AS v, CASE WHEN coalesce(y - lag(y) OVER (PARTITION BY image_id, side ORDER BY y) > 4, true) THEN 1 ELSE 0 END AS new FROM s WHERE {sign} * r > greatest(2.0, 0.5 * sigma)))
        GROUP BY image_id, side, run HAVING max(y) - min(y) + 1 >= 6"""


@query(SIGMA + f", e AS ({_events(1)} UNION ALL {_events(-1)}) SELECT *, CASE WHEN (peak >= 4 AND height >= 8) OR (area >= 35 AND height >= 8) THEN 'NG' WHEN peak >= 2.5 AND height >= 6 THEN 'WARN' ELSE 'OK' END AS level FROM e")
def w9_u3_events(spark, sf_dir):
    r = op.robust_sigma(residuals(spark, sf_dir))
    both = op.events(r, PITCH, 1, sigmas=0.5).unionByName(op.events(r, PITCH, -1, sigmas=0.5))
    return both.select("image_id", "side", "y0", "y1", F.round("peak", 6).alias("peak"), F.round("area", 4).alias("area"), "height", "level")


@query(TEETH + f""", g AS (SELECT image_id, side, tooth, greatest(max(r), 0) AS up, greatest(-min(r), 0) AS down, sum(greatest(r, 0)) AS au, sum(greatest(-r, 0)) AS ad, arg_max(y, r) AS yu, arg_min(y, r) AS yd, count(*) AS n FROM t GROUP BY ALL),
    s AS (SELECT *, CASE WHEN abs(yu - yd) <= {0.6 * PITCH} THEN least(up, down) + 0.03 * least(au, ad) / n ELSE 0.0 END AS score FROM g)
    SELECT image_id, side, tooth, round(score, 6) AS score, CASE WHEN score >= 5.5 THEN 'NG' WHEN score >= 4 THEN 'WARN' ELSE 'OK' END AS level FROM s""")
def w10_dipoles(spark, sf_dir):
    return op.dipoles(residuals(spark, sf_dir), PITCH).select("image_id", "side", "tooth", F.round("score", 6).alias("score"), "level")


PEAKS = TEETH + """, p AS (SELECT image_id, side, tooth, max(x) AS peak, arg_max(y, x) AS y FROM t GROUP BY ALL), f AS (SELECT image_id, side, regr_slope(peak, y) AS a, regr_intercept(peak, y) AS b FROM p GROUP BY ALL),
    k AS (SELECT p.image_id, p.side, tooth, peak, y, peak - coalesce(b + a * y, peak) AS residual, abs(peak - lag(peak) OVER (PARTITION BY p.image_id, p.side ORDER BY tooth)) AS step FROM p JOIN f USING (image_id, side))"""


@query(PEAKS + " SELECT image_id, side, tooth, round(peak, 6) AS peak, CAST(y AS INTEGER) AS y, round(residual, 4) AS residual, round(step, 6) AS step FROM k")
def w11_tooth_peaks(spark, sf_dir):
    t = op.tooth_peaks(v.signal(spark, sf_dir), PITCH)
    return t.select("image_id", "side", "tooth", F.round("peak", 6).alias("peak"), "y", scaled_round("residual", 4).alias("residual"), F.round("step", 6).alias("step"))


@query(PEAKS + " SELECT image_id, side, round(coalesce(max(step), 0), 6) AS max_step, first(tooth ORDER BY step DESC, tooth) FILTER (step IS NOT NULL) AS at_tooth, round(max(abs(residual)), 4) AS max_residual FROM k GROUP BY ALL")
def w11_peak_maxima(spark, sf_dir):
    m = op.peak_maxima(op.tooth_peaks(v.signal(spark, sf_dir), PITCH))
    return m.select("image_id", "side", F.round("max_step", 6).alias("max_step"), "at_tooth", scaled_round("max_residual", 4).alias("max_residual"))


def _excursions(source: str, depth: int) -> str:
    return f"""d AS (SELECT image_id, side, sign, y, sign * r AS v FROM {source}, (VALUES (1), (-1)) s(sign) WHERE sign * r > {depth}),
    n AS (SELECT *, sum(new) OVER (PARTITION BY image_id, side, sign ORDER BY y) AS run FROM (SELECT *, CASE WHEN coalesce(y - lag(y) OVER (PARTITION BY image_id, side, sign ORDER BY y) > 1, true) THEN 1 ELSE 0 END AS new FROM d)),
    g AS (SELECT image_id, side, sign, run, sum(v - {depth}) AS area, arg_max(y, v) AS y FROM n GROUP BY ALL)
    SELECT image_id, side, CAST(sign AS INTEGER) AS sign, round(max(area), 4) AS area, CAST(arg_max(y, area) AS INTEGER) AS y FROM g GROUP BY ALL"""


@query(RESIDUAL + ", " + _excursions("r", 15))
def w12_largest_excursion(spark, sf_dir):
    return op.largest_excursion(residuals(spark, sf_dir), 15).withColumn("area", steady_round("area", 4))


@query(PEAKS + ", o AS (SELECT s.image_id, s.side, s.y, x - (b + a * s.y) AS r FROM signal s JOIN f ON s.image_id = f.image_id AND s.side = f.side), " + _excursions("o", 15))
def w12_excursion_from_peaks(spark, sf_dir):
    """From the line through the tooth peaks."""
    return op.largest_excursion(op.against_peaks(v.signal(spark, sf_dir), PITCH), 15).withColumn("area", steady_round("area", 4))


@query(RESIDUAL + """, q AS (SELECT image_id, side, y, CASE WHEN image_id % 5 = 0 THEN 3.5 ELSE r END AS r FROM r), z AS (SELECT image_id, side, y, r - avg(r) OVER (PARTITION BY image_id, side) AS r FROM q), l AS (SELECT image_id, side, lag, round(sum(a.r * b.r), 6) AS c FROM (SELECT *, unnest(range(5, 16)) AS lag FROM z) a JOIN z b USING (image_id, side) WHERE b.y = a.y + a.lag GROUP BY ALL),
    w AS (SELECT image_id, side, lag FROM (SELECT *, row_number() OVER (PARTITION BY image_id, side ORDER BY c DESC, lag) AS k FROM l) WHERE k = 1)
    SELECT z.image_id, z.side, CAST(CASE WHEN max(abs(r)) <= 1e-8 THEN 12 ELSE coalesce(max(lag), 12) END AS INTEGER) AS pitch FROM z LEFT JOIN w ON z.image_id = w.image_id AND z.side = w.side GROUP BY ALL""")
def w16_pitch(spark, sf_dir):
    """Every fifth image's curves are flat and have the fall-back."""
    r = residuals(spark, sf_dir).withColumn("r", F.when(F.col("image_id") % 5 == 0, 3.5).otherwise(F.col("r")))
    return op.pitch_estimate(r, 5, 15, fallback=12)


@query("""WITH r AS (SELECT image_id, side, y, x - median(x) OVER (PARTITION BY image_id, side) AS r FROM signal WHERE y // 11 % 5 <> 3),
    c AS (SELECT image_id, side, max(y) + 1 AS n FROM r GROUP BY ALL), g AS (SELECT image_id, side, n, unnest(CASE WHEN n > 10 THEN list_sort(list_distinct(list_append(range(0, n - 9, 6), n - 10))) ELSE [0] END) AS start FROM c),
    i AS (SELECT *, row_number() OVER (PARTITION BY image_id, side ORDER BY start) - 1 AS strip_idx FROM g),
    s AS (SELECT i.image_id, i.side, strip_idx, i.start, round(coalesce(max(abs(r)), 0.0), 4) AS bump, round(CASE WHEN count(r) < 2 THEN 0.0 ELSE abs(regr_slope(r, y)) * (max(y) - min(y)) END, 4) AS skew
        FROM i LEFT JOIN r ON i.image_id = r.image_id AND i.side = r.side AND r.y >= i.start AND r.y < i.start + 10 GROUP BY ALL),
    b AS (SELECT *, greatest(bump, 2 * skew) AS score FROM s), f AS (SELECT *, lead(score) OVER (PARTITION BY image_id, side ORDER BY strip_idx) AS following FROM b)
    SELECT image_id, side, CAST(strip_idx AS INTEGER) AS strip_idx, CAST(start AS INTEGER) AS start, bump, skew, round(CASE WHEN following IS NOT NULL THEN greatest(score, following) END, 4) AS pair FROM f""")
def w17_j8_strip_scores(spark, sf_dir):
    """Of curves with stretches missing, so that some strips are empty."""
    s = op.strip_scores(op.residuals(v.signal(spark, sf_dir).where("floor(y / 11) % 5 <> 3")), 10, 4)
    return s.select("image_id", "side", "strip_idx", "start", "bump", "skew", F.round("pair", 4).alias("pair"))


@query("WITH f AS (SELECT image_id, regr_slope(x, y) AS a, regr_intercept(x, y) AS b FROM signal WHERE side = 'L' GROUP BY image_id) SELECT image_id, CAST(y AS INTEGER) AS y, round(x - (b + a * y + 16), 4) AS gap FROM signal JOIN f USING (image_id) WHERE side = 'R'")
def j12_right_against_left(spark, sf_dir):
    return op.against_left(v.signal(spark, sf_dir), 16).select("image_id", "y", F.round("gap", 4).alias("gap"))


@query(RESIDUAL + """, h AS (SELECT *, max(y) OVER (PARTITION BY image_id, side) + 1 AS h FROM r), z AS (SELECT image_id, side, CASE WHEN y < floor(h * CASE side WHEN 'L' THEN 0.1 ELSE 0.2 END) OR (side = 'R' AND r > 0) THEN 0.0 ELSE r END AS r FROM h)
    SELECT image_id, round(max(r) FILTER (side = 'L'), 6) AS most_left, round(min(r) FILTER (side = 'L'), 6) AS least_left, round(max(r) FILTER (side = 'R'), 6) AS most_right, round(min(r) FILTER (side = 'R'), 6) AS least_right FROM z GROUP BY image_id""")
def a27_p17_extremes(spark, sf_dir):
    z = op.ignored_top(residuals(spark, sf_dir), 0.1, 0.2)
    side = lambda f, s: F.round(f(F.when(F.col("side") == s, F.col("r"))), 6)
    return z.groupBy("image_id").agg(side(F.max, "L").alias("most_left"), side(F.min, "L").alias("least_left"), side(F.max, "R").alias("most_right"), side(F.min, "R").alias("least_right"))


@query()
def w13_phase_template(spark, sf_dir):
    return op.phase_template(residuals(spark, sf_dir), PITCH)


@query()
def w14_smoothed(spark, sf_dir):
    return op.per_curve(v.signal(spark, sf_dir), lambda y, x: op.smoothed(x), "smooth")


@query()
def w15_robust_reference(spark, sf_dir):
    return op.per_curve(v.signal(spark, sf_dir), op.robust_reference, "reference")


@query("""SELECT image_id, side, CAST(y AS INTEGER) AS y, max(x) OVER (PARTITION BY image_id, side ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS tip FROM signal""")
def w5_envelope(spark, sf_dir):
    return v.signal(spark, sf_dir).select("image_id", "side", "y", F.max("x").over(op.curve().rowsBetween(-4, 4)).alias("tip"))


@query()
def w5_smooth_envelope(spark, sf_dir):
    """The envelope's median filter, with mirrored ends."""
    tips = w5_envelope(spark, sf_dir).withColumnRenamed("tip", "x")
    return op.per_curve(tips, lambda y, x: op.median_filtered(x, 5), "smooth")
