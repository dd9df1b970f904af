"""Queries on strip profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectra.operators import knn
from inspectra.operators import profiles as op
from inspectra.plans import views as v
from inspectra.plans.registry import query

_NEXT = "lead({0}) OVER (PARTITION BY image_id ORDER BY strip_idx)"
PAIRS = f"WITH q AS (SELECT image_id, CAST(strip_idx AS INTEGER) AS strip_idx, profile AS a, {_NEXT.format('profile')} AS b FROM profiles), p AS (SELECT * FROM q WHERE b IS NOT NULL)"
_Z = "CASE WHEN {sd} < 1e-8 THEN list_transform({v}, lambda x: 0.0::DOUBLE) ELSE list_transform({v}, lambda x: (x - {m}) / {sd}) END"
#: Normalised profiles (zp), and pairs of them (z: a, b).
ZPAIRS = f"""WITH zm AS (SELECT image_id, CAST(strip_idx AS INTEGER) AS strip_idx, profile, list_avg(profile) AS m FROM profiles),
    zs AS (SELECT *, sqrt(list_avg(list_transform(profile, lambda x: (x - m) * (x - m)))) AS sd FROM zm),
    zp AS (SELECT image_id, strip_idx, {_Z.format(v='profile', m='m', sd='sd')} AS z FROM zs),
    zq AS (SELECT image_id, strip_idx, z AS a, {_NEXT.format('z')} AS b FROM zp), z AS (SELECT * FROM zq WHERE b IS NOT NULL)"""


def pairs(spark, sf_dir):
    return op.pairs(v.profiles(spark, sf_dir))


def normalised_pairs(spark, sf_dir, *more):
    return op.pairs(op.normalised(v.strip_boxes(v.profiles(spark, sf_dir))), "profile", *more)


def rounded(column, name):
    return F.round(column, 6).alias(name)


@query(PAIRS + """ SELECT image_id, strip_idx, round(list_distance(a, b), 6) AS l2, round(1 - list_cosine_similarity(a, b), 6) AS cosine, 0 AS x0, strip_idx * 6 AS y0, 64 AS x1, strip_idx * 6 + 14 AS y1 FROM p""")
def w1_pair_distances(spark, sf_dir):
    """With the area of both strips."""
    a, b = F.col("a"), F.col("b")
    both = op.union_box(op.pairs(v.strip_boxes(v.profiles(spark, sf_dir)), "profile", "x0", "y0", "x1", "y1"))
    return both.select("image_id", "strip_idx", rounded(knn.l2(a, b), "l2"), rounded(knn.cosine_distance(a, b), "cosine"), "x0", "y0", "x1", "y1")


@query(PAIRS + " SELECT image_id, max(d) AS worst, arg_max(strip_idx, d) AS strip_idx, CASE WHEN max(d) >= 1.5 THEN 'NG' ELSE 'OK' END AS verdict FROM (SELECT image_id, strip_idx, round(list_distance(a, b), 6) AS d FROM p) GROUP BY image_id")
def t2_worst_pair(spark, sf_dir):
    d = pairs(spark, sf_dir).select("image_id", "strip_idx", rounded(knn.l2(F.col("a"), F.col("b")), "d"))
    return d.groupBy("image_id").agg(F.max("d").alias("worst"), F.max_by("strip_idx", F.struct("d", -F.col("strip_idx"))).alias("strip_idx")).withColumn("verdict", F.when(F.col("worst") >= 1.5, "NG").otherwise("OK"))


@query(ZPAIRS + " SELECT image_id, strip_idx, generate_subscripts(z, 1) - 1 AS pos, round(unnest(z), 6) AS v FROM zp")
def m12_z_normalised(spark, sf_dir):
    z = op.normalised(v.profiles(spark, sf_dir))
    return z.select("image_id", "strip_idx", F.posexplode("profile").alias("pos", "v")).select("image_id", "strip_idx", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query(PAIRS + f""", c AS (SELECT image_id, strip_idx, a, list_concat(b, a) AS b FROM p),
    m AS (SELECT *, list_avg(a) AS ma, list_avg(b) AS mb FROM c), s AS (SELECT *, sqrt(list_avg(list_transform(a, lambda x: (x - ma) * (x - ma)))) AS sa, sqrt(list_avg(list_transform(b, lambda x: (x - mb) * (x - mb)))) AS sb FROM m),
    n AS (SELECT image_id, strip_idx, {_Z.format(v='a', m='ma', sd='sa')} AS a, {_Z.format(v='b', m='mb', sd='sb')} AS b FROM s),
    r AS (SELECT image_id, strip_idx, b, list_transform(range(0, 128), lambda i: a[1 + CAST(floor(i * 63 / 127) AS BIGINT)] + (a[least(64, 2 + CAST(floor(i * 63 / 127) AS BIGINT))] - a[1 + CAST(floor(i * 63 / 127) AS BIGINT)]) * (i * 63 / 127 - floor(i * 63 / 127))) AS a FROM n)
    SELECT image_id, strip_idx, round(list_distance(a, b) / sqrt(128), 6) AS d FROM r""")
def m13_m14_resampled_rms(spark, sf_dir):
    """Of each profile, and the next one followed by itself, which is twice as long."""
    long = pairs(spark, sf_dir).select("image_id", "strip_idx", op.z_normalised(F.col("a")).alias("a"), op.z_normalised(F.concat("b", "a")).alias("b"))
    return op.of_one_length(long).select("image_id", "strip_idx", rounded(op.rms(F.col("a"), F.col("b")), "d"))


@query(ZPAIRS + " SELECT image_id, strip_idx, round(list_distance(a, b) / 8, 6) AS l2, round(CASE WHEN sqrt(list_dot_product(a, a) * list_dot_product(b, b)) < 1e-12 THEN 0.0 ELSE 1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) END, 6) AS correlation FROM z")
def m14_profile_distances(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return normalised_pairs(spark, sf_dir).select("image_id", "strip_idx", rounded(op.rms(a, b), "l2"), rounded(op.correlation_distance(a, b), "correlation"))


@query(PAIRS + ", m AS (SELECT *, list_avg(a) AS ma, list_avg(b) AS mb FROM p), c AS (SELECT *, list_transform(a, lambda x: x - ma) AS ca, list_transform(b, lambda x: x - mb) AS cb FROM m) SELECT image_id, strip_idx, round(1 - list_cosine_similarity(ca, cb), 6) AS d FROM c")
def m14_correlation_distance(spark, sf_dir):
    return normalised_pairs(spark, sf_dir).select("image_id", "strip_idx", rounded(op.correlation_distance(F.col("a"), F.col("b")), "d"))


@query("""WITH g AS (SELECT image_id, CAST(strip_idx AS INTEGER) AS strip_idx, unnest(range(0, 4)) AS seg, profile FROM profiles), s AS (SELECT image_id, strip_idx, seg, profile[16 * seg + 1:16 * seg + 16] AS v FROM g),
    m AS (SELECT *, list_avg(v) AS m FROM s), d AS (SELECT *, sqrt(list_avg(list_transform(v, lambda x: (x - m) * (x - m)))) AS sd FROM m),
    z AS (SELECT image_id, strip_idx, seg, """ + _Z.format(v="v", m="m", sd="sd") + """ AS a FROM d), q AS (SELECT *, lead(a) OVER (PARTITION BY image_id, seg ORDER BY strip_idx) AS b FROM z),
    p AS (SELECT image_id, strip_idx, list_distance(a, b) / 4 AS d FROM q WHERE b IS NOT NULL)
    SELECT image_id, strip_idx, round(max(d), 6) AS distance, round(max(d) - min(d), 6) AS skew FROM p GROUP BY ALL""")
def m17_segment_distance(spark, sf_dir):
    d = op.pairs(op.with_segments(v.profiles(spark, sf_dir), 4)).select("image_id", "strip_idx", op.segment_distances(F.col("a"), F.col("b")).alias("d"))
    return d.select("image_id", "strip_idx", rounded(F.array_max("d"), "distance"), rounded(F.array_max("d") - F.array_min("d"), "skew"))


@query(ZPAIRS + " SELECT image_id, strip_idx, generate_subscripts(a, 1) - 1 AS pos, round(abs(unnest(a) - unnest(b)), 6) AS v FROM z")
def m18_difference_curve(spark, sf_dir):
    c = normalised_pairs(spark, sf_dir).select("image_id", "strip_idx", F.posexplode(op.difference_curve(F.col("a"), F.col("b"))).alias("pos", "v"))
    return c.select("image_id", "strip_idx", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


#: Products at every shift s of a against b.
SHIFTED = "SELECT image_id, strip_idx, s, a, b, round(list_dot_product(a[greatest(0, s) + 1:64 - greatest(0, -s)], b[greatest(0, -s) + 1:64 - greatest(0, s)]), 9) AS c FROM (SELECT *, unnest(range(-{0}, {0} + 1)) AS s FROM z)"


@query(ZPAIRS + f", c AS ({SHIFTED.format(63)}) SELECT image_id, strip_idx, abs(s) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY image_id, strip_idx ORDER BY c DESC, s) AS r FROM c) WHERE r = 1")
def m15_profile_shift(spark, sf_dir):
    return op.shifts(normalised_pairs(spark, sf_dir)).select("image_id", "strip_idx", "shift")


@query(ZPAIRS + f""", c AS ({SHIFTED.format(5)}), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, strip_idx ORDER BY c DESC, s) AS r FROM c) WHERE r = 1),
    t AS (SELECT image_id, strip_idx, 64 - abs(s) AS n, a[greatest(0, -s) + 1:64 - greatest(0, s)] AS a, b[greatest(0, s) + 1:64 - greatest(0, -s)] AS b FROM w)
    SELECT image_id, strip_idx, round(list_distance(a, b) / sqrt(n), 6) AS l2, round(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS correlation FROM t""")
def m15_lined_up_distances(spark, sf_dir):
    d = op.lined_up_distances(normalised_pairs(spark, sf_dir), 5)
    return d.select("image_id", "strip_idx", rounded(F.col("l2"), "l2"), rounded(F.col("correlation"), "correlation"))


@query()
def w3_j9_m16_peak_matches(spark, sf_dir):
    return op.peak_matches(pairs(spark, sf_dir))


CELLS = "WITH c AS (SELECT image_id, CAST(strip_idx AS INTEGER) AS strip_idx, unnest(profile) AS v, CAST(generate_subscripts(profile, 1) - 1 AS INTEGER) AS pos FROM profiles)"


def cells(spark, sf_dir):
    return v.profiles(spark, sf_dir).select("image_id", "strip_idx", F.posexplode("profile").alias("pos", "v"))


@query(CELLS + " SELECT image_id, strip_idx, pos, round(sum(v) OVER (PARTITION BY image_id, strip_idx ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM c")
def w4_boxcar(spark, sf_dir):
    return op.boxcar(cells(spark, sf_dir), ["image_id", "strip_idx"], "pos", "v", 5).select("image_id", "strip_idx", "pos", F.round("smooth", 6).alias("smooth"))


_W = [float(x) for x in op.gaussian_weights(5)]


@query(CELLS + f" SELECT image_id, strip_idx, pos, round({' + '.join(f'coalesce(lag(v, {2 - k}) OVER w, 0.0) * {_W[k]!r}::DOUBLE' for k in range(5))}, 6) AS smooth FROM c WINDOW w AS (PARTITION BY image_id, strip_idx ORDER BY pos)")
def w4_gaussian(spark, sf_dir):
    return op.gaussian(cells(spark, sf_dir), ["image_id", "strip_idx"], "pos", "v", 5).select("image_id", "strip_idx", "pos", F.round("smooth", 6).alias("smooth"))


@query(ZPAIRS + " SELECT round(greatest(quantile_cont(list_distance(a, b) / 8, 0.999) * 1.5, 0.1), 6) AS thr, count(*) AS n_pairs, count(DISTINCT image_id) AS n_images FROM z")
def a6_pair_threshold(spark, sf_dir):
    d = normalised_pairs(spark, sf_dir).select("image_id", op.rms(F.col("a"), F.col("b")).alias("d"))
    return d.agg(F.round(F.greatest(F.percentile("d", F.lit(0.999)) * 1.5, F.lit(0.1)), 6).alias("thr"), F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("image_id").alias("n_images"))
