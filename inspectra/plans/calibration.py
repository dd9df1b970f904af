"""Queries on nearest neighbours, scores, thresholds, samples and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectra.operators import knn, scores
from inspectra.plans import views as v
from inspectra.plans.registry import query
from inspectra.sources import files
from inspectra.sources.folders import shared_path, stored

NEAREST = """WITH d AS (SELECT q.query_id, q.cls, b.bank_id, list_distance(q.emb, b.emb) AS d FROM queries q JOIN bank b ON q.cls = b.cls AND q.query_id <> b.bank_id),
    n AS (SELECT query_id, cls, avg(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d) AS r FROM d) WHERE r <= %d GROUP BY ALL)"""


def patch_distances(spark, sf_dir, k=1):
    return knn.nearest(v.queries(spark, sf_dir), v.bank(spark, sf_dir), k, exclude_self=True)


@query(NEAREST % 1 + " SELECT query_id, cls, round(d, 6) AS d FROM n")
def j5_nearest_distance(spark, sf_dir):
    return patch_distances(spark, sf_dir).select("query_id", "cls", F.round("d", 6).alias("d"))


@query(NEAREST % 3 + " SELECT query_id, cls, round(d, 6) AS d FROM n")
def j5_mean_of_three(spark, sf_dir):
    return patch_distances(spark, sf_dir, 3).select("query_id", "cls", F.round("d", 6).alias("d"))


@query(NEAREST % 3 + " SELECT query_id, cls, round(d, 6) AS d FROM n")
def j5_j7_pruned_search(spark, sf_dir):
    """The same distances, with shares of the bank skipped where they can't hold a nearer row."""
    found = knn.PrunedSearch(v.queries(spark, sf_dir), v.bank(spark, sf_dir), 3, exclude_self=True, pivots=8).nearest()
    return found.select("query_id", "cls", F.round("d", 6).alias("d"))


@query("SELECT q.query_id, round(sqrt(greatest(min(pow(list_distance(q.emb, b.emb), 2)), 0) + 1e-12), 6) AS d FROM queries q JOIN bank b ON q.query_id <> b.bank_id GROUP BY q.query_id")
def j6_global_bank(spark, sf_dir):
    q, b = v.queries(spark, sf_dir).withColumn("cls", F.lit(0)), v.bank(spark, sf_dir).withColumn("cls", F.lit(0))
    return knn.nearest(q, b, exclude_self=True).select("query_id", F.round(F.sqrt(F.col("d") * F.col("d") + 1e-12), 6).alias("d"))


@query("SELECT a.bank_id AS query_id, a.cls, round(min(list_distance(a.emb, b.emb)), 6) AS d FROM bank a JOIN bank b ON a.cls = b.cls AND a.bank_id <> b.bank_id GROUP BY ALL")
def j7_self_distance(spark, sf_dir):
    return knn.self_distances(v.bank(spark, sf_dir), exclude_self=True).select("query_id", "cls", F.round("d", 6).alias("d"))


@query(NEAREST % 1 + """, i AS (SELECT query_id // 200 AS image_id, max(d) AS score, count(*) AS patches FROM n GROUP BY 1), t AS (SELECT quantile_cont(score, 0.9) AS thr FROM i)
    SELECT image_id, patches, round(score, 6) AS score, round(thr, 6) AS thr, CASE WHEN score > thr THEN 'NG' ELSE 'OK' END AS decision FROM i, t""")
def slice_region_inspection(spark, sf_dir):
    """Nearest distances, one score per image, the threshold, the verdict."""
    d = patch_distances(spark, sf_dir).withColumn("image_id", F.floor(F.col("query_id") / 200))
    images = d.groupBy("image_id").agg(F.max("d").alias("score"), F.count(F.lit(1)).alias("patches")).withColumn("all", F.lit(1))
    thr = scores.quantile_threshold(images, "all", "score", 0.9)
    out = images.join(F.broadcast(thr), "all")  # one row
    return out.select("image_id", "patches", F.round("score", 6).alias("score"), F.round("thr", 6).alias("thr"), F.when(F.col("score") > F.col("thr"), "NG").otherwise("OK").alias("decision"))


LISTS = """WITH p AS (SELECT image_id, patch_idx, list_sum(list_transform(emb, lambda x: abs(x))) AS d FROM patches), l AS (SELECT image_id, list_reverse_sort(list(d)) AS ds FROM p GROUP BY image_id)"""


def absolute_sum(vector):
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))


def patch_scores(spark, sf_dir):
    """A patch's score: the sum of its vector's absolute values (its length is 1)."""
    return v.patches(spark, sf_dir).select("image_id", "patch_idx", absolute_sum("emb").alias("d"))


def image_lists(spark, sf_dir):
    return patch_scores(spark, sf_dir).groupBy("image_id").agg(F.collect_list("d").alias("ds"))


@query(LISTS + " SELECT image_id, round(ds[1], 6) AS most, round(list_avg(ds[1:3]), 6) AS top FROM l")
def a8_max_and_top_mean(spark, sf_dir):
    return image_lists(spark, sf_dir).select("image_id", F.round(F.array_max("ds"), 6).alias("most"), F.round(scores.top_mean(F.col("ds"), 3), 6).alias("top"))


@query(LISTS + " SELECT image_id, round(list_avg(ds[1:greatest(1, CAST(trunc(len(ds) * 0.4) AS BIGINT))]), 6) AS pct, round(0.3 * ds[1] + 0.7 * list_avg(ds[1:3]), 6) AS hyb FROM l")
def a9_percentile_and_hybrid(spark, sf_dir):
    d = F.col("ds")
    return image_lists(spark, sf_dir).select("image_id", F.round(scores.percentile_mean(d, 60), 6).alias("pct"), F.round(scores.hybrid(d, 0.3, 3), 6).alias("hyb"))


@query(LISTS + " SELECT image_id, round(list_avg(ds[1:3]) / (list_sort(ds)[(len(ds) + 1) // 2] + 1e-6), 6) AS score FROM l")
def a10_contrast(spark, sf_dir):
    return image_lists(spark, sf_dir).select("image_id", F.round(scores.contrast(F.col("ds"), 3), 6).alias("score"))


@query(LISTS + """, g AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, patch_idx) AS rk FROM p),
    h AS (SELECT *, greatest(1, CAST(round_even(sqrt(n), 0) AS BIGINT)) AS h FROM g), c AS (SELECT *, CASE WHEN h * h = n THEN h ELSE n // h END AS w FROM h WHERE rk <= 3),
    s AS (SELECT image_id, avg(d) AS m, sqrt(var_pop(patch_idx // w) + var_pop(patch_idx % w)) AS spread, any_value(h) AS h, any_value(w) AS w FROM c GROUP BY image_id)
    SELECT image_id, round(m * (2 - least(spread / (sqrt(pow(h / 2, 2) + pow(w / 2, 2)) + 1e-6), 1.0)), 6) AS score FROM s""")
def a11_spatial(spark, sf_dir):
    return scores.spatial(patch_scores(spark, sf_dir), 3).withColumn("score", F.round("score", 6))


OKS = NEAREST % 1


@query(OKS + " SELECT cls, round(quantile_cont(d, 0.995), 6) AS thr, round(greatest(quantile_cont(d, 0.9) * 1.15, 1.2), 6) AS safe FROM n GROUP BY cls")
def a5_a6_thresholds(spark, sf_dir):
    d = patch_distances(spark, sf_dir)
    safe = scores.quantile_threshold(d, "cls", "d", 0.9, 1.15, 1.2).withColumnRenamed("thr", "safe")
    out = scores.quantile_threshold(d, "cls", "d", 0.995).join(safe, "cls")
    return out.select("cls", F.round("thr", 6).alias("thr"), F.round("safe", 6).alias("safe"))


@query(OKS + " SELECT cls, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS least, round(max(d), 6) AS most, round(quantile_cont(d, 0.999), 6) AS q999 FROM n GROUP BY cls")
def a7_ok_statistics(spark, sf_dir):
    s = scores.ok_statistics(patch_distances(spark, sf_dir), "cls", "d")
    return s.select("cls", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most", "q999")])


@query(OKS + ", t AS (SELECT cls, quantile_cont(d, 0.8) AS thr FROM n GROUP BY cls) SELECT cls, count(*) FILTER (d > thr) AS above, quantile_cont(d, 0.97) > 2 * quantile_cont(d, 0.90) AS bimodal FROM n JOIN t USING (cls) GROUP BY cls")
def a25_suspicious_banks(spark, sf_dir):
    d = patch_distances(spark, sf_dir)
    return scores.bimodal(d.join(scores.quantile_threshold(d, "cls", "d", 0.8), "cls"), "cls", "d")


@query(OKS + " SELECT cls, rank, query_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(d, 6) DESC, query_id) AS rank FROM n) WHERE rank <= 5")
def w19_suspects(spark, sf_dir):
    d = patch_distances(spark, sf_dir).withColumn("d", F.round("d", 6))
    return knn.with_rank(d, "cls", "d", "query_id", 5).select("cls", F.col("rank").cast("long").alias("rank"), "query_id", "d")


@query(OKS + """, c AS (SELECT cls, count(*) AS n_ok, quantile_cont(d, 0.995) AS thr, avg(d) AS mean, max(d) AS most FROM n GROUP BY cls), p AS (SELECT cls, count(*) AS n_patches FROM bank GROUP BY cls),
    s AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(d, 6) DESC, query_id) AS rank FROM n)
    SELECT CAST(cls AS VARCHAR) AS cls, round(thr, 6) AS thr, n_ok, n_patches, round(mean, 6) AS score_mean, round(most, 6) AS score_max, (SELECT count(*) FROM bank) AS n_bank, rank, round(d, 6) AS score, CASE WHEN query_id % 100 = 0 THEN 'val' ELSE 'train' END AS split, query_id || '.png' AS path
    FROM s JOIN c USING (cls) JOIN p USING (cls) WHERE rank <= 5""")
def s9_training_report(spark, sf_dir):
    """Written and read back: thresholds and statistics per class, with its suspects nested."""
    folder = shared_path(spark, "report")
    bank = v.bank(spark, sf_dir)
    d = stored(patch_distances(spark, sf_dir), "distances")
    stats = scores.ok_statistics(d, "cls", "d").select("cls", F.col("n").alias("n_ok"), F.col("mean").alias("score_mean"), F.col("most").alias("score_max"))
    classes = stats.join(scores.quantile_threshold(d, "cls", "d", 0.995), "cls").join(bank.groupBy("cls").agg(F.count(F.lit(1)).alias("n_patches")), "cls")
    top = knn.with_rank(d.withColumn("d", F.round("d", 6)), "cls", "d", "query_id", 5)
    suspects = top.select("cls", F.col("d").alias("score"), F.when(F.col("query_id") % 100 == 0, "val").otherwise("train").alias("split"), F.concat("query_id", F.lit(".png")).alias("path"))
    files.write_report(classes, suspects, bank.agg(F.count(F.lit(1)).alias("n_bank")), folder)
    index, meta = files.read_report(spark, folder)
    flat = index.withColumn("_one", F.lit(1)).join(F.broadcast(meta.withColumn("_one", F.lit(1))), "_one").select("*", F.explode("suspects").alias("s"))  # one row of meta
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("s.score"), F.regexp_extract("s.path", r"^(\d+)", 1).cast("long")))
    return flat.select("cls", *[F.round(c, 6).alias(c) for c in ("thr", "score_mean", "score_max")], "n_ok", "n_patches", "n_bank", rank.cast("long").alias("rank"), "s.score", "s.split", "s.path")


@query("SELECT cls, count(*) AS n FROM bank GROUP BY cls HAVING count(*) >= 50")
def p7_min_per_class(spark, sf_dir):
    return v.bank(spark, sf_dir).groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")


def digest_order(key: str) -> str:
    """SQL of the order in which scores.hash_order has the keys."""
    return f"CAST('0x' || substr(md5('42:' || {key}), 1, 13) AS BIGINT)"


ORDERED_BANK = f"WITH b AS (SELECT cls, bank_id, bank_id // 16 AS tile, {digest_order('bank_id')} AS o FROM bank)"


@query(ORDERED_BANK + """, t AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY o, bank_id) AS r FROM b), c AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY o, bank_id) AS k FROM t WHERE r <= 8)
    SELECT cls, bank_id, tile FROM c WHERE k <= 30""")
def a16_sample_bank(spark, sf_dir):
    """At most 8 patches of a tile of 16, then at most 30 of a class."""
    b = v.bank(spark, sf_dir).select("cls", "bank_id", F.floor(F.col("bank_id") / 16).alias("tile"))
    return scores.sample_per_group(scores.sample_per_group(b, ["tile"], 8, "bank_id"), ["cls"], 30, "bank_id")


@query("SELECT cls, bank_id, n AS bank_before, greatest(5, least(25, n)) AS bank_after FROM (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls ORDER BY bank_id) AS r FROM bank) WHERE r <= greatest(5, least(25, n))")
def a17_shrink_bank(spark, sf_dir):
    return scores.shrink_bank(v.bank(spark, sf_dir), 25, 5, first=True).select("cls", "bank_id", "bank_before", F.col("bank_after").cast("long").alias("bank_after"))


ORDERED_TRUTH = f"WITH t AS (SELECT *, {digest_order('sample_id')} AS o FROM truth)"


@query(ORDERED_TRUTH + """, r AS (SELECT *, row_number() OVER (ORDER BY o, sample_id) AS r, count(*) OVER () AS n FROM t)
    SELECT sample_id, CASE WHEN r <= greatest(1, CAST(floor(n * 0.15) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r""")
def a18_split(spark, sf_dir):
    return scores.split(v.truth(spark, sf_dir), "sample_id", 0.15).select("sample_id", "split")


@query(ORDERED_TRUTH + """, r AS (SELECT *, row_number() OVER (PARTITION BY actual_ng ORDER BY o, sample_id) AS r, count(*) OVER (PARTITION BY actual_ng) AS n FROM t)
    SELECT sample_id, actual_ng, CASE WHEN r <= least(greatest(5, CAST(round_even(n * 0.15, 0) AS BIGINT)), greatest(0, n - 10)) THEN 'val' ELSE 'train' END AS split FROM r""")
def a18_split_per_class(spark, sf_dir):
    return scores.split(v.truth(spark, sf_dir), "sample_id", 0.15, "actual_ng", 10).select("sample_id", "actual_ng", "split")


@query("""WITH c AS (SELECT count(*) FILTER (actual_ng AND predicted_ng) AS tp, count(*) FILTER (NOT actual_ng AND predicted_ng) AS fp, count(*) FILTER (actual_ng AND NOT predicted_ng) AS fn, count(*) FILTER (NOT actual_ng AND NOT predicted_ng) AS tn FROM truth)
    SELECT *, round((tp + tn) / greatest(tp + fp + fn + tn, 1e-6), 6) AS accuracy, round(tp / greatest(tp + fp, 1e-6), 6) AS precision, round(tp / greatest(tp + fn, 1e-6), 6) AS recall FROM c""")
def a19_confusion(spark, sf_dir):
    c = scores.confusion(v.truth(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", *[F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall")])


@query("SELECT actual_ng, n, round(sum(n) OVER () / (count(*) OVER () * (n + 1e-6)), 6) AS weight FROM (SELECT actual_ng, count(*) AS n FROM truth GROUP BY actual_ng)")
def a21_class_weights(spark, sf_dir):
    return scores.class_weights(v.truth(spark, sf_dir), "actual_ng").withColumn("weight", F.round("weight", 6))


@query("""WITH e AS (SELECT sample_id % 20 AS run, sample_id % 13 AS epoch, avg(CASE WHEN actual_ng = predicted_ng THEN 1.0 ELSE 0.0 END) AS metric FROM truth GROUP BY ALL)
    SELECT run, epoch, round(metric, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS r FROM e) WHERE r = 1""")
def a22_best_epoch(spark, sf_dir):
    e = v.truth(spark, sf_dir).groupBy((F.col("sample_id") % 20).alias("run"), (F.col("sample_id") % 13).alias("epoch")).agg(F.avg((F.col("actual_ng") == F.col("predicted_ng")).cast("double")).alias("metric"))
    return e.groupBy("run").agg(F.max_by("epoch", F.struct("metric", -F.col("epoch"))).alias("epoch"), F.round(F.max("metric"), 6).alias("metric"))


LOGITS = "WITH s AS (SELECT *, exp(logit_ok - greatest(logit_ok, logit_ng)) AS a, exp(logit_ng - greatest(logit_ok, logit_ng)) AS b FROM logits), p AS (SELECT sample_id, cls, round(a / (a + b), 6) AS prob_ok, round(b / (a + b), 6) AS prob_ng FROM s)"


def probabilities(spark, sf_dir):
    z = F.array("logit_ok", "logit_ng")
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    index = F.transform_keys(F.create_map(F.lit("OK"), F.lit(1), F.lit("ng"), F.lit(2)), lambda k, _: F.lower(k))
    p = F.transform(e, lambda x: F.round(x / total, 6))
    return v.logits(spark, sf_dir).select("sample_id", "cls", F.element_at(p, F.element_at(index, "ok")).alias("prob_ok"), F.element_at(p, F.element_at(index, "ng")).alias("prob_ng"))


@query(LOGITS + " SELECT sample_id, prob_ok, prob_ng, CASE WHEN prob_ng > prob_ok THEN 'NG' ELSE 'OK' END AS by_argmax, CASE WHEN prob_ng > 0.4 THEN 'NG' ELSE 'OK' END AS by_threshold FROM p")
def p11_m11_m22_probabilities(spark, sf_dir):
    ng = F.col("prob_ng")
    return probabilities(spark, sf_dir).select("sample_id", "prob_ok", "prob_ng", F.when(ng > F.col("prob_ok"), "NG").otherwise("OK").alias("by_argmax"), F.when(ng > 0.4, "NG").otherwise("OK").alias("by_threshold"))


SCORES2 = """WITH s AS (SELECT vec_id AS sample_id, label AS cls, abs(CAST(embedding[1] AS DOUBLE)) * 10 AS score, abs(CAST(embedding[3] AS DOUBLE)) * 10 AS dt FROM embeddings)"""


def two_scores(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cls"), (F.abs(F.element_at("embedding", 1).cast("double")) * 10).alias("score"), (F.abs(F.element_at("embedding", 3).cast("double")) * 10).alias("dt"))


@query(SCORES2 + " SELECT sample_id, CASE WHEN score >= 1.0 THEN 'NG' ELSE 'OK' END AS inclusive, score > 0.8 AND (cls % 2 = 0 OR dt > 0.7) AS both_gates FROM s")
def p10_p12_gates(spark, sf_dir):
    dt_thr = F.when(F.col("cls") % 2 == 0, 0.0).otherwise(0.7)
    gates = (F.col("score") > 0.8) & ((dt_thr == 0) | (F.col("dt") > dt_thr))
    return two_scores(spark, sf_dir).select("sample_id", F.when(F.col("score") >= 1.0, "NG").otherwise("OK").alias("inclusive"), gates.alias("both_gates"))


@query(SCORES2 + """, r AS (SELECT sample_id // 8 AS image_id, cls, score, 1.2 + cls / 10.0::DOUBLE AS thr, CASE WHEN cls = 9 THEN 'UNKNOWN' WHEN score > 1.2 + cls / 10.0::DOUBLE THEN 'NG' ELSE 'OK' END AS decision FROM s),
    g AS (SELECT image_id, count(*) AS total, count(*) FILTER (decision = 'NG') AS ng_count, count(*) FILTER (decision = 'UNKNOWN') AS unk_count, round(coalesce(max(score) FILTER (decision <> 'UNKNOWN'), 0.0), 6) AS score, round(coalesce(max(thr) FILTER (decision <> 'UNKNOWN'), 0.0), 6) AS threshold FROM r GROUP BY image_id)
    SELECT *, CASE WHEN ng_count > 0 THEN 'NG' ELSE 'OK' END AS verdict, CASE WHEN ng_count + unk_count > 0 THEN 'NG' ELSE 'OK' END AS strict_verdict FROM g""")
def a4_image_verdict(spark, sf_dir):
    """Counts, the largest score and threshold, and the verdict, without and with unknown regions as faults."""
    s = two_scores(spark, sf_dir).withColumns({"image_id": F.floor(F.col("sample_id") / 8), "thr": 1.2 + F.col("cls") / 10})
    decided = s.withColumn("decision", F.when(F.col("cls") == 9, "UNKNOWN").when(F.col("score") > F.col("thr"), "NG").otherwise("OK"))
    images = s.select("image_id").distinct()
    plain, strict = scores.image_verdict(images, decided), scores.image_verdict(images, decided, count_unknown=True)
    out = plain.join(strict.select("image_id", F.col("verdict").alias("strict_verdict")), "image_id")
    return out.select("image_id", "total", "ng_count", "unk_count", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "verdict", "strict_verdict")


COLUMNS = knn.projection_matrix(64, 16).T.tolist()


@query(f"""WITH p AS (SELECT vec_id, list_transform(CAST({COLUMNS} AS DOUBLE[][]), lambda c: list_dot_product(CAST(embedding AS DOUBLE[]), c)) AS z FROM embeddings),
    n AS (SELECT vec_id, z, greatest(sqrt(list_dot_product(z, z)), 1e-12) AS length FROM p)
    SELECT vec_id, dim, round(value / length, 6) AS value FROM (SELECT vec_id, length, generate_subscripts(z, 1) - 1 AS dim, unnest(z) AS value FROM n)""")
def m9_m10_projection(spark, sf_dir):
    p = knn.projection(v.table(spark, sf_dir, "embeddings"), "embedding", 16)
    return p.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("SELECT image_id, round(list_sum(list_transform(m, lambda x: x * x)), 6) AS squared, n FROM (SELECT image_id, list(avg ORDER BY dim) AS m, max(n) AS n FROM (SELECT image_id, dim, avg(e) AS avg, count(*) AS n FROM (SELECT image_id, unnest(emb) AS e, generate_subscripts(emb, 1) AS dim FROM patches) GROUP BY ALL) GROUP BY image_id)")
def m24_pooled_patches(spark, sf_dir):
    cells = v.patches(spark, sf_dir).select("image_id", F.posexplode("emb").alias("dim", "e")).groupBy("image_id", "dim").agg(F.avg(F.col("e").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    pooled = cells.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("c"), F.max("n").alias("n"))
    return pooled.select("image_id", F.round(knn.dot(F.col("c.m"), F.col("c.m")), 6).alias("squared"), "n")


@query(f"""WITH c AS (SELECT image_id, unnest(emb) AS e, generate_subscripts(emb, 1) AS dim FROM patches), a AS (SELECT image_id, dim, avg(e) AS m FROM c GROUP BY ALL), l AS (SELECT image_id, list(m ORDER BY dim) AS m FROM a GROUP BY image_id),
    p AS (SELECT image_id, list_transform(CAST({COLUMNS} AS DOUBLE[][]), lambda k: list_dot_product(m, k)) AS z FROM l), n AS (SELECT image_id, z, greatest(sqrt(list_dot_product(z, z)), 1e-12) AS length FROM p)
    SELECT image_id, dim, round(value / length, 6) AS value FROM (SELECT image_id, length, generate_subscripts(z, 1) - 1 AS dim, unnest(z) AS value FROM n)""")
def m24_pooled_vectors(spark, sf_dir):
    """A strip's patches as one vector: the mean, projected and normalised."""
    pooled = knn.projection(knn.pooled(v.patches(spark, sf_dir), "image_id", "emb"), "emb", 16)
    return pooled.select("image_id", F.posexplode("emb").alias("dim", "value")).select("image_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(f"""WITH o AS (SELECT *, {digest_order('bank_id')} AS o FROM bank), r AS (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls ORDER BY o, bank_id) AS r FROM o), s AS (SELECT * FROM r WHERE r <= greatest(5, least(25, n))),
    d AS (SELECT a.cls, a.bank_id, a.n, min(list_distance(a.emb, b.emb)) AS d FROM s a JOIN s b ON a.cls = b.cls AND a.bank_id <> b.bank_id GROUP BY ALL)
    SELECT cls, max(n) AS bank_before, count(*) AS bank_after, round(quantile_cont(d, 0.995), 6) AS thr, min(bank_id) AS first_id, CAST(sum(bank_id) AS BIGINT) AS ids FROM d GROUP BY cls""")
def a17_shrunk_threshold(spark, sf_dir):
    """A random part of each bank, and the threshold found anew from it."""
    bank = stored(scores.shrink_bank(v.bank(spark, sf_dir), 25, 5), "shrunk")
    thr = scores.quantile_threshold(knn.self_distances(bank.select("bank_id", "cls", "emb"), exclude_self=True), "cls", "d", 0.995)
    sizes = bank.groupBy("cls").agg(F.max("bank_before").alias("bank_before"), F.count(F.lit(1)).alias("bank_after"), F.min("bank_id").alias("first_id"), F.sum("bank_id").alias("ids"))
    return sizes.join(thr, "cls").select("cls", "bank_before", "bank_after", F.round("thr", 6).alias("thr"), "first_id", "ids")


@query(ORDERED_TRUTH + f""", c AS (SELECT actual_ng, count(*) AS n, row_number() OVER (ORDER BY actual_ng) - 1 AS class, count(*) OVER () AS classes FROM truth GROUP BY actual_ng),
    r AS (SELECT actual_ng, sample_id, row_number() OVER (PARTITION BY actual_ng ORDER BY o, sample_id) - 1 AS place FROM t),
    d AS (SELECT range AS draw, {digest_order("range || ':1'")} / pow(2, 52) AS a, {digest_order("range || ':2'")} / pow(2, 52) AS b FROM range(20000))
    SELECT draw, r.actual_ng, r.sample_id FROM d JOIN c ON c.class = CAST(floor(a * classes) AS BIGINT) JOIN r ON r.actual_ng = c.actual_ng AND r.place = CAST(floor(b * n) AS BIGINT)""")
def a21_weighted_draws(spark, sf_dir):
    """20,000 draws, about half of them from each class whatever its share of rows."""
    return scores.weighted_draws(v.truth(spark, sf_dir), "sample_id", "actual_ng", 20_000)


@query(NEAREST % 1 + " SELECT query_id || '.png' AS file, round(d, 6) AS score, 1.2::DOUBLE AS threshold, CASE WHEN d >= 1.2 THEN 'NG' ELSE 'OK' END AS pred FROM n")
def s11_batch_results(spark, sf_dir):
    folder = shared_path(spark, "batch-results")
    rows = patch_distances(spark, sf_dir).select(F.concat("query_id", F.lit(".png")).alias("file"), F.round("d", 6).alias("score"), F.lit(1.2).alias("threshold"), F.when(F.col("d") >= 1.2, "NG").otherwise("OK").alias("pred"))
    rows.write.json(folder)
    return spark.read.schema(rows.schema).json(folder)
