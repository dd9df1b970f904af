"""Patch distances to one score; calibration of thresholds from OK scores.

Scores are array expressions over the distances of one image, so that an
image's patches stay in its row; quantiles are exact and interpolate linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.operators import ranks


def ordered(distances: Column) -> Column:
    return F.sort_array(distances, asc=False)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def top_mean(distances: Column, k: Column | int) -> Column:
    return mean_of(F.slice(ordered(distances), 1, F.greatest(F.lit(1), k if isinstance(k, Column) else F.lit(k))))


def percentile_mean(distances: Column, percentile: float) -> Column:
    """Mean of the top max(1, int(n (1 - p / 100)))."""
    return top_mean(distances, (F.size(distances) * (1 - percentile / 100)).cast("int"))


def hybrid(distances: Column, alpha: float, k: int) -> Column:
    a = min(1.0, max(0.0, alpha))
    return a * F.array_max(distances) + (1 - a) * top_mean(distances, k)


def contrast(distances: Column, k: int) -> Column:
    """Top mean over the lower median."""
    lower = F.element_at(F.sort_array(distances), ((F.size(distances) + 1) / 2).cast("int"))
    return top_mean(distances, k) / (lower + 1e-6)


def spatial(patches: DataFrame, k: int, image: str = "image_id", index: str = "patch_idx", distance: str = "d") -> DataFrame:
    """Top mean x (1 + locality); locality falls with the spread of the top k
    cells on a grid of round(sqrt(n)) rows."""
    per = Window.partitionBy(image)
    n = F.count(F.lit(1)).over(per)
    rows = patches.withColumns({"n": n, "rank": F.row_number().over(per.orderBy(F.desc(distance), index))})
    rows = rows.withColumn("h", F.greatest(F.lit(1), F.bround(F.sqrt("n")).cast("int"))).withColumn("w", F.when(F.col("h") * F.col("h") == F.col("n"), F.col("h")).otherwise(F.floor(F.col("n") / F.col("h"))).cast("int"))
    rows = rows.where(F.col("rank") <= k).withColumns({"r": F.floor(F.col(index) / F.col("w")), "c": F.col(index) % F.col("w")})
    top = rows.groupBy(image).agg(F.avg(distance).alias("mean"), F.sqrt(F.var_pop("r") + F.var_pop("c")).alias("spread"), F.first("h").alias("h"), F.first("w").alias("w"))
    most = F.sqrt(F.pow(F.col("h") / 2, F.lit(2)) + F.pow(F.col("w") / 2, F.lit(2)))
    return top.select(image, (F.col("mean") * (2 - F.least(F.col("spread") / (most + 1e-6), F.lit(1.0)))).alias("score"))


MODES = {
    "max": lambda d: F.array_max(d), "topk": lambda d: top_mean(d, 10), "percentile": lambda d: percentile_mean(d, 99),
    "hybrid": lambda d: hybrid(d, 0.5, 10), "contrast": lambda d: contrast(d, 10),
}


def quantile_threshold(ok: DataFrame, key: str, score: str, p: float, scale: float = 1.0, floor: float | None = None, default: float = 0.5) -> DataFrame:
    """Per class: the quantile of OK scores, scaled, not below a floor."""
    found = with_quantiles(ok.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), ok, key, score, {"_q": p})
    thr = F.coalesce(F.col("_q") * scale, F.lit(default))
    return found.select(key, (F.greatest(thr, F.lit(floor)) if floor is not None else thr).alias("thr"))


def with_quantiles(groups: DataFrame, rows: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """A row per group, with quantiles of the group's values; null where it has none."""
    q = ranks.quantiles(rows, [key], value, ps).drop("n").withColumnRenamed(key, "_key")
    return groups.join(q, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def ok_statistics(ok: DataFrame, key: str, score: str) -> DataFrame:
    plain = ok.groupBy(key).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"))
    return with_quantiles(plain, ok, key, score, {"q999": 0.999})


def bimodal(ok: DataFrame, key: str, score: str) -> DataFrame:
    """Scores above the threshold, and whether p97 is over twice p90."""
    above = ok.groupBy(key).agg(F.count_if(F.col(score) > F.col("thr")).alias("above"))
    return with_quantiles(above, ok, key, score, {"_a": 0.90, "_b": 0.97}).select(key, "above", (F.col("_b") > 2 * F.col("_a")).alias("bimodal"))


def hash_order(key: Column, seed: int) -> Column:
    """52 bits of a digest of the seed and the key, as SQL engines have it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")


def sample_per_group(rows: DataFrame, group: list[str], most: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``most`` rows per group without replacement: those that come
    first in an order that depends on the key and the seed alone."""
    order = Window.partitionBy(*group).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def shrink_bank(bank: DataFrame, most: int, least: int, key: str = "bank_id", seed: int = 42, first: bool = False) -> DataFrame:
    """Keeps max(least, min(most, n)) rows per class, with both sizes."""
    per = Window.partitionBy("cls")
    order = per.orderBy(key) if first else per.orderBy(hash_order(F.col(key), seed), key)
    sizes = bank.groupBy(F.col("cls").alias("_cls")).agg(F.count(F.lit(1)).alias("bank_before"))
    # the rank's limit holds in each task before anything is shuffled
    rows = bank.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(most, least)).join(sizes, F.col("cls").eqNullSafe(F.col("_cls"))).drop("_cls")
    target = F.greatest(F.lit(least), F.least(F.lit(most), F.col("bank_before")))
    return rows.where(F.col("_n") <= target).withColumn("bank_after", F.least(target, F.col("bank_before"))).drop("_n")


def split(rows: DataFrame, key: str, fraction: float, group: str | None = None, least: int = 1, seed: int = 42) -> DataFrame:
    """Exact validation sizes: max(1, int(n f)) over all, or per class
    min(max(least // 2, round(n f)), max(0, n - least)). Over all rows the order
    of hashes is cut in one of 4096 bins, and only that bin is ranked."""
    if group:
        size = lambda n: F.least(F.greatest(F.lit(least // 2), F.bround(n * fraction)), F.greatest(F.lit(0), n - least))
    else:
        size = lambda n: F.greatest(F.lit(1), F.floor(n * fraction))
        rows = rows.withColumn("_everything", F.lit(0))
    marked = ranks.first_share(rows, [group or "_everything"], hash_order(F.col(key), seed), key, size)
    return marked.withColumn("split", F.when(F.col("_in"), "val").otherwise("train")).drop("_in", "_everything")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """N / (C (n_c + 1e-6))."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * (F.col("n") + 1e-6)))


def weighted_draws(rows: DataFrame, key: str, label: str, draws: int, seed: int = 42) -> DataFrame:
    """Draws with replacement, each class as likely as any other. A draw picks
    a class, then a place among its rows, both from a hash of its number; rows
    are numbered per class in bins, and the draw joins the row with its number."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))  # a row per class
    classes = sizes.withColumns({"_class": F.row_number().over(Window.orderBy(label)) - 1, "_classes": F.count(F.lit(1)).over(Window.partitionBy())})  # a row per class
    share = lambda salt: hash_order(F.concat_ws(":", F.col("draw").cast("string"), F.lit(salt)), seed) / float(1 << 52)
    numbered = ranks.numbered(rows.select(key, label), [label], hash_order(F.col(key), seed), key)
    many = classes.select("_classes").limit(1).withColumn("_one", F.lit(1))
    drawn = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_one", F.lit(1)).join(F.broadcast(many), "_one").withColumn("_class", F.floor(share(1) * F.col("_classes")).cast("int"))
    placed = drawn.drop("_classes").join(F.broadcast(classes.drop("_classes")), "_class").withColumn("_place", F.floor(share(2) * F.col("_size")).cast("int"))
    return placed.select("draw", label, "_place").join(numbered, [label, "_place"]).select("draw", label, key)


def image_verdict(images: DataFrame, regions: DataFrame, count_unknown: bool = False) -> DataFrame:
    """Per image, also those without regions: total, ng_count, unk_count, the largest
    score and threshold of known regions, and NG where a region is (with
    count_unknown also where one is unknown). regions: image_id, score, thr, decision."""
    known = F.col("decision") != "UNKNOWN"
    g = images.join(regions.select("image_id", "score", "thr", "decision"), "image_id", "left").groupBy("image_id").agg(
        F.count("decision").alias("total"), F.count_if(F.col("decision") == "NG").alias("ng_count"), F.count_if(F.col("decision") == "UNKNOWN").alias("unk_count"),
        F.coalesce(F.max(F.when(known, F.col("score"))), F.lit(0.0)).alias("score"), F.coalesce(F.max(F.when(known, F.col("thr"))), F.lit(0.0)).alias("threshold"),
    )
    faults = F.col("ng_count") + (F.col("unk_count") if count_unknown else F.lit(0))
    return g.withColumn("verdict", F.when(faults > 0, "NG").otherwise("OK"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts, accuracy, precision and recall of NG."""
    a, p = F.col("actual_ng"), F.col("predicted_ng")
    c = rows.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    ratio = lambda x, y: x / F.greatest(y, F.lit(1e-6))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
