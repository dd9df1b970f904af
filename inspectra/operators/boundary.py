"""Boundary curves and residual signals: one row per (image, side, y).

All windows partition by image and side, so that the steps of a plan share one
shuffle; runs are gaps and islands, never lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.operators import ranks
from inspectra.operators.geometry import positions

CURVE = ["image_id", "side"]


def curve(order: str | None = "y") -> Window:
    w = Window.partitionBy(*CURVE)
    return w.orderBy(order) if order else w


def filled(rows: DataFrame, value: str = "x") -> DataFrame:
    """Missing samples by linear interpolation, the ends held."""
    back, ahead = curve().rowsBetween(Window.unboundedPreceding, 0), curve().rowsBetween(0, Window.unboundedFollowing)
    y = F.when(F.col(value).isNotNull(), F.col("y"))
    rows = rows.withColumns({
        "_v0": F.last(value, ignorenulls=True).over(back), "_y0": F.last(y, ignorenulls=True).over(back),
        "_v1": F.first(value, ignorenulls=True).over(ahead), "_y1": F.first(y, ignorenulls=True).over(ahead),
    })
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("y") - F.col("_y0")) / F.nullif(F.col("_y1") - F.col("_y0"), F.lit(0))
    return rows.withColumn(value, F.coalesce(F.col(value), between, "_v0", "_v1")).drop("_v0", "_v1", "_y0", "_y1")


def residuals(rows: DataFrame, value: str = "x") -> DataFrame:
    """Difference to the median of the curve."""
    return with_median(rows, F.col(value), "_median").withColumn("r", F.col(value) - F.col("_median")).drop("_median")


def robust_sigma(rows: DataFrame, value: str = "r") -> DataFrame:
    """1.4826 MAD + 1e-6 of each curve, as column sigma."""
    middle = with_median(rows, F.col(value), "_m")
    return with_median(middle, F.abs(F.col(value) - F.col("_m")), "_mad").withColumn("sigma", 1.4826 * F.col("_mad") + 1e-6).drop("_m", "_mad")


def with_median(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows with the exact median of a value over their curve."""
    median = ranks.quantiles(rows.select(*CURVE, value.alias("_value")), CURVE, "_value", {name: 0.5}).drop("n")
    return rows.join(median, CURVE)


def runs(rows: DataFrame, gap: int) -> DataFrame:
    """Numbers the runs of flagged rows; runs at most ``gap`` rows apart are one."""
    last = F.lag("y").over(curve())
    new = (last.isNull() | (F.col("y") - last > gap + 1)).cast("int")
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(curve())).drop("_new")


def level(peak: Column, height: Column, area: Column, pitch: int) -> Column:
    """The pitch-scaled rules of an event."""
    at_least = lambda fixed, share: max(fixed, round(share * pitch))
    ng = ((peak >= 4) & (height >= at_least(8, 0.30))) | ((area >= 35) & (height >= at_least(8, 0.25)))
    return F.when(ng, "NG").when((peak >= 2.5) & (height >= at_least(6, 0.20)), "WARN").otherwise("OK")


def events(rows: DataFrame, pitch: int, sign: int = 1, min_px: float = 2.0, sigmas: float = 3.0) -> DataFrame:
    """Runs of residuals beyond max(min_px, 3 sigma) with their measures. rows: with
    sigma, or it is found here."""
    r = rows if "sigma" in rows.columns else robust_sigma(rows)
    value = sign * F.col("r")
    hit = r.withColumn("v", value).where(value > F.greatest(F.lit(min_px), sigmas * F.col("sigma")))
    found = runs(hit, max(3, round(0.10 * pitch))).groupBy(*CURVE, "run").agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("v").alias("peak"), F.sum("v").alias("area"),
    ).withColumn("height", F.col("y1") - F.col("y0") + 1).where(F.col("height") >= max(6, round(0.25 * pitch)))
    return found.withColumn("level", level(F.col("peak"), F.col("height"), F.col("area"), pitch)).drop("run")


def windows(rows: DataFrame, pitch: int) -> DataFrame:
    """Whole tooth windows [c - half, c + half) around centres half, half + pitch, ... below H - half."""
    half = max(1, pitch // 2)
    height = F.max("y").over(curve(None)) + 1
    tooth = F.floor(F.col("y") / pitch)
    centre = tooth * pitch + half
    return rows.withColumns({"tooth": tooth, "_c": centre, "_h": height}).where((F.col("y") < F.col("_c") + half) & (F.col("_c") < F.col("_h") - half)).drop("_c", "_h")


def dipoles(rows: DataFrame, pitch: int, weight: float = 0.03) -> DataFrame:
    """Per tooth window: positive and negative peak and area, score, level."""
    r = F.col("r")
    g = windows(rows, pitch).groupBy(*CURVE, "tooth").agg(
        F.greatest(F.max("r"), F.lit(0.0)).alias("up"), F.greatest(-F.min("r"), F.lit(0.0)).alias("down"),
        F.sum(F.greatest(r, F.lit(0.0))).alias("area_up"), F.sum(F.greatest(-r, F.lit(0.0))).alias("area_down"),
        F.max_by("y", F.struct(r, -F.col("y"))).alias("y_up"), F.min_by("y", F.struct(r, F.col("y"))).alias("y_down"), F.count(F.lit(1)).alias("rows"),
    )
    score = F.least("up", "down") + weight * F.least("area_up", "area_down") / F.col("rows")
    near = F.abs(F.col("y_up") - F.col("y_down")) <= 0.6 * pitch
    g = g.withColumn("score", F.when(near, score).otherwise(0.0))
    return g.withColumn("level", F.when(F.col("score") >= 5.5, "NG").when(F.col("score") >= 4, "WARN").otherwise("OK"))


def tooth_peaks(rows: DataFrame, pitch: int, value: str = "x", skip_top: float = 0.0) -> DataFrame:
    """Each window's largest value, its y, its residual to the straight line
    through the curve's peaks, and how far it lies from the peak before. Windows
    with a centre in the first share of the rows are left out."""
    height = F.max("y").over(curve(None)) + 1
    near = windows(rows.withColumn("_top", F.floor(height * skip_top)), pitch).where(F.col("tooth") * pitch + max(1, pitch // 2) >= F.col("_top"))
    p = near.groupBy(*CURVE, "tooth").agg(F.max(value).alias("peak"), F.max_by("y", F.struct(F.col(value), -F.col("y"))).alias("y"))
    # summed in the order of the teeth: one curve has one line, to the last digit
    order = Window.partitionBy(*CURVE).orderBy("tooth")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.when(F.col("peak").isNotNull(), F.col("y"))
    out = p.withColumn("slope", F.covar_pop(at, "peak").over(whole) / F.nullif(F.covar_pop(at, at).over(whole), F.lit(0.0)))
    out = out.withColumn("intercept", F.avg("peak").over(whole) - F.col("slope") * F.avg(at).over(whole))
    out = out.withColumn("residual", F.col("peak") - F.coalesce(F.col("intercept") + F.col("slope") * F.col("y"), F.col("peak")))
    return out.withColumn("step", F.abs(F.col("peak") - F.lag("peak").over(order)))


def peak_maxima(peaks: DataFrame) -> DataFrame:
    """Per curve: the largest step, the tooth where it ends (the first one), the largest residual."""
    worst = F.max_by("tooth", F.struct(F.coalesce("step", F.lit(-1.0)), -F.col("tooth")))
    return peaks.groupBy(*CURVE).agg(F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"), F.when(F.max("step").isNotNull(), worst).alias("at_tooth"), F.max(F.abs("residual")).alias("max_residual"))


def against_peaks(rows: DataFrame, pitch: int, value: str = "x") -> DataFrame:
    """Rows with r, their residual to the line through their curve's tooth peaks;
    curves with fewer than two peaks have none."""
    line = tooth_peaks(rows, pitch, value).groupBy(*CURVE).agg(F.first("slope").alias("_slope"), F.first("intercept").alias("_intercept")).where("_slope IS NOT NULL")
    return rows.join(line, CURVE).withColumn("r", F.col(value) - (F.col("_intercept") + F.col("_slope") * F.col("y"))).drop("_slope", "_intercept")


def largest_excursion(rows: DataFrame, depth: float) -> DataFrame:
    """Per curve and sign: the largest area beyond a depth among contiguous
    runs, and the y of that run's peak."""
    both = rows.select(*CURVE, "y", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), "r").withColumn("v", F.col("sign") * F.col("r")).where(F.col("v") > depth)
    over = Window.partitionBy(*CURVE, "sign").orderBy("y")
    new = (F.lag("y").over(over).isNull() | (F.col("y") - F.lag("y").over(over) > 1)).cast("int")
    island = both.withColumn("_new", new).withColumn("run", F.sum("_new").over(over))
    areas = island.groupBy(*CURVE, "sign", "run").agg(F.sum(F.col("v") - depth).alias("area"), F.max_by("y", F.struct("v", -F.col("y"))).alias("y"))
    return areas.groupBy(*CURVE, "sign").agg(F.max("area").alias("area"), F.max_by("y", F.struct("area", -F.col("run"))).alias("y"))


def phase_template(rows: DataFrame, pitch: int, smooth: int = 7) -> DataFrame:
    """Median residual per y modulo pitch over rows within 2.5 sigma (over all
    rows of a phase that has none such), smoothed around the circle by a
    quadratic fit, with mean zero."""
    near = F.when(F.abs("r") <= 2.5 * F.col("sigma"), F.col("r"))
    medians = robust_sigma(rows).groupBy(*CURVE, (F.col("y") % pitch).cast("int").alias("phase")).agg(F.coalesce(F.percentile(near, F.lit(0.5)), F.percentile("r", F.lit(0.5))).alias("m"))
    weights = savgol_weights(smooth, 2)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        value = np.zeros(pitch)
        value[group["phase"].to_numpy()] = group["m"].to_numpy()
        padded = np.concatenate((value[-(smooth // 2) :], value, value[: smooth // 2]))
        out = np.convolve(padded, weights[::-1], mode="valid")
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "side": group["side"].iloc[0], "phase": np.arange(pitch), "template": out - out.mean()})

    return medians.groupBy(*CURVE).applyInPandas(finish, "image_id long, side string, phase int, template double")


def savgol_weights(size: int, degree: int) -> np.ndarray:
    """Weights that give the middle of a least-squares polynomial."""
    x = np.arange(size) - size // 2
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0]


def median_filtered(values: np.ndarray, size: int = 5) -> np.ndarray:
    mirrored = np.pad(values, size // 2, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(mirrored, size), axis=1)


def smoothed(values: np.ndarray, median: int = 5, size: int = 7, degree: int = 3) -> np.ndarray:
    """Median filter with its ends held, then a sliding polynomial; the first
    and last half windows are read off the polynomials of the end windows."""
    held = np.pad(values.astype(float), median // 2, mode="edge")
    calm = np.median(np.lib.stride_tricks.sliding_window_view(held, median), axis=1)
    size = min(size, len(calm) - 1 + len(calm) % 2)
    size = size if size > degree else degree + 3 + degree % 2
    if size > len(calm):
        return calm
    half, x = size // 2, np.arange(size)
    out = calm.copy()
    out[half : len(calm) - half] = np.lib.stride_tricks.sliding_window_view(calm, size) @ savgol_weights(size, degree)
    out[:half] = np.polyval(np.polyfit(x, calm[:size], degree), x[:half])
    out[len(calm) - half :] = np.polyval(np.polyfit(x, calm[-size:], degree), x[size - half :])
    return out


def robust_reference(y: np.ndarray, x: np.ndarray, degree: int = 3, rounds: int = 3) -> np.ndarray:
    """Polynomial by least squares, with outliers' weights cut in rounds."""
    t = (y - y.mean()) / max(1e-9, np.abs(y - y.mean()).max(initial=0))
    basis, w = np.vander(t, degree + 1, increasing=True), np.ones(len(y))
    for _ in range(rounds):
        c = np.linalg.lstsq(basis * w[:, None], x * w, rcond=None)[0]
        r = np.abs(x - basis @ c)
        mad = np.median(r) + 1e-8
        w = np.where(r > 3 * mad, w * 0.1, np.minimum(w * 1.5, 1))
    return basis @ np.linalg.lstsq(basis * w[:, None], x * w, rcond=None)[0]


def per_curve(rows: DataFrame, function, name: str, value: str = "x") -> DataFrame:
    """A function of (y, values) for each curve; a curve is one image's."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("y")
        return group.assign(**{name: function(group["y"].to_numpy(float), group[value].to_numpy(float))})

    return rows.select(*CURVE, "y", value).groupBy(*CURVE).applyInPandas(run, f"image_id long, side string, y int, {value} double, {name} double")


def pitch_estimate(rows: DataFrame, low: int, high: int, value: str = "r", fallback: int | None = None) -> DataFrame:
    """The lag with the largest autocorrelation about the mean; the smallest
    where several. A flat curve, or one shorter than ``low``, has the fall-back."""
    rows = rows.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*CURVE)))
    all_ = rows.groupBy(*CURVE).agg((F.max(F.abs(value)) <= 1e-8).alias("_flat"))
    lags = rows.select(*CURVE, (F.col("y")).alias("y1"), F.col(value).alias("a"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"))
    other = rows.select(*CURVE, F.col("y").alias("y2"), F.col(value).alias("b"))
    moved = lags.withColumn("y2", (F.col("y1") + F.col("lag")).cast("int")).join(other, [*CURVE, "y2"])
    sums = moved.groupBy(*CURVE, "lag").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("c"))
    best = sums.groupBy(*CURVE).agg(F.max_by("lag", F.struct("c", -F.col("lag"))).alias("_best"))
    pitch = F.when(~F.col("_flat"), F.col("_best"))
    return all_.join(best, CURVE, "left").select(*CURVE, F.coalesce(pitch, F.lit(fallback).cast("int")).alias("pitch"))


def strip_scores(rows: DataFrame, size: int, overlap: int, weight: float = 2.0) -> DataFrame:
    """Bump and skew of each strip of a curve, and of each pair of neighbours the
    larger of both strips' bumps and weighted skews. Strips lie at every stride,
    the last one touches the end; one without rows scores 0. A row falls into
    the strips that cover it, found by arithmetic, not by comparing it with all."""
    stride = max(1, size - overlap)
    length = rows.groupBy(*CURVE).agg((F.max("y") + 1).cast("int").alias("_length"))
    grid = length.select(*CURVE, F.posexplode(positions(F.col("_length"), size, stride)).alias("strip_idx", "start"))
    regular = F.greatest(F.lit(0), F.floor((F.col("_length") - size) / stride)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("y") - size) / stride).cast("int") + 1)
    covering = F.when(first <= regular, F.sequence(first, F.greatest(first, F.least(F.floor(F.col("y") / stride).cast("int"), regular)))).otherwise(F.array().cast("array<int>"))
    last = (F.col("_length") > size) & ((F.col("_length") - size) % stride != 0) & (F.col("y") >= F.col("_length") - size)
    placed = rows.join(length, CURVE).withColumn("strip_idx", F.explode(F.concat(covering, F.when(last, F.array(regular + 1)).otherwise(F.array().cast("array<int>")))))
    s = placed.groupBy(*CURVE, "strip_idx").agg(F.max(F.abs("r")).alias("bump"), F.abs(F.regr_slope("r", "y")).alias("slope"), (F.max("y") - F.min("y")).alias("range"))
    skew = F.coalesce(F.when(F.col("range") > 0, F.col("slope") * F.col("range")), F.lit(0.0))
    s = grid.join(s, [*CURVE, "strip_idx"], "left").select(*CURVE, "strip_idx", "start", F.round(F.coalesce("bump", F.lit(0.0)), 4).alias("bump"), F.round(skew, 4).alias("skew"))
    score = F.greatest(F.col("bump"), weight * F.col("skew"))
    following = F.lead(score).over(curve("strip_idx"))
    return s.withColumn("pair", F.when(following.isNotNull(), F.greatest(score, following)))


def against_left(rows: DataFrame, offset: float) -> DataFrame:
    """The right side's distance to the left side's fitted line plus an offset."""
    fit = rows.where("side = 'L'").groupBy("image_id").agg(F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("intercept"))
    right = rows.where("side = 'R'").join(fit, "image_id")
    return right.select("image_id", "y", (F.col("x") - (F.col("intercept") + F.col("slope") * F.col("y") + offset)).alias("gap"))


def ignored_top(rows: DataFrame, left: float = 0.0, right: float = 0.2, missing_right: bool = True) -> DataFrame:
    """Residuals in the first share of a curve's rows, one share for each side,
    become zero; so do, on the right, those away from the groove."""
    height = F.max("y").over(curve(None)) + 1
    share = F.when(F.col("side") == "L", left).otherwise(right)
    zero = (F.col("y") < F.floor(height * share)) | (F.lit(missing_right) & (F.col("side") == "R") & (F.col("r") > 0))
    return rows.withColumn("r", F.when(zero, 0.0).otherwise(F.col("r")))
