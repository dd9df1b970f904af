"""Profiles of strips: normalising, comparing, peaks. A profile is an array in
its strip's row; what arrays of columns can't say is a small numpy helper."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside
    functions of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def z_normalised(a: Column) -> Column:
    """By the population deviation; a flat profile becomes zeros."""

    def scaled(a: Column, m: Column) -> Column:
        sd = F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))
        return bound(sd, lambda sd: F.when(sd < 1e-8, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: (x - m) / sd)))

    return bound(a, lambda a: bound(mean(a), lambda m: scaled(a, m)))


def resampled(a: Column | str, n: Column) -> Column:
    """Linear interpolation at n evenly spaced places from end to end."""

    def at(a: Column, i: Column) -> Column:
        size = F.size(a)
        place = i * F.when(n > 1, (size - 1) / (n - 1)).otherwise(F.lit(0.0))
        low = F.least(F.floor(place).cast("int"), size - 1)
        high = F.least(low + 1, size - 1)
        return a[low] + (a[high] - a[low]) * (place - low)

    return bound(F.col(a) if isinstance(a, str) else a, lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(a, i)))


def rms(a: Column, b: Column) -> Column:
    return F.sqrt(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - Pearson of normalised profiles; 0 where a side is flat."""
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm < 1e-12, 0.0).otherwise(1 - dot(a, b) / norm)


def difference_curve(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def normalised(strips: DataFrame, value: str = "profile") -> DataFrame:
    """The strips with their profiles normalised, each once, before they meet."""
    return strips.withColumn(value, z_normalised(F.col(value)))


def of_one_length(pair_rows: DataFrame) -> DataFrame:
    """Pairs of normalised profiles with the shorter side resampled to the longer."""
    n = F.greatest(F.size("a"), F.size("b"))
    fit = lambda c: F.when(F.size(c) == n, F.col(c)).otherwise(resampled(F.col(c), n))
    return pair_rows.withColumns({"a": fit("a"), "b": fit("b")})


def pairs(strips: DataFrame, value: str = "profile", *more: str) -> DataFrame:
    """Each strip with the next one of its image: a, b; and of further columns
    c_a, c_b."""
    order = Window.partitionBy("image_id").orderBy("strip_idx")
    both = [x for c in more for x in (F.col(c).alias(f"{c}_a"), F.lead(c).over(order).alias(f"{c}_b"))]
    return strips.select("image_id", "strip_idx", F.col(value).alias("a"), F.lead(value).over(order).alias("b"), *both).where("b IS NOT NULL")


def union_box(pair_rows: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of the area of both strips of a pair."""
    corner = {c: (F.least if c in ("x0", "y0") else F.greatest)(f"{c}_a", f"{c}_b") for c in ("x0", "y0", "x1", "y1")}
    return pair_rows.withColumns(corner).drop(*[f"{c}_{s}" for c in corner for s in "ab"])


def segments(a: Column, n: int) -> Column:
    """n parts of floor(size / n) samples; the last takes what is left."""
    part = F.floor(F.size(a) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(a, part * i + 1, F.when(i == n - 1, F.size(a) - part * (n - 1)).otherwise(part)))


def with_segments(strips: DataFrame, n: int, value: str = "profile") -> DataFrame:
    """The strips with a normalised profile for each of their segments."""
    return strips.withColumn(value, segments(F.col(value), n)).withColumn(value, F.transform(value, z_normalised))


def segment_distances(a: Column, b: Column) -> Column:
    """RMS of each normalised segment of one strip and that of the other."""
    return F.zip_with(a, b, rms)


def shift_of(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The shift of b against a at which their product is largest; the least
    shift, then the negative one, where several are."""
    a, b = a - a.mean(), b - b.mean()
    best, at = -np.inf, 0
    for s in sorted(range(-most, most + 1), key=lambda s: (abs(s), s)):
        x, y = (a[: len(a) - s], b[s:]) if s >= 0 else (a[-s:], b[: len(b) + s])
        value = round(float(x @ y), 9)
        if value > best:
            best, at = value, s
    return at


def peak_shift(a: np.ndarray, b: np.ndarray) -> int:
    """How far the largest correlation of two normalised profiles lies from no
    shift, over their full length; the first where several are as large."""
    return abs(int(np.argmax(np.round(np.correlate(a, b, mode="full"), 9))) - (len(b) - 1)) if len(a) else 0


def lined_up(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Both normalised profiles cut by the best shift within ``most``, in the way
    that published thresholds rest on: by the shift of a against b, a at its end
    and b at its start."""
    n = len(a)
    if most <= 0 or n < 3:
        return a, b
    near = np.round(np.correlate(a, b, mode="full"), 9)[max(0, n - 1 - most) : n + most]
    s = int(np.argmax(near)) + max(0, n - 1 - most) - (n - 1)
    return (a[: n - s], b[s:]) if s >= 0 else (a[-s:], b[: n + s])


def lined_up_distances(pair_rows: DataFrame, most: int) -> DataFrame:
    """Adds l2 and correlation of normalised pairs after they are lined up."""

    @F.pandas_udf("l2 double, correlation double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = lined_up(np.asarray(x), np.asarray(y), most)
            norm = np.sqrt((x @ x) * (y @ y))
            out.append((np.sqrt(np.mean((x - y) ** 2)), 0.0 if norm < 1e-12 else 1 - (x @ y) / norm))
        return pd.DataFrame(out, columns=["l2", "correlation"])

    return pair_rows.withColumn("_d", run("a", "b")).select("*", "_d.l2", "_d.correlation").drop("_d")


def aligned(a: np.ndarray, b: np.ndarray, most: int, legacy_trim: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Both cut to where they overlap after the shift. legacy_trim cuts the
    other ends, as older results did."""
    s = shift_of(a, b, most)
    if legacy_trim:
        s = -s
    return (a[: len(a) - s], b[s:]) if s >= 0 else (a[-s:], b[: len(b) + s])


def shifts(pair_rows: DataFrame) -> DataFrame:
    """Adds the peak shift of normalised pairs."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([peak_shift(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)])

    return pair_rows.withColumn("shift", run("a", "b"))


def find_peaks(p: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Strict local maxima of at least a height; of those no more than a distance
    apart the taller stays."""
    inner = np.flatnonzero((p[1:-1] > p[:-2]) & (p[1:-1] > p[2:]) & (p[1:-1] >= height)) + 1
    kept: list[int] = []
    for i in sorted(inner, key=lambda i: (-p[i], i)):
        if all(abs(i - k) > distance for k in kept):
            kept.append(i)
    return np.array(sorted(kept), dtype=int)


def match_peaks(a: np.ndarray, b: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """For each peak of a in turn the nearest of b, at most ``gap`` apart, that
    none before it has taken; the first where two are as near."""
    free, out = [int(y) for y in b], []
    for x in map(int, a):
        near = min(free, key=lambda y: abs(y - x), default=None)
        if near is not None and abs(near - x) <= gap:
            out.append((x, near))
            free.remove(near)
    return out


def flat_to_zero(a: np.ndarray) -> np.ndarray:
    sd = a.std()
    return np.zeros_like(a) if sd < 1e-8 else (a - a.mean()) / sd


def edge_shift(a: np.ndarray, b: np.ndarray, distance: int = 3, gap: int = 15) -> int:
    """Largest distance of matched peaks of raw profiles; the normalised ones'
    peak shift where none match."""
    height = min(0.3 * np.abs(a).max(), 0.3 * np.abs(b).max())
    matched = match_peaks(find_peaks(a, height, distance), find_peaks(b, height, distance), gap)
    return max(abs(y - x) for x, y in matched) if matched else peak_shift(flat_to_zero(a), flat_to_zero(b))


def peak_matches(pair_rows: DataFrame, distance: int = 3, gap: int = 15) -> DataFrame:
    """Per pair: peaks of either side, matches, the edge shift."""

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a, b = np.asarray(a), np.asarray(b)
                height = min(0.3 * np.abs(a).max(), 0.3 * np.abs(b).max())
                pa, pb = find_peaks(a, height, distance), find_peaks(b, height, distance)
                rows.append((len(pa), len(pb), len(match_peaks(pa, pb, gap)), edge_shift(a, b, distance, gap)))
            out = pd.DataFrame(rows, columns=["peaks_a", "peaks_b", "matched", "edge_shift"])
            yield pd.concat((batch[["image_id", "strip_idx"]].reset_index(drop=True), out), axis=1)

    return pair_rows.mapInPandas(run, "image_id long, strip_idx int, peaks_a long, peaks_b long, matched long, edge_shift long")


def boxcar(rows: DataFrame, key: list[str], order: str, value: str, size: int) -> DataFrame:
    """Mean over a centred window, zeros beyond the ends."""
    frame = Window.partitionBy(*key).orderBy(order).rowsBetween(-(size // 2), size - 1 - size // 2)
    return rows.withColumn("smooth", F.sum(value).over(frame) / size)


def gaussian_weights(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-x * x / (2 * sigma * sigma))
    return w / w.sum()


def gaussian(rows: DataFrame, key: list[str], order: str, value: str, size: int) -> DataFrame:
    w, over = gaussian_weights(size), Window.partitionBy(*key).orderBy(order)
    terms = [F.coalesce(F.lag(value, size // 2 - k).over(over), F.lit(0.0)) * float(w[k]) for k in range(size)]
    return rows.withColumn("smooth", sum(terms[1:], terms[0]))
