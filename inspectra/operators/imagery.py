"""Images as rows: maps over cells in SQL form, and helpers per image.

A raster is one row (image_id, tile, h, w, data). Helpers get one image, or a few of
one size, at a time inside mapInPandas; rasters are dealt out evenly over tasks first, which shuffles
their bytes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from inspectra.operators import ranks
from inspectra.operators.profiles import resampled
from inspectra.sources.folders import stored


#: Rasters of which a task holds the rows at once, and those of one stack.
SLICE, STACK = 64, 16


def per_image(rasters: DataFrame, function: Callable[[np.ndarray, int], list[tuple]], schema: str) -> DataFrame:
    """image_id, tile, and the columns of ``schema`` from the rows that a
    function makes of each raster and of a seed for it. Rasters are dealt out
    evenly first, as a few large files would leave most tasks without any. Rows
    leave the task for every ``SLICE`` rasters, however large its batches are."""

    def rows(part: list[tuple]) -> Iterator[tuple]:
        for image, tile, h, w, data in part:
            for r in function(np.frombuffer(data, dtype=np.uint8).reshape(h, w), image << 20 | tile):
                yield image, tile, *r

    return _per_slice(rasters, rows, schema)


def per_stack(rasters: DataFrame, function: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """As per_image, with a row for each raster of a stack (n, h, w) of at most
    ``STACK`` rasters of one size: what numpy spends on each call is spent on a
    stack, not on a raster."""

    def rows(part: list[tuple]) -> Iterator[tuple]:
        of_size: dict[tuple[int, int], list[tuple]] = {}
        for raster in part:
            of_size.setdefault(raster[2:4], []).append(raster)
        for (h, w), alike in of_size.items():
            for at in range(0, len(alike), STACK):
                some = alike[at : at + STACK]
                stack = np.frombuffer(b"".join(r[4] for r in some), dtype=np.uint8).reshape(len(some), h, w)
                for (image, tile, *_), r in zip(some, function(stack), strict=True):
                    yield image, tile, *r

    return _per_slice(rasters, rows, schema)


def _per_slice(rasters: DataFrame, rows: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    keys = ["image_id", "tile"]
    names = keys + [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch[[*keys, "h", "w", "data"]].iloc[at : at + SLICE].itertuples(index=False, name=None)
                yield pd.DataFrame(list(rows(list(part))), columns=names)

    tasks = max(4 * rasters.sparkSession.sparkContext.defaultParallelism, rasters.rdd.getNumPartitions())
    return rasters.repartition(tasks).mapInPandas(run, f"image_id long, tile int, {schema}")


def stitched(cells: DataFrame, how: str = "max") -> DataFrame:
    """Overlapping maps in image coordinates, joined by maximum or mean."""
    return cells.groupBy("image_id", "y", "x").agg((F.max("v") if how == "max" else F.avg("v")).alias("v"))


def scaled_by_maximum(cells: DataFrame) -> DataFrame:
    most = F.max("v").over(Window.partitionBy("image_id"))
    return cells.withColumn("v", F.when(most > 0, F.col("v") / most).otherwise(0.0))


def stretched(a: Column, n: Column) -> Column:
    """An array stretched to n >= its size: pixel centres, straight lines between
    them, the ends held."""

    def at(i: Column) -> Column:
        place = (i + 0.5) * F.size(a) / n - 0.5
        low = F.floor(place).cast("int")
        inside = lambda k: F.get(a, F.greatest(F.lit(0), F.least(k, F.size(a) - 1)))
        return inside(low) + (inside(low + 1) - inside(low)) * (place - low)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def difference_maps(pair_rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Adds map, an array of rows: at each place of two feature maps (a and b, flat
    arrays of channels, rows, columns) the length of their difference."""
    channels, rows, columns = shape
    plane = rows * columns

    def place(y: Column, x: Column) -> Column:
        terms = [F.get("a", y * columns + x + c * plane) - F.get("b", y * columns + x + c * plane) for c in range(channels)]
        return F.sqrt(sum((t * t for t in terms[1:]), terms[0] * terms[0]) + 1e-8)

    line = lambda k, f: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), f)
    return pair_rows.withColumn("map", line(rows, lambda y: line(columns, lambda x: place(y, x))))


def region_lines(pair_rows: DataFrame) -> DataFrame:
    """image_id, y, x0, line: a pair's map (rows) or curve (one row for all) laid over
    the area x0, y0, x1, y1 of both strips, an array for each of its lines. Maps are
    stretched to the area, curves are drawn from end to end along it: across where
    the strips lie above each other, else down."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = pair_rows.where((w > 0) & (h > 0))
    down = F.explode(F.sequence(F.lit(0), h - 1)).alias("_y")
    if "map" in pair_rows.columns:
        wide = rows.withColumn("map", F.transform("map", lambda r: stretched(r, w)))
        tall = wide.select("image_id", "x0", "y0", h.alias("_h"), F.size("map").alias("_n"), "map", down)
        place = (F.col("_y") + 0.5) * F.col("_n") / F.col("_h") - 0.5
        low = F.floor(place).cast("int")
        row = lambda k: F.get("map", F.greatest(F.lit(0), F.least(k, F.col("_n") - 1)))
        both = tall.select("image_id", "x0", (F.col("y0") + F.col("_y")).alias("y"), (place - low).alias("_t"), row(low).alias("_a"), row(low + 1).alias("_b"))
        return both.select("image_id", "y", "x0", F.zip_with("_a", "_b", lambda p, q: p + (q - p) * F.col("_t")).alias("line"))
    along = F.when(F.col("vertical"), w).otherwise(h)
    drawn = rows.withColumn("curve", resampled("curve", along)).select("image_id", "x0", "y0", "vertical", w.alias("_w"), "curve", down)
    line = F.when(F.col("vertical"), F.col("curve")).otherwise(F.array_repeat(F.get("curve", F.col("_y")), F.col("_w")))
    return drawn.select("image_id", (F.col("y0") + F.col("_y")).alias("y"), "x0", line.alias("line"))


def mean_lines(lines: DataFrame) -> DataFrame:
    """Per image and y one line from the least x0: at each x the mean of the lines that
    cover it, null where none does. A line is one row, not one per cell, so that
    what a task holds stays a small multiple of its input."""
    whole = lines.groupBy("image_id", "y").agg(F.min("x0").alias("x0"), F.max(F.col("x0") + F.size("line")).alias("_end"), F.collect_list(F.struct("x0", "line")).alias("_lines"))

    def mean(x: Column) -> Column:
        at = F.filter(F.transform("_lines", lambda r: F.when(x >= r["x0"], F.get(r["line"], (x - r["x0"]).cast("int")))), lambda value: value.isNotNull())
        return F.when(F.size(at) > 0, F.aggregate(at, F.lit(0.0), lambda s, value: s + value) / F.size(at))

    return whole.select("image_id", "y", "x0", F.transform(F.sequence("x0", F.col("_end") - 1), mean).alias("line"))


def weighted_curves(pair_rows: DataFrame) -> DataFrame:
    """Curves of pairs with a small distance fade: times (d / the image's largest d) squared."""
    most = pair_rows.groupBy("image_id").agg(F.max("d").alias("_most"))
    share = F.col("d") / F.when(F.col("_most") < 1e-12, 1.0).otherwise(F.col("_most"))
    return pair_rows.join(most, "image_id").withColumn("curve", F.transform("curve", lambda x: x * share * share)).drop("_most")


def difference_heat(pair_rows: DataFrame) -> DataFrame:
    """Heat of neighbouring strips' differences: the mean over all pairs that
    cover a cell, over the image's largest. Lines meet per image and y, maxima leave
    each task per image; no image is one task's work."""
    means = mean_lines(region_lines(pair_rows))
    most = means.groupBy("image_id").agg(F.max(F.array_max("line")).alias("_most"))
    cells = means.join(most, "image_id").select("image_id", "y", "x0", "_most", F.posexplode("line").alias("_x", "v")).where("v IS NOT NULL")
    return cells.select("image_id", "y", (F.col("x0") + F.col("_x")).alias("x"), F.when(F.col("_most") > 0, F.col("v") / F.col("_most")).otherwise(F.col("v")).alias("v"))


def map_score(cells: DataFrame, q: float | None = 0.999) -> DataFrame:
    """Per image the largest value, or an exact quantile."""
    if q is None:
        return cells.groupBy("image_id").agg(F.max("v").alias("score"))
    return ranks.quantiles(cells, ["image_id"], "v", {"score": q}).drop("n")


def scaled(v: Column, low: Column | float, high: Column | float) -> Column:
    """Heat to 0..1."""
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / F.greatest(high - low, F.lit(1e-9))))


def as_u16(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.round(scaled(v, low, high) * 65535).cast("int")


def iou(pairs: DataFrame) -> DataFrame:
    """Per image from boolean gt and pred: IoU (1 for an empty union) and soft Dice."""
    both, either = F.count_if(F.col("gt") & F.col("pred")), F.count_if(F.col("gt") | F.col("pred"))
    g = pairs.groupBy("image_id").agg(both.alias("both"), either.alias("either"), F.count_if("gt").alias("n_gt"), F.count_if("pred").alias("n_pred"))
    return g.select("image_id", F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")).alias("iou"), ((2 * F.col("both") + 1) / (F.col("n_gt") + F.col("n_pred") + 1)).alias("dice"))


def coverage_gate(pixels: DataFrame, least: float, limit: int = 127) -> DataFrame:
    """Per image the share of pixels over a limit: the score, or 1 less it and NG
    where it is below a minimum (0: no gate)."""
    low = (F.lit(least) > 0) & (F.col("share") < least)
    shares = pixels.groupBy("image_id").agg(F.avg((F.col("gray") > limit).cast("double")).alias("share"))
    return shares.withColumns({"verdict": F.when(low, "NG").otherwise("OK"), "score": F.when(low, 1 - F.col("share")).otherwise(F.col("share"))})


def less_row_median(pixels: DataFrame, value: str, along: str = "y") -> DataFrame:
    """Pixels less the median of their row (along y) or column (along x)."""
    line = ["image_id", along]
    median = pixels.groupBy(*line).agg(F.percentile(value, F.lit(0.5)).alias("_median"))
    return pixels.join(median, line).withColumn(value, F.col(value) - F.col("_median")).drop("_median")


def otsu_threshold(pixels: DataFrame) -> DataFrame:
    """Per image, from its histogram; the first of the best bins."""
    h = pixels.groupBy("image_id", F.col("gray").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    over, all_ = Window.partitionBy("image_id").orderBy("bin"), Window.partitionBy("image_id")
    h = h.withColumns({"low": F.sum("c").over(over), "mass": F.sum(F.col("c") * F.col("bin")).over(over), "n": F.sum("c").over(all_), "total": F.sum(F.col("c") * F.col("bin")).over(all_)})
    high = F.col("n") - F.col("low")
    gap = F.col("mass") / F.col("low") - (F.col("total") - F.col("mass")) / F.nullif(high, F.lit(0))
    between = F.round(F.coalesce(F.col("low") * high * gap * gap, F.lit(0.0)), 6)
    return h.withColumn("b", between).groupBy("image_id").agg(F.max_by("bin", F.struct("b", -F.col("bin"))).alias("threshold"))


def templates(cells: DataFrame, essential: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Per class and cell: mean, deviation, foreground share and mask; per
    class: mean of foreground and background."""
    t = cells.groupBy("cls", "y", "x").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.col("fg").cast("double")).alias("share"))
    t = t.withColumn("mask", F.col("share") > essential)
    s = t.groupBy("cls").agg(F.count_if("mask").alias("fg_pixels"), F.avg(F.when(F.col("mask"), F.col("mean"))).alias("fg_mean"), F.avg(F.when(~F.col("mask"), F.col("mean"))).alias("bg_mean"))
    return t, s


def aligned_to(images: DataFrame, means: DataFrame, side: tuple[int, int], reach: int) -> DataFrame:
    """images (cls, pixels: rows one after another) moved to where they correlate
    best with their class's mean, at most ``reach`` pixels, their edges held; the
    first place from the top left where several do as well. means: cls, mean; a
    row per class, broadcast."""
    height, width = side
    size = 2 * reach + 1

    @F.pandas_udf("array<double>")
    def move(pixels: pd.Series, mean: pd.Series) -> pd.Series:
        flat = np.stack(pixels.to_numpy()).reshape(-1, height, width)
        held = np.pad(flat, ((0, 0), (reach, reach), (reach, reach)), mode="edge")
        target = np.stack(mean.to_numpy()).reshape(-1, height * width)
        target = target - target.mean(axis=1, keepdims=True)
        spots = np.lib.stride_tricks.sliding_window_view(held, (height, width), axis=(1, 2)).reshape(len(flat), size * size, height * width)
        centred = spots - spots.mean(axis=2, keepdims=True)
        norm = np.sqrt((centred**2).sum(axis=2) * (target**2).sum(axis=1)[:, None])
        fit = np.einsum("nsp,np->ns", centred, target) / np.where(norm > 1e-12, norm, np.inf)
        return pd.Series(list(spots[np.arange(len(flat)), np.round(fit, 9).argmax(axis=1)]))

    found = images.join(F.broadcast(means.select("cls", F.col("mean").alias("_mean"))), "cls")
    return found.withColumn("pixels", move("pixels", "_mean")).drop("_mean")


def class_moments(images: DataFrame) -> DataFrame:
    """cls, n, mean and std: arrays over the pixels of each class's images. Each task
    adds its images up before anything is shuffled, so that no class is gathered."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for cls, rows in batch.groupby("cls")["pixels"]:
                x = np.stack(rows.to_numpy())
                n, mean = len(x), x.mean(axis=0)
                m2 = ((x - mean) ** 2).sum(axis=0)
                if cls in sums:
                    old_n, old_mean, old_m2 = sums[cls]
                    gap = mean - old_mean
                    n, mean, m2 = n + old_n, old_mean + gap * n / (n + old_n), m2 + old_m2 + gap**2 * n * old_n / (n + old_n)
                sums[cls] = (n, mean, m2)
        yield pd.DataFrame([(cls, n, mean, m2) for cls, (n, mean, m2) in sums.items()], columns=["cls", "n", "mean", "m2"])

    parts = images.select("cls", "pixels").mapInPandas(task, "cls int, n long, mean array<double>, m2 array<double>")
    cells = parts.select("cls", "n", "m2", F.posexplode("mean").alias("k", "mean")).select("cls", "n", "k", "mean", F.get("m2", F.col("k")).alias("m2"))
    per = cells.groupBy("cls", "k").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("s"))
    std = F.sqrt(F.greatest(F.col("s") / F.col("n") - F.col("m") * F.col("m"), F.lit(0.0)))
    whole = per.groupBy("cls").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "m", std.alias("std")))).alias("_c"))
    return whole.select("cls", "n", F.col("_c.m").alias("mean"), F.col("_c.std").alias("std"))


def refined_templates(images: DataFrame, side: tuple[int, int], reach: int = 10, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of each class's images after they are aligned to the mean
    of the round before; and the images so aligned. A round is stored, so that
    the next one doesn't align from the start."""
    raw = images
    moments = stored(class_moments(raw), "templates")
    for k in range(rounds):
        images = stored(aligned_to(raw, moments, side, reach), f"aligned-{k}")
        moments = stored(class_moments(images), "templates")
    return moments, images


def foreground(images: DataFrame, moments: DataFrame, is_fg: Callable[[Column], Column], essential: float = 0.5, loose: float = 0.3, least: int = 50) -> DataFrame:
    """Per class the share of its images in which a pixel is foreground, the mask of
    shares over ``essential`` (over ``loose`` where that leaves fewer than ``least``
    pixels), and the template's mean outside (255 if all is inside) and inside it
    (0 if nothing is)."""
    cells = images.select("cls", F.posexplode("pixels").alias("k", "v")).groupBy("cls", "k").agg(F.avg(is_fg(F.col("v")).cast("double")).alias("share"))
    shares = cells.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("k", "share"))).alias("_s")).select("cls", F.col("_s.share").alias("share"))
    count = lambda limit: F.size(F.filter("share", lambda x: x > limit))
    limit = F.when(count(essential) < least, loose).otherwise(essential)
    rows = shares.withColumn("limit", limit).withColumn("mask", F.transform("share", lambda x: x > F.col("limit"))).join(moments, "cls")
    both = F.zip_with("mask", "mean", lambda m, x: F.struct(m.alias("m"), x.alias("x")))
    average = lambda keep, none: F.coalesce(F.try_divide(F.aggregate(F.filter(both, keep), F.lit(0.0), lambda a, p: a + p["x"]), F.size(F.filter(both, keep))), F.lit(none))
    return rows.select("cls", "n", "mean", "std", "share", "limit", "mask", F.size(F.filter("mask", lambda m: m)).alias("fg_pixels"), average(lambda p: ~p["m"], 255.0).alias("bg_mean"), average(lambda p: p["m"], 0.0).alias("fg_mean"))


def neighbours(cells: DataFrame, size: int, grow: bool) -> DataFrame:
    """Dilation or erosion of boolean cells (column on) by a square: cells
    shift to their neighbours, so that no window spans an image twice."""
    p, steps = size // 2, F.array(*[F.lit(d) for d in range(-(size // 2), size - size // 2)])
    spread = cells.select("image_id", "y", F.explode(steps).alias("dy"), "x", "on").select("image_id", (F.col("y") + F.col("dy")).alias("y"), "x", "on", F.explode(steps).alias("dx"))
    g = spread.groupBy("image_id", "y", (F.col("x") + F.col("dx")).alias("x")).agg((F.bool_or("on") if grow else F.bool_and("on")).alias("on"))
    return g.join(cells.select("image_id", "y", "x"), ["image_id", "y", "x"]) if p else cells


def inner_boundary(mask: DataFrame, side: str) -> DataFrame:
    """Per row of a side's mask: its innermost x."""
    return mask.groupBy("image_id", "y").agg((F.max("x") if side == "L" else F.min("x")).alias("x"))


def position_udtf(spark):
    """A table function: starts of tiles of a length, for SQL's LATERAL."""

    @udtf(returnType="start int, stop int")
    class TilePositions:
        def eval(self, length: int, tile: int, stride: int):
            if length <= tile:
                yield 0, length
                return
            starts = list(range(0, length - tile + 1, stride))
            if starts[-1] != length - tile:
                starts.append(length - tile)
            for s in starts:
                yield s, s + tile

    spark.udtf.register("tile_positions", TilePositions)
    return TilePositions


class Registry:
    """Named algorithms: score and train, from and to DataFrames."""

    def __init__(self) -> None:
        self._by_name: dict[str, tuple[Callable, Callable | None]] = {}

    def register(self, name: str, score: Callable, train: Callable | None = None) -> None:
        self._by_name[name] = (score, train)

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def get(self, name: str) -> tuple[Callable, Callable | None]:
        if name not in self._by_name:
            raise KeyError(f"unknown algorithm {name!r}; known: {', '.join(self.names())}")
        return self._by_name[name]
