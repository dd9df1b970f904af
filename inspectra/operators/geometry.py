"""Boxes, grids, annotations, names and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.operators import ranks

ITEM = "array<struct<ch:string,cx:double,cy:double,w:double,h:double,i:int,idx:int,label:string,name:string>>"
POLYGON = "imagePath string, imageHeight int, imageWidth int, shapes array<struct<label:string,points:array<array<double>>>>"


def box_from_centre(pad: int = 2) -> dict[str, Column]:
    """Rounds half to even, as the numbers were made."""
    x0, y0 = F.rint(F.col("cx") - F.col("w") / 2).cast("int"), F.rint(F.col("cy") - F.col("h") / 2).cast("int")
    x1, y1 = F.rint(F.col("cx") + F.col("w") / 2).cast("int"), F.rint(F.col("cy") + F.col("h") / 2).cast("int")
    return {"x0": x0 - pad, "y0": y0 - pad, "x1": x1 + pad, "y1": y1 + pad}


def integer_box(pad: int = 2) -> dict[str, Column]:
    """The variant that truncates first and takes half the size, rounded down,
    to either side: an odd size loses a pixel."""
    cx, cy, w, h = (F.col(c).cast("int") for c in ("cx", "cy", "w", "h"))
    half_w, half_h = F.floor(w / 2).cast("int") + pad, F.floor(h / 2).cast("int") + pad
    return {"x0": cx - half_w, "y0": cy - half_h, "x1": cx + half_w, "y1": cy + half_h}


def clipped(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """An interval inside [0, size], at least one pixel long where it begins
    before the end; one that begins at or beyond the end is empty."""
    a = F.greatest(F.lit(0), F.least(low, size))
    b = F.greatest(F.lit(0), F.least(high, size))
    return a, F.when(b <= a, F.least(size, a + 1)).otherwise(b)


def plain_clipped(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """The variant that may become empty."""
    return F.greatest(F.lit(0), low), F.least(size, high)


def clip_boxes(boxes: DataFrame, width: Column, height: Column, plain: bool = False) -> DataFrame:
    clip = plain_clipped if plain else clipped
    (x0, x1), (y0, y1) = clip(F.col("x0"), F.col("x1"), width), clip(F.col("y0"), F.col("y1"), height)
    out = boxes.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).drop("x0", "x1", "y0", "y1").withColumnsRenamed({"_x0": "x0", "_x1": "x1", "_y0": "y0", "_y1": "y1"})
    return out.where("x1 > x0 AND y1 > y0") if plain else out


def read_annotations(text: DataFrame, column: str = "json", item: str = ITEM) -> DataFrame:
    """One row per item of JSON annotations; a byte order mark is allowed,
    items that aren't a list count as none. item: the type of the items, where not
    all of their keys are needed."""
    # the mark's three bytes are cut off: no text is searched or copied as characters
    bare = F.when(F.col(column).startswith("\ufeff"), F.substring(F.col(column).cast("binary"), 4, 2**31 - 1).cast("string")).otherwise(F.col(column))
    parsed = text.withColumn("_a", F.from_json(bare, f"image_name string, items {item}"))
    items = F.explode(F.coalesce("_a.items", F.array().cast(item)))
    return parsed.select(*[c for c in text.columns if c != column], F.col("_a.image_name").alias("image_name"), items.alias("item"))


def valid_items(rows: DataFrame) -> DataFrame:
    """Items with a character and a size; missing keys fall back."""
    i = F.col("item")
    ch = F.coalesce(i["ch"], i["label"], i["name"])
    out = rows.select(
        *[c for c in rows.columns if c != "item"], F.coalesce(i["i"], i["idx"], F.lit(-1)).alias("idx"), ch.alias("ch"),
        i["cx"].alias("cx"), i["cy"].alias("cy"), i["w"].alias("w"), i["h"].alias("h"),
    )
    return out.where((F.coalesce("ch", F.lit("")) != "") & (F.coalesce("w", F.lit(0.0)) > 0) & (F.coalesce("h", F.lit(0.0)) > 0))


def character_totals(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Per key: n, first_ch, last_ch and kinds of the items' characters (ch), and
    sums. Numbers are added up per key and character first: only what is left is
    compared as texts, which sorts it."""
    per = rows.groupBy(key, "ch").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return per.groupBy(key).agg(F.sum("n").alias("n"), F.min("ch").alias("first_ch"), F.max("ch").alias("last_ch"), F.count("ch").alias("kinds"), *[F.sum(c).alias(c) for c in sums])


#: Characters that file systems forbid, and the names they get.
SAFE_NAMES = {"/": "slash", "\\": "backslash", ":": "colon", "*": "asterisk", "?": "question", '"': "quote", "<": "lt", ">": "gt", "|": "pipe", ".": "dot", " ": "space", "\t": "tab"}


def labelled_items(rows: DataFrame, labels: tuple[str, ...] = ("OK", "NG"), key: str = "label") -> DataFrame:
    """Items with a size whose label, in upper case, is one of those given."""
    i = F.col("item")
    label = F.upper(F.coalesce(i[key], F.lit("")))
    return rows.withColumn("label", label).where(label.isin(*labels) & (F.coalesce(i["w"], F.lit(0.0)) > 0) & (F.coalesce(i["h"], F.lit(0.0)) > 0))


def safe_name(ch: Column) -> Column:
    """Class folder name of a character."""
    table = F.create_map(*[F.lit(x) for kv in SAFE_NAMES.items() for x in kv])
    code = F.concat(F.lit("u"), F.lpad(F.hex(F.ascii(ch)), 4, "0"))
    odd = ch.rlike(r"[. ]$")
    return F.when(ch == "", "empty").otherwise(F.coalesce(F.try_element_at(table, ch), F.when(odd, code).otherwise(ch)))


def positions(length: Column, tile: int, stride: int) -> Column:
    """Starts of tiles by stride; the last one touches the end."""
    last = length - tile
    grid = F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(F.greatest(last, F.lit(0))))
    return F.when(length > tile, grid).otherwise(F.array(F.lit(0)))


def tiles(images: DataFrame, tile_w: int, tile_h: int, stride_x: int, stride_y: int) -> DataFrame:
    xs = images.withColumn("x0", F.explode(positions(F.col("w"), tile_w, stride_x)))
    rows = xs.withColumn("y0", F.explode(positions(F.col("h"), tile_h, stride_y)))
    return rows.withColumns({"x1": F.least(F.col("w"), F.col("x0") + tile_w), "y1": F.least(F.col("h"), F.col("y0") + tile_h)})


def strips(images: DataFrame, size: int, overlap: int) -> DataFrame:
    """Strips along the longer axis (vertical if the sides are equal)."""
    vertical = F.col("h") >= F.col("w")
    length = F.when(vertical, F.col("h")).otherwise(F.col("w"))
    rows = images.withColumn("vertical", vertical).select("*", F.posexplode(positions(length, size, max(1, size - overlap))).alias("strip_idx", "start"))
    end = F.least(F.col("start") + size, F.when(F.col("vertical"), F.col("h")).otherwise(F.col("w")))
    pick = lambda a, b: F.when(F.col("vertical"), a).otherwise(b)
    return rows.withColumns({"x0": pick(F.lit(0), F.col("start")), "y0": pick(F.col("start"), F.lit(0)), "x1": pick(F.col("w"), end), "y1": pick(end, F.col("h"))}).drop("start")


def skip_edges(strip_rows: DataFrame, n: int) -> DataFrame:
    """Without the first and last n strips of images that have over 2 n."""
    image = Window.partitionBy("image_id")
    rows = strip_rows.withColumns({"_n": F.row_number().over(image.orderBy("strip_idx")), "_all": F.count(F.lit(1)).over(image)})
    return rows.where((F.col("_all") <= 2 * n) | ((F.col("_n") > n) & (F.col("_n") <= F.col("_all") - n))).drop("_n", "_all")


def path_parts(path: Column) -> dict[str, Column]:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {
        "name": name,
        "stem": F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name),
        "extension": F.regexp_extract(name, r"^.+(\.[^.]+)$", 1),
        "parent": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
    }


def join_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with their image: by full name, else by base name."""
    full = images.select(F.col("name").alias("image_name"), F.col("image_id").alias("by_name"))
    base = images.groupBy(F.regexp_extract("name", r"([^/]*)$", 1).alias("base")).agg(F.min("image_id").alias("by_base"))
    rows = annotations.withColumn("base", F.regexp_extract("image_name", r"([^/]*)$", 1))
    return rows.join(full, "image_name", "left").join(base, "base", "left").withColumn("image_id", F.coalesce("by_name", "by_base")).drop("base", "by_name", "by_base")


def annotation_images(annotations: DataFrame, images: DataFrame, root: str, extensions: list[str]) -> DataFrame:
    """Annotations (path, image_path) with the image they belong to (image_id, path;
    null if there is none): the named path if it is absolute, else under the
    annotation's folder, else under the root; else the annotation's own stem with
    each extension in turn, as it is and in upper case. An annotation has a few
    candidate paths, and each is looked up; files of one stem never meet as pairs."""
    parts = path_parts(F.col("path"))
    folder, named = parts["parent"], F.coalesce("image_path", F.lit(""))
    by_name = [F.when(named.startswith("/"), named), F.when(named != "", F.concat(folder, F.lit("/"), named)), F.when(named != "", F.concat(F.lit(f"{root}/"), named))]
    by_stem = [F.concat(folder, F.lit("/"), parts["stem"], F.lit(e)) for ext in extensions for e in (f".{ext}", f".{ext.upper()}")]
    candidates = F.posexplode(F.array(*by_name, *by_stem)).alias("_priority", "_candidate")
    there = images.groupBy(F.col("path").alias("_candidate")).agg(F.min("image_id").alias("_image"))
    rows = annotations.withColumn("_row", F.monotonically_increasing_id())
    found = rows.select("_row", candidates).where("_candidate IS NOT NULL").join(there, "_candidate").groupBy("_row").agg(F.min_by("_image", "_priority").alias("image_id"))
    return rows.join(found, "_row", "left").drop("_row")


def first_candidate(rows: DataFrame, key: str, priority: str, tie: str) -> DataFrame:
    """Of each key's candidates the one with the least priority number."""
    order = Window.partitionBy(key).orderBy(priority, tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def number_crops(crops: DataFrame, existing: DataFrame, order: list[str], block: int = 256) -> DataFrame:
    """Running number per class after the class's largest existing one; the
    file name has four digits, or more where the number does. Rows are numbered
    in blocks of the first order column, a whole number, after the rows of the
    blocks before, so that no task sorts a whole class."""
    largest = existing.groupBy("cls").agg(F.max("crop_no").alias("largest"))
    rows = crops.withColumn("_block", F.floor(F.col(order[0]) / block))
    sizes = rows.groupBy("cls", "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("cls").orderBy("_block")) - F.col("_size")).drop("_size")
    n = F.row_number().over(Window.partitionBy("cls", "_block").orderBy(*order)) + F.col("_before") + F.coalesce("largest", F.lit(0))
    rows = rows.join(before, ["cls", "_block"]).join(largest, "cls", "left").withColumn("crop_no", n).drop("largest", "_block", "_before")
    return rows.withColumn("file", crop_file(F.col("crop_no")))


def crop_file(number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(".png"))


def places_by_character(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, cls, idx: for each character of a text the array of its places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for image, t in zip(batch[key].iloc[at : at + 64], batch[text].iloc[at : at + 64], strict=True):
                    codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
                    order = np.argsort(codes, kind="stable")
                    cuts = np.flatnonzero(np.diff(codes[order])) + 1
                    rows += [(image, t[part[0]], part) for part in np.split(order.astype(np.int32), cuts) if len(part)]
                yield pd.DataFrame(rows, columns=[key, "cls", "idx"])

    return texts.select(key, text).mapInPandas(run, f"{key} long, cls string, idx array<int>")


def numbers_before(counted: DataFrame, existing: DataFrame, order: str, n: str, block: int = 256) -> DataFrame:
    """As number_crops, for rows of a class that stand for n crops each: adds before,
    the number that the row's first crop follows."""
    largest = existing.groupBy("cls").agg(F.max("crop_no").alias("largest"))
    rows = ranks.running_sums(counted, ["cls"], F.floor(F.col(order) / block), [order], n, "_upto").join(largest, "cls", "left")
    return rows.withColumn("before", F.col("_upto") - F.col(n) + F.coalesce("largest", F.lit(0))).drop("_upto", "largest")
