"""Readers and writers of images, annotations, models, logs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.operators.geometry import POLYGON

#: Fixed value: image file extensions.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "tif", "tiff"]
RESULT = (
    "job_id string, project_id string, ok boolean, pred string, score double, threshold double, "
    "timing_ms struct<infer:double,post:double,save:double,read:double,wait:double,total:double,detail:map<string,double>>, "
    "artifacts map<string,string>, regions array<struct<x:int,y:int,w:int,h:int,score:double,area_px:int>>, "
    "model_version string, error struct<code:string,message:string>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size of image files; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).select("path", F.col("length").alias("size")).orderBy("path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, height, width, channels, data; broken files give no row."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder)
    return rows.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def read_polygons(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(POLYGON).option("multiLine", True).json(folder).where("imageHeight > 0 AND imageWidth > 0")


def class_of(path: Column) -> Column:
    """The parent folder's name."""
    return F.element_at(F.split(path, "/"), -2)


def append_log(results: DataFrame, folder: str) -> None:
    """JSON lines in one folder per day (column date)."""
    results.write.mode("append").partitionBy("date").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RESULT + ", date date").json(folder)


def write_models(models: DataFrame, bank: DataFrame, folder: str) -> None:
    models.write.mode("overwrite").parquet(f"{folder}/models")
    bank.repartition("cls").write.mode("overwrite").partitionBy("cls").parquet(f"{folder}/bank")


def read_models(spark: SparkSession, folder: str, method: str) -> tuple[DataFrame, DataFrame]:
    """Models of one method and the bank rows of their classes."""
    models = spark.read.parquet(f"{folder}/models").where(F.col("algo_method") == method)
    return models, spark.read.parquet(f"{folder}/bank").join(models.select("cls"), "cls", "left_semi")


def write_csv(rows: DataFrame, folder: str, compression: str = "none") -> None:
    rows.write.mode("overwrite").option("header", True).option("compression", compression).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What write_csv wrote compressed. A file, which is one task's work then anyway, is
    parsed as one stream, not line by line; values may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).schema(schema).csv(folder)


def write_suspects(rows: DataFrame, folder: str) -> None:
    """Tab-separated lines, one folder per class."""
    rows.select("cls", F.concat_ws("\t", F.format_string("%.6f", "score"), "split", "path").alias("value")).write.mode("overwrite").partitionBy("cls").text(folder)


def read_suspects(spark: SparkSession, folder: str) -> DataFrame:
    """cls, score, split, path of every line; a path may hold tabs."""
    lines = spark.read.schema("value string, cls string").text(folder)
    part = F.split("value", "\t", 3)
    return lines.select("cls", part[0].cast("double").alias("score"), part[1].alias("split"), part[2].alias("path"))


REPORT = "cls string, thr double, n_ok long, n_patches long, score_mean double, score_max double, suspects array<struct<score:double,split:string,path:string>>"


def write_report(classes: DataFrame, suspects: DataFrame, meta: DataFrame, folder: str) -> None:
    """index: a row per class with its suspects, highest score first (suspects: cls,
    score, split, path; a few per class); meta: one row."""
    per = suspects.groupBy(F.col("cls").cast("string").alias("_cls")).agg(F.sort_array(F.collect_list(F.struct("score", "split", "path")), asc=False).alias("suspects"))
    rows = classes.withColumn("cls", F.col("cls").cast("string")).join(per, F.col("cls") == F.col("_cls"), "left").drop("_cls")
    names = [f.split()[0] for f in REPORT.split(", ")]
    none = F.array().cast("array<struct<score:double,split:string,path:string>>")
    rows.withColumn("suspects", F.coalesce("suspects", none)).select(names).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/index")
    meta.write.mode("overwrite").json(f"{folder}/meta")


def read_report(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The report's classes and its meta row. A line that isn't an object with just
    the report's fields, or with a value of another type, is an error."""
    names = sorted(f.split()[0] for f in REPORT.split(", "))
    lines = spark.read.text(f"{folder}/index")
    wrong = lines.where(~F.sort_array(F.json_object_keys("value")).eqNullSafe(F.array(*[F.lit(n) for n in names])))
    if example := wrong.head(1):
        raise ValueError(f"not a row of a report: {example[0].value[:200]}")
    return spark.read.schema(REPORT).option("mode", "FAILFAST").json(f"{folder}/index"), spark.read.json(f"{folder}/meta")


def result_text(pred: Column, prob_ok: Column) -> Column:
    return F.format_string("result=%s\nprob_OK=%.4f", pred, prob_ok)


def parsed_result_text(text: Column) -> Column:
    return F.str_to_map(text, F.lit("\n"), F.lit("="))
