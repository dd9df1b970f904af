"""Helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}

#: The white space that separates words in every contract: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. In
    local mode (as in tests) a temporary one of our own where that is missing."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own_folder[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return that table: cuts the
    lineage, and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_small_batches(df: DataFrame, name: str, rows: int = 512) -> DataFrame:
    """As stored, with fewer rows at a time between Spark and Python, for rows
    that hold texts; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound, for the rest of the session, what passes at a time between Spark and
    Python, for plans that the caller runs over whole texts; a bound that is
    already lower stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bytes_of(df: DataFrame, size: Column) -> int:
    """Sum of a size expression, for the checks that precede a broadcast."""
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


#: Decisions up to this size are sent to every task; larger ones are joined.
BROADCAST_BYTES = 32 << 20


def keep_decided(rows: DataFrame, keys: list[str], decided: DataFrame) -> DataFrame:
    """The rows that stay. rows: the keys, and "row" with what is returned;
    decided: the keys of each row, and "kept"; a key that has none stays. Only
    the keys that go, or that several kept rows share, are looked up: broadcast
    where they are few bytes (checked), else by a join. Of kept rows that share
    their keys one stays; they are combined in each task first."""
    per = decided.groupBy(*keys).agg(F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    flags = stored(per.where("NOT _kept OR _n > 1").select(*[F.col(k).alias("_f" + k) for k in keys], F.col("_kept").alias("_again")), "flags")
    small = bytes_of(flags, F.lit(64)) <= BROADCAST_BYTES
    same = None
    for k in keys:
        one = rows[k].eqNullSafe(flags["_f" + k])
        same = one if same is None else same & one
    marked = rows.join(F.broadcast(flags) if small else flags, same, "left")
    again = marked.where("_again").groupBy(*keys).agg(F.first("row").alias("row"))
    return marked.where("_again IS NULL").select("row.*").unionByName(again.select("row.*"))
