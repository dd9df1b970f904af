"""Streaming jobs. Each takes a streaming DataFrame and returns one; ``drain``
runs what is there now and returns the result as a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inspectra.sources.folders import shared_path


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.withColumn("epoch", F.lit(0).cast("int")).schema
    return spark.read.schema(schema).parquet(out)


def read_table(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A table's files as a stream, at most ``files`` of them at each trigger.
    The path is given as a pattern, as a plain one would have to be a folder and
    a table may be one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def minute_monitor(jobs: DataFrame, late: str = "10 minutes", size: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Throughput, yield and latency per project and window."""
    g = jobs.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "project_id")
    out = g.agg(F.count(F.lit(1)).alias("jobs"), F.avg((F.col("pred") == "OK").cast("double")).alias("yield"), F.avg("infer_ms").alias("mean_ms"))
    return out.select(F.col("window.start").alias("start"), "project_id", "jobs", "yield", "mean_ms")


def sessions(requests: DataFrame, client: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """A client's session ends when it has been idle for the gap."""
    g = requests.withWatermark("ts", late).groupBy(F.session_window("ts", gap), client).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(client, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests")


def pairs(images: DataFrame, jsons: DataFrame, within: str = "12 seconds", outer: bool = True) -> DataFrame:
    """Image and annotation by stem, at most ``within`` apart. With outer, an
    image that stays alone comes out once the watermark has passed it."""
    i = images.select(F.col("stem").alias("i_stem"), F.col("ts").alias("image_ts")).withWatermark("image_ts", within)
    j = jsons.select(F.col("stem").alias("j_stem"), F.col("ts").alias("json_ts")).withWatermark("json_ts", within)
    near = F.expr(f"i_stem = j_stem AND json_ts BETWEEN image_ts - INTERVAL {within} AND image_ts + INTERVAL {within}")
    return i.join(j, near, "left_outer" if outer else "inner").select(F.col("i_stem").alias("stem"), "image_ts", "json_ts")


def once_per_stem(arrivals: DataFrame, late: str) -> DataFrame:
    return arrivals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["stem", "kind"])


LIVE = "project_id string, total long, ok long, ng long, error long, avg_ms double, last_ts timestamp"
STATE = "total long, ok long, ng long, error long, first_us long, first_job long, us array<long>, jobs array<long>, ms array<double>"
#: Rows of a project that its running latency is made of: 0.9 to this power is below 1e-16.
NEWEST = 352
EMPTY = (0, 0, 0, 0, 0, 0, [], [], [])


def fold(state: tuple, rows: pd.DataFrame) -> tuple:
    """The state after more jobs, in whatever order they come: counts, the first
    job and the newest ones."""
    if rows.empty:
        return state
    total, ok, ng, error, *first, us, jobs, ms = state
    n_ok, n_ng = int((rows["pred"] == "OK").sum()), int((rows["pred"] == "NG").sum())
    us = np.concatenate((np.array(us, np.int64), rows["ts"].to_numpy("datetime64[us]").astype(np.int64)))
    jobs = np.concatenate((np.array(jobs, np.int64), rows["job_id"].to_numpy(np.int64)))
    ms = np.concatenate((np.array(ms, float), rows["infer_ms"].to_numpy(float)))
    order = np.lexsort((jobs, us))
    least = (int(us[order[0]]), int(jobs[order[0]]))
    first, last = (min(tuple(first), least) if total else least), order[-NEWEST:]
    return (total + len(rows), ok + n_ok, ng + n_ng, error + len(rows) - n_ok - n_ng, *first, us[last].tolist(), jobs[last].tolist(), ms[last].tolist())


def live_row(state: tuple, keep: float = 0.9) -> tuple:
    """total, ok, ng, error, running latency and last time."""
    *counts, first_us, first_job, us, jobs, ms = state
    avg = 0.0
    for t, job, x in zip(us, jobs, ms, strict=True):
        avg = x if (t, job) == (first_us, first_job) else keep * avg + (1 - keep) * x
    return (*counts, avg, pd.Timestamp(us[-1], unit="us") if us else None)


def live_stats(jobs: DataFrame) -> DataFrame:
    """Counts, running latency and last time per project, as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else EMPTY
        for batch in batches:  # one at a time: a busy project's rows are never held together
            now = fold(now, batch)
        state.update(now)
        yield pd.DataFrame([(key[0], *live_row(now))], columns=[c.split()[0] for c in LIVE.split(", ")])

    rows = jobs.select("project_id", "job_id", "ts", "pred", "infer_ms")
    return rows.groupBy("project_id").applyInPandasWithState(update, LIVE, STATE, "update", GroupStateTimeout.NoTimeout)
