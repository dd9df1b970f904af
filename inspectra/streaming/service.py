"""The watching service as streams: requests and files as they arrive, work that
is pending as state, and sinks that a repeated batch doesn't write twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inspectra.sources.folders import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WORK = "stem long, event string, ts timestamp, image_ts timestamp, json_ts timestamp, attempts int"
STATE = "image long, json long, working boolean, failures int"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need; the session's own is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def step(state: tuple, kind: str, us: int, ok: bool, timeout_us: int, most: int) -> tuple[tuple, list[tuple]]:
    """State and outcomes after one arrival. state: time of the pending image and
    annotation, whether a pair is worked on, its failures so far. An outcome is
    event, time, image's and annotation's time, attempts.

    A later file replaces the pending one of its kind; a pending file that is
    ``timeout_us`` old or more can't be paired any more."""
    image, json, working, failures = state
    out = []
    if image is not None and us - image >= timeout_us:
        out.append(("timeout", image + timeout_us, image, None, 0))
        image = None
    if json is not None and us - json >= timeout_us:
        out.append(("timeout", json + timeout_us, None, json, 0))
        json = None
    if kind == "image":
        image = us
    elif kind == "json":
        json = us
    elif working:
        failures += 0 if ok else 1
        if ok or failures > most:
            out.append(("archive" if ok else "error", us, None, None, failures + bool(ok)))
            working, failures = False, 0
    if image is not None and json is not None:
        out.append(("pair", us, image, json, 0))
        image, json, working, failures = None, None, True, 0
    return (image, json, working, failures), out


def rows_of(stem: int, outcomes: list[tuple]) -> pd.DataFrame:
    time = lambda k: pd.to_datetime([o[k] for o in outcomes], unit="us")
    return pd.DataFrame({"stem": stem, "event": [o[0] for o in outcomes], "ts": time(1), "image_ts": time(2), "json_ts": time(3), "attempts": [o[4] for o in outcomes]})


class PendingFiles(StatefulProcessor):
    """Files of a stem until they are paired or too old, and a pair's attempts
    until one succeeds or the last one fails."""

    def __init__(self, timeout_us: int, most: int) -> None:
        self.timeout_us, self.most = timeout_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", STATE)

    def now(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (None, None, False, 0)

    def keep(self, state: tuple) -> None:
        if state == (None, None, False, 0):
            self.state.clear()
            return
        self.state.update(state)
        for us in state[:2]:
            if us is not None:
                self.handle.registerTimer(-(-(us + self.timeout_us) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "kind"])  # one stem's rows of one batch
        state, out = self.now(), []
        for kind, us, ok in zip(batch["kind"], batch["ts"].to_numpy("datetime64[us]").astype("int64"), batch["ok"], strict=True):
            state, more = step(state, kind, int(us), bool(ok), self.timeout_us, self.most)
            out += more
        self.keep(state)
        if out:
            yield rows_of(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        image, json, working, failures = self.now()
        passed, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        if image is not None and image + self.timeout_us <= passed:
            out.append(("timeout", image + self.timeout_us, image, None, 0))
            image = None
        if json is not None and json + self.timeout_us <= passed:
            out.append(("timeout", json + self.timeout_us, None, json, 0))
            json = None
        self.keep((image, json, working, failures))
        if out:
            yield rows_of(key[0], out)


def pending_files(arrivals: DataFrame, timeout_s: float = 12.0, retries: int = 2, late: str = "0 seconds") -> DataFrame:
    """arrivals: stem, kind (image, json, or attempt with ok), ts. Outcomes of
    pairing and of the attempts: pair, timeout, archive, error (after the first
    attempt and ``retries`` more have failed)."""
    rows = arrivals.select("stem", "kind", "ts", F.coalesce("ok", F.lit(False)).alias("ok")).withWatermark("ts", late)
    processor = PendingFiles(round(timeout_s * 1_000_000), retries)
    return rows.groupBy("stem").transformWithStateInPandas(processor, WORK, "Append", "EventTime")


def sink(stream: DataFrame, name: str, routes: dict[str, Column], day: Column, setting: Callable = rocks_state) -> dict[str, DataFrame]:
    """Runs what is there now; each route's rows by day. A batch has a folder of its
    own, which a repeated run of it overwrites: nothing is written twice."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    with setting(spark):
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(batch_writer(out, routes, day)).start().awaitTermination()
    return {route: read_route(spark, stream, f"{out}/{route}") for route in routes}


def batch_writer(out: str, routes: dict[str, Column], day: Column) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        for route, condition in routes.items():
            batch.where(condition).withColumn("_day", day).write.mode("overwrite").partitionBy("_day").parquet(f"{out}/{route}/_batch={number}")

    return write


def read_route(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return spark.read.schema(f"{fields}, _batch long, _day date").parquet(folder).drop("_batch").withColumnRenamed("_day", "day")


def read_drop_folder(spark: SparkSession, folder: str, parts: str, files: int = 64) -> DataFrame:
    """Lines of the text files of a drop folder as they arrive, with the columns of
    its sub-folders (``name type, ...``)."""
    return spark.readStream.schema(f"value string, {parts}").option("maxFilesPerTrigger", files).text(folder).withColumnRenamed("value", "line")
