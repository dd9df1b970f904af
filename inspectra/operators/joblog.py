"""Job-log analytics: stats, latency, versions, status."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.operators import ranks

EMA_KEEP = 0.9


def project_stats(jobs: DataFrame) -> DataFrame:
    """Counts per project; whatever is neither OK nor NG counts as an error."""
    pred = F.col("pred")
    return jobs.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(pred == "OK").alias("ok"), F.count_if(pred == "NG").alias("ng"),
        F.count_if(pred.isNull() | ~pred.isin("OK", "NG")).alias("error"), F.max("ts").alias("last_ts"),
    )


#: Beyond so many jobs a value's weight (0.9 ** 4000) is far below what a double can add.
#: A row whose weight has fallen below this part of one no longer counts.
EMA_REST = 1e-16


def running_latency(jobs: DataFrame, keep: float = EMA_KEEP, rest: float = EMA_REST) -> DataFrame:
    """avg = first value, then keep * avg + (1 - keep) * x in order of arrival,
    as the weighted sum that it unrolls to. Only the last rows of a project
    weigh anything; the rank's limit is applied before the shuffle, so that a
    busy project isn't sorted as a whole."""
    rows = max(1, math.ceil(math.log(rest) / math.log(keep))) if 0 < keep < 1 else 1
    order = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("job_id"))
    starts = jobs.groupBy("project_id").agg(F.min(F.struct("ts", "job_id")).alias("start"))
    last = jobs.select("project_id", "infer_ms", "ts", "job_id").withColumn("age", F.row_number().over(order)).where(F.col("age") <= rows)
    share = F.pow(F.lit(keep), F.col("age") - 1) * F.when(F.struct("ts", "job_id") == F.col("start"), 1.0).otherwise(1 - keep)
    return last.join(starts, "project_id").groupBy("project_id").agg(F.sum(share * F.col("infer_ms")).alias("avg_ms"))


#: Steps that a timing always has; others are detail.
STEPS = ["infer", "post", "save", "read"]


def merged_timing(steps: Column, wait: Column, total: Column) -> Column:
    """A plugin's map of steps with any keys, the wait for the file and the total as
    one map: known steps are 0 where missing, wait and total come first, other
    keys are rounded to two places."""
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in ("wait_file", "total", *STEPS)]), F.array(F.round(wait, 2), F.round(total, 2), *[F.coalesce(F.try_element_at(steps, F.lit(k)), F.lit(0.0)) for k in STEPS]))
    free = F.transform_values(F.map_filter(steps, lambda k, v: ~k.isin("wait_file", "total", *STEPS) & v.isNotNull()), lambda k, v: F.round(v, 2))
    return F.map_concat(known, F.coalesce(free, F.create_map().cast("map<string,double>")))


def timing_of_json(text: Column) -> Column:
    """Any numeric keys of a JSON object; other keys and other texts give none."""
    numbers = F.transform_values(F.from_json(text, "map<string,string>"), lambda k, v: v.try_cast("double"))
    return F.coalesce(F.map_filter(numbers, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,double>"))


def timing_means(rows: DataFrame, timing: str) -> DataFrame:
    """Mean milliseconds per project and key of the timing maps, whatever the keys are."""
    pairs = rows.select("project_id", F.explode(timing).alias("step", "ms")).where("ms IS NOT NULL")
    return pairs.groupBy("project_id", "step").agg(F.avg("ms").alias("mean_ms"), F.count("ms").alias("n"))


def step_latency(jobs: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Mean milliseconds per project and step; a null step isn't counted."""
    pairs = F.explode(F.create_map(*[c for k, v in steps.items() for c in (F.lit(k), F.col(v))])).alias("step", "ms")
    return jobs.select("project_id", pairs).where("ms IS NOT NULL").groupBy("project_id", "step").agg(F.avg("ms").alias("mean_ms"), F.count("ms").alias("n"))


def last_marks(jobs: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """Jobs with the last value of each column that was known at their time. marks:
    project_id, ts and the columns, any of them null. Jobs and marks meet per
    project and day, so that a busy project is spread; each day opens with what
    was known before it. Of marks at one time the largest value holds."""
    day, order = F.to_date("ts"), Window.partitionBy("project_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    own = marks.groupBy("project_id", "ts").agg(*[F.max(c).alias(c) for c in columns]).withColumn("day", day)
    daily = own.groupBy("project_id", "day").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns])
    days = jobs.select("project_id", day.alias("day")).distinct().join(daily, ["project_id", "day"], "full")
    opening = days.select("project_id", "day", *[F.last(c, ignorenulls=True).over(order).alias(f"_open_{c}") for c in columns])
    rows = jobs.withColumns({"_job": F.lit(True), "day": day}).unionByName(own.withColumn("_job", F.lit(False)), allowMissingColumns=True)
    so_far = Window.partitionBy("project_id", "day").orderBy("ts", "_job").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns}).where("_job")
    out = seen.join(opening, ["project_id", "day"], "left")
    return out.withColumns({c: F.coalesce(c, f"_open_{c}") for c in columns}).drop("_job", "day", *[f"_open_{c}" for c in columns])


def as_of(jobs: DataFrame, pins: DataFrame, fallback: str = "none") -> DataFrame:
    """The version that was active at each job's time: the last pin of its
    project not after it."""
    seen = last_marks(jobs.select("job_id", "project_id", "ts"), pins.select("project_id", F.col("updated_at").alias("ts"), "version"), ["version"])
    return seen.select("job_id", "project_id", F.coalesce("version", F.lit(fallback)).alias("version"))


#: Files that make a version folder a model.
MODEL_FILES = ["meta.json", "index.json"]


def model_versions(listing: DataFrame) -> DataFrame:
    """project_id, version, ts of the version folders, and whether they hold a model
    file (from when the first one is there). listing: project_id, version, file, ts."""
    is_model = F.col("file").isin(*MODEL_FILES) | F.col("file").endswith(".joblib")
    return listing.groupBy("project_id", "version").agg(F.min("ts").alias("ts"), F.min(F.when(is_model, F.col("ts"))).alias("model_ts"))


def active_version(jobs: DataFrame, pins: DataFrame, listing: DataFrame, fallback: str = "none") -> DataFrame:
    """job_id, project_id, version: the last pin's version where there is a pin (none
    if its folder doesn't exist), else the newest version, by name, whose folder
    held a model file at the time."""
    versions = model_versions(listing)
    pinned = pins.select("project_id", F.col("updated_at").alias("ts"), "version").join(versions.select("project_id", "version", F.lit(True).alias("_there")), ["project_id", "version"], "left")
    pin = pinned.select("project_id", "ts", F.struct("version", F.coalesce("_there", F.lit(False)).alias("there")).alias("pin"))
    # of the versions in order of their model files those with a larger name than all before
    before = F.max("version").over(Window.partitionBy("project_id").orderBy("model_ts", "version").rowsBetween(Window.unboundedPreceding, -1))
    with_model = versions.where("model_ts IS NOT NULL").withColumn("_before", before)
    newest = with_model.where("_before IS NULL OR version > _before").select("project_id", F.col("model_ts").alias("ts"), F.col("version").alias("newest"))
    seen = last_marks(jobs.select("job_id", "project_id", "ts"), pin.unionByName(newest, allowMissingColumns=True), ["pin", "newest"])
    version = F.when(F.col("pin").isNull(), F.col("newest")).when(F.col("pin.there"), F.col("pin.version"))
    return seen.select("job_id", "project_id", F.coalesce(version, F.lit(fallback)).alias("version"))


def latest_version(listing: DataFrame) -> DataFrame:
    """The newest version of each project that holds a model file."""
    return model_versions(listing).where("model_ts IS NOT NULL").groupBy("project_id").agg(F.max("version").alias("version"))


def threshold(option: Column, project: Column, model: Column, default: float = 0.5) -> Column:
    """Request option, else project override unless it is 0, else the model's."""
    return F.coalesce(option, F.nullif(project, F.lit(0.0)), model, F.lit(default))


def three_levels(value: Column, warn: float, ng: float) -> Column:
    return F.when(value >= ng, "NG").when(value >= warn, "WARN").otherwise("OK")


#: The commands of a request.
COMMANDS = ["PING", "INFER", "STATUS", "SET_ACTIVE_MODEL"]


def request_code(known: Column, enabled: Column, loaded: Column, job_id: Column, cmd: Column, path: Column) -> Column:
    """The first check that fails, in order; OK if none does. Commands match in
    any case; only an inference names a job, an image and a project's model."""
    cmd = F.upper(F.coalesce(cmd, F.lit("")))
    missing = (F.coalesce(job_id, F.lit("")) == "") | (F.coalesce(path, F.lit("")) == "")
    return (
        F.when(~cmd.isin(*COMMANDS), "INVALID_CMD")
        .when(cmd != "INFER", "OK")
        .when(missing, "INVALID_CMD")
        .when(~known, "PROJECT_NOT_FOUND")
        .when(~enabled, "PROJECT_DISABLED")
        .when(~loaded, "MODEL_NOT_LOADED")
        .otherwise("OK")
    )


REQUEST = "cmd string, job_id string, image_path string, options map<string,string>"
BLANKS = " \t\r\n\x0b\x0c"


def repaired_json(line: Column) -> Column:
    """A trimmed line of JSON members without its braces gets them."""
    text = F.trim(line, F.lit(BLANKS))
    return F.when(text.startswith('"'), F.concat(F.lit("{"), F.rtrim(text, F.lit("}")), F.lit("}"))).otherwise(text)


def parsed_request(line: Column) -> Column:
    """The request of a line once repaired, else of the line as it came; null if neither is an object."""
    whole = lambda text: F.when(F.is_variant_null(F.try_parse_json(text)), None).when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.from_json(text, REQUEST))
    return F.coalesce(whole(repaired_json(line)), whole(line))


def log_tail(jobs: DataFrame, n: int) -> DataFrame:
    """The last n entries per project."""
    order = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("job_id"))
    return jobs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def entries_since(jobs: DataFrame, since: int) -> DataFrame:
    """Entries of each project from the ``since``-th on (from 0, in order of arrival),
    with their index and the next one to ask for. A busy project is numbered by
    the day."""
    one = jobs.withColumn("_one", F.lit(1))
    numbered = ranks.running_sums(one, ["project_id"], F.unix_date(F.to_date("ts")), ["ts", "job_id"], "_one", "_n").drop("_one")
    total = jobs.groupBy(F.col("project_id").alias("_p")).agg(F.count(F.lit(1)).alias("next_index"))
    rows = numbered.withColumn("index", F.col("_n") - 1).drop("_n").where(F.col("index") >= since)
    return rows.join(total, F.col("project_id").eqNullSafe(F.col("_p"))).drop("_p")


def job_status(pred: Column, ms: Column, limit_ms: float) -> Column:
    return F.when(ms > limit_ms, "timeout").when(pred == "ERROR", "failed").otherwise("completed")


def backlog(jobs: DataFrame, most: int) -> DataFrame:
    """Jobs pending per project after every start; ``full`` where over ``most``.
    A busy project is counted by the day."""
    start = jobs.select("project_id", "job_id", "ts", F.lit(1).alias("step"))
    end = jobs.select("project_id", "job_id", (F.col("ts") + F.make_interval(secs=F.col("infer_ms"))).alias("ts"), F.lit(-1).alias("step"))
    both = start.unionByName(end)
    pending = ranks.running_sums(both, ["project_id"], F.unix_date(F.to_date("ts")), ["ts", "step", "job_id"], "step", "pending").where("step = 1")
    return pending.select("project_id", "job_id", "pending", (F.col("pending") > most).alias("full"))


def stable_files(polls: DataFrame, checks: int, deadline_s: float | None = None) -> DataFrame:
    """First time at which a file's size had been above 0 and equal to the
    previous poll's ``checks`` times in a row; with a deadline only files that
    are so before it has passed since their first poll."""
    if deadline_s is not None:
        first = polls.groupBy("path").agg(F.min("ts").alias("_first"))
        polls = polls.join(first, "path").where(F.unix_micros("ts") - F.unix_micros("_first") < round(deadline_s * 1e6)).drop("_first")
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    same = (F.col("size") > 0) & (F.col("size") == F.lag("size").over(order))
    rows = polls.withColumn("same", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("island", F.sum((~F.col("same")).cast("int")).over(order))
    length = F.sum(F.col("same").cast("int")).over(Window.partitionBy("path", "island").orderBy("ts", "event_id"))
    return rows.withColumn("run", length).where(F.col("run") >= checks).groupBy("path").agg(F.min("ts").alias("ready_at"))
