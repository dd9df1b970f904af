"""Queries on the job log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectra.operators import joblog as op
from inspectra.plans import views as v
from inspectra.plans.registry import query


@query("""SELECT project_id, count(*) AS total, count(*) FILTER (pred = 'OK') AS ok, count(*) FILTER (pred = 'NG') AS ng,
    count(*) FILTER (pred NOT IN ('OK', 'NG')) AS error, max(ts) AS last_ts FROM jobs GROUP BY project_id""")
def a1_project_stats(spark, sf_dir):
    return op.project_stats(v.jobs(spark, sf_dir))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, job_id DESC) - 1 AS age, count(*) OVER (PARTITION BY project_id) AS total FROM jobs)
    SELECT project_id, round(sum(pow(0.9, age) * (CASE WHEN age = total - 1 THEN 1.0 ELSE 0.1 END) * infer_ms), 4) AS avg_ms FROM n GROUP BY project_id""")
def a2_running_latency(spark, sf_dir):
    return op.running_latency(v.jobs(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 4))


@query("""SELECT project_id, step, round(avg(ms), 4) AS mean_ms, count(*) AS n FROM (
    SELECT project_id, 'infer' AS step, infer_ms AS ms FROM jobs UNION ALL SELECT project_id, 'k', k FROM jobs) WHERE ms IS NOT NULL GROUP BY ALL""")
def a26_step_latency(spark, sf_dir):
    return op.step_latency(v.jobs(spark, sf_dir), {"infer": "infer_ms", "k": "k"}).withColumn("mean_ms", F.round("mean_ms", 4))


@query("""WITH p AS (SELECT project_id, updated_at, max(version) AS version FROM model_pins GROUP BY ALL)
    SELECT j.job_id, j.project_id, coalesce(p.version, 'none') AS version FROM jobs j ASOF LEFT JOIN p ON j.project_id = p.project_id AND j.ts >= p.updated_at""")
def j10_active_version(spark, sf_dir):
    return op.as_of(v.jobs(spark, sf_dir), v.model_pins(spark, sf_dir))


VERSIONS = "v AS (SELECT project_id, version, min(ts) AS ts, min(ts) FILTER (file IN ('meta.json', 'index.json') OR file LIKE '%.joblib') AS model_ts FROM model_files GROUP BY ALL)"


@query(f"""WITH {VERSIONS}, p AS (SELECT m.project_id, updated_at, max({{'version': m.version, 'there': v.version IS NOT NULL}}) AS pin FROM model_pins m LEFT JOIN v ON m.project_id = v.project_id AND m.version = v.version GROUP BY ALL),
    a AS (SELECT j.job_id, j.project_id, j.ts, p.pin FROM jobs j ASOF LEFT JOIN p ON j.project_id = p.project_id AND j.ts >= p.updated_at),
    n AS (SELECT a.job_id, max(v.version) AS newest FROM a JOIN v ON a.project_id = v.project_id AND v.model_ts <= a.ts WHERE a.pin IS NULL GROUP BY a.job_id)
    SELECT a.job_id, a.project_id, coalesce(CASE WHEN pin IS NULL THEN newest WHEN pin.there THEN pin.version END, 'none') AS version FROM a LEFT JOIN n USING (job_id)""")
def j10_t3_active_model(spark, sf_dir):
    """Pinned versions, or the newest one with a model file where nothing is pinned yet."""
    return op.active_version(v.jobs(spark, sf_dir), v.model_pins(spark, sf_dir), v.model_files(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT project_id, max(version) AS version FROM v WHERE model_ts IS NOT NULL GROUP BY project_id")
def t3_latest_model(spark, sf_dir):
    return op.latest_version(v.model_files(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, 'p' || (user_id % 8) AS project_id, value, event_type, props FROM events),
    t AS (SELECT project_id, 'wait_file' AS step, round(value / 7, 2) AS ms FROM e UNION ALL SELECT project_id, 'total', round(value * 2, 2) FROM e UNION ALL SELECT project_id, 'infer', value FROM e
        UNION ALL SELECT project_id, 'post', CASE WHEN event_id % 3 = 0 THEN value / 3 ELSE 0 END FROM e UNION ALL SELECT project_id, unnest(['save', 'read']), 0.0 FROM e
        UNION ALL SELECT project_id, k, round(CAST(json_extract(props, '$.' || k) AS DOUBLE), 2) FROM (SELECT *, unnest(json_keys(props)) AS k FROM e)
        UNION ALL SELECT project_id, 'stage_' || event_type, round(value / 5, 2) FROM e UNION ALL SELECT project_id, 'only_' || event_id, round(value, 2) FROM e WHERE event_id % 97 = 0)
    SELECT project_id, step, round(avg(ms), 4) AS mean_ms, count(*) AS n FROM t WHERE ms IS NOT NULL GROUP BY ALL""")
def a26_timing_maps(spark, sf_dir):
    """Steps with any keys, some of them in one row only."""
    e = v.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("p"), F.col("user_id") % 8).alias("project_id"), "event_type", "value", "props")
    own = F.map_from_arrays(
        F.array(F.lit("infer"), F.lit("post"), F.concat(F.lit("stage_"), "event_type"), F.concat(F.lit("only_"), "event_id")),
        F.array(F.col("value"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 3), F.col("value") / 5, F.when(F.col("event_id") % 97 == 0, F.col("value"))),
    )
    merged = op.merged_timing(F.map_concat(own, op.timing_of_json(F.col("props"))), F.col("value") / 7, F.col("value") * 2)
    return op.timing_means(e.select("project_id", merged.alias("timing")), "timing").withColumn("mean_ms", F.round("mean_ms", 4))


@query("""SELECT j.job_id, j.project_id, coalesce(p.enabled, false) AS enabled, coalesce(nullif(p.thr_global, 0), 120.0) AS thr,
    CASE WHEN j.infer_ms > coalesce(nullif(p.thr_global, 0), 120.0) THEN 'NG' ELSE 'OK' END AS decision FROM jobs j LEFT JOIN projects p USING (project_id)""")
def j11_p8_p9_project_threshold(spark, sf_dir):
    thr = op.threshold(F.lit(None).cast("double"), F.col("thr_global"), F.lit(120.0))
    joined = v.jobs(spark, sf_dir).join(v.projects(spark, sf_dir), "project_id", "left").withColumn("thr", thr)
    return joined.select("job_id", "project_id", F.coalesce("enabled", F.lit(False)).alias("enabled"), "thr", F.when(F.col("infer_ms") > F.col("thr"), "NG").otherwise("OK").alias("decision"))


@query("SELECT job_id, CASE WHEN infer_ms >= 180 THEN 'NG' WHEN infer_ms >= 90 THEN 'WARN' ELSE 'OK' END AS level FROM jobs")
def p13_three_levels(spark, sf_dir):
    return v.jobs(spark, sf_dir).select("job_id", op.three_levels(F.col("infer_ms"), 90, 180).alias("level"))


REQUESTS = """WITH f AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS text FROM requests), g AS (SELECT *, CASE WHEN text LIKE '"%' THEN '{' || rtrim(text, '}') || '}' ELSE text END AS fixed FROM f),
    j AS (SELECT *, CASE WHEN json_valid(fixed) THEN fixed WHEN json_valid(line) THEN line END AS good FROM g), o AS (SELECT *, CASE WHEN json_type(good) = 'OBJECT' THEN good END AS obj FROM j),
    q AS (SELECT request_id, n, client, obj IS NOT NULL AS valid, json_extract_string(obj, '$.cmd') AS cmd, json_extract_string(obj, '$.job_id') AS job_id, json_extract_string(obj, '$.image_path') AS image_path FROM o)"""


def parsed_requests(spark, sf_dir):
    return v.requests(spark, sf_dir).select("request_id", "client", "n", op.parsed_request(F.col("line")).alias("r")).select("request_id", "client", "n", "r.cmd", "r.job_id", "r.image_path")


@query(REQUESTS + " SELECT request_id, cmd, job_id, image_path FROM q")
def m4_repaired_requests(spark, sf_dir):
    return parsed_requests(spark, sf_dir).select("request_id", "cmd", "job_id", "image_path")


CODES = """SELECT request_id, client, CASE WHEN upper(coalesce(cmd, '')) NOT IN ('PING', 'INFER', 'STATUS', 'SET_ACTIVE_MODEL') THEN 'INVALID_CMD' WHEN upper(cmd) <> 'INFER' THEN 'OK' WHEN job_id = '' OR image_path = '' THEN 'INVALID_CMD'
    WHEN p.project_id IS NULL THEN 'PROJECT_NOT_FOUND' WHEN NOT enabled THEN 'PROJECT_DISABLED' WHEN n = 3 THEN 'MODEL_NOT_LOADED' ELSE 'OK' END AS code, upper(cmd) AS cmd, job_id FROM q LEFT JOIN projects p ON p.project_id = 'p' || n"""


def checked_requests(requests, projects):
    """Parsed requests with the code of the first check that they fail."""
    r = requests.withColumn("project_id", F.concat(F.lit("p"), "n")).join(projects.withColumn("known", F.lit(True)), "project_id", "left")
    known = F.coalesce("known", F.lit(False))
    return r.withColumn("code", op.request_code(known, F.coalesce("enabled", F.lit(False)), F.col("n") != 3, F.col("job_id"), F.col("cmd"), F.col("image_path")))


@query(REQUESTS + f" SELECT request_id, code FROM ({CODES})")
def p15_request_codes(spark, sf_dir):
    return checked_requests(parsed_requests(spark, sf_dir), v.projects(spark, sf_dir)).select("request_id", "code")


@query(REQUESTS + """ SELECT client, count(*) AS requests, count(*) FILTER (cmd IS NULL) AS broken, count(*) FILTER (upper(cmd) = 'INFER') AS infers FROM q GROUP BY client""")
def r8_request_summary(spark, sf_dir):
    infer = F.upper("cmd") == "INFER"
    return parsed_requests(spark, sf_dir).groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("cmd").isNull()).alias("broken"), F.count_if(infer).alias("infers"))


@query("""SELECT project_id, date_trunc('minute', ts) AS minute, count(*) AS jobs, round(avg(CASE WHEN pred = 'OK' THEN 1.0 ELSE 0.0 END), 6) AS yield, round(avg(infer_ms), 4) AS mean_ms FROM jobs GROUP BY ALL""")
def r5_minute_monitor(spark, sf_dir):
    g = v.jobs(spark, sf_dir).groupBy("project_id", F.window("ts", "1 minute").alias("w"))
    out = g.agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg((F.col("pred") == "OK").cast("double")), 6).alias("yield"), F.round(F.avg("infer_ms"), 4).alias("mean_ms"))
    return out.select("project_id", F.col("w.start").alias("minute"), "jobs", "yield", "mean_ms")


@query("""SELECT project_id, CASE WHEN infer_ms > 200 THEN 'timeout' WHEN pred = 'ERROR' THEN 'failed' ELSE 'completed' END AS status, count(*) AS n FROM jobs GROUP BY ALL""")
def r9_job_status(spark, sf_dir):
    return v.jobs(spark, sf_dir).groupBy("project_id", op.job_status(F.col("pred"), F.col("infer_ms"), 200).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT project_id, job_id, epoch_us(ts) AS t, 1 AS step FROM jobs UNION ALL SELECT project_id, job_id, epoch_us(ts) + CAST(round(infer_ms * 1000000) AS BIGINT), -1 FROM jobs),
    p AS (SELECT *, sum(step) OVER (PARTITION BY project_id ORDER BY t, step, job_id ROWS UNBOUNDED PRECEDING) AS pending FROM s)
    SELECT project_id, count(*) AS starts, CAST(max(pending) AS BIGINT) AS most, count(*) FILTER (pending > 2) AS full_starts FROM p WHERE step = 1 GROUP BY project_id""")
def r9_backlog(spark, sf_dir):
    return op.backlog(v.jobs(spark, sf_dir), 2).groupBy("project_id").agg(F.count(F.lit(1)).alias("starts"), F.max("pending").alias("most"), F.count_if("full").alias("full_starts"))


@query("SELECT job_id, project_id, ts, pred FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, job_id DESC) AS n FROM jobs) WHERE n <= 100")
def w20_log_tail(spark, sf_dir):
    return op.log_tail(v.jobs(spark, sf_dir), 100).select("job_id", "project_id", "ts", "pred")


@query("""WITH a AS (SELECT *, coalesce(size > 0 AND size = lag(size) OVER w, false) AS same FROM polls WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS island FROM a),
    c AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY path, island ORDER BY ts, event_id) AS run FROM b)
    SELECT path, min(ts) AS ready_at FROM c WHERE run >= 2 GROUP BY path""")
def w21_stable_files(spark, sf_dir):
    return op.stable_files(v.polls(spark, sf_dir), 2)


@query("""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY path) AS first FROM polls), p AS (SELECT * FROM f WHERE ts - first < INTERVAL 10 DAY), a AS (SELECT *, coalesce(size > 0 AND size = lag(size) OVER w, false) AS same FROM p WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS island FROM a), c AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY path, island ORDER BY ts, event_id) AS run FROM b)
    SELECT path, min(ts) AS ready_at FROM c WHERE run >= 2 GROUP BY path""")
def w21_ready_in_time(spark, sf_dir):
    return op.stable_files(v.polls(spark, sf_dir), 2, 10 * 86_400)


@query("SELECT job_id, project_id, ts, pred, n - 1 AS index, total AS next_index FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, job_id) AS n, count(*) OVER (PARTITION BY project_id) AS total FROM jobs) WHERE n > 40")
def w20_entries_since(spark, sf_dir):
    return op.entries_since(v.jobs(spark, sf_dir), 40).select("job_id", "project_id", "ts", "pred", "index", "next_index")


@query("SELECT project_id, max(version) AS version FROM model_pins GROUP BY project_id")
def t3_latest_version(spark, sf_dir):
    return v.model_pins(spark, sf_dir).groupBy("project_id").agg(F.max("version").alias("version"))


@query("""SELECT a.stem, a.ts AS image_ts, b.ts AS json_ts FROM arrivals a JOIN arrivals b ON a.stem = b.stem AND a.kind = 'image' AND b.kind = 'json'
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 240000000""")
def r1_pairs(spark, sf_dir):
    a = v.arrivals(spark, sf_dir)
    i = a.where("kind = 'image'").select("stem", F.col("ts").alias("image_ts"))
    j = a.where("kind = 'json'").select("stem", F.col("ts").alias("json_ts"))
    return i.join(j, "stem").where(F.abs(F.unix_micros("image_ts") - F.unix_micros("json_ts")) <= 240_000_000)


@query("""SELECT a.stem, a.ts FROM arrivals a LEFT JOIN arrivals b ON a.stem = b.stem AND b.kind = 'json' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 240000000
    WHERE a.kind = 'image' AND b.stem IS NULL""")
def r2_timeouts(spark, sf_dir):
    a = v.arrivals(spark, sf_dir)
    i = a.where("kind = 'image'").select("stem", "ts")
    j = a.where("kind = 'json'").select(F.col("stem").alias("s"), F.col("ts").alias("t"))
    near = (i.stem == j.s) & (F.abs(F.unix_micros("ts") - F.unix_micros("t")) <= 240_000_000)
    return i.join(j, near, "left_anti")


@query("SELECT stem % 500 AS stem, kind, max(ts) AS ts FROM arrivals GROUP BY ALL")
def r3_last_arrival(spark, sf_dir):
    return v.arrivals(spark, sf_dir).groupBy((F.col("stem") % 500).alias("stem"), "kind").agg(F.max("ts").alias("ts"))


@query("""WITH o AS (SELECT stem, pred, ts FROM (SELECT job_id // 4 AS stem, pred, ts, job_id FROM jobs)),
    t AS (SELECT job_id // 4 AS stem, pred, date, row_number() OVER (PARTITION BY job_id // 4 ORDER BY ts, job_id) AS attempt FROM jobs),
    k AS (SELECT * FROM t WHERE attempt <= 3), d AS (SELECT stem, min(CASE WHEN pred = 'OK' THEN attempt END) AS won, CAST(max(attempt) AS BIGINT) AS tried FROM k GROUP BY stem)
    SELECT stem, coalesce(won, tried) AS attempts, CASE WHEN won IS NOT NULL THEN 'archive' ELSE 'error' END AS goes_to FROM d""")
def r7_retries(spark, sf_dir):
    order = Window.partitionBy("stem").orderBy("ts", "job_id")
    tries = v.jobs(spark, sf_dir).withColumn("stem", F.floor(F.col("job_id") / 4)).withColumn("attempt", F.row_number().over(order)).where("attempt <= 3")
    done = tries.groupBy("stem").agg(F.min(F.when(F.col("pred") == "OK", F.col("attempt"))).alias("won"), F.max("attempt").alias("tried"))
    return done.select("stem", F.coalesce("won", "tried").cast("long").alias("attempts"), F.when(F.col("won").isNotNull(), "archive").otherwise("error").alias("goes_to"))


@query("SELECT job_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d_%H%M%S') AS version, '[' || strftime(ts, '%H:%M:%S') || '] [' || CAST(job_id % 101 AS VARCHAR) || '%] ' || pred AS line FROM jobs")
def m8_dates(spark, sf_dir):
    line = F.format_string("[%s] [%d%%] %s", F.date_format("ts", "HH:mm:ss"), F.col("job_id") % 101, F.col("pred"))
    return v.jobs(spark, sf_dir).select("job_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("version"), line.alias("line"))


@query("""SELECT job_id, '{"job_id":"' || job_id || '","pred":"' || pred || '","ok":' || CASE WHEN pred = 'OK' THEN 'true' ELSE 'false' END || ',"k":' || CAST(CAST(k AS BIGINT) AS VARCHAR) || '}' AS response FROM jobs WHERE k IS NOT NULL""")
def m6_slim_response(spark, sf_dir):
    body = F.to_json(F.struct(F.col("job_id").cast("string").alias("job_id"), "pred", (F.col("pred") == "OK").alias("ok"), F.col("k").cast("long").alias("k")))
    return v.jobs(spark, sf_dir).where("k IS NOT NULL").select("job_id", body.alias("response"))


@query("SELECT job_id, round(infer_ms, 2) AS infer, CASE WHEN k IS NULL THEN 0 ELSE 1 END AS n_detail, round(k, 2) AS k FROM jobs")
def m7_split_timing(spark, sf_dir):
    timing = F.map_filter(F.create_map(F.lit("infer"), F.col("infer_ms"), F.lit("k"), F.col("k")), lambda _, x: x.isNotNull())
    known = F.array(F.lit("infer"), F.lit("total"))
    detail = F.transform_values(F.map_filter("timing", lambda k, _: ~F.array_contains(known, k)), lambda _, x: F.round(x, 2))
    return v.jobs(spark, sf_dir).withColumn("timing", timing).withColumn("detail", detail).select("job_id", F.round(F.col("timing")["infer"], 2).alias("infer"), F.size("detail").alias("n_detail"), F.col("detail")["k"].alias("k"))
