"""Streaming queries over the event table, drained to a table, and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectra.plans import views as v
from inspectra.plans.registry import query
from inspectra.sources import files
from inspectra.sources.folders import shared_path
from inspectra.operators import geometry, joblog
from inspectra.plans import joblog as requests
from inspectra.streaming import service
from inspectra.streaming import streams as op


def job_stream(spark, sf_dir):
    e = op.read_table(spark, f"{sf_dir}/events.parquet")
    pred = F.when(F.col("event_type") == "signup", "NG").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").otherwise("OK")
    return e.select(F.col("event_id").alias("job_id"), F.concat(F.lit("p"), F.col("user_id") % 8).alias("project_id"), "user_id", pred.alias("pred"), F.col("value").alias("infer_ms"), F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH w AS (SELECT date_trunc('minute', ts) AS start, project_id, count(*) AS jobs, round(avg(CASE WHEN pred = 'OK' THEN 1.0 ELSE 0.0 END), 6) AS yield, round(avg(infer_ms), 4) AS mean_ms FROM jobs GROUP BY ALL)
    SELECT * FROM w WHERE start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM jobs) - INTERVAL 10 MINUTE""")
def r5_monitor_stream(spark, sf_dir):
    return op.drain(op.minute_monitor(job_stream(spark, sf_dir)), "monitor").select("start", "project_id", "jobs", F.round("yield", 6).alias("yield"), F.round("mean_ms", 4).alias("mean_ms"))


@query("""WITH a AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id FROM events), b AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM b), d AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS requests FROM c GROUP BY user_id, s)
    SELECT * FROM d WHERE "end" <= (SELECT max(ts) FROM a) - INTERVAL 10 MINUTE""")
def r6_session_stream(spark, sf_dir):
    return op.drain(op.sessions(job_stream(spark, sf_dir).select("user_id", "ts"), "user_id", "6 hours"), "sessions")


@query("""SELECT project_id, count(*) AS total, count(*) FILTER (pred = 'OK') AS ok, count(*) FILTER (pred = 'NG') AS ng, count(*) FILTER (pred NOT IN ('OK', 'NG')) AS error, max(ts) AS last_ts,
    round(sum(pow(0.9, age) * (CASE WHEN age = n - 1 THEN 1.0 ELSE 0.1 END) * infer_ms), 4) AS avg_ms FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, job_id DESC) - 1 AS age, count(*) OVER (PARTITION BY project_id) AS n FROM jobs) GROUP BY project_id""")
def r4_live_stats_stream(spark, sf_dir):
    live = op.drain(op.live_stats(job_stream(spark, sf_dir)), "live-stats", "update")
    return live.groupBy("project_id").agg(F.max_by(F.struct(*[c for c in live.columns if c not in ("project_id", "epoch")]), "epoch").alias("s")).select("project_id", "s.total", "s.ok", "s.ng", "s.error", "s.last_ts", F.round("s.avg_ms", 4).alias("avg_ms"))


@query("""SELECT a.stem, a.ts AS image_ts, b.ts AS json_ts FROM arrivals a JOIN arrivals b ON a.stem = b.stem AND a.kind = 'image' AND b.kind = 'json' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 240000000""")
def r1_pair_stream(spark, sf_dir):
    e = lambda: op.read_table(spark, f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 2).alias("stem"), (F.col("event_id") % 2 == 0).alias("image"), F.col("ts").cast("timestamp").alias("ts"))
    return op.drain(op.pairs(e().where("image"), e().where("NOT image"), "240 seconds", outer=False), "pairs")


WAIT_US = 12 * 3_600_000_000


def file_arrivals(spark, sf_dir):
    """A user's events as arrivals of one stem: images, annotations, and attempts at
    what they make, of which views succeed."""
    e = op.read_table(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "signup", "json").otherwise("attempt")
    return e.select(F.col("user_id").alias("stem"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("ok"))


def _pending_sql() -> str:
    """One arrival (e) after the other on the state so far (a): i and j the pending
    files' times, w whether a pair is worked on (of an arrival: whether it
    succeeds), n its failures, o the outcomes."""
    kind = "STRUCT(event VARCHAR, ts BIGINT, image BIGINT, json BIGINT, attempts BIGINT)[]"
    dead = {c: f"(a.{c} IS NOT NULL AND e.t - a.{c} >= {WAIT_US})" for c in "ij"}
    now = {c: f"(CASE WHEN e.k = '{k}' THEN e.t WHEN NOT {dead[c]} THEN a.{c} END)" for c, k in (("i", "image"), ("j", "json"))}
    paired, tried = f"({now['i']} IS NOT NULL AND {now['j']} IS NOT NULL)", "(e.k = 'attempt' AND a.w)"
    failures = f"(a.n + CASE WHEN {tried} AND NOT e.w THEN 1 ELSE 0 END)"
    done = f"({tried} AND (e.w OR {failures} > 2))"
    one = lambda when, event, ts, image, json, attempts="0": f"CASE WHEN {when} THEN [{{'event': {event}, 'ts': {ts}, 'image': {image}, 'json': {json}, 'attempts': CAST({attempts} AS BIGINT)}}]::{kind} ELSE []::{kind} END"
    outcomes = [
        one(dead["i"], "'timeout'", f"a.i + {WAIT_US}", "a.i", "NULL"), one(dead["j"], "'timeout'", f"a.j + {WAIT_US}", "NULL", "a.j"),
        one(done, "CASE WHEN e.w THEN 'archive' ELSE 'error' END", "e.t", "NULL", "NULL", f"{failures} + CASE WHEN e.w THEN 1 ELSE 0 END"), one(paired, "'pair'", "e.t", now["i"], now["j"]),
    ]
    state = lambda i, j, w, n, k, t, o: f"{{'i': CAST({i} AS BIGINT), 'j': CAST({j} AS BIGINT), 'w': {w}, 'n': CAST({n} AS BIGINT), 'k': {k}, 't': CAST({t} AS BIGINT), 'o': {o}}}"
    begin, arrival = state("NULL", "NULL", "false", 0, "''", 0, f"[]::{kind}"), state("NULL", "NULL", "ok", 0, "kind", "t", f"[]::{kind}")
    then = state(f"CASE WHEN NOT {paired} THEN {now['i']} END", f"CASE WHEN NOT {paired} THEN {now['j']} END", f"({paired} OR (a.w AND NOT {done}))", f"CASE WHEN {paired} OR {done} THEN 0 ELSE {failures} END", "''", 0, f"list_concat(a.o, {outcomes[0]}, {outcomes[1]}, {outcomes[2]}, {outcomes[3]})")
    left = lambda c, image, json: one(f"s.{c} IS NOT NULL AND (s.{c} + {WAIT_US} + 999) // 1000 <= last // 1000", "'timeout'", f"s.{c} + {WAIT_US}", image, json)
    return f"""WITH e AS (SELECT user_id AS stem, CASE event_type WHEN 'click' THEN 'image' WHEN 'signup' THEN 'json' ELSE 'attempt' END AS kind, epoch_us(CAST(ts AS TIMESTAMP)) AS t, event_type = 'view' AS ok FROM events),
        l AS (SELECT stem, list({arrival} ORDER BY t, kind) AS l FROM e GROUP BY stem), f AS (SELECT stem, list_reduce(list_prepend({begin}, l), lambda a, e: {then}) AS s, (SELECT max(t) FROM e) AS last FROM l),
        o AS (SELECT stem, unnest(list_concat(s.o, {left('i', 's.i', 'NULL')}, {left('j', 'NULL', 's.j')})) AS o FROM f)
        SELECT stem, o.event AS event, make_timestamp(o.ts) AS ts, make_timestamp(o.image) AS image_ts, make_timestamp(o.json) AS json_ts, CAST(o.attempts AS INTEGER) AS attempts, CAST(make_timestamp(o.ts) AS DATE) AS day,
            CASE WHEN o.event IN ('timeout', 'error') THEN 'error' ELSE 'archive' END AS sink FROM o"""


@query(_pending_sql())
def r2_r3_r7_pending_stream(spark, sf_dir):
    """Pairs, timeouts, and what became of the pairs' attempts, from one stateful stream with two sinks."""
    work = service.pending_files(file_arrivals(spark, sf_dir), WAIT_US / 1e6)
    bad = F.col("event").isin("timeout", "error")
    found = service.sink(work, "pending", {"archive": ~bad, "error": bad}, F.to_date("ts"))
    both = found["archive"].withColumn("sink", F.lit("archive")).unionByName(found["error"].withColumn("sink", F.lit("error")))
    return both.select("stem", "event", "ts", "image_ts", "json_ts", "attempts", "day", "sink")


@query(requests.REQUESTS + f", l AS (SELECT request_id, line, n FROM requests) SELECT c.line, 'p' || n AS project_id, DATE '2024-01-01' + CAST(c.client % 7 AS INTEGER) AS day, code, c.cmd, c.job_id FROM (SELECT * FROM ({requests.CODES}) JOIN l USING (request_id)) c")
def r8_s14_request_stream(spark, sf_dir):
    """Request lines from a drop folder by project and day, parsed, checked against
    the projects, and logged by day."""
    folder = shared_path(spark, "drop")
    r = v.requests(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("client") % 7).cast("int"))
    r.select(F.col("line").alias("value"), F.col("n").alias("n"), day.alias("day")).write.partitionBy("n", "day").text(folder)
    lines = service.read_drop_folder(spark, folder, "n long, day date")
    parsed = lines.select("line", "n", "day", joblog.parsed_request(F.col("line")).alias("r")).select("line", "n", "day", "r.cmd", "r.job_id", "r.image_path")
    checked = requests.checked_requests(parsed, v.projects(spark, sf_dir)).select("line", "project_id", "code", F.upper("cmd").alias("cmd"), "job_id", F.col("day").alias("_on"))
    log = service.sink(checked, "requests", {"log": F.lit(True)}, F.col("_on"))["log"]
    return log.select("line", "project_id", "day", "code", "cmd", "job_id")


@query("SELECT CAST(job_id AS VARCHAR) AS job_id, project_id, pred, round(infer_ms, 3) AS score, date FROM jobs")
def s6_log_round_trip(spark, sf_dir):
    folder = shared_path(spark, "job-log")
    files.append_log(v.jobs(spark, sf_dir).select(F.col("job_id").cast("string").alias("job_id"), "project_id", "pred", F.col("infer_ms").alias("score"), "date"), folder)
    return files.read_log(spark, folder).select("job_id", "project_id", "pred", F.round("score", 3).alias("score"), "date")


@query("SELECT cls, bank_id FROM bank WHERE cls % 3 <> 0")
def s8_model_round_trip(spark, sf_dir):
    folder = shared_path(spark, "models")
    bank = v.bank(spark, sf_dir)
    models = bank.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).withColumn("algo_method", F.when(F.col("cls") % 3 == 0, "structural").otherwise("patch"))
    files.write_models(models, bank, folder)
    return files.read_models(spark, folder, "patch")[1].select("cls", "bank_id")


@query("SELECT vec_id AS sample_id, CASE WHEN embedding[1] > 0 THEN 'OK' ELSE 'NG' END AS result, round(abs(CAST(embedding[1] AS DOUBLE)), 4) AS prob_ok FROM embeddings")
def s12_result_text(spark, sf_dir):
    first = F.element_at("embedding", 1).cast("double")
    text = files.result_text(F.when(first > 0, "OK").otherwise("NG"), F.abs(first))
    m = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), files.parsed_result_text(text).alias("m"))
    return m.select("sample_id", F.col("m")["result"].alias("result"), F.col("m")["prob_OK"].cast("double").alias("prob_ok"))


@query("SELECT image_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx, min(ch) AS first_ch, max(ch) AS last_ch, count(DISTINCT ch) AS kinds, sum(cx) AS cx FROM glyph_items GROUP BY image_id")
def s7_csv_round_trip(spark, sf_dir):
    folder = shared_path(spark, "details")
    files.write_csv(v.glyph_items(spark, sf_dir).select("image_id", "idx", F.base64(F.col("ch").cast("binary")).alias("ch"), "cx"), folder, "gzip")
    read = files.read_csv(spark, folder, "image_id long, idx int, ch string, cx double").withColumn("ch", F.unbase64("ch").cast("string"))
    return geometry.character_totals(read, "image_id", ["idx", "cx"])


@query("SELECT pred, count(*) AS n FROM jobs GROUP BY pred")
def s13_sorted_folders(spark, sf_dir):
    folder = shared_path(spark, "sorted")
    v.jobs(spark, sf_dir).select("job_id", "pred").write.partitionBy("pred").parquet(folder)
    return spark.read.schema("job_id long, pred string").parquet(folder).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(cls AS VARCHAR) AS cls, count(*) AS n FROM bank GROUP BY ALL")
def s9_s10_report_and_suspects(spark, sf_dir):
    folder = shared_path(spark, "suspects")
    rows = v.bank(spark, sf_dir).select("cls", F.element_at("emb", 1).cast("double").alias("score"), F.lit("train").alias("split"), F.concat("bank_id", F.lit(".png")).alias("path"))
    files.write_suspects(rows, folder)
    read = spark.read.schema("value string, cls string").text(folder)
    return read.where(F.size(F.split("value", "\t")) == 3).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(job_id AS VARCHAR) AS job_id, project_id, pred = 'OK' AS ok, pred, round(infer_ms, 3) AS score, round(infer_ms, 2) AS infer, round(infer_ms * 2, 2) AS total, round(k, 2) AS detail_k, CASE WHEN pred = 'NG' THEN 1 ELSE 0 END AS n_regions, CASE WHEN pred = 'NG' THEN job_id % 50 END AS x,
    CASE WHEN pred = 'ERROR' THEN 'INFER_FAILED' END AS error_code, date FROM jobs""")
def s6_nested_log(spark, sf_dir):
    """Log lines with timings, regions and errors nested, written by day and read back."""
    folder = shared_path(spark, "nested-log")
    j = v.jobs(spark, sf_dir)
    pred, ms = F.col("pred"), F.col("infer_ms")
    timing = F.struct(F.round(ms, 2).alias("infer"), F.round(ms * 2, 2).alias("total"), F.map_filter(F.create_map(F.lit("k"), F.round("k", 2)), lambda k, x: x.isNotNull()).alias("detail"))
    region = F.struct((F.col("job_id") % 50).cast("int").alias("x"), F.lit(1).alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h"), ms.alias("score"), F.lit(12).alias("area_px"))
    error = F.when(pred == "ERROR", F.struct(F.lit("INFER_FAILED").alias("code"), pred.alias("message")))
    rows = j.select(F.col("job_id").cast("string").alias("job_id"), "project_id", (pred == "OK").alias("ok"), "pred", ms.alias("score"), timing.alias("timing_ms"), F.when(pred == "NG", F.array(region)).otherwise(F.array()).alias("regions"), error.alias("error"), "date")
    files.append_log(rows, folder)
    r = files.read_log(spark, folder)
    return r.select(
        "job_id", "project_id", "ok", "pred", F.round("score", 3).alias("score"), F.col("timing_ms.infer").alias("infer"), F.col("timing_ms.total").alias("total"), F.try_element_at("timing_ms.detail", F.lit("k")).alias("detail_k"),
        F.size("regions").alias("n_regions"), F.get("regions", F.lit(0))["x"].cast("long").alias("x"), F.col("error.code").alias("error_code"), "date",
    )


@query("SELECT CAST(cls AS VARCHAR) AS cls, round(CAST(emb[1] AS DOUBLE), 6) AS score, CASE WHEN bank_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, bank_id || '.png' AS path FROM bank")
def s10_suspect_lists(spark, sf_dir):
    """Every line of the lists, read back into its fields."""
    folder = shared_path(spark, "suspect-lists")
    split = F.when(F.col("bank_id") % 5 == 0, "val").otherwise("train")
    files.write_suspects(v.bank(spark, sf_dir).select("cls", F.element_at("emb", 1).cast("double").alias("score"), split.alias("split"), F.concat("bank_id", F.lit(".png")).alias("path")), folder)
    return files.read_suspects(spark, folder)


@query("SELECT job_id, pred FROM jobs")
def s13_sorted_results(spark, sf_dir):
    """Results by verdict folder; each comes back from the folder of its verdict."""
    folder = shared_path(spark, "sorted-results")
    v.jobs(spark, sf_dir).select("job_id", "pred").write.partitionBy("pred").parquet(folder)
    return spark.read.schema("job_id long, pred string").parquet(folder)


@query("SELECT image_id || '.png' AS image, count(*) AS total, count(*) FILTER (idx % 13 = 0) AS ng, count(*) FILTER (idx % 29 = 1) AS unknown FROM glyph_items GROUP BY image_id")
def s7_summary_csv(spark, sf_dir):
    """A row per image: regions, faults and regions of unknown class."""
    folder = shared_path(spark, "summary")
    i = v.glyph_items(spark, sf_dir)
    files.write_csv(i.groupBy(F.concat("image_id", F.lit(".png")).alias("image")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("idx") % 13 == 0).alias("ng"), F.count_if(F.col("idx") % 29 == 1).alias("unknown")), folder)
    return spark.read.option("header", True).schema("image string, total long, ng long, unknown long").csv(folder)


@query("WITH n AS (SELECT cls, count(*) AS n FROM bank GROUP BY cls) SELECT CAST(cls AS INTEGER) AS cls, CASE WHEN cls % 3 = 0 THEN 'structural' ELSE 'patch' END AS algo_method, 3 AS k, CASE WHEN cls % 2 = 0 THEN 'topk' ELSE 'max' END AS score_mode, round(0.5 + n / 1000, 6) AS thr, n FROM n WHERE cls % 3 <> 0")
def s8_model_parameters(spark, sf_dir):
    """A class model's threshold, neighbours and mode beside its bank."""
    folder = shared_path(spark, "model-parameters")
    bank = v.bank(spark, sf_dir)
    models = bank.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "algo_method": F.when(F.col("cls") % 3 == 0, "structural").otherwise("patch"), "k": F.lit(3), "score_mode": F.when(F.col("cls") % 2 == 0, "topk").otherwise("max"), "thr": F.round(0.5 + F.col("n") / 1000, 6),
    })
    files.write_models(models, bank, folder)
    read, rows = files.read_models(spark, folder, "patch")
    counts = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("rows"))
    return read.join(counts, "cls").where(F.col("n") == F.col("rows")).select("cls", "algo_method", "k", "score_mode", "thr", "n")
