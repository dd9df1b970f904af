"""Pending files, their timers and attempts, and sinks that repeat a batch."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from inspectra.operators import joblog
from inspectra.streaming import service

T0 = dt.datetime(2024, 5, 1, 12)
S = 1_000_000


def test_a_later_file_replaces_the_pending_one():
    state, out = (None, None, False, 0), []
    for kind, s in (("image", 0), ("image", 5), ("json", 14), ("json", 20), ("image", 40)):
        state, more = service.step(state, kind, s * S, False, 12 * S, 2)
        out += more
    assert out == [("pair", 14 * S, 5 * S, 14 * S, 0), ("timeout", 32 * S, None, 20 * S, 0)]
    assert state == (40 * S, None, True, 0)


def test_attempts_end_with_the_first_success_or_the_third_failure():
    def run(*oks):
        state, out = (None, None, True, 0), []
        for k, ok in enumerate(oks):
            state, more = service.step(state, "attempt", k, ok, 12 * S, 2)
            out += more
        return state, [(event, at, attempts) for event, at, _, _, attempts in out]

    idle = (None, None, False, 0)
    assert run(False, False, True) == (idle, [("archive", 2, 3)])
    assert run(False, False, False, True) == (idle, [("error", 2, 3)])  # what comes after has no pair
    assert run(False) == ((None, None, True, 1), [])


def arrivals(spark, folder):
    rows = spark.readStream.schema("stem long, kind string, at int, ok boolean").option("maxFilesPerTrigger", 1).json(folder)
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(T0.timestamp()) + F.col("at")))


def test_timers_fire_between_batches(spark, tmp_path):
    """Each file is a batch: pairs, a timeout by timer, one that came again in time, attempts."""
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [
        [(1, "image", 0), (2, "image", 0), (3, "json", 0)],
        [(1, "json", 8), (2, "image", 9), (9, "image", 9)],
        [(2, "json", 20), (1, "attempt", 21), (1, "attempt", 22), (1, "attempt", 23), (2, "attempt", 24, True), (9, "image", 100)],
    ]
    for k, rows in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("".join(json.dumps({"stem": r[0], "kind": r[1], "at": r[2], "ok": len(r) > 3}) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    found = service.sink(service.pending_files(arrivals(spark, str(folder))), "pending", {"ok": F.col("event").isin("pair", "archive"), "bad": F.col("event").isin("timeout", "error")}, F.to_date("ts"))
    zero = T0.timestamp()
    got = {name: sorted((r.stem, r.event, round(r.s - zero), r.attempts) for r in df.withColumn("s", F.unix_micros("ts") / 1e6).collect()) for name, df in found.items()}
    assert got["ok"] == [(1, "pair", 8, 0), (2, "archive", 24, 1), (2, "pair", 20, 0)]
    assert got["bad"] == [(1, "error", 23, 3), (3, "timeout", 12, 0), (9, "timeout", 21, 0)]
    assert {str(r.day) for r in found["bad"].collect()} == {"2024-05-01"}


def test_a_repeated_batch_writes_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=1)), (3, T0)], "k long, ts timestamp")
    write = service.batch_writer(str(tmp_path), {"odd": F.col("k") % 2 == 1, "even": F.col("k") % 2 == 0}, F.to_date("ts"))
    for _ in range(3):
        write(rows, 0)
    write(rows.withColumn("k", F.col("k") + 10), 1)
    assert sorted(r.k for r in service.read_route(spark, rows, f"{tmp_path}/odd").collect()) == [1, 3, 11, 13]
    assert sorted((r.k, str(r.day)) for r in service.read_route(spark, rows, f"{tmp_path}/even").collect()) == [(2, "2024-05-02"), (12, "2024-05-02")]


def test_requests_are_repaired(spark):
    lines = {
        '{"cmd":"infer","job_id":"1","image_path":"a"}': "infer", '  "cmd":"PING"}}\t': "PING", '"cmd":"x"': "x", "[1]": None, "": None, "null": None,
        "7": None, '"text"': None, "{broken": None, '{"cmd":null}': None, None: None, '{"cmd":"STATUS","options":{"a":"b"}} ': "STATUS",
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", joblog.parsed_request(F.col("line")).alias("r"))
    assert {r.line: r.r and r.r.cmd for r in df.collect()} == lines
    code = lambda cmd, job="1", path="p", known=True, enabled=True, loaded=True: joblog.request_code(*map(F.lit, (known, enabled, loaded, job, cmd, path)))
    cases = {
        "OK": [code("Infer"), code("ping", None), code("STATUS", ""), code("set_active_model", None, None, False)], "INVALID_CMD": [code("stop"), code(None), code("infer", ""), code("INFER", "1", None)],
        "PROJECT_NOT_FOUND": [code("infer", known=False)], "PROJECT_DISABLED": [code("infer", enabled=False)], "MODEL_NOT_LOADED": [code("infer", loaded=False)],
    }
    for want, columns in cases.items():
        assert set(spark.range(1).select(*[c.alias(str(k)) for k, c in enumerate(columns)]).first()) == {want}
