"""Logical views that give the driver tables the shape of inspection data.

``VIEWS`` holds the same views as SQL; ``with_views`` puts those a query needs
before its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import cycle, islice
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to four tasks a core where a few large files would leave
    most cores without any; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pred = F.when(F.col("event_type") == "signup", "NG").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").otherwise("OK")
    return e.select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("p"), F.col("user_id") % 8).alias("project_id"), pred.alias("pred"),
        F.col("value").alias("infer_ms"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("n")).distinct()
    return ids.select(F.concat(F.lit("p"), "n").alias("project_id"), (F.col("n") % 5 != 0).alias("enabled"), F.when(F.col("n") % 2 == 1, 150.0).alias("thr_global"))


def model_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.concat(F.lit("p"), F.col("user_id") % 8).alias("project_id"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("version"), F.col("ts").cast("timestamp").alias("updated_at"))


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of version folders: those of purchases, some of them gone, and of signups."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup' OR (event_type = 'purchase' AND event_id % 7 <> 0)")
    name = F.element_at(F.array(*[F.lit(x) for x in ("meta.json", "index.json", "weights.joblib", "notes.txt", "readme.md")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.concat(F.lit("p"), F.col("user_id") % 8).alias("project_id"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("version"), name.alias("file"), F.col("ts").cast("timestamp").alias("ts"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bank_id"), F.col("label").alias("cls"), F.col("embedding").alias("emb"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row, sought among all others."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("cls"), F.col("embedding").alias("emb"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    image = F.floor(F.col("vec_id") / 8).alias("image_id")
    cls = F.min_by("label", "vec_id").over(Window.partitionBy(F.floor(F.col("vec_id") / 8))).alias("cls")
    return e.select(image, (F.col("vec_id") % 8).alias("patch_idx"), cls, F.col("embedding").alias("emb"))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    return cells.select("image_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap(spark, sf_dir).select("image_id", "y", "x", F.round((F.col("v") + 1) * 127.5).cast("int").alias("gray"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen strips an image, each a profile of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 16).alias("image_id"), (F.col("vec_id") % 16).cast("int").alias("strip_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("profile"))


def strip_boxes(strips: DataFrame) -> DataFrame:
    """Where the strips lie: rows of 8 that overlap by 2, as wide as their profile."""
    top = F.col("strip_idx") * 6
    return strips.withColumns({"x0": F.lit(0), "y0": top, "x1": F.lit(64), "y1": top + 8})


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.floor(F.col("user_id") / 2).alias("image_id"), F.when(F.col("user_id") % 2 == 0, "L").otherwise("R").alias("side"),
        (F.row_number().over(order) - 1).alias("y"), F.col("value").alias("x"),
    )


def glyph(idx: Column) -> dict[str, Column]:
    """Centre and size of the idx-th item of a text, in lines of 40."""
    return {"cx": idx % 40 * 12.5, "cy": F.floor(idx / 40) * 30 + 20.5, "w": (idx % 7 + 5).cast("double"), "h": (idx % 4 + 9).cast("double")}


def plain_glyph(idx: int) -> dict[str, float]:
    """As glyph, for one number."""
    return {"cx": idx % 40 * 12.5, "cy": idx // 40 * 30 + 20.5, "w": idx % 7 + 5.0, "h": idx % 4 + 9.0}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.coalesce("text", F.lit("")).alias("t")))


def glyph_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for each character of each text, in lines of 40."""
    i = texts(spark, sf_dir).select("image_id", F.posexplode(F.split("t", "")).alias("idx", "ch")).where("ch <> ''")
    return i.select("image_id", "idx", "ch", *[c.alias(name) for name, c in glyph(F.col("idx")).items()])


def annotation_texts(spark: SparkSession, sf_dir: str, named: Callable[[str, int], dict], placed: Callable[[int], dict], lead: str = "", size: int = 4000) -> DataFrame:
    """json: for every ``size`` characters of a text an annotation in JSON, after
    ``lead``, with an item for each character: what ``named`` gives for it and its
    number modulo 5, and ``placed`` for its number; keys that are None are left out.
    They are written where the text is read; no item is shuffled, and no item's
    numbers are written as text anew for every text that has them."""
    part = texts(spark, sf_dir).where("t <> ''").select("image_id", "t", F.explode(F.sequence(F.lit(0), F.ceil(F.char_length("t") / size).cast("int") - 1)).alias("part"))
    part = part.select("image_id", "part", F.substring("t", F.col("part") * size + 1, F.lit(size)).alias("t"))
    encoder = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))

    def inner(found: dict) -> bytes:
        return encoder.encode({k: value for k, value in found.items() if value is not None})[1:-1].encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = lru_cache(1 << 16)(lambda ch, kind: b"{" + inner(named(ch, kind)) + b",")
        ends = lru_cache(64)(lambda first: [inner(placed(i)) + b"}" for i in range(first, first + size)])
        for batch in batches:
            rows, held = [], 0
            for image, number, text in zip(*(batch.column(c).to_pylist() for c in ("image_id", "part", "t")), strict=True):
                first = number * size
                kinds = islice(cycle(range(5)), first % 5, None)
                items = b",".join(map(add, map(begin, text, kinds), ends(first)))
                rows.append(b'%s{"image_name":"%d.png","items":[%s]}' % (lead.encode(), image, items))
                held += len(items)
                if held > 1 << 23:
                    yield pa.record_batch([pa.array(rows, pa.string())], ["json"])
                    rows, held = [], 0
            yield pa.record_batch([pa.array(rows, pa.string())], ["json"])

    return part.mapInArrow(run, "json string")


def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("image_id"), (k * 37 % 2000 + 200).cast("int").alias("w"), (k * 53 % 900 + 150).cast("int").alias("h"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path without scheme and query of each page's url."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^?#]*)", 1).alias("path"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 0).alias("actual_ng"), (F.col("toxic") == 1).alias("predicted_ng"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.floor(F.col("value") / 100).cast("int").alias("size"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 2).alias("stem"), F.when(F.col("event_id") % 2 == 0, "image").otherwise("json").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn")
    cmd = F.when(F.col("role") == "system", "ping").when(F.col("turn") == 7, "stop").when(F.col("turn") == 6, "Status").when(F.col("turn") == 5, "set_active_model").when(n % 3 == 0, "infer").otherwise("INFER")
    body = F.format_string('"cmd":"%s","job_id":"%s","image_path":"%s"', cmd, F.when(n % 13 == 0, "").otherwise(n.cast("string")), F.when(n % 17 != 0, F.concat(F.lit("/in/"), F.col("conv_id"), F.lit(".png"))).otherwise(""))
    line = F.when(n % 11 == 0, F.concat(F.lit("{"), body)).when(n % 7 == 0, F.concat(F.lit(" \t"), body, F.lit("}} "))).when(n % 19 == 0, F.to_json(F.array(F.lit(1)))).when(n % 23 == 0, F.concat(F.lit('"'), F.col("role"), F.lit('"'))).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    return c.select(n.alias("request_id"), F.col("conv_id").alias("client"), line.alias("line"), (F.col("conv_id") % 9).alias("n"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, label, points: a rectangle per image."""
    i = image_index(spark, sf_dir)
    k = F.col("image_id")
    x0, y0 = k % 50, k % 30
    corners = F.array(F.array(x0, y0), F.array(x0 + k % 97 + 3, y0), F.array(x0 + k % 97 + 3, y0 + k % 61 + 3), F.array(x0, y0 + k % 61 + 3))
    label = F.when(k % 3 == 0, "Panel").when(k % 3 == 1, "panel ").otherwise("other")
    return i.select("image_id", "w", "h", label.alias("label"), F.when(k % 10 == 0, F.slice(corners, 1, 2)).otherwise(corners).alias("points"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cls"), (F.element_at("embedding", 1).cast("double") * 4).alias("logit_ok"), (F.element_at("embedding", 2).cast("double") * 4).alias("logit_ng"))


VIEWS = {
    "jobs": """SELECT event_id AS job_id, 'p' || (user_id % 8) AS project_id,
        CASE event_type WHEN 'signup' THEN 'NG' WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' ELSE 'OK' END AS pred,
        value AS infer_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS date FROM events""",
    "projects": "SELECT 'p' || n AS project_id, n % 5 <> 0 AS enabled, CASE WHEN n % 2 = 1 THEN 150.0::DOUBLE END AS thr_global FROM (SELECT DISTINCT user_id % 8 AS n FROM events)",
    "model_pins": "SELECT 'p' || (user_id % 8) AS project_id, strftime(ts, '%Y%m%d_%H%M%S') AS version, CAST(ts AS TIMESTAMP) AS updated_at FROM events WHERE event_type = 'purchase'",
    "model_files": "SELECT 'p' || (user_id % 8) AS project_id, strftime(ts, '%Y%m%d_%H%M%S') AS version, ['meta.json', 'index.json', 'weights.joblib', 'notes.txt', 'readme.md'][event_id % 5 + 1] AS file, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'signup' OR (event_type = 'purchase' AND event_id % 7 <> 0)",
    "bank": "SELECT vec_id AS bank_id, label AS cls, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings",
    "queries": "SELECT vec_id AS query_id, label AS cls, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings WHERE vec_id % 50 = 0",
    "patches": "SELECT vec_id // 8 AS image_id, vec_id % 8 AS patch_idx, first_value(label) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS cls, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings",
    "heatmap": "SELECT vec_id AS image_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)",
    "pixels": "SELECT image_id, y, x, CAST(round((v + 1) * 127.5) AS INTEGER) AS gray FROM heatmap",
    "profiles": "SELECT vec_id // 16 AS image_id, vec_id % 16 AS strip_idx, CAST(embedding AS DOUBLE[]) AS profile FROM embeddings",
    "signal": "SELECT user_id // 2 AS image_id, CASE WHEN user_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS y, value AS x FROM events",
    "glyph_items": "SELECT doc_id AS image_id, CAST(i - 1 AS INTEGER) AS idx, ch, (i - 1) % 40 * 12.5::DOUBLE AS cx, (i - 1) // 40 * 30 + 20.5::DOUBLE AS cy, ((i - 1) % 7 + 5)::DOUBLE AS w, ((i - 1) % 4 + 9)::DOUBLE AS h FROM (SELECT doc_id, unnest(t) AS ch, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).') AS t FROM documents))",
    "image_index": "SELECT p_partkey AS image_id, CAST(p_partkey * 37 % 2000 + 200 AS INTEGER) AS w, CAST(p_partkey * 53 % 900 + 150 AS INTEGER) AS h FROM part",
    "files": "SELECT page_id AS file_id, regexp_extract(coalesce(url, ''), '://([^?#]*)', 1) AS path FROM pages",
    "truth": "SELECT doc_id AS sample_id, quality = 0 AS actual_ng, toxic = 1 AS predicted_ng FROM labels",
    "polls": "SELECT user_id AS path, CAST(floor(value / 100) AS INTEGER) AS size, CAST(ts AS TIMESTAMP) AS ts, event_id FROM events",
    "arrivals": "SELECT event_id // 2 AS stem, CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'json' END AS kind, CAST(ts AS TIMESTAMP) AS ts FROM events",
    "requests": """SELECT request_id, client, CASE WHEN request_id % 11 = 0 THEN '{' || body WHEN request_id % 7 = 0 THEN ' ' || chr(9) || body || '}} ' WHEN request_id % 19 = 0 THEN '[1]' WHEN request_id % 23 = 0 THEN '"' || role || '"' ELSE '{' || body || '}' END AS line, n FROM (
        SELECT conv_id * 100 + turn AS request_id, role, conv_id AS client, conv_id % 9 AS n, '"cmd":"' || CASE WHEN role = 'system' THEN 'ping' WHEN turn = 7 THEN 'stop' WHEN turn = 6 THEN 'Status' WHEN turn = 5 THEN 'set_active_model' WHEN (conv_id * 100 + turn) % 3 = 0 THEN 'infer' ELSE 'INFER' END
        || '","job_id":"' || CASE WHEN (conv_id * 100 + turn) % 13 = 0 THEN '' ELSE CAST(conv_id * 100 + turn AS VARCHAR) END || '","image_path":"' || CASE WHEN (conv_id * 100 + turn) % 17 <> 0 THEN '/in/' || conv_id || '.png' ELSE '' END || '"' AS body FROM conversations)""",
    "polygons": """SELECT image_id, w, h, CASE image_id % 3 WHEN 0 THEN 'Panel' WHEN 1 THEN 'panel ' ELSE 'other' END AS label,
        CASE WHEN image_id % 10 = 0 THEN p[1:2] ELSE p END AS points FROM (SELECT *, [[x0, y0], [x1, y0], [x1, y1], [x0, y1]] AS p FROM (
        SELECT *, image_id % 50 AS x0, image_id % 30 AS y0, image_id % 50 + image_id % 97 + 3 AS x1, image_id % 30 + image_id % 61 + 3 AS y1 FROM image_index))""",
    "logits": "SELECT vec_id AS sample_id, label AS cls, CAST(embedding[1] AS DOUBLE) * 4 AS logit_ok, CAST(embedding[2] AS DOUBLE) * 4 AS logit_ng FROM embeddings",
}


def with_views(sql: str) -> str:
    """The text with a WITH clause of the views that it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in dict.fromkeys(needed))
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
