"""URL filter: block and allow rules, then a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Everything is DataFrame functions. The labelled table is of fixed, small size,
so gradient descent runs as one ``aggregate`` over its sparse features; the
resulting weights (``BUCKETS`` doubles) become a literal of the scoring
expression. Scoring is a projection of the url column alone: no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged by the model's intercept; an empty table gives an empty result;
rows that repeat are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
GRAM = 4
STEPS = 300
RATE = 1.0
DECAY = 1e-4

#: (verdict, host, path prefix). A rule fits its host and all subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The labelled URL table: 1 is to be blocked.
LABELLED = [
    (1, "http://www.cheap-pills.example.com/en/450"), (1, "https://cheap-pills.example.org/fr/176/"), (1, "http://pills-cheap.example.net/buy"),
    (1, "https://www.casino-win.example.org/en/14"), (1, "http://m.casino-win.example.com/de/3.html"), (1, "http://casino-bonus.example.net/win"),
    (1, "http://m.free-bets.example.com/en/27"), (1, "https://free-bets.example.net/es/9/"), (1, "http://free-spins.example.org/bets"),
    (1, "https://spam-farm.example.org/en/728"), (1, "http://blog.spam-farm.example.com/en/11"), (1, "https://link-farm.example.net/seo"),
    (1, "https://ads-track.example.org/en/584"), (1, "http://m.ads-track.example.com/fr/5"), (1, "http://click-track.example.net/ads"),
    (1, "https://www.cheap-pills.example.net/es/91.html"), (1, "http://casino-win.example.net/en/62/"), (1, "http://www.free-bets.example.org/de/8"),
    (0, "http://ththre.example.com/fr/825"), (0, "https://m.ththth.example.net/en/25"), (0, "https://thther.example.org/en/685"),
    (0, "http://therha.example.com/en/676"), (0, "https://blog.tiontion.example.com/en/853/"), (0, "http://blog.ththan.example.net/en/960"),
    (0, "https://m.therou.example.com/en/474.html"), (0, "https://blog.tionsh.example.net/es/533/"), (0, "https://www.ththen.example.com/en/148.html"),
    (0, "http://ththed.example.org/en/453"), (0, "https://www.ththwh.example.org/en/471"), (0, "http://blog.theres.example.com/es/575"),
    (0, "https://news.example.com/world/2021/story.html"), (0, "http://www.library.example.org/catalogue/books"), (0, "https://docs.example.com/guide/install"),
    (0, "https://wiki.example.org/page/history"), (0, "http://university.example.edu/courses/physics"), (0, "https://blog.thernd.example.net/de/612"),
    (0, "http://m.thering.example.com/en/328/"), (0, "https://museum.example.org/fr/collections"), (0, "https://www.therti.example.org/en/618/"),
    (0, "http://weather.example.com/forecast/today"), (0, "http://recipes.example.net/soup.html"), (0, "https://blog.thertion.example.org/es/978"),
    (0, "https://ththble.example.com/es/797"), (0, "http://www.thther.example.org/fr/414"),
]

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers (from 0) of all n-grams; those of the host and of the
    path are told apart by a mark."""

    def grams(mark: str, part: Column) -> Column:
        whole = F.concat(F.lit("^"), part, F.lit("$"))
        count = F.when(part == "", 0).otherwise(F.greatest(F.length(whole) - (GRAM - 1), F.lit(1)))
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(whole, i, F.lit(GRAM))), F.lit(buckets)).cast("int"))

    return F.concat(grams("h", host), grams("p", path))


def train(spark: SparkSession, labelled: list[tuple[int, str]] = LABELLED, buckets: int = BUCKETS, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and intercept by full-batch gradient descent. A step is two
    turns of the fold: the residuals of all examples, then the new weights."""
    urls = spark.createDataFrame([(i, float(y), u) for i, (y, u) in enumerate(labelled)], "ex int, y double, url string")
    rows = urls.select("ex", "y", features(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("grams"))
    cells = (
        rows.select("ex", F.sqrt(F.size("grams").cast("double")).alias("norm"), F.explode("grams").alias("bucket"))
        .groupBy("ex", "bucket")
        .agg((F.count(F.lit(1)) / F.first("norm")).alias("val"))
    )
    by_example = cells.groupBy("ex").agg(F.collect_list(F.struct("bucket", "val")).alias("cells")).join(rows.select("ex", "y"), "ex")
    by_bucket = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(cells, "bucket", "left")
    by_bucket = by_bucket.groupBy("bucket").agg(F.collect_list(F.when(F.col("ex").isNotNull(), F.struct("ex", "val"))).alias("cells"))
    one = by_example.select(F.struct("ex", "y", "cells").alias("example"), F.lit(None).alias("column")).unionByName(
        by_bucket.select(F.lit(None).alias("example"), F.struct("bucket", "cells").alias("column"))
    )
    both = one.agg(F.array_sort(F.collect_list("example")).alias("examples"), F.array_sort(F.collect_list("column")).alias("columns"))

    zero = F.lit(0.0)
    start = F.struct(F.array_repeat(zero, buckets).alias("w"), zero.alias("b"), F.array_repeat(zero, len(labelled)).alias("r"))

    def residual(s: Column, ex: Column) -> Column:
        z = F.aggregate(ex["cells"], s["b"], lambda a, c: a + s["w"][c["bucket"]] * c["val"])
        return ex["y"] - 1 / (1 + F.exp(-z))

    def turn(s: Column, i: Column) -> Column:
        residuals = F.struct(s["w"].alias("w"), s["b"].alias("b"), F.transform(F.col("examples"), lambda ex: residual(s, ex)).alias("r"))
        weights = F.zip_with(
            s["w"], F.col("columns"),
            lambda w, c: w * (1 - DECAY * RATE) + RATE * F.aggregate(c["cells"], zero, lambda a, e: a + s["r"][e["ex"]] * e["val"]),
        )
        bias = s["b"] + 0.1 * RATE * F.aggregate(s["r"], zero, lambda a, r: a + r) / len(labelled)
        return F.when(i % 2 == 1, residuals).otherwise(F.struct(weights.alias("w"), bias.alias("b"), s["r"].alias("r")))

    model = both.select(F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps)), start, turn).alias("m")).first()["m"]
    return list(model["w"]), model["b"]


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    chain = None
    for verdict, domain, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        said = F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, said) if chain is None else chain.when(fits, said)
    return chain


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", model: tuple[list[float], float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict, block_probability."""
    weights, bias = model or train(df.sparkSession, buckets=buckets)
    w = F.lit(weights)
    parts = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = parts.select("*", rule_of(F.col("host"), F.col("path")).alias("said"), features(F.col("host"), F.col("path"), buckets).alias("grams"))
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + w[g])
    z = total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double")) + F.lit(bias)
    scored = scored.withColumn("block_probability", 1 / (1 + F.exp(-z)))
    own = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", F.col("said.rule").alias("rule"), F.coalesce("said.verdict", own).alias("verdict"), "block_probability")
