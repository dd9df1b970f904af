"""Nearest neighbours of patches in a bank of the same class.

The bank of a class is dealt into shares, and so are its queries; each task
holds one share of either and multiplies in blocks, and the k best of each
query are merged afterwards. A class of any size is spread over tasks, and no
pair of query and bank row is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.sources.folders import stored

SHARE_ROWS = 20_000
#: Distances that a task holds at once.
BLOCK = 1 << 20


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1, exclude_self: bool = False, share_rows: int = SHARE_ROWS) -> DataFrame:
    """query_id, cls, d (mean of the k smallest L2 distances), nearest (their
    bank ids). Queries of a class without a bank are left out."""
    sizes = bank.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / share_rows).cast("int").alias("shares"))
    q_sizes = queries.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / share_rows).cast("int").alias("q_shares"))
    both = sizes.join(q_sizes, "cls")
    b = bank.join(both, "cls").select("cls", "bank_id", "emb", F.pmod(F.xxhash64("bank_id"), F.col("shares")).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("q_shares") - 1)).alias("q_share"))
    q = queries.join(both, "cls").select("cls", "query_id", "emb", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("query_id"), F.col("q_shares")).cast("int").alias("q_share"))

    keys = ["cls", "share", "q_share"]
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in keys], "bank_id", F.col("emb").alias("b_emb"))
    parts = q.groupBy(*keys).cogroup(b.groupBy(*[f"b_{c}" for c in keys])).applyInPandas(best_of_shares(k, exclude_self), FOUND)
    return merged(parts, k)


FOUND = "cls int, query_id long, found array<struct<d:double,id:long>>"


def best_of_shares(k: int, exclude_self: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of a bank share for each query of a query share."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"cls": [], "query_id": [], "found": []})
        x, y = np.stack(left["emb"]).astype(np.float64), np.stack(right["b_emb"]).astype(np.float64)
        ids, norms, out = right["bank_id"].to_numpy(), (y * y).sum(axis=1), []
        step = max(1, BLOCK // len(y))
        for at in range(0, len(x), step):
            part, own = x[at : at + step], left["query_id"].to_numpy()[at : at + step]
            d2 = part @ y.T
            d2 *= -2
            d2 += (part * part).sum(axis=1)[:, None]
            d2 += norms
            if exclude_self:
                d2[own[:, None] == ids[None, :]] = np.inf
            near = np.argpartition(d2, min(k, len(ids)) - 1, axis=1)[:, :k]
            for row, cols in enumerate(near):
                d = np.sqrt(((part[row] - y[cols]) ** 2).sum(axis=1))
                keep = np.isfinite(d2[row, cols])
                out.append([{"d": float(a), "id": int(i)} for a, i in zip(d[keep], ids[cols][keep], strict=True)])
        return pd.DataFrame({"cls": left["cls"], "query_id": left["query_id"], "found": out})

    return best


def merged(parts: DataFrame, k: int) -> DataFrame:
    """query_id, cls, d, nearest of the k best of what shares have found."""
    whole = parts.groupBy("cls", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    mean = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["d"]) / F.size("found")
    return whole.where(F.size("found") > 0).select("query_id", "cls", mean.alias("d"), F.col("found.id").alias("nearest"))


#: Pivots of a class at most; they are broadcast.
PIVOTS = 64


def to_pivots(rows: DataFrame, pivots: DataFrame, nearest_only: bool) -> DataFrame:
    """rows (cls, emb) with the distances to the pivots of their class: of the nearest
    one (pivot, away), or of all (aways). pivots: cls, list of vectors; broadcast, a row
    per class."""

    @F.pandas_udf("array<double>")
    def distances(emb: pd.Series, centres: pd.Series) -> pd.Series:
        out = []
        for e, c in zip(emb, centres, strict=True):
            out.append(np.sqrt(((np.stack(c).astype(np.float64) - np.asarray(e, dtype=np.float64)) ** 2).sum(axis=1)))
        return pd.Series(out)

    found = rows.join(F.broadcast(pivots), "cls").withColumn("aways", distances("emb", "centres")).drop("centres")
    if not nearest_only:
        return found
    least = F.array_min("aways")
    return found.withColumns({"pivot": (F.array_position("aways", least) - 1).cast("int"), "away": least}).drop("aways")


class PrunedSearch:
    """Nearest neighbours where the triangle inequality skips shares of the bank.

    The bank of a class is dealt to its nearest pivots, a few of its own rows, and a
    crowded pivot's rows into several shares; each share has a radius. A query
    first looks through one share of its nearest pivot; the k-th distance there is a
    bound. Of the other shares only those can hold a nearer row whose distance to
    the query, pivot to pivot less the radius, is within the bound."""

    def __init__(self, queries: DataFrame, bank: DataFrame, k: int = 1, exclude_self: bool = False, share_rows: int = SHARE_ROWS, pivots: int = PIVOTS) -> None:
        self.k, self.exclude_self = k, exclude_self
        order = Window.partitionBy("cls").orderBy(F.xxhash64("bank_id"), "bank_id")
        chosen = bank.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= min(pivots, PIVOTS))
        centres = stored(chosen.groupBy("cls").agg(F.collect_list("emb").alias("centres")), "pivots")
        dealt = stored(to_pivots(bank, centres, nearest_only=True), "dealt")
        sizes = dealt.groupBy("cls", "pivot").agg(F.ceil(F.count(F.lit(1)) / share_rows).cast("int").alias("shares"))
        self.bank = dealt.join(sizes, ["cls", "pivot"]).withColumn("part", F.pmod(F.xxhash64("bank_id"), F.col("shares")).cast("int"))
        self.shares = stored(self.bank.groupBy("cls", "pivot", "part").agg(F.max("away").alias("radius")), "shares")
        q = to_pivots(queries, centres, nearest_only=False)
        least = F.array_min("aways")
        self.queries = stored(q.withColumn("home", (F.array_position("aways", least) - 1).cast("int")).withColumn("q_share", F.pmod(F.xxhash64("query_id"), F.lit(16)).cast("int")), "queries")
        first = self.queries.select("cls", "query_id", "emb", F.col("home").alias("pivot"), F.lit(0).alias("part"), "q_share")
        self.first = stored(self.search(first), "first")
        bounds = self.first.select("query_id", F.when(F.size("found") >= k, F.col("found")[k - 1]["d"]).alias("bound"))
        among = self.queries.join(bounds, "query_id", "left").join(F.broadcast(self.shares), "cls")  # a row per share
        near = F.get("aways", F.col("pivot")) - F.col("radius") <= F.coalesce(F.col("bound"), F.lit(float("inf"))) * (1 + 1e-9) + 1e-9
        other = (F.col("pivot") != F.col("home")) | (F.col("part") != 0)
        self.wanted = stored(among.where(near & other).select("cls", "query_id", "emb", "pivot", "part", "q_share"), "wanted")

    def search(self, wanted: DataFrame) -> DataFrame:
        keys = ["cls", "pivot", "part", "q_share"]
        needed = wanted.select(*keys).distinct()
        b = self.bank.join(needed, ["cls", "pivot", "part"]).select(*[F.col(c).alias(f"b_{c}") for c in keys], "bank_id", F.col("emb").alias("b_emb"))
        return wanted.groupBy(*keys).cogroup(b.groupBy(*[f"b_{c}" for c in keys])).applyInPandas(best_of_shares(self.k, self.exclude_self), FOUND)

    def nearest(self) -> DataFrame:
        """As ``nearest``."""
        return merged(self.first.unionByName(self.search(self.wanted)), self.k)

    def looked_at(self) -> DataFrame:
        """Per class: pairs of a query and a share, and those that were looked through."""
        all_ = self.queries.groupBy("cls").agg(F.count(F.lit(1)).alias("q")).join(self.shares.groupBy("cls").agg(F.count(F.lit(1)).alias("s")), "cls")
        more = self.wanted.groupBy("cls").agg(F.count(F.lit(1)).alias("w"))
        return all_.join(more, "cls", "left").select("cls", (F.col("q") * F.col("s")).alias("pairs"), (F.col("q") + F.coalesce("w", F.lit(0))).alias("looked_at"))


def self_distances(bank: DataFrame, exclude_self: bool = False, k: int = 1) -> DataFrame:
    """Distances of a bank's rows to the bank itself."""
    return nearest(bank.withColumnRenamed("bank_id", "query_id"), bank, k, exclude_self)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def normalised(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def projection_matrix(width: int, size: int, seed: int = 42) -> np.ndarray:
    m = np.random.default_rng(seed).standard_normal((width, size))
    return m / np.linalg.norm(m, axis=0)


def projection(rows: DataFrame, column: str, size: int, seed: int = 42) -> DataFrame:
    """Random projection by a seeded Gaussian matrix with columns of length 1,
    then normalised; off where the size isn't smaller."""

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors).astype(np.float64)
        if size < x.shape[1]:
            x = x @ projection_matrix(x.shape[1], size, seed)
        return pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))

    return rows.withColumn(column, project(column))


def pooled(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector of each group; sums leave each task per component."""
    cells = rows.select(group, F.posexplode(vector).alias("_k", "_x")).groupBy(group, "_k").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_k", "_m"))).alias("_c"))
    return whole.select(group, F.col("_c._m").alias(vector))


def with_rank(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k highest scores of each group."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
