"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after all white space [\\x20\\x09-\\x0D] is
deleted. Of equal texts the row with the most code points stays, then the
smallest id (a null id counts as larger than any), then the first row read.

A Misra-Gries summary finds the digests that may hold a large share of the
rows. Their exact counts and winners are taken in a second pass that combines
map-side, and are broadcast (at most ``counters`` rows), so that rows of large
groups are decided, and the losers among them removed, where they are read. The
other digests, each at most 2 / (counters + 1) of all rows, go through an
ordinary shuffle of slim rows, also combined map-side.

Defined cases: a null text equals the empty text; an empty table gives an
empty result; of rows that repeat both id and text one is kept; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.llm.common import SPACES, keep_decided, stored

COUNTERS = 1024


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One slim row per input row: row_id, doc_id, n_points, digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
    )


def merge_summary(summary: pd.Series, counts: pd.Series, counters: int) -> pd.Series:
    """Add exact counts to a Misra-Gries summary. When more than ``counters``
    keys result, the next largest count is taken off all of them."""
    both = counts if summary.empty else summary.add(counts, fill_value=0)
    if len(both) > counters:
        cut = both.nlargest(counters + 1).iloc[-1]
        both = both[both > cut] - cut
    return both


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them every one that holds at least
    2 / (counters + 1) of the rows: a summary per task, added up by digest."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summary = pd.Series(dtype="float64")
        for batch in batches:
            summary = merge_summary(summary, batch["digest"].value_counts().astype("float64"), counters)
        yield pd.DataFrame({"digest": list(summary.index), "lower": summary.to_numpy().astype("int64")})

    return (
        rows.select("digest")
        .mapInPandas(summarise, "digest binary, lower long")
        .groupBy("digest")
        .agg(F.sum("lower").alias("lower"))
        .where("lower > 1")
        .orderBy(F.desc("lower"), "digest")
        .limit(counters)
        .select("digest")
    )


def _rank() -> Column:
    """Orders the rows of a group; the least one stays."""
    return F.struct((-F.col("n_points")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")


def grouped(df: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slim rows; the winners and sizes of frequent digests; those of the others."""
    rows = stored(digests(df, id_col, text_col), "digests")
    best = (F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    hot = stored(rows.join(F.broadcast(frequent_digests(rows, counters)), "digest").groupBy("digest").agg(*best), "winners")
    cold = stored(rows.join(F.broadcast(hot), "digest", "left_anti").groupBy("digest").agg(*best), "others")
    return rows, hot, cold


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    rows, hot, cold = grouped(df, id_col, text_col, counters)
    marked = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest"))
    return marked.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
        "digest",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of df that stay, with all their columns. Losers of frequent
    digests go where they are read, by their broadcast winners; those of the
    others by their keys, which are few next to the rows that stay."""
    rows, hot, cold = grouped(df, id_col, text_col, counters)
    best = hot.select(F.col("digest").alias("_hot"), F.col("best.doc_id").alias("_best"), F.col("best.longest").alias("_longest"))
    won = F.col("_hot").isNull() | (F.col("doc_id").eqNullSafe(F.col("_best")) & (F.col("n_points") == -F.col("_longest")))

    def left(some: DataFrame) -> DataFrame:
        return some.join(F.broadcast(best), F.col("digest") == F.col("_hot"), "left").where(won)

    slim = left(rows)
    shared = slim.where("_hot IS NULL").join(cold.where("group_size > 1"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_points") == -F.col("best.longest"))
    keys = ["digest", "doc_id", "n_points"]
    decided = slim.where("_hot IS NOT NULL").select(*keys, F.lit(True).alias("kept")).unionByName(shared.select(*keys, kept.alias("kept")))
    named = df.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
    )
    return keep_decided(left(named).select("row", *keys), keys, decided)
