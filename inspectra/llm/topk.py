"""Exact top-k search by inner product, with a three-phase uniform threshold.

Vectors become integers, floor(1024 x) of each component. A vector is cut into
``lists`` slices; a slice of all rows is a list that knows only its part of
every score.

1. Each list gives the 8 k highest local scores of each query, the best of each
   task first (more than k, as a higher cutoff lets fewer entries through). The rows so found are scored whole; the k-th best of them is a
   score that the answer reaches: the cutoff.
2. The cutoffs go back to the lists, as part of the query blocks. A row whose
   whole score reaches the cutoff has a local score of at least cutoff / lists
   in some list, whatever the signs; each list gives those entries.
3. The rows that any list named are scored exactly, and the k best stay. A row
   that all lists named has its score already, and is dropped below the cutoff.

Rows with equal vectors tie in every query, so of each vector only the 2 k rows
with the smallest ids are searched, k of one id at most (an id may be the
query's own): a vector that a third of all rows share is 2 k rows from there on,
and each task keeps no more of it either. Queries and rows meet in packed blocks
of bounded size: never as pairs. Query blocks are broadcast while they are small
(checked), else copied to shares of the row blocks. What is collected is the entries above the cutoff: with
two lists of 32 components each, 1 pair in 50 of the test tables.

Defined cases: a vector that is null, or holds a null, NaN or infinite
component, takes no part, as query or as candidate; so do rows without an id. A
score is defined while it fits a long; an empty vector scores 0. Vectors of
another length than the query's are no candidates for it. Rows that repeat an id
are candidates each, and queries each; a query never finds its own id. Ties go
to the smaller id. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.llm import common
from inspectra.llm.common import bytes_of, stored, stored_in_small_batches

SCALE = 1024
LISTS = 2
#: Entries that each list gives at first, times k.
HEADS = 8
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
#: Blocks that pass between Spark and Python at a time.
BATCH = 4
#: Shares of the row blocks where query blocks are too large for a broadcast.
SHARES = 256
#: Stands for no cutoff.
LEAST = -(1 << 62)
#: Products of doubles are exact up to here.
EXACT = 1 << 53


def whole_numbers(vector: Column) -> Column:
    """The integers of a vector; null where it takes no part."""
    good = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double"))))


def integer_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row (a number of its own), vec_id, v."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def fewest_of_equal(rows: DataFrame, k: int) -> DataFrame:
    """Rows without those that others with the same vector and smaller ids beat in every query."""
    digest = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).cast("binary"), 256)
    one_id = Window.partitionBy("_digest", "vec_id").orderBy("row")
    one_vector = Window.partitionBy("_digest").orderBy("vec_id", "row")
    rows = rows.withColumn("_digest", digest).withColumn("_n", F.row_number().over(one_id)).where(F.col("_n") <= k)
    return rows.withColumn("_n", F.row_number().over(one_vector)).where(F.col("_n") <= 2 * k).select("row", "vec_id", "v")


BLOCKS = "width int, list int, rows binary, ids binary, cutoffs binary, numbers binary"


def packed(rows: DataFrame, size: int, lists: int) -> DataFrame:
    """Blocks of up to ``size`` rows (row, vec_id, cutoff, v) with vectors of one
    length, one for each list."""

    def block(found: list[tuple]) -> list[tuple]:
        matrix = np.array([v for *_, v in found], dtype=np.int64).reshape(len(found), -1)
        longs = [np.array(x, dtype=np.int64).tobytes() for x in list(zip(*found, strict=True))[:3]]
        edges = [matrix.shape[1] * i // lists for i in range(lists + 1)]
        return [(matrix.shape[1], i, *longs, np.ascontiguousarray(matrix[:, a:b]).tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        columns = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            for one in zip(batch["row"], batch["vec_id"], batch["cutoff"], batch["v"], strict=True):
                of = held.setdefault(len(one[3]), [])
                of.append(one)
                if len(of) == size:
                    yield pd.DataFrame(block(held.pop(len(one[3]))), columns=columns)
        for of in held.values():
            yield pd.DataFrame(block(of), columns=columns)

    return rows.select("row", "vec_id", "cutoff", "v").mapInPandas(task, BLOCKS)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b."""
    most = max(abs(int(a.min(initial=0))), int(a.max(initial=0))) * max(abs(int(b.min(initial=0))), int(b.max(initial=0))) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < EXACT else a @ b.T


def _numbers(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(rows, -1) if data else np.zeros((rows, 0), dtype=np.int64)


def meet(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Query blocks beside the row blocks of the same list and width. The row
    blocks stay where they are while all query blocks are few bytes; beyond that
    they are dealt into shares, each of which gets a copy of the query blocks."""
    q = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns])
    same = (F.col("width") == F.col("q_width")) & (F.col("list") == F.col("q_list"))
    if bytes_of(q, F.length("q_numbers") + 3 * F.length("q_rows")) <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(q), same)
    shares = max(1, min(SHARES, rows.count()))
    q = q.withColumn("q_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return rows.withColumn("share", F.pmod(F.xxhash64("list", "rows"), F.lit(shares)).cast("int")).join(q, same & (F.col("share") == F.col("q_share")))


def _longs(*data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int64) for x in data]


def local_heads(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: query, list, row, part: each list's k highest entries of each query."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples():
                q, q_ids, rows, ids = _longs(one.q_rows, one.q_ids, one.rows, one.ids)
                part = products(_numbers(one.q_numbers, len(q)), _numbers(one.numbers, len(rows)))
                own = q_ids[:, None] == ids[None, :]
                part[own] = np.iinfo(np.int64).min
                best = np.argpartition(part, max(0, len(rows) - k), axis=1)[:, -k:]
                at, col = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                good = ~own[at, col]
                at, col = at[good], col[good]
                yield pd.DataFrame({"query": q[at], "list": np.full(len(at), one.list, dtype=np.int32), "row": rows[col], "part": part[at, col]})

    found = pairs.mapInPandas(task, "query long, list int, row long, part long")
    order = Window.partitionBy("query", "list").orderBy(F.desc("part"), "row")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def entries_above(pairs: DataFrame, lists: int) -> DataFrame:
    """Phase 2: query, row, part and cutoff of all entries of at least cutoff / lists;
    without a cutoff, of all."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples():
                q, q_ids, cutoffs, rows, ids = _longs(one.q_rows, one.q_ids, one.q_cutoffs, one.rows, one.ids)
                part = products(_numbers(one.q_numbers, len(q)), _numbers(one.numbers, len(rows)))
                least = -(-cutoffs // lists)
                at, col = np.nonzero((part >= least[:, None]) & (q_ids[:, None] != ids[None, :]))
                yield pd.DataFrame({"query": q[at], "row": rows[col], "part": part[at, col], "cutoff": cutoffs[at]})

    return pairs.mapInPandas(task, "query long, row long, part long, cutoff long")


def scored(found: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, query_id, vec_id, score of (query, row)."""
    both = found.select("query", "row").join(rows.select("row", "vec_id", F.col("v").alias("_v")), "row")
    both = both.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("_q")), "query")

    @F.pandas_udf("long")
    def inner(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series(np.zeros(len(a), dtype=np.int64))
        ends = np.cumsum(sizes)
        sums = np.append(0, np.cumsum(np.concatenate(list(a)).astype(np.int64) * np.concatenate(list(b)).astype(np.int64)))
        return pd.Series(sums[ends] - sums[ends - sizes])

    return both.select("query", "query_id", "vec_id", inner("_q", "_v").alias("score"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the highest scores for each
    row for which is_query holds (a condition on df)."""
    queries = stored(integer_rows(df.where(is_query), id_col, vector_col).withColumn("cutoff", F.lit(LEAST)), "queries")
    rows = stored(fewest_of_equal(stored(integer_rows(df, id_col, vector_col), "integers"), k).withColumn("cutoff", F.lit(LEAST)), "candidates")
    blocks = stored(packed(rows, block_rows, lists), "row-blocks")
    heads = stored_in_small_batches(local_heads(meet(stored(packed(queries, BLOCK_QUERIES, lists), "query-blocks"), blocks), HEADS * k), "heads", BATCH)
    cutoffs = ranked(scored(heads.select("query", "row").distinct(), queries, rows), k).where(F.col("rank") == k)
    again = queries.drop("cutoff").join(cutoffs.select(F.col("query").alias("row"), F.col("score").alias("cutoff")), "row", "left").fillna({"cutoff": LEAST})
    entries = stored_in_small_batches(entries_above(meet(stored(packed(again, BLOCK_QUERIES, lists), "query-blocks"), blocks), lists), "entries", BATCH)
    summed = entries.groupBy("query", "row").agg(F.sum("part").alias("seen"), F.count(F.lit(1)).alias("n"), F.first("cutoff").alias("cutoff"))
    best = ranked(scored(summed.where((F.col("n") < lists) | (F.col("seen") >= F.col("cutoff"))), queries, rows), k)
    return best.select("query_id", "rank", "vec_id", "score")
