"""Order statistics, ranks and running sums of groups of any size.

A group that a third of all rows belong to is never one task's work: values are
counted and kept in each task first, numbers are given per block of a group, and
only what lies at a boundary is looked at row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.sources.folders import stored

#: Groups up to this size are sorted as one array.
SMALL = 100_000
ACCURACY = 10_000


def _same(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(prefix + k))
    return same


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """Per group, of its n values (nulls aside): n, and for each name the value at
    a rank (from 0, a function of n), exactly.

    A small group's values are sorted as one array. Of a larger one a mergeable
    summary brackets each rank between two values; the values inside the bracket
    are counted by value, in each task first, and the rank is found among the
    counts. Brackets that miss a rank, which the counts show, are widened.
    """
    slim = stored(rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), "values")
    sizes = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > small), "large-groups")
    many = large.count()
    rest = slim.join(F.broadcast(_renamed(large, keys, "_k_")), _same(keys, "_k_"), "left_anti") if many else slim
    arrays = rest.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s")).withColumn("n", F.size("_s").cast("long"))
    out = arrays.select(*keys, "n", *[F.get("_s", f(F.col("n")).cast("int")).alias(name) for name, f in ranks.items()])
    if not many:
        return out
    names = list(ranks)
    wanted = large.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(F.col("n")).cast("long").alias("rank")) for i, f in enumerate(ranks.values())])).alias("t")).select(*keys, "n", "t.*")
    slack, found, left = 2.0 / accuracy, None, stored(wanted, "wanted")
    while True:
        hits = _bracketed(slim, left, keys, slack, accuracy)
        found = hits if found is None else found.unionByName(hits)
        missing = stored(left.join(_renamed(hits.select(*keys, "i"), [*keys, "i"], "_k_"), _same([*keys, "i"], "_k_"), "left_anti"), "missed")
        if missing.isEmpty():
            break
        left, slack = missing, slack * 8
    wide = found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(names)])
    return out.unionByName(wide)


def _bracketed(slim: DataFrame, wanted: DataFrame, keys: list[str], slack: float, accuracy: int) -> DataFrame:
    """keys, n, i, value of the wanted ranks that lie within their brackets."""
    place = F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))
    ends = wanted.withColumns({"_from": place - slack, "_to": place + slack})
    # at most a summary of ``accuracy`` values per large group leaves each task
    known = ends.groupBy(*keys).agg(F.collect_list(F.struct("i", "rank", "n", "_from", "_to")).alias("_t"))
    grid = [k / 1000 for k in range(1001)] if slack >= 1e-3 else [k / accuracy for k in range(accuracy + 1)]
    of_groups = slim.join(F.broadcast(_renamed(known.select(*keys), keys, "_k_")), _same(keys, "_k_"), "left_semi")
    summary = stored(of_groups.groupBy(*keys).agg(F.percentile_approx("_v", grid, accuracy).alias("_q")), "summaries")
    last = len(grid) - 1
    brackets = known.join(_renamed(summary, keys, "_k_"), _same(keys, "_k_")).select(*keys, "_q", F.explode("_t").alias("t")).select(
        *keys, "t.i", "t.rank", "t.n",
        F.when(F.col("t._from") > 0, F.get("_q", F.floor(F.col("t._from") * last).cast("int"))).otherwise(F.lit(-math.inf)).alias("_low"),
        F.when(F.col("t._to") < 1, F.get("_q", F.ceil(F.col("t._to") * last).cast("int"))).otherwise(F.lit(math.inf)).alias("_high"),
    )
    brackets = stored(brackets, "brackets")
    b = _renamed(brackets.groupBy(*keys).agg(F.collect_list(F.struct("i", "_low", "_high")).alias("_b")), keys, "_k_")
    each = slim.join(F.broadcast(b), _same(keys, "_k_")).select(*keys, "_v", F.explode(F.filter("_b", lambda x: F.col("_v") <= x["_high"])).alias("b"))
    # NaN is larger than any other value, as in the order of arrays
    inside = F.when(F.col("_v") >= F.col("b._low"), F.col("_v"))
    counts = each.groupBy(*keys, F.col("b.i").alias("i"), inside.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    so_far = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("value").asc_nulls_first()))
    marked = counts.withColumn("_end", so_far).join(F.broadcast(_renamed(brackets, [*keys, "i"], "_k_")), _same([*keys, "i"], "_k_"))
    good = (F.col("_end") > F.col("rank")) & (F.col("_end") - F.col("c") <= F.col("rank")) & F.col("value").isNotNull()
    return stored(marked.where(good).select(*keys, "n", "i", "value"), "ranked")


def quantiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """Per group n and exact quantiles with linear interpolation, by name."""
    ranks = {}
    for name, p in ps.items():
        ranks[f"_{name}_0"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"_{name}_1"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    found = order_statistics(rows, keys, value, ranks, small, accuracy)

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_{name}_0"), F.col(f"_{name}_1")
        place = (F.col("n") - 1) * F.lit(p)
        return F.when(low == high, low).otherwise(low * (F.ceil(place) - place) + high * (place - F.floor(place)))

    return found.select(*keys, "n", *[between(name, p).alias(name) for name, p in ps.items()])


def top_rows(rows: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k largest of each group; each task keeps k before anything is shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)


def group_scores(rows: DataFrame, keys: list[str], value: str, index: str, k: int = 10, percentile: float = 99.0, alpha: float = 0.5, small: int = SMALL) -> DataFrame:
    """Per group all the scores of its distances: max, topk, percentile, hybrid,
    contrast and spatial, from bounded summaries: the k largest rows, counts, and
    two order statistics."""
    top = top_rows(rows.select(*keys, index, value), keys, value, index, k)
    ranks = {"_cut": lambda n: n - F.greatest(F.lit(1), (n * (1 - percentile / 100)).cast("long")), "_lower": lambda n: F.floor((n + 1) / 2) - 1}
    stats = stored(order_statistics(rows, keys, value, ranks, small), "statistics")
    small_side = F.greatest(F.lit(1), F.bround(F.sqrt("n")).cast("int"))
    grid = stats.select(*keys, "n", small_side.alias("_h")).withColumn("_w", F.when(F.col("_h") * F.col("_h") == F.col("n"), F.col("_h")).otherwise(F.floor(F.col("n") / F.col("_h"))).cast("int"))
    cells = top.join(_renamed(grid, keys, "_k_"), _same(keys, "_k_")).withColumns({"_r": F.floor(F.col(index) / F.col("_w")), "_c": F.col(index) % F.col("_w")})
    heads = cells.groupBy(*keys).agg(
        F.max(value).alias("max"), F.avg(value).alias("topk"), F.sqrt(F.var_pop("_r") + F.var_pop("_c")).alias("_spread"),
        F.first(F.sqrt(F.pow(F.col("_h") / 2, F.lit(2)) + F.pow(F.col("_w") / 2, F.lit(2)))).alias("_most"),
    )
    above = rows.join(_renamed(stats.select(*keys, "_cut"), keys, "_k_"), _same(keys, "_k_")).where(F.col(value) > F.col("_cut")).groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_above"))
    all_ = heads.join(_renamed(stats, keys, "_k_"), _same(keys, "_k_")).drop(*[f"_k_{k}" for k in keys])
    all_ = all_.join(_renamed(above, keys, "_k_"), _same(keys, "_k_"), "left")
    m = F.greatest(F.lit(1), (F.col("n") * (1 - percentile / 100)).cast("long"))
    over = F.coalesce("_above", F.lit(0))
    a = min(1.0, max(0.0, alpha))
    return all_.select(
        *keys, "n", "max", "topk", ((F.coalesce("_sum", F.lit(0.0)) + (m - over) * F.col("_cut")) / m).alias("percentile"),
        (a * F.col("max") + (1 - a) * F.col("topk")).alias("hybrid"), (F.col("topk") / (F.col("_lower") + 1e-6)).alias("contrast"),
        (F.col("topk") * (2 - F.least(F.col("_spread") / (F.col("_most") + 1e-6), F.lit(1.0)))).alias("spatial"),
    )


def numbered(rows: DataFrame, keys: list[str], order: Column, tie: str, bins: int = 4096, top: int = 1 << 52) -> DataFrame:
    """Rows of each group numbered from 0 (_place) by an evenly spread whole number
    below ``top``, then tie; and the group's size (_size). A group's rows are
    numbered per bin of that number, after the rows of the bins before."""
    marked = rows.withColumn("_o", order).withColumn("_bin", F.floor(F.col("_o") / (top // bins)).cast("int"))
    before = _bins_before(marked, keys)
    place = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_o", tie)) - 1 + F.col("_before")
    joined = marked.join(_renamed(before, [*keys, "_bin"], "_k_"), _same([*keys, "_bin"], "_k_"))
    return joined.withColumn("_place", place).drop("_o", "_bin", "_before", "_count", "_k__bin", *[f"_k_{k}" for k in keys])


def _bins_before(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and bin: rows in it, rows in bins before it, rows of the group."""
    counts = marked.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_count"))
    group = Window.partitionBy(*keys)
    return counts.withColumns({"_before": F.sum("_count").over(group.orderBy("_bin")) - F.col("_count"), "_size": F.sum("_count").over(group)})


def first_share(rows: DataFrame, keys: list[str], order: Column, tie: str, target: Callable[[Column], Column], bins: int = 4096, top: int = 1 << 52) -> DataFrame:
    """Adds _in: whether a row is among the first target(size) of its group. Bins
    that lie wholly inside or outside decide their rows where they are read;
    only the bin at the cut is ranked row by row."""
    marked = rows.withColumn("_o", order).withColumn("_bin", F.floor(F.col("_o") / (top // bins)).cast("int"))
    cut = _bins_before(marked, keys).withColumn("_target", target(F.col("_size")))
    inside = F.when(F.col("_before") + F.col("_count") <= F.col("_target"), True).when(F.col("_before") >= F.col("_target"), False)
    joined = marked.join(_renamed(cut.withColumn("_all", inside), [*keys, "_bin"], "_k_"), _same([*keys, "_bin"], "_k_"))
    temporary = ["_o", "_bin", "_before", "_count", "_size", "_target", "_all", "_k__bin", *[f"_k_{k}" for k in keys]]
    sure = joined.where("_all IS NOT NULL").withColumn("_in", F.col("_all")).drop(*temporary)
    rank = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_o", tie)) + F.col("_before")
    at_cut = joined.where("_all IS NULL").withColumn("_in", rank <= F.col("_target")).drop(*temporary)
    return sure.unionByName(at_cut)


def running_sums(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a value over a group's rows up to and with each, by block and
    then order. Sums of blocks first, the sums of all blocks before, then the
    rows inside a block: a task holds one block of a group. block: whole, and
    ascending with the order."""
    marked = rows.withColumn("_block", block)
    sums = marked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_sum")).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.withColumn("_inside", inside).join(_renamed(before, [*keys, "_block"], "_k_"), _same([*keys, "_block"], "_k_"))
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before", "_k__block", *[f"_k_{k}" for k in keys])
