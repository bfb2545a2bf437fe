"""Ranks and order statistics of large groups.

A group may hold most of all rows, so it is never ordered in one task. Its values are cut into ranges
by approximate quantiles; a range is ordered alone and starts at the number of rows in the ranges
before it. Which range a value falls in only depends on the value, so ties stay together and results
are exact whatever the quantiles are. Ranges are ``RANGES`` a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def in_ranges(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``__gw_r``, the range of each value: one short row of edges for each group meets its rows."""
    edges = df.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("__gw_e"))
    on = df.join(edges, list(by)) if by else df.crossJoin(edges)
    return on.withColumn("__gw_r", F.size(F.filter("__gw_e", lambda e: e < F.col(value)))).drop("__gw_e")


def counts_below(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """(by, value, n, below): how many rows (or what weight) each different value has, and all lesser ones."""
    n = F.count("*").cast("double") if weight is None else F.sum(weight)
    counts = in_ranges(df.groupBy(*by, value).agg(n.alias("n")), by, value)
    sums = counts.groupBy(*by, "__gw_r").agg(F.sum("n").alias("__gw_s"))
    before = lambda w: F.coalesce(w, F.lit(0.0))
    start = sums.select(*by, "__gw_r", before(F.sum("__gw_s").over(W.partitionBy(*by).orderBy("__gw_r").rowsBetween(W.unboundedPreceding, -1))).alias("__gw_b"))
    own = before(F.sum("n").over(W.partitionBy(*by, "__gw_r").orderBy(value).rowsBetween(W.unboundedPreceding, -1)))
    return counts.withColumn("below", own).join(start, [*by, "__gw_r"]).select(*by, value, "n", (F.col("below") + F.col("__gw_b")).alias("below"))


def numbered(df: DataFrame, order: str, *ties: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: row numbers from 1 over the whole frame, or a group, by a numeric column and then ties."""
    keys = [*by, "__gw_r"]
    ranged = in_ranges(df, by, order)
    sizes = ranged.groupBy(*keys).agg(F.count("*").alias("__gw_n"))
    start = sizes.select(*keys, F.coalesce(F.sum("__gw_n").over(W.partitionBy(*by).orderBy("__gw_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__gw_b"))
    own = F.row_number().over(W.partitionBy(*keys).orderBy(order, *ties))
    on = ranged.withColumn(name, own).join(start if by else F.broadcast(start), keys)
    return on.withColumn(name, (F.col(name) + F.col("__gw_b")).cast("long")).drop("__gw_r", "__gw_b")


def nth_value(df: DataFrame, by: Sequence[str], value: str, rank: Column, name: str) -> DataFrame:
    """(by, name, n): the value of the given rank, from 1; ``rank`` may use n, the rows of the group."""
    places = counts_below(df, by, value)
    total = df.groupBy(*by).agg(F.count("*").alias("__gw_n"))
    on = places.join(total, list(by)) if by else places.crossJoin(F.broadcast(total))
    at = on.withColumnRenamed("n", "__gw_c").withColumnRenamed("__gw_n", "n").withColumn("__gw_k", rank)
    return at.filter((F.col("below") < F.col("__gw_k")) & (F.col("__gw_k") <= F.col("below") + F.col("__gw_c"))).select(*by, F.col(value).alias(name), "n")


def medians(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, name): exact medians, by the two middle values; null values do not count."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value)
    places = counts_below(ok, by, value)
    total = places.groupBy(*by).agg(F.sum("n").alias("__gw_n"))
    on = places.join(total, list(by)) if by else places.crossJoin(F.broadcast(total))
    low, high = F.floor((F.col("__gw_n") + 1) / 2), F.floor((F.col("__gw_n") + 2) / 2)
    # The rows that hold the two middle places: two values, or one.
    middle = on.filter((F.col("below") < high) & (F.col("below") + F.col("n") >= low))
    return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(name))


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Column, name: str) -> DataFrame:
    """(by, name): exact percentiles of each group, in proportion between two rows, as an array in order of
    ``shares``, an array of numbers from 0 to 1 that may use n, the rows of the group. Null and nan values do not count."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value)
    places = counts_below(ok, by, value)
    total = ok.groupBy(*by).agg(F.count("*").alias("n"))
    asked = total.filter("n > 0").select(*by, F.posexplode(shares).alias("__gw_i", "__gw_q"), "n").select(*by, "__gw_i", ((F.col("n") - 1) * F.col("__gw_q")).alias("__gw_p"))
    ranks = asked.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.floor("__gw_p"), F.ceil("__gw_p"))))).alias("__gw_k"))  # two for each share
    on = places.join(ranks, list(by)) if by else places.crossJoin(F.broadcast(ranks))
    hit = F.filter("__gw_k", lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("n")))
    at = on.select(*by, F.col(value).alias("__gw_v"), F.explode(hit).alias("__gw_k"))
    low, high = at.withColumnsRenamed({"__gw_k": "__gw_l", "__gw_v": "__gw_a"}), at.withColumnsRenamed({"__gw_k": "__gw_h", "__gw_v": "__gw_b"})
    ends = asked.withColumns({"__gw_l": F.floor("__gw_p"), "__gw_h": F.ceil("__gw_p")}).join(low, [*by, "__gw_l"]).join(high, [*by, "__gw_h"])
    between = F.col("__gw_a") + (F.col("__gw_p") - F.col("__gw_l")) * (F.col("__gw_b") - F.col("__gw_a"))
    return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__gw_i", between.alias("v")))), lambda x: x["v"]).alias(name))


def cumulated(df: DataFrame, by: Sequence[str], key: str, weight: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of weights up to each row, and ``name``_before, that of the rows before it, in
    order of a numeric key; ranges of it are added up alone."""
    keys = [*by, "__gw_r"]
    ranged = in_ranges(df, by, key)
    sums = ranged.groupBy(*keys).agg(F.sum(weight).alias("__gw_s"))
    start = sums.select(*keys, F.coalesce(F.sum("__gw_s").over(W.partitionBy(*by).orderBy("__gw_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__gw_b"))
    inside = W.partitionBy(*keys).orderBy(key)
    own = F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    on = ranged.withColumns({name: own, f"{name}_before": before}).join(start if by else F.broadcast(start), keys)
    return on.withColumns({c: F.col(c) + F.col("__gw_b") for c in (name, f"{name}_before")}).drop("__gw_r", "__gw_b")
