"""Aggregates that have no built-in twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.joins import salted_join
from pagewright.sources.storage import store

#: Ranges that a key's values are cut into before the one that holds the median is looked at.
PARTS = 64


def median_or_zero(value):
    """[D2, D3] The median, with the mean of the middle two; 0 without values."""
    return F.coalesce(F.median(value), F.lit(0.0))


def weighted_lower_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str, parts: int = PARTS) -> DataFrame:
    """[D4] Per key, the first value whose cumulative weight reaches half of all; rows without weight don't count. Nulls are a key like others.

    Equal values of a key are summed as they are read. A mergeable summary, approximate percentiles, cuts each key's values into ``parts`` ranges; sums of the ranges, at most ``parts`` + 1 a key,
    say exactly which one holds the median and what weighs before it, and only that one's values are sorted. So a key with any share of the rows is as many tasks as others, but for that range.
    """
    key = F.struct(*keys)
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(key.alias("k"), F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    summed = store(rows, "median-values")
    cuts = summed.groupBy("k").agg(F.percentile_approx("v", [n / parts for n in range(1, parts)], 1000).alias("cuts"))
    placed = salted_join(summed, store(cuts, "median-cuts"), ["k"], ["v"], how="inner")
    placed = store(placed.select("k", "v", "w", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part")), "median-placed")
    by = Window.partitionBy("k")
    sums = placed.groupBy("k", "part").agg(F.sum("w").alias("own"))
    running = sums.select("k", "part", "own", F.sum("own").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("own").over(by).alias("all"))
    middle = running.where((F.col("upto") * 2 >= F.col("all")) & ((F.col("upto") - F.col("own")) * 2 < F.col("all"))).select("k", "part", (F.col("upto") - F.col("own")).alias("before"), "all")
    inside = placed.join(middle, ["k", "part"]).withColumn("upto", F.col("before") + F.sum("w").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.where(F.col("upto") * 2 >= F.col("all")).groupBy("k").agg(F.min("v").alias(name)).select("k.*", name)
