"""Ranks and exact quantiles of any number of values, without a task that sorts or holds them all.

Equal values are counted first.  Cut points, drawn by hash from the different
values, put them into buckets in the order of the values; a bucket is summed up
by one task, and what lies before it is a sum over the buckets' totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cut points of a group; each bucket then holds about so small a part of its different values.
BUCKETS = 256


def running(counts: DataFrame, value: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before`` (sum of ``n`` over the smaller values of the group) and ``total`` (over all of them).

    ``counts`` has one row per group and value, neither of them NULL.
    """
    by = list(by)
    drawn = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.xxhash64(value), value))
    cuts = counts.select(*by, value, drawn.alias("__k")).filter(F.col("__k") <= BUCKETS).groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("__cuts"))
    # Without groups the cut points are one row.
    placed = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))
    placed = placed.withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c <= F.col(value)))).drop("__cuts")
    sums = placed.groupBy(*by, "__bucket").agg(F.sum(n).alias("__sum"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # at most BUCKETS + 1 rows a group
    ahead = F.sum("__sum").over(group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__bucket", F.coalesce(ahead, F.lit(0)).alias("__ahead"), F.sum("__sum").over(group).alias("total"))
    inside = F.sum(n).over(Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(sums, [*by, "__bucket"]).withColumn("before", F.col("__ahead") + F.coalesce(inside, F.lit(0))).drop("__bucket", "__ahead")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by..., q``: the exact quantiles, linearly interpolated, of the values that are known; a group without any has no row.

    Without ``by`` there is one row, and ``q`` is NULL where no value is known.
    """
    by = list(by)
    counts = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    ranked = running(counts, "__v", "__n", by)
    place = [(F.col("total") - 1) * F.lit(float(s)) for s in shares]
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("__n")), F.col("__v")))
    found = ranked.groupBy(*by).agg(
        F.max("total").alias("total"),
        *(holds(F.floor(p)).alias(f"__lo{i}") for i, p in enumerate(place)),
        *(holds(F.ceil(p)).alias(f"__hi{i}") for i, p in enumerate(place)),
    )
    part = [p - F.floor(p) for p in place]
    lo, hi = ([F.col(f"__{side}{i}") for i in range(len(place))] for side in ("lo", "hi"))
    q = F.array(*(F.when(a == b, a).otherwise(a * (1 - p) + b * p) for a, b, p in zip(lo, hi, part, strict=True)))
    return found.select(*by, F.when(F.col("total").isNotNull(), q).alias("q"))
