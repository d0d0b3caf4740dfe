"""Descriptive profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.ranks import quantiles


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per value: ``metric, value``; NaN is NULL."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.metric", F.nanvl("p.value", F.lit(None).cast("double")).alias("value"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles, max of each column, half-even to four places."""
    rows = _long(df, columns)
    r = lambda c: F.bround(c, 4)
    sums = rows.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(rows, "value", (0.25, 0.5, 0.75), ["metric"])
    return sums.join(q, "metric", "left").select(
        "metric", "n", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"), r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q50"), r(F.col("q")[2]).alias("q75"), r("max").alias("max")
    )


def low_variance(df: DataFrame, columns: list[str], least: float = 0.05) -> DataFrame:
    """Mean, deviation and median of each score and whether it hardly varies."""
    rows = _long(df, columns)
    d = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).join(quantiles(rows, "value", (0.5,), ["metric"]), "metric", "left")
    return d.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("q")[0], 6).alias("median"), F.coalesce(F.col("std") < least, F.lit(False)).alias("low_variance"))


def histogram(df: DataFrame, column: str, bins: int, positive: bool = False) -> DataFrame:
    """``bin`` (from 1), lower edge and count between the least and the greatest value."""
    x = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    x = x.filter("v > 0") if positive else x
    span = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / width) + 1)).cast("int")
    return x.crossJoin(F.broadcast(span)).groupBy(bin_of.alias("bin"), F.round(F.col("lo") + (bin_of - 1) * width, 6).alias("lower_edge")).agg(F.count("*").alias("n"))


def boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whiskers (the last values within 1.5 interquartile ranges) per group."""
    x = df.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v")).filter("grp IS NOT NULL AND v IS NOT NULL")
    q = quantiles(x, "v", (0.25, 0.5, 0.75), ["grp"])
    j = x.join(q, "grp")
    iqr = F.col("q")[2] - F.col("q")[0]
    inside = (F.col("v") >= F.col("q")[0] - 1.5 * iqr) & (F.col("v") <= F.col("q")[2] + 1.5 * iqr)
    r = lambda c, name: F.round(c, 6).alias(name)
    return j.groupBy("grp").agg(r(F.min(F.when(inside, F.col("v"))), "whisker_low"), r(F.first(F.col("q")[0]), "q25"), r(F.first(F.col("q")[1]), "q50"), r(F.first(F.col("q")[2]), "q75"), r(F.max(F.when(inside, F.col("v"))), "whisker_high"), F.count_if(~inside).alias("n_outliers"))


def top_values(df: DataFrame, column: Column, n: int = 30) -> DataFrame:
    """The ``n`` most frequent values (a top-k report), ties by value; NULL isn't a value."""
    return df.select(column.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def tool_histogram(stats: DataFrame, counts: str = "tool_call_counts") -> DataFrame:
    """Calls and trajectories per tool over all maps; spellings of a name are one tool."""
    calls = stats.select(F.explode(counts).alias("tool", "n"))
    return calls.groupBy(F.lower(F.trim("tool")).alias("tool")).agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_rows"))


def gate_summary(stats: DataFrame, ratio: float = 0.9) -> DataFrame:
    """All rows, untruncated, resolved, both - one pass."""
    t, s = F.col("truncation_ratio") >= ratio, F.col("resolved") == 1
    return stats.agg(F.count("*").alias("n_all"), F.count_if(t).alias("n_untruncated"), F.count_if(s).alias("n_resolved"), F.count_if(t & s).alias("n_pass"))


def global_summary(stats: DataFrame) -> DataFrame:
    """Rows, means and rates of the whole pool."""
    return stats.agg(
        F.count("*").alias("n"),
        F.round(F.avg("total_tokens"), 6).alias("mean_tokens"),
        F.round(F.avg("assistant_turns"), 6).alias("mean_turns"),
        F.round(F.avg((F.col("resolved") == 1).cast("int")), 6).alias("resolved_rate"),
        F.count_distinct("repo").alias("n_repos"),
    )


def outcomes(stats: DataFrame, by: list[str]) -> DataFrame:
    """Rows submitted and resolved, submitted only, neither - in all and per group."""
    submit, solved = F.col("ends_with_submit"), F.col("resolved") == 1
    return stats.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(submit & solved).alias("n_solved"),
        F.count_if(submit & ~solved).alias("n_submitted"),
        F.count_if(~submit).alias("n_error"),
    )


def category_shares(df: DataFrame, group: str, category: Column) -> DataFrame:
    """Share of each category within its group, three places."""
    by = df.groupBy(F.col(group).alias("grp"), category.alias("category")).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("grp")), 3))


def normalise_schema(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exactly the named columns with the given types; NULL where missing or not castable."""
    have = {c.lower() for c in df.columns}
    return df.select(*(F.expr(f"try_cast(`{c}` AS {t})").alias(c) if c.lower() in have else F.lit(None).cast(t).alias(c) for c, t in fields.items()))
