"""Rank tests, correlation, regression and bootstrap (section 2.12, W7-W9), as aggregations."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.config import LIMITS
from stepforge.operators.ranks import running


def value_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """W7 per distinct value: ``value, ties, n1, rank`` (the average rank), from sums over counts in buckets."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"), F.count_if(F.col(group)).alias("n1"))
    return running(counts, value, "ties").withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2)


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """M1, M2: one row with n1, n2, U of the rows where ``first`` holds, tie sum and P(X > Y) + P(X = Y) / 2."""
    marked = df.select(F.col(value).cast("double").alias("v"), F.coalesce(first, F.lit(False)).alias("g"))
    r = value_ranks(marked, "v", "g")
    agg = r.agg(
        F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.col("ties") - F.col("n1")), F.lit(0)).alias("n2"),
        F.sum(F.col("rank") * F.col("n1")).alias("r1"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie_sum"),
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return agg.select("n1", "n2", u.alias("u"), "tie_sum", F.round(F.try_divide(u, F.col("n1") * F.col("n2")), 6).alias("prob_superiority"))


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney_p(n1: int, n2: int, u: float, tie_sum: float = 0.0, alternative: str = "two-sided") -> float:
    """Tie-corrected normal approximation with continuity correction; NaN where a group is empty or all values tie."""
    n = n1 + n2
    if not n1 or not n2 or n < 2:
        return math.nan
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - tie_sum / (n * (n - 1))))
    if not sd:
        return math.nan
    mean = n1 * n2 / 2
    if alternative == "greater":
        return normal_tail((u - mean - 0.5) / sd)
    if alternative == "less":
        return normal_tail((mean - u - 0.5) / sd)
    return min(1.0, 2 * normal_tail((abs(u - mean) - 0.5) / sd))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """M3: one row with n and rho over rows where both are known; NULL below three rows or for a constant."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    ranked = rows
    for c in "xy":
        counts = rows.groupBy(c).agg(F.count("*").alias("t"))
        ranks = running(counts, c, "t").select(c, (F.col("before") + (F.col("t") + 1) / 2).alias(f"r{c}"))
        ranked = ranked.join(ranks, c)
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 3, rho), 6).alias("rho"))


def spearman_p(ranks_x: list[float], ranks_y: list[float]) -> float:
    """Two-sided p: exact by permutation up to eight pairs, else from the t distribution."""
    n = len(ranks_x)
    mx, my = sum(ranks_x) / n, sum(ranks_y) / n
    dot = lambda ys: sum((a - mx) * (b - my) for a, b in zip(ranks_x, ys, strict=True))
    seen = abs(dot(ranks_y))
    if n <= 8:
        perms = list(itertools.permutations(ranks_y))
        return sum(abs(dot(p)) >= seen - 1e-9 for p in perms) / len(perms)
    return correlation_p(n, dot(ranks_y) / math.sqrt(sum((a - mx) ** 2 for a in ranks_x) * sum((b - my) ** 2 for b in ranks_y)))


def correlation_p(n: int, rho: float) -> float:
    """Two-sided p of a correlation of ``n`` pairs, from the t distribution; NaN below three."""
    if n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - rho * rho)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d, value = 1.0, 0.0, 1.0
    for m in range(400):
        k = m // 2
        if m == 0:
            term = 1.0
        elif m % 2 == 0:
            term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            term = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        value *= c * d
        if m and abs(1 - c * d) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * (value - 1) / a


def interpretation(rho: Column) -> Column:
    """M4; rho of exactly -0.4 is moderate."""
    return (
        F.when(rho.isNull() | F.isnan(rho), "N/A (constant)")
        .when(rho < -0.7, "strong negative")
        .when(rho <= -0.4, "moderate negative")
        .when(rho < 0.4, "weak")
        .when(rho < 0.7, "moderate positive")
        .otherwise("strong positive")
    )


def stars(p: Column) -> Column:
    """M8."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """M5: least-squares line."""
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.regr_count(y, x).alias("n"))


def _draws(points: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Hash-picked resamples of numbered points (``k`` from 0, ``n`` in all): every round draws n of them.

    The points of one resample are those of a small result table (one a model
    or one a test case), so rounds times n rows are spread over the rounds.
    """
    n = points.agg(F.count("*").alias("n"))
    slots = points.sparkSession.range(rounds).withColumnRenamed("id", "round").crossJoin(F.broadcast(n)).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round"), F.col("slot"))), 1, 12), 16, 10).cast("long") % F.col("n")
    return slots.withColumn("k", pick).join(points, "k")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Numbers the rows of a small result table from 0."""
    return df.withColumn("k", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def bootstrap_mean(df: DataFrame, value: str, order: list[str], rounds: int = LIMITS.bootstrap_rounds, seed: int = LIMITS.seed) -> DataFrame:
    """M7: mean and its 95 percent bootstrap interval."""
    points = numbered(df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), *[c for c in order if c != value]), [c if c != value else "v" for c in order]).select("k", "v")
    means = _draws(points, rounds, seed).groupBy("round").agg(F.avg("v").alias("m"))
    interval = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return points.agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n")).crossJoin(F.broadcast(interval)).select("n", "mean", F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"))


def bootstrap_band(df: DataFrame, x: str, y: str, at: list[float], order: list[str], rounds: int = LIMITS.bootstrap_rounds, seed: int = LIMITS.seed) -> DataFrame:
    """M6: the fitted line at points ``at`` and its 95 percent band, clipped to [0, 1].

    A resample of a single point falls back to the line of all points.
    """
    points = numbered(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *order), order).select("k", "x", "y")
    full = points.agg(F.regr_slope("y", "x").alias("s0"), F.regr_intercept("y", "x").alias("i0"))
    fits = _draws(points, rounds, seed).groupBy("round").agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i")).crossJoin(F.broadcast(full))
    grid = fits.withColumn("at", F.explode(F.array(*map(F.lit, at))))
    line = F.coalesce(F.col("s"), F.col("s0")) * F.col("at") + F.when(F.col("s").isNull(), F.col("i0")).otherwise(F.col("i"))
    clip = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    return (
        grid.groupBy("at")
        .agg(F.percentile(line, F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.first(F.col("s0") * F.col("at") + F.col("i0")).alias("fit"))
        .select("at", F.round("fit", 6).alias("fit"), clip(F.col("p")[0]).alias("lo"), clip(F.col("p")[1]).alias("hi"))
    )


def relative_delta(summary: DataFrame, reference: str, value: str = "mean_loss") -> DataFrame:
    """Change of each model against the reference of the same split, in percent."""
    ref = summary.filter(F.col("model") == reference).select("split", F.col(value).alias("ref"))
    return summary.join(ref, "split", "left").select("model", "split", value, F.round((F.col(value) - F.col("ref")) / F.col("ref") * 100, 6).alias("delta_pct"))


def impact_rank(deltas: DataFrame, reference: str) -> DataFrame:
    """Rank of each model by delta within its split, ties by model."""
    w = Window.partitionBy("split").orderBy(F.desc_nulls_last("delta_pct"), "model")
    return deltas.filter(F.col("model") != reference).withColumn("impact", F.row_number().over(w))


def quality_gradient(summary: DataFrame) -> DataFrame:
    """Whether loss rises from gold over random to low_q, per model."""
    p = summary.groupBy("model").pivot("split", ["gold", "random", "low_q"]).agg(F.bround(F.avg("mean_loss"), 4))
    return p.withColumn("monotone", F.coalesce((F.col("gold") < F.col("random")) & (F.col("random") < F.col("low_q")), F.lit(False)))


def scaling(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (strategy, small, large) set the small model's means against the large one's."""
    a = summary.select(F.col("model").alias("small"), "split", F.col("mean_loss").alias("loss_small"))
    b = summary.select(F.col("model").alias("large"), "split", F.col("mean_loss").alias("loss_large"))
    return a.join(F.broadcast(pairs), "small").join(b, ["large", "split"]).select("strategy", "split", "small", "large", "loss_small", "loss_large", F.round(F.col("loss_large") - F.col("loss_small"), 6).alias("delta"))


def loss_summary(loss_rows: DataFrame) -> DataFrame:
    """Per (model, split): mean, population deviation, perplexity = exp(mean), valid and failed rows."""
    x = F.nanvl(F.col("loss").cast("double"), F.lit(None).cast("double"))
    return loss_rows.groupBy("model", "split").agg(
        F.round(F.avg(x), 6).alias("mean_loss"),
        F.round(F.stddev_pop(x), 6).alias("std_loss"),
        F.round(F.exp(F.avg(x)), 6).alias("perplexity"),
        F.count(x).alias("n_valid"),
        F.count_if(x.isNull()).alias("n_failed"),
        F.round(F.avg("n_tokens"), 6).alias("mean_tokens"),
    )


def loss_pivot(summary: DataFrame) -> DataFrame:
    """Mean loss by model and split."""
    return summary.groupBy("model").pivot("split", ["gold", "random", "low_q"]).agg(F.bround(F.avg("mean_loss"), 4))
