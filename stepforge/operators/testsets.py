"""Disjoint evaluation sets and their audit (section 2.13, F3-F6, J3, O1-O2, TR1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.config import FAILURE_STATUS, LIMITS, SUCCESS_STATUS, Limits
from stepforge.functions.ids import trajectory_key
from stepforge.operators.ranks import quantiles
from stepforge.session import cut as checkpointed
from stepforge.sources.readers import with_ids


def status_in(values: tuple[str, ...]) -> Column:
    """case-insensitive membership of exit_status; NULL is in no set."""
    return F.coalesce(F.lower("exit_status").isin(*values), F.lit(False))


def training_ids(subset_rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Distinct canonical ids of the named subsets (all by default). A subset without rows is an error, not a warning."""
    rows = subset_rows.filter("subset_name IS NOT NULL")
    if names is not None:
        have = {r.subset_name for r in rows.select("subset_name").filter(F.col("subset_name").isin(*names)).distinct().collect()}
        if missing := set(names) - have:
            raise ValueError(f"no rows of training subsets {sorted(missing)}")
        rows = rows.filter(F.col("subset_name").isin(*names))
    return rows.select(trajectory_key("trajectory_id").alias("trajectory_id")).filter("trajectory_id IS NOT NULL").distinct()


def shuffled(pool: DataFrame, split: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` ids in an order seeded for the split."""
    key = F.md5(F.concat(F.lit(f"{seed}:{split}:"), F.col("trajectory_id")))
    return pool.select("trajectory_id", key.alias("k")).orderBy("k", "trajectory_id").limit(n).select(F.lit(split).alias("split"), "trajectory_id")


def quality_pool(pool: DataFrame, q: float, top: bool, status: tuple[str, ...], n: int) -> DataFrame:
    """F3 + F5: rows beyond the quantile with the status, or all beyond it if those are fewer than ``n``.

    Quantile and count are one-row aggregates joined to the pool; the driver
    isn't asked.  Without any score the status alone decides.
    """
    cut = quantiles(pool, "score", [q]).select(F.col("q")[0].alias("cut"))
    beyond = pool.crossJoin(F.broadcast(cut)).withColumn("beyond", F.coalesce((F.col("score") >= F.col("cut")) if top else (F.col("score") <= F.col("cut")), F.lit(False)) | F.col("cut").isNull())
    strict = beyond.filter("beyond").agg(F.count_if(status_in(status)).alias("n_strict"))
    return beyond.filter("beyond").crossJoin(F.broadcast(strict)).filter(status_in(status) | ((F.col("n_strict") < n) & F.col("cut").isNotNull())).select(*pool.columns)


def build(pool: DataFrame, training: DataFrame, limits: Limits = LIMITS, n: int | None = None) -> DataFrame:
    """``split, trajectory_id`` of the gold, low_q and random sets: disjoint, and free of training ids.

    ``pool`` has ``trajectory_id, score, exit_status``, one row per id; ids are
    compared and given in canonical spelling.  The narrow tables that several
    sets derive from are checkpointed, so each input is scanned once.
    """
    n = n or limits.test_set_size
    keyed = pool.withColumn("trajectory_id", trajectory_key("trajectory_id")).filter("trajectory_id IS NOT NULL").select("trajectory_id", "score", "exit_status")
    eligible = checkpointed(with_ids(keyed, training, "left_anti"))
    gold = shuffled(quality_pool(eligible, limits.test_set_quantile, True, SUCCESS_STATUS, n), "gold", n, limits.seed)
    gold = checkpointed(gold)
    rest = eligible.join(gold, "trajectory_id", "left_anti")
    low = shuffled(quality_pool(rest, 1 - limits.test_set_quantile, False, FAILURE_STATUS, n), "low_q", n, limits.seed)
    low = checkpointed(low)
    rand = shuffled(rest.join(low, "trajectory_id", "left_anti"), "random", n, limits.seed)
    return gold.unionByName(low).unionByName(rand)


def audit(test_sets: DataFrame, training: DataFrame) -> DataFrame:
    """TR1: ids of each evaluation split that training also holds; 0 for a clean split."""
    key = trajectory_key("trajectory_id").alias("trajectory_id")
    t = training.select(key).distinct().withColumn("hit", F.lit(1))
    return test_sets.select("split", key).distinct().join(t, "trajectory_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("n_leaked"))
