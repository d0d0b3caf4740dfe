"""Named training subsets, their statistics and overlap (T1-T10, A11, O3, J8, section 2.9)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.config import LIMITS


@dataclass(frozen=True)
class Subset:
    """``order`` is SQL over the pool's columns (descending unless ``ascending``), or None for a seeded sample."""

    name: str
    pool: str  # all | gate
    order: str | None
    size: int
    ascending: bool = False


def catalogue(scale: float = 1.0) -> list[Subset]:
    """The 16 subsets of section 2.9; ``scale`` shrinks all sizes alike."""
    n = lambda k: max(1, round(k * scale))
    eff, style, b2, b3, c2, c3 = "efficiency_score", "style_score", "b2_error_retry", "b3_step_count_ratio", "c2_action_diversity", "c3_observation_utilization"
    ablations = {"NoEfficiency": style, "NoStyle": eff, "NoB2": f"0.5 * {b3} + 0.5 * {style}", "NoB3": f"0.5 * {b2} + 0.5 * {style}", "NoC2": f"0.5 * {eff} + 0.5 * {c3}", "NoC3": f"0.5 * {eff} + 0.5 * {c2}"}
    return (
        [Subset(f"Random-{k}", "all", None, n(k)) for k in (500, 1000, 2000)]
        + [Subset(f"TopQ-{k}", "gate", "composite_score", n(k)) for k in (500, 1000, 2000)]
        + [Subset(f"ResolvedOnly-{k}", "gate", None, n(k)) for k in (500, 1000)]
        + [Subset("BottomQ-500", "gate", "composite_score", n(500), ascending=True)]
        + [Subset(f"Ablation-{k}-500", "gate", order, n(500)) for k, order in ablations.items()]
        + [Subset("B2Only-Top500", "gate", b2, n(500))]
    )


def sample_key(seed: int = LIMITS.seed) -> Column:
    """The position of an id in a seeded order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("trajectory_id")))


def build(pool: DataFrame, subset: Subset, seed: int = LIMITS.seed) -> DataFrame:
    """The subset's rows: a top-k of the pool (ties by id), never a full sort; ``subset_name`` is added."""
    if subset.order is None:
        order = [sample_key(seed), F.col("trajectory_id")]
    else:
        score = F.expr(subset.order)
        order = [F.asc_nulls_last(score) if subset.ascending else F.desc_nulls_last(score), F.asc("trajectory_id")]
    return pool.orderBy(*order).limit(subset.size).withColumn("subset_name", F.lit(subset.name))


def build_all(all_pool: DataFrame, gate_pool: DataFrame, names: Iterable[str] | None = None, scale: float = 1.0, seed: int = LIMITS.seed) -> DataFrame:
    """``subset_name, trajectory_id``, the score columns and the ``order_score`` of all (or the named) subsets.

    Each pool is read once: every id is put into each of its orders, a group
    limit keeps the first of every order while still in the map tasks, and
    subsets of one order are cut by rank.  An unknown name is an error.
    """
    chosen = catalogue(scale)
    if names is not None:
        wanted = set(names)
        if unknown := wanted - {s.name for s in chosen}:
            raise ValueError(f"no such subset: {sorted(unknown)}")
        chosen = [s for s in chosen if s.name in wanted]
    out = None
    for pool, rows in (("all", all_pool), ("gate", gate_pool)):
        own = [s for s in chosen if s.pool == pool]
        orders = sorted({(s.order or "", s.ascending) for s in own})
        if not orders:
            continue
        sign = lambda up: -1 if up else 1
        key = [
            F.struct(F.lit(k).alias("o"), (F.nanvl(F.expr(order).cast("double"), F.lit(None).cast("double")) * sign(up) if order else F.lit(None).cast("double")).alias("score"), (F.lit("") if order else sample_key(seed)).alias("drawn"))
            for k, (order, up) in enumerate(orders)
        ]
        deepest = F.element_at(F.array(*(F.lit(max(s.size for s in own if (s.order or "", s.ascending) == o)) for o in orders)), F.col("o") + 1)
        rank = F.row_number().over(Window.partitionBy("o").orderBy(F.desc_nulls_last("score"), "drawn", "trajectory_id"))
        most = max(s.size for s in own)
        ranked = rows.select("*", F.explode(F.array(*key)).alias("k")).select(*rows.columns, "k.*").withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= deepest)
        table = rows.sparkSession.createDataFrame([(s.name, orders.index((s.order or "", s.ascending)), s.size) for s in own], "subset_name string, o int, size int")
        flip = F.element_at(F.array(*(F.lit(sign(up)) for _, up in orders)), F.col("o") + 1)
        built = ranked.join(F.broadcast(table), "o").filter("rank <= size").select(*rows.columns, "subset_name", (F.col("score") * flip).alias("order_score"))
        out = built if out is None else out.unionByName(built, allowMissingColumns=True)
    return out


def subset_stats(members: DataFrame) -> DataFrame:
    """Statistics per subset in one aggregation; sample standard deviation, exact medians.

    ``score_version`` says which score mean_q is: v3 where rows have one, else v1.
    """
    q = F.coalesce("composite_score", "composite_q")
    r = lambda c, name: F.round(c, 6).alias(name)
    return members.groupBy("subset_name").agg(
        F.count("*").alias("actual_size"),
        F.when(F.count("composite_score") > 0, "v3").otherwise("v1").alias("score_version"),
        r(F.avg(q), "mean_q"),
        r(F.median(q), "median_q"),
        r(F.stddev_samp(q), "std_q"),
        r(F.min(q), "min_q"),
        r(F.max(q), "max_q"),
        r(F.avg("total_tokens"), "mean_tokens"),
        r(F.median("total_tokens"), "median_tokens"),
        r(F.avg("assistant_turns"), "mean_turns"),
        r(F.avg(F.col("ends_with_submit").cast("int")), "submit_rate"),
        r(F.avg((F.col("resolved") == 1).cast("int")), "resolved_rate"),
        F.count_distinct("repo").alias("unique_repos"),
        *(r(F.avg(c), f"mean_{c}") for c in ("efficiency_score", "style_score", "b2_error_retry", "b3_step_count_ratio", "c2_action_diversity", "c3_observation_utilization", "order_score")),
        r(F.median("order_score"), "median_order_score"),
    )


def overlap(members: DataFrame) -> DataFrame:
    """O3: Jaccard of every pair of subsets, 0 for two empty ones; pairs without a common id are included.

    The pairing is by id, so its size follows the memberships of an id; only
    the table of subset sizes (one row a subset) is paired with itself.
    """
    m = members.select("subset_name", "trajectory_id").distinct()
    a, b = m.withColumnRenamed("subset_name", "a"), m.withColumnRenamed("subset_name", "b")
    common = a.join(b, "trajectory_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    sizes = m.groupBy("subset_name").agg(F.count("*").alias("n"))
    pairs = sizes.select(F.col("subset_name").alias("a"), F.col("n").alias("n_a")).join(F.broadcast(sizes.select(F.col("subset_name").alias("b"), F.col("n").alias("n_b"))), F.col("a") < F.col("b"))
    c = F.coalesce("common", F.lit(0))
    return pairs.join(common, ["a", "b"], "left").select("a", "b", "n_a", "n_b", c.alias("common"), F.round(F.coalesce(F.try_divide(c, F.col("n_a") + F.col("n_b") - c), F.lit(0.0)), 6).alias("jaccard"))

