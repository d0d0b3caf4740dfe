"""Gate, medians and the three composite scores (P4-P20, F1-F2, A7, J1): projections over stored raw metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.config import LIMITS, V1_WEIGHTS, V2_GROUPS, Limits
from stepforge.operators.steps import entropy


def truncation_ratio(tokens: str = "total_tokens", limits: Limits = LIMITS) -> Column:
    """Share of the tokens inside the context window; 0 for no tokens, NULL for an unknown number."""
    n = F.col(tokens)
    return F.when(n.isNull(), None).when(n == 0, F.lit(0.0)).otherwise(F.least(n, F.lit(limits.context_window)) / n)


def outcome_success() -> Column:
    """P5: 1 submitted and resolved, 0.5 submitted, else 0."""
    return F.when(~F.col("ends_with_submit"), 0.0).when(F.col("resolved") == 1, 1.0).otherwise(0.5)


def observation_noise(limits: Limits = LIMITS) -> Column:
    """P6."""
    return F.when(F.col("num_observations") == 0, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("avg_observation_length") / limits.observation_chars))


def step_efficiency(kinds: Column) -> Column:
    """Kinds of tools a call, times ten, at most 1."""
    return F.when(F.col("total_tool_calls") == 0, 0.0).otherwise(F.least(F.lit(1.0), kinds / F.col("total_tool_calls") * 10))


def passes_gate(limits: Limits = LIMITS) -> Column:
    """(almost) untruncated and resolved; never NULL."""
    return F.coalesce((truncation_ratio(limits=limits) >= limits.gate_ratio) & (F.col("resolved") == 1), F.lit(False))


def weighted(weights: dict[str, float], columns: dict[str, Column] | None = None) -> Column:
    columns = columns or {}
    parts = [columns.get(k, F.col(k)) * w for k, w in weights.items()]
    return sum(parts[1:], parts[0])


def add_v1(stats: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The five dimensions and their weighted sum ``composite_q``; needs tool_call_counts."""
    counts = F.map_values("tool_call_counts")
    dims = stats.withColumns(
        {
            "truncation_ratio": truncation_ratio(limits=limits),
            "outcome_success": outcome_success(),
            "step_efficiency": step_efficiency(F.size("tool_call_counts")),
            "observation_noise": observation_noise(limits),
            "action_diversity": entropy(counts),
        }
    )
    return dims.withColumn("composite_q", weighted(V1_WEIGHTS))


def add_v2(stats_v1: DataFrame) -> DataFrame:
    """Eight dimensions in four groups; the step count is set against the median of all rows."""
    median = stats_v1.agg(F.median("assistant_turns").alias("median_turns"))
    ratio = F.when((F.col("median_turns") > 0) & (F.col("assistant_turns") > 0), F.least(F.lit(1.0), F.col("median_turns") / F.col("assistant_turns"))).otherwise(0.0)
    return (
        stats_v1.crossJoin(F.broadcast(median))
        .withColumn("step_count_ratio", ratio)
        .withColumns(
            {
                "v2_correctness": F.col("outcome_success") * 0.7 + F.col("test_alignment_score") * 0.3,
                "v2_efficiency": F.col("unique_action_ratio") * 0.5 + F.col("step_count_ratio") * 0.5,
                "v2_style": F.col("observation_noise") * 0.4 + F.col("action_diversity") * 0.4 + F.col("unique_action_ratio") * 0.2,
                "v2_completeness": F.col("truncation_ratio"),
            }
        )
        .withColumn("composite_v2", weighted({f"v2_{k}": w for k, w in V2_GROUPS.items()}))
        .drop("median_turns")
    )


def task_medians(stats: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Exact median of turns per instance over gate-passing rows."""
    return stats.filter(passes_gate(limits)).groupBy("instance_id").agg(F.median("assistant_turns").alias("median_turns"))


def step_count_score(median: Column, limits: Limits = LIMITS) -> Column:
    """1 at half the median or less, 0 at three times or more; 0.5 where there is no median or no turn."""
    r = F.greatest(F.lit(limits.step_ratio_low), F.least(F.lit(limits.step_ratio_high), F.col("assistant_turns") / median))
    return F.when((median > 0) & (F.col("assistant_turns") > 0), 1 - (r - limits.step_ratio_low) / (limits.step_ratio_high - limits.step_ratio_low)).otherwise(0.5)


def add_v3(stats_v1: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Sub-scores, group scores and ``composite_score``; NULL where the gate fails.

    One shuffle by instance: the medians are joined back to the rows.
    """
    gated = stats_v1.withColumn("passes_gate", passes_gate(limits))
    joined = gated.join(task_medians(stats_v1, limits), "instance_id", "left")
    on = lambda c: F.when(F.col("passes_gate"), c)
    return (
        joined.withColumns(
            {
                "b1_redundant_commands": on(1 - F.col("redundant_cmds_ratio")),
                "b2_error_retry": on(1 - F.least(F.lit(1.0), F.col("error_retry_count") / limits.most_cycles)),
                "b3_step_count_ratio": on(step_count_score(F.col("median_turns"), limits)),
                "c1_observation_cleanliness": on(1 - F.col("obs_noise_char_ratio")),
                "c2_action_diversity": on(F.col("action_diversity")),
                "c3_observation_utilization": on(F.col("obs_utilization_ratio")),
            }
        )
        .withColumn("efficiency_score", (F.col("b2_error_retry") + F.col("b3_step_count_ratio")) / 2)
        .withColumn("style_score", (F.col("c2_action_diversity") + F.col("c3_observation_utilization")) / 2)
        .withColumn("composite_score", F.col("efficiency_score") * 0.5 + F.col("style_score") * 0.5)
        .drop("median_turns")
    )
