"""Fixed schemas at the boundaries; nothing is inferred."""

from __future__ import annotations

TRAJECTORIES = (
    "trajectory_id string, instance_id string, repo string, exit_status string, resolved int, model_patch string, "
    "trajectory array<struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>"
)
STATS = (
    "trajectory_id string, instance_id string, repo string, total_tokens bigint, assistant_turns bigint, "
    "tool_call_counts map<string,bigint>, total_tool_calls bigint, exit_status string, ends_with_submit boolean, "
    "is_error_or_timeout boolean, resolved bigint, has_patch boolean, patch_length bigint, avg_observation_length double, "
    "num_observations bigint, unique_action_ratio double, test_alignment_score double, redundant_cmds_ratio double, "
    "error_retry_count bigint, total_action_pairs bigint, obs_noise_char_ratio double, obs_utilization_ratio double, "
    "truncation_ratio double, outcome_success double, step_efficiency double, observation_noise double, "
    "action_diversity double, composite_q double"
)
LOSS_RESULTS = "map<string,map<string,struct<mean_loss: double, std_loss: double, perplexity: double, losses: array<double>, n_valid: bigint, n_failed: bigint, mean_assistant_tokens: double>>>"
#: The columns of a published subset row, in order.
PUBLISHED = {
    "trajectory_id": "string", "instance_id": "string", "repo": "string", "total_tokens": "bigint",
    "assistant_turns": "bigint", "total_tool_calls": "bigint", "exit_status": "string", "ends_with_submit": "boolean",
    "is_error_or_timeout": "boolean", "resolved": "bigint", "has_patch": "boolean", "patch_length": "bigint",
    "avg_observation_length": "double", "num_observations": "bigint", "truncation_ratio": "double",
    "composite_Q": "double", "passes_gate": "boolean", "b1_redundant_commands": "double", "b2_error_retry": "double",
    "b3_step_count_ratio": "double", "c1_observation_cleanliness": "double", "c2_action_diversity": "double",
    "c3_observation_utilization": "double", "efficiency_score": "double", "style_score": "double",
    "composite_score": "double",
}
