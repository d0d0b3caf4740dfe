"""Named queries of the core operators over the tables of a data folder.

Each entry runs over its whole tables.  A limit is kept only where it is the
feature: top-k reports, named subsets and evaluation sets of a given size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.config import LIMITS
from stepforge.functions.ids import repo_key, trajectory_key
from stepforge.operators import chat, evaluation, profile, scores, statistics, subsets, testsets, textmetrics
from stepforge.operators import steps as st
from stepforge.operators.evaluation import json_texts
from stepforge.session import cut
from stepforge.sources import latest, readers, sinks, table
from stepforge.sources.tables import delivered_once, where
from stepforge.streaming.scoring import activity

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP_SIZE = 100
#: Length from which an example counts as truncated in the run counters.
COUNTED_CHARS = 20_000
#: Status stands for a model: names shown, and models by strategy and size.
SHOWN = {"submit": "Submitted", "exit_cost": "Out of budget"}
SERIES = [("cost", 500, "exit_cost"), ("cost", 1000, "submit"), ("time", 500, "timeout"), ("time", 1000, "submit"), ("time", 2000, "nowhere")]
SUB_SCORES = ["b1_redundant_commands", "b2_error_retry", "b3_step_count_ratio", "c1_observation_cleanliness", "c2_action_diversity", "c3_observation_utilization"]
DIMENSIONS = ["composite_score", "efficiency_score", "style_score", "b2_error_retry", "b3_step_count_ratio", "c2_action_diversity", "c3_observation_utilization"]


def _t(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    return lambda f: lambda spark, d: f(*(table(spark, d, n) for n in names))


def _r(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles rounded to six places, so that the order of summation doesn't show; ``exact`` columns come first."""
    cols = [*exact, *(c for c in df.columns if c not in exact)]
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols))


# --- stored raw metrics: the last row of each trajectory --------------------


def last_stats(stats: DataFrame, *columns: str) -> DataFrame:
    """The last delivery of each trajectory, ids canonical; the rule of every profile of ``stats``."""
    return latest(stats.select("trajectory_id", "ingested_at", *columns) if columns else stats, "trajectory_id", "ingested_at")


def last_scored(scored: DataFrame, *columns: str) -> DataFrame:
    """The last scoring of each trajectory, ids canonical."""
    return latest(scored.select("trajectory_id", "scored_at", *columns), "trajectory_id", "scored_at")


def pool(stats: DataFrame) -> DataFrame:
    """Ids with v1 score and status, for evaluation sets."""
    return last_stats(stats, "composite_q", "exit_status").select("trajectory_id", F.col("composite_q").alias("score"), F.coalesce("exit_status", F.lit("")).alias("exit_status"))


def gate_pool(scored: DataFrame) -> DataFrame:
    """Per trajectory the columns that subsets are ranked by."""
    return last_scored(scored, "composite_score", "efficiency_score", "style_score", *SUB_SCORES).drop("scored_at")


def all_pool(stats: DataFrame) -> DataFrame:
    """Per trajectory the columns that subset statistics need."""
    rows = last_stats(stats, "composite_q", "total_tokens", "assistant_turns", "ends_with_submit", "resolved", "repo")
    return rows.drop("ingested_at").withColumn("repo", repo_key("repo"))


def members(stats: DataFrame, scored: DataFrame) -> DataFrame:
    """All 16 subsets with the statistics columns joined to them; what is read again and again is checkpointed, some thousand rows."""
    everything = all_pool(stats)
    built = subsets.build_all(everything.select("trajectory_id"), gate_pool(scored))
    return cut(built.join(everything, "trajectory_id", "left"))


def train_ids(split_rows: DataFrame) -> DataFrame:
    return testsets.training_ids(split_rows)


def test_sets(stats: DataFrame, split_rows: DataFrame) -> DataFrame:
    return testsets.build(pool(stats), train_ids(split_rows))


# --- nested trajectories ----------------------------------------------------


def raw(trajectories: DataFrame) -> DataFrame:
    return st.trajectory_stats(trajectories)


def v1(trajectories: DataFrame) -> DataFrame:
    return scores.add_v1(raw(trajectories))


def v3(trajectories: DataFrame) -> DataFrame:
    return scores.add_v3(v1(trajectories))


def flagship(trajectories: DataFrame) -> DataFrame:
    """Nested messages to metrics, gate, medians, scores and the best rows."""
    top = v3(trajectories).filter("passes_gate").withColumn("composite_score", F.round("composite_score", 6))
    cols = ["trajectory_id", "instance_id", *SUB_SCORES, "efficiency_score", "style_score", "composite_score"]
    return _r(top.select(*cols).orderBy(F.desc("composite_score"), "trajectory_id").limit(FLAGSHIP_SIZE), "trajectory_id")


def per_observation(trajectories: DataFrame) -> DataFrame:
    """Keywords of each observation, one row each."""
    return st.steps(trajectories).select("trajectory_id", "step_idx", F.explode(F.expr(st.keywords("obs_text"))).alias("keyword"))


def messages_of(trajectories: DataFrame) -> DataFrame:
    return chat.with_chat(trajectories)


def turns_of(trajectories: DataFrame) -> DataFrame:
    return chat.with_turns(messages_of(trajectories))


def action_pairs(trajectories: DataFrame) -> DataFrame:
    """Generated against true actions: the reply after three turns stands in for a prediction of the first one."""
    both = F.struct(chat.first_action()["target"].alias("truth"), chat.prefix(3)["target"].alias("generated"))
    m = where(turns_of(trajectories), "pair", both, lambda x: x["truth"].isNotNull() & x["generated"].isNotNull())
    return m.select("trajectory_id", "pair.generated", "pair.truth")


def prompts(trajectories: DataFrame, steps: int | None) -> DataFrame:
    """Length of the prompt and the reply wanted, after ``steps`` turns or (None) for the first action."""
    rows = where(turns_of(trajectories), "p", chat.first_action() if steps is None else chat.prefix(steps), lambda p: p.isNotNull())
    return rows.select("trajectory_id", F.size("p.prompt").alias("n_prompt"), "p.target")


def action_rows(trajectories: DataFrame) -> DataFrame:
    g, t = F.col("generated"), F.col("truth")
    p = action_pairs(trajectories).withColumns({"pg": textmetrics.file_paths(g), "pt": textmetrics.file_paths(t)})
    return p.select(
        "trajectory_id",
        (textmetrics.action_type(g) == textmetrics.action_type(t)).alias("action_type_match"),
        textmetrics.action_type(g).alias("pred_action_type"),
        textmetrics.action_type(t).alias("gt_action_type"),
        textmetrics.jaccard(F.col("pg"), F.col("pt")).alias("file_match_score"),
        textmetrics.exact_match(g, t).alias("exact_match"),
        textmetrics.format_score(g).alias("format_score"),
        F.substring(g, 1, 500).alias("generated"),
    )


def next_actions(trajectories: DataFrame) -> DataFrame:
    """Pairs for each number of turns kept: the reply then wanted, in place of a model's text, and the true first action."""
    turns = turns_of(trajectories)
    replies = F.array(*(F.struct(F.lit(k).alias("n_steps"), chat.prefix(k)["target"].alias("generated"), chat.first_action()["target"].alias("truth")) for k in (3, 5, 7)))
    return turns.select("trajectory_id", F.explode(replies).alias("r")).select("trajectory_id", "r.*")


def counters(trajectories: DataFrame, split_rows: DataFrame) -> DataFrame:
    """A26 over the gold ids, with the characters of an example as its length."""
    key = trajectory_key("trajectory_id").alias("trajectory_id")
    made = chat.examples(trajectories).select(key, F.length("text").alias("length"))
    gold = split_rows.filter("split = 'gold'").select(key).filter("trajectory_id IS NOT NULL")
    return evaluation.run_counters(trajectories.select(key), gold, made, "length", COUNTED_CHARS)


def arguments(trajectories: DataFrame) -> DataFrame:
    """The arguments of every call, JSON objects in the common layout."""
    rows = delivered_once(trajectories, "trajectory_id", "trajectory")
    calls = F.expr("transform(coalesce(trajectory, array()), m -> transform(coalesce(m.tool_calls, array()), c -> c.function.arguments))")
    return rows.select("trajectory_id", F.posexplode(json_texts(calls)).alias("message", "args")).select("trajectory_id", "message", F.posexplode("args").alias("call", "arguments"))


# --- steps as token rows ----------------------------------------------------


def token_arrays(steps: DataFrame) -> DataFrame:
    """Per trajectory, in order of steps, arrays in place of a model's: tokens, losses, and labels of the shell steps only."""
    rows = steps.filter("trajectory_id IS NOT NULL AND step_idx IS NOT NULL").select("trajectory_id", "step_idx", F.lower(F.trim("tool")).alias("tool"), "n_tokens").distinct()
    label = F.when(F.col("tool") == "execute_bash", F.col("step_idx")).otherwise(F.lit(LIMITS.label_mask))
    listed = rows.groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_idx", F.col("n_tokens").cast("int").alias("n"), F.col("n_tokens").cast("double").alias("loss"), label.alias("label")))).alias("s"))
    return listed.select("trajectory_id", F.col("s.n").alias("tokens"), F.col("s.loss").alias("losses"), F.col("s.label").alias("labels"))


def padded_tokens(steps: DataFrame) -> DataFrame:
    """Token arrays filled up to the longest of their batch."""
    rows = token_arrays(steps).select("trajectory_id", "tokens", F.substring(F.md5("trajectory_id"), 1, 2).alias("batch"))
    full = evaluation.padded(rows, "batch", "tokens")
    return full.select("trajectory_id", "batch", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda x: x == LIMITS.label_mask)).alias("n_pad"))


# --- result tables ----------------------------------------------------------


def loss_rows(stats: DataFrame, split_rows: DataFrame) -> DataFrame:
    """Loss rows (model, split, trajectory_id, loss, n_tokens) in place of a model's: status as model, 1 - score as loss."""
    p = last_stats(stats, "composite_q", "exit_status", "total_tokens").select("trajectory_id", F.when(F.trim("exit_status") != "", F.lower(F.trim("exit_status"))).otherwise("none").alias("model"), (1 - F.col("composite_q")).alias("loss"), F.col("total_tokens").alias("n_tokens"))
    splits = split_rows.filter(F.col("split").isin("gold", "random", "low_q")).select("split", trajectory_key("trajectory_id").alias("trajectory_id")).distinct()
    return splits.join(p, "trajectory_id").select("model", "split", "trajectory_id", "loss", "n_tokens")


def losses(stats: DataFrame, split_rows: DataFrame) -> DataFrame:
    return statistics.loss_summary(loss_rows(stats, split_rows))


def repo_points(stats: DataFrame) -> DataFrame:
    """Mean score, turns and tokens a repository, for correlation and regression."""
    return last_stats(stats, "repo", "composite_q", "assistant_turns", "total_tokens").withColumn("repo", repo_key("repo")).filter("repo IS NOT NULL").groupBy("repo").agg(F.round(F.avg("composite_q"), 6).alias("q"), F.round(F.avg("assistant_turns"), 6).alias("turns"), F.round(F.avg("total_tokens"), 6).alias("tokens"))


def outcomes_by_status(stats: DataFrame) -> DataFrame:
    """Rows and solved rows by status, in place of metrics by model."""
    status = F.when(F.trim("exit_status") != "", F.lower(F.trim("exit_status"))).otherwise("none").alias("model")
    return last_stats(stats, "exit_status", "resolved").groupBy(status).agg(F.count("*").alias("n"), F.count_if(F.col("resolved") == 1).alias("n_solved"))


def series(stats: DataFrame, split_rows: DataFrame) -> DataFrame:
    sizes = stats.sparkSession.createDataFrame(SERIES, "strategy string, size int, model string")
    return evaluation.scaling_series(losses(stats, split_rows), sizes, "gold")


def named_losses(stats: DataFrame, split_rows: DataFrame) -> DataFrame:
    return losses(stats, split_rows).select("split", evaluation.display_name(F.col("model"), SHOWN).alias("name"), "mean_loss")


def _spearman(stats: DataFrame) -> DataFrame:
    s = statistics.spearman(repo_points(stats), "turns", "q")
    return s.withColumn("interpretation", statistics.interpretation(F.col("rho")))


def _merge(scored: DataFrame) -> DataFrame:
    old, new = (scored.filter(f"passes_gate AND {c}") for c in ("resolved = 1 AND assistant_turns < 20", "assistant_turns >= 15"))
    tagged = lambda d, tag: d.select("trajectory_id").distinct().withColumn("origin", F.lit(tag))
    return sinks.merge_results(tagged(old, "existing"), tagged(new, "new"), ["trajectory_id"])


def _catalogue_query(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        spec = next(s for s in subsets.catalogue() if s.name == name)
        rows = all_pool(table(spark, d, "stats")).select("trajectory_id") if spec.pool == "all" else gate_pool(table(spark, d, "scored"))
        return subsets.build(rows, spec).select("subset_name", "trajectory_id")

    return run


def subset_query_name(name: str) -> str:
    return "subset_" + name.lower().replace("-", "_")


def queries() -> dict[str, Query]:
    t, s, c, p, e = _t("trajectories"), _t("stats"), _t("scored"), _t("steps"), _t("experiments")
    q: dict[str, Query] = {
        "flagship": t(flagship),
        "action_obs_pairing": t(st.steps),
        "raw_metrics": t(lambda x: _r(raw(x).drop("tool_call_counts"), "trajectory_id")),
        "redundant_cmds": t(lambda x: _r(raw(x).select("trajectory_id", "redundant_cmds_ratio"))),
        "error_retry": t(lambda x: raw(x).select("trajectory_id", "error_retry_count", "total_action_pairs")),
        "obs_noise": t(lambda x: _r(raw(x).select("trajectory_id", "obs_noise_char_ratio"))),
        "obs_keywords": t(per_observation),
        "obs_utilization": t(lambda x: _r(raw(x).select("trajectory_id", "obs_utilization_ratio"))),
        "unique_action_ratio": t(lambda x: _r(raw(x).select("trajectory_id", "unique_action_ratio", "test_alignment_score"))),
        "tool_counts": t(lambda x: raw(x).select("trajectory_id", F.explode("tool_call_counts").alias("tool", "n"))),
        "token_totals": t(lambda x: raw(x).select("trajectory_id", "total_tokens")),
        "action_entropy": t(lambda x: _r(v1(x).select("trajectory_id", "action_diversity"))),
        "score_v1": t(lambda x: _r(v1(x).select("trajectory_id", "truncation_ratio", "outcome_success", "step_efficiency", "observation_noise", "action_diversity", "composite_q"))),
        "score_v2": t(lambda x: _r(scores.add_v2(v1(x)).select("trajectory_id", "step_count_ratio", "v2_correctness", "v2_efficiency", "v2_style", "v2_completeness", "composite_v2"))),
        "score_v3": t(lambda x: _r(v3(x).select("trajectory_id", "passes_gate", *SUB_SCORES, "efficiency_score", "style_score", "composite_score"))),
        "task_median": t(lambda x: scores.task_medians(raw(x))),
        "gate_filter": s(lambda x: _r(x.filter(scores.passes_gate()).select("trajectory_id", "total_tokens", scores.truncation_ratio().alias("truncation_ratio")).distinct())),
        "outcome_flags": s(lambda x: x.select("trajectory_id", (F.lower(F.trim(F.coalesce("exit_status", F.lit("")))) == "submit").alias("submitted"), scores.outcome_success().alias("outcome")).distinct()),
        "tool_histogram": s(lambda x: profile.tool_histogram(last_stats(x, "tool_call_counts"))),
        "outcome_composition": s(lambda x: profile.outcomes(by_repo(last_stats(x, "repo", "ends_with_submit", "resolved")), ["repo"])),
        "global_summary": s(lambda x: profile.global_summary(by_repo(last_stats(x, "repo", "total_tokens", "assistant_turns", "resolved")))),
        "gate_summary": s(lambda x: profile.gate_summary(last_stats(x, "truncation_ratio", "resolved"))),
        "top_repos": s(lambda x: profile.top_values(last_stats(x, "repo"), repo_key("repo"))),
        "describe_scored": c(lambda x: profile.describe(last_scored(x, *DIMENSIONS), DIMENSIONS)),
        "dim_variance": c(lambda x: profile.low_variance(last_scored(x, *SUB_SCORES), SUB_SCORES)),
        "histogram_tokens": s(lambda x: profile.histogram(last_stats(x, "total_tokens"), "total_tokens", 80, positive=True)),
        "histogram_turns": s(lambda x: profile.histogram(last_stats(x, "assistant_turns"), "assistant_turns", 50)),
        "histogram_composite": c(lambda x: profile.histogram(last_scored(x, "composite_score"), "composite_score", 40)),
        "boxplot_composite": c(lambda x: profile.boxplot(by_repo(last_scored(x, "repo", "composite_score")), "repo", "composite_score")),
        "schema_normalise": c(lambda x: _r(sinks.publishable(x).distinct(), "trajectory_id")),
        "subset_stats": _t("stats", "scored")(lambda a, b: subsets.subset_stats(members(a, b))),
        "subset_overlap": _t("stats", "scored")(lambda a, b: subsets.overlap(members(a, b))),
        "subset_outcomes": _t("stats", "scored")(lambda a, b: profile.outcomes(members(a, b), ["subset_name"])),
        "training_ids": _t("split_rows")(train_ids),
        "quantile_filter": s(lambda x: testsets.quality_pool(pool(x), 0.9, True, ("submit", "success", "resolved"), 1).select("trajectory_id")),
        "relaxed_pool": s(lambda x: testsets.quality_pool(pool(x), 0.1, False, ("failed",), 10_000).select("trajectory_id")),
        "exclude_chain": _t("stats", "split_rows")(lambda a, b: readers.with_ids(pool(a).select("trajectory_id"), train_ids(b), "left_anti")),
        "testsets": _t("stats", "split_rows")(test_sets),
        "testset_audit": _t("stats", "split_rows")(lambda a, b: testsets.audit(test_sets(a, b), train_ids(b))),
        "leakage_audit": _t("split_rows")(lambda x: testsets.audit(x.filter(F.col("split") != "train"), train_ids(x))),
        "fetch_rows": _t("trajectories", "split_rows")(lambda a, b: readers.with_ids(a.select("trajectory_id", "exit_status", "resolved"), b.filter(F.col("split") == "gold")).distinct()),
        "experiment_subsets": _t("experiments", "split_rows")(experiment_subsets),
        "resume_unseen": _t("trajectories", "stats")(lambda a, b: readers.unseen(a, b.filter("resolved = 1")).select("trajectory_id").distinct()),
        "chat_render": t(lambda x: messages_of(x).select("trajectory_id", chat.render().alias("text"))),
        "assistant_spans": t(lambda x: chat.examples(x).select("trajectory_id", F.posexplode("spans").alias("k", "s")).select("trajectory_id", "k", F.col("s.begin").alias("span_begin"), F.col("s.end").alias("span_end"))),
        "seq_lengths": t(lambda x: chat.examples(x).select("trajectory_id", F.length("text").alias("n_chars"), chat.span_chars().alias("n_label_chars"))),
        "label_tokens": t(lambda x: chat.label_mask(chat.examples(x)).select("trajectory_id", F.size("input_ids").alias("n_tokens"), F.expr("size(filter(labels, v -> v != -100))").alias("n_labels"))),
        "prefix_truncation": t(lambda x: prompts(x, 3)),
        "prefix_truncation_5": t(lambda x: prompts(x, 5)),
        "prefix_truncation_7": t(lambda x: prompts(x, 7)),
        "first_action": t(lambda x: prompts(x, None)),
        "action_type": t(lambda x: action_rows(x).select("trajectory_id", "pred_action_type", "gt_action_type", "action_type_match")),
        "format_score": t(lambda x: action_rows(x).select("trajectory_id", "format_score")),
        "path_extract": t(lambda x: action_pairs(x).select("trajectory_id", F.explode(textmetrics.file_paths(F.col("truth"))).alias("path"))),
        "path_jaccard": t(lambda x: _r(action_rows(x).select("trajectory_id", "file_match_score"))),
        "exact_match": t(lambda x: action_rows(x).select("trajectory_id", "exact_match")),
        "rouge_l": t(lambda x: _r(action_pairs(x).select("trajectory_id", textmetrics.rouge_l("generated", "truth").alias("rouge_l")))),
        "bleu4": t(lambda x: _r(action_pairs(x).select("trajectory_id", textmetrics.bleu4("generated", "truth").alias("bleu4")))),
        "action_summary": t(lambda x: action_rows(x).agg(F.count("*").alias("n_evaluated"), F.round(F.avg(F.col("action_type_match").cast("int")), 6).alias("action_type_acc"), F.round(F.avg("file_match_score"), 6).alias("file_match"), F.round(F.avg("format_score"), 6).alias("format_score"), F.round(F.avg(F.col("exact_match").cast("int")), 6).alias("exact_match"))),
        "category_dist": t(lambda x: profile.category_shares(action_rows(x).withColumn("grp", F.lit("all")), "grp", F.col("gt_action_type"))),
        "loss_summary": _t("stats", "split_rows")(losses),
        "loss_pivot": _t("stats", "split_rows")(lambda a, b: statistics.loss_pivot(losses(a, b))),
        "ablation_delta": _t("stats", "split_rows")(lambda a, b: statistics.relative_delta(losses(a, b), "submit")),
        "impact_rank": _t("stats", "split_rows")(lambda a, b: statistics.impact_rank(statistics.relative_delta(losses(a, b), "submit"), "submit").select("model", "split", "impact")),
        "quality_gradient": _t("stats", "split_rows")(lambda a, b: statistics.quality_gradient(losses(a, b))),
        "scaling_delta": _t("stats", "split_rows")(lambda a, b: statistics.scaling(losses(a, b), a.sparkSession.createDataFrame([("cost", "exit_cost", "submit"), ("time", "timeout", "submit")], "strategy string, small string, large string"))),
        "mann_whitney": s(lambda x: _r(statistics.mann_whitney(last_stats(x, "composite_q", "has_patch"), "composite_q", F.col("has_patch")))),
        "spearman": s(_spearman),
        "linear_fit": s(lambda x: statistics.linear_fit(repo_points(x), "turns", "tokens")),
        "bootstrap_mean": s(lambda x: statistics.bootstrap_mean(repo_points(x), "q", ["q", "repo"])),
        "bootstrap_band": s(lambda x: statistics.bootstrap_band(repo_points(x), "turns", "q", [10.0, 20.0, 40.0], ["repo"])),
        "mann_whitney_p": s(lambda x: _r(evaluation.mann_whitney_test(last_stats(x, "composite_q", "has_patch"), "composite_q", F.col("has_patch")))),
        "spearman_p": s(lambda x: evaluation.spearman_test(repo_points(x), "turns", "q")),
        "masked_loss": p(lambda x: _r(token_arrays(x).select("trajectory_id", evaluation.masked_loss(F.col("losses"), F.col("labels")).alias("loss")))),
        "padded_batches": p(padded_tokens),
        "next_action_summary": t(lambda x: evaluation.action_summary(next_actions(x), ["n_steps"]).drop("bleu4", "rouge_l")),
        "next_action_text": t(lambda x: evaluation.action_summary(next_actions(x), ["n_steps"]).select("n_steps", "bleu4", "rouge_l")),
        "seq_summary": t(lambda x: evaluation.sequence_summary(chat.examples(x).select(F.length("text").alias("n"), chat.span_chars().alias("labelled")), "n", "labelled")),
        "run_counters": _t("trajectories", "split_rows")(counters),
        "json_arguments": t(arguments),
        "model_losses": _t("stats", "split_rows")(lambda a, b: evaluation.model_losses(outcomes_by_status(a), losses(a, b), "gold")),
        "scaling_series": _t("stats", "split_rows")(series),
        "display_names": _t("stats", "split_rows")(named_losses),
        "incremental_merge": c(_merge),
        "seq_stats_steps": p(lambda x: x.select("trajectory_id", "step_idx", "n_tokens").distinct().agg(F.count("*").alias("n"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"), F.round(F.avg("n_tokens"), 6).alias("mean"), F.median("n_tokens").alias("median"))),
        "experiment_matrix": e(lambda x: x.distinct().groupBy("hypothesis").agg(F.count("*").alias("n"), F.round(F.sum("est_gpu_hours"), 6).alias("gpu_hours"))),
        "activity_windows": _t("events")(activity),
    }
    for spec in subsets.catalogue():
        q[subset_query_name(spec.name)] = _catalogue_query(spec.name)
    return q


def by_repo(rows: DataFrame) -> DataFrame:
    """``rows`` with the canonical repository."""
    return rows.withColumn("repo", repo_key("repo"))


def experiment_subsets(experiments: DataFrame, split_rows: DataFrame) -> DataFrame:
    """Trajectories of each experiment's subset; blanks and case in names of subsets make no difference."""
    name = lambda c: F.lower(F.trim(c)).alias("subset")
    ids = split_rows.select(name("subset_name"), trajectory_key("trajectory_id").alias("trajectory_id")).filter("trajectory_id IS NOT NULL").distinct().groupBy("subset").agg(F.count("*").alias("n"))
    return experiments.select(F.trim("name").alias("name"), name("subset")).distinct().join(ids, "subset").select("name", "subset", "n")
