"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import capping, grouped_split, leakage, mixing, overlap, packing, runs, sampling, splitting, toxicity
from stepforge.sources import table

#: Production parameters of the queries.
CAP_COUNT = 40
CAP_SHARE = 0.01
SAMPLE_RATE = 0.1
PIECE_OVERLAP = 512

Query = Callable[[SparkSession, str], DataFrame]


def _t(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    return lambda f: lambda spark, d: f(*(table(spark, d, n) for n in names))


def _found_overlaps(split_rows: DataFrame, steps: DataFrame) -> DataFrame:
    return overlap.overlaps(split_rows, steps).select("row_a", "row_b").distinct()


def _pack(experiments: DataFrame, split_rows: DataFrame, stats: DataFrame) -> DataFrame:
    return packing.pack(packing.experiment_items(experiments, split_rows, stats))


def _capped_report(stats: DataFrame, scored: DataFrame) -> DataFrame:
    rows = capping.contributions(stats, scored)
    return capping.report(rows, capping.cap_share(rows, CAP_SHARE))


def _split(experiments: DataFrame, stats: DataFrame, steps: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Pieces for every context_length of the experiments; the overlap is at most half of it."""
    lengths = sorted(r[0] for r in experiments.filter("context_length > 0").select("context_length").distinct().collect())  # one a kind of experiment
    return splitting.split_all(stats, steps, trajectories, {n: min(PIECE_OVERLAP, n // 2) for n in lengths})


def _split_report(*tables: DataFrame) -> DataFrame:
    pieces = _split(*tables)
    return pieces.groupBy("context_length", "cut").agg(F.count("*").alias("n_pieces"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.max("n_tokens").alias("most_tokens"))


def _pack_totals(*tables: DataFrame) -> DataFrame:
    """Per experiment what packing must keep: trajectories and tokens, no sequence overfull, nothing cut that fits."""
    placed = _pack(*tables)
    used = placed.groupBy("experiment", "context_length", "bin").agg(F.sum("tokens").alias("used")).groupBy("experiment").agg(F.count_if(F.col("used") > F.col("context_length")).alias("n_overfull"))
    of = placed.groupBy("experiment", "context_length", "trajectory_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    kept = of.groupBy("experiment", "context_length").agg(F.count("*").alias("n_trajectories"), F.sum("tokens").alias("tokens"), F.count_if(F.col("pieces") > F.ceil(F.col("tokens") / F.col("context_length"))).alias("n_cut_needlessly"))
    return kept.join(used, "experiment").select("experiment", "context_length", "n_trajectories", "tokens", "n_overfull", "n_cut_needlessly")


def _split_totals(*tables: DataFrame) -> DataFrame:
    """Per limit what splitting must keep: trajectories and tokens, no piece too long, no gap."""
    pieces = _split(*tables)
    own = F.col("n_tokens") - F.col("overlap")
    of = pieces.groupBy("context_length", "trajectory_id").agg(F.sum(own).alias("tokens"), F.max("end_token").alias("end"), F.count_if(F.col("n_tokens") > F.col("context_length")).alias("long"))
    return of.groupBy("context_length").agg(F.count("*").alias("n_trajectories"), F.sum("tokens").alias("tokens"), F.sum("long").alias("n_too_long"), F.count_if(F.col("tokens") != F.col("end")).alias("n_gaps"))


def _purity(by: str) -> Query:
    """What grouped splits must keep: all rows, and no entity in two splits."""

    def of(stats: DataFrame) -> DataFrame:
        rows = grouped_split.assign(stats, by).groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("split").alias("k"))
        return rows.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"), F.count_if(F.col("k") > 1).alias("n_divided"))

    return _t("stats")(of)


def _mix_limits(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """What a mixture must keep: no text beyond its source's repeats, none twice in a source, no source without target."""
    wanted = mixing.distinct_targets(targets).select("source", "max_repeats")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"))
    mixed = mixing.mix(documents, targets).join(wanted, "source", "left").join(texts, "doc_id")
    by = mixed.groupBy("source", "text").agg(F.count("*").alias("n"), F.max("copies").alias("copies"), F.max("max_repeats").alias("most"))
    return by.agg(F.count_if(F.col("copies") > F.col("most")).alias("n_over_repeats"), F.count_if(F.col("n") > 1).alias("n_repeated_texts"), F.count_if(F.col("most").isNull()).alias("n_other_sources"))


def _toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.scores(documents, toxicity.fit(documents, labels))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _t("split_rows", "steps")(_found_overlaps),
        "p1_report": _t("split_rows", "steps", "stats")(lambda r, s, st: overlap.report(overlap.overlaps(r, s), st)),
        "p1_members": _t("split_rows", "steps")(lambda r, s: overlap.classified(r, s)[0].select("row_id", "split", "key", "class")),
        "p1_classes": _t("split_rows", "steps")(lambda r, s: overlap.classified(r, s)[1]),
        "p2_unknown": _t("experiments", "split_rows", "stats")(packing.unknown_lengths),
        "p2_pack": _t("experiments", "split_rows", "stats")(_pack),
        "p2_bins": _t("experiments", "split_rows", "stats")(lambda *a: packing.bins(_pack(*a))),
        "p2_totals": _t("experiments", "split_rows", "stats")(_pack_totals),
        "p3_cap_count": _t("stats", "scored")(lambda s, c: capping.cap_count(capping.contributions(s, c), CAP_COUNT)),
        "p3_cap_share": _t("stats", "scored")(lambda s, c: capping.cap_share(capping.contributions(s, c), CAP_SHARE)),
        "p3_report": _t("stats", "scored")(_capped_report),
        "p4_sample": _t("stats")(lambda s: sampling.sampled_ids(s, SAMPLE_RATE).select("trajectory_id", "n_rows", F.round("u", 9).alias("u"))),
        "p4_stability": _t("stats")(lambda s: sampling.stability(s, SAMPLE_RATE)),
        "p5_split": _t("experiments", "stats", "steps", "trajectories")(_split),
        "p5_report": _t("experiments", "stats", "steps", "trajectories")(_split_report),
        "p5_totals": _t("experiments", "stats", "steps", "trajectories")(_split_totals),
        "p6_by_repo": _t("stats")(lambda s: grouped_split.assign(s, "repo")),
        "p6_by_instance": _t("stats")(lambda s: grouped_split.assign(s, "instance")),
        "p6_report": _t("stats")(lambda s: grouped_split.report(grouped_split.assign(s, "repo"))),
        "p6_purity_repo": _purity("repo"),
        "p6_purity_instance": _purity("instance"),
        "p7_found": _t("steps")(lambda s: runs.runs(s).select("trajectory_id", "first_step", "last_step")),
        "p7_runs": _t("steps")(runs.runs),
        "p7_collapsed": _t("steps")(runs.collapsed),
        "p8_found": _t("documents", "eval_items")(lambda d, e: leakage.leaks(d, e).select("doc_id", "item_id")),
        "p8_items": _t("documents", "eval_items")(lambda d, e: leakage.item_report(e, leakage.leaks(d, e))),
        "p8_stock": _t("documents", "eval_items")(leakage.stock_sentences),
        "p8_clean": _t("documents", "eval_items")(lambda d, e: leakage.without_leaks(d.select("doc_id", "source", "n_chars"), leakage.leaks(d, e))),
        "p9_mix": _t("documents", "mix_targets")(mixing.mix),
        "p9_shares": _t("documents", "mix_targets")(lambda d, m: mixing.shares(mixing.mix(d, m), m)),
        "p9_limits": _t("documents", "mix_targets")(_mix_limits),
        "p10_found": _t("documents", "doc_labels")(lambda d, b: _toxic(d, b).filter("abusive").select("doc_id")),
        "p10_scores": _t("documents", "doc_labels")(_toxic),
        "p10_rates": _t("documents", "doc_labels")(lambda d, b: toxicity.rates(_toxic(d, b))),
    }
