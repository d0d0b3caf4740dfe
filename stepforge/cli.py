"""Command line (section 2.16): ``stepforge COMMAND --help``.

Paths may lie on any file system that Spark reads.  Training and text
generation are done elsewhere; their outputs are tables that commands take.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.config import LIMITS
from stepforge.operators import chat, evaluation, scores, statistics, subsets, testsets
from stepforge.operators import steps as st
from stepforge.reports import analysis_report, dataset_card
from stepforge.session import ship
from stepforge.sources import readers, sinks


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return readers.decode_trajectory(spark.read.parquet(path))


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw metrics, gate and scores of trajectories: ``stats`` and ``scored`` below --out, and the named subsets if asked for."""
    rows = _raw(spark, a.trajectories)
    rows = readers.first_rows(rows, a.limit) if a.limit else rows
    stats = f"{a.out}/stats"
    if a.resume:
        rows = readers.unseen(rows, spark.read.parquet(stats))
    sinks_mode = sinks.append_rows if a.resume else lambda df, path: df.write.mode("overwrite").parquet(path)
    sinks_mode(scores.add_v1(st.trajectory_stats(rows)), stats)
    scored = scores.add_v3(spark.read.parquet(stats)).filter("passes_gate")
    scored.write.mode("overwrite").parquet(f"{a.out}/scored")
    if not a.skip_summary:
        sinks.write_csv(scored, f"{a.out}/scored_csv", [F.desc("composite_score"), "trajectory_id"])
    if a.export_splits:
        every, gated = spark.read.parquet(stats), spark.read.parquet(f"{a.out}/scored")
        sinks.write_splits(subsets.build_all(every.select("trajectory_id"), gated), f"{a.out}/splits")


def subset(spark: SparkSession, a: argparse.Namespace) -> None:
    """Build the named subsets from ``stats`` and ``scored`` below --scores, with metadata and a comparison table."""
    if a.list:
        print("\n".join(s.name for s in subsets.catalogue()))
        return
    every, gated = spark.read.parquet(f"{a.scores}/stats"), spark.read.parquet(f"{a.scores}/scored")
    names = [a.only] if a.only else [s.name for s in subsets.catalogue()]
    built = subsets.build_all(every.select("trajectory_id"), gated, names)
    columns = [c for c, t in every.dtypes if not t.startswith("map") and c not in built.columns]
    built.join(every.select("trajectory_id", *columns), "trajectory_id", "left").write.mode("overwrite").parquet(f"{a.out}/_members")
    rows = spark.read.parquet(f"{a.out}/_members")
    for name in names:
        sinks.write_subset(rows.filter(F.col("subset_name") == name), a.out, name)
    if len(names) > 1:
        sinks.write_csv(subsets.subset_stats(rows), f"{a.out}/_comparison", ["subset_name"])


def publish(spark: SparkSession, a: argparse.Namespace) -> None:
    """The published columns of every subset below --subsets, and a card; with --dry-run only what would be written."""
    names = [a.only] if a.only else readers.discover_subsets(a.subsets, spark)
    tables = {n: sinks.publishable(readers.read_subset(spark, a.subsets, n)[0]) for n in names}
    if a.dry_run:
        print("\n".join(f"{n}: {t.count()} rows, {len(t.columns)} columns" for n, t in tables.items()))
        return
    for n, t in tables.items():
        t.write.mode("overwrite").parquet(f"{a.out}/{n}")
    counts = spark.createDataFrame([(n, t.count()) for n, t in tables.items()], "subset_name string, n_rows long")
    sinks.write_text(spark, f"{a.out}/_card", dataset_card(counts))


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Token and label arrays of a subset's trajectories (or of all subsets), skipped where they are already there."""
    names = readers.discover_subsets(a.subsets, spark) if a.all else [a.subset]
    for name in names:
        ids = readers.read_ids(spark, f"{a.subsets}/{name}/ids")
        make = lambda ids=ids: chat.label_mask(chat.examples(_raw(spark, a.trajectories), ids), limit=a.max_seq_len)
        rows = readers.materialised(spark, f"{a.out}/{name}", make)
        lengths = rows.select(F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != LIMITS.label_mask)).alias("labelled"))
        print(name, evaluation.sequence_summary(lengths, "n", "labelled").first().asDict())


def test_sets(spark: SparkSession, a: argparse.Namespace) -> None:
    """Disjoint gold, random and low-quality sets, free of training ids, with their rows unless --no-fetch."""
    found = readers.read_scores(spark, a.scores_file, a.scores_table, a.trajectories)
    pool = found.select("trajectory_id", F.col("quality_score").alias("score"), "exit_status")
    training = testsets.training_ids(spark.read.parquet(a.training))
    sets = testsets.build(pool, training, n=a.size)
    if leaked := testsets.audit(sets, training).agg(F.sum("n_leaked")).first()[0]:
        raise RuntimeError(f"{leaked} training ids in the evaluation sets")
    sinks.write_test_sets(sets, f"{a.out}/ids", LIMITS.seed, training.count())
    if not a.no_fetch:
        sinks.fetch_rows(_raw(spark, a.trajectories), sets, f"{a.out}/rows")


def perplexity(spark: SparkSession, a: argparse.Namespace) -> None:
    """Loss and perplexity by model and split from ``loss_rows``; models already in --out are kept unless --force."""
    rows = spark.read.parquet(a.losses)
    rows = rows.filter(F.col("model").isin(*a.models)) if a.models else rows
    rows = rows.filter(F.col("split").isin(*a.splits)) if a.splits else rows
    new = statistics.loss_summary(rows)
    done = f"{a.out}/summary"
    try:
        new = sinks.merge_results(spark.read.parquet(done), new, ["model"], a.force)
    except AnalysisException as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("overwrite").parquet(f"{a.out}/summary_next")
    spark.read.parquet(f"{a.out}/summary_next").write.mode("overwrite").parquet(done)


def actions(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores of generated actions: ``model, n_steps`` (or model alone) with generated and true text."""
    rows = spark.read.parquet(a.generated)
    rows = rows.filter(F.col("model").isin(*a.models)) if a.models else rows
    rows = rows.filter(F.col("split").isin(*a.splits)) if a.splits else rows
    by = ["model"]
    if a.command == "next-action":
        by += ["n_steps"]
        rows = rows.filter(F.col("n_steps").isin(*a.truncate_steps))
    if a.num_samples:
        ids = rows.select("trajectory_id").distinct().orderBy("trajectory_id").limit(a.num_samples)
        rows = rows.join(ids, "trajectory_id", "left_semi")
    sinks.write_csv(evaluation.action_summary(rows, by), a.out, by)


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    """The evaluation report of nested results or of ``loss_rows``."""
    rows = readers.read_results(spark, a.results).select("model", "split", F.explode("losses").alias("loss"), F.col("mean_assistant_tokens").alias("n_tokens")) if a.results.endswith(".json") else spark.read.parquet(a.results)
    hypotheses = {k: tuple(v) for k, v in json.loads(a.hypotheses).items()} if a.hypotheses else None
    sinks.write_text(spark, a.out, analysis_report(rows, a.reference, hypotheses))


def experiments(spark: SparkSession, a: argparse.Namespace) -> None:
    """The experiments from START to END by number: subset, context length, and whether their examples are prepared."""
    table = spark.read.parquet(a.experiments).select(F.trim("name").alias("name"), F.trim("subset").alias("subset"), "context_length").distinct()
    number = F.regexp_extract("name", r"(\d+)$", 1).try_cast("int")
    ready = set(readers.discover_subsets(a.prepared, spark)) if a.prepared else set()
    for r in table.withColumn("k", number).filter(F.col("k").between(a.start, a.end)).orderBy("k").collect():  # one row an experiment
        print(f"{r.name}\t{r.subset}\t{r.context_length}\t{'prepared' if r.subset in ready else 'open'}")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """The evaluation steps one after the other, or one of them: test sets, perplexity, next action, analysis."""
    steps = {1: test_sets, 2: perplexity, 3: actions, 4: analyse}
    for k, run in steps.items():
        if (a.step in (None, k)) and not (k == 1 and a.skip_step1):
            values = vars(a) | {"command": "next-action" if k == 3 else a.command, "out": f"{a.out}/{run.__name__}", "results": a.losses}
            run(spark, argparse.Namespace(**values))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stepforge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for flags, kw in options:
            c.add_argument(*flags.split(), **kw)

    out, raw = ("--out", {"required": True}), ("--trajectories", {"required": True})
    flag = lambda name: (name, {"action": "store_true"})
    many = lambda name: (name, {"nargs": "+", "default": []})
    sets = [("--scores-file", {}), ("--scores-table --scores-repo", {"dest": "scores_table"}), flag("--no-fetch"), ("--size", {"type": int, "default": LIMITS.test_set_size}), ("--training", {"required": True})]
    samples = ("--num-samples", {"type": int})
    command("score", score, raw, out, ("--limit", {"type": int}), flag("--resume"), flag("--export-splits"), ("--skip-summary --skip-viz", {"action": "store_true", "dest": "skip_summary"}))
    command("subset", subset, ("--scores", {}), ("--out", {}), ("--only", {}), flag("--list"))
    command("publish", publish, ("--subsets --output-root", {"required": True, "dest": "subsets"}), ("--out --repo-id", {"required": True, "dest": "out"}), ("--only", {}), flag("--dry-run"))
    command("prepare", prepare, raw, out, ("--subsets --subset-dir", {"required": True, "dest": "subsets"}), ("--subset", {}), flag("--all"), ("--max-seq-len", {"type": int, "default": LIMITS.sequence_tokens}))
    command("test-sets", test_sets, raw, out, *sets)
    command("perplexity", perplexity, ("--losses", {"required": True}), out, many("--models"), many("--splits"), flag("--force"))
    command("next-action", actions, ("--generated", {"required": True}), out, many("--models"), many("--splits"), ("--truncate-steps", {"type": int, "nargs": "+", "default": [3, 5, 7]}), samples)
    command("first-action", actions, ("--generated", {"required": True}), out, many("--models"), many("--splits"), samples)
    command("analyse", analyse, ("--results", {"required": True}), out, ("--reference", {"default": "baseline"}), ("--hypotheses", {"help": "JSON: name to [first, second, alternative]"}))
    command("experiments", experiments, ("start", {"type": int, "nargs": "?", "default": 1}), ("end", {"type": int, "nargs": "?", "default": 10**6}), ("--experiments", {"required": True}), ("--prepared", {}))
    command("evaluate", evaluate, raw, out, *sets, ("--losses", {"required": True}), ("--generated", {"required": True}), many("--models"), many("--splits"), flag("--force"), ("--step", {"type": int}), flag("--skip-step1"), samples,
            ("--truncate-steps", {"type": int, "nargs": "+", "default": [3, 5, 7]}), ("--reference", {"default": "baseline"}), ("--hypotheses", {}))
    return p


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"stepforge {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
