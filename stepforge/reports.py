"""Reports of small result tables as Markdown (K14, K16); the tables are made by jobs, only the text here."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.operators import evaluation, statistics
from stepforge.sources.sinks import markdown


def hypothesis_tests(loss_rows: DataFrame, hypotheses: Mapping[str, tuple[str, str, str]], split: str = "gold") -> DataFrame:
    """M1: one row per hypothesis (name -> first model, second model, alternative): U, p and stars of their losses on a split."""
    out = None
    for name, (first, second, alternative) in hypotheses.items():
        rows = loss_rows.filter((F.col("split") == split) & F.col("model").isin(first, second))
        test = evaluation.mann_whitney_test(rows, "loss", F.col("model") == first).filter(F.col("alternative") == alternative)
        row = test.select(F.lit(name).alias("hypothesis"), F.lit(first).alias("first"), F.lit(second).alias("second"), "alternative", "n1", "n2", "u", "p", "stars")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no hypothesis is given")
    return out


def analysis_report(loss_rows: DataFrame, reference: str, hypotheses: Mapping[str, tuple[str, str, str]] | None = None, names: Mapping[str, str] | None = None) -> str:
    """Losses by model and split, change against the reference, monotone gradients and tests, as one document."""
    summary = statistics.loss_summary(loss_rows)
    shown = evaluation.display_name(F.col("model"), names or {})
    named = lambda df: df.withColumn("model", shown)
    deltas = statistics.relative_delta(summary, reference)
    parts = [
        "# Evaluation report",
        "## Loss by model and split",
        markdown(named(summary), ["model", "split"]),
        f"## Change against {evaluation_name(reference, names)} in percent",
        markdown(named(deltas), ["split", "model"]),
        "## Impact by split",
        markdown(named(statistics.impact_rank(deltas, reference)).select("split", "impact", "model", "delta_pct"), ["split", "impact"]),
        "## Loss from gold over random to low quality",
        markdown(named(statistics.quality_gradient(summary)), ["model"]),
    ]
    if hypotheses:
        parts += ["## Tests", markdown(hypothesis_tests(loss_rows, hypotheses), ["hypothesis"])]
    return "\n\n".join(parts) + "\n"


def evaluation_name(key: str, names: Mapping[str, str] | None) -> str:
    return (names or {}).get(key, key)


def dataset_card(stats: DataFrame, overlap: DataFrame | None = None, title: str = "Subsets", order: Column | str = "subset_name") -> str:
    """One row a subset, by name, and the overlap of subsets where given."""
    parts = [f"# {title}", "## Subsets", markdown(stats, [order])]
    if overlap is not None:
        parts += ["## Overlap", markdown(overlap, ["a", "b"])]
    return "\n\n".join(parts) + "\n"
