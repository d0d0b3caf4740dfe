"""Evaluation results: token losses, action summaries, p-values, sequence statistics, series over subset sizes."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.config import LIMITS
from stepforge.operators import statistics, textmetrics


def masked_loss(losses: Column, labels: Column, mask: int = LIMITS.label_mask) -> Column:
    """Mean of the token losses whose label isn't masked; NULL if all are, or for arrays that are NULL."""
    kept = F.filter(F.arrays_zip(losses.alias("loss"), labels.alias("label")), lambda t: (t["label"] != mask) & t["loss"].isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, t: s + t["loss"]), F.size(kept))


def padded(sequences: DataFrame, batch: str, column: str, value: int = LIMITS.label_mask) -> DataFrame:
    """``column`` (an array) filled up with ``value`` to the longest of its ``batch``; NULL arrays count as empty."""
    longest = sequences.groupBy(batch).agg(F.max(F.size(F.coalesce(column, F.array()))).alias("__n"))
    own = F.coalesce(F.col(column), F.array())
    fill = F.array_repeat(F.lit(value), F.col("__n") - F.size(own))
    return sequences.join(longest, batch).withColumn(column, F.concat(own, fill)).drop("__n")


def display_name(key: Column, names: Mapping[str, str]) -> Column:
    """P25: the name shown for a key, the key itself where there is none."""
    if not names:
        return key
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key], key)


def sequence_summary(examples: DataFrame, length: str, labelled: str) -> DataFrame:
    """One row: sequences, least, greatest, mean and median length, and the share of what is labelled, in percent."""
    return examples.agg(
        F.count("*").alias("n"),
        F.min(length).alias("least"),
        F.max(length).alias("most"),
        F.round(F.avg(length), 6).alias("mean"),
        F.median(length).alias("median"),
        F.round(F.try_divide(F.sum(labelled) * 100.0, F.sum(length)), 6).alias("labelled_pct"),
    )


def run_counters(scanned: DataFrame, wanted: DataFrame, prepared: DataFrame, length: str, limit: int) -> DataFrame:
    """One row: rows scanned, wanted ids, of them found, examples processed, longer than ``limit``, and skipped.

    ``scanned`` and ``wanted`` have canonical trajectory ids; ``prepared`` has an
    example per usable conversation.  Only ids and lengths are exchanged.
    """
    ids = wanted.select("trajectory_id").distinct()
    rows = scanned.groupBy("trajectory_id").agg(F.count("*").alias("rows")).join(ids.withColumn("wanted", F.lit(1)), "trajectory_id", "full")
    made = prepared.select("trajectory_id", F.col(length).alias("length"))
    return rows.join(made, "trajectory_id", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_scanned"),
        F.count("wanted").alias("n_wanted"),
        F.count_if(F.col("wanted").isNotNull() & F.col("rows").isNotNull()).alias("n_found"),
        F.count_if(F.col("wanted").isNotNull() & F.col("length").isNotNull()).alias("n_processed"),
        F.count_if(F.col("wanted").isNotNull() & (F.col("length") > limit)).alias("n_truncated"),
        F.count_if(F.col("wanted").isNotNull() & F.col("rows").isNotNull() & F.col("length").isNull()).alias("n_skipped"),
    )


def action_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (generated, truth) pairs: evaluated, skipped (a side is missing), and mean scores.

    BLEU and ROUGE are means over the pairs that have a score.
    """
    g, t = F.col("generated"), F.col("truth")
    both = pairs.withColumns({"pg": textmetrics.file_paths(g), "pt": textmetrics.file_paths(t), "ok": g.isNotNull() & t.isNotNull()})
    scored = both.select(
        *by,
        "ok",
        (textmetrics.action_type(g) == textmetrics.action_type(t)).cast("double").alias("type"),
        textmetrics.jaccard(F.col("pg"), F.col("pt")).alias("file"),
        textmetrics.format_score(g).alias("format"),
        textmetrics.exact_match(g, t).cast("double").alias("exact"),
        textmetrics.bleu4(g, t).alias("bleu"),
        textmetrics.rouge_l(g, t).alias("rouge"),
    )
    mean = lambda c: F.round(F.avg(F.when(F.col("ok"), F.nanvl(F.col(c), F.lit(None).cast("double")))), 6)
    return scored.groupBy(*by).agg(
        F.count_if("ok").alias("n_evaluated"), F.count_if(~F.col("ok")).alias("n_skipped"), mean("type").alias("action_type_acc"), mean("file").alias("file_match"),
        mean("format").alias("format_score"), mean("exact").alias("exact_match"), mean("bleu").alias("bleu4"), mean("rouge").alias("rouge_l"),
    )


@F.pandas_udf(T.DoubleType())
def _mwu_p(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series, alternative: pd.Series) -> pd.Series:
    return pd.Series([math.nan if u is None or u != u else statistics.mann_whitney_p(int(a), int(b), u, t, alt) for a, b, u, t, alt in zip(n1, n2, u, ties.fillna(0), alternative, strict=True)])


def mann_whitney_test(df: DataFrame, value: str, first: Column) -> DataFrame:
    """M1, M2: the row of ``statistics.mann_whitney`` for each alternative, with its p-value (tie-corrected, continuity) and stars.

    The p-value of a test without rows in a group, or of equal values only, is NULL.
    """
    row = statistics.mann_whitney(df, value, first).withColumn("alternative", F.explode(F.array(F.lit("less"), F.lit("greater"), F.lit("two-sided"))))
    p = F.nanvl(_mwu_p("n1", "n2", "u", "tie_sum", "alternative"), F.lit(None).cast("double"))
    return row.withColumn("p", p).withColumn("stars", statistics.stars(F.col("p"))).withColumn("p", F.round("p", 4))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """M3, M4: n, rho, two-sided p (t distribution with n - 2 degrees) and its reading; exact permutation values are for few models."""

    @F.pandas_udf(T.DoubleType())
    def p_of(n: pd.Series, rho: pd.Series) -> pd.Series:
        return pd.Series([math.nan if r is None or r != r else statistics.correlation_p(int(k), float(r)) for k, r in zip(n, rho, strict=True)])

    row = statistics.spearman(df, x, y)
    return row.withColumn("p", F.round(F.nanvl(p_of("n", "rho"), F.lit(None).cast("double")), 6)).withColumn("interpretation", statistics.interpretation(F.col("rho")))


def model_losses(metrics: DataFrame, losses: DataFrame, split: str) -> DataFrame:
    """Metrics of models beside their mean loss on one split; a model without loss is left out."""
    return metrics.join(losses.filter(F.col("split") == split).select("model", "mean_loss"), "model")


def scaling_series(losses: DataFrame, sizes: DataFrame, split: str) -> DataFrame:
    """Mean loss over subset sizes: ``strategy, size, model, mean_loss`` and the step from the size before.

    ``sizes`` (strategy, size, model) is a fixed table; a model without loss has NULL.
    """
    rows = sizes.join(losses.filter(F.col("split") == split).select("model", "mean_loss"), "model", "left")
    before = F.lag("mean_loss").over(Window.partitionBy("strategy").orderBy("size", "model"))
    return rows.select("strategy", "size", "model", "mean_loss", F.round(F.col("mean_loss") - before, 6).alias("step"))


def json_text(text: str | None) -> str | None:
    """A JSON object written anew in the common layout, keys in their order; any other text as it is."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else str(value)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def json_texts(calls: pd.Series) -> pd.Series:
    """``json_text`` of every argument of every message of a conversation, in Arrow batches."""
    return calls.map(lambda messages: None if messages is None else [None if m is None else [json_text(a) for a in m] for m in messages])
