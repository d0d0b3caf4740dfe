"""Problem 2: fill sequences of fixed capacity with whole trajectories.

Method: first-fit decreasing with a tournament tree of free space, run
independently in randomised groups.  Groups are drawn by hash within an
experiment and hold about ``GROUP`` items each, so the largest subset is packed
by many tasks; each group leaves at most one poorly filled sequence behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions.ids import trajectory_key

#: Items in a group, on average.
GROUP = 5000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item (0, 1, ...); sizes are at most the capacity, the order of equal sizes is kept."""
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    # Each node holds the most free space below it; the leftmost bin with room is found from the root.
    free = np.full(2 * leaves, capacity, np.int64).tolist()
    bins = np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[item] = node - leaves
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins


def experiment_items(experiments: DataFrame, split_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``experiment, context_length, trajectory_id, total_tokens`` of every trajectory of every experiment's subset.

    Experiments delivered twice count once (names are trimmed); one without a
    positive context_length has nothing to fill and is left out.  A trajectory
    counts once in a subset.  Its length is the last one known; trajectories that
    are not in stats, or whose length is unknown or not positive, take no room
    and are left out.
    """
    exp = (
        experiments.select(F.trim("name").alias("experiment"), F.lower(F.trim("subset")).alias("subset"), F.col("context_length").cast("long").alias("context_length"))
        .filter("context_length > 0")
        .groupBy("experiment", "subset")
        .agg(F.max("context_length").alias("context_length"))
    )
    members = split_rows.select(F.lower(F.trim("subset_name")).alias("subset"), trajectory_key("trajectory_id").alias("trajectory_id")).filter("subset IS NOT NULL AND trajectory_id IS NOT NULL").distinct()
    lengths = (
        stats.select(trajectory_key("trajectory_id").alias("trajectory_id"), "ingested_at", F.col("total_tokens").cast("long").alias("total_tokens"))
        .filter("total_tokens IS NOT NULL")
        .groupBy("trajectory_id")
        .agg(F.max(F.struct("ingested_at", "total_tokens"))["total_tokens"].alias("total_tokens"))
        .filter("total_tokens > 0")
    )
    # Experiments are a fixed dimension of a few rows; Spark broadcasts it only while it is small.
    return members.join(exp, "subset").join(lengths, "trajectory_id").select("experiment", "context_length", "trajectory_id", "total_tokens")


def unknown_lengths(experiments: DataFrame, split_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Per experiment: trajectories of its subset, and how many are left out because no positive length is known."""
    known = experiment_items(experiments, split_rows, stats).select("experiment", "trajectory_id", F.lit(1).alias("known"))
    exp = experiments.filter("context_length > 0").select(F.trim("name").alias("experiment"), F.lower(F.trim("subset")).alias("subset")).distinct()
    members = split_rows.select(F.lower(F.trim("subset_name")).alias("subset"), trajectory_key("trajectory_id").alias("trajectory_id")).filter("subset IS NOT NULL AND trajectory_id IS NOT NULL").distinct()
    rows = members.join(exp, "subset").join(known, ["experiment", "trajectory_id"], "left")
    return rows.groupBy("experiment").agg(F.count("*").alias("n_trajectories"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


_PLACED = "experiment string, context_length long, trajectory_id string, piece int, tokens long, bin string, start long"


def pack(items: DataFrame, group: int = GROUP) -> DataFrame:
    """Place every item: ``experiment, context_length, trajectory_id, piece, tokens, bin, start``.

    An item longer than the capacity is cut into pieces, all but the last of
    them a whole sequence; other items are one piece.  ``bin`` names a
    sequence, ``start`` is the piece's place in it.  No sequence is overfull
    and no token is lost.  Equal items are placed independently.
    """
    counts = items.groupBy("experiment").agg(F.count("*").alias("n"))
    grouped = items.join(counts, "experiment").withColumn("grp", F.pmod(F.xxhash64(F.lit("pack"), "experiment", "trajectory_id"), F.ceil(F.col("n") / F.lit(group))))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["total_tokens", "trajectory_id"], ascending=[False, True], kind="stable")
        capacity = int(pdf["context_length"].iloc[0])
        total = pdf["total_tokens"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-total // capacity))
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.minimum(capacity, total[row] - piece * capacity)
        bins = first_fit_decreasing(tokens, capacity)
        order = np.argsort(bins, kind="stable")
        start = np.zeros(len(bins), np.int64)
        ends = np.cumsum(tokens[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(first, ends - tokens[order], 0))
        start[order] = ends - tokens[order] - base
        grp = int(pdf["grp"].iloc[0])
        return pd.DataFrame(
            {
                "experiment": pdf["experiment"].to_numpy()[row],
                "context_length": capacity,
                "trajectory_id": pdf["trajectory_id"].to_numpy()[row],
                "piece": piece.astype(np.int32),
                "tokens": tokens,
                "bin": [f"{grp}-{b}" for b in bins.tolist()],
                "start": start,
            }
        )

    return grouped.groupBy("experiment", "grp").applyInPandas(lambda pdf: place(pdf), _PLACED)


def bins(placed: DataFrame) -> DataFrame:
    """Per experiment: sequences, tokens, the least number of sequences possible, and the share of space used."""
    per_bin = placed.groupBy("experiment", "context_length", "bin").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    return (
        per_bin.groupBy("experiment", "context_length")
        .agg(F.count("*").alias("n_sequences"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .withColumn("least_possible", F.ceil(F.col("tokens") / F.col("context_length")))
        .withColumn("filled", F.round(F.col("tokens") / (F.col("n_sequences") * F.col("context_length")), 6))
    )
