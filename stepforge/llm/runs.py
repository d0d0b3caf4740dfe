"""Problem 7: collapse runs of repeated consecutive actions.

Method: boundary interval lookup.  The steps of a trajectory are laid out in
entity chunks of ``CHUNK`` consecutive step numbers.  Within a chunk the
positions at which a run starts are gathered into a sorted array; every action
finds its run by binary search in that array, and runs are then aggregated.
Each chunk also sees the last action of the chunk before it, so it knows
whether its first run continues one; the pieces of such runs are joined by an
as-of lookup over the chunks' edge pieces only (at most two rows a chunk).

A trajectory of any length is thus spread over many tasks, and repeated rows
of one action are folded before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.calls import call_signature

#: Step numbers per entity chunk; bounds what one task gathers for a trajectory.
CHUNK = 1024

_PIECES = (
    "trajectory_id string, chunk long, first_step int, last_step int, n_actions long, signature long, "
    "started_us long, ended_us long, open_left boolean, open_right boolean"
)


def signed_steps(steps: DataFrame) -> DataFrame:
    """One row per action: ``trajectory_id, step_idx, signature, started_us, ended_us``.

    Rows repeated for one (trajectory_id, step_idx) count once: of differing
    texts the one ingested last, then the greatest signature, stands.  Start
    and end are the earliest and the latest seen; an end that is missing or
    before its start is the start.  Rows without trajectory_id or step_idx
    name no action and are left out; an action without text has signature
    NULL, which equals no other.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = steps.filter(F.col("trajectory_id").isNotNull() & F.col("step_idx").isNotNull()).select(
        "trajectory_id",
        F.col("step_idx").cast("int").alias("step_idx"),
        call_signature(F.col("action_text")).alias("sig"),
        us("started_at").alias("s"),
        us("ended_at").alias("e"),
        us("ingested_at").alias("i"),
    )
    return rows.groupBy("trajectory_id", "step_idx").agg(
        F.max(F.struct("i", "sig"))["sig"].alias("signature"),
        F.min("s").alias("started_us"),
        F.greatest(F.max("e"), F.min("s")).alias("ended_us"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs within each chunk: sorted start positions, binary search, aggregation."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("steps")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        get = lambda k: flat.field(k)
        idx = get("step_idx").to_numpy(zero_copy_only=False).astype(np.int64)
        sig_col = get("signature")
        known = sig_col.is_valid().to_numpy(zero_copy_only=False)
        sig = sig_col.fill_null(0).to_numpy(zero_copy_only=False)
        entity = np.repeat(np.arange(len(sizes)), sizes)
        chunk = np.repeat(batch.column("chunk").to_numpy(zero_copy_only=False), sizes)
        halo = (idx // CHUNK) != chunk
        # An action starts a run unless it repeats the action just before it.
        same = np.zeros(len(idx), bool)
        same[1:] = (entity[1:] == entity[:-1]) & (idx[1:] == idx[:-1] + 1) & (sig[1:] == sig[:-1]) & known[1:] & known[:-1]
        starts = np.flatnonzero(~same)
        run = np.searchsorted(starts, np.arange(len(idx)), side="right") - 1
        own = ~halo
        n = np.bincount(run[own], minlength=len(starts))
        kept = np.flatnonzero(n > 0)
        last = np.append(starts[1:], len(idx)) - 1
        first_own = starts + halo[starts]  # the halo row belongs to the chunk before
        us = {k: (get(k).is_valid().to_numpy(zero_copy_only=False), get(k).fill_null(0).to_numpy(zero_copy_only=False)) for k in ("started_us", "ended_us")}
        lo = np.full(len(starts), np.iinfo(np.int64).max)
        np.minimum.at(lo, run[own & us["started_us"][0]], us["started_us"][1][own & us["started_us"][0]])
        hi = np.full(len(starts), np.iinfo(np.int64).min)
        np.maximum.at(hi, run[own & us["ended_us"][0]], us["ended_us"][1][own & us["ended_us"][0]])
        e = entity[starts]
        ids = batch.column("trajectory_id").take(pa.array(e[kept]))
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(chunk[starts][kept], pa.int64()),
                pa.array(idx[first_own[kept]].astype(np.int32)),
                pa.array(idx[last[kept]].astype(np.int32)),
                pa.array(n[kept].astype(np.int64)),
                pa.array(sig[starts][kept], pa.int64(), mask=~known[starts][kept]),
                pa.array(lo[kept], pa.int64(), mask=lo[kept] == np.iinfo(np.int64).max),
                pa.array(hi[kept], pa.int64(), mask=hi[kept] == np.iinfo(np.int64).min),
                pa.array(halo[starts][kept]),
                pa.array(idx[last[kept]] % CHUNK == CHUNK - 1),
            ],
            names=[f.split()[0] for f in _PIECES.split(", ")],
        )


def runs(steps: DataFrame, least: int = 2) -> DataFrame:
    """Every maximal run of at least ``least`` consecutive equal actions, as one row.

    Columns: ``trajectory_id, first_step, last_step, n_actions, signature,
    started_at, ended_at, duration_s``.  The duration runs from the earliest
    start to the latest end; it is NULL where no time is known.  A gap in the
    step numbers ends a run.  An empty table gives no rows.
    """
    actions = signed_steps(steps).withColumn("chunk", F.floor(F.col("step_idx") / CHUNK))
    # The last action of a chunk is also shown to the next chunk.
    homes = F.when(F.pmod("step_idx", F.lit(CHUNK)) == CHUNK - 1, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))
    chunks = (
        actions.withColumn("chunk", F.explode(homes))
        .groupBy("trajectory_id", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("step_idx", "signature", "started_us", "ended_us"))).alias("steps"))
    )
    pieces = chunks.mapInArrow(_pieces, _PIECES)
    edge = F.col("open_left") | F.col("open_right")
    order = Window.partitionBy("trajectory_id").orderBy("first_step")
    joined = (
        pieces.filter(edge)
        .withColumn("run", F.sum((~F.col("open_left")).cast("long")).over(order))
        .groupBy("trajectory_id", "run")
        .agg(
            F.min("first_step").alias("first_step"),
            F.max("last_step").alias("last_step"),
            F.sum("n_actions").alias("n_actions"),
            F.min("signature").alias("signature"),
            F.min("started_us").alias("started_us"),
            F.max("ended_us").alias("ended_us"),
        )
        .drop("run")
    )
    whole = pieces.filter(~edge).select(*joined.columns)
    return (
        whole.unionByName(joined)
        .filter(F.col("n_actions") >= least)
        .select(
            "trajectory_id",
            "first_step",
            "last_step",
            "n_actions",
            "signature",
            F.timestamp_micros("started_us").alias("started_at"),
            F.timestamp_micros("ended_us").alias("ended_at"),
            ((F.col("ended_us") - F.col("started_us")) / 1e6).alias("duration_s"),
        )
    )


def collapsed(steps: DataFrame) -> DataFrame:
    """Every run, those of one action included: the sequences with repeats folded."""
    return runs(steps, least=1)
