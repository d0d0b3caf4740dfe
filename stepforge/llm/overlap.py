"""Problem 1: the same or nearly the same trajectory in training and evaluation splits.

Method: exact prefix-filter bipartite join on rare shingles.  A trajectory is
the sequence of its steps' call signatures; its shingles are the signatures
with their occurrence number, so a multiset becomes a set.  Shingles are
ordered by rarity over all sequences.  Only the first ``n - need + 1`` of a
sequence can be the first shared one of a qualifying pair, so the evaluation
prefixes are the index, the training prefixes the probe; length and position
filters drop pairs that cannot reach the threshold, and the longest common
subsequence of the rest is computed exactly.

Equal sequences are one class and are joined once, so groups of copies cost
nothing before the final membership join, which writes the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.functions.calls import call_signature
from stepforge.functions.ids import instance_key, repo_key, repo_of_instance, trajectory_key
from stepforge.session import cut

#: Least share of the longer trajectory's steps that agree in order ("about two thirds or more").
AGREEMENT = 0.6
#: A shingle that one in so many sequences has is hot.
HOT = 1000
#: Rows of a shingle that one task of the join takes.
PROBES = 20_000


def _need(n: Column, agreement: float) -> Column:
    return F.ceil(n * F.lit(agreement) - F.lit(1e-9)).cast("int")


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence, 64 steps at a time in one big integer."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        u = row & masks.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(steps: pd.Series) -> pd.Series:
    """Signature and occurrence number of every step, as one number each."""

    def of(seq: np.ndarray) -> list[int]:
        seen: dict[int, int] = {}
        out = []
        for x in seq.tolist():
            k = seen[x] = seen.get(x, 0) + 1
            out.append(x if k == 1 else int.from_bytes(blake2b(f"{x}:{k}".encode(), digest_size=8).digest(), "little", signed=True))
        return out

    return steps.map(of)


def sequences(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, steps``: the signatures, in step order, of every wanted trajectory that has steps.

    Rows repeated for one step count once (the last ingested stands).  Steps
    without text keep their place but agree with no other step.
    """
    rows = (
        steps.filter(F.col("step_idx").isNotNull())
        .select(trajectory_key("trajectory_id").alias("key"), F.col("step_idx").cast("int").alias("step_idx"), "action_text", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"))
        .filter(F.col("key").isNotNull())
        .join(wanted, "key", "left_semi")
        .withColumn("sig", call_signature(F.col("action_text")))
        .withColumn("sig", F.coalesce("sig", F.xxhash64(F.lit("no text"), "key", "step_idx")))
    )
    once = rows.groupBy("key", "step_idx").agg(F.max(F.struct("at", "sig"))["sig"].alias("sig"))
    return once.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("step_idx", "sig")))["sig"].alias("steps"))


def near_classes(classes: DataFrame, agreement: float = AGREEMENT) -> DataFrame:
    """Pairs of different classes, one in evaluation and one in training, that agree.

    ``classes`` has ``class long, steps array<long>, in_eval, in_train
    boolean``, one row per class.  Result: ``eval_class, train_class, common,
    agreement``; every pair whose longest common subsequence is at least
    ``agreement`` of the longer sequence is in it.
    """
    shingles = classes.select("class", "in_eval", "in_train", F.size("steps").alias("n"), F.explode(_shingles("steps")).alias("shingle"))
    frequency = shingles.groupBy("shingle").agg(F.count("*").alias("f"))
    # The commonest shingles, no more than HOT times the steps of a sequence, are looked up where their rows are; sent by
    # shingle they would meet in one task.
    hot = frequency.crossJoin(F.broadcast(classes.agg(F.count("*").alias("n_classes")))).filter(F.col("f") * HOT >= F.greatest(F.col("n_classes"), F.lit(HOT * 2))).select("shingle", F.col("f").alias("hot_f"))
    placed = shingles.join(F.broadcast(hot), "shingle", "left").withColumn("at_shingle", F.when(F.col("hot_f").isNull(), F.col("shingle")).otherwise(F.xxhash64("class", "shingle")))
    ordered = (
        placed.join(frequency.withColumnRenamed("shingle", "at_shingle"), "at_shingle", "left")
        .withColumn("f", F.coalesce("hot_f", "f"))
        .groupBy("class", "in_eval", "in_train", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("ranked"))
        .withColumn("prefix", F.slice("ranked", 1, F.col("n") - _need(F.col("n"), agreement) + 1))
        .select("class", "in_eval", "in_train", "n", F.posexplode("prefix").alias("at", "x"))
        .filter("x.f > 1")  # a shingle of one class only cannot be shared
        .select("class", "in_eval", "in_train", "n", "at", F.col("x.shingle").alias("shingle"), F.ceil(F.col("x.f") / PROBES).cast("int").alias("salts"))
    )
    # The training rows of a common shingle go to several tasks, and the evaluation rows to each of them.
    salt = {"train": F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"), "eval": F.explode(F.sequence(F.lit(0), F.col("salts") - 1))}
    side = lambda flag, p: ordered.filter(flag).select("shingle", salt[p].alias("salt"), F.col("class").alias(f"{p}_class"), F.col("n").alias(f"{p}_n"), F.col("at").alias(f"{p}_at"))
    longer = F.greatest("eval_n", "train_n")
    candidates = (
        side("in_eval", "eval")
        .join(side("in_train", "train"), ["shingle", "salt"])
        .filter("eval_class <> train_class")
        .filter(F.least("eval_n", "train_n") >= _need(longer, agreement))
        .filter(F.least(F.col("eval_n") - F.col("eval_at"), F.col("train_n") - F.col("train_at")) >= _need(longer, agreement))
        .select("eval_class", "train_class")
        .distinct()
    )
    seq = lambda p: classes.select(F.col("class").alias(f"{p}_class"), F.col("steps").alias(f"{p}_steps"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, t = b.column("eval_steps"), b.column("train_steps")
            common = [common_subsequence(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(e, t, strict=True)]
            longest = np.maximum(e.value_lengths().to_numpy(zero_copy_only=False), t.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [b.column("eval_class"), b.column("train_class"), pa.array(common, pa.int32()), pa.array(np.asarray(common) / longest, pa.float64())],
                names=["eval_class", "train_class", "common", "agreement"],
            )

    return (
        candidates.join(seq("eval"), "eval_class")
        .join(seq("train"), "train_class")
        .select("eval_class", "train_class", "eval_steps", "train_steps")
        .mapInArrow(verify, "eval_class long, train_class long, common int, agreement double")
        .filter(F.col("agreement") >= agreement - 1e-9)
    )


def split_members(split_rows: DataFrame) -> DataFrame:
    """``row_id, split, is_train, key, subset_name, instance``; rows without row_id, split or id are left out."""
    return (
        split_rows.select("row_id", F.lower(F.trim("split")).alias("split"), trajectory_key("trajectory_id").alias("key"), "subset_name", instance_key("instance_id").alias("instance"))
        .filter("row_id IS NOT NULL AND split IS NOT NULL AND key IS NOT NULL")
        .withColumn("is_train", F.col("split") == "train")
        .distinct()
    )


def classified(split_rows: DataFrame, steps: DataFrame, agreement: float = AGREEMENT) -> tuple[DataFrame, DataFrame]:
    """Membership and pairs of classes: ``row_id, split, is_train, key, subset_name, instance, class`` and ``eval_class, train_class, agreement``.

    A class is a distinct sequence of calls, or an id without steps.  Pairs hold
    a class with itself where it is in evaluation and in training; copies are
    not expanded, so this form stays as small as the rows however many copies there are.
    """
    members = cut(split_members(split_rows))
    keys = members.groupBy("key").agg(F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval"))
    seqs = sequences(steps, keys)
    # A class is a distinct sequence; an id without steps is a class of its own.
    keyed = cut(keys.join(seqs, "key", "left").withColumn("class", F.when(F.col("steps").isNull(), F.xxhash64(F.lit("id"), "key")).otherwise(F.xxhash64(F.lit("steps"), "steps"))))
    classes = (
        keyed.filter("steps IS NOT NULL")
        .groupBy("class")
        .agg(F.first("steps").alias("steps"), F.max("in_eval").alias("in_eval"), F.max("in_train").alias("in_train"))
    )
    near = near_classes(cut(classes), agreement)
    same = keyed.groupBy("class").agg(F.max("in_eval").alias("e"), F.max("in_train").alias("t")).filter("e AND t")
    pairs = same.select(F.col("class").alias("eval_class"), F.col("class").alias("train_class"), F.lit(1.0).alias("agreement")).unionByName(near.drop("common"))
    return members.join(keyed.select("key", "class"), "key"), pairs


def overlaps(split_rows: DataFrame, steps: DataFrame, agreement: float = AGREEMENT) -> DataFrame:
    """Pairs of a training row and an evaluation row that stand for the same trajectory.

    Columns: ``row_a, row_b`` (row_a < row_b), ``eval_row, train_row,
    eval_split, subset_name, eval_key, train_key, kind`` (``id`` the same id
    however written, ``copy`` equal steps, ``near`` nearly equal steps) and
    ``agreement``.  Ids that have no steps match by id only.  Rows delivered
    twice count once; empty tables give no rows.
    """
    rows, pairs = classified(split_rows, steps, agreement)
    ev = rows.filter("NOT is_train").select(F.col("class").alias("eval_class"), F.col("row_id").alias("eval_row"), F.col("split").alias("eval_split"), F.col("key").alias("eval_key"), F.col("instance").alias("eval_instance"))
    tr = rows.filter("is_train").select(F.col("class").alias("train_class"), F.col("row_id").alias("train_row"), "subset_name", F.col("key").alias("train_key"))
    return (
        pairs.join(ev, "eval_class")
        .join(tr, "train_class")
        .filter("eval_row <> train_row")
        .select(
            F.least("eval_row", "train_row").alias("row_a"),
            F.greatest("eval_row", "train_row").alias("row_b"),
            "eval_row",
            "train_row",
            "eval_split",
            "subset_name",
            "eval_key",
            "train_key",
            "eval_instance",
            F.when(F.col("eval_key") == F.col("train_key"), "id").when(F.col("eval_class") == F.col("train_class"), "copy").otherwise("near").alias("kind"),
            "agreement",
        )
    )


def report(found: DataFrame, stats: DataFrame) -> DataFrame:
    """Leaked evaluation rows and pairs per split, training subset and repository.

    The repository is that of the evaluation trajectory in ``stats``, else the
    one its instance names, else NULL.
    """
    repos = stats.select(trajectory_key("trajectory_id").alias("eval_key"), repo_key("repo").alias("r")).filter("r IS NOT NULL").groupBy("eval_key").agg(F.min("r").alias("r"))
    return (
        found.join(repos, "eval_key", "left")
        .withColumn("repo", F.coalesce("r", repo_of_instance("eval_instance")))
        .groupBy("eval_split", "subset_name", "repo")
        .agg(
            F.count_distinct("row_a", "row_b").alias("n_pairs"),
            F.count_distinct("eval_row").alias("n_eval_rows"),
            F.count_distinct("train_row").alias("n_train_rows"),
        )
    )
