"""Problem 4: a reproducible sample that only grows as data grows.

Method: the md5 of a fixed salt and the record key is mapped to the unit
interval; a record is in the sample when its number lies below the rate.
Membership depends on nothing but key, salt and rate, so it is the same on
every run, partitioning and engine, records stay members when others arrive,
and a sample at a lower rate is part of one at a higher rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions.ids import trajectory_key, unit_hash

SALT = "stepforge-sample-1"


def in_sample(key: F.Column, rate: float, salt: str = SALT) -> F.Column:
    """Whether a key is in the sample; a NULL key never is."""
    return F.coalesce(unit_hash(key, salt) < F.lit(float(rate)), F.lit(False))


def sample(rows: DataFrame, key: str, rate: float, salt: str = SALT) -> DataFrame:
    """The rows of sampled keys, repeated rows included; a narrow filter without shuffle.

    ``rate`` 0 gives none, 1 all rows with a key.  Ids are taken in canonical
    spelling, so one written otherwise has the same fate.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    return rows.filter(in_sample(trajectory_key(key), rate, salt))


def sampled_ids(stats: DataFrame, rate: float, salt: str = SALT) -> DataFrame:
    """One row per sampled trajectory: its number in [0, 1), rows and first and last delivery."""
    key = trajectory_key("trajectory_id")
    return (
        sample(stats, "trajectory_id", rate, salt)
        .groupBy(key.alias("trajectory_id"))
        .agg(F.count("*").alias("n_rows"), F.min("ingested_at").alias("first_ingested"), F.max("ingested_at").alias("last_ingested"))
        .withColumn("u", unit_hash(F.col("trajectory_id"), salt))
    )


def stability(stats: DataFrame, rate: float, parts: int = 4, salt: str = SALT) -> DataFrame:
    """How the sample grew with the data: per quarter of the time of first delivery, ids seen and ids sampled so far.

    Every id counted in one row is counted in all later ones: nothing leaves the sample.
    """
    first = stats.groupBy(trajectory_key("trajectory_id").alias("k")).agg(F.min("ingested_at").alias("t")).filter("k IS NOT NULL")
    span = first.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.least(F.lit(parts), F.floor((us("t") - us("lo")) * parts / F.greatest(us("hi") - us("lo"), F.lit(1))) + 1)
    by = first.crossJoin(F.broadcast(span)).groupBy(F.coalesce(part, F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.count_if(in_sample(F.col("k"), rate, salt)).alias("s"))
    at = by.sparkSession.range(1, parts + 1).select(F.col("id").alias("at"))
    return (
        at.join(F.broadcast(by), F.col("part") <= F.col("at"))
        .groupBy("at")
        .agg(F.sum("n").alias("n_ids"), F.sum("s").alias("n_sampled"))
        .select("at", "n_ids", "n_sampled", F.round(F.col("n_sampled") / F.col("n_ids"), 6).alias("share"))
    )
