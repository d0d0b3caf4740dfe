"""The tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.ids import trajectory_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per canonical ``key``, that of the greatest ``at``: rows are delivered twice and scored again.

    Of rows of one time the one with the greatest hash stands, so the choice is
    the same on every run; rows without key are left out.
    """
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    keyed = df.withColumn(key, trajectory_key(key)).filter(F.col(key).isNotNull())
    return keyed.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(at, F.xxhash64(*plain))).alias("__r")).select("__r.*")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly work on each row.

    Only an input of fewer files or row groups than that is moved; a large one
    is read in many parts already and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def delivered_once(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``df``, of rows that agree in them one; for rows too large to be exchanged.

    Hashes of the rows are exchanged, not the rows: of rows with one hash and
    one first column the first in its file stays.  The rows are joined only to
    the keys that occur twice, a table Spark broadcasts while it is small.  The
    result is spread over the cores like ``spread``.  A frame that isn't read
    straight from files has no places of rows and is compared as a whole.
    """
    key = columns[0]
    try:
        rows = df.select(*columns, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias("__at"))
    except AnalysisException:
        return spread(df.select(*columns)).distinct()
    hashed = F.xxhash64(*columns).alias("__h")
    twice = rows.select(F.col(key).alias("__k"), hashed, "__at").groupBy("__k", "__h").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).filter("__n > 1").drop("__n")
    return spread(rows).withColumn("__own", hashed).join(twice, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__h")), "left").filter("__first IS NULL OR __first = __at").select(*columns)


def where(df: DataFrame, name: str, value: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """``df`` with the column ``name``, without the rows whose value fails the condition; a costly value is made once.

    A filter behind the column would be pushed below it with its expression and make the value twice.
    """
    return df.select("*", F.explode(F.filter(F.array(value), condition)).alias(name))
