"""Readers and validators."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.ids import trajectory_key
from stepforge.sources import schema


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame, or ValueError naming the columns it lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def read_jsonl(spark: SparkSession, path: str, ddl: str = schema.STATS, required: Iterable[str] = ("trajectory_id",)) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, unreadable ones fail."""
    return require(spark.read.schema(ddl).option("mode", "FAILFAST").json(path), required)


def read_csv(spark: SparkSession, path: str, ddl: str, required: Iterable[str] = ("trajectory_id",)) -> DataFrame:
    """CSV with a header; columns get the schema's types by name, values that don't fit are NULL."""
    header = spark.read.option("header", True).csv(path)
    require(header, required)
    types = {p.strip().split(" ", 1)[0].lower(): p.strip().split(" ", 1)[1] for p in ddl.split(",") if " " in p.strip()}
    return header.select(*(F.expr(f"try_cast(`{c}` AS {types.get(c.lower(), 'string')})").alias(c) for c in header.columns))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """An id list as text: trimmed, without blanks, distinct; ``with_ids`` compares ids however they are written."""
    return spark.read.text(path).select(F.trim("value").alias("trajectory_id")).filter("trajectory_id <> ''").distinct()


def subset_ids(subset_rows: DataFrame, name: str) -> DataFrame:
    """The ids of one named subset."""
    return subset_rows.filter(F.col("subset_name") == name).select("trajectory_id").distinct()


def read_scores(spark: SparkSession, file: str | None = None, table_path: str | None = None, raw_path: str | None = None) -> DataFrame:
    """Scores from a file, else a table, else raw rows without score.

    The score column is ``quality_score``, whatever it was called
    (composite_score before composite_Q / composite_q).
    """
    if file:
        df = spark.read.option("header", True).csv(file) if file.endswith(".csv") else spark.read.json(file)
    elif table_path:
        df = spark.read.parquet(table_path)
    elif raw_path:
        return spark.read.parquet(raw_path).select("trajectory_id", "exit_status", F.lit(None).cast("double").alias("quality_score"))
    else:
        raise ValueError("a file, a table or raw rows are needed")
    for name in ("quality_score", "composite_score", "composite_Q", "composite_q"):
        if name in df.columns:
            return require(df.withColumn("quality_score", F.expr(f"try_cast(`{name}` AS double)")), ("trajectory_id", "exit_status"))
    raise ValueError("no score column")


def materialised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if a job has completed it, else ``make()`` written there and read again."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_losses(spark: SparkSession, path: str, split: str | None = None, models: Iterable[str] | None = None) -> DataFrame:
    """``model, split, mean_loss`` of a CSV, of one split and of the named models where given."""
    rows = read_csv(spark, path, "model string, split string, mean_loss double", ("model", "split", "mean_loss")).select("model", "split", "mean_loss")
    rows = rows if split is None else rows.filter(F.col("split") == split)
    return rows if models is None else rows.filter(F.col("model").isin(*models))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested results (model -> split -> figures) as a long table, one row per model and split."""
    text = spark.read.option("wholetext", True).text(path)
    models = text.select(F.explode(F.from_json("value", schema.LOSS_RESULTS)).alias("model", "splits"))
    return models.select("model", F.explode("splits").alias("split", "r")).select("model", "split", "r.*")


def decode_trajectory(df: DataFrame) -> DataFrame:
    """TR16: a ``trajectory`` stored as a JSON string becomes messages; unreadable ones are NULL."""
    if dict(df.dtypes)["trajectory"] != "string":
        return df
    ddl = "array<struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>"
    return df.withColumn("trajectory", F.from_json("trajectory", ddl))


def unseen(source: DataFrame, done: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """Rows whose id isn't done yet - resuming by id, however written, not by position."""
    return with_ids(source, done, "left_anti", key)


def with_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "trajectory_id") -> DataFrame:
    """The rows whose id is (or with ``left_anti`` isn't) among ``ids``, however either is written."""
    wanted = ids.select(trajectory_key(key).alias("__key")).filter("__key IS NOT NULL").distinct()
    return rows.withColumn("__key", trajectory_key(key)).join(wanted, "__key", how).drop("__key")


def first_rows(df: DataFrame, n: int, key: str = "trajectory_id") -> DataFrame:
    """The first ``n`` by id; the same on every run."""
    return df.orderBy(key).limit(n)


def discover_subsets(root: str, spark: SparkSession | None = None) -> list[str]:
    """Names of the subsets below a root written by ``write_subset``, on Spark's file system."""
    spark = spark or SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(n.split("=", 1)[-1] for n in names if not n.startswith(("_", ".")))


def read_subset(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict]:
    """Rows and metadata of a written subset."""
    folder = f"{root.rstrip('/')}/{name}"
    meta = json.loads(spark.read.text(f"{folder}/metadata").first().value)
    return spark.read.schema(meta["schema"]).json(f"{folder}/rows"), meta


def output_root(given: str | None = None, env: str = "STEPFORGE_OUTPUT", candidates: Iterable[str] = ("output", "data")) -> str:
    """The argument, else the environment, else the first folder that exists, else the first candidate."""
    candidates = list(candidates)
    return given or os.environ.get(env) or next((c for c in candidates if os.path.isdir(c)), candidates[0])
