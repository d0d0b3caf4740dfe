"""Sinks and incremental merges (K1-K16, O8). Rows are written by tasks; only reports are formatted on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators.profile import normalise_schema
from stepforge.operators.steps import once
from stepforge.sources.readers import with_ids
from stepforge.sources.schema import PUBLISHED


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: append; a failed job leaves no partial rows behind (output commit protocol)."""
    df.write.mode("append").format(fmt).save(path)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """CSV with header; map and array columns are left out."""
    flat = df.select(*(c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))))
    (flat.orderBy(*order) if order else flat).write.mode("overwrite").option("header", True).csv(path)


def write_splits(members: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K4: one folder per subset, so a reader of one prunes the others."""
    members.write.mode("overwrite").partitionBy("subset_name").format(fmt).save(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, as one file in a folder, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_subset(rows: DataFrame, root: str, name: str, description: str = "", stats: dict | None = None) -> dict:
    """K5: rows as JSON lines and CSV, the id list, and the metadata (one small file), all on Spark's file system."""
    folder = f"{root.rstrip('/')}/{name}"
    rows.write.mode("overwrite").json(f"{folder}/rows")
    write_csv(rows, f"{folder}/csv")
    rows.select("trajectory_id").orderBy("trajectory_id").write.mode("overwrite").text(f"{folder}/ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    meta = {"name": name, "description": description, "actual_size": rows.count(), "stats": stats or {}, "schema": schema}
    write_text(rows.sparkSession, f"{folder}/metadata", json.dumps(meta))
    return meta


def write_test_sets(test_sets: DataFrame, path: str, seed: int, n_training: int) -> None:
    """K8: ids by split, with seed and the number of excluded training ids in every row's folder metadata."""
    test_sets.withColumns({"seed": F.lit(seed), "total_training_ids": F.lit(n_training)}).write.mode("overwrite").partitionBy("split").parquet(path)


def fetch_rows(raw: DataFrame, ids: DataFrame, path: str) -> None:
    """K9: the raw rows of wanted ids (semi-join), each once."""
    once(with_ids(raw, ids), "trajectory_id").write.mode("overwrite").json(path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Token arrays as parquet."""
    examples.write.mode("overwrite").parquet(path)


def merge_results(existing: DataFrame, new: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Results of models already there are kept, with ``force`` replaced."""
    if force:
        return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def publishable(rows: DataFrame) -> DataFrame:
    """The fixed columns of a published subset."""
    return normalise_schema(rows, PUBLISHED)


def markdown(df: DataFrame, order: list[str]) -> str:
    """A small result table (one row a model, split or subset) as a Markdown table, whole."""
    rows = df.orderBy(*order).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
