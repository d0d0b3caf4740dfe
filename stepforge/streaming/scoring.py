"""Incremental scoring with Structured Streaming (S1, S3): the same row-wise metrics over a file source.

The metrics need no state, since a trajectory is one row; ids scored in an
earlier batch are left out by an anti-join on what was written, so no state
grows with the stream.  With ``availableNow`` a run takes what has arrived
since the last one and ends; its checkpoint is the resume point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepforge.operators.scores import add_v1
from stepforge.operators.steps import trajectory_stats
from stepforge.sources.readers import unseen
from stepforge.sources.schema import TRAJECTORIES


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(TRAJECTORIES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score arriving trajectories into ``out``, one folder a batch; a trajectory scored in an earlier batch is skipped.

    A batch that is tried again overwrites its own folder, so no row is written
    twice; of rows of one trajectory in a batch ``trajectory_stats`` keeps the same one as on a table.
    """

    def batch(df: DataFrame, number: int) -> None:
        scored = add_v1(trajectory_stats(df))
        if number:
            earlier = df.sparkSession.read.schema("trajectory_id string, batch long").parquet(out).filter(F.col("batch") < number)
            scored = unseen(scored, earlier)
        scored.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(stream_or_batch: DataFrame, late: str = "1 day", window: str = "6 hours") -> DataFrame:
    """Events per window and type with a watermark; the same expression on a stream and on a table.

    ``ts`` without zone is read as UTC, since watermarks need a timestamp with one.
    """
    ts = F.col("ts").cast("timestamp")
    rows = stream_or_batch.withColumn("ts", ts).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
