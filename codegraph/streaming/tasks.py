"""Streaming forms of the batch operators (an extension).

Files that arrive in a folder are classified and chunked by the same
expressions as in batch; the task log keeps the latest event of each task
within a watermark and writes it idempotently by batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, classify


def arriving_files(spark: SparkSession, folder: str, schema: str = "source_uri string, revision string, path string, content string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def arriving_chunks(files: DataFrame) -> DataFrame:
    """Chunks of the supported files of a stream; stateless, so rows flow through."""
    kept = classify.classify(files).filter(F.col("model_type").isNotNull())
    return chunks.chunks(kept.select("source_uri", "revision", "path", "content"), keep=["source_uri", "revision", "path"])


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def latest_state(events: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the newest event of each (user_id, event_type) as a table.

    Every micro-batch merges into the next version of the table, named by its
    batch id; a replayed batch writes the same version again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("s")).select("user_id", "event_type", "s.*")
        if batch_id:
            newest = spark.read.parquet(f"{path}/v{batch_id - 1}").unionByName(newest).groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("s")).select("user_id", "event_type", "s.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
