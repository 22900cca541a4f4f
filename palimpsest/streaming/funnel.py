"""Event funnels over a stream, an extension of the batch counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """A file stream of the events in a folder, with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def funnel(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, value) per tumbling window; the same plan serves batch and stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def running_count(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def notify(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls handler with the rows that came in and the batch's number, once for every batch that has any."""

    def on_insert(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            handler(rows, batch)

    return stream.writeStream.foreachBatch(on_insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; append writes Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
