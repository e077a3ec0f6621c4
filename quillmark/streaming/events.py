"""Streams of observations: late ones marked and kept, and events registered once each, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.revisions import event_kind, registered


def classified(observations: DataFrame) -> DataFrame:
    """observations(…, published_at, observed_at, version) with event_kind and late. Nothing is dropped for being late, so there is no watermark."""
    kind = event_kind(F.col("published_at"), F.col("observed_at"), F.col("version"))
    return observations.withColumn("event_kind", kind).withColumn("late", F.col("event_kind") == "late_discovery")


def register_stream(events: DataFrame, path: str, checkpoint: str, key: str, payload: list[str], observed: str) -> StreamingQuery:
    """Appends to a Parquet table each event whose key isn't there yet; a batch that is run again adds nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = registered(batch, key, payload, [observed]).select(key, observed, *payload)
        try:
            known = spark.read.schema(fresh.schema).parquet(path).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = fresh.select(key).where("false")
        fresh.join(known, key, "left_anti").write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, minutes: int, delay: str) -> DataFrame:
    """Events by tumbling window and kind; windows close when the watermark, `delay` behind the newest event, has passed."""
    return events.withWatermark("observed_at", delay).groupBy(F.window("observed_at", f"{minutes} minutes"), "event_kind").agg(F.count("*").alias("n"))


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """New Parquet files of a folder as a stream, with the columns of a table."""
    return spark.readStream.schema(like.schema).parquet(folder)
