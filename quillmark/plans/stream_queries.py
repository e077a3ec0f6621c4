"""Queries that run a stream to its end and return what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.ledger_queries import reservations
from quillmark.plans.registry import ORACLES, query
from quillmark.plans.workflow_queries import lease_commands
from quillmark.sources.folders import shared_folder
from quillmark.sources.tables import table
from quillmark.streaming import events as streams
from quillmark.streaming import folds


def stream_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("""
SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 4 = 0 THEN 'late_discovery' WHEN event_id % 3 = 0 THEN 'new_work' ELSE 'revision_available' END AS event_kind, event_id % 4 = 0 AND event_id % 9 > 0 AS late FROM events
""")
def streamed_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Observations classified in a stream, registered once each in a table that is read back. Late ones are kept."""
    like = table(spark, folder, "events")
    place = stream_folder(spark)
    source = streams.read_stream(spark, f"{folder}/events*.parquet", like)
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    published = F.when(k % 9 == 0, at + F.expr("INTERVAL 1 DAY")).when(k % 4 == 0, at - F.expr("INTERVAL 20 DAYS")).otherwise(at - F.expr("INTERVAL 1 DAY"))
    rows = source.select("event_id", "user_id", at.alias("observed_at"), published.alias("published_at"), F.when(k % 3 == 0, 1).otherwise(2).alias("version"))
    kinds = streams.classified(rows).select("event_id", "user_id", "observed_at", "event_kind", "late")
    streams.register_stream(kinds, f"{place}/events", f"{place}/offsets", "event_id", ["user_id", "event_kind", "late"], "observed_at").awaitTermination()
    return spark.read.parquet(f"{place}/events").select("event_id", "user_id", "event_kind", "late")


@query("""SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS day_us, event_type AS event_kind, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAYS FROM events) GROUP BY ALL""")
def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Days that a watermark two days behind the newest event has closed, with their events by kind."""
    like = table(spark, folder, "events")
    place = stream_folder(spark)
    source = streams.read_stream(spark, f"{folder}/events*.parquet", like).select(F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_type").alias("event_kind"))
    counts = streams.windowed_counts(source, 24 * 60, "2 days").select(F.unix_micros("window.start").alias("day_us"), "event_kind", "n")
    counts.writeStream.format("parquet").option("path", f"{place}/days").option("checkpointLocation", f"{place}/offsets").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{place}/days")


def _finished(rows: DataFrame, place: str) -> DataFrame:
    """A stream run to its end, and what it has written."""
    spark = rows.sparkSession
    with folds.state_store(spark):
        rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/offsets").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/out")


@query(ORACLES["lease_replay"])
def streamed_leases(spark: SparkSession, folder: str) -> DataFrame:
    """The log of lease_replay as a stream, with the state of each job in the state store."""
    source = streams.read_stream(spark, f"{folder}/events*.parquet", table(spark, folder, "events"))
    return _finished(folds.lease_stream(lease_commands(source), 86_400), stream_folder(spark))


@query(ORACLES["budget_admission"])
def streamed_admission(spark: SparkSession, folder: str) -> DataFrame:
    """The requests of budget_admission as a stream, with what is reserved of each budget in the state store."""
    source = streams.read_stream(spark, f"{folder}/orders*.parquet", table(spark, folder, "orders"))
    requests = reservations(spark, folder, source).select("period", "currency", F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("at"), F.col("reserved").alias("amount"))
    return _finished(folds.admission_stream(requests, 900_000), stream_folder(spark))
