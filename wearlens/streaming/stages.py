"""Stream stages between the raw readings and the consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import distance_score
from ..sinks.tables import keyed_messages


def cleaned_features(
    readings: DataFrame, sensors: list[str], length: str = "1 hour", slide: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Count, mean, population std, min and max per equipment and sliding event-time window."""
    stats = [
        f(F.col(s)).alias(f"{s}_{n}")
        for s in sensors
        for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    ]
    windowed = readings.withWatermark("event_time", delay).groupBy(F.window("event_time", length, slide), "equipment_id")
    grouped = windowed.agg(F.count(F.lit(1)).alias("readings"), *stats)
    return grouped.select(
        "equipment_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "readings",
        *[f"{s}_{n}" for s in sensors for n in ("mean", "std", "min", "max")],
    )


def tagged_anomalies(readings: DataFrame, reference: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """Readings whose distance to a fitted reference reaches the threshold, with their score."""
    return readings.withColumn("score", distance_score(reference, features)).where(F.col("score") >= threshold)


def publish_stream(rows: DataFrame, path: str, checkpoint: str, topic_key: str = "equipment_id") -> StreamingQuery:
    """Write a stage as JSON lines `{"key": ..., "value": ...}`."""
    keyed = keyed_messages(rows, topic_key)
    return (
        keyed.writeStream.format("json")
        .option("ignoreNullFields", "false")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def publish_topic(rows: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "equipment_id") -> StreamingQuery:
    """Write a stage to a Kafka topic; needs the Kafka connector on the cluster."""
    return (
        keyed_messages(rows, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )
