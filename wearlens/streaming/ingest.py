"""JSON reading messages: parsing, routing of bad ones, idempotent load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import parse_double, parse_time
from ..schemas import READING_KEY, READINGS
from ..sinks.tables import insert_if_absent


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of text lines (`value`) from a folder of JSON-lines files."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_topic(
    spark: SparkSession, servers: str, topic: str, start: str = "latest", per_trigger: int | None = None
) -> DataFrame:
    """Stream of messages (`value`) of a Kafka topic; needs the Kafka connector on the cluster."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.floor(parse_double(text)).cast("bigint"))


def parse_messages(messages: DataFrame, columns: list[str] | None = None, text: str = "value") -> DataFrame:
    """Typed reading columns plus `reason`: null for a good message, else why it was refused.

    Keys beyond `columns` are dropped.
    """
    columns = columns or READINGS
    found = messages.withColumn("_m", F.from_json(F.col(text).cast("string"), "map<string,string>"))
    required = F.array(*[F.lit(c) for c in sorted(columns)])
    missing = F.filter(required, lambda c: ~F.map_contains_key("_m", c))
    typed: dict[str, Column] = {}
    for c in columns:
        raw = F.try_element_at("_m", F.lit(c))
        if c == "event_time":
            typed[c] = parse_time(raw)
        elif c == "cycle":
            typed[c] = _whole(raw)
        elif c == "failure_label":
            typed[c] = _whole(raw).try_cast("smallint")
        elif c.startswith(("sensor_", "setting_")):
            typed[c] = parse_double(raw)
        else:
            typed[c] = raw
    parsed = found.withColumns(typed)
    invalid = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    reason = (
        F.when(F.col("_m").isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
        .when(F.size(invalid) > 0, F.concat(F.lit("invalid values: "), F.array_join(invalid, ", ")))
    )
    return parsed.select(F.col(text).alias("message"), *columns, reason.alias("reason"))


def good_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("message", "reason")


def refused_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL").select("message", "reason")


def load_stream(
    messages: DataFrame,
    table: str,
    quarantine: str,
    checkpoint: str,
    columns: list[str] | None = None,
    bounded: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Load good messages once per reading key and keep refused ones with their reason.

    The source position is committed only after both writes. A repeated micro-batch finds its keys in the
    table already, and its refused rows replace those of the first attempt. A batch without refused messages leaves
    no folder in the quarantine.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch, columns).persist()
        try:
            insert_if_absent(good_messages(parsed), table, key=READING_KEY)
            refused = refused_messages(parsed)
            if not refused.isEmpty():
                refused.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    writer = messages.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if bounded else writer.trigger(processingTime=interval)
    return writer.start()


def unique_readings(parsed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming de-duplication on the reading key with state bounded by the watermark."""
    return parsed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(READING_KEY)
