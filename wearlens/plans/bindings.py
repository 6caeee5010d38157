"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import attach_facts
from ..functions.ordered import CYCLE_BUCKET, HOUR, row_index
from ..schemas import SENSORS, SETTINGS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as sensor readings, before a cycle is assigned."""
    events = table(spark, folder, "events")
    equipment = F.format_string("engine_%03d", "user_id")
    return events.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
        equipment.alias("equipment_id"),
        F.concat(equipment, F.lit("_batch_run_001")).alias("run_id"),
        F.col("value").alias("sensor_1"),
        F.get_json_object("props", "$.k").cast("double").alias("sensor_2"),
        (F.col("event_type") == "error").cast("int").alias("failure_label"),
        "event_id",
        F.col("user_id").alias("unit"),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with `cycle`, the position of the row inside its equipment."""
    rows = raw_readings(spark, folder)
    return row_index(rows, ["equipment_id"], ["event_us", "event_id"], F.floor(F.col("event_us") / HOUR), "cycle")


def unit_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Readings by unit with the remaining life `rul` and a straight-line `prediction` of it."""
    rows = readings(spark, folder).withColumn("row_index", F.col("cycle"))
    lives = raw_readings(spark, folder).groupBy("unit").agg(F.count(F.lit(1)).alias("life"))
    known = attach_facts(rows, lives, ["unit"], "cycle", "inner").withColumn("rul", F.col("life") - F.col("cycle")).drop("life")
    # Slope and intercept over all units follow from the life lengths alone: cycles are 1..life.
    n = F.sum("life")
    cycle_sum = F.sum(F.expr("life * (life + 1) / 2"))
    square_sum = F.sum(F.expr("life * (life + 1) * (2 * life + 1) / 6"))
    rul_sum = F.sum(F.expr("life * (life - 1) / 2"))
    cross_sum = F.sum(F.expr("life * life * (life + 1) / 2 - life * (life + 1) * (2 * life + 1) / 6"))
    slope = (n * cross_sum - cycle_sum * rul_sum) / (n * square_sum - cycle_sum * cycle_sum)
    line = lives.agg(F.struct(slope.alias("slope"), ((rul_sum - slope * cycle_sum) / n).alias("start")))
    fitted = line.scalar()
    return known.withColumn(
        "prediction", F.round(fitted["start"] + fitted["slope"] * F.col("cycle"), 6)
    )


ELEMENTS = [f"sensor_{i}" for i in range(1, 65)]


def matrix(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Vectors as a unit/cycle table: unit = label, elements under the given names.

    By default the 21 sensors and 3 settings that the readers' files have; ELEMENTS names all 64.
    """
    vectors = table(spark, folder, "embeddings")
    rows = row_index(
        vectors.select("vec_id", F.col("label").alias("unit"), "embedding"),
        ["unit"],
        ["vec_id"],
        F.floor(F.col("vec_id") / CYCLE_BUCKET),
        "cycle",
    )
    picked = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names or SENSORS + SETTINGS)]
    return rows.select("unit", "cycle", "vec_id", *picked)
