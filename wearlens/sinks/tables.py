"""Idempotent Parquet tables: one folder per day, clustered by equipment, run and time."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schemas import READING_KEY

DATE = "event_date"
CLUSTER = ["equipment_id", "run_id", "event_time"]


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn(DATE, F.to_date("event_time"))


def write_by_day(
    df: DataFrame, path: str, mode: str = "append", compression: str = "snappy", seen: Observation | None = None
) -> None:
    """Write by day, counting the written rows in `seen`. Rows are range-partitioned by (day, equipment, run, time), so a busy day or a busy
    equipment is shared by many tasks and every file covers a narrow range of equipment."""
    ranged = _dated(df).repartitionByRange(DATE, *CLUSTER).sortWithinPartitions(DATE, *CLUSTER)
    # Counted behind the exchange: the sampling pass of the range partitioning also runs what is before it.
    counted = ranged if seen is None else ranged.observe(seen, F.count(F.lit(1)).alias("rows"))
    (
        counted.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(DATE)
        .parquet(path)
    )


def read_by_day(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= event_time < end; the day folders outside are not listed into the scan."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if start is not None:
        low = F.lit(start).cast("timestamp")
        df = df.where((F.col(DATE) >= F.to_date(low)) & (F.col("event_time") >= low))
    if end is not None:
        high = F.lit(end).cast("timestamp")
        df = df.where((F.col(DATE) <= F.to_date(high)) & (F.col("event_time") < high))
    return df


def _existing(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame | None:
    """Rows of the table in the days the batch touches, or None while there is no table.

    Files may differ in columns, since a batch may bring new ones; any other error than a missing table is raised.
    """
    try:
        table = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    days = [r[0] for r in batch.select(DATE).distinct().collect()]  # one value per calendar day
    return table.where(F.col(DATE).isin(days))


def _stored_keys(spark: SparkSession, path: str, batch: DataFrame, key: list[str]) -> DataFrame | None:
    """Day and key of those rows of the table that the batch may repeat, or None while there is no table.

    Where the time is part of the key, only rows between the batch's first and last time of a day count. The scan leaves out
    files and row groups of other times, so that a small batch reads little of a long day. Every file has the key, so
    no schemas are merged.
    """
    try:
        table = spark.read.option("mergeSchema", False).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    timed = "event_time" in key and dict(batch.dtypes)["event_time"] == "timestamp"
    time = F.unix_micros("event_time") if timed else F.lit(None).cast("long")
    # one row per calendar day
    days = batch.groupBy(DATE).agg(F.min(time).alias("low"), F.max(time).alias("high")).where(F.col(DATE).isNotNull()).collect()
    found = table.where(F.col(DATE).isin([r[DATE] for r in days]))
    if timed and days:
        at = F.col("event_time")
        ranges = [at.between(F.timestamp_micros(F.lit(r["low"])), F.timestamp_micros(F.lit(r["high"]))) for r in days]
        found = found.where(reduce(Column.__or__, ranges))
    return found.select(DATE, *key)


def first_per_key(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """One row per key, the earliest arrival. An aggregate, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    kept = F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_kept")
    return df.groupBy(*key).agg(kept).select(*key, "_kept.*").select(*df.columns)


def insert_if_absent(
    batch: DataFrame, path: str, arrival: list[str] | None = None, key: list[str] | None = None
) -> int:
    """Append the rows whose key is not in the table yet; the first of equal keys wins. Returns rows added."""
    key = key or READING_KEY
    spark = batch.sparkSession
    order = arrival or [c for c in batch.columns if c not in key]
    fresh = first_per_key(_dated(batch), key, order)
    stored = _stored_keys(spark, path, _dated(batch), key)
    if stored is not None:
        fresh = fresh.join(stored, [DATE, *key], "left_anti")
    seen = Observation()
    write_by_day(fresh, path, seen=seen)
    try:
        return int(seen.get["rows"])
    except Py4JJavaError:  # nothing was observed: execution found the rows to add empty and skipped them
        return 0


def upsert(batch: DataFrame, path: str, arrival: list[str], key: list[str] | None = None) -> None:
    """Replace rows of equal key by the newest arrival, keep their `created_at`, rewrite the touched days only.

    Columns that only the table has keep their stored values; columns that only the batch has are null in rows it does not
    replace.
    """
    key = key or READING_KEY
    spark = batch.sparkSession
    columns = [c for c in batch.columns if c not in arrival]
    body = [c for c in columns if c not in key and c != "created_at"]
    stamped = batch if "created_at" in batch.columns else batch.withColumn("created_at", F.current_timestamp())
    fresh = _dated(stamped).select(
        DATE, *key, *body, "created_at", F.struct(F.lit(1).alias("source"), *arrival).alias("_order")
    )
    existing = _existing(spark, path, fresh)
    merged, stored = fresh, []
    if existing is not None:
        stored = [c for c in existing.columns if c not in {DATE, "created_at", *key, *body, *arrival}]
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in batch.select(*arrival).schema.fields]
        kept = existing.select(
            DATE,
            *key,
            *[c for c in body if c in existing.columns],
            *stored,
            "created_at",
            F.struct(F.lit(0).alias("source"), *none).alias("_order"),
        )
        merged = kept.unionByName(fresh, allowMissingColumns=True)
    # a key has one stored row at most, so its stored-only columns are that row's
    newest = merged.groupBy(DATE, *key).agg(
        F.max_by(F.struct(*body), "_order").alias("_body"),
        *[F.min_by(c, "_order").alias(c) for c in stored],
        F.min_by("created_at", "_order").alias("created_at"),
    )
    write_by_day(newest.select(*key, "_body.*", *stored, "created_at"), path, mode="overwrite")


def stage_batch(prepared: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a normalized batch for the next stage."""
    writer = prepared.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_feature_set(features: DataFrame, path: str, version: str) -> None:
    """Write features under their version; other versions stay."""
    (
        features.withColumn("feature_set_version", F.lit(version))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("feature_set_version")
        .parquet(path)
    )


def keyed_messages(df: DataFrame, key: str = "equipment_id") -> DataFrame:
    """`key, value`: one JSON object per row, ready for a message sink or a file."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def publish(df: DataFrame, path: str, key: str = "equipment_id") -> None:
    """Batch publish of messages as JSON lines `{"key": ..., "value": ...}`."""
    keyed_messages(df, key).write.mode("append").option("ignoreNullFields", "false").json(path)


def save_run(tables: dict[str, DataFrame], root: str, run_name: str) -> None:
    """Results of one run, one table each, under a `run_name` partition."""
    for name, df in tables.items():
        (
            df.withColumn("run_name", F.lit(run_name))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_name")
            .parquet(f"{root}/{name}")
        )


def tracking_rows(
    spark: SparkSession, run_id: str, run_name: str, params: dict[str, object], metrics: DataFrame | None
) -> DataFrame:
    """Long log rows `run_id, run_name, kind, key, value`; null and NaN metrics are left out.

    `metrics` is a one-row or few-row frame whose numeric columns are the metrics; with a `model_key` column
    the keys are prefixed by it.
    """
    rows = [(run_id, run_name, "param", k, None if v is None else str(v)) for k, v in sorted(params.items())]
    log = spark.createDataFrame(rows, "run_id string, run_name string, kind string, key string, value string")
    if metrics is None:
        return log
    numeric = [c for c, t in metrics.dtypes if t in ("double", "float", "int", "bigint", "smallint")]
    typed = metrics.select(
        *(["model_key"] if "model_key" in metrics.columns else []), *[F.col(c).cast("double").alias(c) for c in numeric]
    )
    ids = ["model_key"] if "model_key" in metrics.columns else []
    long = typed.unpivot(ids, numeric, "metric", "number").where(F.col("number").isNotNull() & ~F.isnan("number"))
    key = F.concat_ws("_", *ids, "metric")
    logged = long.select(
        F.lit(run_id).alias("run_id"),
        F.lit(run_name).alias("run_name"),
        F.lit("metric").alias("kind"),
        key.alias("key"),
        F.col("number").cast("string").alias("value"),
    )
    return log.unionByName(logged)


def log_run(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
