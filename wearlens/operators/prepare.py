"""Projection and normalization of telemetry."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, parse_time
from ..functions.ordered import HOUR, row_index
from ..schemas import DEFAULT_FEATURE_SET, FEATURE_META, READINGS, SENSORS, SETTINGS, require

# Prediction columns in order of preference, and readable names of the score columns.
PREDICTION_COLUMNS = ("hybrid_prediction", "prediction", "lstm_prediction")
SCORE_NAMES = {
    "isolation_forest_score": "Isolation Forest",
    "local_outlier_factor_score": "Local Outlier Factor",
    "zscore_score": "Z-Score Distance",
    "mad_score": "MAD Distance",
    "reconstruction_error": "Reconstruction Error",
}


def strict_time(c: Column) -> Column:
    """Timestamp; the job fails on the first value that is none."""
    failed = F.raise_error(F.lit("A value of event_time is no time.")).cast("timestamp")
    return F.coalesce(parse_time(c), failed)


def prepare_batch(
    raw: DataFrame,
    sensors: list[str] | None = None,
    source_file: str | Column | None = None,
    ties: tuple[str, ...] = ("run_id",),
) -> DataFrame:
    """Strict UTC time, default run id, default cycle (running count per equipment by time, then `ties`), numeric sensors.

    Readings of one equipment with equal times and ties have no order of their own; name columns that tell them apart."""
    sensors = sensors or SENSORS
    require(raw, ["event_time", "equipment_id", *sensors], "prepare telemetry batch")
    out = raw.withColumns(
        {"event_time": strict_time(F.col("event_time")), **{s: F.col(s).cast("double") for s in sensors}}
    )
    if "run_id" not in out.columns:
        out = out.withColumn("run_id", F.concat(F.col("equipment_id").cast("string"), F.lit("_batch_run_001")))
    if "cycle" not in out.columns:
        bucket = F.floor(F.unix_micros("event_time") / HOUR)
        out = row_index(out, ["equipment_id"], ["event_time", *ties], bucket, "cycle")
    if source_file is not None and "source_file" not in out.columns:
        out = out.withColumn("source_file", source_file if isinstance(source_file, Column) else F.lit(source_file))
    return out


def to_telemetry(
    cycles: DataFrame,
    fd: str | Column,
    split: str | Column,
    cycle_seconds: int = 60,
    start_time: str = "2026-01-01T00:00:00Z",
    failure_label: int = 0,
    columns: list[str] | None = None,
) -> DataFrame:
    """Unit/cycle rows as readings: times and names follow from unit and cycle."""
    columns = columns or READINGS
    require(cycles, {"unit", "cycle", *SETTINGS, *SENSORS}.intersection(columns) | {"unit", "cycle"}, "map cycles")
    parsed = datetime.fromisoformat(start_time.replace("Z", "+00:00"))
    start = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
    start_us = round(start.timestamp() * MICROS)
    fd = F.lit(fd) if isinstance(fd, str) else fd
    split = F.lit(split) if isinstance(split, str) else split
    step = F.lit(cycle_seconds).cast("long") * MICROS
    equipment = F.format_string("%s_%s_unit_%03d", fd, split, F.col("unit").cast("long"))
    derived = {
        "event_time": F.timestamp_micros(F.lit(start_us).cast("long") + (F.col("cycle").cast("long") - 1) * step),
        "equipment_id": equipment,
        "run_id": F.concat(equipment, F.lit("_run_001")),
        "failure_label": F.lit(failure_label).cast("short"),
    }
    return cycles.withColumns(derived).select(*columns)


def feature_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    require(df, columns, "build anomaly features")
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def pack_features(features: DataFrame, version: str = DEFAULT_FEATURE_SET) -> DataFrame:
    """Reading key, cycle, source, version and one JSON payload; NaN becomes null and its key is kept."""
    require(features, ["event_time", "equipment_id", "run_id"], "load feature rows")
    names = [c for c in features.columns if c not in FEATURE_META]
    doubles = {f.name for f in features.schema.fields if f.dataType.typeName() in ("double", "float")}
    payload = [(F.when(~F.isnan(c), F.col(c)) if c in doubles else F.col(c)).alias(c) for c in names]
    defaults = {
        "cycle": F.lit(None).cast("long"),
        "source_file": F.lit(None).cast("string"),
        "feature_set_version": F.lit(version),
    }
    meta = [F.col(c) if c in features.columns else defaults[c].alias(c) for c in FEATURE_META[3:]]
    return features.select(
        strict_time(F.col("event_time")).alias("event_time"),
        "equipment_id",
        "run_id",
        *meta,
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("feature_payload"),
    )


def pack_long_features(
    features: DataFrame, version: str = DEFAULT_FEATURE_SET, blocks: dict[str, list[str]] | None = None
) -> DataFrame:
    """Long features as one map per reading; a reading has a fixed number of features. Rows that hold the `values` of a
    `block` are named by `blocks` after they have met, so that no name is shuffled."""
    meta = [c for c in FEATURE_META if c in features.columns and c != "feature_set_version"]
    if blocks is None:
        payload = F.map_from_entries(F.collect_list(F.struct("feature", "feature_value")))
        return features.groupBy(*meta).agg(payload.alias("feature_payload")).withColumn("feature_set_version", F.lit(version))
    order = list(blocks)
    place = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(order) for x in (b, i)]), F.col("block")).cast("short")
    met = (
        features.select(*meta, F.struct(place.alias("place"), "values").alias("part"))
        .groupBy(*meta)
        .agg(F.collect_list("part").alias("parts"))
    )
    names = F.array(*[F.array(*[F.lit(n) for n in blocks[b]]) if blocks[b] else F.array().cast("array<string>") for b in order])
    keys = F.flatten(F.transform("parts", lambda p: F.element_at(names, p["place"].cast("int") + 1)))
    payload = F.map_from_arrays(keys, F.flatten(F.transform("parts", lambda p: p["values"])))
    return met.select(*meta, payload.alias("feature_payload"), F.lit(version).alias("feature_set_version"))


def payload_values(packed: DataFrame, names: list[str], version: str | None = None) -> DataFrame:
    """Read named features back out of a JSON or map payload, optionally of one feature set version."""
    rows = packed if version is None else packed.where(F.col("feature_set_version") == version)
    payload = F.col("feature_payload")
    if dict(packed.dtypes)["feature_payload"] == "string":
        payload = F.from_json(payload, "map<string,double>")
    return rows.select(
        "event_time", "equipment_id", "run_id", *[F.try_element_at(payload, F.lit(n)).alias(n) for n in names]
    )


def first_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The first rows by an explicit order; all of them when `rows` is not positive."""
    return df.orderBy(*order).limit(rows) if rows > 0 else df


def unit_slice(forecasts: DataFrame, schedule: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """Forecast rows and schedule rows of one unit."""
    return forecasts.where(F.col("unit") == unit), schedule.where(F.col("equipment_id") == f"unit_{unit}")


def prediction_column(df: DataFrame) -> str:
    for name in PREDICTION_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"None of the columns {PREDICTION_COLUMNS} is there.")


def long_scores(df: DataFrame, label: str, scores: list[str], ids: list[str] | None = None) -> DataFrame:
    """One row per (row, detector): label, readable method name, score."""
    long = df.select(*(ids or []), label, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(
        [*(ids or []), label], scores, "method_key", "score"
    )
    names = F.create_map(*[F.lit(x) for pair in SCORE_NAMES.items() for x in pair])
    return long.withColumn("method", F.coalesce(F.try_element_at(names, F.col("method_key")), F.col("method_key")))
