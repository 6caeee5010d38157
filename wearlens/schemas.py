"""Column names and types of the tables this package reads and writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SETTINGS = [f"setting_{i}" for i in range(1, 4)]
SENSORS = [f"sensor_{i}" for i in range(1, 22)]
UNIT_CYCLE = ["unit", "cycle", *SETTINGS, *SENSORS]
READING_KEY = ["event_time", "equipment_id", "run_id"]
READINGS = [*READING_KEY, "cycle", *SETTINGS, *SENSORS, "failure_label"]
FEATURE_META = [*READING_KEY, "cycle", "source_file", "feature_set_version"]

# Fixed value: the version written when a feature row names none.
DEFAULT_FEATURE_SET = "day4_v1"


def _struct(fields: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


UNIT_CYCLE_SCHEMA = _struct(
    [("unit", T.IntegerType()), ("cycle", T.IntegerType())] + [(c, T.DoubleType()) for c in SETTINGS + SENSORS]
)
READING_SCHEMA = _struct(
    [("event_time", T.TimestampType()), ("equipment_id", T.StringType()), ("run_id", T.StringType())]
    + [("cycle", T.LongType())]
    + [(c, T.DoubleType()) for c in SETTINGS + SENSORS]
    + [("failure_label", T.ShortType())]
)
# Messages and raw batches arrive as text, so that a bad value can be reported instead of lost.
MESSAGE_SCHEMA = _struct([(c, T.StringType()) for c in READINGS])


def require(df: DataFrame, columns: Iterable[str], purpose: str) -> None:
    """Raise with the sorted list of absent columns."""
    missing = sorted(set(columns).difference(df.columns))
    if missing:
        raise ValueError(f"Cannot {purpose} without columns: {', '.join(missing)}")


def sensor_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("sensor_")]


def sequence_columns(df: DataFrame) -> list[str]:
    """Settings present in the frame, then its sensors."""
    columns = [c for c in SETTINGS if c in df.columns] + sensor_columns(df)
    if not columns:
        raise ValueError("No sequence feature columns were found.")
    return columns
