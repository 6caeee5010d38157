"""Data-quality checks: one aggregation over the batch plus one grouped count for key uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_double, parse_time
from ..schemas import SENSORS

# The inclusive range every sensor must stay in.
SENSOR_MIN, SENSOR_MAX = 0.0, 2000.0


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required).difference(df.columns))


def _check(name: str, bad: Column, elements: Column, good_text: str, bad_text: str) -> Column:
    bad = F.coalesce(bad, F.lit(0)).cast("long")
    return F.struct(
        F.lit(name).alias("name"),
        (bad == 0).alias("success"),
        F.when(bad == 0, good_text).otherwise(bad_text).alias("details"),
        elements.cast("long").alias("element_count"),
        bad.alias("unexpected_count"),
    )


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows share their key with another row."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return repeated.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"))


def validation_checks(
    df: DataFrame,
    sensors: list[str] | None = None,
    low: float = SENSOR_MIN,
    high: float = SENSOR_MAX,
    mode: str = "strict",
    time: str = "event_time",
    equipment: str = "equipment_id",
    run: str = "run_id",
) -> DataFrame:
    """`name, success, details, element_count, unexpected_count` per check.

    `strict`: a null or non-numeric sensor value also fails the range check.
    `lenient`: null-ness is its own check and the range check ignores nulls.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"Unknown validation mode: {mode}")
    sensors = sensors or SENSORS
    keys = [time, equipment] + ([run] if run in df.columns else [])
    missing = missing_columns(df, [time, equipment, *sensors])
    absent_keys = [k for k in keys if k not in df.columns]
    present = [s for s in sensors if s in df.columns]
    is_time = F.lit(False)
    if time in df.columns:
        typed = dict(df.dtypes)[time].startswith("timestamp")
        is_time = (F.col(time) if typed else parse_time(F.col(time))).isNotNull()
    null_key = F.lit(True)
    if not absent_keys:
        null_key = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(~is_time).alias("bad_time"), F.count_if(null_key).alias("bad_key")]
    if equipment in df.columns:
        counts.append(F.count_if(F.col(equipment).isNull()).alias("bad_equipment"))
    for s in present:
        number = parse_double(F.col(s))
        inside = number.between(low, high)
        counts.append(F.count_if(number.isNull()).alias(f"null_{s}"))
        counts.append(F.count_if(~inside).alias(f"outside_{s}"))
    totals = df.agg(*counts)
    n = F.col("n")
    repeated = n if absent_keys else duplicate_rows(df, keys).scalar()
    named = "every column is there" if not missing else f"absent columns: {', '.join(missing)}"
    required = _check("required_columns", F.lit(len(missing)), F.lit(len(sensors) + 2), named, named)
    unique = _check("unique_batch_keys", repeated, n, "every key occurs once", "some keys occur more than once")
    bounds = f"[{low}, {high}]"
    if mode == "strict":
        checks = [
            required,
            _check("event_time_parseable", F.col("bad_time"), n, "every time can be read",
                   "some times cannot be read"),
            _check("key_columns_non_null", F.col("bad_key"), n, "no key is empty", "some keys are empty"),
            unique,
        ]
        for s in present:
            nulls, outside = F.col(f"null_{s}"), F.col(f"outside_{s}")
            checks.append(_check(f"{s}_numeric", nulls, n, "all values are numbers", "some values are no numbers"))
            checks.append(_check(f"{s}_range", nulls + outside, n, f"all values in {bounds}", f"some values out of {bounds}"))
    else:
        missing_equipment = F.col("bad_equipment") if equipment in df.columns else n
        checks = [
            required,
            _check("event_time_non_null", F.col("bad_time"), n, "no value is absent", "some values are absent"),
            _check("equipment_id_non_null", missing_equipment, n, "no value is absent", "some values are absent"),
            unique,
        ]
        for s in present:
            nulls, outside = F.col(f"null_{s}"), F.col(f"outside_{s}")
            checks.append(_check(f"{s}_non_null", nulls, n, "no value is absent", "some values are absent"))
            checks.append(_check(f"{s}_range", outside, n - nulls, f"all values in {bounds}", f"some values out of {bounds}"))
    return totals.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def with_percent(checks: DataFrame) -> DataFrame:
    """Add the share of unexpected elements in percent (0 for an empty batch)."""
    share = F.coalesce(100.0 * F.col("unexpected_count") / F.nullif(F.col("element_count"), F.lit(0)), F.lit(0.0))
    return checks.withColumn("unexpected_percent", share)


def validation_report(checks: DataFrame, engine: str = "spark") -> DataFrame:
    """One row: overall success and a JSON list of the checks (their number is set by the columns)."""
    listed = F.array_sort(F.collect_list(F.struct("name", "success", "details")))
    return checks.agg(
        F.bool_and("success").alias("success"),
        F.lit(engine).alias("engine"),
        F.count(F.lit(1)).alias("check_count"),
        F.count_if(~F.col("success")).alias("failed_count"),
        F.to_json(listed).alias("checks"),
    )


def gate(checks: DataFrame) -> None:
    """Raise with the failed checks; call before any write."""
    failed = checks.where(~F.col("success")).orderBy("name").collect()
    if failed:
        summary = "; ".join(f"{r['name']}: {r['details']}" for r in failed)
        raise ValueError(f"The batch did not pass its checks: {summary}")


def missing_values(df: DataFrame) -> DataFrame:
    """`column, missing_count` for columns with missing values; one row `none, 0` when there are none."""
    columns = df.columns
    kinds = dict(df.dtypes)

    def absent(c: str) -> Column:
        return F.isnull(c) | F.isnan(c) if kinds[c] in ("double", "float") else F.isnull(c)

    counted = df.agg(*[F.count_if(absent(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in columns])
    found = F.filter(pairs, lambda p: p["missing_count"] > 0)
    none = F.array(F.struct(F.lit("none").alias("column"), F.lit(0).cast("long").alias("missing_count")))
    return counted.select(F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("m")).select("m.*")
