"""Composed runs: batch features, detector comparison, forecast to plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detect import inject_anomalies, reconstruction_scores, score_statistics
from ..operators.features import engineer_features, feature_blocks
from ..operators.forest import isolation_scores
from ..operators.maintenance import (
    CostRates, Resources, cheapest_days, maintenance_tasks, priced_schedule, scenario_costs, schedule_summary,
    task_day_costs,
)
from ..operators.metrics import best_first, ranking_metrics, score_curve
from ..operators.neighbours import local_outlier_factor
from ..operators.prepare import pack_long_features, prepare_batch
from ..operators.sequences import sequence_windows
from ..operators.validate import gate, validation_checks
from ..functions.ordered import HOUR, row_index
from ..session import written
from ..sinks.tables import upsert

ROW_SCORES = ["isolation_forest_score", "local_outlier_factor_score", "zscore_score", "mad_score"]


def run_batch(raw: DataFrame, table: str, sensors: list[str], version: str, source_file: str | Column | None = None) -> DataFrame:
    """CSV or table rows to stored features in one plan: normalize, validate (raises before any write),
    engineer, pack, upsert. Returns the packed rows."""
    bucket = F.floor(F.unix_micros("event_time") / HOUR)
    prepared = prepare_batch(raw, sensors, source_file)
    placed = written(row_index(prepared, ["equipment_id"], ["event_time", "run_id"], bucket), "prepared")
    gate(validation_checks(placed, sensors))
    packed = pack_long_features(engineer_features(placed, sensors, blocks=True), version, feature_blocks(sensors))
    stored = packed.withColumn("arrival", F.lit(0))
    upsert(stored, table, arrival=["arrival"])
    return prepared.sparkSession.read.option("mergeSchema", True).parquet(table)


def score_detectors(
    train: DataFrame, rows: DataFrame, features: list[str], trees: int = 300, neighbours: int = 35, contamination: float = 0.08
) -> DataFrame:
    """Row scores of the two reference distances, the isolation forest and the local outlier factor."""
    # Numbers of written rows never meet, as hashes may; the forest samples by a hash that does not depend on the partitions.
    number = F.monotonically_increasing_id()
    known = written(train.withColumns({"_row": number, "_key": F.xxhash64("unit", "cycle")}), "train-rows")
    labelled = written(rows.withColumn("_row", number), "scored-rows")
    scored = score_statistics(known, labelled, features)
    scored = isolation_scores(known, scored, "_key", features, contamination, trees)
    # Distances are taken between standardized rows.
    from ..operators.detect import zscore_reference
    from ..operators.sequences import fitted_values, scaled

    reference = fitted_values(zscore_reference(known, features))
    vector = F.array(*[scaled(f, reference) for f in features]).alias("v")
    local = local_outlier_factor(known.select("_row", vector), labelled.select("_row", vector), "_row", "v", neighbours)
    return scored.join(local, "_row").drop("_row")


def row_experiment(
    train: DataFrame, holdout: DataFrame, features: list[str], fraction: float = 0.08, contamination: float = 0.08,
    seed: int = 42, trees: int = 300, neighbours: int = 35, append: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Scored rows with injected anomalies, and the ranking metrics, best average precision first."""
    if not 0 < contamination < 0.5:
        raise ValueError("The expected share of anomalies has to lie above 0 and below one half.")
    labelled = inject_anomalies(holdout, fraction, seed, features, append)
    scored = written(score_detectors(train, labelled, features, trees, neighbours, contamination), "row-scores")
    return scored, best_first(ranking_metrics(score_curve(scored, "is_anomaly", ROW_SCORES)), "pr_auc")


def window_experiment(
    train: DataFrame, holdout: DataFrame, features: list[str], length: int = 30, stride: int = 5, fraction: float = 0.08,
    contamination: float = 0.08, seed: int = 42, trees: int = 300, neighbours: int = 35,
) -> tuple[DataFrame, DataFrame]:
    """All detectors on the same windows: largest row score per window, and the reconstruction error."""
    labelled = written(inject_anomalies(holdout, fraction, seed, features, append=False), "labelled")
    scored = score_detectors(train, labelled, features, trees, neighbours, contamination)
    by_row = sequence_windows(scored, length, stride, label="is_anomaly", scores=ROW_SCORES)
    rebuilt, _ = reconstruction_scores(train, labelled, features, length, stride, contamination=contamination)
    keys = ["unit", "window_start_index", "window_end_index", "window_length", "cycle_start", "cycle_end", "is_anomaly_window"]
    windows = written(rebuilt.join(by_row, keys, "left"), "window-scores")
    curve = score_curve(windows, "is_anomaly_window", ["reconstruction_error", *ROW_SCORES])
    return windows, best_first(ranking_metrics(curve), "pr_auc")


def plan_maintenance(
    predictions: DataFrame, resources: Resources | None = None, rates: CostRates | None = None, max_tasks: int | None = None,
    cycles_per_day: float = 5.0,
) -> dict[str, DataFrame]:
    """Tasks, cheapest-day schedule, summary and scenarios from a forecast table."""
    resources, rates = resources or Resources(), rates or CostRates()
    tasks = written(maintenance_tasks(predictions, cycles_per_day, resources.horizon_days, rates, max_tasks), "tasks")
    days = cheapest_days(task_day_costs(tasks, resources, rates))
    schedule = priced_schedule(tasks, days, resources, rates)
    return {
        "tasks": tasks,
        "schedule": schedule,
        "summary": schedule_summary(schedule),
        "scenarios": scenario_costs(tasks, days, resources, rates),
    }
