"""From remaining-life forecasts to costed maintenance tasks, audits, scenarios and alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import row_index
from ..schemas import require
from .prepare import prediction_column
from .sequences import latest_per_unit

# Repair profiles, weekly production pattern, stock, day limits, scenarios, alert rules.
PROFILES = (
    # repair_type, repair_cost, duration_hours, required_technicians, part_name, part_quantity
    ("inspection", 2000.0, 2.0, 1, "inspection_kit", 1),
    ("minor_service", 5000.0, 4.0, 1, "service_kit", 1),
    ("component_repair", 9000.0, 6.0, 2, "rotor_assembly", 1),
    ("major_overhaul", 15000.0, 8.0, 2, "engine_core", 1),
)
PROFILE_FIELDS = ("repair_type", "repair_cost", "duration_hours", "required_technicians", "part_name", "part_quantity")
WEEKLY_PATTERN = (1.15, 1.10, 1.05, 1.00, 1.00, 0.85, 0.80)
REPAIR_LIMITS = ((3, "major_overhaul"), (7, "component_repair"), (14, "minor_service"))
STOCK = (("inspection_kit", 50), ("service_kit", 50), ("rotor_assembly", 50), ("engine_core", 50))
SCENARIOS = (
    # scenario, downtime, repair and labor multiplier
    ("base", 1.0, 1.0, 1.0),
    ("high_downtime", 1.25, 1.0, 1.0),
    ("low_downtime", 0.85, 1.0, 1.0),
    ("high_parts", 1.0, 1.20, 1.0),
    ("high_labor", 1.0, 1.0, 1.20),
    ("stress_case", 1.30, 1.15, 1.15),
)
RUL_ALERT_DAYS, RISK_ALERT_COST, DOWNTIME_ALERT_HOURS = 7.0, 25_000.0, 16.0


@dataclass(frozen=True)
class CostRates:
    downtime_per_hour: float = 10_000.0
    technician_per_hour: float = 150.0

    def __post_init__(self) -> None:
        if self.downtime_per_hour <= 0 or self.technician_per_hour <= 0:
            raise ValueError("Hourly rates must be positive.")


@dataclass(frozen=True)
class Resources:
    horizon_days: int = 14
    technician_hours_per_day: float = 24.0
    downtime_hours_per_day: float = 16.0
    multipliers: tuple[float, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.horizon_days < 1:
            raise ValueError("The horizon must be at least one day.")
        if self.technician_hours_per_day <= 0 or self.downtime_hours_per_day <= 0:
            raise ValueError("Daily limits must be positive.")
        if self.multipliers and len(self.multipliers) != self.horizon_days:
            raise ValueError("There must be one production multiplier per day of the horizon.")


def repair_profiles(spark: SparkSession) -> DataFrame:
    """The profiles as a four-row dimension."""
    kinds = "repair_type string, repair_cost double, duration_hours double, required_technicians int, part_name string, part_quantity int"
    return spark.createDataFrame(list(PROFILES), kinds)


def part_stock(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STOCK), "part_name string, stock int")


def repair_type(days: Column) -> Column:
    out = None
    for limit, name in REPAIR_LIMITS:
        out = F.when(days <= limit, name) if out is None else out.when(days <= limit, name)
    return out.otherwise("inspection")


def production_multiplier(day: Column, resources: Resources) -> Column:
    pattern = resources.multipliers or WEEKLY_PATTERN
    return F.element_at(F.array(*[F.lit(float(m)) for m in pattern]), (day % len(pattern) + 1).cast("int"))


def tasks_from_latest(
    latest: DataFrame, column: str, cycles_per_day: float = 5.0, horizon_days: int = 14, rates: CostRates | None = None
) -> DataFrame:
    """One task per unit from its latest predicted remaining life."""
    if cycles_per_day <= 0:
        raise ValueError("A day needs more than 0 cycles.")
    rates = rates or CostRates()
    rul = F.greatest(F.col(column).cast("double"), F.lit(0.0))
    based = latest.select(F.concat(F.lit("unit_"), F.col("unit").cast("long").cast("string")).alias("equipment_id"), rul.alias("predicted_rul"))
    days = F.greatest(F.col("predicted_rul") / cycles_per_day, F.lit(0.5))
    based = based.withColumn("predicted_rul_days", days)
    d = F.col("predicted_rul_days")
    preferred = F.least(F.floor(F.greatest(d - 1.0, F.lit(0.0))), F.lit(horizon_days - 1)).cast("int")
    criticality = F.least(F.greatest((14.0 - d) / 14.0, F.lit(0.1)), F.lit(1.0))
    return (
        based.withColumn("repair_type", repair_type(d))
        .withColumn("preferred_day", preferred)
        .withColumn("criticality", criticality)
        .withColumn("risk_penalty_per_day", rates.downtime_per_hour * (0.2 + F.col("criticality")))
    )


def lowest_predictions(latest: DataFrame, column: str, rows: int | None = 20) -> DataFrame:
    """The units with the lowest predicted life first; all of them when `rows` is None."""
    ordered = latest.orderBy(column, "unit")
    return latest if rows is None else ordered.limit(rows)


def maintenance_tasks(
    predictions: DataFrame,
    cycles_per_day: float = 5.0,
    horizon_days: int = 14,
    rates: CostRates | None = None,
    max_tasks: int | None = None,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """One task per unit; `max_tasks` keeps only the units with the lowest predictions."""
    require(predictions, ["unit"], "build maintenance tasks")
    column = prediction_column(predictions)
    latest = lowest_predictions(latest_per_unit(predictions, ties=ties), column, max_tasks)
    return tasks_from_latest(latest, column, cycles_per_day, horizon_days, rates)


def candidates(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("preferred_day", "predicted_rul_days", "equipment_id")


def placed_candidates(tasks: DataFrame) -> DataFrame:
    """The same order as `place` inside each preferred day, numbered by buckets of the remaining days."""
    return row_index(tasks, ["preferred_day"], ["predicted_rul_days", "equipment_id"], F.floor(F.col("predicted_rul_days") * 100), "place")


def over_days(tasks: DataFrame, horizon_days: int) -> DataFrame:
    """One row per task and day of the horizon (`day`)."""
    return tasks.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon_days - 1))))


def with_profile(tasks: DataFrame) -> DataFrame:
    """Look up the repair profile; the dimension has four rows."""
    return tasks.join(F.broadcast(repair_profiles(tasks.sparkSession)), "repair_type")


def _priced(df: DataFrame, day: str, resources: Resources, downtime: Column, labor: Column, repair: Column) -> DataFrame:
    work = F.col("duration_hours") * F.col("required_technicians") * labor
    return (
        df.withColumn("production_multiplier", production_multiplier(F.col(day), resources))
        .withColumn(
            "direct_cost",
            F.col("repair_cost") * repair + work + F.col("duration_hours") * downtime * F.col("production_multiplier"),
        )
        .withColumn(
            "risk_cost", F.greatest(F.col(day) - F.col("preferred_day"), F.lit(0)) * F.col("risk_penalty_per_day")
        )
        .withColumn("total_cost", F.col("direct_cost") + F.col("risk_cost"))
    )


def price(profiled: DataFrame, day: str, resources: Resources | None = None, rates: CostRates | None = None) -> DataFrame:
    """Add production multiplier, direct, risk and total cost of doing the task on `day`."""
    rates, resources = rates or CostRates(), resources or Resources()
    return _priced(
        profiled, day, resources, F.lit(rates.downtime_per_hour), F.lit(rates.technician_per_hour), F.lit(1.0)
    )


def task_day_costs(tasks: DataFrame, resources: Resources | None = None, rates: CostRates | None = None) -> DataFrame:
    resources = resources or Resources()
    return price(with_profile(over_days(tasks, resources.horizon_days)), "day", resources, rates)


def cheapest_days(costs: DataFrame, keys: tuple[str, ...] = ("equipment_id",)) -> DataFrame:
    """`scheduled_day` with the lowest total cost per task, the earliest on ties: a bound without capacities."""
    return costs.groupBy(*keys).agg(F.min_by("day", F.struct("total_cost", "day")).alias("scheduled_day"))


def priced_schedule(
    tasks: DataFrame, assignment: DataFrame, resources: Resources | None = None, rates: CostRates | None = None
) -> DataFrame:
    """Schedule rows of a given assignment `(equipment_id, scheduled_day)`, money rounded to cents."""
    chosen = with_profile(tasks.join(assignment.select("equipment_id", "scheduled_day"), "equipment_id"))
    priced = price(chosen, "scheduled_day", resources, rates)
    money = {c: F.round(c, 2) for c in ("direct_cost", "risk_cost", "total_cost")}
    return priced.withColumns(money).select(
        "equipment_id", "scheduled_day", "repair_type", "predicted_rul", "predicted_rul_days", "preferred_day",
        "criticality", "production_multiplier", "direct_cost", "risk_cost", "total_cost", "duration_hours",
        "required_technicians", "part_name", "part_quantity",
    )


def capacity_audit(schedule: DataFrame, resources: Resources | None = None) -> DataFrame:
    """Used and allowed technician hours and downtime hours per day and parts per kind, with an `ok` flag."""
    resources = resources or Resources()
    day = schedule.groupBy("scheduled_day").agg(
        F.sum(F.col("duration_hours") * F.col("required_technicians")).alias("technician"),
        F.sum("duration_hours").alias("downtime"),
    )
    rules = F.array(
        F.struct(F.lit("technician_hours").alias("resource"), F.col("technician").alias("used"),
                 F.lit(float(resources.technician_hours_per_day)).alias("allowed")),
        F.struct(F.lit("downtime_hours").alias("resource"), F.col("downtime").alias("used"),
                 F.lit(float(resources.downtime_hours_per_day)).alias("allowed")),
    )
    daily = day.select(
        F.concat(F.lit("day_"), F.col("scheduled_day").cast("string")).alias("bucket"), F.explode(rules).alias("r")
    ).select("bucket", "r.*")
    parts = (
        schedule.groupBy("part_name").agg(F.sum("part_quantity").cast("double").alias("used"))
        .join(F.broadcast(part_stock(schedule.sparkSession)), "part_name", "left")
        .select(
            F.col("part_name").alias("bucket"),
            F.lit("parts").alias("resource"),
            "used",
            F.coalesce("stock", F.lit(0)).cast("double").alias("allowed"),
        )
    )
    return daily.unionByName(parts).withColumn("ok", F.col("used") <= F.col("allowed"))


def schedule_summary(schedule: DataFrame, status: str = "Priced") -> DataFrame:
    """Headline numbers of a schedule; zeros when it is empty."""
    late = F.col("scheduled_day") > F.col("preferred_day")

    def total(c: Column) -> Column:
        return F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)

    return schedule.agg(
        F.lit(status).alias("solver_status"),
        F.count(F.lit(1)).alias("task_count"),
        total(F.col("total_cost")).alias("total_cost"),
        total(F.col("direct_cost")).alias("total_direct_cost"),
        total(F.col("risk_cost")).alias("total_risk_cost"),
        F.round(F.coalesce(F.avg("total_cost"), F.lit(0.0)), 2).alias("average_cost_per_task"),
        F.count_if(late).alias("tasks_after_preferred_day"),
        F.round(F.coalesce(F.avg((~late).cast("double")), F.lit(0.0)), 4).alias("on_or_before_preferred_rate"),
        total(F.col("duration_hours")).alias("total_downtime_hours"),
        total(F.col("duration_hours") * F.col("required_technicians")).alias("total_technician_hours"),
    )


def scenario_costs(
    tasks: DataFrame,
    assignment: DataFrame | None = None,
    resources: Resources | None = None,
    rates: CostRates | None = None,
    scenarios: tuple = SCENARIOS,
) -> DataFrame:
    """Totals per named scenario and how many assignments differ from the base scenario.

    Without an assignment every scenario takes its own cheapest days. An assignment with a `scenario` column gives each
    scenario its own days, one without it the same days to all. The risk per day is that of the task, so multipliers do
    not change it.
    """
    resources, rates = resources or Resources(), rates or CostRates()
    listed = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(d).alias("downtime_multiplier"), F.lit(r).alias("repair_multiplier"), F.lit(w).alias("labor_multiplier"))
        for n, d, r, w in scenarios
    ])

    def cost(df: DataFrame, day: str) -> DataFrame:
        spread = with_profile(df).withColumn("_s", F.explode(listed)).select("*", "_s.*").drop("_s")
        return _priced(
            spread, day, resources,
            rates.downtime_per_hour * F.col("downtime_multiplier"),
            rates.technician_per_hour * F.col("labor_multiplier"),
            F.col("repair_multiplier"),
        )

    if assignment is not None:
        of = F.col("scenario") if "scenario" in assignment.columns else F.lit(None).cast("string")
        given = assignment.select("equipment_id", "scheduled_day", of.alias("_of"))
        chosen = cost(tasks.join(given, "equipment_id"), "scheduled_day")
        chosen = chosen.where(F.coalesce(F.col("_of") == F.col("scenario"), F.lit(True))).drop("_of")
    else:
        days = cost(over_days(tasks, resources.horizon_days), "day")
        whole = F.struct("day", *[c for c in days.columns if c not in ("day", "equipment_id", "scenario")])
        best = days.groupBy("equipment_id", "scenario").agg(F.min_by(whole, F.struct("total_cost", "day")).alias("b"))
        chosen = best.select("equipment_id", "scenario", "b.*").withColumnRenamed("day", "scheduled_day")
    # Base day beside every scenario of the same task: the same rows, regrouped by task.
    base = chosen.where(F.col("scenario") == scenarios[0][0]).select("equipment_id", F.col("scheduled_day").alias("base_day"))
    chosen = chosen.join(base, "equipment_id", "left")
    changed = F.count_if(~F.col("scheduled_day").eqNullSafe(F.col("base_day")))
    late = F.col("scheduled_day") > F.col("preferred_day")
    grouped = chosen.groupBy("scenario", "downtime_multiplier", "repair_multiplier", "labor_multiplier").agg(
        F.round(F.sum("total_cost"), 2).alias("total_cost"),
        F.round(F.sum("risk_cost"), 2).alias("total_risk_cost"),
        F.count_if(late).alias("tasks_after_preferred_day"),
        F.round(F.avg((~late).cast("double")), 4).alias("on_or_before_preferred_rate"),
        changed.alias("changed_assignments"),
        F.count(F.lit(1)).alias("_tasks"),
    )
    stable = F.round(1.0 - F.col("changed_assignments") / F.greatest("_tasks", F.lit(1)), 4)
    return grouped.withColumn("schedule_robustness", stable).drop("_tasks")


def scenario_picks(scenarios: DataFrame) -> DataFrame:
    """The cheapest and the most robust scenario."""
    cheap = F.struct("total_cost", "total_risk_cost", "scenario")
    firm = F.struct((-F.col("schedule_robustness")).alias("r"), "total_cost", "scenario")
    return scenarios.agg(
        F.min_by("scenario", cheap).alias("lowest_cost_scenario"), F.min_by("scenario", firm).alias("most_robust_scenario")
    )


def tradeoff(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("scenario", "total_risk_cost", "total_cost")


def alerts(
    schedule: DataFrame,
    rul_days: float = RUL_ALERT_DAYS,
    risk_cost: float = RISK_ALERT_COST,
    downtime_hours: float = DOWNTIME_ALERT_HOURS,
) -> DataFrame:
    """`(subject, rule, value, threshold)` for short lives, costly risk, late tasks and overbooked days."""
    rules = F.array(
        F.struct(F.lit("predicted_rul_days").alias("rule"), F.col("predicted_rul_days").alias("value"),
                 F.lit(float(rul_days)).alias("threshold"), (F.col("predicted_rul_days") < rul_days).alias("hit")),
        F.struct(F.lit("risk_cost").alias("rule"), F.col("risk_cost").alias("value"),
                 F.lit(float(risk_cost)).alias("threshold"), (F.col("risk_cost") > risk_cost).alias("hit")),
        F.struct(F.lit("scheduled_late").alias("rule"), F.col("scheduled_day").cast("double").alias("value"),
                 F.col("preferred_day").cast("double").alias("threshold"),
                 (F.col("scheduled_day") > F.col("preferred_day")).alias("hit")),
    )
    rows = schedule.select(F.col("equipment_id").alias("subject"), F.explode(F.filter(rules, lambda r: r["hit"])).alias("r"))
    own = rows.select("subject", "r.rule", "r.value", "r.threshold")
    days = schedule.groupBy("scheduled_day").agg(F.sum("duration_hours").alias("value")).where(F.col("value") > downtime_hours)
    busy = days.select(
        F.concat(F.lit("day_"), F.col("scheduled_day").cast("string")).alias("subject"),
        F.lit("daily_downtime").alias("rule"),
        "value",
        F.lit(float(downtime_hours)).alias("threshold"),
    )
    return own.unionByName(busy)
