import pytest
from pyspark.sql import functions as F

from wearlens.functions.columns import blend, peak_index
from wearlens.operators import forecast as fc
from wearlens.operators import maintenance as mt
from wearlens.operators import sequences as se
from wearlens.plans import experiments as ex


def history(spark):
    rows = [(1, 10, 25.0, 25), (1, 20, 18.0, 18), (2, 10, 12.0, 12), (2, 20, 8.0, 8), (3, 10, 9.0, 9), (3, 20, 3.0, 3)]
    return spark.createDataFrame(rows, "unit int, target_cycle int, prediction double, rul int")


def test_tasks_from_latest_predictions(spark):
    rows = {r["equipment_id"]: r for r in mt.maintenance_tasks(history(spark)).collect()}
    assert len(rows) == 3
    assert rows["unit_3"]["predicted_rul_days"] == 0.6 and rows["unit_3"]["repair_type"] == "major_overhaul"
    assert rows["unit_1"]["predicted_rul"] == 18.0 and rows["unit_1"]["preferred_day"] == 2
    assert rows["unit_1"]["repair_type"] == "component_repair"


def test_price_of_an_overhaul_on_the_first_day(spark):
    tasks = mt.maintenance_tasks(history(spark), max_tasks=1)
    row = mt.priced_schedule(tasks, tasks.select("equipment_id", F.lit(0).alias("scheduled_day"))).first()
    assert row["direct_cost"] == 109400.0 and row["risk_cost"] == 0.0


def test_scenarios_and_summary(spark):
    plan = ex.plan_maintenance(history(spark))
    scenarios = {r["scenario"]: r for r in plan["scenarios"].collect()}
    assert set(scenarios) == {s[0] for s in mt.SCENARIOS}
    summary = plan["summary"].first()
    assert summary["task_count"] == 3 and scenarios["base"]["total_cost"] == summary["total_cost"]
    assert scenarios["base"]["schedule_robustness"] == 1.0
    empty = mt.schedule_summary(plan["schedule"].where("scheduled_day < 0")).first()
    assert empty["task_count"] == 0 and empty["total_cost"] == 0.0


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        mt.CostRates(downtime_per_hour=0)
    with pytest.raises(ValueError):
        mt.Resources(horizon_days=3, multipliers=(1.0,))
    with pytest.raises(ValueError):
        blend(F.lit(1.0), F.lit(1.0), 0.7, 0.4)
    with pytest.raises(ValueError):
        mt.maintenance_tasks(history(spark).drop("prediction"))


def test_blend_and_peak(spark):
    df = spark.createDataFrame([(10.0, 8.0, [0.1, 0.3, 0.6]), (6.0, 8.0, [0.5, 0.2, 0.3]), (5.0, None, [1.0])], "a double, b double, w array<double>")
    rows = fc.with_blend(df, "a", "b").select("hybrid_prediction", "prophet_fallback_used", peak_index(F.col("w")).alias("peak")).collect()
    assert [round(r[0], 6) for r in rows] == [9.4, 6.6, 5.0]
    assert [r[1] for r in rows] == [0, 0, 1] and [r[2] for r in rows] == [2, 0, 0]


def test_cycle_curve_and_trend(spark):
    rows = spark.createDataFrame([(1, 12.0), (1, 14.0), (2, 9.0), (3, 7.0)], "target_cycle int, y double")
    curve = fc.cycle_curve(rows, "y").orderBy("target_cycle").collect()
    assert [r["y"] for r in curve] == [13.0, 9.0, 7.0] and str(curve[0]["ds"]) == "2000-01-01"
    with pytest.raises(Exception, match="at least 1"):
        fc.cycle_curve(rows.withColumn("target_cycle", F.lit(0)), "y").collect()
    line = spark.range(1, 101).select(F.col("id").alias("target_cycle"), (200.0 - F.col("id") + 5 * F.sin(F.col("id") * 0.3141592653589793)).alias("y"))
    model = fc.fit_trend(line)
    gap = fc.predict_trend(line, model).select(F.max(F.abs(F.col("y") - F.col("prophet_prediction")))).first()[0]
    assert gap < 0.01
    with pytest.raises(ValueError):
        fc.fit_trend(line.limit(1))


def test_window_model_keeps_windows_with_missing_inputs(spark):
    rows = [(u, float(i), None if u == 2 else float(i % 3), float(100 - i)) for u in range(3) for i in range(16)]
    windows = spark.createDataFrame(rows, "unit int, a double, b double, rul double")
    model = fc.fit_window_model(windows, ["a", "b"], "rul", maxIter=2)
    found = fc.predict_windows(model, windows, "rul")
    assert found.count() == 48 and found.where("prediction IS NULL OR isnan(prediction)").count() == 0
    assert found.columns == ["unit", "a", "b", "rul", "prediction", "absolute_error"]


def test_failure_mode_of_the_window_model(spark):
    rows = [(i, float(i), None if i % 5 == 0 else float(i % 2), float(i % 2)) for i in range(60)]
    windows = spark.createDataFrame(rows, "unit int, a double, b double, fails double")
    model = fc.fit_window_model(windows, ["a", "b"], "fails", mode="failure", maxIter=3)
    found = fc.predict_windows(model, windows, "fails", mode="failure")
    assert found.columns == ["unit", "a", "b", "fails", "predicted_probability", "predicted_label"]
    assert found.where("predicted_label = fails").count() > 45


def test_given_days_per_scenario_count_as_changed(spark):
    rows = spark.createDataFrame([(u, 10.0 * (u + 1)) for u in range(4)], "unit int, prediction double").withColumn("target_cycle", F.lit(1))
    tasks = mt.maintenance_tasks(rows)
    names = [s[0] for s in mt.SCENARIOS]
    days = [(f"unit_{u}", n, 1 if n == names[0] or u else 2) for u in range(4) for n in names]
    given = spark.createDataFrame(days, "equipment_id string, scenario string, scheduled_day int")
    changed = {r["scenario"]: r["changed_assignments"] for r in mt.scenario_costs(tasks, given).collect()}
    assert changed == {n: int(n != names[0]) for n in names}


def test_latest_row_needs_an_order(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0)], "unit int, prediction double")
    with pytest.raises(ValueError):
        se.latest_per_unit(rows)
    assert se.latest_per_unit(rows, ties=("prediction",)).first()["prediction"] == 3.0
