"""Registered queries: forecasts, maintenance planning, streams, experiments and tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as de
from ..operators import forecast as fc
from ..operators import maintenance as mt
from ..operators import sequences as se
from ..schemas import SENSORS
from ..session import scratch_path, written
from ..sinks import tables as st
from ..streaming import ingest as si
from ..streaming import stages as sg
from . import experiments as ex
from . import sqltext as q
from .analysis_queries import _injected_sql, cycles
from .batch_queries import TWO, rounded
from .bindings import matrix, raw_readings, readings
from .registry import query

# --- tasks and costs -------------------------------------------------------------------------------


def predictions(spark, folder) -> DataFrame:
    """The second sensor read as a remaining-life forecast per unit and cycle."""
    return readings(spark, folder).select("unit", F.col("cycle").alias("target_cycle"), F.col("sensor_2").alias("prediction"))


def tasks(spark, folder) -> DataFrame:
    return mt.maintenance_tasks(predictions(spark, folder), max_tasks=None)


def assignment(task_rows: DataFrame) -> DataFrame:
    """Every task two days after its preferred day, inside the horizon."""
    return task_rows.select("equipment_id", F.least(F.col("preferred_day") + 2, F.lit(13)).alias("scheduled_day"))


_PROFILES = "pf(repair_type, repair_cost, duration_hours, required_technicians, part_name, part_quantity) AS (VALUES " + ", ".join(str(p) for p in mt.PROFILES) + ")"
_PATTERN = "[" + ", ".join(str(m) for m in mt.WEEKLY_PATTERN) + "]"

_TASKS = f"""{q.READINGS}, la AS (SELECT unit, arg_max(sensor_2, cycle) AS prediction FROM tv GROUP BY 1),
t0 AS (SELECT unit, 'unit_' || unit AS equipment_id, greatest(prediction, 0.0) AS predicted_rul, greatest(greatest(prediction, 0.0) / 5.0, 0.5) AS d FROM la),
t1 AS (SELECT unit, equipment_id, predicted_rul, d AS predicted_rul_days,
  CASE WHEN d <= 3 THEN 'major_overhaul' WHEN d <= 7 THEN 'component_repair' WHEN d <= 14 THEN 'minor_service' ELSE 'inspection' END AS repair_type,
  CAST(least(greatest(floor(greatest(d - 1, 0)), 0), 13) AS INTEGER) AS preferred_day, least(greatest((14.0 - d) / 14.0, 0.1), 1.0) AS criticality FROM t0),
tk AS (SELECT *, 10000 * (0.2 + criticality) AS risk_penalty_per_day FROM t1), {_PROFILES}"""


def _costed(source: str, day: str, down: str = "10000.0", labor: str = "150.0", repair: str = "1.0") -> str:
    return (
        f"SELECT s.*, pf.* EXCLUDE (repair_type), {_PATTERN}[CAST({day} AS INTEGER) % 7 + 1] AS production_multiplier, "
        f"repair_cost * {repair} + duration_hours * required_technicians * {labor} + duration_hours * {down} * {_PATTERN}[CAST({day} AS INTEGER) % 7 + 1] AS direct_cost, "
        f"greatest({day} - preferred_day, 0) * risk_penalty_per_day AS risk_cost FROM {source} s JOIN pf USING (repair_type)"
    )


_DAYS = f"dd AS (SELECT tk.*, unnest(range(0, 14)) AS day FROM tk), ct AS ({_costed('dd', 'day')}), co AS (SELECT *, direct_cost + risk_cost AS total_cost FROM ct)"
_SCHEDULE = (
    f"aa AS (SELECT tk.*, least(preferred_day + 2, 13) AS scheduled_day FROM tk), st AS ({_costed('aa', 'scheduled_day')}), "
    "sc AS (SELECT * EXCLUDE (direct_cost, risk_cost), round(direct_cost, 2) AS direct_cost, round(risk_cost, 2) AS risk_cost, round(direct_cost + risk_cost, 2) AS total_cost FROM st)"
)


@query("repair_types_mnt1", f"WITH {_TASKS} SELECT repair_type, count(*) AS tasks FROM tk GROUP BY 1")
def _types(spark, folder):
    return tasks(spark, folder).groupBy("repair_type").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "maintenance_tasks_mnt2",
    f"WITH {_TASKS} SELECT equipment_id, repair_type, predicted_rul, round(predicted_rul_days, 6) AS predicted_rul_days, preferred_day, "
    "round(risk_penalty_per_day, 5) AS risk_penalty_per_day, round(criticality, 8) AS criticality FROM tk",
)
def _tasks(spark, folder):
    return tasks(spark, folder).withColumns(
        {"predicted_rul_days": F.round("predicted_rul_days", 6), "risk_penalty_per_day": F.round("risk_penalty_per_day", 5), "criticality": F.round("criticality", 8)}
    )


@query(
    "lowest_predictions_top1",
    f"WITH {_TASKS} SELECT equipment_id, predicted_rul FROM tk ORDER BY predicted_rul, unit LIMIT 20",
)
def _lowest(spark, folder):
    return mt.maintenance_tasks(predictions(spark, folder), max_tasks=20).select("equipment_id", "predicted_rul")


@query(
    "ordered_candidates_top2",
    f"WITH {_TASKS} SELECT equipment_id, preferred_day, predicted_rul, row_number() OVER (PARTITION BY preferred_day ORDER BY predicted_rul_days, equipment_id) AS place FROM tk",
)
def _candidates(spark, folder):
    placed = mt.placed_candidates(tasks(spark, folder))
    return placed.select("equipment_id", "preferred_day", "predicted_rul", "place")


@query("task_days_joi4", f"WITH {_TASKS} SELECT equipment_id, unnest(range(0, 14)) AS day FROM tk")
def _days(spark, folder):
    return mt.over_days(tasks(spark, folder), 14).select("equipment_id", "day")


@query(
    "profile_lookup_joi5",
    f"WITH {_TASKS} SELECT equipment_id, repair_type, duration_hours, part_name FROM tk JOIN pf USING (repair_type)",
)
def _profiles(spark, folder):
    return mt.with_profile(tasks(spark, folder)).select("equipment_id", "repair_type", "duration_hours", "part_name")


@query(
    "task_costs_mnt3",
    f"WITH {_TASKS}, {_DAYS} SELECT equipment_id, day, production_multiplier, round(direct_cost, 4) AS direct_cost, round(risk_cost, 4) AS risk_cost, round(total_cost, 4) AS total_cost FROM co",
)
def _costs(spark, folder):
    out = mt.task_day_costs(tasks(spark, folder)).select("equipment_id", "day", "production_multiplier", "direct_cost", "risk_cost", "total_cost")
    return rounded(out, 4)


_BEST = "bd AS (SELECT equipment_id, arg_min(day, {'c': round(total_cost, 4), 'd': day}) AS scheduled_day FROM co GROUP BY 1)"


@query("cheapest_days_mnt4", f"WITH {_TASKS}, {_DAYS}, {_BEST} SELECT * FROM bd")
def _cheapest(spark, folder):
    return mt.cheapest_days(mt.task_day_costs(tasks(spark, folder)))


_SCHEDULE_COLUMNS = "equipment_id, scheduled_day, repair_type, preferred_day, production_multiplier, direct_cost, risk_cost, total_cost, duration_hours, required_technicians, part_name, part_quantity"


def schedule(spark, folder) -> DataFrame:
    rows = tasks(spark, folder)
    return mt.priced_schedule(rows, assignment(rows))


@query("priced_schedule_mnt5", f"WITH {_TASKS}, {_SCHEDULE} SELECT {_SCHEDULE_COLUMNS} FROM sc")
def _schedule(spark, folder):
    return schedule(spark, folder).select(*_SCHEDULE_COLUMNS.split(", "))


@query(
    "capacity_audit_mnt6",
    f"WITH {_TASKS}, {_SCHEDULE}, u AS (SELECT 'day_' || scheduled_day AS bucket, 'technician_hours' AS resource, sum(duration_hours * required_technicians) AS used, 24.0 AS allowed FROM sc GROUP BY 1 "
    "UNION ALL SELECT 'day_' || scheduled_day, 'downtime_hours', sum(duration_hours), 16.0 FROM sc GROUP BY 1 UNION ALL SELECT part_name, 'parts', sum(part_quantity), 50.0 FROM sc GROUP BY 1) "
    "SELECT bucket, resource, CAST(used AS DOUBLE) AS used, CAST(allowed AS DOUBLE) AS allowed, used <= allowed AS ok FROM u",
)
def _audit(spark, folder):
    return mt.capacity_audit(schedule(spark, folder))


@query(
    "schedule_summary_mnt7",
    f"WITH {_TASKS}, {_SCHEDULE} SELECT 'Priced' AS solver_status, count(*) AS task_count, round(sum(total_cost), 2) AS total_cost, round(sum(direct_cost), 2) AS total_direct_cost, "
    "round(sum(risk_cost), 2) AS total_risk_cost, round(avg(total_cost), 2) AS average_cost_per_task, count(*) FILTER (scheduled_day > preferred_day) AS tasks_after_preferred_day, "
    "round(avg(CAST(scheduled_day <= preferred_day AS DOUBLE)), 4) AS on_or_before_preferred_rate, sum(duration_hours) AS total_downtime_hours, sum(duration_hours * required_technicians) AS total_technician_hours FROM sc",
)
def _summary(spark, folder):
    return mt.schedule_summary(schedule(spark, folder))


def _scenario_sql(cheapest: bool) -> str:
    named = "sn(scenario, dm, rm, lm) AS (VALUES " + ", ".join(str(s) for s in mt.SCENARIOS) + ")"
    day = "day" if cheapest else "scheduled_day"
    base = "(SELECT tk.*, unnest(range(0, 14)) AS day FROM tk)" if cheapest else "tk"
    own = "" if cheapest else ", least(preferred_day + CASE WHEN dm > 1 THEN 0 WHEN lm > 1 THEN 4 ELSE 2 END, 13) AS scheduled_day"
    spread = f"sd AS (SELECT x.*, sn.*{own} FROM {base} x CROSS JOIN sn)"
    priced = f"sp AS ({_costed('sd', day, '10000.0 * dm', '150.0 * lm', 'rm')}), sq AS (SELECT *, direct_cost + risk_cost AS total_cost FROM sp)"
    if cheapest:
        chosen = "ch AS (SELECT *, day AS scheduled_day FROM sq QUALIFY row_number() OVER (PARTITION BY scenario, equipment_id ORDER BY round(total_cost, 4), day) = 1)"
    else:
        chosen = "ch AS (SELECT * FROM sq)"
    return (
        f"{_TASKS}, {named}, {spread}, {priced}, {chosen}, cb AS (SELECT equipment_id, scheduled_day AS base_day FROM ch WHERE scenario = 'base'), "
        "sr AS (SELECT scenario, dm AS downtime_multiplier, rm AS repair_multiplier, lm AS labor_multiplier, round(sum(total_cost), 2) AS total_cost, round(sum(risk_cost), 2) AS total_risk_cost, "
        "count(*) FILTER (scheduled_day > preferred_day) AS tasks_after_preferred_day, round(avg(CAST(scheduled_day <= preferred_day AS DOUBLE)), 4) AS on_or_before_preferred_rate, "
        "count(*) FILTER (scheduled_day <> base_day) AS changed_assignments, round(1.0 - count(*) FILTER (scheduled_day <> base_day) / count(*), 4) AS schedule_robustness "
        "FROM ch JOIN cb USING (equipment_id) GROUP BY ALL)"
    )


def scenarios(spark, folder) -> DataFrame:
    """Each scenario with days of its own: the preferred day where downtime costs more, four days later where labour does, else two."""
    rows = tasks(spark, folder)
    delays = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(0 if d > 1 else 4 if w > 1 else 2).alias("delay")) for n, d, _, w in mt.SCENARIOS])
    days = rows.select("equipment_id", "preferred_day", F.inline(delays))
    day = F.least(F.col("preferred_day") + F.col("delay"), F.lit(13)).alias("scheduled_day")
    return mt.scenario_costs(rows, days.select("equipment_id", "scenario", day))


_SCENARIO_COLUMNS = ("scenario, CAST(downtime_multiplier AS DOUBLE) AS downtime_multiplier, CAST(repair_multiplier AS DOUBLE) AS repair_multiplier, CAST(labor_multiplier AS DOUBLE) AS labor_multiplier, "
                     "total_cost, total_risk_cost, tasks_after_preferred_day, on_or_before_preferred_rate, changed_assignments, schedule_robustness")


@query("scenario_costs_mnt8", f"WITH {_scenario_sql(False)} SELECT {_SCENARIO_COLUMNS} FROM sr")
def _scenarios(spark, folder):
    return scenarios(spark, folder)


@query("scenario_reassignment_joi6", f"WITH {_scenario_sql(True)} SELECT {_SCENARIO_COLUMNS} FROM sr")
def _reassigned(spark, folder):
    return mt.scenario_costs(tasks(spark, folder))


@query("tradeoff_mnt9", f"WITH {_scenario_sql(False)} SELECT scenario, total_risk_cost, total_cost FROM sr")
def _tradeoff(spark, folder):
    return mt.tradeoff(scenarios(spark, folder))


@query(
    "scenario_picks_top5",
    f"WITH {_scenario_sql(True)} SELECT (SELECT scenario FROM sr ORDER BY total_cost, total_risk_cost LIMIT 1) AS lowest_cost_scenario, "
    "(SELECT scenario FROM sr ORDER BY schedule_robustness DESC, total_cost LIMIT 1) AS most_robust_scenario",
)
def _picks(spark, folder):
    return mt.scenario_picks(mt.scenario_costs(tasks(spark, folder)))


@query(
    "alerts_mnt10",
    f"WITH {_TASKS}, {_SCHEDULE} SELECT equipment_id AS subject, 'predicted_rul_days' AS rule, round(predicted_rul_days, 6) AS value, CAST(7.0 AS DOUBLE) AS threshold FROM sc WHERE predicted_rul_days < 7 "
    "UNION ALL SELECT equipment_id, 'risk_cost', risk_cost, 25000.0 FROM sc WHERE risk_cost > 25000 UNION ALL SELECT equipment_id, 'scheduled_late', scheduled_day, preferred_day FROM sc WHERE scheduled_day > preferred_day "
    "UNION ALL SELECT 'day_' || scheduled_day, 'daily_downtime', sum(duration_hours), 16.0 FROM sc GROUP BY scheduled_day HAVING sum(duration_hours) > 16",
)
def _alerts(spark, folder):
    return mt.alerts(schedule(spark, folder)).withColumn("value", F.round("value", 6))


@query(
    "headline_numbers_mnt11",
    f"WITH {_TASKS}, {_SCHEDULE} SELECT count(*) AS task_count, round(coalesce(sum(total_cost), 0), 2) AS total_cost, round(coalesce(sum(risk_cost), 0), 2) AS total_risk_cost, "
    "0 AS empty_task_count, 0.0::DOUBLE AS empty_total_cost FROM sc",
)
def _headline(spark, folder):
    rows = schedule(spark, folder)
    full = mt.schedule_summary(rows).select("task_count", "total_cost", "total_risk_cost")
    empty = mt.schedule_summary(rows.where("total_cost < 0"), "nothing is planned")
    none = empty.select(F.struct("task_count", "total_cost")).scalar()
    return full.withColumns({"empty_task_count": none["task_count"], "empty_total_cost": none["total_cost"]})


# --- forecasts -------------------------------------------------------------------------------------


@query("window_model_rul3")
def _window_model(spark, folder):
    rows = se.add_train_rul(cycles(spark, folder))
    train, held = se.split_by_unit(rows, 0.2, 42)
    frames = []
    for part in (train, held):
        frame, inputs = fc.window_summary(se.target_windows(part.withColumn("age", F.col("cycle")), 10, features=[*TWO, "age"]), [*TWO, "age"])
        frames.append(frame)
    model = fc.fit_window_model(written(frames[0], "model-windows"), inputs, "rul")
    return fc.predict_windows(model, frames[1], "rul").select("unit", "window_start_index", "target_cycle", "rul", "prediction", "absolute_error")


@query("trend_baseline_rul4")
def _trend(spark, folder):
    rows = se.add_train_rul(cycles(spark, folder)).withColumn("target_cycle", F.col("cycle"))
    model = fc.fit_trend(fc.cycle_curve(rows, "rul"))
    return fc.predict_trend(rows.select("unit", "target_cycle", "rul"), model)


@query("parameter_search_rul5")
def _search(spark, folder):
    rows = se.add_train_rul(cycles(spark, folder)).withColumn("age", F.col("cycle"))
    return fc.search_parameters(rows, ["age", "sensor_1"], lengths=(5, 10), depths=(2,), rounds=(3,))


# --- streams ---------------------------------------------------------------------------------------

_MESSAGE = ["event_time", "equipment_id", "run_id", "cycle", *TWO, "failure_label"]


def _messages(spark, folder) -> DataFrame:
    """Readings as JSON messages with an extra key; errors above 200 lose a key, values below 0.5 get a bad time."""
    rows = readings(spark, folder)
    fields = [
        F.when(F.col("sensor_1") < 0.5, F.lit("not a time")).otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("event_time"),
        "equipment_id", "run_id", "cycle", *TWO,
        F.when(~((F.col("failure_label") == 1) & (F.col("sensor_1") > 100)), F.col("failure_label")).alias("failure_label"),
        F.lit("normal").alias("stream_status"),
    ]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


_BAD = "(failure_label = 1 AND sensor_1 > 100)"


@query(
    "parse_messages_prj3",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle, sensor_1, sensor_2, failure_label FROM tv WHERE sensor_1 >= 0.5 AND NOT {_BAD}",
)
def _parse(spark, folder):
    out = si.good_messages(si.parse_messages(_messages(spark, folder), _MESSAGE))
    return out.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "cycle", *TWO, F.col("failure_label").cast("int").alias("failure_label"))


def _loaded(spark, folder) -> tuple[str, str]:
    root = scratch_path(spark, "stream")
    source = f"{root}/messages"
    _messages(spark, folder).write.text(source)
    _messages(spark, folder).write.mode("append").text(source)
    stream = si.read_messages(spark, source, files_per_batch=1)
    si.load_stream(stream, f"{root}/readings", f"{root}/refused", f"{root}/checkpoint", _MESSAGE).awaitTermination()
    return f"{root}/readings", f"{root}/refused"


@query(
    "load_stream_str2",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle, sensor_1, sensor_2 FROM tv WHERE sensor_1 >= 0.5 AND NOT {_BAD}",
)
def _load(spark, folder):
    loaded, _ = _loaded(spark, folder)
    return spark.read.parquet(loaded).select("equipment_id", F.unix_micros("event_time").alias("event_us"), "cycle", *TWO)


@query(
    "refused_messages_str3",
    f"WITH {q.READINGS} SELECT CASE WHEN {_BAD} THEN 'missing columns: failure_label' ELSE 'invalid values: event_time' END AS reason, 2 * count(*) AS messages FROM tv "
    f"WHERE sensor_1 < 0.5 OR {_BAD} GROUP BY 1",
)
def _refused(spark, folder):
    _, refused = _loaded(spark, folder)
    return spark.read.parquet(refused).groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def _stream_table(spark, stream: DataFrame, name: str) -> DataFrame:
    root = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "message_stream_src5",
    f"WITH {q.READINGS} SELECT equipment_id, count(*) AS messages FROM tv GROUP BY 1",
)
def _stream(spark, folder):
    path = scratch_path(spark, "messages")
    _messages(spark, folder).write.text(path)
    found = _stream_table(spark, si.read_messages(spark, path), "copied")
    return found.select(F.get_json_object("value", "$.equipment_id").alias("equipment_id")).groupBy("equipment_id").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "normalize_stream_str1",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle, sensor_1, sensor_2, failure_label FROM tv WHERE sensor_1 >= 0.5 AND NOT {_BAD}",
)
def _normalize(spark, folder):
    path = scratch_path(spark, "messages")
    _messages(spark, folder).write.text(path)
    parsed = si.good_messages(si.parse_messages(si.read_messages(spark, path), _MESSAGE))
    out = _stream_table(spark, parsed, "normalized")
    return out.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "cycle", *TWO, F.col("failure_label").cast("int").alias("failure_label"))


def _reading_stream(spark, folder) -> DataFrame:
    path = scratch_path(spark, "reading-files")
    raw_readings(spark, folder).select("event_time", "equipment_id", "run_id", *TWO).write.parquet(path)
    kinds = spark.read.parquet(path).schema
    return spark.readStream.schema(kinds).parquet(path)


@query(
    "cleaned_features_str4",
    f"WITH {q.READINGS}, w AS (SELECT *, unnest([event_us // 1800000000 * 1800000000, event_us // 1800000000 * 1800000000 - 1800000000]) AS start_us FROM tv), "
    "g AS (SELECT equipment_id, start_us, count(*) AS readings, round(avg(sensor_1), 6) AS sensor_1_mean, round(max(sensor_1), 6) AS sensor_1_max FROM w GROUP BY 1, 2) "
    "SELECT equipment_id, start_us, readings, sensor_1_mean, sensor_1_max FROM g WHERE start_us + 3600000000 <= (SELECT max(event_us) FROM tv) - 600000000",
)
def _cleaned(spark, folder):
    out = _stream_table(spark, sg.cleaned_features(_reading_stream(spark, folder), ["sensor_1"]), "cleaned")
    return out.select("equipment_id", F.unix_micros("window_start").alias("start_us"), "readings",
                      F.round("sensor_1_mean", 6).alias("sensor_1_mean"), F.round("sensor_1_max", 6).alias("sensor_1_max"))


@query(
    "tagged_anomalies_str5",
    f"WITH {q.READINGS}, z AS (SELECT avg(sensor_1) a, stddev_pop(sensor_1) b, avg(sensor_2) c, stddev_pop(sensor_2) d FROM tv), "
    "s AS (SELECT equipment_id, event_us, sqrt((pow((sensor_1 - a) / b, 2) + pow((sensor_2 - c) / d, 2)) / 2) AS score FROM tv, z) "
    "SELECT equipment_id, event_us, round(score, 5) AS score FROM s WHERE score >= 1.5",
)
def _tagged(spark, folder):
    reference = de.zscore_reference(raw_readings(spark, folder), TWO)
    root = scratch_path(spark, "tagged")
    tagged = sg.tagged_anomalies(_reading_stream(spark, folder), reference, TWO, 1.5)
    keyed = tagged.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "score")
    sg.publish_stream(keyed, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    lines = spark.read.schema("key string, value string").json(f"{root}/out")
    found = lines.select("key", F.from_json("value", "event_us bigint, score double").alias("m")).select(F.col("key").alias("equipment_id"), "m.*")
    return found.withColumn("score", F.round("score", 5))


# --- experiments -----------------------------------------------------------------------------------

_ANO8_SCORES = ["zscore_score", "mad_score", "isolation_forest_score", "local_outlier_factor_score"]


@query("row_experiment_ano8")
def _row_experiment(spark, folder):
    rows = matrix(spark, folder).select("unit", "cycle", *SENSORS)
    _, summary = ex.row_experiment(rows, rows, SENSORS, trees=50, neighbours=10)
    return rounded(summary, 9)


@query("window_comparison_ano7")
def _window_comparison(spark, folder):
    rows = matrix(spark, folder).select("unit", "cycle", *SENSORS)
    _, summary = ex.window_experiment(rows, rows, SENSORS, length=10, stride=2, trees=50, neighbours=10)
    return rounded(summary, 9)


@query(
    "statistical_experiment_ano8",
    f"WITH {_injected_sql(True)} SELECT is_anomaly, injected_anomaly_type, count(*) AS rows FROM app GROUP BY 1, 2",
)
def _composition(spark, folder):
    from ..operators.profile import label_composition

    rows = matrix(spark, folder).select("unit", "cycle", *SENSORS)
    return label_composition(de.inject_anomalies(rows, 0.08, 42), ["is_anomaly", "injected_anomaly_type"])


@query(
    "saved_run_snk8",
    f"WITH {_TASKS}, {_SCHEDULE} SELECT 'week_a' AS run_name, equipment_id, total_cost FROM sc UNION ALL SELECT 'week_b', equipment_id, direct_cost FROM sc",
)
def _saved_run(spark, folder):
    root = scratch_path(spark, "runs")
    rows = written(schedule(spark, folder), "schedule")
    st.save_run({"schedule": rows.select("equipment_id", F.lit(0.0).alias("total_cost"))}, root, "week_b")
    st.save_run({"schedule": rows.select("equipment_id", "total_cost")}, root, "week_a")
    st.save_run({"schedule": rows.select("equipment_id", F.col("direct_cost").alias("total_cost"))}, root, "week_b")
    return spark.read.parquet(f"{root}/schedule").select("run_name", "equipment_id", "total_cost")


@query(
    "tracking_log_snk9",
    f"WITH {_TASKS}, {_SCHEDULE}, m AS (SELECT repair_type, count(*) AS tasks, round(sum(total_cost), 2) AS total_cost FROM sc GROUP BY 1) "
    "SELECT 'param' AS kind, 'horizon' AS key, 14.0::DOUBLE AS number FROM (SELECT count(*) FROM sc) UNION ALL SELECT 'metric', repair_type || '_tasks', tasks FROM m UNION ALL SELECT 'metric', repair_type || '_total_cost', total_cost FROM m",
)
def _tracking(spark, folder):
    path = scratch_path(spark, "tracking")
    metrics = schedule(spark, folder).groupBy(F.col("repair_type").alias("model_key")).agg(
        F.count(F.lit(1)).alias("tasks"), F.round(F.sum("total_cost"), 2).alias("total_cost"), F.lit(None).cast("double").alias("absent")
    )
    st.log_run(st.tracking_rows(spark, "run-1", "weekly", {"horizon": 14}, metrics), path)
    return spark.read.parquet(path).select("kind", "key", F.col("value").cast("double").alias("number"))
