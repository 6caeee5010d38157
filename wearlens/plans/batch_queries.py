"""Registered queries: sources, sinks, projections, validation and time features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, blend, peak_index, ratio
from ..functions.ordered import HOUR, row_index
from ..operators import features as ft
from ..operators import prepare as pr
from ..operators import validate as va
from ..schemas import SENSORS, SETTINGS, UNIT_CYCLE, sensor_columns
from ..session import scratch_path
from ..sinks import blocks as bl
from ..sinks import tables as st
from ..sources import files as sf
from . import sqltext as q
from .bindings import matrix, raw_readings, readings, table, unit_cycles
from .registry import query

TWO = ["sensor_1", "sensor_2"]
CYCLE_LIST = ", ".join(UNIT_CYCLE)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to a number of places for the comparison with SQL; arithmetic, as `round` on doubles is slow."""
    unit = 10.0**digits
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.floor(F.col(c) * unit + 0.5) / unit for c in doubles})


# --- sources ---------------------------------------------------------------------------------------


def _write_cycles(spark, folder) -> str:
    root = scratch_path(spark, "cycles")
    cycles = matrix(spark, folder)
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in UNIT_CYCLE]).alias("value")
    for fd, rows in (("FD001", cycles.where("unit < 5")), ("FD002", cycles.where("unit >= 5"))):
        rows.select(line).write.text(f"{root}/CMaps/train_{fd}.txt")
    return root


@query(
    "read_cycles_src1",
    f"WITH {q.MATRIX} SELECT 'train' AS split, CASE WHEN unit < 5 THEN 'FD001' ELSE 'FD002' END AS fd, "
    f"{', '.join(['unit', 'cycle'] + [f'round({c}, 6) AS {c}' for c in SETTINGS + SENSORS])} FROM ev",
)
def _read_cycles(spark, folder):
    root = _write_cycles(spark, folder)
    return rounded(sf.read_cycles(spark, f"{root}/CMaps/*", names=r"(train|test)_(FD\d+)\.txt"))


@query(
    "read_targets_src2",
    "WITH t AS (SELECT user_id, count(*) AS rul FROM events GROUP BY 1) SELECT printf('FD%03d', user_id // 100) AS fd, "
    "row_number() OVER (PARTITION BY user_id // 100 ORDER BY user_id) AS unit, rul FROM t",
)
def _read_targets(spark, folder):
    root = scratch_path(spark, "targets")
    lives = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("rul"))
    named = lives.select(F.format_string("FD%03d", F.floor(F.col("user_id") / 100)).alias("fd"), "user_id", "rul")
    ordered = named.orderBy("fd", "user_id").select("fd", F.col("rul").cast("string").alias("value"))
    ordered.write.partitionBy("fd").text(root)
    return sf.read_targets(spark, f"{root}/*", names=r"fd=(FD\d+)", per="folder")


_TV_OUT = "event_us, equipment_id, run_id, cycle, sensor_1, sensor_2, failure_label"


@query("read_csv_src3", f"WITH {q.READINGS} SELECT {_TV_OUT} FROM tv")
def _read_csv(spark, folder):
    path = scratch_path(spark, "csv")
    kept = readings(spark, folder).select(*_TV_OUT.split(", "))
    kept.write.option("header", True).csv(path)
    return sf.read_csv(spark, path, kept.schema)


@query(
    "load_dataset_src4",
    f"WITH {q.MATRIX} SELECT 'train' AS part, unit, max(cycle) AS last_cycle, round(sum(sensor_3), 6) AS total FROM ev GROUP BY unit "
    "UNION ALL SELECT 'test', unit, max(cycle), round(sum(sensor_3), 6) FROM ev WHERE cycle <= 20 GROUP BY unit "
    "UNION ALL SELECT 'target', row_number() OVER (ORDER BY unit), max(cycle) - 20, NULL FROM ev GROUP BY unit",
)
def _load_dataset(spark, folder):
    root = scratch_path(spark, "dataset")
    cycles = matrix(spark, folder)
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in UNIT_CYCLE]).alias("value")
    cycles.select(line).write.text(f"{root}/CMaps/train_FD001.txt")
    cycles.where("cycle <= 20").select(line).write.text(f"{root}/CMaps/test_FD001.txt")
    left = cycles.groupBy("unit").agg((F.max("cycle") - 20).alias("rul"))
    left.orderBy("unit").select(F.col("rul").cast("string").alias("value")).write.text(f"{root}/CMaps/RUL_FD001.txt")
    train, test, targets = sf.load_dataset(spark, root, "nasa", "FD001")

    def summed(df, part):
        return df.groupBy("unit").agg(
            F.max("cycle").cast("long").alias("last_cycle"), F.round(F.sum("sensor_3"), 6).alias("total")
        ).select(F.lit(part).alias("part"), F.col("unit").cast("long").alias("unit"), "last_cycle", "total")

    rest = targets.select(
        F.lit("target").alias("part"),
        F.col("unit").cast("long").alias("unit"),
        F.col("rul").cast("long").alias("last_cycle"),
        F.lit(None).cast("double").alias("total"),
    )
    return summed(train, "train").unionByName(summed(test, "test")).unionByName(rest)


@query(
    "newest_artifact_src6",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, sensor_1 FROM tv WHERE event_type = 'view'",
)
def _newest(spark, folder):
    root = scratch_path(spark, "runs")
    events = table(spark, folder, "events").withColumn("equipment_id", F.format_string("engine_%03d", "user_id"))
    rows = events.select("equipment_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
                         F.col("value").alias("sensor_1"), "event_type")
    for kind in ("click", "error", "view"):
        rows.where(F.col("event_type") == kind).drop("event_type").write.parquet(f"{root}/run_{kind}")
    return sf.read_newest(spark, f"{root}/run_*")


@query(
    "saved_results_src7",
    f"WITH {q.UNIT_CYCLES} SELECT unit, cycle, rul, prediction FROM uv",
)
def _saved(spark, folder):
    path = scratch_path(spark, "saved")
    unit_cycles(spark, folder).select("unit", "cycle", "rul", "prediction").write.parquet(path)
    return sf.read_saved(spark, path, ["rul", "prediction"])


# --- sinks -----------------------------------------------------------------------------------------

_KEYED = ["event_time", "equipment_id", "run_id", "sensor_1"]


def _batch(spark, folder) -> DataFrame:
    return raw_readings(spark, folder)


@query(
    "insert_if_absent_snk1",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, CASE WHEN failure_label = 1 THEN -1.0 ELSE sensor_1 END AS sensor_1 FROM tv",
)
def _insert(spark, folder):
    path = scratch_path(spark, "readings")
    rows = _batch(spark, folder)
    st.insert_if_absent(rows.where("failure_label = 0").select(*_KEYED), path)
    again = rows.select(*_KEYED).withColumn("sensor_1", F.lit(-1.0))
    st.insert_if_absent(again.unionByName(again), path)
    return spark.read.parquet(path).select("equipment_id", F.unix_micros("event_time").alias("event_us"), "sensor_1")


@query(
    "upsert_snk2",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, CASE WHEN failure_label = 1 THEN sensor_1 * 10 ELSE sensor_1 END AS sensor_1, "
    "event_us AS created_us FROM tv",
)
def _upsert(spark, folder):
    path = scratch_path(spark, "features")
    rows = _batch(spark, folder).select(*_KEYED, "event_id", "failure_label", F.col("event_time").alias("created_at"))
    st.upsert(rows.drop("failure_label"), path, arrival=["event_id"])
    later = rows.where("failure_label = 1").withColumns(
        {"sensor_1": F.col("sensor_1") * 10, "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")}
    )
    st.upsert(later.drop("failure_label"), path, arrival=["event_id"])
    return spark.read.parquet(path).select(
        "equipment_id", F.unix_micros("event_time").alias("event_us"), "sensor_1", F.unix_micros("created_at").alias("created_us")
    )


@query(
    "daily_layout_snk3",
    f"WITH {q.READINGS} SELECT strftime(event_time, '%Y-%m-%d') AS day, equipment_id, count(*) AS readings, round(sum(sensor_1), 6) AS total "
    "FROM tv WHERE event_time >= TIMESTAMP '2024-01-10 06:00:00' AND event_time < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2",
)
def _layout(spark, folder):
    path = scratch_path(spark, "daily")
    st.write_by_day(_batch(spark, folder).select(*_KEYED), path)
    kept = st.read_by_day(spark, path, "2024-01-10 06:00:00", "2024-01-20 00:00:00")
    return kept.groupBy(F.date_format(st.DATE, "yyyy-MM-dd").alias("day"), "equipment_id").agg(
        F.count(F.lit(1)).alias("readings"), F.round(F.sum("sensor_1"), 6).alias("total")
    )


@query(
    "compact_old_snk4",
    f"WITH {q.READINGS} SELECT CASE WHEN event_time < TIMESTAMP '2024-01-23 00:00:00' THEN CAST(floor(date_diff('day', DATE '1970-01-01', CAST(event_time AS DATE)) / 30.0) AS INTEGER) "
    "ELSE -1 END AS event_block, equipment_id, event_us, sensor_1, failure_label = 1 AS late FROM tv",
)
def _compact(spark, folder):
    hot, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    rows = _batch(spark, folder).select(*_KEYED, "failure_label")
    st.write_by_day(rows.where("failure_label = 0").drop("failure_label"), hot)
    for cutoff in ("2024-01-10", "2024-01-16"):
        bl.compact_before(spark, hot, cold, cutoff)
    st.write_by_day(rows.where("failure_label = 1").withColumn("late", F.lit(True)), hot)  # late rows, with columns that older files lack
    bl.compact_before(spark, hot, cold, "2024-01-23")
    left = spark.read.option("mergeSchema", True).parquet(hot).withColumn("event_block", F.lit(-1))
    both = bl.read_blocks(spark, cold).unionByName(left, allowMissingColumns=True)
    late = F.coalesce("late", F.lit(False)).alias("late")
    return both.select("event_block", "equipment_id", F.unix_micros("event_time").alias("event_us"), "sensor_1", late)


@query("stage_batch_snk5", f"WITH {q.READINGS} SELECT {_TV_OUT} FROM tv")
def _stage(spark, folder):
    path = scratch_path(spark, "staged")
    raw = raw_readings(spark, folder).drop("run_id")
    prepared = pr.prepare_batch(raw, TWO, ties=("event_id",))
    st.stage_batch(prepared.select(*_TV_OUT.split(", ")), path)
    return spark.read.parquet(path)


@query(
    "feature_set_snk6",
    f"WITH {q.READINGS} SELECT 'v1' AS feature_set_version, equipment_id, event_us, sensor_1 AS feature FROM tv "
    "UNION ALL SELECT 'v2', equipment_id, event_us, sensor_2 FROM tv",
)
def _feature_set(spark, folder):
    path = scratch_path(spark, "feature-sets")
    rows = raw_readings(spark, folder)
    for version, sensor in (("v1", "sensor_2"), ("v2", "sensor_2"), ("v1", "sensor_1")):
        st.write_feature_set(rows.select("equipment_id", "event_us", F.col(sensor).alias("feature")), path, version)
    return spark.read.parquet(path).select("feature_set_version", "equipment_id", "event_us", "feature")


@query(
    "publish_messages_snk7",
    f"WITH {q.READINGS} SELECT equipment_id, CAST(sum(failure_label) AS BIGINT) AS failures, round(sum(sensor_1), 6) AS total, count(*) AS keyed FROM tv GROUP BY 1",
)
def _publish(spark, folder):
    path = scratch_path(spark, "published")
    st.publish(raw_readings(spark, folder).select("equipment_id", "event_us", "sensor_1", "failure_label"), path)
    lines = spark.read.schema("key string, value string").json(path)
    parsed = lines.select("key", F.from_json("value", "equipment_id string, sensor_1 double, failure_label int").alias("m")).select("key", "m.*")
    return parsed.groupBy("equipment_id").agg(
        F.sum("failure_label").alias("failures"), F.round(F.sum("sensor_1"), 6).alias("total"),
        F.count_if(F.col("key") == F.col("equipment_id")).alias("keyed"),
    )


# --- projections -----------------------------------------------------------------------------------


@query("prepare_batch_prj1", f"WITH {q.READINGS} SELECT {_TV_OUT}, 'events' AS source_file FROM tv")
def _prepare(spark, folder):
    raw = table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time"),
        F.format_string("engine_%03d", "user_id").alias("equipment_id"),
        F.col("value").cast("string").alias("sensor_1"),
        F.get_json_object("props", "$.k").alias("sensor_2"),
        (F.col("event_type") == "error").cast("int").alias("failure_label"),
        "event_id",
    )
    prepared = pr.prepare_batch(raw, TWO, source_file="events", ties=("event_id",))
    return prepared.withColumn("event_us", F.unix_micros("event_time")).select(*_TV_OUT.split(", "), "source_file")


@query(
    "to_telemetry_prj2",
    f"WITH {q.MATRIX} SELECT 1767225600000000 + (cycle - 1) * 60000000 AS event_us, printf('FD001_train_unit_%03d', unit) AS equipment_id, "
    "printf('FD001_train_unit_%03d', unit) || '_run_001' AS run_id, cycle, round(sensor_21, 6) AS sensor_21, 0 AS failure_label FROM ev",
)
def _telemetry(spark, folder):
    out = pr.to_telemetry(matrix(spark, folder), "FD001", "train")
    return out.select(F.unix_micros("event_time").alias("event_us"), "equipment_id", "run_id", "cycle",
                      F.round("sensor_21", 6).alias("sensor_21"), F.col("failure_label").cast("int").alias("failure_label"))


@query(
    "select_sensors_prj4",
    f"WITH {q.MATRIX} SELECT unit, cycle, {', '.join(f'round({s}, 6) AS {s}' for s in SENSORS)} FROM ev",
)
def _sensors(spark, folder):
    df = matrix(spark, folder)
    return rounded(df.select("unit", "cycle", *sensor_columns(df)))


@query(
    "feature_frame_prj5",
    "SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem",
)
def _frame(spark, folder):
    return pr.feature_frame(table(spark, folder, "lineitem"), ["l_quantity", "l_linenumber", "l_tax"])


@query(
    "sensor_ratios_prj6",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, round(sensor_2 / nullif(sensor_1, 0), 6) AS sensor_2_to_sensor_1_ratio FROM tv",
)
def _ratios(spark, folder):
    out = ft.with_ratios(raw_readings(spark, folder), ft.ratio_pairs(TWO))
    return out.select("equipment_id", "event_us", F.round("sensor_2_to_sensor_1_ratio", 6).alias("sensor_2_to_sensor_1_ratio"))


@query(
    "pack_features_prj7",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle, 'day4_v1' AS feature_set_version, "
    "CASE WHEN sensor_2 = 0 THEN '{\"label\":' || failure_label || ',\"share\":null}' "
    "ELSE '{\"label\":' || failure_label || ',\"share\":' || CAST(CAST(sensor_2 AS INTEGER) AS VARCHAR) || '.0}' END AS feature_payload FROM tv",
)
def _pack(spark, folder):
    rows = readings(spark, folder)
    share = F.when(F.col("sensor_2") == 0, F.lit(float("nan"))).otherwise(F.col("sensor_2"))
    wide = rows.select("event_time", "equipment_id", "run_id", "cycle", F.col("failure_label").alias("label"), share.alias("share"))
    packed = pr.pack_features(wide)
    return packed.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "cycle", "feature_set_version", "feature_payload")


@query(
    "payload_lookup_prj8",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, sensor_2 AS b FROM tv WHERE sensor_1 > 20",
)
def _payload(spark, folder):
    rows = readings(spark, folder).select("event_time", "equipment_id", "run_id", "cycle", F.col("sensor_1").alias("a"), F.col("sensor_2").alias("b"))
    found = pr.payload_values(pr.pack_features(rows, version="v7"), ["a", "b", "absent"], version="v7")
    hit = found.where((F.col("a") > 20) & F.col("absent").isNull())
    return hit.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "b")


@query(
    "first_rows_prj9",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle FROM tv ORDER BY event_us, event_id LIMIT 500",
)
def _first(spark, folder):
    return pr.first_rows(readings(spark, folder), ["event_us", "event_id"], 500).select("equipment_id", "event_us", "cycle")


@query(
    "unit_slice_prj10",
    f"WITH {q.UNIT_CYCLES} SELECT unit, cycle, rul, prediction FROM uv WHERE unit = 7",
)
def _slice(spark, folder):
    forecasts = unit_cycles(spark, folder).select("unit", "cycle", "rul", "prediction")
    schedule = forecasts.select(F.concat(F.lit("unit_"), F.col("unit").cast("string")).alias("equipment_id"))
    return pr.unit_slice(forecasts, schedule, 7)[0]


@query(
    "prediction_column_prj11",
    f"WITH {q.UNIT_CYCLES} SELECT unit, cycle, prediction AS chosen FROM uv",
)
def _chosen(spark, folder):
    rows = unit_cycles(spark, folder).withColumn("lstm_prediction", F.lit(0.0))
    return rows.select("unit", "cycle", F.col(pr.prediction_column(rows)).alias("chosen"))


@query(
    "threshold_labels_prj12",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, CAST(sensor_1 >= 25.0 AS INTEGER) AS predicted_label FROM tv",
)
def _labels(spark, folder):
    return raw_readings(spark, folder).select("equipment_id", "event_us", at_least(F.col("sensor_1"), 25.0).alias("predicted_label"))


@query(
    "array_peak_prj13",
    "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS peak_index, round(CAST(list_max(embedding) AS DOUBLE), 6) AS peak_weight FROM embeddings",
)
def _peak(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vectors.select("vec_id", peak_index(F.col("embedding")).alias("peak_index"),
                          F.round(F.array_max("embedding").cast("double"), 6).alias("peak_weight"))


@query(
    "blend_prj14",
    f"WITH {q.UNIT_CYCLES}, s AS (SELECT *, CASE WHEN failure_label = 0 THEN sensor_2 END AS second FROM uv) "
    "SELECT unit, cycle, round(coalesce(0.7 * prediction + 0.3 * second, prediction), 9) AS hybrid_prediction, "
    "CAST(second IS NOT NULL AS INTEGER) AS ensemble_applied, CAST(second IS NULL AS INTEGER) AS prophet_fallback_used FROM s",
)
def _blend(spark, folder):
    from ..operators.forecast import with_blend

    rows = unit_cycles(spark, folder).withColumn("second", F.when(F.col("failure_label") == 0, F.col("sensor_2")))
    out = with_blend(rows, "prediction", "second", 0.7, 0.3)
    return out.select("unit", "cycle", F.round("hybrid_prediction", 9).alias("hybrid_prediction"), "ensemble_applied", "prophet_fallback_used")


@query(
    "absolute_error_prj15",
    f"WITH {q.UNIT_CYCLES} SELECT unit, cycle, round(abs(rul - prediction), 6) AS absolute_error FROM uv",
)
def _error(spark, folder):
    return unit_cycles(spark, folder).select("unit", "cycle", F.round(F.abs(F.col("rul") - F.col("prediction")), 6).alias("absolute_error"))


@query(
    "long_scores_prj16",
    f"WITH {q.READINGS} SELECT event_id, failure_label, 'Z-Score Distance' AS method, sensor_1 AS score FROM tv "
    "UNION ALL SELECT event_id, failure_label, 'MAD Distance', sensor_2 FROM tv",
)
def _long(spark, folder):
    rows = raw_readings(spark, folder).withColumnsRenamed({"sensor_1": "zscore_score", "sensor_2": "mad_score"})
    return pr.long_scores(rows, "failure_label", ["zscore_score", "mad_score"], ids=["event_id"]).select(
        "event_id", "failure_label", "method", "score"
    )


# --- validation ------------------------------------------------------------------------------------

_MEASURES = ["l_quantity", "l_extendedprice", "l_tax"]


def _lineitem_batch(spark, folder):
    """Line items as a batch: ship date as time, order as equipment, line as run."""
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.col("l_orderkey").cast("string").alias("equipment_id"),
        F.col("l_linenumber").cast("string").alias("run_id"),
        *_MEASURES,
    )


def _strict_sql() -> str:
    rows = ["SELECT 'required_columns' AS name, true AS success, 0 AS unexpected_count"]
    rows.append("SELECT 'event_time_parseable', count(*) FILTER (l_shipdate IS NULL) = 0, count(*) FILTER (l_shipdate IS NULL) FROM lineitem")
    rows.append("SELECT 'key_columns_non_null', count(*) FILTER (l_shipdate IS NULL OR l_orderkey IS NULL OR l_linenumber IS NULL) = 0, "
                "count(*) FILTER (l_shipdate IS NULL OR l_orderkey IS NULL OR l_linenumber IS NULL) FROM lineitem")
    rows.append("SELECT 'unique_batch_keys', coalesce(sum(c), 0) = 0, CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem "
                "GROUP BY l_shipdate, l_orderkey, l_linenumber HAVING count(*) > 1)")
    for m in _MEASURES:
        rows.append(f"SELECT '{m}_numeric', count(*) FILTER ({m} IS NULL) = 0, count(*) FILTER ({m} IS NULL) FROM lineitem")
        bad = f"count(*) FILTER (NOT coalesce({m} BETWEEN 0 AND 2000, false))"
        rows.append(f"SELECT '{m}_range', {bad} = 0, {bad} FROM lineitem")
    return " UNION ALL ".join(rows)


@query("required_columns_val1", "SELECT 'required_columns' AS name, false AS success, 'absent columns: l_color, l_width' AS details FROM (SELECT count(*) FROM lineitem)")
def _required(spark, folder):
    checks = va.validation_checks(_lineitem_batch(spark, folder), ["l_width", "l_color", "l_tax"])
    return checks.where("name = 'required_columns'").select("name", "success", "details")


def _strict(spark, folder):
    return va.validation_checks(_lineitem_batch(spark, folder), _MEASURES)


@query("time_and_keys_val2_val3", f"SELECT * FROM ({_strict_sql()}) WHERE name IN ('event_time_parseable', 'key_columns_non_null')")
def _time_keys(spark, folder):
    return _strict(spark, folder).where(F.col("name").isin("event_time_parseable", "key_columns_non_null")).select("name", "success", "unexpected_count")


@query("unique_keys_val4", f"SELECT * FROM ({_strict_sql()}) WHERE name = 'unique_batch_keys'")
def _unique(spark, folder):
    return _strict(spark, folder).where("name = 'unique_batch_keys'").select("name", "success", "unexpected_count")


@query(
    "numeric_values_val5",
    "SELECT 'props_numeric' AS name, count(*) FILTER (TRY_CAST(props AS DOUBLE) IS NULL) = 0 AS success, "
    "count(*) FILTER (TRY_CAST(props AS DOUBLE) IS NULL) AS unexpected_count FROM events "
    "UNION ALL SELECT 'value_numeric', true, 0 FROM (SELECT count(*) FROM events)",
)
def _numeric(spark, folder):
    events = table(spark, folder, "events").withColumn("event_time", F.col("ts").cast("timestamp")).withColumn("equipment_id", F.col("user_id").cast("string"))
    checks = va.validation_checks(events, ["props", "value"])
    return checks.where(F.col("name").isin("props_numeric", "value_numeric")).select("name", "success", "unexpected_count")


@query("validate_val2_val6", _strict_sql())
def _validate(spark, folder):
    return _strict(spark, folder).select("name", "success", "unexpected_count")


@query(
    "lenient_checks_val7",
    "WITH b AS (SELECT l_shipdate, l_orderkey, nullif(l_tax, 0.0) AS l_tax FROM lineitem), n AS (SELECT count(*) AS n, count(l_tax) AS k, "
    "count(*) FILTER (l_tax NOT BETWEEN 0 AND 0.05) AS o FROM b) "
    "SELECT 'l_tax_non_null' AS name, n = k AS success, n AS element_count, n - k AS unexpected_count, round(100.0 * (n - k) / n, 6) AS unexpected_percent FROM n "
    "UNION ALL SELECT 'l_tax_range', o = 0, k, o, round(100.0 * o / k, 6) FROM n",
)
def _lenient(spark, folder):
    batch = _lineitem_batch(spark, folder).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    checks = va.with_percent(va.validation_checks(batch, ["l_tax"], 0.0, 0.05, mode="lenient"))
    return rounded(checks.where("name LIKE 'l_tax%'").drop("details"))


@query(
    "validation_report_val8",
    f"WITH c AS ({_strict_sql()}) SELECT bool_and(success) AS success, count(*) AS check_count, count(*) FILTER (NOT success) AS failed_count FROM c",
)
def _report(spark, folder):
    return va.validation_report(_strict(spark, folder)).select("success", "check_count", "failed_count")


@query(
    "missing_values_val9",
    "SELECT 'a' AS \"column\", count(*) FILTER (user_id = 0) AS missing_count FROM events HAVING count(*) FILTER (user_id = 0) > 0 "
    "UNION ALL SELECT 'b', count(*) FILTER (event_type = 'error') FROM events HAVING count(*) FILTER (event_type = 'error') > 0",
)
def _missing(spark, folder):
    events = table(spark, folder, "events")
    return va.missing_values(events.select(
        F.when(F.col("user_id") != 0, F.col("value")).alias("a"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("b"),
        F.col("value").alias("c"),
    ))


# --- time features ---------------------------------------------------------------------------------

_KEYS = ["equipment_id", "sensor"]


def long_readings(spark, folder, *extra) -> DataFrame:
    return ft.unpivot_sensors(raw_readings(spark, folder), ["equipment_id", "event_us", *extra], TWO)


def _rolling_sql() -> str:
    parts = []
    for name, width in ft.ROLLING_WINDOWS.items():
        parts.append(f"w{name} AS (PARTITION BY equipment_id, sensor ORDER BY event_us RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW)")
    outs = []
    for name in ft.ROLLING_WINDOWS:
        for stat, call in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)")):
            over = f"{call} OVER w{name}"
            over = f"coalesce({over}, 0)" if stat == "std" else over
            outs.append(f'round({over}, 6) AS "{name}_{stat}"')
    long = q.unpivot("tv", ["equipment_id", "event_us"], TWO)
    return f"WITH {q.READINGS}, l AS ({long}) SELECT equipment_id, sensor, event_us, {', '.join(outs)} FROM l WINDOW {', '.join(parts)}"


@query("rolling_stats_win1", _rolling_sql())
def _rolling(spark, folder):
    out = ft.rolling_stats(long_readings(spark, folder), _KEYS, "event_us")
    return rounded(out.drop("value")).select("equipment_id", "sensor", "event_us", *[f"{w}_{s}" for w in ft.ROLLING_WINDOWS for s in ft.STATS])


@query(
    "lags_win2",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, "
    + ", ".join(f"lag(sensor_1, {k}) OVER w AS sensor_1_lag_{k}" for k in ft.LAGS)
    + " FROM tv WINDOW w AS (PARTITION BY equipment_id ORDER BY event_us, event_id)",
)
def _lags(spark, folder):
    out = ft.lag_values(readings(spark, folder), ["equipment_id"], "cycle", ["sensor_1"])
    return out.select("equipment_id", "event_us", *[f"sensor_1_lag_{k}" for k in ft.LAGS])


_FFT_SQL = f"""WITH {q.READINGS},
g AS (SELECT equipment_id, event_us, list(sensor_1) OVER (PARTITION BY equipment_id ORDER BY event_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS v FROM tv),
c AS (SELECT equipment_id, event_us, len(v) AS n, list_transform(v, lambda x: x - list_avg(v)) AS d FROM g),
k AS (SELECT equipment_id, event_us, n, d, unnest(range(1, n // 2 + 1)) AS f FROM c),
a AS (SELECT equipment_id, event_us, sqrt(
  pow(list_sum(list_transform(range(0, n), lambda j: d[j + 1] * cos(2 * pi() * f * j / n))), 2) +
  pow(list_sum(list_transform(range(0, n), lambda j: d[j + 1] * sin(2 * pi() * f * j / n))), 2)) AS amp FROM k),
s AS (SELECT equipment_id, event_us, list(amp ORDER BY amp DESC) AS amps FROM a GROUP BY 1, 2)
SELECT c.equipment_id, c.event_us, {', '.join(f'round(amps[{i}], 5) AS fft_amp_{i}' for i in range(1, 6))}
FROM c LEFT JOIN s USING (equipment_id, event_us)"""


@query("rolling_fft_win3", _FFT_SQL)
def _fft(spark, folder):
    long = ft.unpivot_sensors(raw_readings(spark, folder), ["equipment_id", "event_us"], ["sensor_1"])
    return rounded(ft.rolling_spectrum(long, _KEYS, "event_us", []), 5).drop("sensor")


@query("running_count_win4", f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle FROM tv")
def _running(spark, folder):
    rows = raw_readings(spark, folder)
    out = row_index(rows, ["equipment_id"], ["event_us", "event_id"], F.floor(F.col("event_us") / HOUR), "cycle")
    return out.select("equipment_id", "event_us", "cycle")


def _engineered_sql() -> str:
    rolled = _rolling_sql()
    base = f"r AS ({rolled.replace('WITH ' + q.READINGS + ', ', 'WITH ', 1)})"
    rows = [
        f"SELECT equipment_id, event_us, sensor || '_{w}_{s}' AS feature, \"{w}_{s}\" AS feature_value FROM r"
        for w in ft.ROLLING_WINDOWS for s in ft.STATS
    ]
    lag_parts = ", ".join(f"lag({s}, {k}) OVER w AS {s}_lag_{k}" for s in TWO for k in ft.LAGS)
    lags = f"g AS (SELECT equipment_id, event_us, {lag_parts} FROM tv WINDOW w AS (PARTITION BY equipment_id ORDER BY event_us, event_id))"
    rows += [f"SELECT equipment_id, event_us, '{s}_lag_{k}', {s}_lag_{k} FROM g" for s in TWO for k in ft.LAGS]
    rows.append("SELECT equipment_id, event_us, 'sensor_2_to_sensor_1_ratio', round(sensor_2 / nullif(sensor_1, 0), 6) FROM tv")
    return f"WITH {q.READINGS}, {base}, {lags} SELECT * FROM ({' UNION ALL '.join(rows)})"


@query("engineered_features", _engineered_sql())
def _engineered(spark, folder):
    rows = readings(spark, folder).withColumn("row_index", F.col("cycle"))
    out = ft.engineer_features(rows, TWO)
    plain = out.where(~F.col("feature").contains("_fft_"))
    return plain.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "feature", F.round("feature_value", 6).alias("feature_value"))


@query(
    "packed_feature_map_set2",
    f"WITH {q.READINGS} SELECT equipment_id, event_us, cycle, 2 * (12 + 12 + 5) + 1 AS features, round(sensor_2 / nullif(sensor_1, 0), 6) AS ratio FROM tv",
)
def _packed_map(spark, folder):
    rows = readings(spark, folder).withColumn("row_index", F.col("cycle"))
    packed = pr.pack_long_features(ft.engineer_features(rows, TWO, blocks=True), blocks=ft.feature_blocks(TWO))
    value = F.try_element_at("feature_payload", F.lit("sensor_2_to_sensor_1_ratio"))
    return packed.select("equipment_id", F.unix_micros("event_time").alias("event_us"), "cycle",
                         F.size("feature_payload").alias("features"), F.round(value, 6).alias("ratio"))
